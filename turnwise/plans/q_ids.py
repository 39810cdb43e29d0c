"""Queries for sorting, ids and offsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ids, joins
from ..sources import fixtures as fx
from .catalog import register
from .oracle import sql


@register("n1_sort_turns", sql(["topic_turns"], """
    SELECT conversation_id, turn_id, sub_conversation_id FROM topic_turns
    ORDER BY conversation_id, turn_id"""))
def n1_sort_turns(spark, sf_dir):
    t = fx.topic_turns(spark, sf_dir).select("conversation_id", "turn_id", "sub_conversation_id")
    return ids.sort_turns(t)


_FIRST_SEEN = """
    firsts AS (SELECT user_id, min(ts) AS t0, arg_min(event_id, ts) AS e0 FROM events GROUP BY user_id),
    idmap AS (SELECT user_id, CAST(row_number() OVER (ORDER BY t0, e0, user_id) - 1 AS BIGINT)
                AS conversation_id FROM firsts)"""


@register("n2_dense_ids", sql([], "SELECT user_id, conversation_id FROM idmap", _FIRST_SEEN))
def n2_dense_ids(spark, sf_dir):
    """Users numbered 0.. in order of their first event."""
    from ..plans.positions import dense_rank_of
    e = fx.table(spark, sf_dir, "events")
    return dense_rank_of(e, ["user_id"], ["ts", "event_id"], "conversation_id")


@register("j4_lookup_join", sql([], """
    SELECT e.event_id, m.conversation_id, e.event_type FROM events e JOIN idmap m USING (user_id)""",
                                _FIRST_SEEN))
def j4_lookup_join(spark, sf_dir):
    """N2's mapping joined back to every event."""
    e = fx.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return ids.dense_ids(e, "user_id", ["ts", "event_id"], "conversation_id") \
              .select("event_id", "conversation_id", "event_type")


@register("n4_row_index", sql(["topic_turns"], """
    SELECT conversation_id, turn_id,
           CAST(row_number() OVER (ORDER BY conversation_id, turn_id) - 1 AS BIGINT) AS "index"
    FROM topic_turns"""))
def n4_row_index(spark, sf_dir):
    t = fx.topic_turns(spark, sf_dir).select("conversation_id", "turn_id")
    return ids.row_index(t, ["conversation_id", "turn_id"], "index")


def _stack_sql(step: int) -> str:
    return sql(["topic_turns", "event_turns", "doc_turns"], f"""
    SELECT 'topic' AS source, conversation_id, turn_id FROM topic_turns
    UNION ALL
    SELECT 'events', conversation_id + (SELECT max(conversation_id) + {step} FROM topic_turns), turn_id
    FROM event_turns
    UNION ALL
    SELECT 'docs', conversation_id + (SELECT max(conversation_id) + {step} FROM topic_turns)
                   + (SELECT max(conversation_id) + {step} FROM event_turns), turn_id
    FROM doc_turns""")


def _stack(spark, sf_dir, mode):
    # Ids and turns only: the segmented views have the same rows.
    parts = [fx.turns(spark, sf_dir).withColumn("source", F.lit("topic")),
             fx.ranked_events(spark, sf_dir).withColumn("source", F.lit("events")),
             fx.doc_turns(spark, sf_dir).withColumn("source", F.lit("docs"))]
    parts = [p.select("source", "conversation_id", "turn_id") for p in parts]
    return joins.stack(ids.offset_ids(parts, mode=mode))


@register("n5_offset_ids", _stack_sql(1))
def n5_offset_ids(spark, sf_dir):
    return _stack(spark, sf_dir, "safe")


@register("n5_offset_ids_reference", _stack_sql(0))
def n5_offset_ids_reference(spark, sf_dir):
    return _stack(spark, sf_dir, "reference")


@register("j2_stack", sql(["topic_turns", "event_turns", "doc_turns"], """
    SELECT conversation_id, turn_id, message, agent, sub_conversation_id, topic_shift FROM topic_turns
    UNION ALL
    SELECT conversation_id + (SELECT max(conversation_id) + 1 FROM topic_turns), turn_id, message, agent,
           sub_conversation_id, topic_shift FROM event_turns
    UNION ALL
    SELECT conversation_id + (SELECT max(conversation_id) + 1 FROM topic_turns)
             + (SELECT max(conversation_id) + 1 FROM event_turns),
           turn_id, message, NULL, NULL, NULL FROM doc_turns"""))
def j2_stack(spark, sf_dir):
    """Outer union by name: documents have no agent, segment or label columns."""
    a = fx.topic_turns(spark, sf_dir).select("conversation_id", "turn_id", "message", "agent",
                                            "sub_conversation_id", "topic_shift")
    b = fx.event_turns(spark, sf_dir).select("conversation_id", "turn_id", "message", "agent",
                                            "sub_conversation_id", "topic_shift")
    c = fx.doc_turns(spark, sf_dir)
    return joins.stack(ids.offset_ids([a, b, c]))
