"""Queries for aggregations and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, profile, segment
from ..sources import fixtures as fx
from .catalog import r6, register
from .oracle import sql
from .q_segment import _SHIFT_STATS


@register("a1_value_counts", sql(["topic_turns"], """
    SELECT topic_shift, count(*) AS count FROM topic_turns GROUP BY topic_shift"""))
def a1_value_counts(spark, sf_dir):
    return profile.value_counts(fx.topic_turns(spark, sf_dir), "topic_shift")


@register("a1_value_counts_agent", sql(["turns"], """
    SELECT agent, count(*) AS count FROM turns GROUP BY agent"""))
def a1_value_counts_agent(spark, sf_dir):
    return profile.value_counts(fx.turns(spark, sf_dir), "agent")


@register("a2_n_unique", sql(["doc_turns"], """
    SELECT count(DISTINCT message) AS n_unique_message, count(DISTINCT conversation_id)
           AS n_unique_conversation_id FROM doc_turns"""))
def a2_n_unique(spark, sf_dir):
    """Distinct document lines (repeated lines occur) and documents."""
    return profile.n_unique(fx.doc_turns(spark, sf_dir), ["message", "conversation_id"])


@register("a3_segment_histogram", sql(["event_turns"], """
    SELECT max_segment, count(*) AS n_conversations FROM (
      SELECT conversation_id, max(sub_conversation_id) AS max_segment FROM event_turns
      GROUP BY conversation_id) GROUP BY max_segment"""))
def a3_segment_histogram(spark, sf_dir):
    return profile.segment_histogram(fx.event_turns(spark, sf_dir))


@register("a4_turn_histogram", sql(["turns"], """
    SELECT n_turns, count(*) AS n_conversations FROM (
      SELECT conversation_id, count(*) AS n_turns FROM turns GROUP BY conversation_id)
    GROUP BY n_turns"""))
def a4_turn_histogram(spark, sf_dir):
    return profile.turn_histogram(fx.turns(spark, sf_dir))


def _edge(i: str) -> str:
    return f"CASE WHEN {i} >= 20 THEN mm.hi ELSE CAST({i} AS DOUBLE) * ((mm.hi - mm.lo) / 20) + mm.lo END"


_I0 = "CAST(floor((single_turn_ratio - mm.lo) * (20.0 / (mm.hi - mm.lo))) AS BIGINT)"
_I1 = f"CASE WHEN {_I0} >= 20 THEN 19 ELSE {_I0} END"
_I2 = f"CASE WHEN single_turn_ratio < {_edge(_I1)} THEN {_I1} - 1 ELSE {_I1} END"
_I3 = f"CASE WHEN single_turn_ratio >= {_edge(f'({_I2}) + 1')} AND ({_I2}) <> 19 THEN ({_I2}) + 1 ELSE {_I2} END"


@register("a5_histogram", sql(["event_turns"], f"""
    SELECT b.bin, round({_edge('b.bin')}, 6) AS lo, round({_edge('b.bin + 1')}, 6) AS hi,
           CAST(coalesce(c.count, 0) AS BIGINT) AS count
    FROM (SELECT range AS bin FROM range(20)) b
    CROSS JOIN mm
    LEFT JOIN (SELECT {_I3} AS bin, count(*) AS count
               FROM ratio CROSS JOIN mm GROUP BY 1) c USING (bin)""",
                                   _SHIFT_STATS.format(src="event_turns") + """,
    mm AS (SELECT CASE WHEN min(single_turn_ratio) = max(single_turn_ratio)
                       THEN min(single_turn_ratio) - 0.5 ELSE min(single_turn_ratio) END AS lo,
                  CASE WHEN min(single_turn_ratio) = max(single_turn_ratio)
                       THEN max(single_turn_ratio) + 0.5 ELSE max(single_turn_ratio) END AS hi
           FROM ratio)"""))
def a5_histogram(spark, sf_dir):
    """20-bin histogram of the single-turn shift ratio of the event conversations."""
    r = segment.single_turn_ratio(segment.shift_stats(fx.event_turns(spark, sf_dir)))
    h = profile.histogram(r, "single_turn_ratio", 20)
    return h.select("bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "count")


@register("a6_class_balance", sql(["topic_turns"], """
    SELECT count(*) AS rows, CAST(sum(topic_shift) AS BIGINT) AS positives,
           round(avg(topic_shift), 6) AS positive_share FROM topic_turns"""))
def a6_class_balance(spark, sf_dir):
    b = profile.class_balance(fx.topic_turns(spark, sf_dir))
    return b.select("rows", "positives", r6("positive_share").alias("positive_share"))


@register("a7_filter_report", sql(["topic_turns"], """
    SELECT 'before' AS stage, count(*) AS rows FROM topic_turns
    UNION ALL SELECT 'after', count(*) FROM topic_turns WHERE sub_conversation_id <= 1"""))
def a7_filter_report(spark, sf_dir):
    t = fx.topic_turns(spark, sf_dir)
    return profile.filter_report(t, clean.cap_segments(t, 1))


@register("a8_profile", sql([], """
    SELECT 'conv_id' AS column_name, 0 AS ordinal, 'bigint' AS dtype, count(conv_id) AS non_null
      FROM conversations
    UNION ALL SELECT 'turn', 1, 'bigint', count(turn) FROM conversations
    UNION ALL SELECT 'role', 2, 'string', count(role) FROM conversations
    UNION ALL SELECT 'text', 3, 'string', count(text) FROM conversations"""))
def a8_profile(spark, sf_dir):
    return profile.profile(fx.table(spark, sf_dir, "conversations"))


@register("a9_corpus_summary", sql(["topic_turns", "event_turns", "emb_turns"], """
    SELECT source, CAST(sum(n) AS BIGINT) AS rows, count(*) AS conversations,
           round(avg(s), 6) AS avg_shifts
    FROM (SELECT source, conversation_id, count(*) AS n, sum(topic_shift) AS s FROM (
            SELECT 'topic' AS source, conversation_id, topic_shift FROM topic_turns
            UNION ALL SELECT 'events', conversation_id, topic_shift FROM event_turns
            UNION ALL SELECT 'emb', conversation_id, topic_shift FROM emb_turns)
          GROUP BY source, conversation_id)
    GROUP BY source"""))
def a9_corpus_summary(spark, sf_dir):
    parts = [fx.topic_turns(spark, sf_dir).withColumn("source", F.lit("topic")),
             fx.event_turns(spark, sf_dir).withColumn("source", F.lit("events")),
             fx.emb_turns(spark, sf_dir).withColumn("source", F.lit("emb"))]
    u = None
    for p in parts:
        p = p.select("source", "conversation_id", "topic_shift")
        u = p if u is None else u.unionByName(p)
    s = profile.corpus_summary(u)
    return s.select("source", "rows", "conversations", r6("avg_shifts").alias("avg_shifts"))


@register("a10_class_weights", sql(["topic_turns"], """
    SELECT topic_shift, n_c, round(sum(n_c) OVER () / (count(*) OVER () * n_c), 6) AS weight
    FROM (SELECT CASE WHEN turn_id = 0 AND topic_shift = 1 THEN 0 ELSE topic_shift END AS topic_shift,
                 count(*) AS n_c FROM topic_turns GROUP BY 1)"""))
def a10_class_weights(spark, sf_dir):
    """Balanced class weights of the labels after the first-turn reset (P10)."""
    t = clean.reset_first_turn(fx.topic_turns(spark, sf_dir))
    w = profile.class_weights(t, "topic_shift")
    return w.select("topic_shift", "n_c", r6("weight").alias("weight"))


@register("a11_max_of", sql(["event_turns"], """
    SELECT max(conversation_id) AS max_conversation_id FROM event_turns"""))
def a11_max_of(spark, sf_dir):
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("conversation_id"))
    return profile.max_of(users, "conversation_id")
