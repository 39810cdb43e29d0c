"""Queries for projections, filters and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean
from ..sources import fixtures as fx
from .catalog import register
from .oracle import norm_text, sql

_W = "PARTITION BY conversation_id ORDER BY turn_id"


@register("p1_to_canonical", sql([], """
    SELECT conv_id AS conversation_id, turn AS turn_id, role AS agent, text AS message
    FROM conversations"""))
def p1_to_canonical(spark, sf_dir):
    c = fx.table(spark, sf_dir, "conversations")
    return clean.to_canonical(c, {"conv_id": "conversation_id", "turn": "turn_id",
                                  "role": "agent", "text": "message"}, drop=["Unnamed: 0"])


@register("p2_normalize_label", sql(["topic_turns"], """
    SELECT conversation_id, turn_id, topic_shift AS from_bool_text,
           CASE WHEN topic_shift = 1 THEN 1 ELSE 0 END AS from_pair_label
    FROM topic_turns"""))
def p2_normalize_label(spark, sf_dir):
    """Labels written as 'True'/'False' and 'positive'/'negative' text, normalised to 0/1."""
    t = fx.topic_turns(spark, sf_dir)
    t = t.select("conversation_id", "turn_id",
                 F.when(F.col("topic_shift") == 1, "True").otherwise("False").alias("from_bool_text"),
                 F.when(F.col("topic_shift") == 1, "positive").otherwise("negative").alias("from_pair_label"))
    t = clean.with_label(t, "from_bool_text")
    return clean.with_label(t, "from_pair_label")


@register("p3_normalize_text", sql(["turns"], f"""
    SELECT conversation_id, turn_id, {norm_text('message')} AS norm_message FROM turns"""))
def p3_normalize_text(spark, sf_dir):
    t = fx.turns(spark, sf_dir)
    return clean.with_normalized_text(t, "message", "norm_message").select(
        "conversation_id", "turn_id", "norm_message")


@register("p4_turn_count", sql(["blobs"], """
    SELECT conversation_id,
           CAST(len(regexp_extract_all(best_generated_conversation, '(?i)\\nUser')) + 1 AS BIGINT)
             AS total_turns
    FROM blobs"""))
def p4_turn_count(spark, sf_dir):
    b = fx.blobs(spark, sf_dir)
    return clean.with_turn_count(b, "best_generated_conversation").select("conversation_id", "total_turns")


@register("p5_cap_segments", sql(["topic_turns"], """
    SELECT conversation_id, sub_conversation_id, turn_id, topic_shift FROM topic_turns
    WHERE sub_conversation_id <= 2"""))
def p5_cap_segments(spark, sf_dir):
    t = fx.topic_turns(spark, sf_dir)
    return clean.cap_segments(t, 2).select("conversation_id", "sub_conversation_id", "turn_id", "topic_shift")


@register("p6_subset", sql(["turns"], """
    SELECT conversation_id, turn_id, message FROM turns WHERE agent = 'assistant'"""))
def p6_subset(spark, sf_dir):
    t = fx.turns(spark, sf_dir)
    return clean.subset(t, F.col("agent") == "assistant").select("conversation_id", "turn_id", "message")


@register("p7_drop_trailing", sql(["turns"], f"""
    SELECT conversation_id, turn_id, agent FROM (
      SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn_id DESC) AS rd FROM turns)
    WHERE rd > 2"""))
def p7_drop_trailing(spark, sf_dir):
    t = fx.turns(spark, sf_dir)
    return clean.drop_trailing(t, 2).select("conversation_id", "turn_id", "agent")


@register("p8_cap_turns_drop_busy", sql(["event_turns"], f"""
    SELECT conversation_id, turn_id, topic_shift FROM event_turns
    WHERE turn_id < 20 AND conversation_id IN (
      SELECT conversation_id FROM event_turns WHERE turn_id < 20
      GROUP BY conversation_id HAVING sum(topic_shift) <= 12)"""))
def p8_cap_turns_drop_busy(spark, sf_dir):
    """At most 20 turns per conversation, then drop conversations with more than 12 shifts."""
    t = fx.event_turns(spark, sf_dir)
    t = clean.cap_turns(t, 20)
    return clean.drop_busy(t, 12).select("conversation_id", "turn_id", "topic_shift")


@register("p9_assign_speakers", sql(["turns"], """
    SELECT conversation_id, turn_id,
           CASE WHEN turn_id % 2 = 0 THEN 'agent_1' ELSE 'agent_2' END AS speaker FROM turns"""))
def p9_assign_speakers(spark, sf_dir):
    t = fx.turns(spark, sf_dir)
    return clean.assign_speakers(t, out="speaker").select("conversation_id", "turn_id", "speaker")


@register("p10_reset_first_turn", sql(["topic_turns"], """
    SELECT conversation_id, turn_id,
           CASE WHEN turn_id = 0 AND topic_shift = 1 THEN 0 ELSE topic_shift END AS topic_shift
    FROM topic_turns"""))
def p10_reset_first_turn(spark, sf_dir):
    t = fx.topic_turns(spark, sf_dir)
    return clean.reset_first_turn(t).select("conversation_id", "turn_id", "topic_shift")


@register("p10_reset_first_row", sql(["event_turns"], """
    SELECT conversation_id, turn_id,
           CASE WHEN turn_id = min(turn_id) OVER (PARTITION BY conversation_id) AND topic_shift = 1
                THEN 0 ELSE topic_shift END AS topic_shift
    FROM (SELECT * REPLACE (turn_id + 3 AS turn_id) FROM event_turns)"""))
def p10_reset_first_row(spark, sf_dir):
    """``first='first_row'`` on conversations that do not start at turn 0 (turn ids moved up by 3)."""
    t = fx.event_turns(spark, sf_dir).withColumn("turn_id", F.col("turn_id") + 3)
    return clean.reset_first_turn(t, "first_row").select("conversation_id", "turn_id", "topic_shift")


@register("p11_preview", sql(["turns"], """
    SELECT conversation_id, turn_id, message FROM turns
    ORDER BY conversation_id, turn_id LIMIT 25"""))
def p11_preview(spark, sf_dir):
    t = fx.turns(spark, sf_dir).select("conversation_id", "turn_id", "message")
    return clean.preview(t, 25, ["conversation_id", "turn_id"])
