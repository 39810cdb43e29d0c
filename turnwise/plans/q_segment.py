"""Queries for segmentation windows (W1-W10) and the steady-conversation filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, segment
from ..sources import fixtures as fx
from .catalog import register
from .oracle import sql

_W = "PARTITION BY conversation_id ORDER BY turn_id"


@register("w1_segment_by_key", sql(["topic_turns"], """
    SELECT conversation_id, sub_conversation_id, turn_id, agent, message, knowledge_source, topic_shift
    FROM topic_turns"""))
def w1_segment_by_key(spark, sf_dir):
    return segment.segment_by_key(fx.keyed_turns(spark, sf_dir), "knowledge_source").select(
        "conversation_id", "sub_conversation_id", "turn_id", "agent", "message",
        "knowledge_source", "topic_shift")


@register("w1_segment_events", sql(["event_turns"], """
    SELECT conversation_id, sub_conversation_id, turn_id, knowledge_source, topic_shift
    FROM event_turns"""))
def w1_segment_events(spark, sf_dir):
    """W1 on long conversations (events per user, key = event type)."""
    return segment.segment_by_key(fx.keyed_events(spark, sf_dir), "knowledge_source").select(
        "conversation_id", "sub_conversation_id", "turn_id", "knowledge_source", "topic_shift")


@register("w2_change_flag", sql(["topic_turns"], f"""
    SELECT conversation_id, turn_id, sub_conversation_id,
           CASE WHEN lag(turn_id) OVER ({_W}) IS NULL THEN 1
                WHEN sub_conversation_id IS DISTINCT FROM lag(sub_conversation_id) OVER ({_W}) THEN 1
                ELSE 0 END AS sub_convo_change
    FROM topic_turns"""))
def w2_change_flag(spark, sf_dir):
    t = fx.topic_turns(spark, sf_dir).select("conversation_id", "turn_id", "sub_conversation_id")
    return segment.change_flag(t, scope="conversation")


@register("w2_change_flag_global", sql(["topic_turns"], """
    SELECT conversation_id, turn_id, sub_conversation_id,
           CASE WHEN lag(turn_id) OVER w IS NULL THEN 1
                WHEN sub_conversation_id IS DISTINCT FROM lag(sub_conversation_id) OVER w THEN 1
                ELSE 0 END AS sub_convo_change
    FROM topic_turns WINDOW w AS (ORDER BY conversation_id, turn_id)"""))
def w2_change_flag_global(spark, sf_dir):
    """W2 over the whole table in row order (the reference's stacked-table diff)."""
    t = fx.topic_turns(spark, sf_dir).select("conversation_id", "turn_id", "sub_conversation_id")
    return segment.change_flag(t, scope="global")


@register("w3_boundaries", sql(["preds"], f"""
    SELECT conversation_id, turn_id, topic_shift, pred_shift,
           CASE WHEN coalesce(lag(topic_shift) OVER ({_W}), topic_shift) <> topic_shift THEN 1 ELSE 0 END
             AS true_boundary,
           CASE WHEN coalesce(lag(pred_shift) OVER ({_W}), pred_shift) <> pred_shift THEN 1 ELSE 0 END
             AS pred_boundary
    FROM preds"""))
def w3_boundaries(spark, sf_dir):
    p = fx.preds(spark, sf_dir).select("conversation_id", "turn_id", "topic_shift", "pred_shift")
    return segment.boundaries(p, ["topic_shift", "pred_shift"], ["true_boundary", "pred_boundary"])


@register("w3_boundaries_global", sql(["preds"], """
    SELECT conversation_id, turn_id, topic_shift,
           CASE WHEN coalesce(lag(topic_shift) OVER (ORDER BY conversation_id, turn_id), topic_shift)
                     <> topic_shift THEN 1 ELSE 0 END AS true_boundary
    FROM preds"""))
def w3_boundaries_global(spark, sf_dir):
    p = fx.preds(spark, sf_dir).select("conversation_id", "turn_id", "topic_shift")
    return segment.boundaries(p, "topic_shift", "true_boundary", scope="global")


@register("w4_boundary_positions", sql(["preds"], """
    SELECT pos FROM (
      SELECT row_number() OVER (ORDER BY conversation_id, turn_id) - 1 AS pos,
             CASE WHEN coalesce(lag(topic_shift) OVER (ORDER BY conversation_id, turn_id), topic_shift)
                       <> topic_shift THEN 1 ELSE 0 END AS b
      FROM preds) WHERE b = 1"""))
def w4_boundary_positions(spark, sf_dir):
    from ..plans.positions import with_position
    p = fx.preds(spark, sf_dir).select("conversation_id", "turn_id", "topic_shift")
    p = with_position(p, ["conversation_id", "turn_id"], "pos")
    p = segment.boundaries(p, "topic_shift", "b", scope="global", pos="pos")
    return segment.boundary_positions(p, "b", "pos")


_SHIFT_STATS = """
    pos AS (SELECT conversation_id, topic_shift,
                   row_number() OVER (PARTITION BY conversation_id ORDER BY turn_id) - 1 AS p
            FROM {src}),
    gaps AS (SELECT conversation_id, p - lag(p) OVER (PARTITION BY conversation_id ORDER BY p) AS d
             FROM pos WHERE topic_shift = 1),
    stats AS (
      SELECT c.conversation_id, c.total_shifts,
             CAST(coalesce(g.single_turn_shifts, 0) AS BIGINT) AS single_turn_shifts,
             CAST(coalesce(g.multi_turn_shifts, 0) AS BIGINT) AS multi_turn_shifts,
             CAST(coalesce(g.len_turn_diffs, 0) AS BIGINT) AS len_turn_diffs
      FROM (SELECT conversation_id,
                   CAST(sum(CASE WHEN topic_shift = 1 THEN 1 ELSE 0 END) AS BIGINT) AS total_shifts
            FROM {src} GROUP BY conversation_id) c
      LEFT JOIN (SELECT conversation_id, count(d) AS len_turn_diffs,
                        count_if(d = 1) AS single_turn_shifts, count_if(d > 1) AS multi_turn_shifts
                 FROM gaps GROUP BY conversation_id) g USING (conversation_id)),
    ratio AS (SELECT *, CASE WHEN len_turn_diffs > 0
                             THEN CAST(printf('%.3f', single_turn_shifts / len_turn_diffs) AS DOUBLE) ELSE 0.0 END
                        AS single_turn_ratio FROM stats)"""


def _stats_sql(views, src, body):
    return sql(views, body, _SHIFT_STATS.format(src=src))


@register("w5_shift_stats", _stats_sql(["topic_turns"], "topic_turns", "SELECT * FROM stats"))
def w5_shift_stats(spark, sf_dir):
    return segment.shift_stats(fx.topic_turns(spark, sf_dir))


@register("w5_shift_stats_events", _stats_sql(["event_turns"], "event_turns", "SELECT * FROM stats"))
def w5_shift_stats_events(spark, sf_dir):
    return segment.shift_stats(fx.event_turns(spark, sf_dir))


@register("w5_shift_gaps", sql(["event_turns"], """
    SELECT conversation_id, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY p) - 1 AS BIGINT)
             AS gap_index, CAST(d AS BIGINT) AS turn_diff
    FROM (SELECT conversation_id, p, p - lag(p) OVER (PARTITION BY conversation_id ORDER BY p) AS d
          FROM (SELECT conversation_id, topic_shift,
                       row_number() OVER (PARTITION BY conversation_id ORDER BY turn_id) - 1 AS p
                FROM event_turns) WHERE topic_shift = 1)
    WHERE d IS NOT NULL"""))
def w5_shift_gaps(spark, sf_dir):
    return segment.shift_gaps(fx.event_turns(spark, sf_dir))


@register("w6_single_turn_ratio", _stats_sql(["topic_turns"], "topic_turns", """
    SELECT conversation_id, len_turn_diffs, single_turn_shifts, single_turn_ratio FROM ratio"""))
def w6_single_turn_ratio(spark, sf_dir):
    s = segment.single_turn_ratio(segment.shift_stats(fx.topic_turns(spark, sf_dir)))
    return s.select("conversation_id", "len_turn_diffs", "single_turn_shifts", "single_turn_ratio")


@register("j1_keep_steady", _stats_sql(["topic_turns"], "topic_turns", """
    SELECT conversation_id, sub_conversation_id, turn_id, agent, message, topic_shift
    FROM topic_turns
    WHERE conversation_id IN (SELECT conversation_id FROM ratio WHERE single_turn_ratio <= 0.7)"""))
def j1_keep_steady(spark, sf_dir):
    t = fx.topic_turns(spark, sf_dir)
    r = segment.single_turn_ratio(segment.shift_stats(t))
    return joins.keep_steady(t, r, 0.7).select(
        "conversation_id", "sub_conversation_id", "turn_id", "agent", "message", "topic_shift")


@register("j1_keep_steady_events", _stats_sql(["event_turns"], "event_turns", """
    SELECT conversation_id, sub_conversation_id, turn_id, topic_shift
    FROM event_turns
    WHERE conversation_id IN (SELECT conversation_id FROM ratio WHERE single_turn_ratio <= 0.7)"""))
def j1_keep_steady_events(spark, sf_dir):
    t = fx.event_turns(spark, sf_dir)
    r = segment.single_turn_ratio(segment.shift_stats(t))
    return joins.keep_steady(t, r, 0.7).select(
        "conversation_id", "sub_conversation_id", "turn_id", "topic_shift")


def steady_conversations(spark, sf_dir):
    """Flagship: which conversations change topic steadily, and how often?"""
    t = fx.topic_turns(spark, sf_dir)
    r = segment.single_turn_ratio(segment.shift_stats(t))
    n = t.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_turns"))
    return r.filter(F.col("single_turn_ratio") <= 0.7).join(n, "conversation_id")


@register("w7_with_history", sql(["topic_turns"], """
    SELECT conversation_id, sub_conversation_id, turn_id,
           coalesce(string_agg(message, ' ') OVER (PARTITION BY conversation_id, sub_conversation_id
                    ORDER BY turn_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history
    FROM topic_turns"""))
def w7_with_history(spark, sf_dir):
    t = fx.topic_turns(spark, sf_dir)
    return segment.with_history(t, "segment").select(
        "conversation_id", "sub_conversation_id", "turn_id", "history")


@register("w7_with_history_conversation", sql(["topic_turns"], """
    SELECT conversation_id, turn_id,
           coalesce(string_agg(message, ' ') OVER (PARTITION BY conversation_id
                    ORDER BY turn_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history
    FROM topic_turns"""))
def w7_with_history_conversation(spark, sf_dir):
    t = fx.topic_turns(spark, sf_dir)
    return segment.with_history(t, "conversation").select("conversation_id", "turn_id", "history")


@register("w8_model_input", sql(["topic_turns"], """
    SELECT conversation_id, turn_id, topic_shift,
           'History: ' || coalesce(string_agg(message, ' ') OVER (PARTITION BY conversation_id,
                sub_conversation_id ORDER BY turn_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')
           || ' New message: ' || message AS input_text
    FROM topic_turns"""))
def w8_model_input(spark, sf_dir):
    t = segment.with_history(fx.topic_turns(spark, sf_dir), "segment")
    return segment.model_input(t).select("conversation_id", "turn_id", "topic_shift", "input_text")


@register("w9_turn_pairs", sql(["topic_turns"], f"""
    SELECT conversation_id, turn_id, topic_shift, message_1, message_2 FROM (
      SELECT conversation_id, turn_id, topic_shift, lag(message) OVER ({_W}) AS message_1,
             message AS message_2, lag(turn_id) OVER ({_W}) AS pt
      FROM topic_turns) WHERE pt IS NOT NULL"""))
def w9_turn_pairs(spark, sf_dir):
    t = fx.topic_turns(spark, sf_dir).select("conversation_id", "turn_id", "topic_shift", "message")
    d = segment.turn_pairs(t)
    return d.select("conversation_id", "turn_id", "topic_shift", "message_1", "message_2")


W10_N = 16


def _ws_tokens_sql(x):
    from .oracle import WS
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda z: z <> '')"


@register("w10_truncate_tokens", sql(["topic_turns"], f"""
    SELECT conversation_id, turn_id,
           array_to_string({_ws_tokens_sql('input_text')}[1:{W10_N}], ' ') AS kept_right,
           array_to_string(CASE WHEN len({_ws_tokens_sql('input_text')}) > {W10_N}
                                THEN {_ws_tokens_sql('input_text')}[-{W10_N}:]
                                ELSE {_ws_tokens_sql('input_text')} END, ' ') AS kept_left
    FROM (SELECT conversation_id, turn_id,
                 'History: ' || coalesce(string_agg(message, ' ') OVER (PARTITION BY conversation_id,
                      sub_conversation_id ORDER BY turn_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')
                 || ' New message: ' || message AS input_text
          FROM topic_turns)"""))
def w10_truncate_tokens(spark, sf_dir):
    t = segment.model_input(segment.with_history(fx.topic_turns(spark, sf_dir), "segment"))
    t = segment.token_budget(t, "input_text", W10_N, "right", "kept_right")
    t = segment.token_budget(t, "input_text", W10_N, "left", "kept_left")
    return t.select("conversation_id", "turn_id", "kept_right", "kept_left")


def _budget_sql(view: str, part: str, n: int, side: str = "right") -> str:
    words = _ws_tokens_sql('input_text')
    kept = f"{words}[1:{n}]" if side == "right" else f"CASE WHEN len({words}) > {n} THEN {words}[-{n}:] ELSE {words} END"
    return sql([view], f"""
    SELECT conversation_id, turn_id,
           array_to_string({kept}, ' ') AS input_text
    FROM (SELECT conversation_id, turn_id,
                 'History: ' || coalesce(string_agg(message, ' ') OVER (PARTITION BY {part}
                      ORDER BY turn_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')
                 || ' New message: ' || message AS input_text
          FROM {view})""")


@register("w10_budgeted_model_input", _budget_sql("topic_turns", "conversation_id, sub_conversation_id", 24))
def w10_budgeted_model_input(spark, sf_dir):
    """First 24 tokens of the segment-history model input, without the quadratic history."""
    t = segment.budgeted_model_input(fx.topic_turns(spark, sf_dir), 24, "segment")
    return t.select("conversation_id", "turn_id", "input_text")


@register("w10_budgeted_model_input_events", _budget_sql("event_turns", "conversation_id", 40))
def w10_budgeted_model_input_events(spark, sf_dir):
    """First 40 tokens of the whole-conversation history input on long event conversations."""
    t = segment.budgeted_model_input(fx.event_turns(spark, sf_dir), 40, "conversation")
    return t.select("conversation_id", "turn_id", "input_text")


@register("w10_newest_first", _budget_sql("topic_turns", "conversation_id", 96, "left"))
def w10_newest_first(spark, sf_dir):
    """The last 96 tokens of the whole-conversation input: the newest history stays."""
    t = segment.budgeted_model_input(fx.topic_turns(spark, sf_dir), 96, "conversation", side="left")
    return t.select("conversation_id", "turn_id", "input_text")


@register("w10_newest_first_events", _budget_sql("event_turns", "conversation_id", 40, "left"))
def w10_newest_first_events(spark, sf_dir):
    """The same on long event conversations, 40 tokens."""
    t = segment.budgeted_model_input(fx.event_turns(spark, sf_dir), 40, "conversation", side="left")
    return t.select("conversation_id", "turn_id", "input_text")


@register("w10_newest_first_lines", _budget_sql("doc_topic_turns", "conversation_id, sub_conversation_id", 48, "left"))
def w10_newest_first_lines(spark, sf_dir):
    """Document lines, history of the segment."""
    t = segment.budgeted_model_input(fx.doc_topic_turns(spark, sf_dir), 48, "segment", side="left")
    return t.select("conversation_id", "turn_id", "input_text")
