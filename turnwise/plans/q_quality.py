"""Queries for data-quality checks and label repair (Q1-Q5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, quality
from ..sources import fixtures as fx
from .catalog import register
from .oracle import sql

_WS = "PARTITION BY conversation_id, sub_conversation_id ORDER BY turn_id"


def _q1_sql(stride: int) -> str:
    return sql(["event_turns"], f"""
    SELECT DISTINCT conversation_id, sub_conversation_id FROM (
      SELECT conversation_id, sub_conversation_id, agent,
             lead(agent) OVER ({_WS}) AS nxt, row_number() OVER ({_WS}) - 1 AS r
      FROM event_turns)
    WHERE r % {stride} = 0 AND nxt IS NOT NULL AND agent = nxt""")


@register("q1_non_alternating", _q1_sql(2))
def q1_non_alternating(spark, sf_dir):
    """Speaker = value band of the event; the reference's pairwise (stride 2) check."""
    return quality.non_alternating(fx.event_turns(spark, sf_dir), stride=2)


@register("q1_non_alternating_full", _q1_sql(1))
def q1_non_alternating_full(spark, sf_dir):
    return quality.non_alternating(fx.event_turns(spark, sf_dir), stride=1)


_RESET = """
    reset AS (SELECT conversation_id, sub_conversation_id, turn_id,
                     CASE WHEN turn_id = 0 AND topic_shift = 1 THEN 0 ELSE topic_shift END AS topic_shift
              FROM topic_turns)"""


def _fault_sql(window: str, body_src: str = "reset") -> str:
    return f"""
    SELECT CAST(count_if(chg = 1 AND topic_shift <> 1) AS BIGINT) AS fault_1,
           CAST(count_if(chg = 0 AND topic_shift = 1) AS BIGINT) AS fault_2
    FROM (SELECT *, CASE WHEN lag(turn_id) OVER w IS NULL THEN 1
                         WHEN sub_conversation_id IS DISTINCT FROM lag(sub_conversation_id) OVER w THEN 1
                         ELSE 0 END AS chg
          FROM {body_src} WINDOW w AS ({window}))"""


@register("q2_fault_counts", sql(["topic_turns"], _fault_sql(
    "PARTITION BY conversation_id ORDER BY turn_id"), _RESET))
def q2_fault_counts(spark, sf_dir):
    """Faults after the first-turn reset (P10), per conversation."""
    t = clean.reset_first_turn(fx.topic_turns(spark, sf_dir))
    return quality.fault_counts(t, "conversation")


@register("q2_fault_counts_global", sql(["topic_turns"], _fault_sql(
    "ORDER BY conversation_id, turn_id"), _RESET))
def q2_fault_counts_global(spark, sf_dir):
    """Faults over the stacked table in row order (the reference's diff)."""
    t = clean.reset_first_turn(fx.topic_turns(spark, sf_dir))
    return quality.fault_counts(t, "global")


_REPAIRED = _RESET + """,
    repaired AS (SELECT conversation_id, sub_conversation_id, turn_id,
                   CASE WHEN chg = 1 AND topic_shift <> 1 THEN 1 ELSE topic_shift END AS topic_shift
                 FROM (SELECT *, CASE WHEN lag(turn_id) OVER w IS NULL THEN 1
                         WHEN sub_conversation_id IS DISTINCT FROM lag(sub_conversation_id) OVER w THEN 1
                         ELSE 0 END AS chg
                       FROM reset WINDOW w AS (ORDER BY conversation_id, turn_id)))"""


@register("q3_repair_labels", sql(["topic_turns"], """
    SELECT conversation_id, turn_id, topic_shift FROM repaired""", _REPAIRED))
def q3_repair_labels(spark, sf_dir):
    t = clean.reset_first_turn(fx.topic_turns(spark, sf_dir))
    return quality.repair_labels(t, "global").select("conversation_id", "turn_id", "topic_shift")


@register("q3_faults_after_repair", sql(["topic_turns"], _fault_sql(
    "ORDER BY conversation_id, turn_id", "repaired"), _REPAIRED))
def q3_faults_after_repair(spark, sf_dir):
    """Property: fault (1) is 0 after the repair."""
    t = clean.reset_first_turn(fx.topic_turns(spark, sf_dir))
    return quality.fault_counts(quality.repair_labels(t, "global"), "global")


@register("q4_violations", sql(["preds"], """
    SELECT conversation_id, turn_id,
           CASE WHEN chg THEN 'Violation in conversation_id ' || conversation_id || ' at turn_id ' || turn_id
                              || ': sub_conversation_id changed but topic_shift != 1.'
                ELSE 'Violation in conversation_id ' || conversation_id || ' at turn_id ' || turn_id
                     || ': sub_conversation_id did not change but topic_shift == 1.' END AS violation
    FROM (SELECT conversation_id, turn_id, pred_shift AS topic_shift,
                 sub_conversation_id IS DISTINCT FROM lag(sub_conversation_id) OVER w AS chg,
                 lag(turn_id) OVER w AS pt
          FROM preds WINDOW w AS (PARTITION BY conversation_id ORDER BY turn_id))
    WHERE pt IS NOT NULL AND ((chg AND topic_shift <> 1) OR (NOT chg AND topic_shift = 1))"""))
def q4_violations(spark, sf_dir):
    """Weak lexical labels checked against the true segments."""
    p = fx.preds(spark, sf_dir).drop("topic_shift").withColumnRenamed("pred_shift", "topic_shift")
    return quality.violations(p)


@register("q5_turn_gaps_all", sql(["turns"], """
    SELECT conversation_id, min(turn_id) AS min_turn, max(turn_id) AS max_turn, count(*) AS n_turns,
           count(DISTINCT turn_id) AS n_distinct,
           CASE WHEN min(turn_id) = 0 AND max(turn_id) = count(*) - 1
                     AND count(DISTINCT turn_id) = count(*) THEN 1 ELSE 0 END AS continuous
    FROM turns GROUP BY conversation_id"""))
def q5_turn_gaps_all(spark, sf_dir):
    """Turn-id continuity over all turns: a gap is a gap of the table."""
    return quality.turn_gaps(fx.turns(spark, sf_dir))
