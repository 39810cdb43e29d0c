"""Data-quality checks and label repair (Q1-Q5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scan import ordered_scan, with_prev
from .segment import change_flag, keep

CONV, SEG, TURN = "conversation_id", "sub_conversation_id", "turn_id"

# Violation texts of the label/segment check.
VIOLATION_CHANGED = ("Violation in conversation_id {c} at turn_id {t}: "
                     "sub_conversation_id changed but topic_shift != 1.")
VIOLATION_UNCHANGED = ("Violation in conversation_id {c} at turn_id {t}: "
                       "sub_conversation_id did not change but topic_shift == 1.")


def non_alternating(df: DataFrame, stride: int = 2, agent: str = "agent",
                    conv: str = CONV, seg: str = SEG, turn: str = TURN) -> DataFrame:
    """Q1: segments where one speaker talks twice in a row.

    ``stride=2`` (reference) compares turn pairs (0,1), (2,3), ... of the
    segment only; ``stride=1`` compares every neighbouring pair.
    Returns the distinct ``(conversation, segment)`` with a repeat.
    """
    d = ordered_scan(keep(df, conv, seg, turn, agent), [conv, seg], turn, nxt=[agent], sums={"_r": F.lit(1)}, next_prefix="_n_")
    bad = d.filter(((F.col("_r") - 1) % stride == 0) & F.col("_n_" + agent).isNotNull()
                   & (F.col(agent) == F.col("_n_" + agent)))
    return bad.select(conv, seg).distinct()


def _faults(df: DataFrame, scope: str, seg: str, shift: str) -> DataFrame:
    d = change_flag(df, seg, scope=scope, out="_chg")
    f1 = (F.col("_chg") == 1) & ~(F.col(shift) == 1)
    f2 = (F.col("_chg") == 0) & (F.col(shift) == 1)
    return d.withColumn("_f1", f1).withColumn("_f2", f2)


def fault_counts(df: DataFrame, scope: str = "conversation", seg: str = SEG,
                 shift: str = "topic_shift") -> DataFrame:
    """Q2: (1) segment changed but label != 1, (2) no change but label == 1."""
    d = _faults(df, scope, seg, shift)
    return d.agg(F.count_if("_f1").alias("fault_1"), F.count_if("_f2").alias("fault_2"))


def repair_labels(df: DataFrame, scope: str = "conversation", seg: str = SEG,
                  shift: str = "topic_shift") -> DataFrame:
    """Q3: set the label to 1 where fault (1) holds; fault (2) is left as is."""
    d = _faults(df, scope, seg, shift)
    d = d.withColumn(shift, F.when(F.col("_f1"), F.lit(1)).otherwise(F.col(shift)).cast("int"))
    return d.drop("_chg", "_f1", "_f2")


def violations(df: DataFrame, conv: str = CONV, seg: str = SEG, turn: str = TURN,
               shift: str = "topic_shift") -> DataFrame:
    """Q4: one row per faulty turn, from the second turn of each conversation on."""
    d = with_prev(keep(df, conv, seg, turn, shift), [conv], turn, [seg, turn], prefix="_p_")
    has = F.col("_p_" + turn).isNotNull()
    changed = ~F.col(seg).eqNullSafe(F.col("_p_" + seg))
    cs, ts = F.col(conv).cast("string"), F.col(turn).cast("string")

    def text(tmpl):
        a, rest = tmpl.split("{c}")
        b, c = rest.split("{t}")
        return F.concat(F.lit(a), cs, F.lit(b), ts, F.lit(c))

    marked = F.coalesce(F.col(shift) == 1, F.lit(False))
    what = F.when(changed & (F.col(shift) != 1), text(VIOLATION_CHANGED)).when(~changed & marked, text(VIOLATION_UNCHANGED))
    return d.filter(has).select(conv, turn, what.alias("violation")).filter(F.col("violation").isNotNull())


def turn_gaps(df: DataFrame, conv: str = CONV, turn: str = TURN) -> DataFrame:
    """Q5: whether turn ids run 0, 1, ..., n-1 in each conversation."""
    g = df.groupBy(conv).agg(F.min(turn).alias("min_turn"), F.max(turn).alias("max_turn"),
                             F.count(F.lit(1)).alias("n_turns"),
                             F.countDistinct(turn).alias("n_distinct"))
    ok = (F.col("min_turn") == 0) & (F.col("max_turn") == F.col("n_turns") - 1) \
        & (F.col("n_distinct") == F.col("n_turns"))
    return g.withColumn("continuous", ok.cast("int"))
