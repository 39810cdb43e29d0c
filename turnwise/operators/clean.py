"""Projections, filters and label/text cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_label, normalize_text, turn_count
from ..plans.scan import ordered_scan, with_running_sum

CONV, SEG, TURN = "conversation_id", "sub_conversation_id", "turn_id"


def to_canonical(df: DataFrame, mapping: Mapping[str, str],
                 drop: Sequence[str] = ()) -> DataFrame:
    """Rename ``old -> new`` and drop columns (e.g. a saved index ``Unnamed: 0``)."""
    d = df.drop(*[c for c in drop if c in df.columns])
    for old, new in mapping.items():
        d = d.withColumnRenamed(old, new)
    return d


def with_label(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Bool / string labels to 0/1 (``'True'``, ``'positive'`` ... -> 1)."""
    return df.withColumn(out or col, normalize_label(col))


def with_normalized_text(df: DataFrame, col: str = "message", out: str | None = None) -> DataFrame:
    """Lower-case, runs of non-word characters to one space."""
    return df.withColumn(out or col, normalize_text(col))


def with_turn_count(df: DataFrame, col: str, out: str = "total_turns") -> DataFrame:
    """Count of ``\\nUser`` (any case) plus one."""
    return df.withColumn(out, turn_count(col))


def cap_segments(df: DataFrame, n: int = 10, seg: str = SEG) -> DataFrame:
    """P5: keep rows whose segment id is <= ``n`` (truncates, keeps the conversation)."""
    return df.filter(F.col(seg) <= n)


def subset(df: DataFrame, predicate: Column) -> DataFrame:
    """Row filter (pushed down to the Parquet scan when it names scan columns)."""
    return df.filter(predicate)


def _with_counts(df: DataFrame, conv: str, turn: str) -> DataFrame:
    return ordered_scan(df, [conv], turn, sums={"_tw_rank": F.lit(1)}, totals={"_tw_n": F.lit(1)})


def drop_trailing(df: DataFrame, k: int = 2, conv: str = CONV, turn: str = TURN) -> DataFrame:
    """Drop each conversation's last ``k`` turns (conversations of <= k turns vanish)."""
    d = _with_counts(df, conv, turn)
    return d.filter(F.col("_tw_rank") <= F.col("_tw_n") - k).drop("_tw_rank", "_tw_n")


def cap_turns(df: DataFrame, n: int = 20, conv: str = CONV, turn: str = TURN) -> DataFrame:
    """Keep the first ``n`` turns of each conversation."""
    d = with_running_sum(df, [conv], turn, F.lit(1), "_tw_rank")
    return d.filter(F.col("_tw_rank") <= n).drop("_tw_rank")


def drop_busy(df: DataFrame, max_shifts: int = 5, conv: str = CONV,
              shift: str = "topic_shift", turn: str = TURN) -> DataFrame:
    """Remove conversations with more than ``max_shifts`` shifts."""
    d = ordered_scan(df, [conv], turn, totals={"_tw_s": F.col(shift)})
    return d.filter(F.col("_tw_s") <= max_shifts).drop("_tw_s")


def assign_speakers(df: DataFrame, turn: str = TURN, out: str = "agent") -> DataFrame:
    """``agent_1`` on even turn numbers, ``agent_2`` on odd ones."""
    return df.withColumn(out, F.when(F.col(turn) % 2 == 0, F.lit("agent_1")).otherwise(F.lit("agent_2")))


def reset_first_turn(df: DataFrame, first: str = "turn_id_zero", conv: str = CONV,
                     turn: str = TURN, shift: str = "topic_shift") -> DataFrame:
    """P10: a shift label on the first turn is reset to 0.

    ``first='turn_id_zero'`` (reference): the row with turn id 0;
    ``first='first_row'``: the lowest turn id of each conversation.
    """
    if first == "turn_id_zero":
        is_first = F.col(turn) == 0
        d = df
    elif first == "first_row":
        d = ordered_scan(df, [conv], turn, group_min={"_tw_t0": F.col(turn)})
        is_first = F.col(turn) == F.col("_tw_t0")
    else:
        raise ValueError("first must be 'turn_id_zero' or 'first_row'")
    d = d.withColumn(shift, F.when(is_first & (F.col(shift) == 1), F.lit(0))
                     .otherwise(F.col(shift)).cast("int"))
    return d.drop("_tw_t0") if first == "first_row" else d


def preview(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in ``order`` (a top-k: TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)
