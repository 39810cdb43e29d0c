"""Sorting, dense ids, row indexes and id offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.positions import dense_rank_of, with_position

CONV, TURN = "conversation_id", "turn_id"


def sort_turns(df: DataFrame, conv: str = CONV, turn: str = TURN) -> DataFrame:
    """Total order by conversation, turn (a range-partitioned sort)."""
    return df.orderBy(conv, turn)


def dense_ids(df: DataFrame, key: str, order: Sequence[Column | str],
              out: str = CONV, base: int = 0) -> DataFrame:
    """Replace ``key`` by a dense id in first-appearance order.

    First appearance = the smallest ``order`` of the key's rows.  The key
    dimension is ranked with range-partitioned positions (no single-task
    window) and joined back (J4); AQE broadcasts it when it is small and
    splits a skewed key when it is not.
    """
    ids = dense_rank_of(df, [key], order, out, base)
    return df.join(ids, key).drop(key) if key != out else df.join(ids, key)


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row (broadcast of a single row)."""
    return df.withColumn("_tw_one", F.lit(1)) \
             .join(F.broadcast(one_row.withColumn("_tw_one", F.lit(1))), "_tw_one") \
             .drop("_tw_one")


def row_index(df: DataFrame, order: Sequence[Column | str], out: str = "index") -> DataFrame:
    """0-based global row index in ``order``."""
    return with_position(df, order, out)


def offset_ids(dfs: Sequence[DataFrame], col: str = CONV, mode: str = "safe") -> list[DataFrame]:
    """Shift ids of each table so stacked tables do not collide.

    ``mode='safe'``: table i starts at (max id of the shifted table i-1) + 1.
    ``mode='reference'``: adds the previous shifted maximum (id 0 of one table
    then lands on the last id of the one before).
    """
    if mode not in ("safe", "reference"):
        raise ValueError("mode must be 'safe' or 'reference'")
    step = 1 if mode == "safe" else 0
    # one-row table of per-table maxima, then running offsets (size = number of tables)
    maxes = None
    for i, d in enumerate(dfs[:-1] or dfs):  # nothing comes after the last
        m = d.agg(F.max(col).cast("long").alias(f"_m{i}"))
        maxes = m if maxes is None else attach_scalar(maxes, m)
    offs = [F.lit(0).cast("long")]
    for i in range(1, len(dfs)):
        offs.append(offs[-1] + F.col(f"_m{i - 1}") + F.lit(step))
    off_row = maxes.select(*[o.alias(f"_o{i}") for i, o in enumerate(offs)])
    out = []
    for i, d in enumerate(dfs):
        if i == 0:
            out.append(d)
            continue
        o = off_row.select(F.col(f"_o{i}").alias("_tw_off"))
        out.append(attach_scalar(d, o).withColumn(col, (F.col(col) + F.col("_tw_off")).cast("long"))
                   .drop("_tw_off"))
    return out
