"""Relational joins and set operations on turn tables.

Join strategy is left to Spark: with AQE on, a side whose measured shuffle
output is under ``spark.sql.autoBroadcastJoinThreshold`` becomes a broadcast
at run time, and a skewed key of a sort-merge join is split
(``spark.sql.adaptive.skewJoin.enabled``).  Nothing here broadcasts a side
whose size grows with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scan import BLOCK, hand_back

CONV = "conversation_id"


def keep_steady(df: DataFrame, stats: DataFrame, max_ratio: float = 0.7,
                ratio: str = "single_turn_ratio", conv: str = CONV, turn: str = "turn_id") -> DataFrame:
    """Keep the turns of conversations whose single-turn ratio is <= ``max_ratio``.

    The verdict on a conversation reaches its turns block by block (``hand_back``).
    """
    keep = stats.filter(F.col(ratio) <= max_ratio).select(conv, F.lit(True).alias("_tw_keep"))
    return hand_back(df, [conv], turn, keep, ["_tw_keep"]).where("_tw_keep").drop("_tw_keep")


def stack(dfs: Sequence[DataFrame]) -> DataFrame:
    """Outer union by column name; a column missing from a table is null."""
    out = dfs[0].drop(BLOCK)  # blocks of one table are not those of the stack
    for d in dfs[1:]:
        out = out.unionByName(d.drop(BLOCK), allowMissingColumns=True)
    return out


def reconcile_turns(expected: DataFrame, parsed: DataFrame, conv: str = CONV,
                    expected_col: str = "total_turns", parsed_col: str = "n_parsed") -> DataFrame:
    """Expected against parsed turn counts per conversation.

    ``parsed`` is a turn table; its rows are counted per conversation.  A
    conversation missing on either side counts as different.
    """
    p = parsed.groupBy(conv).agg(F.count(F.lit(1)).alias(parsed_col))
    e = expected.select(conv, expected_col)
    j = e.join(p, conv, "full_outer")
    return j.withColumn("differs", (~F.col(expected_col).eqNullSafe(F.col(parsed_col))).cast("int"))

