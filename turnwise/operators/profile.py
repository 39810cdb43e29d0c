"""Aggregations and profiling.

Every aggregate is a hash aggregation with a map-side partial step, so a hot
key is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ids import attach_scalar

CONV, SEG = "conversation_id", "sub_conversation_id"


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A1: rows per value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def n_unique(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """A2: distinct values per column, exact (``approx=True``: HyperLogLog++)."""
    f = F.approx_count_distinct if approx else F.countDistinct
    return df.agg(*[f(c).alias(f"n_unique_{c}") for c in cols])


def segment_histogram(df: DataFrame, conv: str = CONV, seg: str = SEG) -> DataFrame:
    """A3: highest segment id per conversation, then how many conversations have it."""
    m = df.groupBy(conv).agg(F.max(seg).alias("max_segment"))
    return m.groupBy("max_segment").agg(F.count(F.lit(1)).alias("n_conversations"))


def turn_histogram(df: DataFrame, conv: str = CONV) -> DataFrame:
    """A4: turns per conversation, then how many conversations have that many."""
    m = df.groupBy(conv).agg(F.count(F.lit(1)).alias("n_turns"))
    return m.groupBy("n_turns").agg(F.count(F.lit(1)).alias("n_conversations"))


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """A5: equal-width histogram with ``bins`` bins; the last bin is closed.

    Bin assignment follows numpy's: index ``floor((x - lo) * bins / (hi - lo))``,
    then corrected against the actual edges ``lo + i * step`` (last edge ``hi``),
    so a value on an edge lands where numpy puts it.  Returns every bin
    ``(bin, lo, hi, count)``, empty ones with 0.  When all values are equal the
    range is widened by 0.5 on each side.
    """
    x = F.col(col).cast("double")
    mm = df.agg(F.min(x).alias("_mn"), F.max(x).alias("_mx"))
    mm = mm.select(F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
                   F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(bins)

    def edge(i):
        return F.when(i >= bins, F.col("_hi")).otherwise(i.cast("double") * step + F.col("_lo"))

    i0 = F.floor((x - F.col("_lo")) * (F.lit(float(bins)) / (F.col("_hi") - F.col("_lo")))).cast("long")
    i1 = F.when(i0 >= bins, F.lit(bins - 1)).otherwise(i0)
    i2 = F.when(x < edge(i1), i1 - 1).otherwise(i1)
    i3 = F.when((x >= edge(i2 + 1)) & (i2 != bins - 1), i2 + 1).otherwise(i2)
    counted = attach_scalar(df.select(col).filter(F.col(col).isNotNull()), mm) \
        .groupBy(i3.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    allbins = attach_scalar(spark.range(bins).withColumnRenamed("id", "bin"), mm)
    allbins = allbins.select("bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"))
    return allbins.join(counted, "bin", "left").select(
        "bin", "lo", "hi", F.coalesce(F.col("count"), F.lit(0)).alias("count"))


def class_balance(df: DataFrame, label: str = "topic_shift") -> DataFrame:
    """Rows, positive rows and positive share."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.sum(F.col(label).cast("long")).alias("positives"),
                  F.avg(F.col(label).cast("double")).alias("positive_share"))


def filter_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row count before and after a filter."""
    b = before.agg(F.count(F.lit(1)).alias("rows")).withColumn("stage", F.lit("before"))
    a = after.agg(F.count(F.lit(1)).alias("rows")).withColumn("stage", F.lit("after"))
    return b.unionByName(a)


def profile(df: DataFrame) -> DataFrame:
    """Per column its type and non-null count (one pass, then unpivot)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    ids = [f"c{i}" for i in range(len(df.columns))]
    long = counts.unpivot([], ids, "col_key", "non_null")
    meta = df.sparkSession.createDataFrame(
        [(f"c{i}", i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "col_key string, ordinal int, column_name string, dtype string")
    return long.join(F.broadcast(meta), "col_key").drop("col_key")


def corpus_summary(df: DataFrame, source: str = "source", conv: str = CONV,
                   shift: str = "topic_shift") -> DataFrame:
    """Rows and average shifts per conversation, by source."""
    per = df.groupBy(source, conv).agg(F.count(F.lit(1)).alias("_n"),
                                       F.sum(F.col(shift).cast("long")).alias("_s"))
    return per.groupBy(source).agg(F.sum("_n").alias("rows"),
                                   F.count(F.lit(1)).alias("conversations"),
                                   F.avg(F.col("_s").cast("double")).alias("avg_shifts"))


def class_weights(df: DataFrame, label: str = "topic_shift") -> DataFrame:
    """A10: balanced weights ``n / (k * n_c)`` for each class present."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = c.agg(F.sum("n_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return attach_scalar(c, tot).select(
        label, "n_c", (F.col("_n") / (F.col("_k") * F.col("n_c"))).alias("weight"))


def max_of(df: DataFrame, col: str) -> DataFrame:
    """Column maximum."""
    return df.agg(F.max(col).alias(f"max_{col}"))
