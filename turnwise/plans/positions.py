"""Global row positions without a single-partition window.

``row_number() OVER (ORDER BY ...)`` with no partition plans an
``Exchange SinglePartition``: one task sorts the whole table.  Instead the
table is range-partitioned on the order key and sorted inside each partition;
a row's position is its index inside the partition plus the number of rows in
all earlier partitions.  Only the per-partition counts (one row per shuffle
partition, a proven size bound) are aggregated and broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def with_position(df: DataFrame, order: Sequence[Column | str], out: str = "pos",
                  num_partitions: int | None = None, part_out: str | None = None) -> DataFrame:
    """Add ``out``: the 0-based position of each row in ``order`` (and ``part_out``: its range partition).

    ``order`` should be a total order (unique key); ties get an arbitrary but
    gap-free numbering.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    # Without an explicit count AQE sizes the range partitions from the data
    # (advisory partition size); the checkpoint below fixes whatever it chose.
    r = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    s = (r.sortWithinPartitions(*order)
         .withColumn("_tw_pid", F.spark_partition_id())
         .withColumn("_tw_idx", F.monotonically_increasing_id()
                     - F.shiftleft(F.col("_tw_pid").cast("long"), 33)))
    # Range bounds are sampled per exchange, so two evaluations of ``s`` could
    # split the data differently.  Materialise it once (reliable checkpoint in
    # the shared folder): counts and rows then come from the same partitions,
    # and a lost executor re-reads the checkpoint instead of re-sampling.
    s = cut_lineage(s)
    counts = s.groupBy("_tw_pid").agg(F.count(F.lit(1)).alias("_tw_n"))
    offsets = counts.select(
        "_tw_pid",
        F.coalesce(F.sum("_tw_n").over(Window.orderBy("_tw_pid")
                                       .rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_tw_off"))
    res = s.join(F.broadcast(offsets), "_tw_pid", "inner")
    res = res.withColumn(out, (F.col("_tw_off") + F.col("_tw_idx")).cast("long")).drop("_tw_idx", "_tw_off")
    return res.withColumnRenamed("_tw_pid", part_out) if part_out else res.drop("_tw_pid")


def dense_rank_of(df: DataFrame, key: Sequence[str], first: Sequence[Column | str],
                  out: str, base: int = 0) -> DataFrame:
    """Map each distinct ``key`` to a dense id in order of ``first`` (then key).

    Returns ``key + [out]`` with one row per key; the grouping is a partial
    (map-side combined) aggregation, so a hot key costs nothing extra.
    """
    first = [F.col(c) if isinstance(c, str) else c for c in first]
    k = df.groupBy(*key).agg(F.min(F.struct(*first)).alias("_tw_first"))
    order = [F.col("_tw_first")] + [F.col(c) for c in key]
    ranked = with_position(k, order, out)
    return ranked.select(*key, (F.col(out) + F.lit(base)).alias(out))


def with_group_rank(df: DataFrame, part: Sequence[str], order: Sequence[Column | str],
                    out: str, base: int = 0) -> DataFrame:
    """0-based (or ``base``-based) rank of each row inside its group by ``order``.

    Skew-safe replacement for ``row_number() OVER (PARTITION BY part ORDER BY
    order)`` when ``order`` is not an integral position: rows get a global
    position (range-partitioned, so a huge group is spread over many tasks),
    minus the first position of their group.  That one reaches the rows by
    (group, range partition), never by the group alone.
    """
    part = list(part)
    d = with_position(df, [F.col(c) for c in part] + list(order), "_tw_gpos", part_out="_tw_rp")
    here = d.groupBy(*part, "_tw_rp").agg(F.min("_tw_gpos").alias("_tw_g0"))
    first = here.select(*[F.col(c).alias(f"_tw_k{i}") for i, c in enumerate(part)], F.col("_tw_rp").alias("_tw_rq"),
                        F.min("_tw_g0").over(Window.partitionBy(*part)).alias("_tw_g0"))
    same = F.col("_tw_rp") == F.col("_tw_rq")
    for i, c in enumerate(part):
        same = same & F.col(c).eqNullSafe(F.col(f"_tw_k{i}"))
    d = d.join(first, same).withColumn(out, (F.col("_tw_gpos") - F.col("_tw_g0") + F.lit(base)).cast("long"))
    return d.drop("_tw_gpos", "_tw_g0", "_tw_rp", "_tw_rq", *[f"_tw_k{i}" for i in range(len(part))])
