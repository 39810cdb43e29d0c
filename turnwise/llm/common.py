"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def stored(df: DataFrame, name: str = "llm") -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read the copy."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    copy = df.sparkSession.read.schema(df.schema).parquet(path)
    copy.stored_at = path
    return copy


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH")]))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of the value written as text, modulo ``divisor`` (null: as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` also folds other alphabets)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)) \
            .otherwise(F.translate(c, upper, upper.lower()))


def crc_ids(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF


def slices(texts: Iterable[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs holding about ``chars`` characters each (one text at least)."""
    start = size = end = 0
    for end, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield start, end
            start, size = end, 0
        size += len(t)
    if size or end >= start:
        yield start, end + 1


# Integer arrays travel as zstd frames of their byte planes: small values and sorted
# runs (kept as differences) then cost a byte or two each instead of eight.

def pack(a: np.ndarray, delta: bool = False) -> bytes:
    a = np.ascontiguousarray(a, dtype=np.uint64)
    if delta and len(a):
        a = np.diff(a, prepend=np.uint64(0))
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    planes = a.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width, delta]) + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(b: bytes) -> np.ndarray:
    width, delta = b[0], b[1]
    raw = np.frombuffer(zstandard.decompress(bytes(b[2:])), np.uint8).reshape(width, -1)
    a = np.zeros((raw.shape[1], 8), np.uint8)
    a[:, :width] = raw.T
    a = a.view(np.uint64).reshape(-1)
    return np.cumsum(a, dtype=np.uint64) if delta else a


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table: one row ``(node, root)`` per node that has an edge.

    Each round hooks every node to its smallest neighbour (a partial aggregate), shortens the
    resulting paths by pointer jumping, relabels the edges with the roots and drops those inside
    one component; the rest is the next, much smaller, graph.  Every step reads written tables
    only, so a hub that holds a third of the edges is an ordinary skewed join side for AQE to
    split, and lost executors re-read files.  Nodes are compared by a hash, so chains of
    neighbouring numbers shrink by a constant factor per round like any other graph.

    The root is some node of the component, not necessarily the smallest.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = stored(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    roots = None
    while not e.isEmpty():
        hook = e.groupBy("u").agg(F.min(order("v")).alias("m"))
        hook = hook.select("u", F.when(F.col("m") < order("u"), F.col("m.n")).otherwise(F.col("u")).alias("p"))
        hook = stored(hook, "hook")
        while True:
            up = hook.select(F.col("u").alias("p"), F.col("p").alias("q"))
            jumped = stored(hook.join(up, "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "hook")
            hook = jumped.select("u", "p")
            if jumped.where("moved").isEmpty():
                break
        step = hook.select(F.col("u").alias("root"), "p")
        if roots is None:
            roots = hook.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            roots = stored(roots.join(step, "root", "left")
                           .select("node", F.coalesce("p", "root").alias("root")), "roots")
        e = e.join(hook, "u").select(F.col("p").alias("u"), "v")
        e = e.join(hook.withColumnRenamed("u", "v").withColumnRenamed("p", "w"), "v").select("u", F.col("w").alias("v"))
        e = stored(e.where("u <> v").distinct(), "edges")
    if roots is None:
        return edges.select(F.col(a).alias("node"), F.col(a).alias("root")).limit(0)
    return roots

