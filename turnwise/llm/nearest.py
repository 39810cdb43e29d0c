"""Operator 3: approximate nearest neighbours by adaptive dimension scan.

Largest inner products are smallest distances once every vector gets one more component that
brings all to the same norm.  The vectors are then turned by a random rotation, so that any
first ``d`` of ``D`` components are a fair sample of a distance, and dealt to the lists of their
nearest centroids.  A query scans its nearest lists block of columns by block of columns.
After each block a hypothesis test drops candidates whose partial distance, scaled to all
columns, is significantly above the query's ``k``-th best so far.  What survives is scored
exactly, in double precision, on the original vectors.

Jobs: (1) centroids on a bounded sample (``SAMPLE`` vectors by hash) on the driver; (2) every
vector goes to its list; (3) queries scan their first lists, which gives each its bound; (4) they
scan the others with that bound.  A list is cut into chunks of ``CHUNK`` candidates and its
queries into chunks of ``QUERIES``, each pair of chunks one task-sized cell, so a vector that a
third of the table shares is spread.  Each cell returns at most ``k`` rows per query.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; a query never finds its own id; rows that share an id are
candidates each, and one query (their least vector); if there are fewer than
``k`` candidates all are returned; equal scores go by smaller id; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SAMPLE = 16_384
CHUNK, QUERIES = 4096, 1024
BLOCK = 16        # columns a test
STRICT = 2.1      # how significant a dropped candidate's distance is
PROBED = 0.75     # share of the lists that a query scans
OUT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v, dim`` of the vectors that may take part."""
    v = F.col(vec_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~odd & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def as_matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        near = nearest_lists(x, c, 1)[:, 0]
        size = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    return c


def nearest_lists(x: np.ndarray, c: np.ndarray, m: int) -> np.ndarray:
    d = (c * c).sum(1) - 2 * x @ c.T
    return np.argsort(d, axis=1, kind="stable")[:, :m] if m > 1 else d.argmin(1)[:, None]


class Space:
    """The rotation, the common norm and the centroids; shared with all tasks."""

    def __init__(self, sample: np.ndarray, norm2: float, n: int, seed: int = 5):
        d = sample.shape[1]
        self.norm2 = norm2
        self.turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(d + 1, d + 1)))[0]
        lists = int(np.clip(round(n ** 0.5 / 2), 1, 1024))
        self.centroids = kmeans(self.place(sample), min(lists, len(sample)))

    def place(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Rotated vectors; queries keep a zero as their last component."""
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0))
        return np.hstack([x, rest[:, None]]) @ self.turn


def scan(space: Space, ids, x: np.ndarray, query_ids, q: np.ndarray, bound: np.ndarray, k: int) -> list[tuple]:
    """The ``k`` best of ``x`` for every query, given that worse than ``bound`` is of no use."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    px, pq = space.place(x), space.place(q, query=True)
    dims = px.shape[1]
    q2 = (q * q).sum(1)
    found = []
    first = min(BLOCK, dims)
    head = (px[:, :first] ** 2).sum(1) + (pq[:, :first] ** 2).sum(1)[:, None] - 2 * pq[:, :first] @ px[:, :first].T
    for i in range(len(q)):
        best_score, best = np.zeros(0), np.zeros(0, np.int64)
        limit = q2[i] + space.norm2 - 2 * bound[i]  # as a squared distance
        for a in range(0, len(x), 1024):  # the bound tightens from part to part
            at = np.arange(a, min(a + 1024, len(x)))
            part, seen = head[i, at], first
            while True:
                keep = (part * (dims / seen) <= limit * (1 + STRICT / seen ** 0.5) ** 2) if seen < dims else (part <= limit + 1e-9)
                at, part = at[keep], part[keep]
                if seen >= dims or not len(at):
                    break
                z = min(seen + BLOCK, dims)
                part = part + ((px[at, seen:z] - pq[i, seen:z]) ** 2).sum(1)
                seen = z
            at = at[ids[at] != query_ids[i]]
            if len(at):
                best = np.r_[best, at]
                best_score = np.r_[best_score, (x[at] * q[i]).sum(1)]  # rows alike score alike
                top = np.lexsort((ids[best], -best_score))[:k]
                best, best_score = best[top], best_score[top]
                if len(best) == k:
                    limit = min(limit, q2[i] + space.norm2 - 2 * best_score[-1])
        found += [(int(query_ids[i]), int(ids[j]), float(s)) for j, s in zip(best, best_score)]
    return found


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row where ``is_query``
    (a condition on ``vec_id``), among all rows but its own."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    dims = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2"))
    common = dims.orderBy(F.desc("n"), "dim").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    rows = rows.where(F.col("dim") == common["dim"]).drop("dim")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE, max(256, (1 << 24) // common["dim"]))).toPandas()
    space = spark.sparkContext.broadcast(Space(as_matrix(sample["v"]), common["norm2"] * (1 + 1e-9), common["n"]))
    del sample

    def to_list(batches):
        for df in batches:
            df["list"] = nearest_lists(space.value.place(as_matrix(df["v"])), space.value.centroids, 1)[:, 0] if len(df) else 0
            yield df[["vec_id", "v", "list"]]

    listed = stored(rows.mapInPandas(to_list, "vec_id long, v array<double>, list int"), "listed")
    sizes = {r["list"]: r["n"] for r in listed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row per list
    count = np.array([sizes.get(i, 0) for i in range(len(space.value.centroids))])
    chunks = -(-count // CHUNK)
    probed = max(8, int(np.ceil(PROBED * len(count))))

    def probes(batches):
        for df in batches:
            if not len(df):
                continue
            out = []
            for near, i, v in zip(nearest_lists(space.value.place(as_matrix(df["v"]), query=True), space.value.centroids, len(count)), df["vec_id"], df["v"]):
                near = near[count[near] > 0]
                have = np.cumsum(count[near])
                home = int(np.searchsorted(have, k + 1)) + 1  # enough lists for k others
                out += [(i, v, int(c), j < home) for j, c in enumerate(near[:max(home, probed)])]
            yield pd.DataFrame(out, columns=["query_id", "q", "list", "home"])

    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))  # an id is one query
    asked = stored(queries.mapInPandas(probes, "query_id long, q array<double>, list int, home boolean"), "probes")

    def cells(queries: DataFrame, name: str) -> DataFrame:
        asked_of = {r["list"]: r["n"] for r in queries.groupBy("list").agg(F.count("*").alias("n")).collect()}
        plan = [(int(c), int(chunks[c]), -(-n // QUERIES)) for c, n in asked_of.items()]
        plan = F.broadcast(spark.createDataFrame(plan, "list int, nc long, nq long"))  # a row per list
        left = listed.join(plan, "list").select(
            "list", F.pmod(F.xxhash64("vec_id"), "nc").alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("b"), "vec_id", "v")
        right = queries.join(plan, "list").select(
            "list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nc") - 1)).alias("c"), F.pmod(F.xxhash64("query_id"), "nq").alias("b"), "query_id", "q", "bound")

        def run(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            found = scan(space.value, x["vec_id"].to_numpy(), as_matrix(x["v"]), q["query_id"].to_numpy(), as_matrix(q["q"]), q["bound"].to_numpy(float), k) if len(x) and len(q) else []
            return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

        key = ["list", "c", "b"]
        return stored(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, OUT), name)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    none = F.lit(float("-inf"))
    near = cells(asked.where("home").withColumn("bound", none), "home")
    bound = near.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query_id", F.col("score").alias("bound"))
    far = asked.where("NOT home").join(bound, "query_id", "left").withColumn("bound", F.coalesce("bound", none))
    both = near.union(cells(far, "far"))
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
