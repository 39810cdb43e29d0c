"""Operator 5: SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint sets a bit if more than half of its shingles' hashes do.  Links are
pairs of fingerprints within ``radius`` bits.  Covering LSH finds all of them: bit ``i`` gets a
random vector ``m(i)`` of ``radius + 1`` bits, and for each of the ``2^(radius+1) - 1`` non-zero
vectors ``v`` the mask holds the bits with ``<m(i), v>`` odd.  Whatever ``radius`` bits differ,
some ``v`` is orthogonal to all their vectors, so that mask sees no difference: no link is missed.

Work is on distinct fingerprints.  A bucket (mask, masked value) over ``cell`` members is cut
into chunks and every pair of chunks is a cell of its own, so no task holds more than two chunks;
a cell compares its members in numpy and returns only a spanning set of the links it verified
(at most one row per member).  Connected components run on those.

Defined results: null and empty texts have fingerprint zero and link like any other; fewer words
than a shingle make one shingle of all words; null ids take part, but a component's id is the
smallest non-null one; repeated rows stay; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, stored

SEED = 42


def fingerprint(text: str | None, words: int) -> int:
    """Unsigned fingerprint of one whole text."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    n = max(1, len(w) - words + 1) if w else 0
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 50_000):  # bounded memory for very long texts
        z = min(n, a + 50_000)
        if len(w) < words:
            shingles = [b" ".join(w)]
        else:
            shingles = map(b" ".join, zip(*(w[a + i:z + i] for i in range(words))))
        digests = b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, the text's hash ``th`` and the signed 64-bit fingerprint ``fp``."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(fp)], ["id", "th", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return rows.mapInArrow(make, "id long, th long, fp long")


def covering_masks(radius: int, seed: int = 1) -> list[int]:
    """The masks as signed 64-bit integers; each bit's vector is drawn balanced over all vectors."""
    rng = np.random.default_rng(seed)
    k = 1 << (radius + 1)
    # Every vector as often as any other, in random places, so that the masks are of even size.
    vectors = rng.permutation(np.concatenate([rng.permutation(k) for _ in range(-(-64 // k))])[:64])
    masks = []
    for v in range(1, k):
        m = sum(1 << i for i in range(64) if bin(int(vectors[i]) & v).count("1") % 2)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def spanning_links(key: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the verified ones, for rows sorted by ``key`` (whole keys only).

    ``side`` is -1 where all members of a key compare, else rows compare with the other side.
    """
    n = len(fp)
    root = np.arange(n)
    runs = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    end = np.repeat(np.r_[runs[1:], n], np.diff(np.r_[runs, n]))  # end of each row's key
    live, shift = np.arange(n), 1
    pairs_a, pairs_b = [], []
    while True:
        live = live[live + shift < end[live]]
        if not len(live):
            break
        other = live + shift
        near = np.bitwise_count(fp[live] ^ fp[other]) <= radius
        near &= (side[live] < 0) | (side[live] != side[other])
        pairs_a.append(live[near])
        pairs_b.append(other[near])
        shift += 1
    if not pairs_a:
        return fp[:0], fp[:0]
    a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
    while True:  # smallest row number of each component
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    tied = np.flatnonzero(root != np.arange(n))
    return fp[tied], fp[root[tied]]


def near_links(fps: DataFrame, radius: int, cell: int = 2048) -> DataFrame:
    """Spanning links ``(a, b)`` among the distinct fingerprints ``fp``."""
    masks = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("v"))
                      for t, m in enumerate(covering_masks(radius))])
    rows = fps.select("fp", F.explode(masks).alias("m")).select("fp", "m.t", "m.v")
    sizes = rows.groupBy("t", "v").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(stored(sizes, "buckets"), ["t", "v"])
    # A bucket of c chunks has c(c+1)/2 cells; a member goes to the c cells of its chunk.
    rows = rows.withColumn("c", F.ceil(F.col("n") / cell).cast("int")) \
               .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")) \
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    rows = rows.select(F.xxhash64("t", "v", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"),
                       F.when(F.col("mine") == F.col("other"), -1).otherwise(F.col("mine")).alias("side"), "fp")
    rows = rows.repartition("key").sortWithinPartitions("key", "side")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(df):
            a, b = spanning_links(df["key"].to_numpy(), df["side"].to_numpy(), df["fp"].to_numpy().view(np.uint64), radius)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        rest = None
        for df in batches:
            df = df if rest is None else pd.concat([rest, df], ignore_index=True)
            if not len(df):
                continue
            done = int(np.searchsorted(df["key"].to_numpy(), df["key"].iloc[-1]))  # its last key may go on
            rest = df.iloc[done:]
            if done:
                yield out(df.iloc[:done])
        if rest is not None and len(rest):
            yield out(rest)

    return rows.mapInPandas(link, "a long, b long")


def grouped(docs: DataFrame, words: int, radius: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Written ``(id, th, fp)`` of every row, and ``(fp, root, component_id)`` of every fingerprint."""
    rows = stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    links = stored(near_links(fps.select("fp"), radius).distinct(), "links")
    roots = components(links)
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
               .withColumn("root", F.coalesce("root", "fp"))
    least = stored(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of_fp = stored(named.select("fp", "root").join(least, "root").select("fp", "root", "component_id"), "of-fp")
    discard(fps, links, least)
    return rows, of_fp


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``id, fingerprint (16 hex digits), component_id`` for every row of ``docs``."""
    rows, of_fp = grouped(docs, words, radius, id_col, text_col)
    return rows.join(of_fp, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int, radius: int) -> DataFrame:
    """One row of ``docs`` of each component: the first by ``doc_id`` (null last), the text's hash,
    and then by all columns."""
    rows, of_fp = grouped(docs, words, radius, "doc_id", "text")
    first = rows.join(of_fp, "fp").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "th")).alias("f"))
    first = stored(first.select(F.col("f.id").alias("_id"), F.col("f.th").alias("_th")), "first-of-each")
    def same(keys: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(keys["_id"]) & (F.xxhash64(docs["text"]) == keys["_th"])

    kept = docs.join(first, same(first), "left_semi")
    # Rows that share id and text; only theirs are gathered.
    again = kept.groupBy(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th")).agg(F.count("*").alias("_n"))
    again = stored(again.where("_n > 1").select("_id", "_th"), "repeated-rows")
    if again.isEmpty():
        return kept
    rest = kept.join(again, same(again), "left_semi").groupBy("doc_id", F.xxhash64("text").alias("_th"))
    rest = rest.agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return kept.join(again, same(again), "left_anti").union(rest)
