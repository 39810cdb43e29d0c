"""Operator 11: ranked lexical search over posting lists in geometric blocks.

``vectors`` reads the texts once and keeps of each document its length and how often it holds the
terms that some query asks for.  ``build_index`` deals documents of like direction (signs of a
random projection) to shards of at most ``SHARD_DOCS``; in a shard every term's posting list is
clustered by the similarity of its documents, and each block stores the coordinatewise maximum of
their impacts.  ``search`` goes through a query's terms from the rarest to the commonest.  A
block's summary times the query, over this term and the later ones, bounds every document that
holds none of the earlier terms; the block is skipped only if that is below the 20th best score
known.  Documents of the other blocks are scored in full.  Bounds and scores are integers, so the
result is exact.

A first round searches every ``FIRST``-th shard; its thresholds go into the round over the others.
Queries are taken in batches of bounded vocabulary, each with an index of its own; a batch's terms
are the only thing that is broadcast.

Scale: postings never leave the task that holds their documents, so a term that every document
holds is split like the documents are.  What moves is a few bytes per document and asked term,
one row per shard, and at most ``k`` hits per shard and query.  Summaries hold the coordinates
that some query asks for together with the list's term.

Defined results: null text has no terms; an item without terms, or without a document that holds
one of them with a positive weight, has no rows; repeated items are ranked each by itself;
repeated documents are separate documents; null ids come last among equal scores; an empty table
gives no rows; columns of other names are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pack, stored, unpack

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}
SHARD_DOCS = 4096
BLOCK_DOCS = 64    # documents that a block is meant to hold
FIRST = 16         # every so many-th shard gives the first thresholds
BATCH_TERMS = 200_000
SIGNS = 16         # dimensions of the random projection
HITS = "query long, doc_id long, score long"


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(text.translate(UPPER)) if text else []


class Queries:
    """A batch of queries over its own vocabulary; terms are numbered from the rarest on once
    their document frequencies are known."""

    def __init__(self, items: list[tuple[int, Counter]]):
        self.items = items
        self.vocabulary = {t: k for k, t in enumerate(sorted({t for _, c in items for t in c}))}

    def weigh(self, df: np.ndarray, documents: int) -> None:
        """Weights of the terms and the order in which lists are read."""
        weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in df]
        self.order = np.lexsort((np.arange(len(df)), df)).astype(np.int64)   # place -> term
        self.place = np.argsort(self.order).astype(np.int64)                # term -> place
        self.weight = np.array([weight[t] for t in self.order], np.int64)
        self.terms, self.gain, together = {}, {}, {}
        for q, count in self.items:
            at = np.array(sorted(int(self.place[self.vocabulary[t]]) for t in count), np.int64)
            times = {int(self.place[self.vocabulary[t]]): n for t, n in count.items()}
            self.terms[q] = at
            self.gain[q] = self.weight[at] * np.array([times[int(p)] for p in at], np.int64)
            for j, p in enumerate(at.tolist()):
                together.setdefault(p, set()).update(at[j:].tolist())
        self.together = {p: np.array(sorted(c), np.int64) for p, c in together.items()}
        rng = np.random.default_rng(11)
        self.directions = rng.standard_normal((len(df), SIGNS)).astype(np.float32) * (self.weight[:, None] / 1000).astype(np.float32)


def batches_of(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Items numbered as ``query``, and the number of batches that keeps a batch's terms bounded."""
    from ..plans.positions import with_position
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("item_text"))
    rows = stored(with_position(rows, [F.col("item_id").asc_nulls_first(), F.col("item_text").asc_nulls_first()], "query"), "items")
    size = rows.agg(F.sum(F.length("item_text"))).first()[0] or 0
    return rows, size // (8 * BATCH_TERMS) + 1


def vectors(docs: DataFrame, queries: Queries, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, terms, tf``: every document's number of terms and its asked terms (packed)."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(queries.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for b in batches:
            n, terms, tf = [], [], []
            for i in range(0, b.num_rows, 500):
                for text in b.column("text").slice(i, 500).to_pylist():
                    words = terms_of(text)
                    n.append(len(words))
                    count = Counter(map(number.get, words))
                    count.pop(None, None)
                    at = sorted(count)
                    terms.append(np.array(at, "<u4").tobytes())
                    tf.append(np.array([count[t] for t in at], "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tf, pa.binary())],
                                             ["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, n long, terms binary, tf binary"), "term-vectors")


def statistics(rows: DataFrame, vocabulary: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and the document frequency of every asked term."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(vocabulary, np.int64)
        for b in batches:
            ids = np.frombuffer(b"".join(b.column("terms").to_pylist()), "<u4")
            df += np.bincount(ids, minlength=vocabulary)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at])], ["term", "n"])

    total = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(vocabulary, np.int64)
    # At most one row per asked term.
    for r in rows.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]
    return total["docs"], total["terms"], df


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of several runs in one array."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Shard:
    """Documents of a shard: their coordinates (places and impacts), by row."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, place: np.ndarray, impact: np.ndarray):
        self.ids, self.first, self.place, self.impact = ids, first, place, impact
        self.size = np.diff(first)

    def score(self, rows: np.ndarray, terms: np.ndarray, gain: np.ndarray) -> np.ndarray:
        size = self.size[rows]
        at = ragged(self.first[rows], size)
        k = np.minimum(np.searchsorted(terms, self.place[at]), len(terms) - 1)
        part = np.where(terms[k] == self.place[at], gain[k], 0) * self.impact[at]
        ends = np.cumsum(size)
        run = np.concatenate([[0], np.cumsum(part)])
        return run[ends] - run[ends - size]

    def lists(self, queries: Queries) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each asked term that occurs: its place, documents in blocks, block sizes, summaries
        (one row per block, one column per coordinate asked together with the term)."""
        row = np.repeat(np.arange(len(self.ids)), self.size)
        sketch = np.zeros((len(self.ids), SIGNS), np.float32)
        full = np.flatnonzero(self.size)
        for i in range(0, len(full), 512):
            some = full[i:i + 512]
            at = ragged(self.first[some], self.size[some])
            parts = queries.directions[self.place[at]] * self.impact[at, None].astype(np.float32)
            sketch[some] = np.add.reduceat(parts, np.cumsum(self.size[some]) - self.size[some])
        sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        order = np.argsort(self.place, kind="stable")
        places, start = np.unique(self.place[order], return_index=True)
        for p, docs in zip(places.tolist(), np.split(row[order], start[1:])):
            asked = queries.together.get(p)
            if asked is None:
                continue
            k = -(-len(docs) // BLOCK_DOCS)
            block = np.zeros(len(docs), np.int64)
            if k > 1:
                middle = docs[np.arange(k) * len(docs) // k]
                block = (sketch[docs] @ sketch[middle].T).argmax(1)
                docs, block = docs[np.argsort(block, kind="stable")], np.sort(block)
                _, block = np.unique(block, return_inverse=True)
            size = self.size[docs]
            at = ragged(self.first[docs], size)
            col = np.minimum(np.searchsorted(asked, self.place[at]), len(asked) - 1)
            use = asked[col] == self.place[at]
            summary = np.zeros((int(block[-1]) + 1, len(asked)), np.int64)
            np.maximum.at(summary.reshape(-1), (np.repeat(block, size) * len(asked) + col)[use], self.impact[at][use])
            yield p, docs, np.bincount(block), summary


def build_index(rows: DataFrame, queries: Queries, documents: int, terms: int) -> DataFrame:
    """The written index: ``shard`` and its documents, lists, blocks and summaries, packed."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(queries)

    def direction(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        for df in batches:
            signs = []
            for t, n in zip(df["terms"], df["tf"]):
                v = np.log1p(np.frombuffer(n, "<u4")).astype(np.float32) @ q.directions[q.place[np.frombuffer(t, "<u4")]]
                signs.append(int("".join("1" if x > 0 else "0" for x in v), 2))
            yield df.assign(direction=np.array(signs, np.int32))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, held, number = shared.value, [], 0
        for df in batches:
            held.append(df)
            while sum(map(len, held)) >= SHARD_DOCS:
                every = pd.concat(held)
                yield one(q, every.iloc[:SHARD_DOCS], number)
                held, number = [every.iloc[SHARD_DOCS:]], number + 1
        every = pd.concat(held) if held else None
        if every is not None and len(every):
            yield one(q, every, number)

    def one(q: Queries, df: pd.DataFrame, number: int) -> pd.DataFrame:
        size = np.array([len(t) // 4 for t in df["terms"]], np.int64)
        place = q.place[np.frombuffer(b"".join(df["terms"]), "<u4")]
        tf = np.frombuffer(b"".join(df["tf"]), "<u4").astype(np.int64)
        # 100 - 25 + (25 n N) div L, in whole numbers of any size
        m = np.array([75 + 25 * n * documents // terms for n in df["n"].tolist()], np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, size))
        s = Shard(df["doc_id"].to_numpy(np.int64), np.concatenate([[0], np.cumsum(size)]), place, impact)
        lists = list(s.lists(q))
        cat = lambda k: np.concatenate([x[k].reshape(-1) for x in lists]) if lists else np.zeros(0, np.int64)
        return pd.DataFrame({"part": [int(df["part"].iloc[0])], "number": [number],
                             "ids": [df["doc_id"].to_numpy(np.int64).tobytes() + df["no_id"].to_numpy(bool).tobytes()],  # null ids carry a mark
                             "sizes": [pack(size)], "places": [pack(place)], "impacts": [pack(impact)],
                             "lists": [pack(np.array([[p, len(d), len(b)] for p, d, b, _ in lists], np.int64).reshape(-1))],
                             "docs": [pack(cat(1))], "blocks": [pack(cat(2))], "summaries": [pack(cat(3))]})

    asked = rows.where(F.length("terms") > 0).select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "n", "terms", "tf")
    asked = asked.mapInPandas(direction, "doc_id long, no_id boolean, n long, terms binary, tf binary, direction int")
    # A task makes one shard after another if there are more shards than shuffle partitions.
    tasks = min(documents // SHARD_DOCS + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = asked.repartitionByRange(tasks, "direction", F.xxhash64("doc_id", "n", "terms", "tf")) \
                 .sortWithinPartitions("direction").withColumn("part", F.spark_partition_id())
    index = dealt.mapInPandas(build, "part int, number int, ids binary, sizes binary, places binary, impacts binary, lists binary, docs binary, blocks binary, summaries binary")
    return stored(index.withColumn("shard", F.concat_ws("-", "part", "number")), "blocked-index")


def best(scores: np.ndarray, ids: np.ndarray, none: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best scores, of equal ones the smallest ids, null last."""
    return np.lexsort((ids, none, -scores))[:k]


def search_shard(row: dict, queries: Queries, floor: dict[int, int], k: int) -> tuple[list[tuple], dict]:
    """Each query's best documents of a shard and counts of what was read and skipped."""
    sizes = unpack(row["sizes"]).astype(np.int64)
    n = len(sizes)
    ids, none = np.frombuffer(row["ids"][:8 * n], np.int64), np.frombuffer(row["ids"][8 * n:], np.uint8)
    shard = Shard(ids, np.concatenate([[0], np.cumsum(sizes)]), unpack(row["places"]).astype(np.int64), unpack(row["impacts"]).astype(np.int64))
    docs, blocks, flat = (unpack(row[c]).astype(np.int64) for c in ("docs", "blocks", "summaries"))
    lists, d, b, s = {}, 0, 0, 0
    for p, n_docs, n_blocks in unpack(row["lists"]).astype(np.int64).reshape(-1, 3).tolist():
        width = len(queries.together[p])
        lists[p] = (docs[d:d + n_docs], blocks[b:b + n_blocks], flat[s:s + n_blocks * width].reshape(n_blocks, width))
        d, b, s = d + n_docs, b + n_blocks, s + n_blocks * width
    hits, seen_blocks, skipped = [], 0, 0
    for q, terms in queries.terms.items():
        gain, least = queries.gain[q], max(floor.get(q, 0), 1)
        seen = np.zeros(n, bool)
        top, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for j, p in enumerate(terms.tolist()):
            if p not in lists:
                continue
            members, size, summary = lists[p]
            bound = summary[:, np.searchsorted(queries.together[p], terms[j:])] @ gain[j:]
            order = np.argsort(-bound, kind="stable")
            first = np.cumsum(size) - size
            at, some = 0, 1
            while at < len(order) and bound[order[at]] >= least:
                now = order[at:at + some]
                now = now[bound[now] >= least]
                rows = members[ragged(first[now], size[now])]
                rows = rows[~seen[rows]]
                got = shard.score(rows, terms, gain)
                rows, got = rows[got >= least], got[got >= least]
                top, score = np.concatenate([top, rows]), np.concatenate([score, got])
                if len(top) > k:
                    keep = best(score, ids[top], none[top], k)
                    top, score = top[keep], score[keep]
                if len(top) == k:
                    least = max(least, int(score.min()))
                at, some = at + len(now), some * 2
            seen_blocks, skipped = seen_blocks + len(order), skipped + len(order) - at
            seen[members] = True
        hits += [(q, None if none[t] else int(ids[t]), int(x)) for t, x in zip(top.tolist(), score.tolist())]
    return hits, {"blocks": seen_blocks, "skipped": skipped}


def search(index: DataFrame, queries: Queries, k: int = 20, floor: dict[int, int] | None = None) -> DataFrame:
    """``query, doc_id, score``: at most ``k`` hits per shard and query, the best ones among them."""
    shared = index.sparkSession.sparkContext.broadcast((queries, floor or {}))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        q, least = shared.value
        hits = [h for row in df.to_dict("records") for h in search_shard(row, q, least, k)[0]]
        return pd.DataFrame({"query": pd.Series([h[0] for h in hits], dtype="int64"), "doc_id": pd.Series([h[1] for h in hits], dtype="Int64"),
                             "score": pd.Series([h[2] for h in hits], dtype="int64")})

    return stored(index.groupBy("shard").applyInPandas(run, HITS), "hits")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
                   item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item."""
    spark = docs.sparkSession
    numbered, batches = batches_of(items, item_id, item_text)
    found = None
    for b in range(batches):
        some = numbered.where(F.col("query") % batches == b).select("query", "item_text").collect()  # bounded by the batch
        queries = Queries([(r["query"], Counter(terms_of(r["item_text"]))) for r in some if terms_of(r["item_text"])])
        if not queries.items:
            continue
        rows = vectors(docs, queries, id_col, text_col)
        documents, terms, df = statistics(rows, len(queries.vocabulary))
        queries.weigh(df, documents)
        index = build_index(rows, queries, documents, terms)
        early = F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0
        hits = search(index.where(early), queries, k)
        per_query = Window.partitionBy("query").orderBy(F.col("score").desc())
        known = hits.withColumn("r", F.row_number().over(per_query)).where(f"r = {k}").select("query", "score").collect()  # one row per query
        hits = hits.unionByName(search(index.where(~early), queries, k, {r["query"]: r["score"] for r in known}))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], HITS)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.join(numbered.select("query", "item_id"), "query").select(F.col("item_id").alias(item_id), "rank", F.col("doc_id").alias(id_col), "score")
