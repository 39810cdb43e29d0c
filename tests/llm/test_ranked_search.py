"""Operator 11 against scores of every document."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from turnwise.llm import queries, ranked_search
from turnwise.llm.common import reachable

from .conftest import SF001


def brute(docs, items, k=20):
    """``{(item number, rank): (doc_id, score)}`` by the definition."""
    words = [(d, ranked_search.terms_of(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    counts = [Counter(w) for _, w in words]
    df = Counter(t for c in counts for t in c)
    out = set()
    for item, text in items:
        scored = []
        for (d, w), c in zip(words, counts):
            score = 0
            for t in ranked_search.terms_of(text):
                if c[t]:
                    m = 100 - 25 + 25 * len(w) * n_docs // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out |= {(item, r + 1, None if no else d, -s) for r, (s, no, d) in enumerate(sorted(scored)[:k])}
    return out


def run(docs, items, k=20):
    return {tuple(r) for r in ranked_search.rank_documents(docs, items, k).select("item_id", "rank", "doc_id", "score").collect()}


def test_query(spark, docs, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    got = queries.op11_ranked_search(spark, SF001)
    assert {tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()} == brute(texts, items)


def topics(n, seed):
    """Documents about a few subjects, so that blocks differ."""
    rng = random.Random(seed)
    common, own = [f"w{k}" for k in range(20)], [[f"s{s}x{k}" for k in range(30)] for s in range(8)]
    return [(k, " ".join(rng.choice(common if rng.random() < 0.4 else own[k % 8]) for _ in range(rng.randint(1, 60)))) for k in range(n)]


@pytest.fixture()
def small(monkeypatch):
    """Several shards, blocks and batches of little data."""
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 4)
    monkeypatch.setattr(ranked_search, "FIRST", 2)


def test_blocks_are_skipped_and_nothing_is_lost(spark, small):
    docs, items = topics(600, 1), [(k, t) for k, t in topics(30, 2)]
    reachable(spark)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert run(d, i, 5) == brute(docs, items, 5)
    q = ranked_search.Queries([(k, Counter(ranked_search.terms_of(t))) for k, t in items])
    rows = ranked_search.vectors(d, q)
    n_docs, n_terms, df = ranked_search.statistics(rows, len(q.vocabulary))
    q.weigh(df, n_docs)
    index = [r.asDict() for r in ranked_search.build_index(rows, q, n_docs, n_terms).collect()]
    read = [ranked_search.search_shard(r, q, {}, 5)[1] for r in index]
    blocks, skipped = sum(r["blocks"] for r in read), sum(r["skipped"] for r in read)
    assert skipped > 0.2 * blocks, (skipped, blocks)


def test_summaries_are_the_largest_impacts(spark, small):
    rng = np.random.default_rng(1)
    size = rng.integers(1, 9, 50)
    place = np.concatenate([np.sort(rng.choice(20, n, replace=False)) for n in size])
    shard = ranked_search.Shard(np.arange(50), np.concatenate([[0], np.cumsum(size)]), place, rng.integers(1, 1000, len(place)))
    dense = np.zeros((50, 20), np.int64)
    dense[np.repeat(np.arange(50), size), place] = shard.impact
    q = ranked_search.Queries([(0, Counter([f"{k:02d}" for k in range(20)]))])
    q.weigh(np.arange(1, 21), 50)
    for p, docs, blocks, summary in shard.lists(q):
        assert sorted(docs) == np.flatnonzero(dense[:, p]).tolist()
        for k, rows in enumerate(np.split(docs, np.cumsum(blocks)[:-1])):
            assert (summary[k] == dense[rows][:, q.together[p]].max(0)).all()


def test_odd_rows(spark, odd, none, small):
    reachable(spark)
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    items = [(1, "one line"), (1, "one line"), (2, None), (None, "École own own own OWN"), (3, ""), (4, "!!"), (5, "neverseen"), (6, "rivers " * 3000)]
    table = spark.createDataFrame([(*r, 3, 4, "x") for r in items], "item_id long, text string, doc_id long, rank long, score string")
    got = ranked_search.rank_documents(odd, table).select("item_id", "rank", "doc_id", "score").collect()
    assert {tuple(r) for r in got} == brute(docs, items)
    assert sum(r["item_id"] == 1 for r in got) == 2 * sum(x[0] == 1 for x in brute(docs, items))
    assert run(none, table) == set() and run(odd, table.limit(0)) == set()


def test_batches_of_queries(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BATCH_TERMS", 20)
    docs, items = topics(80, 4), topics(12, 5)
    assert run(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")) == brute(docs, items)
