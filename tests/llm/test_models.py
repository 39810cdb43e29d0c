"""Operators 2, 3, 4 and 10, and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from turnwise.llm import katz, language, nearest, quality
from turnwise.llm.common import crc_mod


def katz_model(rows):
    """Dictionaries: probability of a word after a context, by the formulas."""
    one, two = Counter(), Counter()
    for d, words in rows:
        if zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2:
            one.update(words)
            two.update(zip([None] + words, words))
    n = sum(one.values())
    of = lambda c: [sum(1 for x in c.values() if x == r) for r in range(1, katz.K + 2)]
    d1, d2 = katz.discounted(of(one)), katz.discounted(of(two))
    left = lambda r, d: d[r] if r <= katz.K else r - katz.KEPT
    p1 = {w: left(r, d1) / n for w, r in one.items()}
    unknown = 1 - sum(p1.values())
    total = Counter(h for h, _ in two.elements())
    after = defaultdict(dict)
    for (h, w), r in two.items():
        after[h][w] = left(r, d2) / total[h]
    alpha = {h: (1 - sum(s.values())) / (1 - sum(p1[w] for w in s)) for h, s in after.items()}

    def p(h, w):
        return after[h][w] if w in after.get(h, ()) else alpha.get(h, 1.0) * p1.get(w, unknown)

    return one, n, p, after, p1, unknown


def test_katz_backoff(docs, none):
    rows = [(r["doc_id"], r["text"].encode().lower().split() + [b"\n"]) for r in docs.collect()]
    one, n, p, after, p1, unknown = katz_model(rows)
    for h in [None, *list(after)[:20]]:  # every context sums to one
        assert sum(p(h, w) for w in p1) + p(h, "unseen anywhere") == pytest.approx(1, abs=1e-9)
    got = {r["doc_id"]: r for r in katz.score(docs).collect()}
    for d, words in rows:
        r = got[d]
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in one for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((one[w] + 1) / (n + len(one) + 1)) for w in words), rel=1e-9)
        assert r["score"] == pytest.approx(sum(math.log10(p(h, w)) for h, w in zip([None] + words, words)), rel=1e-7)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert katz.score(none).count() == 0


def test_katz_on_odd_rows(odd):
    got = katz.score(odd, n_buckets=3).collect()
    assert len(got) == odd.count() and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1}


def test_language_of_documents(spark, docs, odd, none):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    for p in (None, pages):
        got = language.identify(docs, p).collect()
        assert len(got) == docs.count()
        assert np.mean([r["lang_id"] == r["declared"] for r in got]) > 0.98 and not any(r["rejected"] for r in got)
    by = {r["doc_id"]: r for r in language.identify(odd).collect()}
    assert by[3]["rejected"] and by[4]["rejected"] and not by[1]["rejected"]
    assert language.identify(none).count() == 0 and language.keep_known(odd).columns == odd.columns


def test_other_scripts_are_rejected_and_wrong_declarations_corrected(spark, docs):
    french = docs.where("lang = 'fr' AND n_chars > 400").limit(1).first()["text"]
    more = spark.createDataFrame([(-1, "Привет мир и добрый день всем людям на земле " * 3, "en", "src1", 1), (-2, french, "en", "src1", 1)], docs.schema)
    by = {r["doc_id"]: r for r in language.identify(docs.union(more)).collect()}
    assert by[-1]["rejected"] and by[-2]["lang_id"] == "fr"


def brute_nearest(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(1)
        others = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in others[:k]]
    return out


def test_nearest_neighbours(spark, docs):
    vectors = spark.read.parquet(f"{SF001}/embeddings.parquet")
    pdf = vectors.toPandas()
    want = brute_nearest(pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"]).astype(float), 20)
    got = defaultdict(list)
    for r in nearest.search(vectors, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    exact = {q: dict(brute_nearest(pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"]).astype(float), 10 ** 6)[q]) for q in list(want)[:3]}
    for q in exact:
        assert all(s == pytest.approx(exact[q][v], abs=1e-12) for v, s in got[q])
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))


def test_nearest_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]),
            (6, [1.0, None]), (7, [1.0, 2.0, 3.0]), (8, [float("inf"), 1.0]), (40, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in nearest.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert nearest.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_quality_on_held_out_labels(spark, odd, none):
    from turnwise.llm.common import documents
    sf = SF001.replace("0.001", "0.01")
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    held = crc_mod("doc_id", 4) == 2
    got = quality.score(docs, labels, ~held, held).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.93
    good, bad = got["score"][got["quality"] == 1].to_numpy(), got["score"][got["quality"] == 0].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.95
    rows = quality.score(odd, labels, ~held, held).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.score(odd, labels.limit(0), ~held, held).collect()} == {0.5}
    assert quality.score(none, labels, ~held, held).count() == 0


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    p = {"E": rng.normal(size=(quality.FEATURES, quality.HIDDEN)) * 0.05, "e": rng.normal(size=quality.HIDDEN), "V": rng.normal(size=(quality.HIDDEN, quality.GATE)),
         "U": rng.normal(size=(quality.HIDDEN, quality.GATE)), "w": rng.normal(size=quality.GATE), "c": rng.normal(size=quality.HIDDEN), "b": np.array(0.1)}
    x, n, y = rng.normal(size=(7, quality.FEATURES)), np.array([3, 4]), np.array([1.0, 0.0])
    loss = lambda: -np.mean(y * np.log(quality.forward(p, x, n)[0]) + (1 - y) * np.log(1 - quality.forward(p, x, n)[0]))
    grad = quality.gradients(p, x, n, y, *quality.forward(p, x, n))
    for k in p:
        at = tuple(0 for _ in np.shape(p[k]))
        p[k][at] += 1e-5
        up = loss()
        p[k][at] -= 2e-5
        down = loss()
        p[k][at] += 1e-5
        assert np.asarray(grad[k])[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-8)


def test_pipeline(spark, docs):
    import corpus_pipeline as P
    kept = {}
    for name, stage in P.STAGES[:-1]:
        kept[name] = stage(spark, docs if not kept else list(kept.values())[-1], SF001).cache()
        assert kept[name].columns == docs.columns
    counts = [docs.count(), *(k.count() for k in kept.values())]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.7 * counts[0]
    out = P.run(spark, SF001).toPandas()
    last = list(kept.values())[-1]
    assert set(out["doc_id"]) == {r["doc_id"] for r in last.select("doc_id").collect()}
    assert out.groupby("sequence_id")["length"].sum().max() <= 1024
    from turnwise.llm import decontaminate
    assert decontaminate.find(last, spark.read.parquet(f"{SF001}/benchmark.parquet")).where("contaminated").count() == 0


def test_pipeline_language_stage_reads_pages(spark, docs, monkeypatch):
    import corpus_pipeline as P
    from turnwise.llm import language, queries
    seen, identify = [], language.identify
    monkeypatch.setattr(language, "identify", lambda d, pages=None: seen.append(pages) or identify(d, pages))
    kept = {r["doc_id"] for r in P.language_id(spark, docs, SF001).select("doc_id").collect()}
    assert seen[0] is not None and "html" in seen[0].columns
    assert kept == {r["doc_id"] for r in queries.op2_language_id(spark, SF001).where("NOT rejected").collect()}
