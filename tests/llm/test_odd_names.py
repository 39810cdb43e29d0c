"""Columns whose names the operators use inside, and repeated ids."""

from pyspark.sql import functions as F

from turnwise.llm import decontaminate, fuzzy_lines, language, nearest, simhash
from turnwise.llm.common import reachable

NAMES = ["_id", "_th", "_bad", "_n", "th", "id", "n_lines", "n_removed", "root", "fp", "removed", "_row", "keep", "p", "n_hit"]


def test_clashing_columns(spark, docs):
    reachable(spark)
    some = docs.limit(60)
    odd = some.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])
    item = spark.createDataFrame([(1, " ".join(some.first()["text"].split()[:14]))], "item_id long, text string")
    for apply in (lambda d: language.keep_known(d), lambda d: simhash.one_of_each(d, 3, 3), lambda d: decontaminate.remove(d, item),
                  lambda d: fuzzy_lines.dedup_lines(d)):
        plain, clash = apply(some), apply(odd)
        assert {tuple(r) for r in clash.select(*docs.columns).collect()} == {tuple(r) for r in plain.select(*docs.columns).collect()}
        kept = [n for n in NAMES if n in clash.columns and n not in ("n_lines", "n_removed")]
        assert len(kept) == len(NAMES) - 2
        assert all(r[n] == f"own {n}" for r in clash.select(*kept).collect() for n in kept)


def test_repeated_ids_are_one_query(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.9, 0.1]), (1, [1.0, 0.2]), (2, [0.0, 1.0]), (20, [0.5, 0.5])]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=3).collect()
    mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 0)
    assert mine == [(1, 1), (2, 20), (3, 2)]
    assert sorted(r["rank"] for r in got if r["query_id"] == 20) == [1, 2, 3]
