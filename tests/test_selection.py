"""Selection by refined histograms (G3, exact G4) against sorting."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from turnwise.operators import augment


def h(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("n", [0, 1, 7, 60, 10_000])
def test_sample_per_class(spark, n):
    rnd = random.Random(1)
    rows = [(k, rnd.choice(["a"] * 9 + ["b", None])) for k in range(500)]
    got = augment.sample_per_class(spark.createDataFrame(rows, "k long, label string"), "label", n, ["k"], seed=3).collect()
    classes = defaultdict(list)
    for k, c in rows:
        classes[c].append((h(3, k), k))
    assert sorted((str(r["label"]), r["k"]) for r in got) == sorted((str(c), k) for c, v in classes.items() for _, k in sorted(v)[:n])


@pytest.mark.parametrize("frac", [0.0, 0.2, 0.5, 1.0])
def test_split_rows(spark, frac):
    rows = [(k,) for k in range(333)]
    got = augment.split_rows(spark.createDataFrame(rows, "k long"), frac, ["k"], seed=9).collect()
    train = {k for _, k in sorted((h(9, k), k) for k, in rows)[:int(frac * len(rows))]}
    assert {r["k"] for r in got if r["split"] == "train"} == train and len(got) == len(rows)


@pytest.mark.parametrize("want", [1, 4, 5, 50, 99])
def test_equal_hashes_are_ranked_by_key(spark, want):
    """Few hashes, so that the last row lies among many with its hash."""
    df = spark.range(100).withColumnRenamed("id", "k")
    got = augment.first_by_hash(df, [], (F.col("k") % 3) * (1 << 20), ["k"], F.lit(want), "first").collect()
    order = sorted(range(100), key=lambda k: (k % 3, k))
    assert {r["k"] for r in got if r["first"]} == set(order[:want]) and len(got) == 100


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a")] * 50 + [(2, "a")], "k long, label string")
    assert augment.sample_per_class(df, "label", 20, ["k"]).count() == 20
    assert augment.split_rows(df, 0.5, ["k"]).where("split = 'train'").count() == 25
    assert augment.sample_per_class(df.limit(0), "label", 5, ["k"]).count() == 0
    assert augment.split_rows(df.limit(0), 0.5, ["k"]).count() == 0


def test_no_sort_of_the_rows(spark):
    df = spark.range(1000).withColumnRenamed("id", "k").withColumn("label", F.col("k") % 2)
    for d in (augment.sample_per_class(df, "label", 10, ["k"]), augment.split_rows(df, 0.3, ["k"])):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "hashpartitioning" not in plan, plan
