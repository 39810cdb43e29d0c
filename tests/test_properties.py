"""Properties from the survey's test plan, on the driver tables."""

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from turnwise.operators import augment, clean, metrics, pairs, quality, segment
from turnwise.sources import fixtures as fx


def test_coherence_pairs_cover_all_pairs(spark):
    for t in (fx.topic_turns(spark, SF01), fx.event_turns(spark, SF01)):
        spec = pairs.coherence_pairs(t).groupBy("conversation_id").agg(F.sum("n_pairs").alias("p"))
        n = t.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("L"))
        bad = spec.join(n, "conversation_id").filter(F.col("p") != F.col("L") * (F.col("L") - 1) / 2)
        assert bad.count() == 0


def test_repair_leaves_no_fault_one(spark):
    t = clean.reset_first_turn(fx.topic_turns(spark, SF01))
    for scope in ("conversation", "global"):
        before = quality.fault_counts(t, scope).collect()[0]
        after = quality.fault_counts(quality.repair_labels(t, scope), scope).collect()[0]
        assert before.fault_1 > 0 and after.fault_1 == 0 and after.fault_2 == before.fault_2


def test_segments_equal_non_first_shifts_plus_one(spark):
    t = fx.event_turns(spark, SF01)
    g = t.groupBy("conversation_id").agg(F.max("sub_conversation_id").alias("m"),
                                         F.sum("topic_shift").alias("s"))
    assert g.filter(F.col("m") + 1 != F.col("s")).count() == 0


def test_splits_are_disjoint_and_complete(spark):
    t = fx.topic_turns(spark, SF01).select("conversation_id", "turn_id")
    n = t.count()
    for d in (augment.split_rows(t, 0.8, ["conversation_id", "turn_id"]),
              augment.split_rows(t, 0.8, ["conversation_id", "turn_id"], exact=False),
              augment.split_conversations(t, 0.8)):
        c = {r.split: r["count"] for r in d.groupBy("split").count().collect()}
        assert sum(c.values()) == n and set(c) <= {"train", "test"}
    exact = augment.split_rows(t, 0.8, ["conversation_id", "turn_id"])
    assert exact.filter(F.col("split") == "train").count() == int(0.8 * n)
    conv = augment.split_conversations(t, 0.8).groupBy("conversation_id").agg(
        F.countDistinct("split").alias("k"))
    assert conv.filter(F.col("k") > 1).count() == 0


def test_pk_not_above_window_diff(spark):
    seq = metrics.sequence_boundaries(fx.preds(spark, SF01), "topic_shift", "pred_shift", "conversation")
    e = metrics.window_errors(seq, 2).filter(F.col("pk").isNotNull())
    assert e.filter(F.col("pk") > F.col("window_diff")).count() == 0


def test_stitch_shape(spark):
    t = fx.topic_turns(spark, SF01)
    s = augment.stitch(t, 2, 42)
    mx = t.agg(F.max("conversation_id")).collect()[0][0]
    g = s.groupBy("conversation_id").agg(F.min("turn_id").alias("a"), F.max("turn_id").alias("b"),
                                         F.count(F.lit(1)).alias("n"),
                                         F.countDistinct("sub_conversation_id").alias("k"))
    rows = g.collect()
    assert all(r.a == 1 and r.b == r.n and r.k == 2 and r.n % 2 == 0 and 4 <= r.n <= 12 for r in rows)
    ids = sorted(r.conversation_id for r in rows)
    assert ids == list(range(mx + 1, mx + 1 + len(ids)))
    first_b = s.filter((F.col("sub_conversation_id") == 1)).groupBy("conversation_id") \
        .agg(F.min_by("topic_shift", "turn_id").alias("f"))
    assert first_b.filter(F.col("f") != 1).count() == 0


@pytest.mark.parametrize("name", ["w1_segment_by_key", "g1_stitch", "n4_row_index", "m9_m10_window_errors"])
def test_partition_independent(spark, name):
    import __spark_entry__ as E
    q = E.queries()[name]
    res = []
    for n in ("1", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            res.append(sorted(tuple(r) for r in q(spark, SF01).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert res[0] == res[1]
