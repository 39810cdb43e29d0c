"""Structured Streaming row-wise labelling and the MLlib classifier."""

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from turnwise.operators import model
from turnwise.session import scratch_path
from turnwise.sources import fixtures as fx
from turnwise.streaming.rowwise import label_turns, read_turn_stream, run_to_parquet


def test_stream_is_incremental_and_exactly_once(spark):
    logits = fx.logits(spark, SF01)
    src, out, ckpt = (scratch_path(spark, n) for n in ("src", "out", "ckpt"))
    first = logits.filter(F.col("conversation_id") % 2 == 0)
    second = logits.filter(F.col("conversation_id") % 2 == 1)
    first.write.mode("append").parquet(src)
    schema = logits.schema.simpleString()[len("struct<"):-1].replace(":", " ")
    run_to_parquet(label_turns(read_turn_stream(spark, src, schema)), out, ckpt)
    n1 = spark.read.parquet(out).count()
    second.write.mode("append").parquet(src)
    run_to_parquet(label_turns(read_turn_stream(spark, src, schema)), out, ckpt)  # restart, same checkpoint
    res = spark.read.parquet(out)
    assert n1 == first.count()
    assert res.count() == logits.count()                      # each row once
    assert res.select("conversation_id", "turn_id").distinct().count() == logits.count()
    bad = res.filter((F.col("pred") == 1) != (F.col("p1") > 0.63))
    assert bad.count() == 0


def test_classifier_is_repeatable(spark):
    e = fx.emb_turns(spark, SF01).select("conversation_id", "turn_id", "embedding", "topic_shift")
    m1 = model.fit_classifier(e, "embedding", "topic_shift", weighted=True, max_iter=30)
    m2 = model.fit_classifier(e, "embedding", "topic_shift", weighted=True, max_iter=30)
    assert list(m1.coefficients) == pytest.approx(list(m2.coefficients), abs=1e-9)
    assert m1.intercept == pytest.approx(m2.intercept, abs=1e-9)
    p = model.predict(m1, e, "embedding", ["conversation_id", "turn_id", "topic_shift"])
    assert p.count() == e.count()
    assert p.filter((F.col("p1") < 0) | (F.col("p1") > 1)).count() == 0
