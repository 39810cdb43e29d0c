"""Row-wise operators on Structured Streaming DataFrames.

The reference reads files whole; nothing in it is stateful over time.  The
operators that look at one row only (label and text normalisation, speaker
assignment, first-turn reset by turn id, keyword overlap of two columns,
vector normalisation and distance, thresholded predictions) are plain column
expressions, so they run unchanged on a streaming DataFrame.  This module
wires them to a file stream with an exactly-once file sink; the checkpoint
goes to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_label, normalize_text
from ..session import scratch_path


def read_turn_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream of turn rows (new files in ``path`` become new rows)."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        r = r.option("header", True).option("multiLine", True).option("escape", '"')
    return r.load(path)


def label_turns(stream: DataFrame, threshold: float = 0.63) -> DataFrame:
    """Row-wise labelling of a stream of logit rows: M1 threshold, M2 arg-max, P2, P3, P9, P10."""
    d = stream
    if "logit0" in d.columns:
        p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("logit0") - F.col("logit1")))
        d = d.withColumn("p1", p1).withColumn("pred", (p1 > threshold).cast("int")) \
             .withColumn("pred_argmax", F.when(F.col("logit1") > F.col("logit0"), 1).otherwise(0))
    if "label" in d.columns:
        d = d.withColumn("label", normalize_label("label"))
    if "message" in d.columns:
        d = d.withColumn("norm_message", normalize_text("message"))
    if "turn_id" in d.columns:
        d = d.withColumn("speaker", F.when(F.col("turn_id") % 2 == 0, "agent_1").otherwise("agent_2"))
        if "topic_shift" in d.columns:
            d = d.withColumn("topic_shift", F.when((F.col("turn_id") == 0) & (F.col("topic_shift") == 1), 0)
                             .otherwise(F.col("topic_shift")))
    return d


def run_to_parquet(stream: DataFrame, out_path: str, checkpoint: str | None = None,
                   available_now: bool = True):
    """Start an append-mode parquet sink; with ``available_now`` process what exists and stop."""
    spark = stream.sparkSession
    ckpt = checkpoint or scratch_path(spark, "stream-ckpt")
    w = stream.writeStream.format("parquet").option("path", out_path) \
        .option("checkpointLocation", ckpt).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


def stream_labels(spark: SparkSession, logits: DataFrame, threshold: float = 0.63) -> DataFrame:
    """Write ``logits`` as files, label them through a file stream, and read the sink back."""
    src = scratch_path(spark, "stream-src")
    logits.write.mode("overwrite").parquet(src)
    schema = logits.schema.simpleString()[len("struct<"):-1].replace(":", " ")
    out = scratch_path(spark, "stream-out")
    run_to_parquet(label_turns(read_turn_stream(spark, src, schema), threshold), out)
    return spark.read.parquet(out)


__all__ = ["read_turn_stream", "label_turns", "run_to_parquet", "stream_labels"]
