"""Views that bring the driver tables into the reference data model.

Each view is built by Spark from the given parquet tables, so its size grows
with them.  The same definitions, in DuckDB SQL, are in
:mod:`turnwise.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import EOU
from ..operators.segment import segment_by_key
from ..plans.positions import with_group_rank
from ..plans.scan import laid_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` in the canonical turn schema."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("turn_id"),
                    F.col("role").alias("agent"), F.col("text").alias("message"))


def laid_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``turns``, laid out by (conversation, block of turns)."""
    return laid_out(turns(spark, sf_dir), ["conversation_id"])


def keyed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``turns`` with a knowledge-source list: blocks of up to three turns."""
    t = turns(spark, sf_dir)
    k = F.concat(F.lit("t"), F.floor((F.col("turn_id") + F.col("conversation_id") % 3) / 3)
                 .cast("long").cast("string"))
    return t.withColumn("knowledge_source", F.array(k))


def topic_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``keyed_turns`` segmented by key change (W1), laid out for the scans that follow."""
    return segmented(keyed_turns(spark, sf_dir))


def segmented(df: DataFrame) -> DataFrame:
    """W1, written once by (conversation, block of turns): later scans share the ordering."""
    return laid_out(segment_by_key(df, "knowledge_source"), ["conversation_id"], dealt=True)


def json_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested-JSON document per conversation: ``{"<id>": {"content": [turn, ...]}}``.

    The nested format stores a conversation as one record, so this groups
    turns by conversation.
    """
    k = keyed_turns(spark, sf_dir)
    turn = F.struct(F.col("turn_id"), F.col("agent"), F.col("message"),
                    F.lit("Neutral").alias("sentiment"), F.col("knowledge_source"),
                    F.lit("Good").alias("turn_rating"))
    g = k.groupBy("conversation_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    content = F.transform("t", lambda x: x.dropFields("turn_id"))
    doc = F.create_map(F.concat(F.lit("c"), F.col("conversation_id").cast("string")),
                       F.struct(content.alias("content")))
    return g.select("conversation_id", F.to_json(doc).alias("value"))


def eou_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delimited line per conversation: messages joined by `` __eou__ ``."""
    t = turns(spark, sf_dir)
    msg = F.regexp_replace("message", r"[\r\n]", " ")
    g = t.groupBy("conversation_id").agg(
        F.sort_array(F.collect_list(F.struct("turn_id", msg.alias("m")))).alias("t"))
    line = F.concat(F.array_join(F.transform("t", lambda x: x["m"]), f" {EOU} "), F.lit(f" {EOU}"))
    return g.select(F.col("conversation_id").alias("line_no"), line.alias("value"))


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transcript blob per conversation: ``User 1: ...`` / ``User 2: ...`` lines."""
    t = turns(spark, sf_dir)
    spk = F.when(F.col("turn_id") % 2 == 0, F.lit("User 1")).otherwise(F.lit("User 2"))
    g = t.groupBy("conversation_id").agg(
        F.sort_array(F.collect_list(F.struct("turn_id", F.concat(spk, F.lit(": "), F.col("message"))
                                             .alias("l")))).alias("t"))
    return g.select("conversation_id",
                    F.array_join(F.transform("t", lambda x: x["l"]), "\n")
                    .alias("best_generated_conversation"))


def emb_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as turns of ten: key = label >= 9, segmented."""
    e = table(spark, sf_dir, "embeddings")
    d = e.select((F.col("vec_id") / 10).cast("long").alias("conversation_id"),
                 (F.col("vec_id") % 10).alias("turn_id"), "embedding",
                 F.when(F.col("label") >= 9, "hi").otherwise("lo").alias("knowledge_source"))
    return segmented(d)


def event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``keyed_events`` segmented."""
    return segmented(keyed_events(spark, sf_dir))


def keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ranked_events``, laid out by (conversation, block of turns)."""
    return laid_out(ranked_events(spark, sf_dir), ["conversation_id"])


def ranked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events``: user = conversation, rank by (ts, event_id) = turn, event type = key."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    r = with_group_rank(e, ["user_id"], [F.col("ts"), F.col("event_id")], "turn_id")
    return r.select(F.col("user_id").alias("conversation_id"), "turn_id",
                    F.col("props").alias("message"), F.col("event_type").alias("knowledge_source"),
                    F.when(F.col("value") < 10, "low").otherwise("high").alias("agent"))


def doc_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` split on newline: doc = conversation, line number = turn."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select(F.col("doc_id").alias("conversation_id"),
                    F.posexplode(F.split("text", "\n")).alias("turn_id", "message")) \
            .withColumn("turn_id", F.col("turn_id").cast("long"))


def doc_topic_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_turns`` in topic blocks of eight lines (W1); repeated lines occur in a block."""
    d = doc_turns(spark, sf_dir).withColumn(
        "knowledge_source", F.concat(F.lit("p"), F.floor(F.col("turn_id") / 8).cast("long").cast("string")))
    return segmented(d)


def preds(spark: SparkSession, sf_dir: str, threshold: float = 0.03) -> DataFrame:
    """``topic_turns`` with a weak lexical prediction of each shift.

    ``pred_shift`` is 1 on a conversation's first turn and where the keyword
    overlap with the previous turn is below ``threshold``.
    """
    from ..operators.similarity import keyword_overlap_prev
    t = topic_turns(spark, sf_dir)
    d = keyword_overlap_prev(t, "overlap_prev", stopwords=())
    pred = F.when(F.col("overlap_prev").isNull(), 1) \
            .when(F.col("overlap_prev") < threshold, 1).otherwise(0).cast("int")
    return d.withColumn("pred_shift", pred).drop("overlap_prev")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``emb_turns`` with logits ``4*e[0]``, ``4*e[1]`` and the key change as label."""
    t = emb_turns(spark, sf_dir)
    return t.select("conversation_id", "turn_id",
                    F.col("topic_shift").alias("label"),
                    (F.lit(4.0) * F.col("embedding")[0].cast("double")).alias("logit0"),
                    (F.lit(4.0) * F.col("embedding")[1].cast("double")).alias("logit1"))
