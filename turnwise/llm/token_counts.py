"""Operator 1: token counts through a digest cache.

A text's normalised content (runs of white space as one space where the tokenizer drops white
space; otherwise the text itself) is digested with SHA-256, and so is the tokenizer's file.
``(tokenizer digest, content digest) -> count`` is an append-only parquet cache partitioned by
tokenizer digest.  Only distinct contents that the cache does not hold are encoded; their counts
are appended, and every row gets its count by a join on the digest.

Scale: one shuffle of the distinct missing texts (copies collapse before it, in the map-side
half of the aggregate), then joins of 32-byte digests.  Both sides of the last join are written
tables, so AQE can split a digest that a third of the rows share.

Defined results: null text counts as empty (0 tokens, 0 bytes); null or repeated ids each keep
their row; an empty table gives an empty result; other columns are not read, and results carry
the id column under its own name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import stored
from .pieces import encoder

CACHE_SCHEMA = "content binary, n_tokens long, tokenizer string"


def tokenizer_digest(path: str) -> str:
    """Version of the tokenizer: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(text: Column, collapse_space: bool) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(text, "[ \\t\\r\\n]+", " ")) if collapse_space else text


def read_cache(spark, cache_path: str, version: str) -> DataFrame:
    """The cache's rows for one tokenizer version (none, if it does not exist yet)."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return spark.createDataFrame([], CACHE_SCHEMA).select("content", "n_tokens")
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    return rows.groupBy("content").agg(F.first("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text", limit: int = 2048,
                 collapse_space: bool = True) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``collapse_space`` must only be set for tokenizers that drop white space.  Without
    ``cache_path`` a new cache is started under the shared checkpoint folder.
    """
    spark = docs.sparkSession
    cache_path = cache_path or scratch_path(spark, "token-cache")
    version = tokenizer_digest(tokenizer_path)
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    norm = normalised(F.col("text"), collapse_space)
    digested = text.select("id", F.octet_length("text").cast("long").alias("n_bytes"), norm.alias("norm"),
                           F.unhex(F.sha2(norm, 256)).alias("content"))
    keys = stored(digested.drop("norm"), "digests")

    known = read_cache(spark, cache_path, version)
    fresh = digested.select("content", "norm")
    if not known.isEmpty():
        fresh = fresh.join(stored(known.select("content"), "known"), "content", "left_anti")
    misses = fresh.groupBy("content").agg(F.first("norm").alias("norm"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for b in batches:
            texts = b.column("norm")
            counts = [len(ids) // 4 for i in range(0, len(texts), 500) for ids in enc.encode(texts.slice(i, 500).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("content"), pa.array(counts, pa.int64())], ["content", "n_tokens"])
        enc.rest()

    new = misses.mapInArrow(encode, "content binary, n_tokens long")
    new.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)

    counts = stored(read_cache(spark, cache_path, version), "counts")
    return keys.join(counts, "content").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
