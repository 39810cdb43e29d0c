"""Operator 9: token ids in ORC files, and reading them back.

Rows are range-partitioned and sorted by (document id, text hash, salt), so files and stripes
cover id ranges in order, and neither an id nor a copy that a third of the rows share falls into
one task.  ORC stores ``ids array<int>`` with its integer run-length encoding; row indexes and a
Bloom filter on ``doc_id`` let a reader skip stripes and row groups for a given document, and
stripes are read in parallel.  Texts are moved (one shuffle), not ids.

``read_back`` numbers the stream: a document's start is the total of earlier files plus the
total of earlier rows of its file, in the order in which they were written.  Only per-file totals
(``_tw_pid``, one row per range partition) go through a window without a partition.

Defined results: null text is an empty text and gives the end id alone; null ids sort first;
repeated ids are separate documents in the order of the files; an empty table writes no
rows and reads back none; other columns are not stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import crc_ids, stored
from .pieces import encoder

ID_SCHEMA = "doc_id long, part int, place long, ids array<int>"


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int,
              id_col: str = "doc_id", text_col: str = "text", stripe_mb: int = 16) -> None:
    """Encode every text, append ``end_id`` and write ORC in ascending id order."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("th"), F.col("salt")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"), F.rand(7).alias("salt"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "doc_id", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"))
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for b in batches:
            for i in range(0, b.num_rows, 2000):  # few texts and ids at a time are Python objects
                j = min(i + 2000, b.num_rows)
                ids = [x + end for x in enc.encode(b.column("text").slice(i, 2000).to_pylist())]
                at = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in ("doc_id", "part", "place")), lists],
                                                 ["doc_id", "part", "place", "ids"])
        enc.rest()

    (rows.mapInArrow(encode, ID_SCHEMA).write
     .option("compression", "zstd")
     .option("orc.stripe.size", str(stripe_mb << 20))
     .option("orc.create.index", "true")
     .option("orc.row.index.stride", "1000")
     .option("orc.bloom.filter.columns", "doc_id")
     .option("orc.bloom.filter.fpp", "0.01")
     .orc(path))


def read_ids(spark, path: str) -> DataFrame:
    """The stored rows; filters on ``doc_id`` reach the stripes' indexes and Bloom filters."""
    return spark.read.schema(ID_SCHEMA).orc(path)


def read_back(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every stored document."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            at = lists.offsets.to_numpy().astype(np.int64)
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            crc = [crc_ids(raw[4 * i:4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("place"), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())],
                                             ["doc_id", "_tw_pid", "place", "n_tokens", "ids_crc32"])

    rows = stored(read_ids(spark, path).mapInArrow(digest, "doc_id long, _tw_pid int, place long, n_tokens long, ids_crc32 long"), "read")
    before = Window.orderBy("_tw_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_tw_pid").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("_tw_pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("_tw_pid").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(F.broadcast(parts), "_tw_pid").select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    path = path or scratch_path(spark, "ids-orc")
    write_ids(docs, path, tokenizer_path, end_id)
    return read_back(spark, path)
