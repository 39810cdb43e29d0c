"""Session construction and shared-storage helpers.

Everything here is ordinary SparkSession configuration.  Nothing assumes
local mode except the test fallback for the checkpoint directory.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every turnwise job wants; a cluster launcher may override them.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "turnwise",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the turnwise defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and scratch tables.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint directory).  Only a local session without one gets a private
    temporary folder; on a cluster a missing setting is an error, since a
    machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        conf = tempfile.mkdtemp(prefix="turnwise-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a written intermediate table."""
    base = shared_dir(spark)
    return os.path.join(base, "tables", f"{name}-{os.getpid()}-{next(_counter)}")


def _count():
    i = 0
    while True:
        i += 1
        yield i


_counter = _count()


_PARQUET_UNSAFE = set(" ,;{}()\n\t=")


def cut_lineage(df):
    """Materialise ``df`` in the shared folder and continue from the stored copy.

    The copy is a parquet table under ``spark.checkpoint.dir`` (compressed, and
    later reads prune the columns they do not need); column names parquet may
    reject fall back to a reliable ``checkpoint()`` in the same folder.
    Either way a lost executor re-reads the stored rows instead of
    recomputing the lineage.
    """
    spark = df.sparkSession
    if any(ch in _PARQUET_UNSAFE for c in df.columns for ch in c):
        shared_dir(spark)
        return df.checkpoint(eager=True)
    path = scratch_path(spark, "cut")
    watch(df)
    df.write.parquet(path)
    return spark.read.parquet(path)


# Called with every table before it is written, if set (tests look at the plans of writes too).
on_write = None


def watch(df) -> None:
    if on_write:
        on_write(df)


def bucketed_table(df, keys, order, dealt=False):
    """``df`` written once in the shared folder, bucketed by ``keys`` and sorted, and read back.

    Spark knows the layout of the copy: windows, aggregates and joins on ``keys`` read it without
    an exchange of its rows.  ``dealt``: the rows already lie by ``keys``, one bucket a task.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "laid")
    name = os.path.basename(path).replace("-", "_")
    d = df if dealt else df.repartition(n, *keys)
    watch(d)
    d.write.format("parquet").bucketBy(n, *keys).sortBy(*keys, *order).option("path", path).saveAsTable(name)
    return spark.table(name)
