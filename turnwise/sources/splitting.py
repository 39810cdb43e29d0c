"""Records that line breaks do not delimit, read by as many tasks as the file has splits.

A file is cut at a separator byte (line break for CSV and TSV, ``}`` for JSON) by Spark's own text
source, so any byte range is a task.  Whether a piece starts inside quotes, and how deep it lies,
depends on everything before it; these are prefix sums over pieces (quotes, braces, brackets),
scanned by file split with one row per split carried on.  Pieces are written once, with their
counts, so that every scan sees the same cuts.  Only pieces of a record that spans several are
brought together, by record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scan import ordered_scan
from ..session import cut_lineage


def pieces(spark: SparkSession, path: str, sep: str, **counts: Column) -> DataFrame:
    """``f`` (file), ``b`` (its split), ``i`` (order in the split), ``value`` and ``counts``, written once."""
    df = spark.read.option("lineSep", sep).text(path).select(
        "value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return cut_lineage(df.select("f", "b", "i", "value", *[c.alias(n) for n, c in counts.items()]))


def _count(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("long")


def _scan(df: DataFrame, **kw) -> DataFrame:
    return ordered_scan(df, ["f"], "i", block="b", **kw)


def _assembled(df: DataFrame, whole: Column, sep: str, *more: str) -> DataFrame:
    """Records ``f, rid, text, *more``: whole pieces as they are, the others put together (``more``: the one value that is not null)."""
    one = df.where(whole).select("f", "rid", F.col("value").alias("text"), *more)
    parts = df.where(~whole).groupBy("f", "rid").agg(
        F.array_sort(F.collect_list(F.struct("b", "i", "value"))).alias("_list"), *[F.max(c).alias(c) for c in more])
    return one.unionByName(parts.select("f", "rid", F.array_join(F.transform("_list", lambda x: x["value"]), sep).alias("text"), *more))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of CSV or TSV files whose quoted fields may hold line breaks: ``f, rid, text`` (``rid`` from 1).

    Quotes inside fields are doubled, as this library writes them; a lone quote in an unquoted
    field is not supported.
    """
    p = pieces(spark, path, "\n", q=_count(F.col("value"), '"'))
    p = _scan(p, sums={"all_q": "q"})
    inside = (F.col("all_q") - F.col("q")) % 2 == 1
    p = p.withColumn("starts", F.when(inside, 0).otherwise(1))
    p = _scan(p, sums={"rid": "starts"})
    whole = (F.col("starts") == 1) & (F.col("all_q") % 2 == 0)
    r = _assembled(p, whole, "\n")
    return r.withColumn("text", F.regexp_replace("text", "\r$", "")).where("text <> ''")


# Outside strings a brace or bracket is structure.  Escaped characters go first; then a string is
# what lies between two quotes, or runs to the end of the piece.
_ESCAPED, _STRING = r"(?s)\\.", r'(?s)"[^"]*+(?:"|$)'


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """Records of nested-JSON files: ``f, rid, text, deep, flat, turn``.

    A record ends with the ``}`` (not in ``text``) of a turn, of another object of a conversation, of
    a conversation or of a document.  ``deep`` is the number of open braces before it starts,
    ``flat`` of open brackets, ``turn`` whether it is an object in a conversation's list.
    """
    plain = F.regexp_replace("value", _ESCAPED, "")
    out0 = F.regexp_replace(plain, _STRING, "")
    out1 = F.regexp_replace(F.concat(F.lit('"'), plain), _STRING, "")
    counts = {"q": _count(plain, '"')}
    for k, o in (("0", out0), ("1", out1)):
        counts["o" + k] = _count(o, "{")
        counts["l" + k] = _count(o, "[") - _count(o, "]")
    p = pieces(spark, path, "}", **counts)
    p = _scan(p, sums={"all_q": "q"})
    inside = (F.col("all_q") - F.col("q")) % 2 == 1
    p = p.select("f", "b", "i", "value", F.when(inside, F.col("o1")).otherwise(F.col("o0")).alias("opened"),
                 F.when(inside, F.col("l1")).otherwise(F.col("l0")).alias("lists"),
                 F.when(F.col("all_q") % 2 == 0, 1).otherwise(0).cast("long").alias("closed"))
    p = _scan(p, sums={"all_opened": "opened", "all_closed": "closed", "flat_end": "lists"})
    deep_end = F.col("all_opened") - (F.col("all_closed") - F.col("closed"))
    p = p.withColumn("deep_end", deep_end).withColumn("turn", (F.col("closed") == 1) & (deep_end == 3) & (F.col("flat_end") == 1))
    p = p.withColumn("ends", F.when((F.col("closed") == 1) & (deep_end <= 3), 1).otherwise(0).cast("long"))
    p = p.withColumn("after", F.struct((F.col("deep_end") - F.col("closed")).alias("deep"), F.col("flat_end").alias("flat"), F.col("ends").alias("e")))
    p = _scan(p.drop("opened", "lists", "all_opened", "all_closed", "flat_end", "deep_end"), sums={"rid": "ends"}, prev=["after"])
    p = p.withColumn("rid", F.col("rid") - F.col("ends") + 1)
    first = F.col("prev_after").isNull() | (F.col("prev_after.e") == 1)
    # Depth where the record starts, known to its first piece.
    zero = F.lit(0).cast("long")
    p = p.withColumn("deep", F.when(first, F.coalesce("prev_after.deep", zero))).withColumn("flat", F.when(first, F.coalesce("prev_after.flat", zero)))
    whole = first & (F.col("ends") == 1)
    return _assembled(p, whole, "}", "deep", "flat", "turn")
