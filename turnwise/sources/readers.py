"""Readers that bring dialogue corpora of different shapes into turn tables.

Files are read by Spark's own sources (text, CSV); all parsing is column
expressions (``from_json``, ``split``, ``regexp_replace``) and ``posexplode``, so
every file split is parsed by its own task.  Positions that the reference takes
from list order (turn number, first-appearance conversation order, line order)
come from ``posexplode`` and from the file's own line order
(``_metadata.file_path``, ``file_block_start`` and the row's index in the block).
"""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import EOU, VALID_USERS, strip
from ..plans.positions import dense_rank_of, with_position
from ..plans.scan import ordered_scan, with_running_sum
from .splitting import csv_records, json_objects

CONV, TURN = "conversation_id", "turn_id"

TURN_STRUCT = T.StructType([
    T.StructField("agent", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("knowledge_source", T.ArrayType(T.StringType())),
    T.StructField("turn_rating", T.StringType()),
])
NESTED_SCHEMA = T.MapType(T.StringType(), T.StructType([
    T.StructField("content", T.ArrayType(TURN_STRUCT))]))


def with_line_order(df: DataFrame, out: str = "line_no") -> DataFrame:
    """Order key of a text-file row: (file, block start, index inside the block).

    Rows of one block are read in file order by one task, so
    ``monotonically_increasing_id`` increases along the block.
    """
    return df.withColumn(out, F.struct(F.col("_metadata.file_path").alias("f"),
                                       F.col("_metadata.file_block_start").alias("b"),
                                       F.monotonically_increasing_id().alias("i")))


def read_text_lines(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """``value`` per line (or per file), with an order key ``line_no``."""
    df = spark.read.text(path, wholetext=whole_file).select("value", "_metadata")
    return with_line_order(df).drop("_metadata")


def explode_nested_json(df: DataFrame, json_col: str = "value",
                        order: Sequence[Column | str] = ("line_no",)) -> DataFrame:
    """``{conv_key: {"content": [turn, ...]}}`` documents -> one row per turn.

    Returns ``conversation_key, conv_order, turn_id, agent, message, sentiment,
    knowledge_source (array), turn_rating``.  ``conv_order`` orders
    conversations by first appearance (document order, then key position).
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    d = df.select(F.struct(*order).alias("_doc"), F.from_json(F.col(json_col), NESTED_SCHEMA).alias("_m"))
    d = d.select("_doc", F.posexplode("_m").alias("_kpos", "conversation_key", "_conv"))
    d = d.select("_doc", "_kpos", "conversation_key",
                 F.posexplode(F.col("_conv.content")).alias(TURN, "_t"))
    return d.select("conversation_key", F.struct("_doc", "_kpos").alias("conv_order"),
                    F.col(TURN).cast("long").alias(TURN), "_t.agent", "_t.message", "_t.sentiment",
                    "_t.knowledge_source", "_t.turn_rating")


def read_nested_json(spark: SparkSession, path: str) -> DataFrame:
    """S1 from files: any number of documents ``{conv_key: {"content": [turn, ...]}}``, one a line or over many lines.

    One document may hold many conversations and one conversation many turns: a record is a turn
    (:mod:`turnwise.sources.splitting`), and no document or conversation is brought together.
    Columns as :func:`explode_nested_json`; other lists of objects in a conversation are not expected.
    """
    r = json_objects(spark, path)
    # The record in which a conversation opens starts with its key.
    opens = (F.col("deep") <= 1) & F.col("text").rlike(r'(?s)^[^"]*+"(?:[^"\\]|\\.)*+"\s*:\s*\{')
    key = F.from_json(F.concat(F.lit('{"k":"'), F.regexp_extract("text", r'(?s)^[^"]*+"((?:[^"\\]|\\.)*+)"', 1), F.lit('"}')), "k string")["k"]
    r = r.withColumn("opens", F.when(opens, 1).otherwise(0)).withColumn("at_key", F.when(opens, F.struct("rid", key.alias("k"))))
    r = ordered_scan(r, ["f"], "rid", sums={"conv": "opens"}, last={"key": "at_key"}).where("turn")
    r = ordered_scan(r, ["f", "conv"], "rid", sums={TURN: F.lit(1)})
    # What stands before the turn itself: a comma, or all up to the list's bracket.
    start = F.when(F.col("flat") == 0, F.regexp_replace("text", r'(?s)^[^"]*+(?:"(?:[^"\\]|\\.)*+"[^"]*+)*?"content"\s*:\s*\[', "")).otherwise(F.col("text"))
    turn = F.from_json(F.concat(F.regexp_replace(start, r"^[\s,]*", ""), F.lit("}")), TURN_STRUCT)
    r = r.select(F.col("key.k").alias("conversation_key"), F.struct("f", "conv").alias("conv_order"), (F.col(TURN) - 1).alias(TURN), turn.alias("_t"))
    return r.select("conversation_key", "conv_order", TURN, "_t.agent", "_t.message", "_t.sentiment", "_t.knowledge_source", "_t.turn_rating")


def number_conversations(df: DataFrame, key: str = "conversation_key",
                         order: str = "conv_order", out: str = CONV) -> DataFrame:
    """N2 on a parsed corpus: dense 0-based ids in first-appearance order."""
    ids = dense_rank_of(df, [key], [order], out)
    return df.join(ids, key)


def explode_delimited(df: DataFrame, line_col: str = "value", order: str = "line_no",
                      sep: str = EOU) -> DataFrame:
    """One conversation per line, turns separated by ``sep``.

    Messages are stripped and empty ones removed before numbering.  Returns
    ``Chat_ID`` (1-based running count of lines with a message, N3),
    ``Count`` (0-based turn), ``Agents`` (alternating, P9) and ``Messages``.
    """
    msgs = F.filter(F.transform(F.split(F.col(line_col), "\\Q" + sep + "\\E"), lambda m: strip(m)),
                    lambda m: m != "")
    d = df.select(F.col(order).alias("_ord"), msgs.alias("_m")).filter(F.size("_m") > 0)
    # The rows themselves are numbered and written once: the order key is made while reading, so
    # a join back on it would miss rows if the file were split differently the second time.
    d = with_position(d, ["_ord"], "_pos").withColumn("Chat_ID", F.col("_pos") + 1)
    d = d.select("Chat_ID", F.posexplode("_m").alias("Count", "Messages"))
    return d.select("Chat_ID", F.col("Count").cast("long").alias("Count"),
                    F.when(F.col("Count") % 2 == 0, "agent_1").otherwise("agent_2").alias("Agents"),
                    "Messages")


def read_delimited(spark: SparkSession, path: str, sep: str = EOU) -> DataFrame:
    """S2 from a text file."""
    return explode_delimited(read_text_lines(spark, path), "value", "line_no", sep)


def _csv_rows(records: DataFrame, schema: T.StructType | str, sep: str) -> DataFrame:
    schema = schema if isinstance(schema, str) else schema.toDDL()
    return records.select(F.from_csv("text", schema, {"sep": sep, "escape": '"', "maxCharsPerColumn": "-1"}).alias("r")).select("r.*")


def read_turns_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                   index_cols: Sequence[str] = ("Unnamed: 0", "_c0", ""), multi_line: bool = True) -> DataFrame:
    """S3: CSV with a header; saved-index columns dropped.

    With ``multi_line`` quoted fields may span lines; a file is still read by as many tasks as it has
    splits (:mod:`turnwise.sources.splitting`).  Without a schema every column is a string.
    """
    if multi_line:
        records = csv_records(spark, path)
        if schema is None:
            head = records.where("rid = 1").select("text").head()
            names = next(csv.reader(io.StringIO(head["text"], newline=""))) if head else []
            schema = T.StructType([T.StructField(n or f"_c{k}", T.StringType()) for k, n in enumerate(names)])
        df = _csv_rows(records.where("rid > 1"), schema, ",")
    else:
        r = spark.read.option("header", True).option("escape", '"')
        df = (r.schema(schema) if schema is not None else r).csv(path)
    return df.drop(*[c for c in index_cols if c in df.columns])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = True) -> DataFrame:
    """Headerless tab-separated file with the given schema; ``multi_line`` as for S3."""
    if multi_line:
        return _csv_rows(csv_records(spark, path), schema, "\t")
    return spark.read.option("sep", "\t").option("header", False).option("escape", '"').schema(schema).csv(path)


def parse_transcript(df: DataFrame, id_col: str, text_col: str,
                     users: Sequence[str] = VALID_USERS) -> DataFrame:
    """Transcript blob -> ``(conversation_id, turn_id, user, message)``.

    Per line, in order: characters outside ``[A-Za-z0-9 white space .!?':]``
    are deleted and the line stripped; empty lines are skipped; only lines
    starting (case-sensitively) with a valid user are kept; the line must start
    with ``<user> :`` (any case); every occurrence of that marker is deleted;
    characters outside ``[word white space .,!?]`` are deleted; the result is
    stripped.  A marker with no text gives an empty message that is kept.
    """
    text = strip(F.regexp_replace(F.col(text_col), "\r\n", "\n"))
    d = df.select(F.col(id_col).alias(CONV), F.posexplode(F.split(text, "\n")).alias("_line", "_raw"))
    d = d.withColumn("_l", strip(F.regexp_replace("_raw", r"(?U)[^A-Za-z0-9\s.!?':]", "")))
    starts = None
    for u in users:
        s = F.col("_l").startswith(u)
        starts = s if starts is None else starts | s
    d = d.filter((F.col("_l") != "") & starts)
    user = None
    msg = None
    for u in users:
        marker = "(?iU)\\Q" + u + "\\E" + r"\s*:\s*"
        hit = F.col("_l").rlike("^" + marker)
        user = (F.when(hit, F.lit(u)) if user is None else user.when(hit, F.lit(u)))
        cleaned = strip(F.regexp_replace(strip(F.regexp_replace("_l", marker, "")), r"[()\[\]{}]", ""))
        cleaned = strip(F.regexp_replace(cleaned, r"(?U)[^\w\s.,!?]", ""))
        msg = (F.when(hit, cleaned) if msg is None else msg.when(hit, cleaned))
    d = d.select(CONV, "_line", user.alias("user"), msg.alias("message")).filter(F.col("user").isNotNull())
    d = with_running_sum(d, [CONV], "_line", F.lit(1), TURN)
    return d.select(CONV, (F.col(TURN) - 1).alias(TURN), "user", "message")
