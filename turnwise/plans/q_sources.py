"""Queries for readers and sinks (S1-S8) and turn-count reconciliation.

Sink queries write a table derived from the driver data to a fresh folder
under the shared checkpoint directory and read it back with the matching
reader, so the oracle is the table that was written.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, joins
from ..operators.segment import segment_by_key
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import readers, sinks
from .catalog import register
from .oracle import WS, sql, strip

_WSI = WS[1:-1]  # the class body, for use inside another class

_TOPIC_COLS = ("conversation_id", "sub_conversation_id", "turn_id", "agent", "message",
               "knowledge_source", "topic_shift")
_TOPIC_SCHEMA = ("conversation_id bigint, sub_conversation_id bigint, turn_id bigint, agent string, "
                 "message string, knowledge_source string, topic_shift int")
_TOPIC_SQL = sql(["topic_turns"], "SELECT " + ", ".join(_TOPIC_COLS) + " FROM topic_turns")


@register("s1_read_nested_json", sql(["topic_turns"], """
    SELECT 'c' || conversation_id AS conversation_key,
           CAST(dense_rank() OVER (ORDER BY conversation_id) - 1 AS BIGINT) AS conversation_id,
           sub_conversation_id, turn_id, agent, message, knowledge_source, topic_shift,
           'Neutral' AS sentiment, 'Good' AS turn_rating
    FROM topic_turns"""))
def s1_read_nested_json(spark, sf_dir):
    """Nested JSON documents -> turns -> dense ids by first appearance -> segments."""
    docs = fx.json_docs(spark, sf_dir)
    t = readers.explode_nested_json(docs, "value", ["conversation_id"])
    t = readers.number_conversations(t)
    t = segment_by_key(t, "knowledge_source")
    return t.select("conversation_key", "conversation_id", "sub_conversation_id", "turn_id", "agent",
                    "message", "knowledge_source", "topic_shift", "sentiment", "turn_rating")


ORACLE_S2 = sql(["turns"], f"""
    SELECT CAST(dense_rank() OVER (ORDER BY conversation_id) AS BIGINT) AS Chat_ID,
           CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY turn_id) - 1 AS BIGINT) AS Count,
           CASE WHEN (row_number() OVER (PARTITION BY conversation_id ORDER BY turn_id) - 1) % 2 = 0
                THEN 'agent_1' ELSE 'agent_2' END AS Agents,
           m AS Messages
    FROM (SELECT conversation_id, turn_id,
                 {strip("regexp_replace(message, '[' || chr(13) || chr(10) || ']', ' ', 'g')")} AS m
          FROM turns)
    WHERE m <> ''""")


@register("s2_read_delimited", ORACLE_S2)
def s2_read_delimited(spark, sf_dir):
    """``__eou__``-delimited lines -> turns with 1-based chat ids."""
    return readers.explode_delimited(fx.eou_lines(spark, sf_dir), "value", "line_no")


@register("s3_s6_csv_roundtrip", _TOPIC_SQL)
def s3_s6_csv_roundtrip(spark, sf_dir):
    t = fx.topic_turns(spark, sf_dir).select(*_TOPIC_COLS)
    path = scratch_path(spark, "csv")
    sinks.write_csv(t, path)
    return readers.read_turns_csv(spark, path, _TOPIC_SCHEMA)


@register("s4_tsv_roundtrip", _TOPIC_SQL)
def s4_tsv_roundtrip(spark, sf_dir):
    t = fx.topic_turns(spark, sf_dir).select(*_TOPIC_COLS)
    path = scratch_path(spark, "tsv")
    sinks.write_tsv(t, path)
    return readers.read_tsv(spark, path, _TOPIC_SCHEMA)


@register("s7_json_roundtrip", _TOPIC_SQL)
def s7_json_roundtrip(spark, sf_dir):
    t = fx.topic_turns(spark, sf_dir).select(*_TOPIC_COLS)
    path = scratch_path(spark, "json")
    sinks.write_json(t, path)
    return spark.read.schema(_TOPIC_SCHEMA).json(path)


def _clean_sql(x: str, user: str) -> str:
    m = f"regexp_replace({x}, '(?i){user}[{_WSI}]*:[{_WSI}]*', '', 'g')"
    return strip(f"regexp_replace({strip(m)}, '[^\\p{{L}}\\p{{N}}_{_WSI}.,!?]', '', 'g')")


_PARSED = f"""
    lines AS (
      SELECT conversation_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS raw
      FROM (SELECT conversation_id,
                   string_split({strip("replace(best_generated_conversation, chr(13) || chr(10), chr(10))")},
                                chr(10)) AS ls
            FROM blobs)),
    cl AS (SELECT conversation_id, line_no,
                  {strip(f"regexp_replace(raw, '[^A-Za-z0-9{_WSI}.!?'':]', '', 'g')")} AS l
           FROM lines),
    kept AS (
      SELECT conversation_id, line_no,
             CASE WHEN regexp_matches(l, '(?i)^User 1[{_WSI}]*:') THEN 'User 1'
                  WHEN regexp_matches(l, '(?i)^User 2[{_WSI}]*:') THEN 'User 2' END AS "user",
             CASE WHEN regexp_matches(l, '(?i)^User 1[{_WSI}]*:') THEN {_clean_sql('l', 'User 1')}
                  WHEN regexp_matches(l, '(?i)^User 2[{_WSI}]*:') THEN {_clean_sql('l', 'User 2')} END
               AS message
      FROM cl WHERE l <> '' AND (starts_with(l, 'User 1') OR starts_with(l, 'User 2'))),
    parsed AS (
      SELECT conversation_id,
             CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY line_no) - 1 AS BIGINT) AS turn_id,
             "user", message
      FROM kept WHERE "user" IS NOT NULL)"""


@register("s5_parse_transcript", sql(["blobs"], "SELECT * FROM parsed", _PARSED))
def s5_parse_transcript(spark, sf_dir):
    return readers.parse_transcript(fx.blobs(spark, sf_dir), "conversation_id", "best_generated_conversation")


@register("j3_reconcile_turns", sql(["blobs"], """
    SELECT coalesce(e.conversation_id, p.conversation_id) AS conversation_id, e.total_turns, p.n_parsed,
           CASE WHEN e.total_turns IS NOT DISTINCT FROM p.n_parsed THEN 0 ELSE 1 END AS differs
    FROM (SELECT conversation_id,
                 CAST(len(regexp_extract_all(best_generated_conversation, '(?i)\\nUser')) + 1 AS BIGINT)
                   AS total_turns FROM blobs) e
    FULL OUTER JOIN (SELECT conversation_id, count(*) AS n_parsed FROM parsed GROUP BY conversation_id) p
      ON e.conversation_id = p.conversation_id""", _PARSED))
def j3_reconcile_turns(spark, sf_dir):
    """Counted turns (P4) against parsed turns (S5); a side missing counts as different."""
    b = fx.blobs(spark, sf_dir)
    expected = clean.with_turn_count(b, "best_generated_conversation")
    parsed = readers.parse_transcript(b, "conversation_id", "best_generated_conversation")
    return joins.reconcile_turns(expected, parsed).select(
        "conversation_id", "total_turns", "n_parsed", "differs")


@register("s1_read_nested_json_file", sql(["topic_turns"], """
    SELECT 'c' || conversation_id AS conversation_key,
           CAST(dense_rank() OVER (ORDER BY conversation_id) - 1 AS BIGINT) AS conversation_id,
           sub_conversation_id, turn_id, agent, message, knowledge_source, topic_shift,
           'Neutral' AS sentiment, 'Good' AS turn_rating
    FROM topic_turns"""))
def s1_read_nested_json_file(spark, sf_dir):
    """S1 from JSON Lines files: documents written in conversation order, read back with
    the file's own line order giving first appearance."""
    path = scratch_path(spark, "nested-json")
    fx.json_docs(spark, sf_dir).orderBy("conversation_id").select("value").write.text(path)
    t = readers.number_conversations(readers.read_nested_json(spark, path))
    t = segment_by_key(t, "knowledge_source")
    return t.select("conversation_key", "conversation_id", "sub_conversation_id", "turn_id", "agent",
                    "message", "knowledge_source", "topic_shift", "sentiment", "turn_rating")


@register("s2_read_delimited_file", ORACLE_S2)
def s2_read_delimited_file(spark, sf_dir):
    """S2 from a text file of ``__eou__`` lines, in file order."""
    path = scratch_path(spark, "eou")
    fx.eou_lines(spark, sf_dir).orderBy("line_no").select("value").write.text(path)
    return readers.read_delimited(spark, path)


@register("s3_read_csv_with_index", _TOPIC_SQL)
def s3_read_csv_with_index(spark, sf_dir):
    """A turn CSV saved with its row index (``Unnamed: 0``), read back without it."""
    t = fx.topic_turns(spark, sf_dir).select(*_TOPIC_COLS)
    t = t.select(F.monotonically_increasing_id().alias("Unnamed: 0"), *_TOPIC_COLS)
    path = scratch_path(spark, "csv-index")
    sinks.write_csv(t, path)
    return readers.read_turns_csv(spark, path, "`Unnamed: 0` bigint, " + _TOPIC_SCHEMA)
