"""DuckDB SQL for every registered query (the correctness oracle).

The views of :mod:`turnwise.sources.fixtures` are written here once more as
SQL common table expressions over the driver tables.  ``sql(views, body)``
prefixes a query body with the views it needs (dependencies first).

Portability notes (Spark 4.1 / DuckDB 2.0):
* Unicode word characters: Spark ``(?U)\\w``, DuckDB ``[\\p{L}\\p{N}_]``.
* Unicode white space (Java's White_Space): DuckDB ``[\\t\\n\\x0b\\f\\r\\x{85}\\p{Z}]``.
* ``sum`` of integers is HUGEINT in DuckDB: cast to BIGINT.
* Doubles are rounded to 6 digits on both sides.
"""

from __future__ import annotations

WS = r"[\t\n\x0b\f\r\x{85}\p{Z}]"
W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def norm_text(x: str) -> str:
    return f"regexp_replace(lower({x}), '{NW}+', ' ', 'g')"


def toks(x: str) -> str:
    """Tokens of two or more word characters (maximal runs)."""
    return f"regexp_extract_all(lower({x}), '{W}{{2,}}')"


def kw_overlap(a: str, b: str, stop: tuple = ()) -> str:
    def s(x):
        t = f"list_distinct({toks(x)})"
        if stop:
            lst = ", ".join("'" + w + "'" for w in stop)
            t = f"list_filter({t}, lambda z: NOT list_contains([{lst}], z))"
        return t
    sa, sb = s(a), s(b)
    return (f"(len(list_intersect({sa}, {sb})) / "
            f"(len(list_distinct(list_concat({sa}, {sb}))) + 1e-6))")


def phash(*parts: str) -> str:
    """Portable hash: first 32 bits of md5 of the '|'-joined parts."""
    s = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5({s}), 1, 8)) AS BIGINT)"


def dot(a: str, b: str) -> str:
    return (f"list_sum(list_transform(list_zip({a}, {b}), "
            f"lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))")


def vnorm(a: str) -> str:
    return f"sqrt(list_sum(list_transform({a}, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE))))"


def cosine(a: str, b: str) -> str:
    return f"({dot(a, b)} / (greatest({vnorm(a)}, 1e-12) * greatest({vnorm(b)}, 1e-12)))"


_WIN = "PARTITION BY conversation_id ORDER BY turn_id"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "turns": ((), """
        SELECT conv_id AS conversation_id, turn AS turn_id, role AS agent, text AS message
        FROM conversations"""),
    "keyed_turns": (("turns",), """
        SELECT *, 't' || CAST((turn_id + conversation_id % 3) // 3 AS VARCHAR) AS knowledge_source
        FROM turns"""),
    "topic_turns": (("keyed_turns",), f"""
        SELECT conversation_id, turn_id, agent, message, knowledge_source, topic_shift,
               CAST(sum(topic_shift) OVER ({_WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1
                    AS BIGINT) AS sub_conversation_id
        FROM (SELECT *, CASE WHEN lag(turn_id) OVER ({_WIN}) IS NULL THEN 1
                             WHEN knowledge_source IS DISTINCT FROM lag(knowledge_source) OVER ({_WIN})
                             THEN 1 ELSE 0 END AS topic_shift
              FROM keyed_turns)"""),
    "emb_turns": ((), f"""
        SELECT conversation_id, turn_id, embedding, knowledge_source, topic_shift,
               CAST(sum(topic_shift) OVER ({_WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1
                    AS BIGINT) AS sub_conversation_id
        FROM (SELECT *, CASE WHEN lag(turn_id) OVER ({_WIN}) IS NULL THEN 1
                             WHEN knowledge_source IS DISTINCT FROM lag(knowledge_source) OVER ({_WIN})
                             THEN 1 ELSE 0 END AS topic_shift
              FROM (SELECT vec_id // 10 AS conversation_id, vec_id % 10 AS turn_id, embedding,
                           CASE WHEN label >= 9 THEN 'hi' ELSE 'lo' END AS knowledge_source
                    FROM embeddings))"""),
    "event_turns": ((), f"""
        SELECT conversation_id, turn_id, message, knowledge_source, agent, topic_shift,
               CAST(sum(topic_shift) OVER ({_WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1
                    AS BIGINT) AS sub_conversation_id
        FROM (SELECT *, CASE WHEN lag(turn_id) OVER ({_WIN}) IS NULL THEN 1
                             WHEN knowledge_source IS DISTINCT FROM lag(knowledge_source) OVER ({_WIN})
                             THEN 1 ELSE 0 END AS topic_shift
              FROM (SELECT user_id AS conversation_id,
                           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS turn_id,
                           props AS message, event_type AS knowledge_source,
                           CASE WHEN value < 10 THEN 'low' ELSE 'high' END AS agent
                    FROM events))"""),
    "blobs": (("turns",), """
        SELECT conversation_id,
               string_agg(CASE WHEN turn_id % 2 = 0 THEN 'User 1' ELSE 'User 2' END || ': ' || message,
                          chr(10) ORDER BY turn_id) AS best_generated_conversation
        FROM turns GROUP BY conversation_id"""),
    "doc_turns": ((), """
        SELECT conversation_id, CAST(turn_id AS BIGINT) AS turn_id, message
        FROM (SELECT doc_id AS conversation_id, generate_subscripts(parts, 1) - 1 AS turn_id,
                     unnest(parts) AS message
              FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""),
    "doc_topic_turns": (("doc_turns",), f"""
        SELECT conversation_id, turn_id, message, knowledge_source, topic_shift,
               CAST(sum(topic_shift) OVER ({_WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1
                    AS BIGINT) AS sub_conversation_id
        FROM (SELECT *, CASE WHEN lag(turn_id) OVER ({_WIN}) IS NULL THEN 1
                             WHEN knowledge_source IS DISTINCT FROM lag(knowledge_source) OVER ({_WIN})
                             THEN 1 ELSE 0 END AS topic_shift
              FROM (SELECT *, 'p' || CAST(turn_id // 8 AS VARCHAR) AS knowledge_source FROM doc_turns))"""),
    "preds": (("topic_turns",), f"""
        SELECT *, CASE WHEN overlap_prev IS NULL THEN 1 WHEN overlap_prev < 0.03 THEN 1 ELSE 0 END
                  AS pred_shift
        FROM (SELECT *, CASE WHEN lag(turn_id) OVER ({_WIN}) IS NULL THEN NULL
                             ELSE {kw_overlap(f'lag(message) OVER ({_WIN})', 'message')} END AS overlap_prev
              FROM topic_turns)"""),
    "logits": (("emb_turns",), """
        SELECT conversation_id, turn_id, topic_shift AS label,
               4.0 * CAST(embedding[1] AS DOUBLE) AS logit0,
               4.0 * CAST(embedding[2] AS DOUBLE) AS logit1
        FROM emb_turns"""),
}


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in VIEWS[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def sql(views, body: str, extra: dict[str, str] | str | None = None) -> str:
    """``WITH <views in dependency order>, <extra ctes> <body>``.

    ``extra`` is a dict of CTE name to body, or raw ``name AS (...), ...`` text.
    """
    ctes = [f"{n} AS ({VIEWS[n][1]})" for n in _order(views)]
    if isinstance(extra, str):
        ctes.append(extra.strip())
    else:
        ctes += [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
