"""Queries for contrastive pair specifications (J5-J9) and the pair sink.

The oracle counts partners by brute force (a self-join per anchor), which
checks the linear formulation against the quadratic definition.
"""

from __future__ import annotations

from ..operators import pairs
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import readers, sinks
from .catalog import register
from .oracle import sql

R = pairs.RULES


def _sel(family: str) -> str:
    return (f"a.conversation_id, a.sub_conversation_id, a.turn_id, '{family}' AS family, "
            f"'{R[family]}' AS rule, count(b.turn_id) AS n_pairs")


_J5 = f"""
    SELECT {_sel('coherence_positive')} FROM {{t}} a LEFT JOIN {{t}} b
      ON a.conversation_id = b.conversation_id AND a.sub_conversation_id = b.sub_conversation_id
     AND b.turn_id > a.turn_id
    GROUP BY ALL"""

_SEGRANK = """
    segrank AS (SELECT conversation_id, sub_conversation_id,
                       row_number() OVER (PARTITION BY conversation_id ORDER BY min(turn_id)) AS sr
                FROM {t} GROUP BY conversation_id, sub_conversation_id),
    ranked AS (SELECT t.*, s.sr FROM {t} t JOIN segrank s USING (conversation_id, sub_conversation_id))"""

_J6 = f"""
    SELECT {_sel('coherence_negative')} FROM ranked a LEFT JOIN ranked b
      ON a.conversation_id = b.conversation_id AND b.sr > a.sr
    GROUP BY ALL"""

_J7 = f"""
    SELECT {_sel('shift_positive')} FROM {{t}} a LEFT JOIN {{t}} b
      ON a.conversation_id = b.conversation_id AND a.sub_conversation_id = b.sub_conversation_id
     AND b.message <> a.message
    GROUP BY ALL"""

_J8 = f"""
    SELECT {_sel('shift_negative')} FROM {{t}} a LEFT JOIN {{t}} b
      ON a.conversation_id = b.conversation_id AND b.turn_id > a.turn_id AND b.topic_shift = 1
    GROUP BY ALL"""


@register("j5_coherence_positive", sql(["topic_turns"], _J5.format(t="topic_turns")))
def j5_coherence_positive(spark, sf_dir):
    return pairs.coherence_positive(fx.topic_turns(spark, sf_dir))


@register("j6_coherence_negative", sql(["topic_turns"], _J6, _SEGRANK.format(t="topic_turns")))
def j6_coherence_negative(spark, sf_dir):
    return pairs.coherence_negative(fx.topic_turns(spark, sf_dir))


@register("j7_shift_positive", sql(["doc_topic_turns"], _J7.format(t="doc_topic_turns")))
def j7_shift_positive(spark, sf_dir):
    """Document lines in blocks of eight: repeated lines are not paired with each other."""
    return pairs.shift_positive(fx.doc_topic_turns(spark, sf_dir))


@register("j8_shift_negative", sql(["topic_turns"], _J8.format(t="topic_turns")))
def j8_shift_negative(spark, sf_dir):
    return pairs.shift_negative(fx.topic_turns(spark, sf_dir))


_TOTALS = """
    SELECT family, label, CAST(sum(n_pairs) AS BIGINT) AS n_pairs, count(*) AS n_anchors FROM (
      SELECT family, 'positive' AS label, n_pairs FROM ({pos})
      UNION ALL SELECT family, 'negative', n_pairs FROM ({neg}))
    GROUP BY family, label"""


@register("j9_label_pairs", sql(["event_turns"], _TOTALS.format(
    pos=_J5.format(t="event_turns"), neg=_J6), _SEGRANK.format(t="event_turns")))
def j9_label_pairs(spark, sf_dir):
    """Coherence pairs of the event conversations, labelled and totalled (J5 + J6 + J9)."""
    return pairs.pair_totals(pairs.coherence_pairs(fx.event_turns(spark, sf_dir)))


@register("j9_shift_aware_totals", sql(["doc_topic_turns"], _TOTALS.format(
    pos=_J7.format(t="doc_topic_turns"), neg=_J8.format(t="doc_topic_turns"))))
def j9_shift_aware_totals(spark, sf_dir):
    return pairs.pair_totals(pairs.shift_aware_pairs(fx.doc_topic_turns(spark, sf_dir)))


_SPEC_SCHEMA = ("conversation_id bigint, sub_conversation_id bigint, turn_id bigint, family string, "
                "rule string, n_pairs bigint, label string")


@register("s8_save_pairs", sql(["topic_turns"], f"""
    SELECT *, 'positive' AS label FROM ({_J5.format(t='topic_turns')})
    UNION ALL SELECT *, 'negative' FROM ({_J6})""", _SEGRANK.format(t="topic_turns")))
def s8_save_pairs(spark, sf_dir):
    """Labelled coherence pair specs written as CSV (S8) and read back (S3)."""
    spec = pairs.coherence_pairs(fx.topic_turns(spark, sf_dir))
    path = scratch_path(spark, "pairs")
    sinks.save_pairs(spec, path, "csv")
    return readers.read_turns_csv(spark, path, _SPEC_SCHEMA)


# Drawn pairs: the SQL lists all partners of an anchor in order, repeats the permutation of their
# ranks and keeps the drawn ones.
PER_ANCHOR, PAIR_SEED = 3, 42


def _drawn(partners: str) -> str:
    """``partners``: all pairs as (conv, seg, turn, family, label, message1, partner, message2, rank)."""
    key = f"'{PAIR_SEED}|' || family || '|' || conversation_id || '|' || sub_conversation_id || '|' || turn_id"

    def h(*more: str) -> str:
        return "CAST(('0x' || substr(md5(" + " || '|' || ".join([key, *more]) + "), 1, 8)) AS BIGINT)"

    other = f"((({h('r', chr(39) + 'k' + chr(39))} - x) % n + n) % n)"
    perm = (f"list_reduce(list_prepend((i + {h(chr(39) + 'start' + chr(39))} % n) % n, range(1, {pairs.ROUNDS + 1})), "
            f"lambda x, r: CASE WHEN {h('r', f'greatest(x, {other})')} % 2 = 1 THEN {other} ELSE x END)")
    return f"""
    SELECT conversation_id, sub_conversation_id, turn_id, draw, partner_turn_id, message1, message2, family, label
    FROM ({partners}) JOIN (
      SELECT conversation_id, sub_conversation_id, turn_id, family, i AS draw, {perm} AS rank
      FROM (SELECT *, unnest(range(0, least({PER_ANCHOR}, n))) AS i
            FROM (SELECT conversation_id, sub_conversation_id, turn_id, family, count(*) AS n FROM ({partners}) GROUP BY ALL))) USING (conversation_id, sub_conversation_id, turn_id, family, rank)"""


def _listed(family: str, table: str, on: str, order: str) -> str:
    return f"""
    SELECT a.conversation_id, a.sub_conversation_id, a.turn_id, '{family}' AS family, '{pairs.LABELS[family]}' AS label,
           a.message AS message1, b.turn_id AS partner_turn_id, b.message AS message2,
           row_number() OVER (PARTITION BY a.conversation_id, a.sub_conversation_id, a.turn_id ORDER BY {order}) - 1 AS rank
    FROM {table} a JOIN {table} b ON a.conversation_id = b.conversation_id AND {on}"""


_L5 = _listed("coherence_positive", "topic_turns", "a.sub_conversation_id = b.sub_conversation_id AND b.turn_id > a.turn_id", "b.turn_id")
_L6 = _listed("coherence_negative", "ranked", "b.sr > a.sr", "b.sr, b.turn_id")
_L7 = _listed("shift_positive", "doc_topic_turns", "a.sub_conversation_id = b.sub_conversation_id AND b.message <> a.message", "b.message, b.turn_id")
_L8 = _listed("shift_negative", "topic_turns", "b.turn_id > a.turn_id AND b.topic_shift = 1", "b.turn_id")
_L8D = _listed("shift_negative", "doc_topic_turns", "b.turn_id > a.turn_id AND b.topic_shift = 1", "b.turn_id")


@register("j5_drawn_pairs", sql(["topic_turns"], _drawn(_L5)))
def j5_drawn_pairs(spark, sf_dir):
    """Up to three later turns of the segment for every turn, with both messages."""
    return pairs.drawn_pairs(fx.topic_turns(spark, sf_dir), "coherence_positive", PER_ANCHOR, PAIR_SEED)


@register("j6_drawn_pairs", sql(["topic_turns"], _drawn(_L6), _SEGRANK.format(t="topic_turns")))
def j6_drawn_pairs(spark, sf_dir):
    return pairs.drawn_pairs(fx.topic_turns(spark, sf_dir), "coherence_negative", PER_ANCHOR, PAIR_SEED)


@register("j7_drawn_pairs", sql(["doc_topic_turns"], _drawn(_L7)))
def j7_drawn_pairs(spark, sf_dir):
    """Document lines: repeats of the anchor's own line are never drawn."""
    return pairs.drawn_pairs(fx.doc_topic_turns(spark, sf_dir), "shift_positive", PER_ANCHOR, PAIR_SEED)


@register("j8_drawn_pairs", sql(["topic_turns"], _drawn(_L8)))
def j8_drawn_pairs(spark, sf_dir):
    return pairs.drawn_pairs(fx.topic_turns(spark, sf_dir), "shift_negative", PER_ANCHOR, PAIR_SEED)


@register("j9_contrastive_pairs", sql(["doc_topic_turns"], f"SELECT * FROM ({_drawn(_L7)}) UNION ALL SELECT * FROM ({_drawn(_L8D)})"))
def j9_contrastive_pairs(spark, sf_dir):
    """Shift-aware training pairs of document lines, labelled."""
    return pairs.contrastive_pairs(fx.doc_topic_turns(spark, sf_dir), "shift", PER_ANCHOR, PAIR_SEED)


@register("s8_save_message_pairs", sql(["topic_turns"], f"""
    SELECT message1, message2, label FROM ({_drawn(_L5)}) UNION ALL SELECT message1, message2, label FROM ({_drawn(_L6)})""",
                                       _SEGRANK.format(t="topic_turns")))
def s8_save_message_pairs(spark, sf_dir):
    """Coherence training pairs written as the sink's three columns (JSON lines) and read back."""
    made = pairs.contrastive_pairs(fx.topic_turns(spark, sf_dir), "coherence", PER_ANCHOR, PAIR_SEED)
    path = scratch_path(spark, "message-pairs")
    sinks.save_pairs(made.select("message1", "message2", "label"), path, "json")
    return spark.read.schema("message1 string, message2 string, label string").json(path)
