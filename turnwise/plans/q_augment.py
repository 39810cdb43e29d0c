"""Queries for synthetic conversations, sampling and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import augment, profile
from ..sources import fixtures as fx
from .catalog import r6, register
from .oracle import phash, sql

SEED = 42
PER_CONV = 2


def _h(tag: str) -> str:
    return phash(f"'{SEED}'", "sample", f"'{tag}'")


_STITCH = f"""
    conv AS (SELECT conversation_id, row_number() OVER (ORDER BY conversation_id) - 1 AS crank
             FROM (SELECT DISTINCT conversation_id FROM topic_turns)),
    cc AS (SELECT count(*) AS c FROM conv),
    mx AS (SELECT max(conversation_id) AS maxid FROM topic_turns),
    segs AS (SELECT s.*, c.crank,
                    row_number() OVER (PARTITION BY s.conversation_id ORDER BY s.first_turn) - 1 AS seg_index,
                    count(*) OVER (PARTITION BY s.conversation_id) AS n_seg
             FROM (SELECT conversation_id, sub_conversation_id, count(*) AS seg_len, min(turn_id) AS first_turn
                   FROM topic_turns GROUP BY ALL) s JOIN conv c USING (conversation_id)),
    samples AS (SELECT crank * {PER_CONV} + j AS sample FROM conv CROSS JOIN range({PER_CONV}) t(j)),
    p1 AS (SELECT sample, {_h('a')} % c AS ra, {_h('b')} AS hbb, 2 * (1 + {_h('la')} % 3) AS la,
                  2 * (1 + {_h('lb')} % 3) AS lb, {_h('sa')} AS ha, {_h('sb')} AS hb, c
           FROM samples CROSS JOIN cc),
    picks AS (SELECT *, (ra + 1 + hbb % (c - 1)) % c AS rb FROM p1),
    pk AS (SELECT p.sample, sa.conversation_id AS conva, sa.sub_conversation_id AS sega, sa.seg_len AS lena,
                  sb.conversation_id AS convb, sb.sub_conversation_id AS segb, sb.seg_len AS lenb, p.la, p.lb
           FROM picks p
           JOIN segs sa ON sa.crank = p.ra AND sa.seg_index = p.ha % sa.n_seg
           JOIN segs sb ON sb.crank = p.rb AND sb.seg_index = p.hb % sb.n_seg
           WHERE sa.seg_len >= 2 AND sb.seg_len >= 2),
    kept AS (SELECT *, least(la, lena - lena % 2) AS ka, least(lb, lenb - lenb % 2) AS kb,
                    (SELECT maxid FROM mx) + row_number() OVER (ORDER BY sample) AS new_id FROM pk),
    head AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, sub_conversation_id ORDER BY turn_id)
                       AS rk FROM topic_turns),
    synth AS (
      SELECT k.new_id AS conversation_id, CAST(0 AS BIGINT) AS sub_conversation_id,
             CAST(h.rk AS BIGINT) AS turn_id, h.message, h.topic_shift,
             h.conversation_id AS source_conversation_id, h.turn_id AS source_turn_id
      FROM kept k JOIN head h ON h.conversation_id = k.conva AND h.sub_conversation_id = k.sega
                              AND h.rk <= k.ka
      UNION ALL
      SELECT k.new_id, CAST(1 AS BIGINT), CAST(k.ka + h.rk AS BIGINT), h.message,
             CASE WHEN h.rk = 1 THEN 1 ELSE h.topic_shift END, h.conversation_id, h.turn_id
      FROM kept k JOIN head h ON h.conversation_id = k.convb AND h.sub_conversation_id = k.segb
                              AND h.rk <= k.kb)"""


@register("g1_stitch", sql(["topic_turns"], "SELECT * FROM synth", _STITCH))
def g1_stitch(spark, sf_dir):
    return augment.stitch(fx.topic_turns(spark, sf_dir), per_conversation=PER_CONV, seed=SEED)


@register("g2_augment_balance", sql(["topic_turns"], """
    SELECT 'before' AS stage, count(*) AS rows, CAST(sum(topic_shift) AS BIGINT) AS positives,
           round(avg(topic_shift), 6) AS positive_share FROM topic_turns
    UNION ALL
    SELECT 'after', count(*), CAST(sum(topic_shift) AS BIGINT), round(avg(topic_shift), 6) FROM (
      SELECT topic_shift FROM topic_turns UNION ALL SELECT topic_shift FROM synth)""", _STITCH))
def g2_augment_balance(spark, sf_dir):
    """Positive share before and after appending the synthetic conversations."""
    t = fx.topic_turns(spark, sf_dir)
    aug = augment.augment(t.select("conversation_id", "sub_conversation_id", "turn_id", "message",
                                   "topic_shift"),
                          augment.stitch(t, per_conversation=PER_CONV, seed=SEED))
    out = None
    for stage, d in (("before", t), ("after", aug)):
        b = profile.class_balance(d).select(F.lit(stage).alias("stage"), "rows", "positives",
                                            r6("positive_share").alias("positive_share"))
        out = b if out is None else out.unionByName(b)
    return out


def _hk(*cols) -> str:
    return phash(f"'{SEED}'", *cols)


@register("g3_sample_per_class", sql(["topic_turns"], f"""
    SELECT conversation_id, turn_id, topic_shift FROM (
      SELECT *, row_number() OVER (PARTITION BY topic_shift
                                   ORDER BY {_hk('conversation_id', 'turn_id')}, conversation_id, turn_id) AS rn
      FROM topic_turns) WHERE rn <= 100"""))
def g3_sample_per_class(spark, sf_dir):
    t = fx.topic_turns(spark, sf_dir).select("conversation_id", "turn_id", "topic_shift")
    return augment.sample_per_class(t, "topic_shift", 100, ["conversation_id", "turn_id"], SEED)


@register("g4_split_rows", sql(["topic_turns"], f"""
    SELECT conversation_id, turn_id,
           CASE WHEN row_number() OVER (ORDER BY {_hk('conversation_id', 'turn_id')}, conversation_id, turn_id) - 1
                     < floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split
    FROM topic_turns"""))
def g4_split_rows(spark, sf_dir):
    t = fx.topic_turns(spark, sf_dir).select("conversation_id", "turn_id")
    return augment.split_rows(t, 0.8, ["conversation_id", "turn_id"], SEED, exact=True)


@register("g4_split_rows_hash", sql(["topic_turns"], f"""
    SELECT conversation_id, turn_id,
           CASE WHEN {_hk('conversation_id', 'turn_id')} < {int(0.8 * (1 << 32))} THEN 'train' ELSE 'test' END
             AS split
    FROM topic_turns"""))
def g4_split_rows_hash(spark, sf_dir):
    t = fx.topic_turns(spark, sf_dir).select("conversation_id", "turn_id")
    return augment.split_rows(t, 0.8, ["conversation_id", "turn_id"], SEED, exact=False)


@register("g5_split_conversations", sql(["topic_turns"], f"""
    SELECT conversation_id, turn_id,
           CASE WHEN {_hk('conversation_id')} < {int(0.8 * (1 << 32))} THEN 'train' ELSE 'test' END AS split
    FROM topic_turns"""))
def g5_split_conversations(spark, sf_dir):
    t = fx.topic_turns(spark, sf_dir).select("conversation_id", "turn_id")
    return augment.split_conversations(t, 0.8, SEED)
