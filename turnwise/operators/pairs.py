"""Contrastive training pairs (J5-J9): partner counts and drawn pairs.

Every turn is an anchor with a set of partners in its conversation:

==========================  ==========================================================
family                      partners of anchor ``a`` (same conversation)
==========================  ==========================================================
``coherence_positive`` J5   same segment, later position (``turn_id > a.turn_id``)
``coherence_negative`` J6   turns of segments that appear first *after* a's segment
``shift_positive``     J7   same segment, message text different from a's
``shift_negative``     J8   ``turn_id > a.turn_id`` and ``topic_shift = 1``
==========================  ==========================================================

All pairs grow with the square of a conversation's length.  Here the partners of an anchor are
ranks ``0 .. n_pairs - 1`` of an order in which they follow each other, so that their number needs
no pairing, and ``per_anchor`` of them are drawn as ranks: a seeded permutation of the ranks,
evaluated at ``0, 1, ...`` (:func:`permuted`), gives distinct partners without listing any.  Where
a conversation lies in one block of turns, partners meet inside the block, by windows over the
stored order; elsewhere an equi-join on (conversation, segment, place) fetches them.  ``per_anchor`` at least
``n_pairs`` gives every pair.

Counts and places come from block-wise scans; no join or window is keyed by a conversation alone.
Turns whose message is null are no J7 partners and have none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import portable_hash
from ..plans.positions import with_group_rank
from ..plans.scan import BLOCK, block_of, hand_back, ordered_scan
from .segment import keep

CONV, SEG, TURN = "conversation_id", "sub_conversation_id", "turn_id"
ROUNDS = 8  # of the permutation

# Family names and the partner rule of each family.
RULES = {
    "coherence_positive": "same segment, later turn",
    "coherence_negative": "segment first seen after the segment of the anchor",
    "shift_positive": "same segment, different message",
    "shift_negative": "later turn with topic_shift = 1",
}
LABELS = {"coherence_positive": "positive", "coherence_negative": "negative",
          "shift_positive": "positive", "shift_negative": "negative"}


def rounds_of(key: list[Column], rounds: int = ROUNDS) -> Column:
    """What the rounds of a key's permutation have in common for all values: a start and a ``k`` a round.

    As a column of the anchor it is hashed once, for all its draws."""
    at = F.array(*[portable_hash(*key, F.lit(r), F.lit("k")) for r in range(1, rounds + 1)])
    return F.struct(F.concat_ws("|", *key).alias("key"), portable_hash(*key, F.lit("start")).alias("start"), at.alias("k"))


def permuted(i: Column, n: Column, key: list[Column], rounds: int = ROUNDS, made: Column | None = None) -> Column:
    """The value at ``i`` of a seeded permutation of ``0 .. n - 1``, for any ``n``.

    A rotation, then rounds of swap-or-not: in each, ``x`` and ``k - x`` (mod ``n``) change places
    or stay, by a bit that both of them see.  ``made``: :func:`rounds_of` of the key, if it is a column.
    """
    n, m = n.cast("long"), rounds_of(key, rounds) if made is None else made
    start = (i.cast("long") + m["start"] % n) % n

    def swap(x, r):
        other = F.pmod(r["k"] - x, n)
        # The last bit of ``portable_hash(*key, r, larger)``, read from its last digit.
        digit = F.substring(F.md5(F.concat_ws("|", r["key"], r["r"], F.greatest(x, other).cast("string"))), 8, 1)
        return F.when(digit.isin(*"13579bdf"), other).otherwise(x)

    each = F.transform(m["k"], lambda k, r: F.struct(k.alias("k"), (r + 1).cast("string").alias("r"), m["key"].alias("key")))
    return F.aggregate(each, start, swap)


def segment_order(df: DataFrame) -> DataFrame:
    """Segments with their length and first-appearance order inside the conversation.

    Returns ``(conv, seg, first_turn, seg_len, cum_len, conv_len)`` where
    ``cum_len`` counts the turns of this segment and all segments first seen
    before it.
    """
    s = df.groupBy(CONV, SEG).agg(F.min(TURN).alias("first_turn"), F.count(F.lit(1)).alias("seg_len"))
    return ordered_scan(s, [CONV], "first_turn", sums={"cum_len": "seg_len"}, totals={"conv_len": "seg_len"})


# A family's table has ``n_pairs`` and ``_base``: a row's partner of rank r stands at place ``_base + r``
# (J7: plus the places of its own message, if it is not before them).  ``_place`` is the row's own
# place among the partners, null if it is none.  Places count by the keys that come with the table.

def _coherence_positive(df: DataFrame, message: str | None) -> tuple[DataFrame, list[str]]:
    base = keep(df, CONV, SEG, TURN, *([message] if message else []))
    d = ordered_scan(base, [CONV, SEG], TURN, sums={"_r": F.lit(1)}, totals={"_len": F.lit(1)})
    d = d.withColumn("n_pairs", F.col("_len") - F.col("_r")).withColumn("_base", F.col("_r")).withColumn("_place", F.col("_r") - 1)
    return d, [CONV, SEG]


def _coherence_negative(df: DataFrame, message: str | None) -> tuple[DataFrame, list[str]]:
    base = keep(df, CONV, SEG, TURN, *([message] if message else []))
    s = segment_order(df).select(CONV, SEG, (F.col("conv_len") - F.col("cum_len")).alias("n_pairs"), F.col("cum_len").alias("_base"),
                                 (F.col("cum_len") - F.col("seg_len")).alias("_before"))
    if not message:
        return hand_back(base, [CONV, SEG], TURN, s, ["n_pairs"]), [CONV]
    d = ordered_scan(base, [CONV, SEG], TURN, sums={"_r": F.lit(1)})
    d = hand_back(d, [CONV, SEG], TURN, s, ["n_pairs", "_base", "_before"]).withColumn("_place", F.col("_before") + F.col("_r") - 1)
    return d, [CONV]


def _runs_inside(df: DataFrame, message: str) -> DataFrame:
    """J7 where no segment leaves its block: windows over the rows as they are laid out."""
    d = df.where(F.col(message).isNotNull()).select(CONV, SEG, TURN, BLOCK, message)
    group = Window.partitionBy(CONV, BLOCK, SEG)
    alike, upto = group.orderBy(message), (Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_place", F.row_number().over(group.orderBy(message, TURN)).cast("long") - 1)
    d = d.select("*", F.rank().over(alike).cast("long").alias("_lo"), F.count(F.lit(1)).over(alike.rangeBetween(*upto)).alias("_hi"))
    # as a join by segment would have it, the rows without one have no partners
    d = d.withColumn("_len", F.when(F.col(SEG).isNull(), 0).otherwise(F.count(F.lit(1)).over(group)))
    return d.withColumn("_lo", F.col("_lo") - 1).withColumn("_hi", F.col("_hi") - 1)


def _runs_across(df: DataFrame, message: str) -> DataFrame:
    """J7 where a segment may reach over many blocks: ranks from a sort of the whole table, scanned in blocks."""
    said = with_group_rank(df.where(F.col(message).isNotNull()).select(CONV, SEG, TURN, message), [CONV, SEG], [F.col(message), F.col(TURN)], "_place")
    d = ordered_scan(said, [CONV, SEG], "_place", prev=[message], nxt=[message], totals={"_len": F.lit(1)}, prev_prefix="_p_", next_prefix="_n_")
    first = F.when(~F.col(message).eqNullSafe(F.col("_p_" + message)), F.col("_place"))
    final = F.when(~F.col(message).eqNullSafe(F.col("_n_" + message)), F.col("_place"))
    return ordered_scan(d, [CONV, SEG], "_place", last={"_lo": first}, coming={"_hi": final})


def _shift_positive(df: DataFrame, message: str, inside: bool) -> tuple[DataFrame, list[str]]:
    d = (_runs_inside if inside else _runs_across)(df, message)
    d = d.withColumn("_same", F.col("_hi") - F.col("_lo") + 1).withColumn("n_pairs", F.col("_len") - F.col("_same")).withColumn("_base", F.lit(0).cast("long"))
    return d, [CONV, SEG]


def _shift_negative(df: DataFrame, message: str | None, shift: str = "topic_shift") -> tuple[DataFrame, list[str]]:
    base = keep(df, CONV, SEG, TURN, F.when(F.col(shift) == 1, 1).otherwise(0).alias("_s"), *([message] if message else []))
    d = ordered_scan(base, [CONV], TURN, sums={"_run": "_s"}, totals={"_tot": "_s"})
    d = d.withColumn("n_pairs", F.col("_tot") - F.col("_run")).withColumn("_base", F.col("_run"))
    return d.withColumn("_place", F.when(F.col("_s") == 1, F.col("_run") - 1)), [CONV]


def by_reach(df: DataFrame) -> list[tuple[DataFrame, bool]]:
    """``df`` with its block column, in parts: conversations inside one block (True), and the others (False).

    The first need no rows but those of their block, which lie together.  Rows without a
    conversation or a turn go with the others, as does all that no block row is found for.
    """
    d = df if BLOCK in df.columns else df.withColumn(BLOCK, block_of(df, TURN))
    blocks = d.select(CONV, BLOCK).distinct()
    many = F.count(F.lit(1)).over(Window.partitionBy(CONV)) > 1
    blocks = blocks.select(CONV, BLOCK, (many | F.col(CONV).isNull() | F.col(BLOCK).isNull()).alias("_tw_far"))
    if blocks.where("_tw_far").isEmpty():
        return [(d, True)]
    d = d.join(blocks, [CONV, BLOCK], "left").withColumn("_tw_far", F.coalesce("_tw_far", F.lit(True)))
    return [(d.where(F.col("_tw_far") == far).drop("_tw_far"), not far) for far in (False, True)]


def _finish(d: DataFrame, family: str) -> DataFrame:
    return d.select(CONV, SEG, TURN, F.lit(family).alias("family"),
                    F.lit(RULES[family]).alias("rule"), F.col("n_pairs").cast("long").alias("n_pairs"))


def coherence_positive(df: DataFrame) -> DataFrame:
    """Per anchor, the number of later turns in its segment."""
    return _finish(_coherence_positive(df, None)[0], "coherence_positive")


def coherence_negative(df: DataFrame) -> DataFrame:
    """Per anchor, the number of turns in segments first seen after its segment."""
    return _finish(_coherence_negative(df, None)[0], "coherence_negative")


def shift_positive(df: DataFrame, message: str = "message") -> DataFrame:
    """Per anchor, the other turns of its segment whose text differs from the anchor's."""
    d = reduce(DataFrame.unionByName, [_shift_positive(d, message, inside)[0].select(CONV, SEG, TURN, "n_pairs") for d, inside in by_reach(df)])
    silent = df.where(F.col(message).isNull()).select(CONV, SEG, TURN, F.lit(0).cast("long").alias("n_pairs"))
    return _finish(d.unionByName(silent), "shift_positive")


def shift_negative(df: DataFrame, shift: str = "topic_shift") -> DataFrame:
    """Per anchor, the later turns of its conversation that open a shift."""
    return _finish(_shift_negative(df, None, shift)[0], "shift_negative")


def drawn_pairs(df: DataFrame, family: str, per_anchor: int, seed: int = 42, message: str = "message") -> DataFrame:
    """``min(per_anchor, n_pairs)`` distinct partners of every anchor, with both messages.

    Returns ``conversation_id, sub_conversation_id, turn_id, draw, partner_turn_id, message1, message2,
    family, label``, one row per pair.
    """
    made = {"coherence_positive": _coherence_positive, "coherence_negative": _coherence_negative,
            "shift_positive": _shift_positive, "shift_negative": _shift_negative}[family]
    return reduce(DataFrame.unionByName, [
        _fetched(*(made(d, message, inside) if family == "shift_positive" else made(d, message)), inside, family, per_anchor, seed, message)
        for d, inside in by_reach(df)])


def _fetched(d: DataFrame, keys: list[str], inside: bool, family: str, per_anchor: int, seed: int, message: str) -> DataFrame:
    """The drawn partners of a family's table (``inside``: of conversations that lie in one block)."""
    key = [F.lit(str(seed)), F.lit(family), F.col(CONV), F.col(SEG), F.col(TURN)]
    # Without a partner there is no draw; elsewhere the hashes are made once an anchor, for all draws.
    d = d.withColumn("_made", F.when(F.col("n_pairs") > 0, rounds_of(key)))

    def place(i):
        at = F.col("_base") + permuted(i, F.col("n_pairs"), key, made=F.col("_made"))
        if family != "shift_positive":
            return at
        return F.when(at >= F.col("_lo"), at + F.col("_same")).otherwise(at)  # the run of the anchor's own message is left out of the ranks

    draws = F.sequence(F.lit(0).cast("long"), F.least(F.lit(per_anchor).cast("long"), F.col("n_pairs")) - 1)
    asked = F.when(F.col("n_pairs") > 0, F.transform(draws, lambda i: F.struct(place(i).cast("long").alias("at"), i.alias("draw"))))
    pair = [F.lit(family).alias("family"), F.lit(LABELS[family]).alias("label")]
    if not inside:
        a = d.where("n_pairs > 0").select(CONV, SEG, TURN, F.col(message).alias("message1"), F.inline(asked)).withColumnRenamed("at", "_place")
        b = d.where(F.col("_place").isNotNull()).select(*keys, "_place", F.col(TURN).alias("partner_turn_id"), F.col(message).alias("message2"))
        return a.join(b, [*keys, "_place"]).select(CONV, SEG, TURN, "draw", "partner_turn_id", "message1", "message2", *pair)
    # A row stands at its own place (no draw) and at the places it asks for, where the row of the
    # place comes first.  All that happens inside a block, so no message is moved.
    own = F.array(F.struct(F.col("_place").cast("long").alias("at"), F.lit(None).cast("long").alias("draw")))
    own = F.when(F.col("_place").isNotNull(), own).otherwise(F.slice(own, 1, 0))
    rows = d.select(CONV, SEG, TURN, BLOCK, F.col(message).alias("message1"), F.inline(F.concat(own, F.coalesce(asked, F.slice(own, 1, 0)))))
    there = Window.partitionBy(CONV, BLOCK, *keys[1:], "at").orderBy(F.col("draw").asc_nulls_first())
    partner = F.first(F.when(F.col("draw").isNull(), F.struct(F.col(TURN).alias("t"), F.col("message1").alias("m")))) \
        .over(there.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_with", partner).where(F.col("draw").isNotNull() & F.col("_with").isNotNull())
    return rows.select(CONV, SEG, TURN, "draw", F.col("_with.t").alias("partner_turn_id"), "message1", F.col("_with.m").alias("message2"), *pair)


def contrastive_pairs(df: DataFrame, kind: str, per_anchor: int, seed: int = 42, message: str = "message") -> DataFrame:
    """J9 over drawn pairs: the positives and negatives of ``kind`` (``coherence`` or ``shift``)."""
    return drawn_pairs(df, f"{kind}_positive", per_anchor, seed, message) \
        .unionByName(drawn_pairs(df, f"{kind}_negative", per_anchor, seed, message))


def label_pairs(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Positives labelled 'positive', negatives 'negative', in one table."""
    return positive.withColumn("label", F.lit("positive")) \
                   .unionByName(negative.withColumn("label", F.lit("negative")))


def coherence_pairs(df: DataFrame) -> DataFrame:
    """J5 + J6 labelled (J9), from one pass over the turns and one over the segments."""
    s = segment_order(df).select(CONV, SEG, (F.col("conv_len") - F.col("cum_len")).alias("_neg"), "seg_len")
    d = ordered_scan(keep(df, CONV, SEG, TURN), [CONV, SEG], TURN, sums={"_r": F.lit(1)})
    d = hand_back(d, [CONV, SEG], TURN, s, ["_neg", "seg_len"])
    each = [F.struct(F.lit(f).alias("family"), F.lit(RULES[f]).alias("rule"), n.cast("long").alias("n_pairs"), F.lit(LABELS[f]).alias("label"))
            for f, n in (("coherence_positive", F.col("seg_len") - F.col("_r")), ("coherence_negative", F.col("_neg")))]
    return d.select(CONV, SEG, TURN, F.inline(F.array(*each)))


def shift_aware_pairs(df: DataFrame) -> DataFrame:
    """J7 + J8 labelled."""
    return label_pairs(shift_positive(df), shift_negative(df))


def pair_totals(spec: DataFrame) -> DataFrame:
    """Pairs per family and label (what the reference prints as value counts)."""
    return spec.groupBy("family", "label").agg(F.sum("n_pairs").alias("n_pairs"),
                                              F.count(F.lit(1)).alias("n_anchors"))
