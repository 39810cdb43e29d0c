"""Synthetic conversations, sampling and splits.

Every random choice is a portable hash of ``(seed, sample id, tag)``: results
are the same under any partitioning and can be recomputed in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import portable_hash
from ..plans.positions import dense_rank_of, with_position
from ..plans.scan import BLOCK, ordered_scan
from ..session import cut_lineage
from .ids import attach_scalar
from .segment import keep

CONV, SEG, TURN = "conversation_id", "sub_conversation_id", "turn_id"
LENGTHS = (2, 4, 6)  # fixed values: how many turns a sample asks a segment for


def _segments(df: DataFrame) -> DataFrame:
    """(conv, seg, seg_len, seg_index, n_seg): segments in first-appearance order."""
    s = df.groupBy(CONV, SEG).agg(F.count(F.lit(1)).alias("seg_len"), F.min(TURN).alias("_first"))
    s = ordered_scan(s, [CONV], "_first", sums={"seg_index": F.lit(1)}, totals={"n_seg": F.lit(1)})
    return s.withColumn("seg_index", F.col("seg_index") - 1).drop("_first")


def stitch(df: DataFrame, per_conversation: int = 1, seed: int = 42, lengths: tuple = LENGTHS) -> DataFrame:
    """G1: synthetic conversations made of one segment of each of two conversations.

    ``per_conversation * C`` samples are drawn (C = number of conversations),
    so the output grows with the input.  Sample ``i`` picks conversation ranks
    ``a = h(i,'a') % C`` and ``b = (a + 1 + h(i,'b') % (C-1)) % C`` (always
    different), a segment of each (``h(i,'sa') % n_seg``), and one of ``lengths``
    for each (``h(i,'la')``).  A sample is dropped when either segment has
    fewer than 2 turns; an odd segment loses its last turn; each part keeps its
    first ``min(length, even part)`` turns.  Segments become 0 and 1, the first
    turn of the second gets ``topic_shift = 1``, turn ids run 1..n, and new
    conversation ids start at max + 1 and are dense over kept samples.
    """
    convs = dense_rank_of(df, [CONV], [CONV], "_crank")
    stats = convs.agg(F.count(F.lit(1)).alias("_C"))
    maxid = df.agg(F.max(CONV).cast("long").alias("_maxid"))
    samples = convs.select(F.explode(F.sequence(F.col("_crank") * per_conversation,
                                                F.col("_crank") * per_conversation + per_conversation - 1))
                           .alias("sample"))
    samples = attach_scalar(samples, stats).where("_C > 1")  # a single conversation has no partner
    h = lambda tag: portable_hash(F.lit(str(seed)), F.col("sample"), F.lit(tag))
    ra = h("a") % F.col("_C")
    samples = samples.withColumn("_ra", ra).withColumn(
        "_rb", (F.col("_ra") + 1 + h("b") % F.greatest(F.col("_C") - 1, F.lit(1))) % F.col("_C"))
    asked = lambda tag: F.get(F.array(*[F.lit(x) for x in lengths]), (h(tag) % len(lengths)).cast("int"))
    samples = samples.withColumn("_la", asked("la")).withColumn("_lb", asked("lb")) \
                     .withColumn("_ha", h("sa")).withColumn("_hb", h("sb"))
    segs = _segments(df)
    first = segs.where("seg_index = 0").select(CONV, "n_seg")  # one row per conversation
    conv_info = convs.join(first, CONV)

    def pick(j, tag):
        # conversation rank -> (conversation, number of segments): unique key
        ci = conv_info.select(F.col("_crank").alias(f"_r{tag}"), F.col(CONV).alias(f"_conv{tag}"),
                              F.col("n_seg").alias(f"_n{tag}"))
        j = j.join(ci, f"_r{tag}").withColumn(f"_idx{tag}", F.col(f"_h{tag}") % F.col(f"_n{tag}"))
        # (conversation, segment index) -> segment: unique key
        sg = segs.select(F.col(CONV).alias(f"_conv{tag}"), F.col("seg_index").alias(f"_idx{tag}"),
                         F.col(SEG).alias(f"_seg{tag}"), F.col("seg_len").alias(f"_len{tag}"))
        return j.join(sg, [f"_conv{tag}", f"_idx{tag}"])

    j = pick(pick(samples, "a"), "b")
    j = j.filter((F.col("_lena") >= 2) & (F.col("_lenb") >= 2))
    j = j.withColumn("_ka", F.least(F.col("_la"), F.col("_lena") - F.col("_lena") % 2)) \
         .withColumn("_kb", F.least(F.col("_lb"), F.col("_lenb") - F.col("_lenb") % 2))
    kept = with_position(j.select("sample", "_conva", "_sega", "_convb", "_segb", "_ka", "_kb"),
                         ["sample"], "_k")
    kept = attach_scalar(kept, maxid).withColumn("new_id", F.col("_maxid") + 1 + F.col("_k"))

    # no sample asks for more turns of a segment than the largest length
    head = ordered_scan(keep(df, CONV, SEG, TURN, "message", "topic_shift"), [CONV, SEG],
                        TURN, sums={"_rank": F.lit(1)}).filter(F.col("_rank") <= max(lengths))
    pa = kept.select("new_id", F.col("_conva").alias(CONV), F.col("_sega").alias(SEG), "_ka") \
        .join(head, [CONV, SEG]).filter(F.col("_rank") <= F.col("_ka")) \
        .select("new_id", F.lit(0).cast("long").alias("_s"), F.col("_rank").alias("_t"),
                "message", F.col("topic_shift").cast("int").alias("topic_shift"),
                F.col(CONV).alias("source_conversation_id"), F.col(TURN).alias("source_turn_id"))
    pb = kept.select("new_id", F.col("_convb").alias(CONV), F.col("_segb").alias(SEG), "_ka", "_kb") \
        .join(head, [CONV, SEG]).filter(F.col("_rank") <= F.col("_kb")) \
        .select("new_id", F.lit(1).cast("long").alias("_s"), (F.col("_ka") + F.col("_rank")).alias("_t"),
                "message", F.when(F.col("_rank") == 1, F.lit(1)).otherwise(F.col("topic_shift"))
                .cast("int").alias("topic_shift"),
                F.col(CONV).alias("source_conversation_id"), F.col(TURN).alias("source_turn_id"))
    out = pa.unionByName(pb)
    return out.select(F.col("new_id").cast("long").alias(CONV), F.col("_s").alias(SEG),
                      F.col("_t").cast("long").alias(TURN), "message", "topic_shift",
                      "source_conversation_id", "source_turn_id")


def augment(df: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Append synthetic rows (union by name)."""
    return df.drop(BLOCK).unionByName(synthetic, allowMissingColumns=True)


# Selection of the first rows by (hash, key) without sorting: a histogram of the hash's upper half
# finds, per class, the bucket in which the last selected row lies; a histogram of the hashes in that
# bucket finds the hash; only rows with that very hash are compared by key.
HALF = 1 << 16
BROADCAST_CLASSES = 100_000


def _small(t: DataFrame, classes: int) -> DataFrame:
    return F.broadcast(t) if classes <= BROADCAST_CLASSES else t


def _crossing(counts: DataFrame, part: list[str], bucket: str, want: Column) -> DataFrame:
    """Per class the bucket that holds the last wanted row: ``_tw_n`` rows, ``_tw_below`` before them."""
    w = (Window.partitionBy(*part) if part else Window)
    before = w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    every = w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = counts.withColumn("_tw_below", F.coalesce(F.sum("_tw_n").over(before), F.lit(0)) + F.col("_tw_start")) \
              .withColumn("_tw_all", F.sum("_tw_n").over(every)).withColumn("_tw_want", want)
    return c.where((F.col("_tw_below") < F.col("_tw_want")) & (F.col("_tw_below") + F.col("_tw_n") >= F.col("_tw_want")))


def first_by_hash(df: DataFrame, part: list[str], h: Column, key: list[str], want: Column, out: str) -> DataFrame:
    """Adds ``out``: whether a row is among the first ``want`` of its class in the order (``h``, key).

    ``h`` is a number below 2**32; ``want`` may use ``_tw_all``, the rows of the class.  Three passes
    over ``df`` and no exchange of its rows; what is exchanged are histograms of at most 65,536 rows
    a class.  Rows that share a hash are ranked by key; at most ``want`` of each task get there.
    """
    d = df.withColumn("_tw_h", h).withColumn("_tw_bucket", F.shiftright("_tw_h", 16))
    limit = F.least(want.cast("long"), F.col("_tw_all"))
    counts = d.groupBy(*part, "_tw_bucket").agg(F.count(F.lit(1)).alias("_tw_n")).withColumn("_tw_start", F.lit(0).cast("long"))
    top = cut_lineage(_crossing(counts, part, "_tw_bucket", limit)
                      .select(*[F.col(c).alias(f"_tw_k{i}") for i, c in enumerate(part)], F.col("_tw_bucket").alias("_tw_at"),
                              F.col("_tw_below").alias("_tw_start"), F.col("_tw_want").alias("_tw_limit")))
    classes = top.count()
    same = F.lit(True)
    for i, c in enumerate(part):
        same = same & F.col(c).eqNullSafe(F.col(f"_tw_k{i}"))
    inner = d.join(_small(top, classes), same & (F.col("_tw_bucket") == F.col("_tw_at")))
    counts = inner.groupBy(*part, "_tw_h", "_tw_start", "_tw_limit").agg(F.count(F.lit(1)).alias("_tw_n")).withColumnRenamed("_tw_h", "_tw_bh")
    edge = cut_lineage(_crossing(counts, part, "_tw_bh", F.col("_tw_limit"))
                       .select(*[F.col(c).alias(f"_tw_k{i}") for i, c in enumerate(part)], F.col("_tw_bh").alias("_tw_edge"),
                               (F.col("_tw_limit") - F.col("_tw_below")).alias("_tw_need"), F.col("_tw_n").alias("_tw_ties")))
    d = d.join(_small(edge, classes), same, "left") if part else d.join(F.broadcast(edge), F.lit(True), "left")  # one row
    tie = (F.col("_tw_h") == F.col("_tw_edge")) & (F.col("_tw_need") < F.col("_tw_ties"))
    sure = F.coalesce(F.col("_tw_h") <= F.col("_tw_edge"), F.lit(False))
    if edge.where("_tw_need < _tw_ties").isEmpty():
        return d.select(*df.columns, sure.alias(out))
    w = Window.partitionBy(*part, "_tw_h").orderBy(*key)
    ranked = d.where(tie).withColumn("_tw_r", F.row_number().over(w)).select(*df.columns, (F.col("_tw_r") <= F.col("_tw_need")).alias(out))
    return d.where(~F.coalesce(tie, F.lit(False))).select(*df.columns, sure.alias(out)).unionByName(ranked)


def sample_per_class(df: DataFrame, label: str, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """Shuffle each class by a seeded hash of ``key`` and keep its first ``n`` rows.

    A class may hold most of the rows; it is neither sorted nor brought together
    (:func:`first_by_hash`).
    """
    h = portable_hash(F.lit(str(seed)), *[F.col(c) for c in key])
    return first_by_hash(df, [label], h, key, F.lit(n), "_tw_first").filter("_tw_first").drop("_tw_first")


def split_rows(df: DataFrame, frac: float, key: list[str], seed: int = 42,
               exact: bool = True, out: str = "split") -> DataFrame:
    """A row split ``train``/``test``.

    ``exact=True``: the first ``int(frac * n)`` rows by a seeded hash are train
    (:func:`first_by_hash`, no sort).
    ``exact=False``: one pass, train when the hash is below ``frac * 2**32``.
    """
    h = portable_hash(F.lit(str(seed)), *[F.col(c) for c in key])
    if not exact:
        return df.withColumn(out, F.when(h < F.lit(int(frac * (1 << 32))), "train").otherwise("test"))
    d = first_by_hash(df, [], h, key, F.floor(F.col("_tw_all") * F.lit(frac)), "_tw_first")
    return d.withColumn(out, F.when(F.col("_tw_first"), "train").otherwise("test")).drop("_tw_first")


def split_conversations(df: DataFrame, frac: float, seed: int = 42, conv: str = CONV,
                        out: str = "split") -> DataFrame:
    """Whole conversations go to one side (no turn of a conversation on both)."""
    h = portable_hash(F.lit(str(seed)), F.col(conv))
    return df.withColumn(out, F.when(h < F.lit(int(frac * (1 << 32))), "train").otherwise("test"))

