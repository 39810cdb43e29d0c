"""Losses over logits and embedding pairs (M3-M6), as column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2_normalize, pair_distance
from ..plans.positions import with_position

CHUNK = 1024


def _lse(l0: Column, l1: Column) -> Column:
    m = F.greatest(l0, l1)
    return m + F.log(F.exp(l0 - m) + F.exp(l1 - m))


def cross_entropy_col(l0: str = "logit0", l1: str = "logit1", label: str = "label") -> Column:
    """Per-row cross-entropy of a two-class logit pair (stable log-sum-exp)."""
    a, b = F.col(l0).cast("double"), F.col(l1).cast("double")
    return _lse(a, b) - F.when(F.col(label) == 1, b).otherwise(a)


def cross_entropy(df: DataFrame, order: list[str], batch_size: int = 128, l0: str = "logit0",
                  l1: str = "logit1", label: str = "label") -> DataFrame:
    """M3: mean over batches of the mean cross-entropy of each batch.

    Batches are consecutive runs of ``batch_size`` rows in ``order``; the last
    may be short and still weighs as much as the others.
    """
    d = with_position(df.select(*order, l0, l1, label), order, "_pos")
    d = d.withColumn("_ce", cross_entropy_col(l0, l1, label)) \
         .withColumn("_b", F.floor(F.col("_pos") / batch_size))
    per = d.groupBy("_b").agg(F.avg("_ce").alias("_m"))
    return per.agg(F.avg("_m").alias("cross_entropy"), F.count(F.lit(1)).alias("n_batches"))


def focal_col(alpha: tuple[float, float] = (0.25, 0.75), gamma: float = 2.0, l0: str = "logit0",
              l1: str = "logit1", label: str = "label") -> Column:
    """Per-row focal loss ``alpha[y] * (1 - p_t)**gamma * CE``."""
    ce = cross_entropy_col(l0, l1, label)
    a = F.when(F.col(label) == 1, F.lit(alpha[1])).otherwise(F.lit(alpha[0]))
    return a * F.pow(F.lit(1.0) - F.exp(-ce), F.lit(gamma)) * ce


def focal_loss(df: DataFrame, alpha: tuple[float, float] = (0.25, 0.75), gamma: float = 2.0,
               l0: str = "logit0", l1: str = "logit1", label: str = "label") -> DataFrame:
    """M4: mean of ``alpha[y] * (1 - p_t)**gamma * CE`` with ``p_t = exp(-CE)``."""
    return df.agg(F.avg(focal_col(alpha, gamma, l0, l1, label)).alias("focal_loss"))


def contrastive_rows(df: DataFrame, a: str, b: str, label: str = "label", margin: float = 1.5,
                     metric: str = "cosine") -> DataFrame:
    """M5 per row: ``2*y*d**2 + (1-y)*ln(1 + exp(margin - d))``, d = X10 distance."""
    d = pair_distance(a, b, metric)
    y = F.col(label).cast("double")
    return df.withColumn("distance", d).withColumn(
        "loss", F.lit(2.0) * y * F.col("distance") * F.col("distance")
        + (F.lit(1.0) - y) * F.log1p(F.exp(F.lit(margin) - F.col("distance"))))


def contrastive_loss(df: DataFrame, a: str, b: str, label: str = "label", margin: float = 1.5,
                     metric: str = "cosine") -> DataFrame:
    """M5 total: the per-row losses summed, with their positive and negative parts."""
    r = contrastive_rows(df, a, b, label, margin, metric)
    y = F.col(label).cast("double")
    return r.agg(F.sum("loss").alias("loss"),
                 F.sum(F.lit(2.0) * y * F.col("distance") * F.col("distance")).alias("positive_loss"),
                 F.sum((F.lit(1.0) - y) * F.log1p(F.exp(F.lit(margin) - F.col("distance")))).alias("negative_loss"),
                 F.count(F.lit(1)).alias("n_pairs"))


def nt_xent(df: DataFrame, a: str, b: str, order: list[str], tau: float = 0.5,
            batch_size: int = 32, include_self: bool = True) -> DataFrame:
    """M6: NT-Xent over batches of ``batch_size`` pairs (the README's formula).

    For anchor ``h_i`` (first vector of pair i) the positive is ``h_j`` (its
    second vector) and the denominator sums ``exp(sim(h_i, h_k)/tau)`` over
    all 2N vectors of the batch, itself included unless ``include_self`` is
    false.  The work is ``batch_size`` dot products per vector; a batch is
    joined in chunks of ``CHUNK`` members, so it need not fit one task.
    Returns the mean of the batch means.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    d = with_position(df.select(*order, a, b), order, "_pos")
    d = d.select(F.floor(F.col("_pos") / batch_size).alias("_b"), F.col("_pos"),
                 l2_normalize(a).alias("_ha"), l2_normalize(b).alias("_hb"))
    members = d.select("_b", F.col("_pos").alias("_mp"), F.lit(0).alias("_side"), F.col("_ha").alias("_hm")) \
        .unionByName(d.select("_b", F.col("_pos").alias("_mp"), F.lit(1).alias("_side"), F.col("_hb").alias("_hm")))
    # A task joins one chunk of a batch's members with one chunk of its anchors.
    chunks = -(-batch_size // CHUNK)
    chunk = (F.col("_pos") % batch_size / CHUNK).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    left = d.withColumn("_ca", chunk).select("*", every.alias("_cm"))
    right = members.withColumn("_cm", (F.col("_mp") % batch_size / CHUNK).cast("int")).select("*", every.alias("_ca"))
    j = left.join(right, ["_b", "_ca", "_cm"])
    if not include_self:
        j = j.filter(~((F.col("_mp") == F.col("_pos")) & (F.col("_side") == 0)))
    den = j.groupBy("_b", "_pos").agg(F.sum(F.exp(dot("_ha", "_hm") / tau)).alias("_den"))
    per = d.join(den, ["_b", "_pos"]).select(
        "_b", (F.log("_den") - dot("_ha", "_hb") / tau).alias("_l"))
    return per.groupBy("_b").agg(F.avg("_l").alias("_m")).agg(F.avg("_m").alias("nt_xent"),
                                                                 F.count(F.lit(1)).alias("n_batches"))
