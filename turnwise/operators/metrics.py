"""Predictions and segmentation metrics.

Pk and WindowDiff are computed on *sparse windows*: a window without a true
or predicted boundary always agrees, so only the at most ``k`` windows touched
by each boundary are generated (``explode(sequence(...))``) and counted.  The
boundary MAE is an as-of lookup of the nearest predicted boundary on each
side, done in blocks of positions so no single task holds the whole sequence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.positions import with_position
from ..plans.scan import BLOCK, LAID_ORDER, laid_out, ordered_scan
from ..session import cut_lineage
from .ids import attach_scalar
from .segment import boundaries, keep

CONV, TURN = "conversation_id", "turn_id"

# Class names of the classification report.
CLASS_NAMES = ("No Shift", "Topic Shift")


def predict_threshold(df: DataFrame, threshold: float = 0.63, l0: str = "logit0",
                      l1: str = "logit1", out: str = "pred") -> DataFrame:
    """M1: softmax probability of class 1 above ``threshold``."""
    p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(F.col(l0) - F.col(l1)))
    return df.withColumn("p1", p1).withColumn(out, (F.col("p1") > threshold).cast("int"))


def predict_argmax(df: DataFrame, l0: str = "logit0", l1: str = "logit1", out: str = "pred") -> DataFrame:
    """M2: arg-max class; a tie goes to class 0."""
    return df.withColumn(out, F.when(F.col(l1) > F.col(l0), 1).otherwise(0).cast("int"))


def accuracy(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """M2: share of rows whose prediction equals the label."""
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "pred",
                          names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """M7: precision, recall, F1 and support per class, accuracy, macro and weighted averages.

    One aggregation pass; a zero division gives 0.  The accuracy row carries
    the accuracy in ``f1_score`` and the row count in ``support``.
    """
    y, p = F.col(label), F.col(pred)
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in (0, 1):
        aggs += [F.count_if((y == c) & (p == c)).alias(f"tp{c}"),
                 F.count_if(p == c).alias(f"pp{c}"), F.count_if(y == c).alias(f"sp{c}")]
    a = df.agg(*aggs)

    def div(x, z):
        return F.when(z > 0, x / z).otherwise(F.lit(0.0))

    for c in (0, 1):
        a = a.withColumn(f"pr{c}", div(F.col(f"tp{c}"), F.col(f"pp{c}"))) \
             .withColumn(f"rc{c}", div(F.col(f"tp{c}"), F.col(f"sp{c}")))
        a = a.withColumn(f"f{c}", div(2 * F.col(f"pr{c}") * F.col(f"rc{c}"), F.col(f"pr{c}") + F.col(f"rc{c}")))
    n = F.col("n")

    def row(name, pr, rc, f1, sup):
        return F.struct(F.lit(name).alias("class_name"), pr.cast("double").alias("precision"),
                        rc.cast("double").alias("recall"), f1.cast("double").alias("f1_score"),
                        sup.cast("long").alias("support"))

    def wavg(m):
        return div(F.col(f"{m}0") * F.col("sp0") + F.col(f"{m}1") * F.col("sp1"), n)

    rows = [row(names[c], F.col(f"pr{c}"), F.col(f"rc{c}"), F.col(f"f{c}"), F.col(f"sp{c}")) for c in (0, 1)]
    rows.append(row("accuracy", F.lit(None), F.lit(None), div(F.col("tp0") + F.col("tp1"), n), n))
    rows.append(row("macro avg", (F.col("pr0") + F.col("pr1")) / 2, (F.col("rc0") + F.col("rc1")) / 2,
                    (F.col("f0") + F.col("f1")) / 2, n))
    rows.append(row("weighted avg", wavg("pr"), wavg("rc"), wavg("f"), n))
    return a.select(F.inline(F.array(*rows)))


def sequence_boundaries(df: DataFrame, true_col: str, pred_col: str, scope: str = "global",
                        conv: str = CONV, turn: str = TURN) -> DataFrame:
    """Label sequences -> ``(part..., pos, tb, pb)`` with W3 boundaries of both.

    ``scope='global'``: one sequence over the whole table in (conversation,
    turn) order (the reference); ``'conversation'``: one per conversation.
    """
    if scope == "global":
        # Range bounds are sampled from the rows that are dealt: stored first, labels are not worked out for that as well.
        d = with_position(cut_lineage(df.select(conv, turn, true_col, pred_col)), [conv, turn], "pos")
        d = boundaries(d, [true_col, pred_col], ["tb", "pb"], "global", conv, turn, pos="pos")
        return d.select("pos", "tb", "pb")
    if scope == "conversation":
        labels = [true_col, pred_col]
        # The scan and the scores read the labels several times; they are worked out once.
        d = keep(df, conv, turn, *labels)
        d = laid_out(d, [conv], dealt=BLOCK in df.columns) if turn == LAID_ORDER else cut_lineage(d)
        d = ordered_scan(d, [conv], turn, prev=labels, sums={"pos": F.lit(1)}, totals={"n": F.lit(1)})
        flags = [F.when(F.col("prev_" + c) != F.col(c), 1).otherwise(0).cast("int").alias(o) for c, o in zip(labels, ("tb", "pb"))]
        return d.select(conv, (F.col("pos") - 1).alias("pos"), *flags, "n")
    raise ValueError("scope must be 'global' or 'conversation'")


def _parts(seq: DataFrame) -> list[str]:
    return [c for c in seq.columns if c not in ("pos", "tb", "pb", "n")]


def window_size(seq: DataFrame) -> DataFrame:
    """M8: ``n / (2 * true boundaries)``; null when there is none."""
    part = _parts(seq)
    return seq.groupBy(*part).agg(F.try_divide(F.count(F.lit(1)).cast("double"),
                                               (2 * F.sum("tb")).cast("double")).alias("window_size"))


# Scores are sums over three kinds of rows: positions, windows that a boundary touches, and true
# boundaries with their distance.  They are put under each other and grouped once.
_ROW = {"n": "long", "tb": "int", "pb": "int", "pk": "int", "wd": "int", "dist": "long"}


def _rows(d: DataFrame, part: list[str], **given) -> DataFrame:
    return d.select(*part, *[(given[c] if c in given else F.lit(None if c == "dist" else 0)).cast(t).alias(c) for c, t in _ROW.items()])


def _window_rows(seq: DataFrame, k: int) -> DataFrame:
    """Windows ``[i, i+k)``, ``i < n - k``, that hold a boundary, and whether they disagree."""
    part = _parts(seq)
    b = seq.filter((F.col("tb") == 1) | (F.col("pb") == 1))
    if "n" not in seq.columns:
        b = attach_scalar(b, seq.agg(F.count(F.lit(1)).alias("n"))) if not part else \
            ordered_scan(seq, part, "pos", totals={"n": F.lit(1)}).filter((F.col("tb") == 1) | (F.col("pb") == 1))
    lo = F.greatest(F.col("pos") - k + 1, F.lit(0))
    hi = F.least(F.col("pos"), F.col("n") - k - 1)
    w = b.filter(lo <= hi).select(*part, F.explode(F.sequence(lo, hi)).alias("i"), "tb", "pb")
    c = w.groupBy(*part, "i").agg(F.sum("tb").alias("tc"), F.sum("pb").alias("pc"))
    return _rows(c, part, pk=(F.col("tc") > 0) != (F.col("pc") > 0), wd=F.col("tc") != F.col("pc"))


def _distance_rows(seq: DataFrame, block_rows: int | None = None) -> DataFrame:
    """True boundaries and their distance to the nearest predicted one, an as-of lookup in blocks."""
    part = _parts(seq)
    b = seq.filter((F.col("tb") == 1) | (F.col("pb") == 1)).select(*part, "pos", "tb", "pb")
    at = F.when(F.col("pb") == 1, F.col("pos"))
    d = ordered_scan(b, part, "pos", last={"_before": at}, coming={"_after": at}, block_rows=block_rows).where("tb = 1")
    return _rows(d, part, dist=F.least(F.col("pos") - F.col("_before"), F.col("_after") - F.col("pos")))


def _scores(seq: DataFrame, *more: DataFrame) -> DataFrame:
    part = _parts(seq)
    rows = _rows(seq, part, n=F.lit(1), tb=F.col("tb"), pb=F.col("pb"))
    for m in more:
        rows = rows.unionByName(m)
    zero = F.lit(0).cast("long")
    sums = [F.coalesce(F.sum(c), zero).alias(o) for c, o in (("n", "n"), ("tb", "n_true"), ("pb", "n_pred"), ("pk", "pk_errors"), ("wd", "wd_errors"))]
    return rows.groupBy(*part).agg(*sums, F.avg("dist").alias("_mae"))


def _pk(k: int) -> list:
    den = F.col("n") - k
    return [F.when(den > 0, F.col("pk_errors") / den), F.when(den > 0, F.col("wd_errors") / den)]


def _mae():
    none = (F.col("n_true") == 0) | (F.col("n_pred") == 0)
    return F.when(none, (F.col("n_true") + F.col("n_pred")).cast("double")).otherwise(F.col("_mae"))


def window_errors(seq: DataFrame, k: int = 2) -> DataFrame:
    """Pk (M9) and WindowDiff (M10) errors over windows ``[i, i+k)``, ``i < n - k``.

    Returns ``(part..., n, pk_errors, wd_errors, pk, window_diff)``; the scores
    are null when ``n <= k``.
    """
    pk, wd = _pk(k)
    return _scores(seq, _window_rows(seq, k)).select(*_parts(seq), "n", "pk_errors", "wd_errors", pk.alias("pk"), wd.alias("window_diff"))


def boundary_mae(seq: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Mean over true boundaries of the distance to the nearest predicted one.

    When either side has no boundary the result is the number of boundaries
    on both sides.  The nearest predicted boundary before and after each
    position is an as-of lookup done in blocks of ``block_rows`` positions.
    """
    return _scores(seq, _distance_rows(seq, block_rows)).select(*_parts(seq), "n_true", "n_pred", _mae().alias("mae"))


def segmentation_report(df: DataFrame, true_col: str, pred_col: str, k: int = 2,
                        scope: str = "global") -> DataFrame:
    """Pk, WindowDiff and MAE in one row (one row per conversation for that scope)."""
    seq = sequence_boundaries(df, true_col, pred_col, scope)
    pk, wd = _pk(k)
    return _scores(seq, _window_rows(seq, k), _distance_rows(seq)).select(*_parts(seq), pk.alias("Pk"), wd.alias("WD"), _mae().alias("MAE"))
