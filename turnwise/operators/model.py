"""Linear topic-shift classifier on frozen turn vectors (M13), with MLlib.

A frozen encoder followed by one linear layer is logistic regression on the
encoder's vectors.  MLlib fits it distributed (L-BFGS over partitions);
class imbalance is handled with the balanced weights of A10 as ``weightCol``.
``fit_focal`` fits the same layer to the focal loss (M4).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import class_weights


def fit_classifier(df: DataFrame, vec: str = "embedding", label: str = "topic_shift",
                   weighted: bool = True, max_iter: int = 50, reg: float = 0.0):
    """Fit on ``df``; returns the fitted ``LogisticRegressionModel``."""
    d = df.select(array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("features"),
                  F.col(label).cast("double").alias("label"), F.col(label).alias("_y"))
    lr = LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter, regParam=reg)
    if weighted:
        w = class_weights(df, label).select(F.col(label).alias("_y"), F.col("weight"))
        d = d.join(F.broadcast(w), "_y")  # one row per class
        lr = lr.setWeightCol("weight")
    return lr.fit(d.drop("_y"))


def predict(model, df: DataFrame, vec: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """Apply a fitted model: ``prediction`` and ``p1`` (probability of class 1)."""
    keep = keep or [c for c in df.columns if c != vec]
    d = df.withColumn("features", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    out = model.transform(d)
    return out.select(*keep, F.col("prediction").cast("int").alias("prediction"),
                      vector_to_array("probability")[1].alias("p1"))


# The reference's loss (M4) for the same linear layer.  With z = w x + b and s = +1 for a shift, -1
# else, p = 1 / (1 + exp(-s z)) is the probability of the true class and a row's loss is
# -alpha (1 - p)**gamma ln p.

def focal_slope(alpha: tuple[float, float] = (0.25, 0.75), gamma: float = 2.0, z: str = "z", label: str = "label"):
    """Derivative of a row's focal loss by ``z``, as a column."""
    s = F.when(F.col(label) == 1, 1.0).otherwise(-1.0)
    a = F.when(F.col(label) == 1, F.lit(alpha[1])).otherwise(F.lit(alpha[0]))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-s * F.col(z)))
    log_p = -F.log1p(F.exp(-s * F.col(z)))
    return s * a * F.pow(1 - p, F.lit(gamma)) * (F.lit(gamma) * p * log_p - (1 - p))


def with_score(df: DataFrame, weights: list[float], vec: str = "embedding", out: str = "z") -> DataFrame:
    """Adds ``out``: the linear score; the last weight is the constant."""
    w = F.array(*[F.lit(float(x)) for x in weights[:-1]])
    dot = F.aggregate(F.zip_with(F.transform(vec, lambda x: x.cast("double")), w, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn(out, dot + F.lit(float(weights[-1])))


def fit_focal(df: DataFrame, vec: str = "embedding", label: str = "topic_shift", alpha: tuple[float, float] = (0.25, 0.75),
              gamma: float = 2.0, ridge: float = 1e-3, rounds: int = 60, tolerance: float = 1e-9) -> list[float]:
    """M13 with the focal loss: weights (and a constant, last) at a stationary point of
    ``mean focal loss + ridge / 2 * |weights|^2``.

    Newton steps.  A round is one pass: every task adds up loss, slope and curvature of its rows
    (numpy, one batch of rows at a time) and hands on one number per component, which are summed
    by component.  The driver holds ``(d + 1)**2`` numbers.  Where the loss is not convex the
    curvature is replaced by an upper estimate, and a step that does not lower the loss is halved.
    Rows without vector or label, or with a vector of another length than most, take no part.
    """
    rows = df.where(F.col(vec).isNotNull() & F.col(label).isNotNull()).select(
        F.transform(vec, lambda x: x.cast("double")).alias("x"), F.col(label).cast("int").alias("y"))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").head()
    if sizes is None:
        return [0.0]
    d = sizes["d"]
    rows = rows.where(F.size("x") == d)

    def passed(w: np.ndarray, curvature: bool) -> np.ndarray:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + (d + 1) + ((d + 1) ** 2 if curvature else 0))
            for b in batches:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                x = np.hstack([x, np.ones((len(x), 1))])
                y = b.column("y").to_numpy()
                s, a = np.where(y == 1, 1.0, -1.0), np.where(y == 1, alpha[1], alpha[0])
                m = s * (x @ w)
                log_p = -np.logaddexp(0.0, -m)
                p = np.exp(log_p)
                q = np.exp(-np.logaddexp(0.0, m))  # 1 - p
                slope = s * a * q ** gamma * (gamma * p * log_p - q)
                total[0] += (-a * q ** gamma * log_p).sum()
                total[1] += len(y)
                total[2:d + 3] += slope @ x
                if curvature:
                    bend = a * p * q ** gamma * (gamma * (q - gamma * p) * log_p + (1 + 2 * gamma) * q)
                    total[d + 3:] += ((np.maximum(bend, 0.05 * a * p * q)[:, None] * x).T @ x).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

        got = rows.mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # (d + 1)**2 rows and a few
        out = np.zeros(2 + (d + 1) + ((d + 1) ** 2 if curvature else 0))
        for r in got:
            out[r["i"]] = r["v"]
        return out

    w, penalty = np.zeros(d + 1), np.r_[np.full(d, ridge), 0.0]
    for _ in range(rounds):
        t = passed(w, True)
        n = max(t[1], 1.0)
        loss, slope = t[0] / n + penalty @ (w * w) / 2, t[2:d + 3] / n + penalty * w
        if np.abs(slope).max() < tolerance:
            break
        bend = t[d + 3:].reshape(d + 1, d + 1) / n + np.diag(penalty + 1e-12)
        step = np.linalg.solve(bend, slope)
        size = 1.0
        while size > 1e-6:
            after = passed(w - size * step, False)
            if after[0] / n + penalty @ ((w - size * step) ** 2) / 2 <= loss + 1e-15:
                break
            size /= 2
        w = w - size * step
    return w.tolist()


def predict_focal(df: DataFrame, weights: list[float], vec: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """``prediction`` (the likelier class; a tie goes to 0) and ``p1`` of the linear layer."""
    keep = keep or [c for c in df.columns if c != vec]
    d = with_score(df, weights, vec, "_z")
    return d.select(*keep, (F.col("_z") > 0).cast("int").alias("prediction"), (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_z")))).alias("p1"))
