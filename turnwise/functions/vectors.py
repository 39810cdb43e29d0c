"""Dense-vector column expressions over ``array<float|double>`` (higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v, eps: float = 1e-12) -> Column:
    """``v / max(||v||, eps)`` element-wise."""
    n = F.greatest(norm(v), F.lit(eps))
    return F.transform(as_double(v), lambda x: x / n)


def cosine(a, b, eps: float = 1e-12) -> Column:
    """Cosine similarity; each norm floored at ``eps``."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def euclidean(a, b) -> Column:
    d = F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x * x))


def pair_distance(a, b, metric: str = "cosine") -> Column:
    """Cosine distance ``1 - cos`` or Euclidean distance (X10); other names are an error."""
    if metric == "cosine":
        return F.lit(1.0) - dot(l2_normalize(a), l2_normalize(b))
    if metric == "euclidean":
        return euclidean(a, b)
    raise ValueError(f"no such distance: {metric!r} (known: cosine, euclidean)")
