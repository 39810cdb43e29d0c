"""Registered queries: one per operator of the inventory, each with its oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame`` reads the driver tables under
``sf_dir``; ``ORACLE[name]`` is the same result in DuckDB SQL over the
pre-registered views of those tables.  Names are ``<inventory id>_<operator>``.
Every computed column is aliased identically on both sides; doubles are
rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import BLOCK

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        # The block column of laid out tables is not part of a result.
        QUERIES[name] = wraps(fn)(lambda spark, sf_dir: fn(spark, sf_dir).drop(BLOCK))
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def r6(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def load_all() -> None:
    """Import the query modules (each registers its queries on import)."""
    from . import (q_augment, q_clean, q_ids, q_metrics, q_pairs,  # noqa: F401
                   q_profile, q_quality, q_segment, q_similarity, q_sources)
