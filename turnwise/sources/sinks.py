"""Sinks (S6-S8): Spark's CSV and JSON writers, one file per task."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; every field quoted, quotes doubled (reads back with S3)."""
    df.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines records."""
    df.write.mode(mode).json(path)


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Headerless tab-separated file (reads back with S4)."""
    df.write.mode(mode).option("sep", "\t").option("header", False).option("escape", '"').csv(path)


def save_pairs(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write a pair table as CSV or JSON; any other format is an error."""
    if fmt == "csv":
        write_csv(df, path, mode)
    elif fmt == "json":
        write_json(df, path, mode)
    else:
        raise ValueError(f"pairs are written as csv or json, not {fmt!r}")
