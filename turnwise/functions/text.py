"""Column expressions for text (all JVM-side, inside whole-stage codegen).

Java's ``\\w`` and ``\\s`` are ASCII; Python's are Unicode.  Patterns that must
behave like Python's ``re`` carry the ``(?U)`` flag.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
# Token pattern of the TF-IDF / keyword tokeniser: two or more word characters.
TOKEN_PATTERN = r"(?U)\b\w\w+\b"
# Delimiter between turns in the delimited-text format.
EOU = "__eou__"
# Speakers kept by the transcript parser, in order.
VALID_USERS = ("User 1", "User 2")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode white space."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def normalize_text(c) -> Column:
    """Lower-case and collapse every run of non-word characters to one space."""
    return F.regexp_replace(F.lower(_c(c)), r"(?U)\W+", " ")


def turn_count(c) -> Column:
    """Number of ``\\nUser`` matches (any case) plus one."""
    return (F.regexp_count(_c(c), F.lit(r"(?i)\nUser")) + F.lit(1)).cast("long")


def normalize_label(c) -> Column:
    """Bool / 'True' / 'true' / '1' / 'positive' -> 1, anything else -> 0.

    Null stays null.
    """
    s = F.lower(strip(_c(c).cast("string")))
    return F.when(s.isNull(), F.lit(None).cast("int")) \
            .when(s.isin("true", "1", "positive", "1.0"), F.lit(1)) \
            .otherwise(F.lit(0))


def tokens(c, lower: bool = True) -> Column:
    """Tokens of two or more word characters (scikit-learn's default pattern)."""
    x = F.lower(_c(c)) if lower else _c(c)
    return F.regexp_extract_all(x, F.lit(TOKEN_PATTERN), 0)


def whitespace_tokens(c) -> Column:
    """Non-empty white-space separated tokens."""
    return F.filter(F.split(strip(_c(c)), r"(?U)\s+"), lambda t: t != "")


def truncate_tokens(c, n: int, side: str = "right") -> Column:
    """Keep ``n`` white-space tokens.

    ``side='right'`` cuts the right end (keeps the first ``n``), as a
    right-truncating tokenizer does; ``side='left'`` keeps the last ``n``.
    """
    t = whitespace_tokens(c)
    if side == "right":
        kept = F.slice(t, 1, n)
    elif side == "left":
        kept = F.when(F.size(t) > n, F.slice(t, -n, n)).otherwise(t)
    else:
        raise ValueError("side must be 'right' or 'left'")
    return F.array_join(kept, " ")
