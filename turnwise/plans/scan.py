"""Skew-safe ordered scans inside a group, and group values handed back to rows.

A plain ``Window.partitionBy(conversation)`` puts a whole conversation into one task, and a join
on the conversation puts all its rows next to one key.  One conversation may hold a large share
of all rows, so both are done in *blocks*: the group key plus ``floor(order / block_rows)``.
Inside a block Spark's window operator does the work; a block table (one row per block) carries
edge values, totals of earlier blocks and group totals, and is joined back on (group, block).

Without a group (the whole table is one sequence) the block table itself may be long.  It is then
scanned in blocks as well, and so on: a tree of block tables whose last level has at most
``block_rows`` rows.

Scans that follow each other on one ordering share it: :func:`laid_out` writes a table bucketed by
(group, block), and scans of such a table, and of what scans of it return, add no exchange of rows.

``order`` must be an integral, roughly dense position (turn ids, row positions); blocks then hold
at most ``block_rows`` rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bucketed_table

BLOCK_ROWS = 1 << 16
# Session setting that overrides the default block size (tests set it small to
# exercise the cross-block carries).
BLOCK_CONF = "turnwise.scan.blockRows"

# The block column that a laid out table carries (blocks of ``LAID_ORDER``).
BLOCK, LAID_ORDER = "_tw_blk", "turn_id"


def block_rows_for(df: DataFrame, block_rows: int | None = None) -> int:
    if block_rows:
        return int(block_rows)
    return int(df.sparkSession.conf.get(BLOCK_CONF, str(BLOCK_ROWS)))


def block_of(df: DataFrame, order: str, block_rows: int | None = None) -> Column:
    return F.floor(F.col(order) / F.lit(block_rows_for(df, block_rows))).cast("long")


def laid_out(df: DataFrame, part: Sequence[str], dealt: bool = False) -> DataFrame:
    """``df`` written once, bucketed by (``part``, block of turns) and read back with its block column.

    ``dealt``: the rows are already dealt by these columns (scans of a laid out table)."""
    if BLOCK not in df.columns:
        df = df.withColumn(BLOCK, block_of(df, LAID_ORDER))
    return bucketed_table(df, [*part, BLOCK], [LAID_ORDER], dealt)


# What a block hands on, by kind of scan: its value for other blocks, and a row's value from the
# other rows of its block.  All are exclusive of the row itself (but ``total``, of the group).
def _block_value(kind: str, v: Column, order: str) -> Column:
    if kind == "prev":
        return F.max_by(v, F.col(order))
    if kind == "next":
        return F.min_by(v, F.col(order))
    return {"sum": F.sum, "total": F.sum, "max": F.max, "total_max": F.max, "min_after": F.min, "total_min": F.min}[kind](v)


def _inside(kind: str, v: Column, keys: Sequence[str], order: str, whole: bool) -> Column | None:
    """``whole``: the window is the group, not a block (totals then come from it as well).

    What follows a row is what precedes it in descending order: a frame that ends with the group is
    added up anew for every row, which grows with the square of a block."""
    every = Window.partitionBy(*keys) if keys else Window
    w, back = every.orderBy(order), every.orderBy(F.col(order).desc())
    before, after = (x.rowsBetween(Window.unboundedPreceding, -1) for x in (w, back))
    whole_group = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if kind.startswith("total"):
        return {"total": F.sum, "total_max": F.max, "total_min": F.min}[kind](v).over(whole_group) if whole else None
    return {"sum": lambda: F.coalesce(F.sum(v).over(before), F.lit(0)), "max": lambda: F.max(v).over(before),
            "min_after": lambda: F.min(v).over(after), "prev": lambda: F.lag(v).over(w), "next": lambda: F.lead(v).over(w)}[kind]()


def _joined(kind: str, inside: Column, carried: Column) -> Column:
    if kind == "sum":
        return inside + F.coalesce(carried, F.lit(0))
    if kind == "max":
        return F.greatest(inside, carried)
    if kind == "min_after":
        return F.least(inside, carried)
    return F.coalesce(inside, carried)


def _exclusive(table: DataFrame, part: Sequence[str], order: str, kinds: Mapping[str, str], rows: int,
               longest: int | None, level: int, block: str | None = None) -> DataFrame:
    """``table`` (values ``_tw_v_<out>``) with ``_tw_x_<out>`` for each ``out: kind``.

    ``longest``: how many rows a group may have; blocks are made if that is more than ``rows``."""
    if longest is not None and longest <= max(rows, 2):
        return table.select("*", *[_inside(k, F.col(f"_tw_v_{o}"), part, order, True).alias(f"_tw_x_{o}") for o, k in kinds.items()])
    b = block or f"_tw_b{level}"
    d = table if block else table.withColumn(b, F.floor(F.col(order) / rows).cast("long"))
    keys = [*part, b]
    edges = d.groupBy(*keys).agg(*[_block_value(k, F.col(f"_tw_v_{o}"), order).alias(f"_tw_v_{o}") for o, k in kinds.items()])
    inside = {o: _inside(k, F.col(f"_tw_v_{o}"), keys, order, False) for o, k in kinds.items()}
    d = d.select("*", *[c.alias(f"_tw_i_{o}") for o, c in inside.items() if c is not None])
    # A group's blocks are few (one for each ``rows`` rows); the whole table's may be many.
    up = _exclusive(edges, part, b, kinds, rows, max(rows, 2) if part else -(-longest // rows), level + 1)
    up = up.select(*keys, *[F.col(f"_tw_x_{o}").alias(f"_tw_c_{o}") for o in kinds])
    d = d.join(up, keys, "left")
    exact = [_joined(k, F.col(f"_tw_i_{o}"), F.col(f"_tw_c_{o}")) if inside[o] is not None else F.col(f"_tw_c_{o}") for o, k in kinds.items()]
    made = [c.alias(f"_tw_x_{o}") for o, c in zip(kinds, exact)]
    return d.select(*[c for c in table.columns], *made)


def ordered_scan(df: DataFrame, part: Sequence[str], order: str,
                 prev: Sequence[str] = (), nxt: Sequence[str] = (),
                 sums: Mapping[str, Column | str] | None = None,
                 totals: Mapping[str, Column | str] | None = None,
                 last: Mapping[str, Column | str] | None = None,
                 coming: Mapping[str, Column | str] | None = None,
                 group_max: Mapping[str, Column | str] | None = None,
                 group_min: Mapping[str, Column | str] | None = None,
                 prev_prefix: str = "prev_", next_prefix: str = "next_",
                 block_rows: int | None = None, block: str | None = None) -> DataFrame:
    """One skew-safe pass over each group of ``part`` in ``order``.

    ``block``: a column that already cuts every group into consecutive blocks, in its own order.

    Adds ``prev_prefix + c`` (value on the previous row of the group) for each ``c`` in ``prev``,
    ``next_prefix + c`` (next row) for each ``c`` in ``nxt``, and for each ``out: expr``

    * ``sums``: the running sum of ``expr`` up to and including the row;
    * ``totals``, ``group_max``, ``group_min``: its sum, maximum, minimum over the group;
    * ``last``: its maximum up to and including the row (the last position where it is not null);
    * ``coming``: its minimum from the row on (the next position where it is not null).
    """
    part, prev, nxt = list(part), list(prev), list(nxt)
    rows = block_rows_for(df, block_rows)
    kinds: dict[str, str] = {}
    values: dict[str, Column] = {}
    asked = {"sum": sums, "total": totals, "max": last, "min_after": coming, "total_max": group_max, "total_min": group_min}
    for kind, exprs in asked.items():
        for out, e in (exprs or {}).items():
            kinds[out], values[out] = kind, F.col(e) if isinstance(e, str) else e
            if kind in ("sum", "total"):
                values[out] = values[out].cast("long")
    if prev:
        kinds["prev"], values["prev"] = "prev", F.struct(*[F.col(c) for c in prev])
    if nxt:
        kinds["next"], values["next"] = "next", F.struct(*[F.col(c) for c in nxt])
    laid = BLOCK in df.columns and order == LAID_ORDER and part and block_rows is None
    block = block or (BLOCK if laid else None)
    longest = None
    if not part:  # one sequence: how long decides the height of the tree
        top = df.agg(F.max(order)).first()[0]
        longest = max(int(top or 0) + 1, rows + 1)
    d = df.select("*", *[v.alias(f"_tw_v_{o}") for o, v in values.items()])
    d = _exclusive(d, part, order, kinds, rows, longest, 1, block)
    outs = [F.col(c) for c in df.columns]
    outs += [F.col(f"_tw_x_prev.{c}").alias(prev_prefix + c) for c in prev]
    outs += [F.col(f"_tw_x_next.{c}").alias(next_prefix + c) for c in nxt]
    for out, kind in kinds.items():
        x, v = F.col(f"_tw_x_{out}"), F.col(f"_tw_v_{out}")
        if kind == "sum":
            outs.append((x + F.coalesce(v, F.lit(0))).alias(out))
        elif kind in ("max", "min_after"):
            outs.append((F.greatest if kind == "max" else F.least)(x, v).alias(out))
        elif kind.startswith("total"):
            outs.append((F.coalesce(x, F.lit(0)) if kind == "total" else x).alias(out))
    return d.select(*outs)


def with_prev(df: DataFrame, part: Sequence[str], order: str, cols: Sequence[str],
              prefix: str = "prev_", block_rows: int | None = None) -> DataFrame:
    """Add ``prefix + c``: the value of ``c`` on the previous row of the group."""
    return ordered_scan(df, part, order, prev=cols, prev_prefix=prefix, block_rows=block_rows)


def with_next(df: DataFrame, part: Sequence[str], order: str, cols: Sequence[str],
              prefix: str = "next_", block_rows: int | None = None) -> DataFrame:
    """Add ``prefix + c``: the value of ``c`` on the next row of the group."""
    return ordered_scan(df, part, order, nxt=cols, next_prefix=prefix, block_rows=block_rows)


def with_running_sum(df: DataFrame, part: Sequence[str], order: str, value: Column | str,
                     out: str, block_rows: int | None = None) -> DataFrame:
    """Add ``out``: sum of ``value`` over the group's rows up to and including this one."""
    return ordered_scan(df, part, order, sums={out: value}, block_rows=block_rows)


def _struct_type(values: DataFrame, cols: Sequence[str]) -> str:
    return values.select(F.struct(*cols).alias("s")).schema["s"].dataType.simpleString()


def hand_back(df: DataFrame, part: Sequence[str], order: str, values: DataFrame, cols: Sequence[str],
              block_rows: int | None = None) -> DataFrame:
    """Add ``cols`` of ``values`` (one row per group of ``part``) to the rows of ``df``; null without one.

    The groups' values first reach a table of blocks (one row for each ``block_rows`` rows of a
    group), by grouping it together with them, and then the rows by a join on (group, block).
    """
    laid = BLOCK in df.columns and order == LAID_ORDER and block_rows is None
    if laid:
        return hand_back_by(df, part, BLOCK, values, cols)
    return hand_back_by(df.withColumn("_tw_hb", block_of(df, order, block_rows)), part, "_tw_hb", values, cols).drop("_tw_hb")


def hand_back_by(df: DataFrame, part: Sequence[str], block: str, values: DataFrame, cols: Sequence[str]) -> DataFrame:
    """:func:`hand_back` with blocks that the caller gave the rows (an integral column)."""
    part, cols = list(part), list(cols)
    blocks = df.select(*part, block).distinct()
    both = blocks.select(*part, block, F.lit(None).cast(_struct_type(values, cols)).alias("_tw_val")) \
        .unionByName(values.select(*part, F.lit(None).cast("long").alias(block), F.struct(*cols).alias("_tw_val")))
    # max ignores nulls: the one value of the group
    got = both.select(*part, block, F.max("_tw_val").over(Window.partitionBy(*part)).alias("_tw_val")).where(F.col(block).isNotNull())
    d = df.join(got, [*part, block], "left")
    keep = [c for c in df.columns if c not in cols]
    return d.select(*keep, *[F.col(f"_tw_val.{c}").alias(c) for c in cols])
