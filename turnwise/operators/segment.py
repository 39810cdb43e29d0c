"""Segmentation windows: topic segments, change flags, boundaries, shift statistics, history.

All ordered scans go through :mod:`turnwise.plans.scan`, which splits very long
conversations into blocks, so no conversation has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import truncate_tokens, whitespace_tokens
from ..plans.positions import with_position
from ..plans.scan import BLOCK, LAID_ORDER, block_of, ordered_scan, with_prev

CONV, SEG, TURN = "conversation_id", "sub_conversation_id", "turn_id"


def _key_string(df: DataFrame, key: str):
    """An array key is joined by ', ' (an empty list is the real key '')."""
    if isinstance(df.schema[key].dataType, T.ArrayType):
        return F.concat_ws(", ", F.col(key))
    return F.col(key).cast("string")


def segment_by_key(df: DataFrame, key: str = "knowledge_source", conv: str = CONV,
                   turn: str = TURN, key_out: str | None = None,
                   block_rows: int | None = None) -> DataFrame:
    """``topic_shift`` = key differs from the previous turn (true on the first
    turn); ``sub_conversation_id`` = number of key changes so far (0-based).

    One skew-safe pass (see :mod:`turnwise.plans.scan`): inside a block the
    change flags and their running count are window functions; the block
    table carries each block's first and last key and its count of inner
    changes, from which the first row's flag and the count of all earlier
    blocks follow.
    """
    k = key_out or key
    d = df.withColumn(k, _key_string(df, key))
    keys = [conv, BLOCK]
    if not (BLOCK in d.columns and turn == LAID_ORDER and block_rows is None):
        d = d.withColumn(BLOCK, block_of(d, turn, block_rows))
    w = Window.partitionBy(*keys).orderBy(turn)
    first = F.row_number().over(w) == 1
    inner = F.when(first, 0).when(~F.col(k).eqNullSafe(F.lag(k).over(w)), 1).otherwise(0)
    d = d.select("*", first.alias("_tw_first"), inner.alias("_tw_chg"))
    d = d.withColumn("_tw_run", F.sum("_tw_chg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    edge = d.groupBy(*keys).agg(F.min_by(F.struct(F.col(k).alias("v")), F.col(turn)).alias("_fk"),
                                F.max_by(F.struct(F.col(k).alias("v")), F.col(turn)).alias("_lk"),
                                F.sum("_tw_chg").alias("_in"))
    wb = Window.partitionBy(conv).orderBy(BLOCK)
    prev_last = F.lag("_lk").over(wb)
    first_chg = F.when(prev_last.isNull(), 1) \
                 .when(~F.col("_fk.v").eqNullSafe(prev_last["v"]), 1).otherwise(0)
    edge = edge.select(*keys, first_chg.alias("_fc"), "_in")
    edge = edge.select(*keys, "_fc", F.coalesce(F.sum(F.col("_fc") + F.col("_in")).over(
        wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    d = d.join(edge, keys, "left")
    shift = F.when(F.col("_tw_first"), F.col("_fc")).otherwise(F.col("_tw_chg")).cast("int")
    seg = (F.col("_off") + F.col("_fc") + F.col("_tw_run") - 1).cast("long")
    # The block column stays: later scans of the same ordering need no exchange of the rows.
    out = [c for c in d.columns if c not in ("_tw_first", "_tw_chg", "_tw_run", "_fc", "_off")]
    if turn != LAID_ORDER or block_rows is not None:
        out.remove(BLOCK)
    return d.select(*out, shift.alias("topic_shift"), seg.alias(SEG))


def change_flag(df: DataFrame, col: str = SEG, scope: str = "conversation",
                conv: str = CONV, turn: str = TURN, out: str = "sub_convo_change",
                pos: str | None = None) -> DataFrame:
    """1 where ``col`` differs from the previous row, null-safe.

    ``scope='conversation'``: the previous row of the same conversation (first
    row is 1).  ``scope='global'``: the previous row of the whole table in
    (conversation, turn) order, or ``pos`` if given (first row of the table is 1).
    """
    if scope == "conversation":
        d = with_prev(df, [conv], turn, [col, turn], prefix="_p_")
        first = F.col("_p_" + turn).isNull()
    elif scope == "global":
        d = df if pos else with_position(df, [conv, turn], "_tw_pos")
        p = pos or "_tw_pos"
        d = with_prev(d, [], p, [col, p], prefix="_p_")
        first = F.col("_p_" + p).isNull()
        if not pos:
            d = d.drop("_tw_pos")
    else:
        raise ValueError("scope must be 'conversation' or 'global'")
    d = d.withColumn(out, F.when(first, 1)
                     .when(~F.col(col).eqNullSafe(F.col("_p_" + col)), 1)
                     .otherwise(0).cast("int"))
    return d.drop(*[c for c in d.columns if c.startswith("_p_")])


def boundaries(df: DataFrame, label, out, scope: str = "conversation",
               conv: str = CONV, turn: str = TURN, pos: str | None = None) -> DataFrame:
    """0 on the first row, then 1 where ``label`` differs from the previous row.

    Both edges of a run count: ``0 1 0`` has two boundaries.  ``label`` and
    ``out`` may be lists: all labels are scanned in one pass.
    """
    labels = [label] if isinstance(label, str) else list(label)
    outs = [out] if isinstance(out, str) else list(out)
    if scope == "conversation":
        d = with_prev(df, [conv], turn, labels, prefix="_p_")
    elif scope == "global":
        d = df if pos else with_position(df, [conv, turn], "_tw_pos")
        d = with_prev(d, [], pos or "_tw_pos", labels, prefix="_p_")
        if not pos:
            d = d.drop("_tw_pos")
    else:
        raise ValueError("scope must be 'conversation' or 'global'")
    for lab, o in zip(labels, outs):
        prev = F.coalesce(F.col("_p_" + lab), F.col(lab))
        d = d.withColumn(o, F.when(prev != F.col(lab), 1).otherwise(0).cast("int"))
    return d.drop(*["_p_" + lab for lab in labels])


def boundary_positions(df: DataFrame, flag: str, pos: str) -> DataFrame:
    """The positions of rows whose boundary flag is 1."""
    return df.filter(F.col(flag) == 1).select(pos)


def with_turn_position(df: DataFrame, conv: str = CONV, turn: str = TURN,
                       out: str = "pos") -> DataFrame:
    """0-based position of each turn inside its conversation."""
    d = ordered_scan(df, [conv], turn, sums={out: F.lit(1)})
    return d.withColumn(out, F.col(out) - 1)


def keep(df: DataFrame, *cols) -> DataFrame:
    """``df.select(*cols)`` that does not lose the block column of a laid out table."""
    return df.select(*cols, *([BLOCK] if BLOCK in df.columns else []))


def _shift_runs(df: DataFrame, conv: str, turn: str, shift: str) -> DataFrame:
    """Runs that start at a shift: ``(conv, run, all_runs, run_len)`` with run = 1, 2, ..., all_runs.

    Every turn belongs to the run of the last shift at or before it (run 0:
    turns before the first shift).  The gap between shift ``k`` and shift
    ``k+1``, in turn positions, is the length of run ``k``.
    """
    s = F.when(F.col(shift) == 1, 1).otherwise(0)
    d = ordered_scan(keep(df, conv, turn, s.alias("_s")), [conv], turn, sums={"run": "_s"}, totals={"all_runs": "_s"})
    return d.groupBy(conv, "run", "all_runs").agg(F.count(F.lit(1)).alias("run_len"))


def shift_gaps(df: DataFrame, conv: str = CONV, turn: str = TURN,
               shift: str = "topic_shift") -> DataFrame:
    """Gaps (in turn positions) between successive shifts of each conversation.

    Long form ``(conversation_id, gap_index, turn_diff)``: a conversation's
    list of gaps is never collected into one row.
    """
    g = _shift_runs(df, conv, turn, shift).filter((F.col("run") >= 1) & (F.col("run") < F.col("all_runs")))
    return g.select(conv, (F.col("run") - 1).cast("long").alias("gap_index"),
                    F.col("run_len").cast("long").alias("turn_diff"))


def shift_stats(df: DataFrame, conv: str = CONV, turn: str = TURN,
                shift: str = "topic_shift") -> DataFrame:
    """Per conversation the number of shifts, and of gaps equal to 1 and above 1.

    Every conversation appears, also one without shifts.
    """
    # the last run has no following shift: it is not a gap
    gap = (F.col("run") >= 1) & (F.col("run") < F.col("all_runs"))
    return _shift_runs(df, conv, turn, shift).groupBy(conv).agg(
        F.max("run").cast("long").alias("total_shifts"),
        F.count_if(gap & (F.col("run_len") == 1)).alias("single_turn_shifts"),
        F.count_if(gap & (F.col("run_len") > 1)).alias("multi_turn_shifts"),
        F.count_if(gap).alias("len_turn_diffs"))


def single_turn_ratio(stats: DataFrame, out: str = "single_turn_ratio") -> DataFrame:
    """Share of gaps equal to 1, rounded to 3 digits; 0 when no gaps.

    Rounded as Python rounds the quotient: to the nearest thousandth of the binary number.  That is
    decided on integer counts; only where the share is half-way between two thousandths does it
    depend on whether the binary number lies above or below (0.7005 above, 0.0625 on the spot).
    """
    s, n = F.col("single_turn_shifts").cast("long"), F.col("len_turn_diffs").cast("long")
    halves = F.expr("2000 * single_turn_shifts DIV len_turn_diffs")  # of a thousandth, whole ones
    down = F.expr("1000 * single_turn_shifts DIV len_turn_diffs")
    on_tie = (halves % 2 == 1) & (2000 * s == halves * n)
    shift = F.when(halves < 4, F.lit(66)).otherwise(F.lit(62))  # so that the binary number becomes whole
    binary = ((halves / F.lit(2000.0)) * F.pow(F.lit(2.0), shift)).cast("long").cast("decimal(19,0)") * F.lit(2000).cast("decimal(4,0)")
    exact = halves.cast("decimal(10,0)") * F.pow(F.lit(2.0), shift - 6).cast("long").cast("decimal(19,0)") * F.lit(64).cast("decimal(2,0)")
    up = F.when(on_tie, F.when(binary > exact, 1).when(binary < exact, 0).otherwise(down % 2)).otherwise(halves % 2)
    r = F.when(n > 0, (down + up) / F.lit(1000.0)).otherwise(F.lit(0.0))
    return stats.withColumn(out, r.cast("double"))


def with_history(df: DataFrame, scope: str = "segment", out: str = "history",
                 conv: str = CONV, seg: str = SEG, turn: str = TURN) -> DataFrame:
    """Earlier messages (turn id strictly lower) joined by a space.

    ``scope='segment'`` is the reference (history restarts at each segment, so an
    empty history reveals a shift); ``scope='conversation'`` does not leak.
    The history text grows with the square of the segment length.
    """
    part = [conv, seg] if scope == "segment" else [conv]
    if scope not in ("segment", "conversation"):
        raise ValueError("scope must be 'segment' or 'conversation'")
    w = Window.partitionBy(*part).orderBy(F.col(turn)).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.concat_ws(" ", F.collect_list("message").over(w)))


def model_input(df: DataFrame, history: str = "history", message: str = "message",
                out: str = "input_text") -> DataFrame:
    """``History: {h} New message: {m}``."""
    return df.withColumn(out, F.concat(F.lit("History: "), F.coalesce(F.col(history), F.lit("")),
                                       F.lit(" New message: "), F.col(message)))


def turn_pairs(df: DataFrame, conv: str = CONV, turn: str = TURN) -> DataFrame:
    """Each turn with the message before it (turns with a predecessor only)."""
    d = with_prev(df, [conv], turn, ["message", turn], prefix="_p_")
    return d.filter(F.col("_p_" + turn).isNotNull()) \
            .withColumnRenamed("_p_message", "message_1") \
            .withColumn("message_2", F.col("message")) \
            .drop("_p_" + turn)


def token_budget(df: DataFrame, col: str, n: int, side: str = "right",
                 out: str | None = None) -> DataFrame:
    """Keep ``n`` white-space tokens of ``col``."""
    return df.withColumn(out or col, truncate_tokens(col, n, side))


def history_tokens(df: DataFrame, n: int, scope: str = "segment", side: str = "right", out: str = "history_tokens",
                   conv: str = CONV, seg: str = SEG, turn: str = TURN, message: str = "message") -> DataFrame:
    """W7 + W10 in bounded size: the first (``side='right'``) or last (``'left'``) ``n`` white-space
    tokens of all earlier messages, as an array.

    What a run of messages contributes to either is a list of at most ``n`` tokens, and two runs'
    lists give the list of both.  Inside a block a row's list comes from a window that reaches over
    ``n`` tokens, not over all messages; a block hands its own list on, and the lists of earlier
    blocks reach the rows by (group, block).  No row holds more than ``2 n`` tokens at any time.
    """
    if scope not in ("segment", "conversation"):
        raise ValueError("scope must be 'segment' or 'conversation'")
    if side not in ("right", "left"):
        raise ValueError("side must be 'right' or 'left'")
    part = [conv, seg] if scope == "segment" else [conv]
    laid = BLOCK in df.columns and turn == LAID_ORDER
    b = BLOCK if laid else "_tw_hb"
    tok = F.coalesce(whitespace_tokens(message), F.array().cast("array<string>"))
    cut = (lambda c: F.slice(c, 1, n)) if side == "right" else (lambda c: F.when(F.size(c) > n, F.slice(c, -n, n)).otherwise(c))
    none = F.array().cast("array<string>")
    d = df if laid else df.withColumn(b, block_of(df, turn))
    d = d.withColumn("_tw_tok", tok).withColumn("_tw_nt", F.size("_tw_tok").cast("long"))
    if side == "right":
        # Only messages that start among the first n tokens of the group can be seen later.
        d = ordered_scan(d, part, turn, sums={"_tw_end": "_tw_nt"})
        seen = (F.col("_tw_nt") > 0) & (F.col("_tw_end") - F.col("_tw_nt") < n)
    else:
        seen = F.col("_tw_nt") > 0
    d = d.withColumn("_tw_piece", F.when(seen, cut(F.col("_tw_tok")))).drop("_tw_tok")
    w, wb = Window.partitionBy(*part, b), Window.partitionBy(*part)
    earlier = lambda win: win.rowsBetween(Window.unboundedPreceding, -1)
    if side == "right":
        d = d.withColumn("_tw_in", F.flatten(F.collect_list("_tw_piece").over(earlier(w.orderBy(turn)))))
        mine = F.array_sort(F.collect_list(F.when(F.col("_tw_piece").isNotNull(), F.struct(F.col(turn).alias("t"), F.col("_tw_piece").alias("p")))))
        blocks = d.groupBy(*part, b).agg(F.flatten(F.transform(mine, lambda x: x["p"])).alias("_tw_list"))
        blocks = blocks.select(*part, b, F.flatten(F.collect_list("_tw_list").over(earlier(wb.orderBy(b)))).alias("_tw_before"))
    else:
        # After a row: the messages whose last token is among the last n so far.
        d = d.withColumn("_tw_at", F.sum("_tw_nt").over(w.orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)))
        d = d.withColumn("_tw_now", cut(F.flatten(F.collect_list("_tw_piece").over(w.orderBy("_tw_at").rangeBetween(-(n - 1), 0)))))
        d = d.withColumn("_tw_in", F.coalesce(F.lag("_tw_now").over(w.orderBy(turn)), none))
        blocks = d.groupBy(*part, b).agg(F.sum("_tw_nt").alias("_tw_total"), F.max_by("_tw_now", turn).alias("_tw_list"))
        blocks = blocks.withColumn("_tw_list", F.when(F.col("_tw_total") > 0, F.col("_tw_list"))) \
                       .withColumn("_tw_at", F.sum("_tw_total").over(wb.orderBy(b).rowsBetween(Window.unboundedPreceding, 0)))
        blocks = blocks.withColumn("_tw_now", cut(F.flatten(F.collect_list("_tw_list").over(wb.orderBy("_tw_at").rangeBetween(-(n - 1), 0)))))
        blocks = blocks.select(*part, b, F.coalesce(F.lag("_tw_now").over(wb.orderBy(b)), none).alias("_tw_before"))
    d = d.join(blocks, [*part, b], "left")
    both = cut(F.concat(F.coalesce("_tw_before", none), F.coalesce("_tw_in", none)))
    return d.select(*df.columns, both.alias(out))


def budgeted_model_input(df: DataFrame, n_tokens: int, scope: str = "segment", out: str = "input_text",
                         conv: str = CONV, seg: str = SEG, turn: str = TURN, message: str = "message",
                         side: str = "right") -> DataFrame:
    """W7 + W8 + W10 in bounded size: ``n_tokens`` white-space tokens of
    ``History: {h} New message: {m}``.

    ``side='right'`` keeps the first tokens, as a right-truncating tokenizer does; ``'left'`` keeps
    the last ones: the new message and the newest history, oldest history dropped first.  Equal to
    truncating the full model input, without building the quadratic history.
    """
    d = history_tokens(df, n_tokens, scope, side, "_tw_hist", conv, seg, turn, message)
    words = F.concat(F.array(F.lit("History:")), F.col("_tw_hist"), F.array(F.lit("New"), F.lit("message:")), whitespace_tokens(message))
    kept = F.slice(words, 1, n_tokens) if side == "right" else F.when(F.size(words) > n_tokens, F.slice(words, -n_tokens, n_tokens)).otherwise(words)
    return d.withColumn(out, F.array_join(kept, " ")).drop("_tw_hist")
