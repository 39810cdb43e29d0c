"""Physical plans, of results and of tables written on the way.

* No window over the whole table except the declared bounded ones: the per-partition counts of
  range positions (``_tw_pid``) and the last level of a tree of block tables (``_tw_b<level>``,
  at most ``block_rows`` rows).
* Group values reach rows block by block: no join of rows by the conversation alone.
* Scans of one ordering share it.
"""

import re

import pytest
from conftest import SF001

from turnwise import session

ALLOWED_ORDER = ("_tw_pid", "_tw_b")


def plans_of(fn, spark) -> list[str]:
    """Plans of the tables written while the query is built, and of its result."""
    seen = []
    session.on_write = lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString())
    try:
        df = fn(spark, SF001)
    finally:
        session.on_write = None
    return [*seen, df._jdf.queryExecution().executedPlan().toString()]


def unpartitioned_windows(plan: str) -> list[str]:
    out = []
    for m in re.finditer(r"windowspecdefinition\(([^,()]+)", plan):
        first = m.group(1)
        if " ASC " in first + " " or " DESC " in first + " ":
            out.append(first.strip())
    return out


def join_keys(plan: str) -> list[list[str]]:
    """Left keys of every sort-merge, shuffled or broadcast join."""
    return [[k.split("#")[0].strip() for k in m.group(1).split(",")] for m in re.finditer(r"Join \[([^\]]*)\], \[", plan)]


def test_parsers():
    p = ("Window [sum(_tw_n#68L) windowspecdefinition(_tw_pid#79 ASC NULLS FIRST, specifiedwindowframe("
         "RowFrame, unboundedpreceding$(), -1)) AS _we0#76L], [_tw_pid#79 ASC NULLS FIRST]\n"
         "Window [lag(k#1, -1, null) windowspecdefinition(conversation_id#4L, _tw_blk#5L, turn_id#6L ASC "
         "NULLS FIRST, specifiedwindowframe(RowFrame, -1, -1)) AS p#7]")
    assert unpartitioned_windows(p) == ["_tw_pid#79 ASC NULLS FIRST"]
    assert join_keys("SortMergeJoin [a#1L, _tw_blk#2], [a#3L, _tw_blk#4], Inner") == [["a", "_tw_blk"]]


def test_no_single_task_windows(spark):
    import __spark_entry__ as E
    bad, seen = {}, 0
    for name, fn in E.queries().items():
        for plan in plans_of(fn, spark):
            for order in unpartitioned_windows(plan):
                seen += 1
                if not order.startswith(ALLOWED_ORDER):
                    bad.setdefault(name, []).append(order)
    assert not bad, bad
    assert seen > 0  # the declared ones (positions, last levels of block tables) are found


# Queries whose operators give a value of a conversation (or segment) back to its turns.
HOT = ["p7_drop_trailing", "p8_cap_turns_drop_busy", "p10_reset_first_row", "j1_keep_steady", "j1_keep_steady_events",
       "j5_coherence_positive", "j6_coherence_negative", "j7_shift_positive", "j8_shift_negative", "j9_label_pairs", "j5_drawn_pairs",
       "j6_drawn_pairs", "j7_drawn_pairs", "j8_drawn_pairs", "w5_shift_stats", "w5_shift_gaps", "w10_budgeted_model_input", "w10_newest_first",
       "x1_tfidf", "x1_tfidf_global", "x2_consecutive_tfidf", "m12_segmentation_report_conversation", "w1_segment_events"]


@pytest.mark.parametrize("name", HOT)
def test_no_join_by_the_conversation_alone(spark, name):
    """Broadcasts off, so that every join shows its keys."""
    import __spark_entry__ as E
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for plan in plans_of(E.queries()[name], spark):
            for keys in join_keys(plan):
                assert not set(keys) <= {"conversation_id", "user_id", "sub_conversation_id", "term"}, keys
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# Planned hash exchanges of rounds before, with every scan on its own; now at most a third, writes included.
BEFORE = {"w5_shift_stats": 21, "j1_keep_steady": 24, "q1_non_alternating": 34, "x2_consecutive_tfidf": 26,
          "x4_shift_pairs": 30, "j9_label_pairs": 74, "m12_segmentation_report_conversation": 63}


@pytest.mark.parametrize("name", BEFORE)
def test_chained_scans_share_their_ordering(spark, name):
    import __spark_entry__ as E
    n = sum(p.count("Exchange hashpartitioning") for p in plans_of(E.queries()[name], spark))
    assert n <= BEFORE[name] / 3, n


WORKED_OUT = "regexp_extract_all"


@pytest.mark.parametrize("name", ["m11_boundary_mae", "m12_segmentation_report"])
def test_labels_are_stored_before_they_are_ordered(spark, name):
    """Range bounds are sampled from what is dealt: that must be stored labels, not the work that makes them."""
    import __spark_entry__ as E
    made = [p for p in plans_of(E.queries()[name], spark) if WORKED_OUT in p]
    assert len(made) == 1 and "rangepartitioning" not in made[0]


def test_labels_of_a_conversation_are_worked_out_once(spark):
    import __spark_entry__ as E
    made = [p for p in plans_of(E.queries()["m12_segmentation_report_conversation"], spark) if WORKED_OUT in p]
    assert len(made) == 1 and made[0].count("Window") < 10  # one scan of the turns


@pytest.mark.parametrize("name", ["j7_shift_positive", "j7_drawn_pairs", "j9_contrastive_pairs"])
def test_partners_in_a_block_meet_without_an_exchange(spark, name):
    """Of the stored rows only the block table (no message) is dealt anew."""
    import __spark_entry__ as E
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        *_, result = plans_of(E.queries()[name], spark)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = result.splitlines()
    after = [lines[i + 1] for i, x in enumerate(lines) if "Exchange " in x]
    assert all("message" not in x and "Aggregate" in x or "Window [" in x and "message" not in x or "Project [" in x and "message" not in x for x in after), after
    assert "rangepartitioning" not in result
    # A draw hashes its bits alone: starts and shifts of the permutation are made once an anchor.
    assert not any("Generate" in x and "conv(" in x for x in lines)
