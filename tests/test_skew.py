"""A hot conversation (most of the rows) against a brute-force pandas answer.

With 64-turn blocks the hot conversation spans dozens of blocks, so every
carry between blocks is exercised; the plan must not window on the
conversation alone.
"""

import random

import pandas as pd
import duckdb
import pytest

from turnwise.operators import pairs, segment
from turnwise.plans.scan import with_next, with_prev, with_running_sum


@pytest.fixture()
def hot(spark):
    spark.conf.set("turnwise.scan.blockRows", "64")
    rnd = random.Random(7)
    rows = []
    for t in range(3000):  # the hot conversation
        rows.append((0, t, rnd.choice("abc"), f"m{rnd.randint(0, 40)}"))
    for c in range(1, 40):
        for t in range(rnd.randint(1, 9)):
            rows.append((c, t, rnd.choice("ab"), f"m{rnd.randint(0, 5)}"))
    yield rows, spark.createDataFrame(rows, "conversation_id long, turn_id long, k string, message string")
    spark.conf.unset("turnwise.scan.blockRows")


def _brute(rows):
    pdf = pd.DataFrame(rows, columns=["conversation_id", "turn_id", "k", "message"])
    pdf = pdf.sort_values(["conversation_id", "turn_id"]).reset_index(drop=True)
    g = pdf.groupby("conversation_id")
    prev = g["k"].shift(1)
    pdf["topic_shift"] = ((prev != pdf["k"]) | prev.isna()).astype(int)
    pdf["sub_conversation_id"] = pdf.groupby("conversation_id")["topic_shift"].cumsum() - 1
    return pdf


def test_scans_match_brute_force(spark, hot):
    rows, df = hot
    pdf = _brute(rows)
    got = with_prev(df, ["conversation_id"], "turn_id", ["k"], prefix="p_")
    got = with_next(got, ["conversation_id"], "turn_id", ["k"], prefix="n_")
    got = with_running_sum(got, ["conversation_id"], "turn_id", "turn_id", "rs").toPandas()
    got = got.sort_values(["conversation_id", "turn_id"]).reset_index(drop=True)
    g = pdf.groupby("conversation_id")
    assert got["p_k"].fillna("-").tolist() == g["k"].shift(1).fillna("-").tolist()
    assert got["n_k"].fillna("-").tolist() == g["k"].shift(-1).fillna("-").tolist()
    assert got["rs"].tolist() == g["turn_id"].cumsum().tolist()


def test_segmentation_and_stats_match_brute_force(spark, hot):
    rows, df = hot
    pdf = _brute(rows)
    seg = segment.segment_by_key(df, "k").toPandas().sort_values(["conversation_id", "turn_id"])
    assert seg["topic_shift"].tolist() == pdf["topic_shift"].tolist()
    assert seg["sub_conversation_id"].tolist() == pdf["sub_conversation_id"].tolist()
    st = segment.shift_stats(segment.segment_by_key(df, "k")).toPandas().set_index("conversation_id")
    want = duckdb.sql("""
        WITH s AS (SELECT conversation_id, turn_id, lead(turn_id) OVER (PARTITION BY conversation_id ORDER BY turn_id) - turn_id AS gap
                   FROM pdf WHERE topic_shift = 1)
        SELECT conversation_id, count(*) AS shifts, count(*) FILTER (gap = 1) AS single, count(*) FILTER (gap > 1) AS multi
        FROM s GROUP BY ALL""").df().set_index("conversation_id")
    st = st.loc[want.index]
    assert st["total_shifts"].tolist() == want["shifts"].tolist()
    assert st["single_turn_shifts"].tolist() == want["single"].tolist()
    assert st["multi_turn_shifts"].tolist() == want["multi"].tolist()


def test_pair_counts_match_brute_force(spark, hot):
    rows, df = hot
    pdf = _brute(rows)
    seg = segment.segment_by_key(df, "k")
    got = pairs.shift_negative(seg).toPandas().sort_values(["conversation_id", "turn_id"])
    exp = []
    for _, grp in pdf.groupby("conversation_id"):
        s = grp["topic_shift"].to_numpy()
        tail = s[::-1].cumsum()[::-1]
        exp += [int(tail[i] - s[i]) for i in range(len(s))]
    assert got["n_pairs"].tolist() == exp


def test_plan_windows_on_blocks(spark, hot):
    _, df = hot
    plan = segment.segment_by_key(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert "_tw_blk" in plan
    assert "SinglePartition" not in plan
