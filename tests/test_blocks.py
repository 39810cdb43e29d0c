"""Block-wise scans, group values and bounded histories against brute force, on one hot conversation."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from turnwise.operators import pairs, segment
from turnwise.plans.scan import hand_back, laid_out, ordered_scan


@pytest.fixture(params=["2", "65536"])
def blocks(spark, request):
    spark.conf.set("turnwise.scan.blockRows", request.param)
    yield int(request.param)
    spark.conf.unset("turnwise.scan.blockRows")


def turns(n_hot=200, seed=7):
    rnd = random.Random(seed)
    rows = [(0, t, rnd.randint(0, 9) if rnd.random() < 0.7 else None) for t in range(n_hot)]
    rows += [(c, t, rnd.randint(0, 9) if rnd.random() < 0.7 else None) for c in range(1, 15) for t in range(rnd.randint(1, 9))]
    return rows


@pytest.mark.parametrize("laid", [False, True])
@pytest.mark.parametrize("whole", [False, True])
def test_every_kind_of_scan(spark, blocks, laid, whole):
    """``whole``: one sequence over the table; with blocks of two its block tables form a tree of seven levels."""
    rows = [(0, k, v) for k, (_, _, v) in enumerate(turns(120))] if whole else turns()
    df = spark.createDataFrame(rows, "conversation_id long, turn_id long, v int")
    if laid:
        df = laid_out(df, ["conversation_id"])
    part = [] if whole else ["conversation_id"]
    got = ordered_scan(df, part, "turn_id", prev=["v"], nxt=["v"], sums={"run": "v"}, totals={"all": "v", "n": F.lit(1)},
                       last={"seen": F.when(F.col("v") > 6, F.col("turn_id"))}, coming={"next_seen": F.when(F.col("v") > 6, F.col("turn_id"))},
                       group_max={"top": "v"}, group_min={"low": "v"})
    want = set()
    groups = defaultdict(list)
    for c, t, v in rows:
        groups[c].append((t, v))
    for c, g in groups.items():
        vs = [v for _, v in g if v is not None]
        for i, (t, v) in enumerate(g):
            big = [x for x, y in g if y is not None and y > 6]
            want.add((c, t, v, g[i - 1][1] if i else None, g[i + 1][1] if i + 1 < len(g) else None, sum(y or 0 for _, y in g[:i + 1]), sum(vs), len(g),
                      max((x for x in big if x <= t), default=None), min((x for x in big if x >= t), default=None), max(vs, default=None), min(vs, default=None)))
    assert {tuple(r) for r in got.select("conversation_id", "turn_id", "v", "prev_v", "next_v", "run", "all", "n", "seen", "next_seen", "top", "low").collect()} == want


def test_hand_back(spark, blocks):
    rows = turns()
    df = spark.createDataFrame(rows, "conversation_id long, turn_id long, v int")
    values = spark.createDataFrame([(0, "hot", 1), (3, None, 2)], "conversation_id long, name string, k int")
    got = hand_back(df, ["conversation_id"], "turn_id", values, ["name", "k"]).collect()
    assert {tuple(r) for r in got} == {(c, t, v, {0: "hot"}.get(c), {0: 1, 3: 2}.get(c)) for c, t, v in rows} and len(got) == len(rows)


def talk(n_hot=60, seed=3):
    rnd = random.Random(seed)
    rows = []
    for c in range(6):
        seg = 0
        for t in range(n_hot if c == 0 else rnd.randint(1, 8)):
            shift = int(t == 0 or rnd.random() < 0.3)
            seg += shift and t > 0
            words = " ".join(f"w{rnd.randint(0, 5)}" for _ in range(rnd.choice([0, 1, 1, 2, 9])))
            rows.append((c, int(seg), t, shift, rnd.choice([None, "", words, words, words])))
    return rows


SCHEMA = "conversation_id long, sub_conversation_id long, turn_id long, topic_shift int, message string"


@pytest.mark.parametrize("scope", ["segment", "conversation"])
@pytest.mark.parametrize("side", ["left", "right"])
@pytest.mark.parametrize("n", [5, 1000])
def test_budget_is_the_truncated_full_text(spark, blocks, scope, side, n):
    rows = talk()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r[0], r[1]): r[2] for r in segment.budgeted_model_input(df, n, scope, side=side).select("conversation_id", "turn_id", "input_text").collect()}
    for c, s, t, _, m in rows:
        earlier = [x[4] for x in rows if x[0] == c and x[2] < t and (scope == "conversation" or x[1] == s) and x[4] is not None]
        words = None if m is None else f"History: {' '.join(earlier)} New message: {m}".split()
        assert got[c, t] == (None if words is None else " ".join(words[:n] if side == "right" else words[-n:]))


def partners(rows, family):
    out = defaultdict(list)
    for c, s, t, _, m in rows:
        first = {}
        for x in rows:
            if x[0] == c:
                first.setdefault(x[1], x[2])
        for c2, s2, t2, shift2, m2 in rows:
            if c2 == c and {"coherence_positive": s2 == s and t2 > t, "coherence_negative": first[s2] > first[s],
                            "shift_positive": s2 == s and m is not None and m2 is not None and m2 != m,
                            "shift_negative": t2 > t and shift2 == 1}[family]:
                out[c, s, t].append((t2, m, m2))
    return out


@pytest.mark.parametrize("family", list(pairs.RULES))
def test_drawn_pairs(spark, blocks, family):
    """All partners for a large number, exactly min(k, n) distinct ones for a small one, the same for any layout."""
    rows = talk(30)
    df, want = spark.createDataFrame(rows, SCHEMA), partners(rows, family)
    every = pairs.drawn_pairs(df, family, 10_000).collect()
    assert sorted(map(str, ((*k, *p) for k, v in want.items() for p in v))) == \
        sorted(str((r["conversation_id"], r["sub_conversation_id"], r["turn_id"], r["partner_turn_id"], r["message1"], r["message2"])) for r in every)
    some = pairs.drawn_pairs(df, family, 2, seed=5)
    got = defaultdict(set)
    for r in some.collect():
        got[r["conversation_id"], r["sub_conversation_id"], r["turn_id"]].add(r["partner_turn_id"])
    assert {k: len(v) for k, v in got.items()} == {k: min(2, len(v)) for k, v in want.items()}
    assert all(v <= {p[0] for p in want[k]} for k, v in got.items())
    again = pairs.drawn_pairs(laid_out(df.repartition(3), ["conversation_id"]), family, 2, seed=5)
    assert sorted(map(str, some.collect())) == sorted(map(str, again.select(some.columns).collect()))


def test_permutation(spark):
    """A permutation for every n, with all values equally likely at each place."""
    df = spark.range(400).selectExpr("id AS a", "explode(array(1, 2, 7, 10, 64)) AS n").selectExpr("a", "n", "explode(sequence(0, n - 1)) AS i")
    got = df.withColumn("x", pairs.permuted(F.col("i"), F.col("n"), [F.lit("1"), F.col("a")])).collect()
    by = defaultdict(list)
    for r in got:
        by[r["a"], r["n"]].append(r["x"])
    assert all(sorted(v) == list(range(n)) for (_, n), v in by.items())
    for n in (7, 10):
        for place in (0, n - 1):
            seen = Counter(r["x"] for r in got if r["n"] == n and r["i"] == place)
            assert all(0.5 < seen[x] / (400 / n) < 1.6 for x in range(n)), seen
    assert len({tuple(v) for (_, n), v in by.items() if n == 10}) > 350


def test_ratio_rounds_like_python(spark):
    cases = [(s, n) for n in range(1, 130) for s in range(n + 1)] + [(s, 2000) for s in range(2001)] + [(0, 0), (1401, 2000), (7, 16), (10**9 + 1, 2 * 10**9)]
    df = spark.createDataFrame(cases, "single_turn_shifts long, len_turn_diffs long")
    for r in segment.single_turn_ratio(df).collect():
        s, n = r["single_turn_shifts"], r["len_turn_diffs"]
        assert r["single_turn_ratio"] == (round(s / n, 3) if n else 0), (s, n)


def test_shift_positive_counts(spark, blocks):
    """J7 counts, of conversations inside one block and of others in one table, silent turns included."""
    rows = talk(30)
    want = partners(rows, "shift_positive")
    got = pairs.shift_positive(laid_out(spark.createDataFrame(rows, SCHEMA), ["conversation_id"])).collect()
    assert {tuple(r)[:3]: r["n_pairs"] for r in got} == {x[:3]: len(want[x[:3]]) for x in rows} and len(got) == len(rows)


def test_what_follows_a_row_costs_no_square(spark):
    """``coming`` and group minima add up in one direction: no frame is taken anew for every row."""
    df = spark.range(200_000).select(F.lit(1).alias("conversation_id"), F.col("id").alias("turn_id"))
    for part in ([], ["conversation_id"]):
        d = ordered_scan(df, part, "turn_id", coming={"next_ten": F.when(F.col("turn_id") % 10 == 0, F.col("turn_id"))})
        assert "1, unboundedfollowing" not in d._jdf.queryExecution().executedPlan().toString()
        assert d.where("next_ten = (turn_id + 9) div 10 * 10").count() == 199_991  # none after 199,990
