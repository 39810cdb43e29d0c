"""Worked examples F1-F6 (hand-checkable values)."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from turnwise.operators import clean, losses, metrics, pairs, profile, segment, similarity
from turnwise.sources import readers

TURNS = "conversation_id long, turn_id long, message string, k string"


def test_f1_transcript_parsing(spark):
    lines = ["User 1: Hi! I'm [user 1's name].", "User 2: Café, ok (yes)?", "",
             "*User 1*: It's 10:30 User 1: again", "user 2: lower", "User 10: no", "Note: skip", "User 2 :"]
    blob = lines[0] + "\r\n" + "\n".join(lines[1:])
    df = spark.createDataFrame([(7, blob)], "cid long, blob string")
    out = readers.parse_transcript(df, "cid", "blob").orderBy("turn_id").collect()
    assert [(r.turn_id, r.user, r.message) for r in out] == [
        (0, "User 1", "Hi! Im user 1s name."), (1, "User 2", "Caf ok yes?"),
        (2, "User 1", "Its 1030 again"), (3, "User 2", "")]


# Worked conversation of the TF-IDF example (fixture text).
F2_MESSAGES = [
    "The river rose after three days of rain.",
    "After three days of rain the river usually does.",
    "Our bridge was closed, so we walked north.",
    "Walking north takes an hour!",
    "An hour is fine if the weather holds.",
    "Has anyone fed the goats?",
    "The goats, the hens and the old donkey.",
    "Hens lay fewer eggs in winter",
]


def f2_expected():
    """Cosines of neighbours from the TF-IDF formula, with plain dictionaries."""
    docs = [collections.Counter(re.findall(r"\w\w+", m.lower())) for m in F2_MESSAGES]
    df = collections.Counter(w for d in docs for w in d)
    vec = [{w: n * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w, n in d.items()} for d in docs]
    dot = lambda a, b: sum(x * b.get(w, 0) for w, x in a.items())
    return [dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)) for a, b in zip(vec, vec[1:])]


@pytest.mark.parametrize("blocks", [False, True])
def test_f2_tfidf_consecutive_cosine(spark, blocks, request):
    if blocks:
        request.getfixturevalue("small_blocks")
    df = spark.createDataFrame([(1, i, m) for i, m in enumerate(F2_MESSAGES)],
                               "conversation_id long, turn_id long, message string")
    s = similarity.consecutive_tfidf(df).orderBy("turn_id").collect()
    expected = f2_expected()
    assert [r.similarity for r in s] == pytest.approx(expected, abs=1e-9)
    shifts = similarity.shifts_below(similarity.consecutive_tfidf(df), 0.1).select("turn_id").collect()
    assert sorted(r.turn_id for r in shifts) == [i for i, x in enumerate(expected) if x < 0.1]


def _f3(spark):
    keys = ["A", "A", "B", "B", "A"]
    df = spark.createDataFrame([(1, i, f"m{i}", k) for i, k in enumerate(keys)], TURNS)
    return segment.segment_by_key(df, "k")


@pytest.mark.parametrize("blocks", [False, True])
def test_f3_segmentation(spark, blocks, request):
    if blocks:
        request.getfixturevalue("small_blocks")
    seg = _f3(spark).orderBy("turn_id").collect()
    assert [r.topic_shift for r in seg] == [1, 0, 1, 0, 1]
    assert [r.sub_conversation_id for r in seg] == [0, 0, 1, 1, 2]
    st = segment.single_turn_ratio(segment.shift_stats(_f3(spark))).collect()[0]
    assert (st.total_shifts, st.single_turn_shifts, st.multi_turn_shifts, st.len_turn_diffs) == (3, 0, 2, 2)
    assert st.single_turn_ratio == 0.0
    gaps = segment.shift_gaps(_f3(spark)).orderBy("gap_index").collect()
    assert [r.turn_diff for r in gaps] == [2, 2]


@pytest.mark.parametrize("blocks", [False, True])
def test_f4_pairs(spark, blocks, request):
    if blocks:
        request.getfixturevalue("small_blocks")
    t = _f3(spark)
    tot = {(r.family, r.label): r.n_pairs for r in pairs.pair_totals(pairs.coherence_pairs(t)).collect()}
    assert tot == {("coherence_positive", "positive"): 2, ("coherence_negative", "negative"): 8}
    tot = {(r.family, r.label): r.n_pairs for r in pairs.pair_totals(pairs.shift_aware_pairs(t)).collect()}
    assert tot == {("shift_positive", "positive"): 4, ("shift_negative", "negative"): 6}
    neg = pairs.shift_negative(t).orderBy("turn_id").collect()
    assert [r.n_pairs for r in neg] == [2, 2, 1, 1, 0]


F5_TRUE = [0, 0, 1, 0, 0, 1, 1, 0, 0, 0]
F5_PRED = [0, 1, 0, 0, 0, 1, 0, 0, 0, 1]


def _f5(spark):
    return spark.createDataFrame([(1, i, t, p) for i, (t, p) in enumerate(zip(F5_TRUE, F5_PRED))],
                                 "conversation_id long, turn_id long, y int, p int")


@pytest.mark.parametrize("blocks", [False, True])
def test_f5_boundaries_and_metrics(spark, blocks, request):
    if blocks:
        request.getfixturevalue("small_blocks")
    seq = metrics.sequence_boundaries(_f5(spark), "y", "p").orderBy("pos").collect()
    assert [r.tb for r in seq] == [0, 0, 1, 1, 0, 1, 0, 1, 0, 0]
    assert [r.pb for r in seq] == [0, 1, 1, 0, 0, 1, 1, 0, 0, 1]
    s = metrics.sequence_boundaries(_f5(spark), "y", "p")
    assert metrics.window_size(s).collect()[0].window_size == pytest.approx(1.25)
    e = metrics.window_errors(s, 2).collect()[0]
    assert (e.pk, e.window_diff) == (pytest.approx(0.375), pytest.approx(0.75))
    m = metrics.boundary_mae(s).collect()[0]
    assert m.mae == pytest.approx(0.5)
    rep = {r.class_name: r for r in metrics.classification_report(
        _f5(spark).withColumnRenamed("y", "label").withColumnRenamed("p", "pred")).collect()}
    tp, fp, fn = 1, 2, 2
    assert rep["Topic Shift"].precision == pytest.approx(tp / (tp + fp))
    assert rep["Topic Shift"].recall == pytest.approx(tp / (tp + fn))
    assert rep["No Shift"].support == 7 and rep["accuracy"].f1_score == pytest.approx(0.6)


def test_f5_mae_without_predictions(spark):
    df = spark.createDataFrame([(1, i, t, 0) for i, t in enumerate(F5_TRUE)],
                               "conversation_id long, turn_id long, y int, p int")
    m = metrics.boundary_mae(metrics.sequence_boundaries(df, "y", "p")).collect()[0]
    assert m.mae == 4.0  # four true boundaries, none predicted


def test_f6_losses(spark):
    rows = [(0.2, 1), (0.2, 0), (1.0, 1), (1.0, 0)]
    df = spark.createDataFrame([([0.0, 0.0], [d, 0.0], y) for d, y in rows], "a array<double>, b array<double>, y int")
    got = [r.loss for r in losses.contrastive_rows(df, "a", "b", "y", 1.5, "euclidean").collect()]
    assert got == pytest.approx([0.08, 1.541008, 2.0, 0.974077], abs=1e-6)
    lg = spark.createDataFrame([(0.0, 0.0, 0), (0.0, 0.0, 1), (2.0, -1.0, 0), (2.0, -1.0, 1)],
                               "logit0 double, logit1 double, label int")
    got = [r.f for r in lg.select(losses.focal_col().alias("f")).collect()]
    assert got == pytest.approx([0.043322, 0.129965, 0.000027, 2.07471], abs=1e-5)
    edge = math.log(0.63 / 0.37)
    assert edge == pytest.approx(0.532217, abs=1e-6)
    th = spark.createDataFrame([(0.0, edge - 1e-6), (0.0, edge + 1e-6)], "logit0 double, logit1 double")
    assert [r.pred for r in metrics.predict_threshold(th).collect()] == [0, 1]
    lab = spark.createDataFrame([(0,)] * 7 + [(1,)] * 3, "topic_shift int")
    w = {r.topic_shift: r.weight for r in profile.class_weights(lab).collect()}
    assert w[0] == pytest.approx(0.714286, abs=1e-6) and w[1] == pytest.approx(1.666667, abs=1e-6)


def test_reset_first_turn_variants(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (2, 0, 1)], "conversation_id long, turn_id long, topic_shift int")
    a = {(r.conversation_id, r.turn_id): r.topic_shift for r in clean.reset_first_turn(df).collect()}
    b = {(r.conversation_id, r.turn_id): r.topic_shift for r in clean.reset_first_turn(df, "first_row").collect()}
    assert a == {(1, 1): 1, (1, 2): 0, (2, 0): 0}
    assert b == {(1, 1): 0, (1, 2): 0, (2, 0): 0}


def test_save_pairs_rejects_unknown_format(spark, tmp_path):
    from turnwise.sources import sinks
    df = spark.createDataFrame([("a", "b", "positive")], "message1 string, message2 string, label string")
    with pytest.raises(ValueError):
        sinks.save_pairs(df, str(tmp_path / "x"), "parquet")


def test_pair_distance_rejects_unknown_metric():
    from turnwise.functions.vectors import pair_distance
    with pytest.raises(ValueError):
        pair_distance("a", "b", "manhattan")


def test_keyword_overlap_stopwords(spark):
    df = spark.createDataFrame([("the cat sat", "the cat ran")], "a string, b string")
    r = df.select(similarity.keyword_overlap(F.col("a"), F.col("b"), ["the"]).alias("o")).collect()[0]
    assert r.o == pytest.approx(1 / (3 + 1e-6))


def test_histogram_matches_numpy(spark):
    import numpy as np
    vals = [0.0, 0.05, 0.1, 0.15, 0.3, 0.35, 0.5, 0.55, 0.6, 0.7, 0.95, 1.0, 1.0, 0.333, 0.667]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r["count"] for r in profile.histogram(df, "x", 20).orderBy("bin").collect()]
    exp, _ = np.histogram(vals, bins=20)
    assert got == exp.tolist()
    one = spark.createDataFrame([(0.4,), (0.4,)], "x double")
    got = [r["count"] for r in profile.histogram(one, "x", 20).orderBy("bin").collect()]
    assert got == np.histogram([0.4, 0.4], bins=20)[0].tolist()
