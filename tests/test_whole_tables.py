"""Queries that read every row of their table."""

import __spark_entry__ as E


def test_turn_gaps_over_all_turns(spark, tmp_path):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", "m") for t in range(6)]
    turns += [(2, t, "user" if t % 2 == 0 else "assistant", "m") for t in (0, 1, 3)] + [(3, 0, "user", "m")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conversation_id"]: (r["n_turns"], r["continuous"]) for r in E.queries()["q5_turn_gaps_all"](spark, str(tmp_path)).collect()}
    assert got == {1: (6, 1), 2: (3, 0), 3: (1, 1)}


def test_weak_labels_of_every_turn(spark, tmp_path):
    turns = [(0, t, "user", f"word{t} other{t}") for t in range(4)] + [(900, 0, "user", "a b"), (900, 1, "user", "c d")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    vectors = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (3, [1.0, 0.0], 1)]  # turn 2 and conversation 900 have none
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, shift in (("x8_weak_label_all", 0), ("x8_weak_label_opening_all", 1)):
        got = {(r["conversation_id"], r["turn_id"]): (r["weak_shift"], r["similarity"]) for r in E.queries()[name](spark, str(tmp_path)).collect()}
        assert set(got) == {(c, t) for c, t, *_ in turns}
        assert got[0, shift] == (1, 0.0) and all(v == (0, None) for k, v in got.items() if k != (0, shift))


def test_every_component_of_vectors_of_any_length(spark, tmp_path):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0, 2.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, E.queries()["x9_l2_normalize_all"](spark, str(tmp_path)).collect()))
    assert got == [(1, 0, 0.6), (1, 1, 0.8), (2, 0, 0.0), (2, 1, 0.0), (2, 2, 1.0)]
