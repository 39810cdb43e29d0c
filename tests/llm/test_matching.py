"""Operators 5, 6 and 7 against brute force."""

import hashlib
import re
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from conftest import SF001
from turnwise.llm import decontaminate, fuzzy_lines, simhash
from turnwise.llm.common import components
from turnwise.llm.sql import ORACLE


def unite(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def bits(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_simhash_components(table, request):
    df = request.getfixturevalue(table)
    rows = [(r["doc_id"], bits(r["text"])) for r in df.collect()]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (rows[i][1] ^ rows[j][1]).bit_count() <= 3]
    root = unite(len(rows), links)
    least = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = sorted((str(d), format(f, "016x"), least.get(r)) for (d, f), r in zip(rows, root))
    got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == want


def test_simhash_on_dense_buckets(spark, none):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 12, dtype=np.int64)
    fps = sorted({int(b) ^ sum(1 << int(i) for i in rng.choice(62, rng.integers(0, 5), replace=False)) for b in base for _ in range(60)})
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    want = unite(len(fps), links)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for cell in (8, 2048):  # buckets of many cells, and of one
        found = [(fps.index(r["a"]), fps.index(r["b"])) for r in simhash.near_links(df, 3, cell).collect()]
        assert unite(len(fps), found) == want
    assert simhash.near_duplicates(none).count() == 0


def test_every_close_pair_shares_a_mask():
    masks = simhash.covering_masks(3)
    rng = np.random.default_rng(2)
    for _ in range(2000):
        diff = sum(1 << int(i) for i in rng.choice(64, 3, replace=False))
        assert any(m & diff == 0 for m in masks)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = defaultdict(set)
    for r in got:
        roots[r["root"]].add(r["node"])
    assert sorted(map(sorted, roots.values())) == [list(range(41)), list(range(100, 160))]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def kept_lines(rows):
    """Brute force over all pairs of distinct normalised lines."""
    norm = lambda s: re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", s.lower()).strip(" ")
    places = defaultdict(list)
    for d, t in sorted(rows):
        for i, line in enumerate(t.split("\n")):
            if norm(line):
                places[norm(line)].append((d, i))
    keys = list(places)

    def sign(line):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in line.split(" ")]
        return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h))

    sigs = np.array([sign(k) for k in keys], np.uint64)
    links = []
    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(sigs[:i] ^ sigs[i]) <= 3):
            most = max(len(keys[i]), len(keys[j]))
            if distance(keys[i], keys[j]) <= int(0.2 * most + 1e-9):
                links.append((i, int(j)))
    groups = defaultdict(list)
    for k, r in zip(keys, unite(len(keys), links)):
        groups[r] += places[k]
    gone = {p for g in groups.values() for p in g if p != min(g)}
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}, len(links)


def test_fuzzy_lines(spark, docs, texts, odd, none):
    want, links = kept_lines(texts)
    assert links
    got = fuzzy_lines.dedup_lines(docs).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want
    # As well with split buckets and without a broadcast.
    assert {r["doc_id"]: r["text"] for r in fuzzy_lines.dedup_lines(docs, bucket=16, broadcast_rows=1).collect()} == want
    out = fuzzy_lines.dedup_lines(odd)
    assert out.columns[:len(odd.columns)] == odd.columns and out.count() == odd.count()
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[3]["text"] is None and by[5]["text"] == " \n\t \n" and by[7]["text"] == ""
    assert by[1]["n_removed"] == 0 and by[2]["text"] == "Another line of its own, longer than that."
    assert sum(r["n_removed"] for r in out.where("doc_id = 9").collect()) % 2 == 0  # both rows alike
    assert fuzzy_lines.dedup_lines(none).count() == 0


def test_buckets_of_lines_are_moved_once(spark, texts, monkeypatch):
    """Rows of the buckets (many a line) go through one exchange by bucket, not one to count and one to join."""
    plans, write = {}, fuzzy_lines.stored
    monkeypatch.setattr(fuzzy_lines, "stored", lambda df, name="llm": plans.setdefault(name, []).append(df._jdf.queryExecution().toString()) or write(df, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame(texts[:40], "doc_id long, text string")
        rows = fuzzy_lines.distinct_rows(docs, "doc_id", "text")
        distinct = fuzzy_lines.stored(fuzzy_lines.line_signatures(rows).groupBy("k1", "k2").agg(
            fuzzy_lines.F.min(fuzzy_lines.F.struct("id", "pos", "th")).alias("first")))
        links = spark.createDataFrame([], "a struct<k1:bigint,k2:bigint>, b struct<k1:bigint,k2:bigint>")
        fuzzy_lines.shingled_links(rows, distinct, links, 0.8, 200_000)
        sigs = spark.range(50).selectExpr("id AS sig")
        near = fuzzy_lines.near_heads(fuzzy_lines.in_buckets(sigs))._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_key = [p.split("== Physical Plan ==")[1].count("Exchange hashpartitioning(key#") for n in ("mixed-buckets", "bucket-lines") for p in plans.get(n, [])]
    assert by_key == [1, 1] and near.split("== Physical Plan ==")[1].count("Exchange hashpartitioning(key#") == 1


def test_sketches_lose_no_similar_pair(spark):
    rng = np.random.default_rng(5)
    letters = list("aabcdeé ñ中")
    rows = []
    for n in [*range(1, 12), *rng.integers(12, 200, 150).tolist()]:
        x = rng.choice(letters, n).tolist()
        y = list(x)
        for _ in range(rng.integers(0, n // 5 + 2)):
            i = int(rng.integers(0, len(y) + 1))
            y[i:i + int(rng.integers(0, 2))] = rng.choice(letters, rng.integers(0, 2)).tolist()
        other = rng.choice(letters, n).tolist()
        rows += [("".join(x), "".join(y)), ("".join(y), "".join(x)), ("".join(x), "".join(other))]
    df = spark.createDataFrame(rows, "a string, b string")
    F = fuzzy_lines.F
    side = lambda c: F.struct(F.char_length(c).alias("len"), F.when(F.char_length(c) <= 128, fuzzy_lines.sketch(F.col(c))).alias("grams")).alias(c)
    df = df.select(F.col("a").alias("s"), F.col("b").alias("t"), side("a"), side("b"))
    got = df.withColumn("allowed", fuzzy_lines.sketches_allow("a", "b", 0.8)).collect()
    similar = [distance(r["s"], r["t"]) <= int(0.2 * max(len(r["s"]), len(r["t"])) + 1e-9) for r in got]
    assert sum(similar) > 150 and all(r["allowed"] for r, near in zip(got, similar) if near)
    assert sum(not r["allowed"] for r in got) > 50


def test_unlike_lines_of_a_bucket_make_no_rows(spark, monkeypatch):
    """Lines that only share some word pairs: no row for each two of them, and similar ones are still found."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("bcdfghjklmnprstvwz"), rng.integers(4, 8)))
    texts = [" ".join([word() for _ in range(5)] + ["over the old stone"]) for _ in range(150)]
    texts += [t[1:] for t in texts[100:]]  # 50 with a letter less
    sizes, write = [], fuzzy_lines.stored

    def counted(df, name="llm"):
        out = write(df, name)
        if name == "shingle-candidates":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(fuzzy_lines, "stored", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = sorted(r["doc_id"] for r in fuzzy_lines.dedup_lines(docs, shingles=True).where("n_removed > 0").collect())
    assert gone == list(range(150, 200))
    assert sum(sizes) < 3 * len(texts)  # not a row for each two unlike lines


def test_verification_leaves_out_shared_ends(spark):
    """As the edit distance decides, with long shared beginnings and ends, which take no part in it."""
    rng = np.random.default_rng(7)
    some = lambda n: "".join(rng.choice(list("ab cé中"), n))
    rows = [("", "", 0), ("", "a", 0), ("aa", "aaa", 1), ("aba", "a", 1), ("ab", "ba", 1)]
    for n in [*range(30), *rng.integers(30, 200, 60).tolist()]:
        x, shared = some(n), some(int(rng.choice([0, 3, 500, 2500])))
        y = list(x)
        for _ in range(rng.integers(0, 7)):
            i = int(rng.integers(0, len(y) + 1))
            y[i:i + int(rng.integers(0, 2))] = some(int(rng.integers(0, 2)))
        y, most = "".join(y), int(rng.integers(0, 6))
        rows += [(shared + x, shared + y, most), (x + shared, y + shared, most), (shared + x + shared, shared + y + shared, most)]
    F = fuzzy_lines.F
    df = spark.createDataFrame(rows, "a string, b string, most int")
    got = df.select(fuzzy_lines.within(F.col("a"), F.col("b"), F.col("most")).alias("near"), F.expr("levenshtein(a, b, most) >= 0").alias("want")).collect()
    assert [r["near"] for r in got] == [r["want"] for r in got] and {r["want"] for r in got} == {True, False}
    passage = "the same long words " * 30
    lines = spark.createDataFrame([("red ship" + passage, "red door" + passage), (passage + "red", passage + "reader")], "a string, b string")
    rest = lines.select(fuzzy_lines.apart(F.col("a"), F.col("b")).alias("p")).select("p.*").collect()
    assert sorted(map(tuple, rest)) == [("d", "ader"), ("ship", "door")]


def test_known_pairs_go_after_each_pair_is_one_row(spark, texts, monkeypatch):
    """Of pairs that share several buckets, the anti-join gets one row each: no distinct follows it."""
    plans, write = [], fuzzy_lines.stored

    def seen(df, name="llm"):
        if name == "shingle-candidates":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(fuzzy_lines, "stored", seen)
    fuzzy_lines.dedup_lines(spark.createDataFrame(texts[:40], "doc_id long, text string"), shingles=True)
    assert ["LeftAnti" in p for p in plans] == [False, True] and "Aggregate" not in plans[1]


def test_words_edited_in_place_need_no_distance_of_the_line(spark, monkeypatch):
    F = fuzzy_lines.F
    passage = "the same long words " * 12
    rows = [("red boat " + passage + "sails", "red boot " + passage + "sails", 2, True), (passage + "one two", "one " + passage[4:] + "one to", 4, True),
            ("a  b", "a c b", 1, True), ("x", "y", 1, True), ("", "ab", 2, True), ("red " + passage, "blue " + passage, 3, False), (passage + "one", passage + "one more", 5, True)]
    df = spark.createDataFrame(rows, "a string, b string, most int, want boolean")
    near = lambda: fuzzy_lines.within(F.col("a"), F.col("b"), F.col("most")).alias("near")
    assert [r["near"] for r in df.select(near()).collect()] == [r[3] for r in rows]
    with monkeypatch.context() as m:
        m.setattr(F, "call_function", lambda *_: F.raise_error(F.lit("distance of the line")).cast("int"))
        assert all(r["near"] for r in df.where("want AND size(split(a, ' ')) = size(split(b, ' '))").select(near()).collect())


def test_candidates_are_joined_once(spark, texts, monkeypatch):
    """Verification reads its pairs three times: always from a written table, never through the anti-join."""
    given, verify = [], fuzzy_lines.verified
    monkeypatch.setattr(fuzzy_lines, "verified", lambda rows, distinct, pairs, *more: given.append(hasattr(pairs, "stored_at")) or verify(rows, distinct, pairs, *more))
    fuzzy_lines.dedup_lines(spark.createDataFrame(texts[:40], "doc_id long, text string"), shingles=True)
    assert given == [True] * 4


def similar_pairs(keys):
    """All pairs of normalised lines with an edit similarity of at least 0.8, whatever their signatures."""
    size = np.array([len(k) for k in keys])
    chars = {c: i for i, c in enumerate(sorted(set("".join(keys))))}
    counts = np.zeros((len(keys), len(chars)), np.int16)
    for i, k in enumerate(keys):
        np.add.at(counts[i], [chars[c] for c in k], 1)
    some = []
    for i in range(len(keys)):
        near = np.flatnonzero(np.abs(counts[:i] - counts[i]).sum(1) <= 2 * (np.maximum(size[:i], size[i]) // 5))  # an edit moves two counts at most
        some += [(keys[i], keys[j], int(max(size[i], size[j])) // 5) for j in near]
    con = duckdb.connect()
    con.register("maybe", pa.table(dict(zip("abm", map(list, zip(*some))))))
    return con.sql("SELECT a, b FROM maybe WHERE levenshtein(a, b) <= m").fetchall()


def test_fuzzy_lines_beyond_the_radius(spark, texts):
    """Each distinct normalised line as a document: similar lines are found without regard to signatures."""
    norm = lambda s: re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", s.lower()).strip(" ")
    keys = {norm(x) for _, t in texts for x in t.split("\n")} - {""}
    base = "seven small boats left harbour early today under grey skies".split()
    keys |= {" ".join(base[:i] + ["zebra"] + base[i + 1:]) for i in range(len(base))} | {"la ja", "la ra", "hello", "hallo", "good morning", "god mornings"}
    keys = sorted(keys)
    pairs = similar_pairs(keys)
    docs = spark.createDataFrame(list(enumerate(keys)), "doc_id long, text string")
    rows = fuzzy_lines.distinct_rows(docs, "doc_id", "text")
    distinct = fuzzy_lines.line_signatures(rows).groupBy("k1", "k2").agg(
        fuzzy_lines.F.min(fuzzy_lines.F.struct("id", "pos", "th")).alias("first"))
    links = spark.createDataFrame([], "a struct<k1:bigint,k2:bigint>, b struct<k1:bigint,k2:bigint>")
    for given in (links, None):
        if given is None:  # as the operator does it, after the signatures
            want = unite(len(keys), [(keys.index(a), keys.index(b)) for a, b in pairs])
            got = fuzzy_lines.dedup_lines(docs, shingles=True).where("n_removed = 0").count()
            assert got == len(set(want)) and fuzzy_lines.dedup_lines(docs).where("n_removed = 0").count() > got
            continue
        found = fuzzy_lines.shingled_links(rows, distinct, given, 0.8, 200_000)
        place = {tuple(r["k"]): r["first"]["id"] for r in distinct.selectExpr("struct(k1, k2) AS k", "first").collect()}
        root = unite(len(keys), [(place[tuple(r["a"])], place[tuple(r["b"])]) for r in found.collect()])
        recall = np.mean([root[keys.index(a)] == root[keys.index(b)] for a, b in pairs])
        print("pairs", len(pairs), "recall", recall)
        assert recall > 0.97


def test_decontamination(spark, docs, odd, none):
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet")
    for t in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    rel = duckdb.sql(ORACLE["op7_decontaminate"])
    for size in (50_000, 3):  # as a hash set in the scan, and by a join
        found = decontaminate.find(docs, bench, max_set=size)
        assert sorted(map(tuple, found.select(*rel.columns).collect())) == sorted(rel.fetchall())
    assert found.where("contaminated").count() > 0
    items = spark.createDataFrame([(7, "todax THIRD"), (8, None), (9, "..."), (10, "school")], "item_id long, text string")
    rows = {(r["doc_id"], r["n_hit"], r["n_items"]): r for r in decontaminate.find(odd, items).collect()}
    assert (9, 2, 1) in rows and (3, 0, 0) in rows and (4, 0, 0) in rows
    assert rows[9, 2, 1]["items_sha256"] == hashlib.sha256(b"7").hexdigest()
    assert decontaminate.remove(odd, items).count() == odd.count() - 2
    assert decontaminate.find(none, items).count() == 0
    assert decontaminate.find(odd, items.limit(0)).where("contaminated").count() == 0


def test_one_row_per_group_with_null_and_repeated_ids(spark):
    one, two, three = "red boats sail past the old pier at dawn", "nine goats climb over a steep and stony hill", "my uncle plays the horn in a brass band"
    rows = [(None, one, "a"), (None, one, "b"), (None, two, "a"), (5, two, "a"), (5, three, "b"), (5, three, "a"), (3, one, "z"), (7, three, "c")]
    rows += [(None, "a text alone without any number at all", "a"), (None, "a second text alone, quite unlike the others here", "a")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string"), 3, 3)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(3, one, "z"), (5, two, "a"), (5, three, "a"), *rows[-2:]], key=str)


def test_removal_by_id_and_text(spark):
    items = spark.createDataFrame([(1, "planted words")], "item_id long, text string")
    rows = [(None, "a clean text"), (None, "some planted words"), (4, "planted words again"), (4, "another clean text"), (6, None)]
    kept = decontaminate.remove(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)
