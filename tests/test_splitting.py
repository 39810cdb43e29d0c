"""Files read by several tasks although quotes, line breaks and nesting span their splits."""

import csv
import json
import random

import pytest

from turnwise.sources import readers, sinks
from turnwise.sources.splitting import csv_records, pieces

BITS = ["plain", 'a "quoted" word', "two\nlines", "win\r\nlines", "comma, here", "tab\there", "} brace {", "[list]", "back\\slash", '\\"', "", "é日🙂", '"', "},{", '{"content": [', "\n"]


@pytest.fixture(params=[700, 1 << 20])
def splits(spark, request):
    """Small splits: records span their borders (and read the written pieces in as many tasks)."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def message(rnd):
    return " ".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 5)))


def test_csv_with_quoted_line_breaks(spark, splits, tmp_path):
    rnd = random.Random(4)
    rows = [(k, message(rnd) or "x", rnd.random() < 0.5) for k in range(150)]
    path = tmp_path / "t.csv"
    with open(path, "w", newline="") as f:
        w = csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator="\n")
        w.writerow(["Unnamed: 0", "id", "message", "flag"])
        w.writerows((k, *r) for k, r in enumerate(rows))
    got = readers.read_turns_csv(spark, str(path), "`Unnamed: 0` long, id long, message string, flag boolean")
    assert got.columns == ["id", "message", "flag"]
    assert {tuple(r) for r in got.collect()} == set(rows) and got.count() == len(rows)
    named = readers.read_turns_csv(spark, str(path)).collect()
    assert {(int(r["id"]), r["message"]) for r in named} == {r[:2] for r in rows}
    if splits == 700:
        assert csv_records(spark, str(path)).select("f").distinct().count() == 1
        assert pieces(spark, str(path), "\n").select("b").distinct().count() > 5


def test_tsv_round_trip(spark, splits, tmp_path):
    rnd = random.Random(5)
    rows = [(k, message(rnd) or "x") for k in range(120)]
    path = str(tmp_path / "t.tsv")
    sinks.write_tsv(spark.createDataFrame(rows, "id long, message string").repartition(3), path)
    got = readers.read_tsv(spark, path, "id long, message string").collect()
    strip = lambda rs: sorted((k, (m or "").strip(" \t\r\n")) for k, m in rs)  # noqa: E731  (the unquoted writer trims)
    assert strip(tuple(r) for r in got) == strip(rows)


@pytest.mark.parametrize("indent", [None, 2])
def test_one_object_with_many_conversations(spark, splits, tmp_path, indent):
    rnd = random.Random(6)
    doc = {}
    for c in range(25):
        turns = [{"agent": f"agent_{t % 2 + 1}", "message": message(rnd), "sentiment": "Neutral", "knowledge_source": ["FS1", 'x "y"'][:rnd.randint(0, 2)],
                  "turn_rating": "Good"} for t in range(rnd.choice([0, 1, 2, 40]))]
        conv = {"article_url": "AS}{" + str(c), "config": "C"}
        if c % 3 == 0:
            conv["meta"] = {"x": {"y": 1}}
        conv["content"] = turns
        conv["conversation_rating"] = {"agent_1": "Good", "agent_2": "Poor"}
        doc[f't_{25 - c} "{rnd.choice(BITS)}'] = conv
    path = tmp_path / "d.json"
    path.write_text(json.dumps(doc, indent=indent, ensure_ascii=bool(indent)), newline="")
    got = readers.number_conversations(readers.read_nested_json(spark, str(path)))
    order = [k for k, v in doc.items() if v["content"]]
    want = {(order.index(k), k, i, t["agent"], t["message"], tuple(t["knowledge_source"])) for k, v in doc.items() for i, t in enumerate(v["content"])}
    assert {(r["conversation_id"], r["conversation_key"], r["turn_id"], r["agent"], r["message"], tuple(r["knowledge_source"])) for r in got.collect()} == want
    assert got.count() == len(want)
    if splits == 700:
        assert pieces(spark, str(path), "}").select("b").distinct().count() > 5


def test_many_documents_and_empty_files(spark, splits, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    docs = [{f"c{n}": {"content": [{"agent": "a", "message": f"m{n} {t} }}"} for t in range(n % 4)]}} for n in range(30)]
    (folder / "a.json").write_text("\n".join(json.dumps(d) for d in docs[:20]) + "\n")
    (folder / "b.json").write_text("\n".join(json.dumps(d) for d in docs[20:]))
    (folder / "c.json").write_text("")
    got = readers.read_nested_json(spark, str(folder)).collect()
    assert {(r["conversation_key"], r["turn_id"], r["message"]) for r in got} == {(f"c{n}", t, f"m{n} {t} }}") for n in range(30) for t in range(n % 4)}
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    assert readers.read_turns_csv(spark, str(empty), "a string").count() == 0 and readers.read_tsv(spark, str(empty), "a string").count() == 0
