"""Operator 12 against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from turnwise.llm import prefix_table, queries
from turnwise.llm.pieces import vocabulary

from .conftest import SF001

MODEL = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    pieces = list(prefix_table.table(MODEL).piece.values())
    kinds = [lambda: "".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))),
             lambda: "".join(rng.choice("abcdeiou ▁ \n") for _ in range(rng.randint(0, 40))),
             lambda: "".join(rng.choice("  aA.") for _ in range(rng.randint(0, 60))),
             lambda: "".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 60))),
             lambda: "".join(chr(rng.choice([rng.randint(1, 0x2FFF), rng.randint(0x4E00, 0x9FFF), rng.randint(0x1F300, 0x1F9FF), 0x200B, 0xFEFF, 0xA0]))
                             for _ in range(rng.randint(1, 20))),
             lambda: rng.choice("ae=-_.0 ") * rng.randint(1, 300) + rng.choice(pieces)]
    return ["", " ", "  ", " a", "a ", "a  b", "<s> </s>", "\n", "\x00", "a\tb", *(rng.choice(kinds)() for _ in range(n))]


def test_ids_are_the_librarys(lib, texts):
    some = odd_texts(4000) + [t for _, t in texts]
    want = [lib.encode(t) for t in some]
    for words, bits in ((300_000, 21), (50, 4)):  # also when little is remembered
        t = prefix_table.PrefixTable(MODEL, words=words, pair_bits=bits)
        got = [ids(x) for i in range(0, len(some), 500) for x in t.encode(some[i:i + 500])]
        assert got == want
    assert [t.decode(x) for x in want] == [lib.decode(x) for x in want]


def test_one_long_word(lib):
    t = prefix_table.table(MODEL)
    rng = random.Random(1)
    for word in ("a" * 50_001, "".join(rng.choice("aeinrst日é🙂\n") for _ in range(50_000)), " " * 10_000 + "x"):
        assert ids(t.encode([word])[0]) == lib.encode(word)


def test_pair_test_is_the_merging(lib):
    """Two pieces fit exactly if merging their text gives them back."""
    t, rng = prefix_table.table(MODEL), random.Random(2)
    every = list(t.piece)
    for _ in range(4000):
        a, b = rng.choice(every[:4000]), rng.choice(every[:4000])
        x, y = t.piece[a], t.piece[b]
        if t.merged(x) == [x] and t.merged(y) == [y]:
            assert t.compatible(a, b) == (t.merged(x + y) == [x, y]), (x, y)


def test_query(spark, odd, none, docs, texts, lib):
    rows = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op12_prefix_table(spark, SF001).collect()}
    want = set()
    for d, text in texts:
        x = lib.encode(text)
        want.add((d, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(lib.decode(x).encode()).hexdigest()))
    assert rows == want
    got = prefix_table.encode_decode(odd, MODEL).collect()
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in got) == \
        sorted((str(r["doc_id"]), lib.encode(r["text"] or ""), lib.decode(lib.encode(r["text"] or ""))) for r in odd.collect())
    assert prefix_table.encode_decode(none, MODEL).count() == 0
    assert prefix_table.digests(prefix_table.encode_decode(none, MODEL)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
