"""Operator 13 against a trie built in memory."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from turnwise.llm import prefix_trie
from turnwise.llm.common import reachable

SCHEMA = "conv_id long, turn long, role string, text string, pos long, key string, total long"


def md5(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, md5(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + mine[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    return {(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n],
             hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items()}


def run(spark, rows, **how):
    reachable(spark)
    table = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA)
    got = [tuple(r) for r in prefix_trie.prefix_trie(table, **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


def talk(rng, convs, turns, words=3):
    rows = []
    for c in convs:
        for t in range(rng.randint(0, turns)):
            rows.append((c, t, rng.choice(["user", "assistant"]), "é" * rng.randint(0, 4) + str(rng.randint(0, words - 1))))
    return rows


@pytest.mark.parametrize("block,shards", [(64, None), (64, 1), (64, 7), (2, 1), (2, 5), (1, 3)])
def test_trie_is_the_trie(spark, block, shards):
    rng = random.Random(block * 10 + (shards or 0))
    rows = talk(rng, [*range(0, 60), *range(195, 230), *range(-130, -90)], 6, 2)
    rows += [(c, t, "user", "the same start") for c in range(300, 340) for t in range(4)]      # copies
    rows += [(500, t, "user", f"turn {t % 3}") for t in range(23)]                              # one long conversation
    rows += [(501, t, "user", f"turn {t % 3}") for t in range(23)] + [(502, t, "user", f"turn {t % 3}") for t in range(19)]
    assert run(spark, rows, block=block, shards=shards) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, "user", "null turn first"), (1, 0, None, "b"), (1, 0, "user", None), (1, 0, "user", None), (2, 5, "", ""),
            (None, 0, "user", "nobody's"), (3, 1, "user", "x" * 100_000), (-7, 0, "user", "negative"), (-100, 0, "user", "base of negatives"),
            (100, 0, "a", "one"), (100, 1, "a", "two"), (117, 0, "z", "kept or not"), (2**62, 0, "user", "large id")]
    want = brute(rows)
    assert run(spark, rows) == want and run(spark, rows, shards=4) == want and run(spark, rows, block=1, shards=3) == want


def test_empty(spark, none):
    assert run(spark, []) == set()
    assert run(spark, [(None, 0, "user", "a")]) == set()


def test_splitters_share_the_work(spark):
    """Copies of one conversation are spread over shards, and only skeleton nodes are in several."""
    rows = [(c, t, "user", f"turn {t}") for c in range(1, 400) for t in range(6, 9)]
    reachable(spark)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns, convs = prefix_trie.rebuilt_turns(table)
    paths = prefix_trie.paths(turns, convs, 64).collect()
    assert len({bytes(r["path"]) for r in paths}) <= 4  # by the number of turns taken away
    assert run(spark, rows, shards=8) == brute(rows)
