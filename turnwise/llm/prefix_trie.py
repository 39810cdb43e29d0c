"""Operator 13: the prefix trie of rebuilt conversations, by a skeleton of splitter paths.

A conversation is the path of its turns, each a digest of role and text and the text's length.
Sorted by path, the members of a node are neighbours.  Paths are dealt to shards by splitters
taken from a sample; a node can only lie in several shards if it is the beginning of a splitter.
Those nodes, the skeleton, are broadcast.  A shard reads its sorted paths once with a stack of
open nodes and finishes every other node by itself; of skeleton nodes it gives partial counts,
which are summed by node, and then from the leaves of the skeleton to its root.

Nothing grows with a conversation or a node: texts are digested before anything moves, a path is
kept in blocks of ``block`` turns, equal paths are sorted by conversation and so spread over
shards, and the ids that end in a skeleton node are hashed as a stream of chunks in order.  A
later block of a path belongs to a trie of its own, named by the digest of everything before it;
totals of such tries reach the tries above them by pointer doubling.  The skeleton has at most
``shards * block`` nodes, whatever the data.  The sample changes the balance only.

Defined results: conversations are ordered by turn, null first, repeated turns by the MD5 of role
and text; null role or text is empty; rows without ``conv_id`` belong to no conversation; ``%`` is
Spark's (the sign of the dividend); an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.positions import with_group_rank
from ..plans.scan import ordered_scan
from .common import crc_mod, stored

TURN = 21  # bytes of a turn in a path: 1 as a mark, 16 of digest, 4 of length
HEAD_TURNS = 6  # a conversation takes fewer turns than this from the first of its hundred
FAMILY = 100
CHUNK = 4096

NODE = ("kind string, grp binary, conv_id long, depth long, parent_conv_id long, parent_skel int, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, skel int, "
        "more_children long, more_leaves long, more_saved long, shard int, seq long, ends array<long>")
_COLUMNS = [c.split()[0] for c in NODE.split(", ")]


def turn_key(role: Column, text: Column) -> Column:
    """Digest of (role, text) and the code points of the text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.concat(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")),
                            F.lpad(F.hex(F.length(text)), 8, "0")))


def rebuilt_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(turns, convs)``: ``conv_id, pos, key`` of every rebuilt turn, ``conv_id, total`` of every conversation."""
    rows = conversations.where(F.col(conv).isNotNull()) \
        .select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), turn_key(F.col(role), F.col(text)).alias("key"))
    own = with_group_rank(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("key")], "pos")
    own = stored(own.select("conv_id", "pos", "key"), "own-turns")
    heads = own.where((F.col("pos") < HEAD_TURNS - 1) & (F.col("conv_id") % FAMILY == 0))
    first = heads.groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("n_head"))
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n_own"))
    convs = convs.withColumn("h", crc_mod("conv_id", HEAD_TURNS)).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    convs = convs.join(first, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_head", F.lit(0))))
    convs = stored(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("total")), "convs")
    shared = heads.withColumnRenamed("conv_id", "base").join(convs.where("taken > 0"), "base").where("pos < h").select("conv_id", "pos", "key")
    kept = own.join(convs, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key")
    return shared.unionByName(kept), convs.select("conv_id", "total")


def paths(turns: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """One row per conversation and block of its path: ``conv_id, block, path, grp, next_grp, more``.

    ``grp`` names the trie of the block; ``next_grp`` the trie of the next one, ``more`` tells
    whether the conversation goes on there."""
    place = F.struct((F.col("pos") % block).alias("at"), "key")
    made = turns.groupBy("conv_id", F.expr(f"pos DIV {block}").cast("int").alias("block")).agg(F.array_sort(F.collect_list(place)).alias("list"))  # at most block turns
    made = made.select("conv_id", "block", F.unhex(F.array_join(F.transform("list", lambda x: F.concat(F.lit("01"), F.hex(x["key"]))), "")).alias("path"))
    none = convs.where("total = 0").select("conv_id", F.lit(0).alias("block"), F.unhex(F.lit("")).alias("path"))
    rows = made.unionByName(none)
    if (convs.agg(F.max("total")).first()[0] or 0) <= block:
        return rows.withColumn("grp", F.unhex(F.lit("00000000"))).withColumn("next_grp", F.lit(None).cast("binary")).withColumn("more", F.lit(False))
    # Digests of blocks add up, so a running sum names everything before a block.
    md5 = F.md5(F.concat(F.unhex(F.lpad(F.hex("block"), 8, "0")), "path"))
    parts = [F.conv(F.substring(md5, 8 * i + 1, 8), 16, 10).cast("long").alias(f"d{i}") for i in range(4)]
    more = F.col("total") > (F.col("block") + 1).cast("long") * block
    rows = stored(rows.join(convs, "conv_id").select("conv_id", "block", "path", more.alias("more"), *parts), "blocks")
    rows = ordered_scan(rows, ["conv_id"], "block", sums={f"r{i}": f"d{i}" for i in range(4)})
    name = lambda k, sums: F.unhex(F.concat(F.lpad(F.hex(k), 8, "0"), *[F.lpad(F.hex(s), 16, "0") for s in sums]))
    before = F.when(F.col("block") == 0, F.unhex(F.lit("00000000"))).otherwise(name(F.col("block"), [F.col(f"r{i}") - F.col(f"d{i}") for i in range(4)]))
    after = F.when(F.length("path") == block * TURN, name(F.col("block") + 1, [F.col(f"r{i}") for i in range(4)]))
    return rows.select("conv_id", "block", "path", before.alias("grp"), after.alias("next_grp"), "more")


class _Skeleton:
    """The nodes that begin a splitter: ``roots[grp]`` and ``children[(node, turn)]``."""

    def __init__(self, splitters: list[tuple[bytes, bytes]]):
        self.roots: dict = {}
        self.children: dict = {}
        self.nodes: list = []  # (parent, code points of the last text, depth in the trie, grp)
        for grp, path in splitters:
            at = self._add(self.roots, grp, -1, 0, 0, grp)
            for d in range(0, len(path), TURN):
                turn = path[d:d + TURN]
                at = self._add(self.children, (at, turn), at, int.from_bytes(turn[-4:], "big"), d // TURN + 1, grp)

    def _add(self, known: dict, key, *node) -> int:
        if key not in known:
            known[key] = len(self.nodes)
            self.nodes.append(node)
        return known[key]


class _Open:
    """A node whose members are being read."""
    __slots__ = ("turn", "size", "skel", "conv", "n", "children", "leaves", "saved", "sha", "ends", "seq", "waiting", "more")

    def __init__(self, turn, skel):
        self.turn, self.skel = turn, skel
        self.size = int.from_bytes(turn[-4:], "big")
        self.conv, self.n, self.children, self.leaves, self.saved, self.seq = None, 0, 0, 0, 0, 0
        self.sha, self.ends, self.waiting, self.more = None, [], [], None


def finish_shards(skeleton: _Skeleton, block: int):
    """Function of sorted rows ``shard, grp, path, conv_id, top, more_children, more_leaves, more_saved``
    to finished nodes (kind ``node``, or ``root`` of a later block's trie), partial counts of
    skeleton nodes (``part``) and the ids that end in them (``ends``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        stack: list[_Open] = []
        at: list = [None, None, None, 0]  # shard, grp, top, depth of the trie's root

        def chunk(node: _Open) -> None:
            out.append({"kind": "ends", "skel": node.skel, "shard": at[0], "seq": node.seq, "ends": node.ends})
            node.ends, node.seq = [], node.seq + 1

        def close() -> None:
            node, depth = stack.pop(), len(stack)
            above = stack[-1] if stack else None
            if node.skel is not None:
                if node.ends:
                    chunk(node)
                more = node.more or (None,) * 3
                out.append({"kind": "part", "skel": node.skel, "conv_id": node.conv, "depth": at[3] + depth, "n_convs": node.n,
                            "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved,
                            "more_children": more[0], "more_leaves": more[1], "more_saved": more[2],
                            "parent_conv_id": at[2] if depth == 1 else None, "grp": at[1] if depth == 0 else None})
                return
            if node.more:
                node.children, node.leaves, node.saved = (a + b for a, b in zip((node.children, node.leaves, node.saved), node.more))
            if not node.children:
                node.leaves = 1
            node.saved += (node.n - 1) * node.size
            for child in node.waiting:
                child["parent_conv_id"] = node.conv
            out.extend(node.waiting)
            made = {"kind": "node" if depth or not at[3] else "root", "grp": None if depth else at[1], "conv_id": node.conv, "depth": at[3] + depth,
                    "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved,
                    "ends_sha256": (node.sha or hashlib.sha256()).hexdigest()}
            if above is None:
                out.append(made)
                return
            above.children, above.leaves, above.saved = above.children + 1, above.leaves + node.leaves, above.saved + node.saved
            if depth == 1 and at[3]:
                made["parent_conv_id"] = at[2]  # a node of the trie before
                out.append(made)
            elif above.skel is not None:
                made["parent_skel"] = above.skel
                out.append(made)
            else:
                above.waiting.append(made)

        def flush() -> pa.RecordBatch:
            cols = {c: [r.get(c) for r in out] for c in _COLUMNS}
            out.clear()
            types = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
            return pa.RecordBatch.from_arrays([pa.array(cols[c.split()[0]], types[c.split()[1]]) for c in NODE.split(", ")], _COLUMNS)

        for b in batches:
            for shard, grp, path, conv, top, *more in zip(*(c.to_pylist() for c in b.columns)):
                if shard != at[0] or grp != at[1]:
                    while stack:
                        close()
                    at[:] = shard, grp, top, int.from_bytes(grp[:4], "big") * block
                    stack.append(_Open(b"", skeleton.roots.get(grp)))
                depth = len(path) // TURN
                same = 0
                while same < depth and same + 1 < len(stack) and stack[same + 1].turn == path[same * TURN:(same + 1) * TURN]:
                    same += 1
                while len(stack) > same + 1:
                    close()
                for d in range(same, depth):
                    turn, above = path[d * TURN:(d + 1) * TURN], stack[-1].skel
                    stack.append(_Open(turn, None if above is None else skeleton.children.get((above, turn))))
                for node in stack:
                    node.n += 1
                    if node.conv is None or conv < node.conv:
                        node.conv = conv
                last = stack[-1]
                if more[0] is not None:
                    last.more = more
                elif depth or not at[3]:
                    if last.skel is not None:
                        last.ends.append(conv)
                        if len(last.ends) == CHUNK:
                            chunk(last)
                    else:
                        text = str(conv) if last.sha is None else f",{conv}"
                        last.sha = last.sha or hashlib.sha256()
                        last.sha.update(text.encode())
                if len(out) >= 5000:
                    yield flush()
        while stack:
            close()
        yield flush()

    return run


def _digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each skeleton node's chunks, which come in order."""
    skel, sha, done = None, None, []
    for b in batches:
        for s, ids in zip(b.column("skel").to_pylist(), b.column("ends").to_pylist()):
            if s != skel:
                if sha is not None:
                    done.append((skel, sha.hexdigest()))
                skel, sha = s, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(",".join(map(str, ids)).encode())
    if sha is not None:
        done.append((skel, sha.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.int32()), pa.array([x for _, x in done], pa.string())], ["skel", "sha"])


def _nodes(rows: DataFrame, block: int, shards: int | None) -> DataFrame:
    """All nodes (and the roots of later blocks' tries) of rows with ``grp, path, conv_id, top, more_*``."""
    spark = rows.sparkSession
    key = F.concat("grp", "path", F.unhex(F.lit("00")), F.unhex(F.lpad(F.hex(F.col("conv_id").bitwiseXOR(F.lit(-1 << 63))), 16, "0")))
    rows = stored(rows.withColumn("key", key), "paths")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], NODE)
    shards = shards or min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 100_000), n // 200 + 1)
    step = max(1, n // (20 * shards))  # about 20 rows a shard are looked at
    sample = rows.where(F.pmod(F.xxhash64("conv_id", "grp"), F.lit(step)) == 0).select("key", "grp", "path").limit(100 * shards).collect()
    sample = sorted((bytes(r["key"]), bytes(r["grp"]), bytes(r["path"])) for r in sample)
    chosen = sample[len(sample) // shards or 1::len(sample) // shards or 1][:shards - 1]
    skeleton = _Skeleton([(g, p) for _, g, p in chosen])
    bounds = spark.sparkContext.broadcast([k for k, _, _ in chosen])

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bisect_right(bounds.value, bytes(k))).astype("int32")

    dealt = rows.withColumn("shard", shard_of("key")).repartitionById(len(chosen) + 1, "shard").sortWithinPartitions("shard", "key")
    run, shared = finish_shards, spark.sparkContext.broadcast(skeleton)
    out = stored(dealt.select("shard", "grp", "path", "conv_id", "top", "more_children", "more_leaves", "more_saved")
                 .mapInArrow(lambda b: run(shared.value, block)(b), NODE), "trie")
    if not skeleton.nodes:
        return out
    # Bounded by the skeleton: one row per node.
    parts = out.where("kind = 'part'").groupBy("skel").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_conv_id").alias("parent_conv_id"), F.min("grp").alias("grp"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        *[F.max(c).alias(c) for c in ("more_children", "more_leaves", "more_saved")])
    ends = out.where("kind = 'ends'").select("skel", "shard", "seq", "ends").repartition("skel").sortWithinPartitions("skel", "shard", "seq")
    sha = {r["skel"]: r["sha"] for r in ends.select("skel", "ends").mapInArrow(_digest_ends, "skel int, sha string").collect()}
    got = {r["skel"]: r.asDict() for r in parts.collect()}
    empty = hashlib.sha256().hexdigest()
    made = []
    for k in range(len(skeleton.nodes) - 1, -1, -1):  # children come after their parents
        parent, size, depth, grp = skeleton.nodes[k]
        r = got[k]
        children, leaves, saved = (r[a] + (r[b] or 0) for a, b in (("n_children", "more_children"), ("n_leaves", "more_leaves"), ("saved_tokens", "more_saved")))
        leaves, saved = leaves if children else 1, saved + (r["n_convs"] - 1) * size
        if parent >= 0:
            p = got[parent]
            p["n_children"], p["n_leaves"], p["saved_tokens"] = p["n_children"] + 1, p["n_leaves"] + leaves, p["saved_tokens"] + saved
        later = int.from_bytes(grp[:4], "big") > 0
        above = r["parent_conv_id"] if later and depth == 1 else got[parent]["conv_id"] if depth else None
        made.append(("root" if later and not depth else "node", r["grp"], r["conv_id"], r["depth"], above, r["n_convs"], children, leaves, saved, sha.get(k, empty)))
    names = ["kind", "grp", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    skel = spark.createDataFrame(made, ", ".join(c for c in NODE.split(", ") if c.split()[0] in names))
    tops = spark.createDataFrame([(k, r["conv_id"]) for k, r in got.items()], "parent_skel int, _above long")
    rest = out.where("kind IN ('node', 'root')").join(F.broadcast(tops), "parent_skel", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above"))
    return rest.select(*names).unionByName(skel.select(*names))


def _later_blocks(rows: DataFrame, block: int, shards: int | None) -> DataFrame:
    """``rows`` with what lies below each block's end: totals of the tries of later blocks."""
    known = rows.withColumn("top", F.lit(None).cast("long")).withColumn("more_children", F.when(F.col("more"), F.lit(1)).cast("long")) \
                .withColumn("more_leaves", F.when(F.col("more"), F.lit(0)).cast("long")).withColumn("more_saved", F.when(F.col("more"), F.lit(0)).cast("long"))
    roots = _nodes(known.where("block > 0"), block, shards).where("kind = 'root'")
    links = rows.where("more").select(F.col("next_grp").alias("grp"), F.col("grp").alias("up")).distinct()
    tries = stored(roots.select("grp", "n_children", "n_leaves", "saved_tokens").join(links, "grp"), "tries")
    total = tries.select("grp", "up", "n_leaves", "saved_tokens")
    while True:  # totals over ever longer ways down, doubled in each round
        up = total.where("up IS NOT NULL").groupBy(F.col("up").alias("grp")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        if total.join(up, "grp", "left_semi").isEmpty():
            break
        jump = total.select(F.col("grp").alias("up"), F.col("up").alias("up2"))
        total = stored(total.join(up, "grp", "left").join(jump, "up", "left").select(
            "grp", F.col("up2").alias("up"), (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens")), "tries")
    below = tries.select("grp", "n_children").join(total.select("grp", "n_leaves", "saved_tokens"), "grp")
    below = stored(below.select(F.col("grp").alias("next_grp"), F.col("n_children").alias("more_children"),
                                F.col("n_leaves").alias("more_leaves"), F.col("saved_tokens").alias("more_saved")), "below")
    tops = stored(rows.where("next_grp IS NOT NULL").groupBy(F.col("next_grp").alias("grp")).agg(F.min("conv_id").alias("top")), "tops")
    rows = rows.withColumn("next_grp", F.when(F.col("more"), F.col("next_grp")))
    return rows.join(below, "next_grp", "left").join(tops, "grp", "left")


def prefix_trie(conversations: DataFrame, block: int = 64, shards: int | None = None) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    turns, convs = rebuilt_turns(conversations)
    rows = stored(paths(turns, convs, block), "path-blocks")
    if rows.where("more").isEmpty():
        rows = rows.select("*", *[F.lit(None).cast("long").alias(c) for c in ("top", "more_children", "more_leaves", "more_saved")])
    else:
        rows = _later_blocks(rows, block, shards)
    return _nodes(rows, block, shards).where("kind = 'node'").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
