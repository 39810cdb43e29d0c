"""Operator 8: best-fit packing by a configuration linear program.

Pieces of whole length fill a sequence each.  The others are only a histogram over lengths
below the capacity, whatever the number of documents.  The fractional program "cover every
length's count with configurations (multisets of lengths within the capacity)" is solved by
multiplicative weights: prices fall for lengths covered most, and a knapsack dynamic program
finds the most valuable configuration for the prices.  The solution is rounded down, solved again
for what is left, and the pieces that no whole configuration takes (their number depends on the
histogram's lengths, not on the pieces) are packed best fit, longest first, on the histogram.

Assigning pieces to places is arithmetic: the pieces of a length are numbered (salted by the
number of partitions, so a length that a third of the pieces share is split), and a place table, whose size depends on the
histogram only, maps a number to its sequence and offset.

Defined results: null text is empty (the end id alone); null and repeated ids are separate
documents; a document longer than the capacity is cut so that only its first piece is short; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_ids, stored
from .pieces import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces; only the first may be short."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every document."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for b in batches:
            rows, texts, at = [], b.column("text"), b.column("doc_id").to_pylist()
            for i in range(0, len(at), 2000):  # few texts and ids at a time are Python objects
                for doc, ids in zip(at[i:i + 2000], enc.encode(texts.slice(i, 2000).to_pylist())):
                    ids += end
                    for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append((doc, k, s, n, crc_ids(ids[4 * s:4 * (s + n)])))
            cols = list(zip(*rows)) or [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])
        enc.rest()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(encode, PIECE)


def knapsack(value: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack over lengths: ``take[c]`` is the length to put into room ``c`` first.

    ``value[s]`` is the price of length ``s`` (zero for lengths that do not occur); 0 in ``take``
    means that a unit of the room stays empty.
    """
    sizes = np.flatnonzero(value)
    price = value[sizes]
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            cand = price[:k] + best[c - sizes[:k]]
            j = cand.argmax()
            if cand[j] > best[c]:
                best[c], take[c] = cand[j], sizes[j]
    return take


def configuration(take: np.ndarray, room: int, first: int) -> Counter:
    """``first`` and the most valuable filling of the room beside it."""
    config: Counter = Counter([first])
    room -= first
    while room > 0:
        s = int(take[room])
        config[s] += s > 0
        room -= s or 1
    return +config


def fractional(counts: dict[int, int], capacity: int, covers: float = 2.0, eps: float = 0.1,
               eta: float = 1.0, ahead: float = 0.3) -> dict[tuple, float]:
    """Configurations and their (fractional) numbers, which cover the lengths' counts about evenly.

    Multiplicative weights for the covering program.  A length's price is its share of a sequence
    (the price at the program's optimum where sequences can be filled) times a weight that falls
    by ``exp(-eta)`` with each cover; a length that is ``ahead`` of the least covered one is not on
    offer.  A round runs the knapsack once and buys the best filling around each of the lengths
    covered least, as often as ``eps`` of the scarcest length in it allows (width-independent
    steps).  After ``covers`` covers the numbers are divided by the mean cover; the lengths' covers
    are then within a few per cent of one, and rounding takes what is above.
    """
    if not counts:
        return {}
    sizes = np.array(sorted(counts), np.int64)
    need = np.array([counts[int(s)] for s in sizes], float)
    index = {int(s): i for i, s in enumerate(sizes)}
    covered, tokens = np.zeros(len(sizes)), need * sizes
    bought: Counter = Counter()
    while (mean := covered @ tokens / tokens.sum()) < covers:
        lead = covered - covered.min()
        value = np.zeros(capacity + 1)
        value[sizes] = np.where(lead > ahead, 0.0, sizes * np.exp(-eta * lead))
        take = knapsack(value, capacity)
        for i in np.argsort(covered, kind="stable")[:16]:
            config = configuration(take, capacity, int(sizes[i]))
            at, times = np.array([index[s] for s in config]), np.array(list(config.values()), float)
            step = eps * (need[at] / times).min()
            bought[tuple(sorted(config.items()))] += step
            covered[at] += step * times / need[at]
    return {c: x / mean for c, x in bought.items()}


def best_fit(left: Counter, capacity: int) -> Counter:
    """Best fit, longest first, of a histogram of left-over lengths."""
    done: Counter = Counter()
    rooms: list[int] = []
    bins: dict[int, list[Counter]] = {}
    for s in sorted(left, reverse=True):
        for _ in range(left[s]):
            k = bisect.bisect_left(rooms, s)
            if k < len(rooms):
                room = rooms.pop(k)
                b = bins[room].pop()
            else:
                room, b = capacity, Counter()
            b[s] += 1
            bisect.insort(rooms, room - s)
            bins.setdefault(room - s, []).append(b)
    for group in bins.values():
        for b in group:
            done[tuple(sorted(b.items()))] += 1
    return done


def by_program(counts: dict[int, int], capacity: int) -> tuple[Counter, Counter]:
    """Configurations of the program, rounded down, and the pieces that rounding left.

    The program is solved again for what is left as long as a solution places nine tenths of its
    pieces; then most lengths are left a few times only, less often than whole configurations take."""
    used: Counter = Counter()
    left = Counter(counts)
    while left:
        before = sum(left.values())
        for config, x in sorted(fractional(dict(left), capacity).items(), key=lambda p: (-p[1], p[0])):
            # Rounded down, and no more often than there are pieces of each of its lengths.
            n = min([int(x + 1e-9), *(left[s] // m for s, m in config)])
            if n:
                used[config] += n
                for s, m in config:
                    left[s] -= n * m
        left = +left
        if sum(left.values()) > before / 10:
            break
    return used, left


def plan(counts: dict[int, int], capacity: int) -> Counter:
    """Configurations ``((length, times), ...)`` and how many sequences use each."""
    counts = {s: n for s, n in counts.items() if n}
    full = counts.pop(capacity, 0)
    used, left = by_program(counts, capacity)
    # Rounding leaves less than a sequence per configuration: a number that the histogram bounds.
    used.update(best_fit(left, capacity))
    if full:
        used[((capacity, 1),)] += full
    return used


def places(used: Counter) -> dict[int, np.ndarray]:
    """For each length its places as rows ``(first number, first sequence, offset)``.

    Piece number ``r`` of the length has the row with the greatest first number not above ``r``;
    its sequence is that row's first sequence plus the difference.
    """
    rows: dict[int, list[tuple[int, int, int]]] = {}
    filled: Counter = Counter()
    sequence = 0
    for config, n in sorted(used.items(), reverse=True):
        offset = 0
        for s, m in sorted(config, reverse=True):
            for _ in range(m):
                rows.setdefault(s, []).append((filled[s], sequence, offset))
                filled[s] += n
                offset += s
        sequence += n
    return {s: np.array(r, np.int64) for s, r in rows.items()}


def pack_pieces(cut_pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a written table of pieces."""
    spark = cut_pieces.sparkSession
    # At most ``capacity`` rows come to the driver.
    counts = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(plan(counts, capacity))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, sum(counts.values()) // (4 * parts))  # a quarter of an even partition
    salts = {s: n // share + 1 for s, n in counts.items()}
    salted = cut_pieces.join(
        F.broadcast(spark.createDataFrame([(s, n) for s, n in salts.items()], "length long, salts long")), "length")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = stored(groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "salts")
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    # The rows are dealt by (length, salt), about a quarter of a partition a key.
    numbered = salted.withColumn("r", F.row_number().over(inside) - 1).join(groups, ["length", "salt"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("r")).alias("number"))
    shared = spark.sparkContext.broadcast(table)  # its size depends on the histogram, not on the rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length):
                rows, at = known[int(s)], np.flatnonzero(length == s)
                k = np.searchsorted(rows[:, 0], number[at], "right") - 1
                sequence[at] = rows[k, 1] + number[at] - rows[k, 0]
                offset[at] = rows[k, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)],
                                             [*b.schema.names[:5], "sequence_id", "offset"])

    return numbered.mapInArrow(place, PIECE + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece."""
    return pack_pieces(stored(pieces(docs, tokenizer_path, end_id, capacity), "pieces"), capacity)
