"""Operator 7: benchmark decontamination (DataFrame functions only).

Test items and training texts are normalised to the same word lists.  Every window of
``window`` consecutive item words (an item of fewer words is one window) is hashed.  If the set
of hashes is no larger than ``max_set`` it is sent to the tasks as a hash set inside the scan's
own expression: one narrow pass hashes the windows of each text and keeps those that are in the
set, with no shuffle of words.  A larger set is joined by a shuffle instead, with the same
result.  Hits are verified by comparing the window's words, so hash collisions do not count.

Scale: the scan emits hits and word counts only.  Hits of a document are grouped by document and
covered position, both pre-aggregated, so a passage that many documents share is just more rows.

Defined results: null or empty texts have no words and are never contaminated; items without
words (null, punctuation) have no windows; repeated documents (same id and text) are counted once
per row but share hits; an empty benchmark leaves every document clean; other columns pass
through ``remove`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored

# What separates words: ASCII other than letters and digits, after A-Z became a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def item_windows(items: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """``item_id, n`` (its length in words) and ``w`` (its words) of every distinct window."""
    words = items.select(F.col(item_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).where("size(words) > 0")
    words = words.withColumn("n", F.least(F.size("words"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)
    w = F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.col("n")), " "))
    return words.select("item_id", "n", F.explode(w).alias("w")).distinct()


def window_hits(rows: DataFrame, windows: DataFrame, max_set: int) -> tuple[DataFrame, DataFrame]:
    """For ``rows`` (``id, th, words``): written ``(id, th, n_words)``, and the windows that may
    be items' as ``(id, th, n, pos, w)``."""
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most ``window`` rows
    distinct = windows.select("n", "w").distinct()
    # A window's first word is at a position from 1; none if the text is shorter.
    starts = {n: F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - (n - 1))) for n in lengths}

    def taken(n: int, at: Column) -> Column:
        return F.transform(at, lambda i: F.struct(F.lit(n).alias("n"), i.alias("pos"),
                                                  F.array_join(F.slice("words", i, n), " ").alias("w")))

    def in_set(n: int, known: list[int]):
        return lambda i: F.xxhash64(F.slice("words", i, n)).isin(known)

    none = F.array().cast("array<struct<n:int,pos:int,w:string>>")
    small = distinct.limit(max_set + 1).count() <= max_set
    if small:
        hits = []
        for n in lengths:
            own = distinct.where(F.col("n") == n).select(F.xxhash64(F.split("w", " ")).alias("h")).distinct()
            # Literals of the plan: every task gets them as one hash set, whose size was checked.
            known = [r["h"] for r in own.collect()]
            hits.append(taken(n, F.filter(starts[n], in_set(n, known))))
        scan = rows.select("id", "th", F.size("words").cast("long").alias("n_words"),
                           F.flatten(F.array(none, *[F.coalesce(h, none) for h in hits])).alias("hits"))
        scan = stored(scan, "window-scan")
        return scan.drop("hits"), scan.select("id", "th", F.inline("hits"))
    every = F.flatten(F.array(none, *[F.coalesce(taken(n, starts[n]), none) for n in lengths]))
    found = rows.select("id", "th", F.inline(every)).join(distinct, ["n", "w"], "left_semi")
    return stored(rows.select("id", "th", F.size("words").cast("long").alias("n_words")), "word-counts"), found


def find(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", max_set: int = 50_000, hashed: bool = False) -> DataFrame:
    """Per row of ``docs``: ``id, n_words, n_hit, n_items, items_sha256, contaminated``, and the
    text's hash ``th`` with ``hashed``."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), words_of(F.col(text_col)).alias("words"))
    windows = stored(item_windows(items, window, item_col, item_text_col), "windows")
    counted, hits = window_hits(rows, windows, max_set)
    # Verification: the window's words are an item's, not only their hash.
    hits = stored(hits.join(windows, ["n", "w"]).select("id", "th", "n", "pos", "item_id").distinct(), "hits")
    covered = hits.select("id", "th", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("p"))
    n_hit = covered.distinct().groupBy("id", "th").agg(F.count("*").alias("n_hit"))
    # At most one entry per benchmark item.
    which = hits.select("id", "th", F.col("item_id").cast("string").alias("item")).distinct() \
                .groupBy("id", "th").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = stored(n_hit.alias("a").join(which.alias("b"), F.expr("a.id <=> b.id AND a.th = b.th"))
                   .select("a.id", "a.th", "n_hit", "items"), "contaminated")
    joined = counted.alias("d").join(found.alias("f"), F.expr("d.id <=> f.id AND d.th = f.th"), "left")
    items_of = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return joined.select(F.col("d.id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                         F.size(items_of).cast("long").alias("n_items"),
                         F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
                         (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), *([F.col("d.th").alias("th")] if hashed else []))


def remove(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a window of any item."""
    # Rows may share an id, also a null one: the text's hash tells them apart.
    bad = find(docs, items, window, id_col, text_col, hashed=True).where("contaminated")
    bad = stored(bad.select(F.col(id_col).alias("_bad"), F.col("th").alias("_th")).distinct(), "bad")
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad"]) & (F.xxhash64(docs[text_col]) == bad["_th"]), "left_anti")
