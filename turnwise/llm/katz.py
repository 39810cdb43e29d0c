"""Operator 10: Katz backoff language model, trained and evaluated as Spark jobs.

Model: bigrams backing off to unigrams backing off to the unknown word.  Counts up to ``K`` get
Good-Turing discounts ``d_r``; what the seen words of a context give up goes to its unseen words
by the exactly normalised weight ``alpha(h) = (1 - sum of seen P(w|h)) / (1 - sum of their P(w))``;
what the unigrams give up is the unknown word's.  Over all known words and the unknown one every
context sums to one.

Stages (each writes its result, so a lost executor re-reads files):

1. Documents become *blocks*: one row per part of a scan task, with each document's words as
   numbers of the block's own word list.  This is the only pass over the texts.
2. Every block sends its distinct words and their training counts, by hash, to word buckets.  A
   bucket adds them up (the unigram table), numbers its words and answers each block.
3. Blocks evaluate all that needs unigrams only, and send their distinct bigrams, the count of
   the second word, and the documents they occur in to bigram buckets.
4. A bucket adds up the counts (the bigram table) and looks every token's bigram up.  A seen one
   leaves ``log(r / c(h))`` and, for ``r <= K``, one more token with that ``r``; an unseen one
   backs off: ``log P(w)`` and one more token that needs ``alpha(h)``.
5. The discounts, from one small global sum, and ``alpha``, from the sums of each context's seen
   words, complete the documents' totals.

Scale: what moves is one entry per distinct word or bigram of a block (a frequent word is one
entry per block, however frequent), packed to a few bytes.  A context that makes up more than
1/65536 of the tokens is dealt over all buckets by its second word; there are at most 65536 such
contexts, so their ``alpha`` may be broadcast.  Words are identified by 64-bit hashes.

Defined results: null text is the empty text: one end token; null ids count as the text "" for
the fold and stay null; repeated rows are separate documents; with no training document every
probability is that of the unknown word; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, pack, slices, stored, unpack

K = 5
START = 0  # the context at a document's start; words are numbered from 1
END = np.uint64(1)  # the end token's hash; words' hashes are larger
KEPT = 0.001  # what counts above K give up, so that every context leaves something
BLOCK_CHARS = 9_000_000
HOT_SHARE = 65_536


def held_out(doc_id, divisor: int, fold: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % divisor == fold


def make_blocks(docs: DataFrame, divisor: int, fold: int, id_col: str, text_col: str) -> DataFrame:
    """One row per block: ``block``, word ``hashes``, their training ``counts``, and ``document``:
    ids, which are null, fold, numbers of tokens, and tokens as places in the word list."""
    def one(block: int, ids: list, texts: list) -> dict:
        number: dict[bytes, int] = {}
        parts, sizes = [], []
        for t in texts:
            w = (t or "").encode("utf-8", "surrogatepass").lower().split()
            sizes.append(len(w) + 1)
            parts.append(np.fromiter((number.setdefault(x, len(number) + 1) for x in w), np.uint32, len(w)))
            parts.append(np.zeros(1, np.uint32))
        hashes = np.array([END, *(max(2, xxhash.xxh64_intdigest(x)) for x in number)], np.uint64)
        order = np.argsort(hashes)
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        words = place[np.concatenate(parts)]
        held = np.array([held_out(i, divisor, fold) for i in ids], bool)
        train = np.bincount(words[np.repeat(~held, sizes)], minlength=len(order))
        document = (pack(np.array([int(x or 0) for x in ids], np.int64).view(np.uint64)), [k for k, x in enumerate(ids) if x is None],
                    np.packbits(held).tobytes(), pack(np.array(sizes)), pack(words))
        return block, pack(hashes[order], delta=True), pack(train), pickle.dumps(document)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 24
        for b in batches:
            ids, texts = b["id"].tolist(), b["text"].tolist()
            for i, j in slices([t or "" for t in texts], BLOCK_CHARS) if texts else ():
                yield pd.DataFrame([one(block, ids[i:j], texts[i:j])], columns=["block", "hashes", "counts", "document"])
                block += 1

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "block long, hashes binary, counts binary, document binary")


def buckets_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of sorted 64-bit keys by range, so that a block's share of a bucket is a slice."""
    return np.searchsorted(keys, np.array([(1 << 64) * i // n for i in range(1, n)], np.uint64))


def send_words(blocks: DataFrame, n_buckets: int) -> DataFrame:
    def run(batches):
        for df in batches:
            for block, h, c in zip(df["block"], df["hashes"], df["counts"]):
                h, c = unpack(h), unpack(c)
                at = [0, *buckets_of(h, n_buckets).tolist(), len(h)]
                rows = [(i, block, pack(h[x:y], delta=True), pack(c[x:y])) for i, (x, y) in enumerate(zip(at, at[1:])) if y > x]
                yield pd.DataFrame(rows, columns=["bucket", "block", "hashes", "counts"])

    return blocks.select("block", "hashes", "counts").mapInPandas(run, "bucket int, block long, hashes binary, counts binary")


def count_words(sent: DataFrame) -> DataFrame:
    """Per bucket and block: the block's words' numbers in the bucket and training counts; and in a
    row without block the bucket's table: its hashes, counts, and counts of counts."""
    def run(df: pd.DataFrame) -> pd.DataFrame:
        got = [unpack(h) for h in df["hashes"]]
        every, back = np.unique(np.concatenate(got), return_inverse=True)
        total = np.zeros(len(every), np.uint64)
        at = np.cumsum([0] + [len(g) for g in got])
        for k, c in enumerate(df["counts"]):
            total[back[at[k]:at[k + 1]]] += unpack(c)
        bucket = int(df["bucket"].iloc[0])
        rows = [(bucket, block, pack(back[at[k]:at[k + 1]], delta=True), pack(total[back[at[k]:at[k + 1]]]), None, len(every), 0, 0)
                for k, block in enumerate(df["block"])]
        rows.append((bucket, None, pack(every, delta=True), pack(total), np.bincount(np.minimum(total, K + 2).astype(int), minlength=K + 3)[1:].tolist(),
                     len(every), int(total.sum()), int(total[0]) if every[0] == END else 0))
        return pd.DataFrame(rows, columns=["bucket", "block", "numbers", "counts", "of_counts", "words", "tokens", "ends"])

    return sent.groupBy("bucket").applyInPandas(
        run, "bucket int, block long, numbers binary, counts binary, of_counts array<long>, words long, tokens long, ends long")


def discounted(of_counts) -> np.ndarray:
    """For counts 0..K what remains of them: Good-Turing, renormalised as Katz does, from the
    numbers of types that occur 1..K+1 times.  Where these are too irregular for a discount
    strictly between 0 and 1, a count gives up half an occurrence."""
    n = [0.0, *map(float, of_counts[:K + 1])]
    out = np.zeros(K + 1)
    top = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        x = ((r + 1) * n[r + 1] / (n[r] * r) - top) / (1 - top) if n[r] and top < 1 else 0.0
        out[r] = r * x if 0 < x < 1 else r - 0.5
    return out


def unigram_model(of_counts: list[int], tokens: int, ends: int) -> dict:
    """Global numbers: N, V, the counts' discounted values and the unknown word's probability."""
    small = discounted(of_counts)
    r = np.arange(K + 1)
    kept = sum(of_counts[i - 1] * (i - small[i]) for i in r[1:]) + KEPT * sum(of_counts[K:])
    return {"N": tokens, "V": sum(of_counts), "ends": ends, "small": small, "unknown": kept / tokens if tokens else 1.0}


def unigram(count: np.ndarray, model: dict) -> np.ndarray:
    """P(w) of words with these training counts; all of no count are the unknown word."""
    p = np.where(count > K, count - KEPT, model["small"][np.minimum(count, K).astype(int)]) / max(model["N"], 1)
    return np.where(count > 0, p, model["unknown"])


def send_bigrams(blocks: DataFrame, numbers: DataFrame, n_buckets: int, first_number: dict, model: dict) -> DataFrame:
    """Bigram messages ``(bucket, block, about_documents, payload)``; each block's own documents go
    along to one of the buckets, which hands them through."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block, document = left["block"].iloc[0], pickle.loads(left["document"].iloc[0])
        right = right.sort_values("bucket")
        word = np.concatenate([unpack(n) + np.uint64(first_number[k]) for k, n in zip(right["bucket"], right["numbers"])])
        count = np.concatenate([unpack(c) for c in right["counts"]]).astype(np.int64)
        sizes, words = unpack(document[3]).astype(np.int64), unpack(document[4]).astype(np.int64)
        held = np.unpackbits(np.frombuffer(document[2], np.uint8))[:len(sizes)].astype(bool)
        first = np.cumsum(sizes) - sizes
        c_w = count[words]
        known = np.add.reduceat((c_w > 0).astype(np.int64), first)
        base = np.add.reduceat(np.log10((c_w + 1.0) / (model["N"] + model["V"] + 1.0)), first)
        out = [(int(block % n_buckets), block, True, pickle.dumps((*document[:4], pack(known), base.tobytes())))]

        doc = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
        key = np.empty(len(words), np.uint64)  # context << 32 | word; START before a document
        key[1:] = word[words[:-1]] << np.uint64(32)
        key[first] = START
        key |= word[words]
        c_h = np.empty(len(words), np.int64)
        c_h[1:] = c_w[:-1]
        c_h[first] = model["ends"]  # as many starts as ends
        order = np.argsort(key, kind="stable")
        key, doc, c_w, c_h = key[order], doc[order], c_w[order], c_h[order]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        times = np.diff(np.r_[head, len(key)])
        train = np.add.reduceat((~held[doc]).astype(np.int64), head)
        key, c_w, c_h = key[head], c_w[head], c_h[head]
        with np.errstate(over="ignore"):
            spread = np.where(c_h > model["N"] // HOT_SHARE, key, key >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
        bucket = ((spread >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
        # Bigrams by bucket, still sorted inside it, and their occurrences in the same order.
        by = np.argsort(bucket, kind="stable")
        at = np.cumsum(times) - times
        doc = doc[np.repeat(at[by] - (np.cumsum(times[by]) - times[by]), times[by]) + np.arange(len(doc))]
        key, c_w, c_h, times, train, bucket = (x[by] for x in (key, c_w, c_h, times, train, bucket))
        edge = np.searchsorted(bucket, np.arange(n_buckets + 1))
        token = np.r_[0, np.cumsum(times)][edge]
        for k in np.flatnonzero(np.diff(edge)):
            x, y = edge[k], edge[k + 1]
            context = key[x:y] >> np.uint64(32)
            new = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
            out.append((int(k), block, False, pickle.dumps((
                pack(context[new], delta=True), pack(np.diff(np.r_[new, y - x])), pack(key[x:y] & np.uint64(0xFFFFFFFF)),
                pack(c_h[x:y][new]), pack(c_w[x:y]), pack(times[x:y]), pack(train[x:y]), pack(doc[token[k]:token[k + 1]])))))
        return pd.DataFrame(out, columns=["bucket", "block", "about_documents", "payload"])

    return blocks.select("block", "document").groupBy("block").cogroup(numbers.groupBy("block")).applyInPandas(
        run, "bucket int, block long, about_documents boolean, payload binary")


def look_up(sent: DataFrame, model: dict) -> DataFrame:
    """Per bucket its bigram ``table`` and sums, and per block what its documents' tokens leave.

    ``hot`` holds ``(context, numbers of words seen 1..K times, numbers seen oftener, their P)``
    of contexts that several buckets share.
    """
    def run(df: pd.DataFrame) -> pd.DataFrame:
        bucket = int(df["bucket"].iloc[0])
        rows = [(bucket, block, True, payload, None, None, None) for block, payload in
                zip(df["block"][df["about_documents"]], df["payload"][df["about_documents"]])]
        names = ["bucket", "block", "about_documents", "payload", "table", "of_counts", "hot"]
        df = df[~df["about_documents"]]
        if not len(df):
            return pd.DataFrame(rows, columns=names)
        got = [pickle.loads(p) for p in df["payload"]]
        keys, c_hs, c_ws, trains = [], [], [], []
        for m in got:
            runs = unpack(m[1]).astype(np.int64)
            keys.append(np.repeat(unpack(m[0]), runs) << np.uint64(32) | unpack(m[2]))
            c_hs.append(np.repeat(unpack(m[3]), runs))
            c_ws.append(unpack(m[4]))
            trains.append(unpack(m[6]))
        every, place, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        r = np.bincount(back, weights=np.concatenate(trains)).astype(np.int64)
        c_h, c_w = np.concatenate(c_hs)[place].astype(np.int64), np.concatenate(c_ws)[place].astype(np.int64)
        p_w = unigram(c_w, model)
        # Sums over each context's seen words.
        context, of = np.unique(every >> np.uint64(32), return_inverse=True)
        seen = np.stack([np.bincount(of, weights=r == i, minlength=len(context)) for i in range(1, K + 1)]
                        + [np.bincount(of, weights=r > K, minlength=len(context)),
                           np.bincount(of, weights=np.where(r > 0, p_w, 0), minlength=len(context))], axis=1)
        c_context = np.zeros(len(context), np.int64)
        c_context[of] = c_h
        shared = c_context > model["N"] // HOT_SHARE
        hot = [(int(c), *s) for c, s in zip(context[shared].tolist(), seen[shared].tolist())]
        value = np.zeros(len(every))  # what is known of a token's log10 probability
        more = r > K
        value[more] = np.log10((r[more] - KEPT) / c_h[more])
        few = (r > 0) & ~more
        value[few] = -np.log10(c_h[few])
        value[r == 0] = np.log10(p_w[r == 0])
        rows += [(bucket, None, None, None, pickle.dumps((pack(every, delta=True), pack(r))), np.bincount(np.minimum(r, K + 2), minlength=K + 3)[1:].tolist(), hot)]
        at = np.cumsum([0] + [len(k) for k in keys])
        for k, (block, m) in enumerate(zip(df["block"], got)):
            bigram = np.repeat(back[at[k]:at[k + 1]], unpack(m[5]).astype(np.int64))
            doc = unpack(m[7]).astype(np.int64)
            docs, of_doc = np.unique(doc, return_inverse=True)
            total = np.bincount(of_doc, weights=value[bigram])
            classes = [np.bincount(of_doc, weights=r[bigram] == i).astype(np.int64) for i in range(1, K + 1)]
            back_off = (r[bigram] == 0) & (c_h[bigram] > 0)  # a context never seen has alpha 1
            needs, index = np.unique(of[bigram[back_off]], return_inverse=True)
            rows.append((bucket, block, False, pickle.dumps((
                pack(docs, delta=True), total.tobytes(), [pack(c) for c in classes], pack(of_doc[back_off]), pack(index),
                pack(context[needs], delta=True), pack(c_context[needs]), seen[needs].tobytes())), None, None, None))
        return pd.DataFrame(rows, columns=names)

    row = "struct<context:long," + ",".join(f"n{i}:double" for i in range(1, K + 2)) + ",p:double>"
    return sent.groupBy("bucket").applyInPandas(
        run, f"bucket int, block long, about_documents boolean, payload binary, table binary, of_counts array<long>, hot array<{row}>")


def complete(found: DataFrame, small: np.ndarray, shared: dict, threshold: int) -> DataFrame:
    """Each block's partial document sums with discounts and backoff weights put in."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log_small = np.log10(small[1:])
        gives = np.r_[np.arange(1, K + 1) - small[1:], KEPT]
        for df in batches:
            out = []
            for block, payload in zip(df["block"], df["payload"]):
                docs, total, classes, of_doc, index, context, c_h, seen = pickle.loads(payload)
                total = np.frombuffer(total).copy()
                for c, x in zip(classes, log_small):
                    total += unpack(c) * x
                context, c_h = unpack(context), unpack(c_h).astype(np.int64)
                if len(context):
                    seen = np.frombuffer(seen).reshape(-1, K + 2).copy()
                    for i in np.flatnonzero(c_h > threshold):
                        seen[i] = shared[int(context[i])]
                    log_alpha = np.log10(seen[:, :K + 1] @ gives / c_h) - np.log10(1 - seen[:, K + 1])
                    total += np.bincount(unpack(of_doc).astype(np.int64), weights=log_alpha[unpack(index).astype(np.int64)], minlength=len(total))
                out.append((block, docs, total.tobytes()))
            yield pd.DataFrame(out, columns=["block", "docs", "total"])

    return found.where("NOT about_documents").select("block", "payload").mapInPandas(run, "block long, docs binary, total binary")


def document_rows(parts: DataFrame, documents: DataFrame, model: dict, id_col: str) -> DataFrame:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, nulls, held, sizes, known, base = pickle.loads(right["payload"].iloc[0])
        ids, sizes = unpack(ids).view(np.int64), unpack(sizes).astype(np.int64)
        score = np.zeros(len(sizes))
        for docs, total in zip(left["docs"], left["total"]):
            score[unpack(docs).astype(np.int64)] += np.frombuffer(total)
        return pd.DataFrame({
            id_col: [None if k in nulls else x for k, x in enumerate(ids.tolist())] if nulls else ids,
            "held_out": np.unpackbits(np.frombuffer(held, np.uint8))[:len(sizes)].astype(bool), "n_tokens": sizes,
            "n_known": unpack(known).astype(np.int64), "train_tokens": model["N"], "base_score": np.frombuffer(base), "score": score})

    return parts.groupBy("block").cogroup(documents.groupBy("block")).applyInPandas(
        run, f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, divisor: int = 7, fold: int = 2, id_col: str = "doc_id", text_col: str = "text",
          n_buckets: int | None = None) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``,
    trained on those whose crc32(id as text) mod ``divisor`` is not ``fold``.

    ``n_buckets`` (default: the session's shuffle partitions) is the number of parts of the
    tables; a part has to fit a task.
    """
    spark = docs.sparkSession
    n_buckets = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = make_blocks(docs, divisor, fold, id_col, text_col)
    blocks = stored(blocks, "lm-blocks")
    words = stored(count_words(send_words(blocks, n_buckets)), "lm-words")
    documents = stored(blocks.select("block", "document"), "lm-documents")
    discard(blocks)
    # One row per bucket and no words in it.
    tables = words.where("block IS NULL").select("bucket", "words", "tokens", "ends", "of_counts").orderBy("bucket").collect()
    first_number, nxt = {}, 1
    for t in tables:
        first_number[t["bucket"]] = nxt
        nxt += t["words"]
    if nxt >> 32:
        raise ValueError("more than 2^32 distinct words")
    of_counts = [sum(x) for x in zip(*(t["of_counts"] for t in tables))] or [0] * (K + 2)
    model = unigram_model(of_counts, sum(t["tokens"] for t in tables), sum(t["ends"] for t in tables))
    answers = words.where("block IS NOT NULL").select("bucket", "block", "numbers", "counts")
    sent = send_bigrams(documents, answers, n_buckets, first_number, model)
    found = stored(look_up(sent, model), "lm-bigrams")
    discard(documents)
    documents = found.where("about_documents").select("block", "payload")
    n = found.where("block IS NULL").select(F.posexplode("of_counts").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n"))
    n = {r["r"]: r["n"] for r in n.collect()}
    small = discounted([n.get(i, 0) for i in range(K + 2)])
    sums = found.where("block IS NULL").select(F.inline("hot")).groupBy("context").agg(
        *[F.sum(f"n{i}") for i in range(1, K + 2)], F.sum("p")).collect()  # at most HOT_SHARE contexts
    shared = {r[0]: np.array(r[1:]) for r in sums}
    return document_rows(complete(found, small, shared, model["N"] // HOT_SHARE), documents, model, id_col)
