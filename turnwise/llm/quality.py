"""Operator 4: document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes.  A passage is encoded from how its
characters follow one another (16 classes of characters, so 256 pairs) and how much it repeats
itself, by a learned layer.  Gated attention, ``softmax(w . (tanh(V h) * sigmoid(U h)))``,
weighs the passages; the weighted sum is scored by a logistic layer.  Labels are per document
only; all weights are learned together from them.

The model is fitted on a bounded sample of labelled documents: those with the smallest hashes,
``SAMPLE`` at most and as many as have ``SAMPLE_PASSAGES`` passages together (one at least), each
with all its passages.  Scoring reads all passages of every whole text, in one narrow pass
without a shuffle.

Defined results: a null or empty text is one empty passage; null labels teach nothing; a document
with several labels counts once for each; without any label every score is 0.5; repeated rows
score alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

PASSAGE = 512
SAMPLE, SAMPLE_PASSAGES = 4000, 200_000
FEATURES = 16 * 16 + 2
HIDDEN, GATE = 24, 16


def _classes() -> np.ndarray:
    table = np.full(256, 15, np.uint8)  # bytes of other alphabets
    for k, group in enumerate((b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"AEIOU", b"BCDFGHJKLMNPQRSTVWXYZ", b"0123456789", b" \t", b"\n\r",
                               b".", b",;:", b"!?", b"'\"`", b"()[]{}<>", b"|/\\-_=+~", b"#$%&*@^")):
        table[list(group)] = k
    table[:32][table[:32] == 15] = 14
    return table


CLASSES = _classes()


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (rows), and each text's number of passages."""
    raw = [t.encode("utf-8", "surrogatepass") or b" " for t in texts]
    size = np.array([len(r) for r in raw])
    n = -(-size // PASSAGE)
    b = np.frombuffer(b"".join(raw) + bytes(5), np.uint8)
    total = int(size.sum())
    at = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    passage = np.repeat(np.cumsum(n) - n, size) + at // PASSAGE
    kind = CLASSES[b].astype(np.int64)
    pairs = np.bincount(passage * 256 + kind[:total] * 16 + kind[1:total + 1], minlength=int(n.sum()) * 256).reshape(-1, 256)
    length = np.bincount(passage, minlength=len(pairs))
    five = np.zeros(total, np.uint64)
    for i in range(5):
        five = five << np.uint64(8) | b[i:i + total]
    key = np.sort(passage.astype(np.uint64) << np.uint64(40) | five)
    new = np.r_[True, key[1:] != key[:-1]]
    different = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=len(pairs))
    x = np.empty((len(pairs), FEATURES), np.float32)
    x[:, :256] = np.sqrt(pairs / length[:, None])
    x[:, 256] = different / length
    x[:, 257] = np.minimum(length / PASSAGE, 1)
    return x, n


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(p: dict, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Scores of bags of ``n`` consecutive rows of ``x``."""
    start = np.cumsum(n) - n
    h = np.tanh(x @ p["E"] + p["e"])
    t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    a = (t * g) @ p["w"]
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, start), n))
    a /= np.repeat(np.add.reduceat(a, start), n)
    z = np.add.reduceat(a[:, None] * h, start)
    return sigmoid(z @ p["c"] + p["b"]), (h, t, g, a, z)


def gradients(p: dict, x, n, y, s, state) -> dict:
    h, t, g, a, z = state
    start = np.cumsum(n) - n
    d = (s - y) / len(y)
    dz = np.repeat(np.outer(d, p["c"]), n, axis=0)
    da = (dz * h).sum(1)
    da = a * (da - np.repeat(np.add.reduceat(a * da, start), n))
    dt, dg = np.outer(da, p["w"]) * g * (1 - t * t), np.outer(da, p["w"]) * t * g * (1 - g)
    dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
    return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ da, "c": z.T @ d, "b": d.sum()}


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 40, batch: int = 128, seed: int = 7) -> dict | None:
    """Adam on the bags; None if there is nothing to learn from."""
    if not len(bags):
        return None
    rng = np.random.default_rng(seed)
    mean, scale = np.concatenate(bags).mean(0), np.concatenate(bags).std(0) + 1e-3
    bags = [(b - mean) / scale for b in bags]
    p = {"E": rng.normal(0, FEATURES ** -0.5, (FEATURES, HIDDEN)), "e": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)),
         "U": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)), "w": rng.normal(0, GATE ** -0.5, GATE), "c": rng.normal(0, HIDDEN ** -0.5, HIDDEN),
         "b": np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))}
    m, v = {k: 0 * np.asarray(x) for k, x in p.items()}, {k: 0 * np.asarray(x) for k, x in p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            pick = order[i:i + batch]
            x, n, y = np.concatenate([bags[j] for j in pick]), np.array([len(bags[j]) for j in pick]), labels[pick]
            s, state = forward(p, x, n)
            step += 1
            for k, grad in gradients(p, x, n, y, s, state).items():
                grad = grad + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return {k: np.asarray(x, np.float32) for k, x in p.items()} | {"mean": mean, "scale": scale}


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train: Column) -> dict | None:
    picked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & train).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    picked = picked.orderBy(F.xxhash64("id"), "id", "y").limit(SAMPLE)
    texts = docs.select(F.col(id_col).alias("id"), F.octet_length(F.col(text_col)).alias("size")).join(F.broadcast(picked), "id")
    sizes = texts.groupBy("id", "y").agg(F.sum(F.ceil(F.greatest(F.coalesce("size", F.lit(0)), F.lit(1)) / PASSAGE)).alias("n"), F.xxhash64("id").alias("h"))
    sizes = sizes.orderBy("h", "id", "y").toPandas()  # SAMPLE rows
    if not len(sizes):
        return None
    sizes = sizes[(sizes["n"].cumsum() <= SAMPLE_PASSAGES) | (np.arange(len(sizes)) == 0)]
    kind = picked.schema["id"].dataType.simpleString()
    picked = docs.sparkSession.createDataFrame([(i, float(y)) for i, y in zip(sizes["id"].tolist(), sizes["y"].tolist())], f"id {kind}, y double")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")  # SAMPLE rows

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for t, y in zip(df["text"], df["y"]):
                x, _ = encode([t or ""])
                rows.append((x.astype(np.float16).tobytes(), y))
            yield pd.DataFrame(rows, columns=["x", "y"])

    got = texts.select("text", "y").mapInPandas(features, "x binary, y double").toPandas().sort_values(["x", "y"])
    bags = [np.frombuffer(x, np.float16).reshape(-1, FEATURES).astype(np.float32) for x in got["x"]]
    return fit(bags, got["y"].to_numpy())


def score(docs: DataFrame, labels: DataFrame, train: Column, held_out: Column, threshold: float = 0.7,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``id, held_out, score, predicted`` for every row of ``docs``."""
    model = learn(docs, labels, id_col, text_col, label_col, train)

    @F.pandas_udf("double")
    def quality(text: pd.Series) -> pd.Series:
        texts = text.fillna("").tolist()
        out = np.full(len(texts), 0.5)
        for i, j in slices(texts) if texts and model else ():
            x, n = encode(texts[i:j])
            out[i:j] = forward(model, ((x - model["mean"]) / model["scale"]).astype(np.float32), n)[0]
        return pd.Series(out)

    scored = docs.select(F.col(id_col), held_out.alias("held_out"), quality(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
