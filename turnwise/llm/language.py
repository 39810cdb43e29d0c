"""Operator 2: language identification by fusing evidence.

Evidence per document: the text's likelihood under each language's byte-trigram model, the
language its markup (or metadata) declares, its address suffix, and its host.  The trigram
models are learned from all texts by their declared language.  Host priors are hierarchical:
languages over all documents, per suffix smoothed by that, per host smoothed by its suffix, from
grouped sums of the documents' posteriors without host evidence; a document's own share is
taken out before it is used for it.  Naive Bayes puts them together, with an extra class ``und``
of uniform trigrams for texts in no known language.

Scale: two passes over the texts, neither moves them; sums of (language, trigram) and of
(suffix, host) are pre-aggregated.  The models are ``len(languages) * BUCKETS`` numbers.  The
host table is written before the join, so AQE can split a host that a third of the rows share.

Defined results: null or empty texts are ``und`` and rejected; a null or unknown declaration, a
null host or suffix is no evidence (rows without host share the prior of "no host"); repeated
rows are judged alike; an empty table gives no rows; columns of other names are kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

BUCKETS = 1 << 15
RELIABLE = 0.9   # how often a declaration is right
STRENGTH = 20.0  # documents that a smoothing prior is worth
SLICE = 200_000   # characters whose trigrams are in memory at a time (one text at least)
WORTH = 60.0     # trigrams that the whole text's likelihood is worth at most
LANGUAGES = ("en", "fr", "de", "es")


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams without digits of all texts in lower case, and each text's number of
    them.  A space stands before and after each text."""
    raw = [b" " + t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    b = np.frombuffer(b"".join(raw) + b"  ", np.uint8)
    w = b.astype(np.uint32)
    code = ((w[:-2] * np.uint32(0x9E3779B1) ^ w[1:-1] * np.uint32(0x85EBCA77) ^ w[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(7)) % np.uint32(BUCKETS)
    digit = (b >= 48) & (b < 58)
    use = ~(digit[:-2] | digit[1:-1] | digit[2:])
    ends = np.cumsum([len(r) for r in raw])
    use[ends - 2] = use[ends - 1] = False  # these would reach into the next text
    n = np.add.reduceat(use.astype(np.int64), np.r_[0, ends[:-1]])
    return code[use], n


def learn(docs: DataFrame, languages: tuple[str, ...], text: str, declared: str) -> np.ndarray:
    """Log probabilities, one row per language and a uniform last row, from declared languages."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for df in batches:
            for k, name in enumerate(languages):
                texts = df["text"][df["declared"] == name].tolist()
                for i, j in slices(texts, SLICE) if texts else ():
                    total[k] += np.bincount(trigrams(texts[i:j])[0], minlength=BUCKETS)
        lang, bucket = np.nonzero(total)
        yield pd.DataFrame({"lang": lang.astype(np.int32), "bucket": bucket.astype(np.int32), "n": total[lang, bucket]})

    rows = docs.select(F.col(text).alias("text"), F.col(declared).alias("declared")).where(F.col("text").isNotNull() & F.col("declared").isin(*languages))
    # len(languages) * BUCKETS rows at most
    sums = rows.mapInPandas(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((len(languages), BUCKETS), 0.5)
    counts[sums["lang"], sums["bucket"]] += sums["n"]
    return np.log(np.vstack([counts / counts.sum(1, keepdims=True), np.full(BUCKETS, 1 / BUCKETS)]))


def likelihoods(model: np.ndarray, names: list[str]):
    """Scalar function of a text: its tempered log likelihood in each class (zeros without text)."""
    @F.pandas_udf("array<double>")
    def score(text: pd.Series) -> pd.Series:
        texts = text.fillna("").tolist()
        out = np.zeros((len(texts), len(names)))
        for i, j in slices(texts, SLICE) if texts else ():
            codes, n = trigrams(texts[i:j])
            ends = np.cumsum(n)
            for k in range(len(names)):
                run = np.concatenate([[0.0], np.cumsum(model[k][codes])])
                out[i:j, k] = (run[ends] - run[ends - n]) / np.maximum(n, 1) * (WORTH * n / (WORTH + n))
        return pd.Series(list(out))

    return score


def text_evidence(docs: DataFrame, keep: dict[str, Column], text: str = "text", declared: str = "lang",
                  languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Written ``keep`` columns, ``declared``, ``has_text`` and ``ll``; the texts stay behind."""
    names = [*languages, "und"]
    score = likelihoods(learn(docs, languages, text, declared), names)
    return stored(docs.select(*[c.alias(n) for n, c in keep.items()], F.col(declared).alias("declared"),
                              (F.length(F.coalesce(F.col(text), F.lit(""))) > 0).alias("has_text"), score(F.col(text)).alias("ll")), "language")


def fuse(rows: DataFrame, languages: tuple[str, ...] = LANGUAGES, threshold: float = 0.5) -> DataFrame:
    """Adds ``lang_id, confidence, rejected`` to rows with ``ll, has_text, declared, host, suffix``."""
    names = [*languages, "und"]
    match = lambda k: F.when(F.col("declared").isin(*languages), F.log(F.when(
        F.col("declared") == names[k], RELIABLE).otherwise((1 - RELIABLE) / len(languages)))).otherwise(0.0)
    logit = [F.col("ll")[k] + match(k) for k in range(len(names))]
    rows = rows.withColumn("_l", F.array(*logit))
    rows = rows.withColumn("_t", F.transform("_l", lambda x: F.exp(x - F.array_max("_l"))))
    rows = rows.withColumn("_p", F.transform("_t", lambda x: x / F.aggregate("_t", F.lit(0.0), lambda a, y: a + y)))
    rows = rows.drop("_l", "_t")
    shares = [F.sum(F.col("_p")[k]).alias(f"s{k}") for k in range(len(names))]
    # Rows without text give nothing: their posterior would only repeat the declaration.
    hosts = stored(rows.where("has_text").groupBy("suffix", "host").agg(F.count("*").alias("n"), *shares), "hosts")
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("sn"), *[F.sum(f"s{k}").alias(f"ss{k}") for k in range(len(names))])
    whole = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("wn"), *[F.coalesce(F.sum(f"s{k}"), F.lit(0.0)).alias(f"w{k}") for k in range(len(names))]).first()
    root = [(whole[f"w{k}"] + 1) / (whole["wn"] + len(names)) for k in range(len(names))]
    table = stored(hosts.alias("h").join(suffixes.alias("x"), F.expr("h.suffix <=> x.suffix")).drop(F.col("x.suffix")), "host-priors")
    joined = rows.alias("r").join(table.alias("t"), F.expr("r.suffix <=> t.suffix AND r.host <=> t.host"), "left")
    own = F.when(F.col("r.has_text"), 1.0).otherwise(0.0)
    n = F.greatest(F.coalesce("t.n", F.lit(0)) - own, F.lit(0.0))
    sn = F.greatest(F.coalesce("t.sn", F.lit(0)) - own, F.lit(0.0))
    final = []
    for k in range(len(names)):
        mine = own * F.col("r._p")[k]
        of_suffix = (F.greatest(F.coalesce(f"t.ss{k}", F.lit(0.0)) - mine, F.lit(0.0)) + STRENGTH * root[k]) / (sn + STRENGTH)
        of_host = (F.greatest(F.coalesce(f"t.s{k}", F.lit(0.0)) - mine, F.lit(0.0)) + STRENGTH * of_suffix) / (n + STRENGTH)
        final.append(F.log(of_host) + F.log(F.greatest(F.col("r._p")[k], F.lit(1e-300))))
    kept = [F.col(f"r.`{c}`") for c in rows.columns if c not in ("_p", "ll")]
    out = joined.select(*kept, F.array(*final).alias("_f")).withColumn("_best", F.array_max("_f"))
    out = out.withColumn("_name", F.get(F.array(*[F.lit(x) for x in names]), F.array_position("_f", F.col("_best")).cast("int") - 1)) \
             .withColumn("_conf", 1 / F.aggregate("_f", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_best"))))
    out = out.withColumn("lang_id", F.when(F.col("has_text"), F.col("_name")).otherwise("und")) \
             .withColumn("confidence", F.when(F.col("has_text"), F.col("_conf")).otherwise(0.0))
    return out.withColumn("rejected", (F.col("lang_id") == "und") | (F.col("confidence") < threshold)).drop("_name", "_conf", "_f", "_best")


def suffix_of(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, r"\.([A-Za-z]+)$", 1), F.lit(""))


def page_evidence(pages: DataFrame) -> DataFrame:
    """``page_of`` (the document number in the address), ``markup, host, suffix`` of its first page."""
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1))
    rows = pages.select(F.regexp_extract("url", r"/(\d+)(?:[/.?#]|$)", 1).alias("number"), "page_id",
                        F.nullif(F.regexp_extract("html", "(?i)<html[^>]*\\slang=[\"']?([A-Za-z]+)", 1), F.lit("")).alias("markup"), host.alias("host"))
    rows = rows.where("number <> ''").groupBy(F.expr("try_cast(number AS bigint)").alias("page_of")) \
               .agg(F.min(F.struct("page_id", "markup", "host")).alias("page"))
    return rows.select("page_of", F.lower("page.markup").alias("markup"), "page.host", suffix_of(F.col("page.host")).alias("suffix"))


def identify(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text, lang, source``): ``doc_id, th, declared, lang_id, confidence,
    rejected``.  Where ``pages`` has a page of the document, its markup and address are evidence;
    elsewhere ``lang`` is the declaration and ``source`` the host."""
    rows = text_evidence(docs, {"doc_id": F.col("doc_id"), "th": F.xxhash64("text"), "source": F.col("source")})
    if pages is None:
        rows = rows.withColumn("host", F.col("source")).withColumn("suffix", F.lit(None).cast("string"))
    else:
        found = stored(page_evidence(pages), "page-evidence")
        rows = rows.join(found, rows.doc_id == found.page_of, "left") \
                   .withColumn("declared", F.coalesce("markup", "declared")).withColumn("host", F.coalesce("host", "source"))
        rows = stored(rows.drop("markup", "page_of"), "evidence")
    return fuse(rows).select("doc_id", "th", "declared", "lang_id", "confidence", "rejected")


def keep_known(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``docs`` without the documents whose language ``identify`` rejects."""
    bad = stored(identify(docs, pages).where("rejected").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct(), "rejected")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_th"]), "left_anti")
