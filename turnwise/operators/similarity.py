"""Text and vector similarity between turns (TF-IDF, embeddings, keyword overlap).

TF-IDF is kept in long form ``(conversation_id, turn_id, term, weight)``; the
cosine of two turns sums over the shared terms, so only overlapping terms
are ever paired.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text, tokens
from ..functions.vectors import cosine, l2_normalize, pair_distance
from ..plans.scan import BLOCK, block_of, hand_back_by, ordered_scan, with_next, with_prev
from .ids import attach_scalar
from .segment import keep

CONV, TURN = "conversation_id", "turn_id"


def tfidf(df: DataFrame, message: str = "message", conv: str = CONV, turn: str = TURN,
          scope: str = "conversation", normalize: bool = True) -> DataFrame:
    """Scikit-learn-default TF-IDF with each message a document.

    ``idf = ln((1 + n) / (1 + df)) + 1``, weight = raw count * idf, rows
    L2-normalised.  ``scope='conversation'`` fits one vocabulary per
    conversation (the reference); ``'global'`` fits one over the whole table.
    Returns ``(conv, turn, term, tf, weight)``.
    """
    return _weights(df, message, conv, turn, scope, normalize)[0].select(conv, turn, "term", "tf", "weight")


def _weights(df: DataFrame, message: str, conv: str, turn: str, scope: str = "conversation", normalize: bool = True,
             neighbours: bool = False) -> tuple[DataFrame, DataFrame]:
    """TF-IDF rows, and the turns they come from; with the neighbours' turn ids if asked for.

    A term's frequency reaches its rows by (group, block, term), so that a word that stands in
    every turn is spread like the turns are.  Blocks are of a conversation's turns, or, where the
    group is the whole table, by a hash of the turn.
    """
    if scope not in ("conversation", "global"):
        raise ValueError("scope must be 'conversation' or 'global'")
    rows, grp = keep(df, conv, turn, message), [conv] if scope == "conversation" else []
    near = [turn] if neighbours else []
    if grp:
        rows = ordered_scan(rows, [conv], turn, prev=near, nxt=near, totals={"n_docs": F.lit(1)})
        b = BLOCK if BLOCK in rows.columns else "_tw_tb"
        rows = rows if b == BLOCK else rows.withColumn(b, block_of(rows, turn))
    else:
        b = "_tw_tb"
        spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = attach_scalar(rows, df.agg(F.count(F.lit(1)).alias("n_docs"))).withColumn(b, F.pmod(F.xxhash64(conv, turn), F.lit(spread)))
    ids = [conv, b, turn, "n_docs", *[p + turn for p in ("prev_", "next_") if neighbours]]
    text = normalize_text(message) if normalize else F.col(message)
    tf = rows.select(*ids, F.explode(tokens(text)).alias("term")).groupBy(*ids, "term").agg(F.count(F.lit(1)).alias("tf"))
    here = tf.groupBy(*grp, b, "term").agg(F.count(F.lit(1)).alias("_df"))
    dfreq = here.select(*grp, b, "term", F.sum("_df").over(Window.partitionBy(*grp, "term")).alias("df"))
    idf = F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    w = tf.join(dfreq, [*grp, b, "term"]).withColumn("raw", F.col("tf") * idf)
    l2 = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(conv, b, turn)))  # one message's terms
    return w.withColumn("weight", F.col("raw") / F.when(l2 > 0, l2).otherwise(F.lit(1.0))), rows


def consecutive_tfidf(df: DataFrame, message: str = "message", conv: str = CONV,
                      turn: str = TURN, out: str = "similarity") -> DataFrame:
    """Cosine of each turn's TF-IDF vector with the next turn's.

    One row per turn that has a next turn: ``(conv, turn, next_turn_id, out)``;
    no shared term gives 0.  A weight goes to the two pairs its turn is in; a pair's rows meet by
    (conversation, first turn), which no conversation makes hot.
    """
    w, rows = _weights(df, message, conv, turn, neighbours=True)
    nxt, zero = "next_" + turn, F.lit(0.0)
    first = F.struct(F.col(turn).alias("_first"), F.col(nxt).alias("_second"), F.col("weight").alias("_wa"), zero.alias("_wb"))
    second = F.struct(F.col("prev_" + turn).alias("_first"), F.col(turn).alias("_second"), zero.alias("_wa"), F.col("weight").alias("_wb"))
    in_pairs = F.array_compact(F.array(F.when(F.col(nxt).isNotNull(), first), F.when(F.col("prev_" + turn).isNotNull(), second)))
    parts = w.select(conv, "term", F.inline(in_pairs))
    pairs = rows.where(F.col(nxt).isNotNull()).select(conv, F.lit(None).cast("string").alias("term"), F.col(turn).alias("_first"),
                                                      F.col(nxt).alias("_second"), zero.alias("_wa"), zero.alias("_wb"))
    every = parts.unionByName(pairs).repartition(conv, "_first", "_second")
    s = every.groupBy(conv, "_first", "_second", "term").agg((F.sum("_wa") * F.sum("_wb")).alias("_p")) \
             .groupBy(conv, "_first", "_second").agg(F.sum("_p").alias(out))
    return s.select(conv, F.col("_first").alias(turn), F.col("_second").alias(nxt), out)


def shifts_below(sim: DataFrame, threshold: float = 0.1, col: str = "similarity") -> DataFrame:
    """Pairs whose similarity is below ``threshold`` (strict)."""
    return sim.filter(F.col(col) < threshold)


def shift_pairs(df: DataFrame, flags: DataFrame, conv: str = CONV, turn: str = TURN) -> DataFrame:
    """``(message i, message i+1)`` for each flagged pair start ``i``.

    ``flags`` holds ``(conv, turn)`` of the first turn of each flagged pair.
    """
    d = with_next(keep(df, conv, turn, "message"), [conv], turn, ["message"], prefix="next_")
    return d.join(flags.select(conv, turn), [conv, turn], "left_semi") \
            .select(conv, turn, F.col("message").alias("message_1"),
                    F.col("next_message").alias("message_2"))


def consecutive_cosine(df: DataFrame, vec: str = "embedding", conv: str = CONV,
                       turn: str = TURN, out: str = "similarity") -> DataFrame:
    """Cosine of each turn's vector with the next turn's (the diagonal only)."""
    d = with_next(df, [conv], turn, [vec, turn], prefix="next_")
    return d.withColumn(out, F.when(F.col("next_" + turn).isNotNull(),
                                    cosine(F.col(vec), F.col("next_" + vec)))) \
            .drop("next_" + vec)


def _kw_set(c, stopwords: Sequence[str]):
    t = F.array_distinct(tokens(c))
    if stopwords:
        t = F.array_except(t, F.array(*[F.lit(s) for s in stopwords]))
    return t


def _jaccard(sa, sb):
    return F.size(F.array_intersect(sa, sb)) / (F.size(F.array_union(sa, sb)) + F.lit(1e-6))


def keyword_overlap(a, b, stopwords: Sequence[str] = ()):
    """Jaccard of the distinct non-stop tokens, ``|A & B| / (|A | B| + 1e-6)``."""
    return _jaccard(_kw_set(a, stopwords), _kw_set(b, stopwords))


def keyword_overlap_prev(df: DataFrame, out: str, stopwords: Sequence[str] = (),
                         conv: str = CONV, turn: str = TURN) -> DataFrame:
    """Keyword overlap of each turn with the previous one (null on the first turn)."""
    d = with_prev(df, [conv], turn, ["message", turn], prefix="_kp_")
    # As columns of their own the sets are made once a row, not once for each use in the quotient.
    d = d.withColumn("_kp_a", _kw_set(F.col("_kp_message"), stopwords)).withColumn("_kp_b", _kw_set(F.col("message"), stopwords))
    ov = F.when(F.col("_kp_" + turn).isNotNull(), _jaccard(F.col("_kp_a"), F.col("_kp_b")))
    return d.withColumn(out, ov).drop("_kp_message", "_kp_" + turn, "_kp_a", "_kp_b")


MAP_LEMMAS = 1000  # a dictionary up to this size is looked up inside the row


def with_lemmas(df: DataFrame, words: str, lemmas: DataFrame, out: str, key: Sequence[str] = (CONV, TURN), map_limit: int = MAP_LEMMAS) -> DataFrame:
    """``out``: the words of an array column, each replaced by its lemma; a word without one stays.

    ``lemmas``: ``token, lemma``, one row per token.  A small dictionary (its size is checked) goes
    to every row as a map; a larger one is joined by (token, block of rows), so that a frequent
    word is spread, and the words return to their rows by ``key``, which must be unique.
    """
    if lemmas.limit(map_limit + 1).count() <= map_limit:
        one = lemmas.agg(F.map_from_entries(F.collect_list(F.struct("token", "lemma"))).alias("_tw_map"))
        d = attach_scalar(df, one)
        return d.withColumn(out, F.transform(words, lambda t: F.coalesce(F.try_element_at("_tw_map", t), t))).drop("_tw_map")
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = df.select(*key, F.posexplode(words).alias("_tw_at", "token")).withColumn("_tw_block", F.pmod(F.xxhash64(*key), F.lit(spread)))
    w = hand_back_by(w, ["token"], "_tw_block", lemmas.select("token", "lemma"), ["lemma"])
    placed = F.struct(F.col("_tw_at").alias("a"), F.coalesce("lemma", "token").alias("t"))
    back = w.groupBy(*key).agg(F.array_sort(F.collect_list(placed)).alias("_tw_list"))  # one row's words
    none = F.array().cast("array<string>")
    d = df.join(back, list(key), "left")
    return d.withColumn(out, F.when(F.col(words).isNotNull(), F.coalesce(F.transform("_tw_list", lambda x: x["t"]), none))).drop("_tw_list")


def lemma_overlap_prev(df: DataFrame, lemmas: DataFrame, out: str, stopwords: Sequence[str] = (),
                       conv: str = CONV, turn: str = TURN, map_limit: int = MAP_LEMMAS) -> DataFrame:
    """X7 on lemmas: Jaccard of the lemmas of non-stop words with those of the previous turn."""
    d = with_lemmas(keep(df, conv, turn, _kw_set(F.col("message"), stopwords).alias("_tw_kw")), "_tw_kw", lemmas, "_tw_lem", [conv, turn], map_limit)
    d = with_prev(d, [conv], turn, ["_tw_lem", turn], prefix="_kp_")
    a, b = F.col("_kp__tw_lem"), F.col("_tw_lem")
    ov = F.size(F.array_intersect(a, b)) / (F.size(F.array_union(a, b)) + F.lit(1e-6))
    return d.select(conv, turn, F.when(F.col("_kp_" + turn).isNotNull(), ov).alias(out))


def weak_label(df: DataFrame, vec: str = "embedding", sim_threshold: float = 0.25,
               overlap_threshold: float = 0.4, stopwords: Sequence[str] = (),
               mark: str = "before", conv: str = CONV, turn: str = TURN) -> DataFrame:
    """A shift where embedding cosine < ``sim_threshold`` and keyword overlap <
    ``overlap_threshold`` between a turn and the next.

    ``mark='before'`` (the reference) puts the label, ``similarity`` and
    ``keyword`` on the first turn of the pair; the last turn gets 0 and null
    scores.  ``mark='opening'`` puts them on the turn that opens the new
    segment (the first turn then gets 0 and null scores).
    """
    d = with_next(df, [conv], turn, [vec, "message", turn], prefix="_wn_")
    has = F.col("_wn_" + turn).isNotNull()
    d = d.withColumn("similarity", F.when(has, cosine(F.col(vec), F.col("_wn_" + vec))))
    d = d.withColumn("keyword", F.when(has, keyword_overlap(F.col("message"),
                                                           F.col("_wn_message"), stopwords)))
    lab = F.when(has & (F.col("similarity") < sim_threshold) & (F.col("keyword") < overlap_threshold), 1) \
           .otherwise(0).cast("int")
    d = d.withColumn("weak_shift", lab).drop("_wn_" + vec, "_wn_message", "_wn_" + turn)
    if mark == "before":
        return d
    if mark != "opening":
        raise ValueError("mark must be 'before' or 'opening'")
    scores = ["weak_shift", "similarity", "keyword"]
    p = with_prev(d, [conv], turn, scores, prefix="_wp_")
    return p.withColumn("weak_shift", F.coalesce("_wp_weak_shift", F.lit(0)).cast("int")) \
            .withColumn("similarity", F.col("_wp_similarity")).withColumn("keyword", F.col("_wp_keyword")) \
            .drop(*["_wp_" + c for c in scores])


def normalized_vectors(df: DataFrame, vec: str = "embedding", out: str = "unit") -> DataFrame:
    """``vec / max(||vec||, 1e-12)``."""
    return df.withColumn(out, l2_normalize(vec))


def distances(df: DataFrame, a: str, b: str, metric: str = "cosine", out: str = "distance") -> DataFrame:
    """Cosine or Euclidean distance between two vector columns."""
    return df.withColumn(out, pair_distance(a, b, metric))
