"""Queries for text and vector similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import similarity as sim
from ..sources import fixtures as fx
from .catalog import r6, register
from .oracle import cosine, dot, kw_overlap, norm_text, sql, toks, vnorm

_W = "PARTITION BY conversation_id ORDER BY turn_id"

# The stop list used by the keyword-overlap queries (a parameter of
# the operator; the fixture texts are in English, French, German and Spanish).
STOPWORDS = ("the", "and", "of", "to", "in", "is", "it", "that", "for", "on", "with", "as", "was",
             "are", "be", "by", "at", "or", "an", "this", "de", "la", "le", "et", "les", "des", "en",
             "un", "une", "der", "die", "das", "und", "ein", "zu", "el", "los", "las", "que", "y")

_TFIDF = f"""
    tok AS (SELECT conversation_id, turn_id, unnest({toks(norm_text('message'))}) AS term FROM turns),
    tf AS (SELECT conversation_id, turn_id, term, count(*) AS tf FROM tok GROUP BY ALL),
    dfq AS (SELECT conversation_id, term, count(*) AS df FROM tf GROUP BY ALL),
    nd AS (SELECT conversation_id, count(*) AS n_docs FROM turns GROUP BY 1),
    w0 AS (SELECT tf.*, tf.tf * (ln((1.0 + n_docs) / (1.0 + df)) + 1.0) AS raw
           FROM tf JOIN dfq USING (conversation_id, term) JOIN nd USING (conversation_id)),
    nrm AS (SELECT conversation_id, turn_id, sqrt(sum(raw * raw)) AS l2 FROM w0 GROUP BY ALL),
    w AS (SELECT conversation_id, turn_id, term, tf,
                 raw / CASE WHEN l2 > 0 THEN l2 ELSE 1.0 END AS weight
          FROM w0 JOIN nrm USING (conversation_id, turn_id)),
    nxt AS (SELECT * FROM (SELECT conversation_id, turn_id, lead(turn_id) OVER ({_W}) AS next_turn_id
                           FROM turns) WHERE next_turn_id IS NOT NULL),
    cs AS (SELECT n.conversation_id, n.turn_id, n.next_turn_id,
                  coalesce(sum(a.weight * b.weight), 0.0) AS similarity
           FROM nxt n
           LEFT JOIN w a ON a.conversation_id = n.conversation_id AND a.turn_id = n.turn_id
           LEFT JOIN w b ON b.conversation_id = n.conversation_id AND b.turn_id = n.next_turn_id
                        AND b.term = a.term
           GROUP BY ALL)"""


@register("x1_tfidf", sql(["turns"], """
    SELECT conversation_id, turn_id, term, tf, round(weight, 6) AS weight FROM w""", _TFIDF))
def x1_tfidf(spark, sf_dir):
    w = sim.tfidf(fx.turns(spark, sf_dir))
    return w.select("conversation_id", "turn_id", "term", "tf", r6("weight").alias("weight"))


_TFIDF_ALL = f"""
    tok AS (SELECT conversation_id, turn_id, unnest({toks(norm_text('message'))}) AS term FROM turns),
    tf AS (SELECT conversation_id, turn_id, term, count(*) AS tf FROM tok GROUP BY ALL),
    dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
    w0 AS (SELECT tf.*, tf.tf * (ln((1.0 + (SELECT count(*) FROM turns)) / (1.0 + df)) + 1.0) AS raw FROM tf JOIN dfq USING (term)),
    w AS (SELECT conversation_id, turn_id, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY conversation_id, turn_id)) AS weight FROM w0)"""


@register("x1_tfidf_global", sql(["turns"], """
    SELECT conversation_id, turn_id, term, tf, round(weight, 6) AS weight FROM w""", _TFIDF_ALL))
def x1_tfidf_global(spark, sf_dir):
    """One vocabulary for the whole table; frequent words are spread by the turns that hold them."""
    w = sim.tfidf(fx.turns(spark, sf_dir), scope="global")
    return w.select("conversation_id", "turn_id", "term", "tf", r6("weight").alias("weight"))


@register("x2_consecutive_tfidf", sql(["turns"], """
    SELECT conversation_id, turn_id, next_turn_id, round(similarity, 6) AS similarity FROM cs""", _TFIDF))
def x2_consecutive_tfidf(spark, sf_dir):
    s = sim.consecutive_tfidf(fx.laid_turns(spark, sf_dir))
    return s.select("conversation_id", "turn_id", "next_turn_id", r6("similarity").alias("similarity"))


@register("x3_shifts_below", sql(["turns"], """
    SELECT conversation_id, turn_id, round(similarity, 6) AS similarity FROM cs WHERE similarity < 0.1""",
                                  _TFIDF))
def x3_shifts_below(spark, sf_dir):
    s = sim.shifts_below(sim.consecutive_tfidf(fx.laid_turns(spark, sf_dir)), 0.1)
    return s.select("conversation_id", "turn_id", r6("similarity").alias("similarity"))


@register("x4_shift_pairs", sql(["turns"], f"""
    SELECT t.conversation_id, t.turn_id, t.message AS message_1, t.nm AS message_2
    FROM (SELECT *, lead(message) OVER ({_W}) AS nm FROM turns) t
    JOIN cs USING (conversation_id, turn_id) WHERE cs.similarity < 0.1""", _TFIDF))
def x4_shift_pairs(spark, sf_dir):
    t = fx.laid_turns(spark, sf_dir)
    flags = sim.shifts_below(sim.consecutive_tfidf(t), 0.1)
    return sim.shift_pairs(t, flags)


@register("x5_consecutive_cosine", sql(["emb_turns"], f"""
    SELECT conversation_id, turn_id, round(s, 6) AS similarity,
           CASE WHEN s < 0.5 THEN 1 ELSE 0 END AS below_05, CASE WHEN s < 0.3 THEN 1 ELSE 0 END AS below_03
    FROM (SELECT conversation_id, turn_id,
                 {cosine('embedding', f'lead(embedding) OVER ({_W})')} AS s FROM emb_turns)
    WHERE s IS NOT NULL"""))
def x5_consecutive_cosine(spark, sf_dir):
    c = sim.consecutive_cosine(fx.emb_turns(spark, sf_dir)).filter(F.col("similarity").isNotNull())
    return c.select("conversation_id", "turn_id", r6("similarity").alias("similarity"),
                    F.when(F.col("similarity") < 0.5, 1).otherwise(0).alias("below_05"),
                    F.when(F.col("similarity") < 0.3, 1).otherwise(0).alias("below_03"))


@register("x7_keyword_overlap", sql(["turns"], f"""
    SELECT conversation_id, turn_id, round(ov, 6) AS overlap FROM (
      SELECT conversation_id, turn_id,
             CASE WHEN lag(turn_id) OVER ({_W}) IS NULL THEN NULL
                  ELSE {kw_overlap(f'lag(message) OVER ({_W})', 'message', STOPWORDS)} END AS ov
      FROM turns)"""))
def x7_keyword_overlap(spark, sf_dir):
    d = sim.keyword_overlap_prev(fx.turns(spark, sf_dir), "overlap", STOPWORDS)
    return d.select("conversation_id", "turn_id", r6("overlap").alias("overlap"))


def plural_lemmas(turns):
    """A dictionary from the corpus itself: a word in -s whose form without it also occurs."""
    words = turns.select(F.explode(sim.tokens("message")).alias("token")).distinct()
    forms = words.select(F.concat("token", F.lit("s")).alias("token"), F.col("token").alias("lemma")).where(F.length("lemma") >= 3)
    return words.join(forms, "token")


_LEMMAS = f"""
    words AS (SELECT DISTINCT unnest({toks('message')}) AS token FROM turns),
    lem AS (SELECT a.token, b.token AS lemma FROM words a JOIN words b ON a.token = b.token || 's' WHERE length(b.token) >= 3),
    kw AS (SELECT conversation_id, turn_id, list_filter(list_distinct({toks('message')}),
                  lambda z: NOT list_contains([{", ".join("'" + w + "'" for w in STOPWORDS)}], z)) AS ws FROM turns),
    lw AS (SELECT conversation_id, turn_id, list_distinct(coalesce(list(coalesce(lemma, w)) FILTER (w IS NOT NULL), [])) AS ls
           FROM (SELECT conversation_id, turn_id, unnest(CASE WHEN len(ws) = 0 THEN [NULL] ELSE ws END) AS w FROM kw)
           LEFT JOIN lem ON lem.token = w GROUP BY ALL)"""


@register("x7_lemma_overlap", sql(["turns"], f"""
    SELECT conversation_id, turn_id, round(CASE WHEN p IS NULL THEN NULL
             ELSE len(list_intersect(p, ls)) / (len(list_distinct(list_concat(p, ls))) + 1e-6) END, 6) AS overlap
    FROM (SELECT *, lag(ls) OVER ({_W}) AS p FROM lw)""", _LEMMAS))
def x7_lemma_overlap(spark, sf_dir):
    """Keyword overlap on lemmas; the dictionary grows with the corpus and is joined."""
    t = fx.turns(spark, sf_dir)
    d = sim.lemma_overlap_prev(t, plural_lemmas(t), "overlap", STOPWORDS, map_limit=0)
    return d.select("conversation_id", "turn_id", r6("overlap").alias("overlap"))


def _all_emb_msg(spark, sf_dir):
    """Every turn; the embedding is null where there is none."""
    e = fx.emb_turns(spark, sf_dir).select("conversation_id", "turn_id", "embedding")
    t = fx.turns(spark, sf_dir).select("conversation_id", "turn_id", "message")
    return t.join(e, ["conversation_id", "turn_id"], "left")


_ALL_EMB_MSG = """
    em AS (SELECT t.conversation_id, t.turn_id, e.embedding, t.message
           FROM turns t LEFT JOIN emb_turns e USING (conversation_id, turn_id))"""


def _x8_sql(mark: str, em: str = _ALL_EMB_MSG) -> str:
    scores = f"""
      SELECT conversation_id, turn_id,
             CASE WHEN lead(turn_id) OVER ({_W}) IS NULL THEN NULL
                  ELSE {cosine('embedding', f'lead(embedding) OVER ({_W})')} END AS s,
             CASE WHEN lead(turn_id) OVER ({_W}) IS NULL THEN NULL
                  ELSE {kw_overlap('message', f'lead(message) OVER ({_W})', STOPWORDS)} END AS k
      FROM em"""
    lab = "CASE WHEN s IS NOT NULL AND s < 0.25 AND k < 0.4 THEN 1 ELSE 0 END"
    if mark == "before":
        body = f"SELECT conversation_id, turn_id, {lab} AS weak_shift, round(s, 6) AS similarity, " \
               f"round(k, 6) AS keyword FROM ({scores})"
    else:
        body = f"""SELECT conversation_id, turn_id,
                   coalesce(lag({lab}) OVER ({_W}), 0) AS weak_shift,
                   round(lag(s) OVER ({_W}), 6) AS similarity, round(lag(k) OVER ({_W}), 6) AS keyword
                   FROM ({scores})"""
    return sql(["emb_turns", "turns"], body, em)


@register("x8_weak_label_all", _x8_sql("before"))
def x8_weak_label_all(spark, sf_dir):
    """Every turn is labelled and meets its true neighbour; without a vector the similarity is null."""
    d = sim.weak_label(_all_emb_msg(spark, sf_dir), stopwords=STOPWORDS)
    return d.select("conversation_id", "turn_id", "weak_shift", r6("similarity").alias("similarity"),
                    r6("keyword").alias("keyword"))


@register("x8_weak_label_opening_all", _x8_sql("opening"))
def x8_weak_label_opening_all(spark, sf_dir):
    d = sim.weak_label(_all_emb_msg(spark, sf_dir), stopwords=STOPWORDS, mark="opening")
    return d.select("conversation_id", "turn_id", "weak_shift", r6("similarity").alias("similarity"),
                    r6("keyword").alias("keyword"))


@register("x9_l2_normalize_all", sql([], f"""
    SELECT vec_id, i - 1 AS i, round(u[i], 6) AS value
    FROM (SELECT vec_id, u, unnest(range(1, len(u) + 1)) AS i
          FROM (SELECT vec_id, list_transform(embedding, lambda z:
                       CAST(z AS DOUBLE) / greatest({vnorm('embedding')}, 1e-12)) AS u FROM embeddings))"""))
def x9_l2_normalize_all(spark, sf_dir):
    """Every component of every vector, of whatever length."""
    e = sim.normalized_vectors(fx.table(spark, sf_dir, "embeddings"), "embedding", "unit")
    e = e.select("vec_id", F.posexplode("unit").alias("i", "value"))
    return e.select("vec_id", F.col("i").cast("long").alias("i"), r6("value").alias("value"))


@register("x10_pair_distance", sql(["emb_turns"], f"""
    SELECT conversation_id, turn_id,
           round(1.0 - {dot('u', 'nu')}, 6) AS cosine_distance,
           round(sqrt(list_sum(list_transform(list_zip(embedding, ne),
                 lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2))), 6) AS euclidean_distance
    FROM (SELECT conversation_id, turn_id, embedding, ne,
                 list_transform(embedding, lambda z: CAST(z AS DOUBLE) / greatest({vnorm('embedding')}, 1e-12)) AS u,
                 list_transform(ne, lambda z: CAST(z AS DOUBLE) / greatest({vnorm('ne')}, 1e-12)) AS nu
          FROM (SELECT *, lead(embedding) OVER ({_W}) AS ne FROM emb_turns))
    WHERE ne IS NOT NULL"""))
def x10_pair_distance(spark, sf_dir):
    from ..plans.scan import with_next
    e = fx.emb_turns(spark, sf_dir).select("conversation_id", "turn_id", "embedding")
    d = with_next(e, ["conversation_id"], "turn_id", ["embedding"], prefix="n_") \
        .filter(F.col("n_embedding").isNotNull())
    d = sim.distances(d, "embedding", "n_embedding", "cosine", "cosine_distance")
    d = sim.distances(d, "embedding", "n_embedding", "euclidean", "euclidean_distance")
    return d.select("conversation_id", "turn_id", r6("cosine_distance").alias("cosine_distance"),
                    r6("euclidean_distance").alias("euclidean_distance"))
