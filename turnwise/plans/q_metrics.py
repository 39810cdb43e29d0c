"""Queries for predictions, losses and segmentation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import augment, losses, metrics, model
from ..plans.scan import with_next
from ..sources import fixtures as fx
from .catalog import r6, register
from .oracle import cosine, dot, sql, vnorm

_W = "PARTITION BY conversation_id ORDER BY turn_id"
_CE = ("(greatest(logit0, logit1) + ln(exp(logit0 - greatest(logit0, logit1)) "
       "+ exp(logit1 - greatest(logit0, logit1))) - CASE WHEN label = 1 THEN logit1 ELSE logit0 END)")


@register("m1_predict_threshold", sql(["logits"], """
    SELECT conversation_id, turn_id, round(1.0 / (1.0 + exp(logit0 - logit1)), 6) AS p1,
           CASE WHEN 1.0 / (1.0 + exp(logit0 - logit1)) > 0.63 THEN 1 ELSE 0 END AS pred
    FROM logits"""))
def m1_predict_threshold(spark, sf_dir):
    d = metrics.predict_threshold(fx.logits(spark, sf_dir), 0.63)
    return d.select("conversation_id", "turn_id", r6("p1").alias("p1"), "pred")


@register("m2_accuracy", sql(["logits"], """
    SELECT round(avg(CASE WHEN (CASE WHEN logit1 > logit0 THEN 1 ELSE 0 END) = label THEN 1.0 ELSE 0.0 END), 6)
             AS accuracy FROM logits"""))
def m2_accuracy(spark, sf_dir):
    d = metrics.predict_argmax(fx.logits(spark, sf_dir))
    return metrics.accuracy(d, "label", "pred").select(r6("accuracy").alias("accuracy"))


@register("m3_cross_entropy", sql(["logits"], f"""
    SELECT round(avg(m), 6) AS cross_entropy, count(*) AS n_batches FROM (
      SELECT b, avg(ce) AS m FROM (
        SELECT (row_number() OVER (ORDER BY conversation_id, turn_id) - 1) // 32 AS b, {_CE} AS ce
        FROM logits) GROUP BY b)"""))
def m3_cross_entropy(spark, sf_dir):
    r = losses.cross_entropy(fx.logits(spark, sf_dir), ["conversation_id", "turn_id"], 32)
    return r.select(r6("cross_entropy").alias("cross_entropy"), "n_batches")


@register("m4_focal_loss", sql(["logits"], f"""
    SELECT round(avg(CASE WHEN label = 1 THEN 0.75 ELSE 0.25 END * pow(1.0 - exp(-({_CE})), 2) * ({_CE})), 6)
             AS focal_loss FROM logits"""))
def m4_focal_loss(spark, sf_dir):
    return losses.focal_loss(fx.logits(spark, sf_dir)).select(r6("focal_loss").alias("focal_loss"))


def _emb_pairs(spark, sf_dir):
    e = fx.emb_turns(spark, sf_dir).select("conversation_id", "turn_id", "sub_conversation_id", "embedding")
    d = with_next(e, ["conversation_id"], "turn_id", ["embedding", "sub_conversation_id"], prefix="n_")
    d = d.filter(F.col("n_embedding").isNotNull())
    return d.withColumn("label", (F.col("sub_conversation_id") == F.col("n_sub_conversation_id")).cast("int"))


_PAIRS = f"""
    ep AS (SELECT * FROM (SELECT conversation_id, turn_id, embedding,
                                 lead(embedding) OVER ({_W}) AS ne,
                                 CASE WHEN lead(sub_conversation_id) OVER ({_W}) = sub_conversation_id
                                      THEN 1 ELSE 0 END AS label
                          FROM emb_turns) WHERE ne IS NOT NULL),
    ed AS (SELECT *, 1.0 - {cosine('embedding', 'ne')} AS d FROM ep)"""


@register("m5_contrastive_rows", sql(["emb_turns"], """
    SELECT conversation_id, turn_id, label, round(d, 6) AS distance,
           round(2.0 * label * d * d + (1 - label) * ln(1 + exp(1.5 - d)), 6) AS loss FROM ed""", _PAIRS))
def m5_contrastive_rows(spark, sf_dir):
    r = losses.contrastive_rows(_emb_pairs(spark, sf_dir), "embedding", "n_embedding", "label", 1.5)
    return r.select("conversation_id", "turn_id", "label", r6("distance").alias("distance"),
                    r6("loss").alias("loss"))


@register("m5_contrastive_loss", sql(["emb_turns"], """
    SELECT round(sum(2.0 * label * d * d + (1 - label) * ln(1 + exp(1.5 - d))), 6) AS loss,
           round(sum(2.0 * label * d * d), 6) AS positive_loss,
           round(sum((1 - label) * ln(1 + exp(1.5 - d))), 6) AS negative_loss,
           count(*) AS n_pairs FROM ed""", _PAIRS))
def m5_contrastive_loss(spark, sf_dir):
    r = losses.contrastive_loss(_emb_pairs(spark, sf_dir), "embedding", "n_embedding", "label", 1.5)
    return r.select(r6("loss").alias("loss"), r6("positive_loss").alias("positive_loss"),
                    r6("negative_loss").alias("negative_loss"), "n_pairs")


def _unit(x: str) -> str:
    return f"list_transform({x}, lambda z: CAST(z AS DOUBLE) / greatest({vnorm(x)}, 1e-12))"


@register("m6_nt_xent", sql(["emb_turns"], f"""
    SELECT round(avg(m), 6) AS nt_xent, count(*) AS n_batches FROM (
      SELECT b, avg(l) AS m FROM (
        SELECT a.b, a.pos, ln(sum(exp({dot('a.ha', 'mm.hm')} / 0.5))) - {dot('a.ha', 'a.hb')} / 0.5 AS l
        FROM u a JOIN (SELECT b, ha AS hm FROM u UNION ALL SELECT b, hb FROM u) mm ON mm.b = a.b
        GROUP BY a.b, a.pos, a.ha, a.hb)
      GROUP BY b)""", _PAIRS + f""",
    u AS (SELECT (row_number() OVER (ORDER BY conversation_id, turn_id) - 1) // 8 AS b,
                 row_number() OVER (ORDER BY conversation_id, turn_id) - 1 AS pos,
                 {_unit('embedding')} AS ha, {_unit('ne')} AS hb FROM ep)"""))
def m6_nt_xent(spark, sf_dir):
    r = losses.nt_xent(_emb_pairs(spark, sf_dir), "embedding", "n_embedding",
                       ["conversation_id", "turn_id"], tau=0.5, batch_size=8)
    return r.select(r6("nt_xent").alias("nt_xent"), "n_batches")


_REPORT = """
    c AS (SELECT count(*) AS n,
                 CAST(count_if(topic_shift = 0 AND pred_shift = 0) AS BIGINT) AS tp0, CAST(count_if(pred_shift = 0) AS BIGINT) AS pp0,
                 CAST(count_if(topic_shift = 0) AS BIGINT) AS sp0,
                 CAST(count_if(topic_shift = 1 AND pred_shift = 1) AS BIGINT) AS tp1, CAST(count_if(pred_shift = 1) AS BIGINT) AS pp1,
                 CAST(count_if(topic_shift = 1) AS BIGINT) AS sp1 FROM preds),
    m AS (SELECT *, CASE WHEN pp0 > 0 THEN tp0 / pp0 ELSE 0.0 END AS pr0,
                 CASE WHEN sp0 > 0 THEN tp0 / sp0 ELSE 0.0 END AS rc0,
                 CASE WHEN pp1 > 0 THEN tp1 / pp1 ELSE 0.0 END AS pr1,
                 CASE WHEN sp1 > 0 THEN tp1 / sp1 ELSE 0.0 END AS rc1 FROM c),
    f AS (SELECT *, CASE WHEN pr0 + rc0 > 0 THEN 2 * pr0 * rc0 / (pr0 + rc0) ELSE 0.0 END AS f0,
                 CASE WHEN pr1 + rc1 > 0 THEN 2 * pr1 * rc1 / (pr1 + rc1) ELSE 0.0 END AS f1 FROM m)"""


@register("m7_classification_report", sql(["preds"], """
    SELECT 'No Shift' AS class_name, round(pr0, 6) AS precision, round(rc0, 6) AS recall,
           round(f0, 6) AS f1_score, CAST(sp0 AS BIGINT) AS support FROM f
    UNION ALL SELECT 'Topic Shift', round(pr1, 6), round(rc1, 6), round(f1, 6), sp1 FROM f
    UNION ALL SELECT 'accuracy', NULL, NULL, round((tp0 + tp1) / n, 6), n FROM f
    UNION ALL SELECT 'macro avg', round((pr0 + pr1) / 2, 6), round((rc0 + rc1) / 2, 6),
                     round((f0 + f1) / 2, 6), n FROM f
    UNION ALL SELECT 'weighted avg', round((pr0 * sp0 + pr1 * sp1) / n, 6), round((rc0 * sp0 + rc1 * sp1) / n, 6),
                     round((f0 * sp0 + f1 * sp1) / n, 6), n FROM f""", _REPORT))
def m7_classification_report(spark, sf_dir):
    """Weak lexical predictions against the true segment starts."""
    r = metrics.classification_report(fx.preds(spark, sf_dir), "topic_shift", "pred_shift")
    return r.select("class_name", r6("precision").alias("precision"), r6("recall").alias("recall"),
                    r6("f1_score").alias("f1_score"), "support")


_SEQ = """
    seq AS (SELECT row_number() OVER w - 1 AS pos,
                   CASE WHEN coalesce(lag(topic_shift) OVER w, topic_shift) <> topic_shift THEN 1 ELSE 0 END AS tb,
                   CASE WHEN coalesce(lag(pred_shift) OVER w, pred_shift) <> pred_shift THEN 1 ELSE 0 END AS pb
            FROM preds WINDOW w AS (ORDER BY conversation_id, turn_id)),
    nn AS (SELECT count(*) AS n FROM seq),
    win AS (SELECT i.pos AS i, sum(s.tb) AS tc, sum(s.pb) AS pc
            FROM seq i JOIN seq s ON s.pos >= i.pos AND s.pos < i.pos + 2
            WHERE i.pos < (SELECT n FROM nn) - 2 GROUP BY i.pos),
    errs AS (SELECT (SELECT n FROM nn) AS n, CAST(count_if((tc > 0) <> (pc > 0)) AS BIGINT) AS pk_errors,
                    CAST(count_if(tc <> pc) AS BIGINT) AS wd_errors FROM win),
    tpos AS (SELECT pos FROM seq WHERE tb = 1),
    ppos AS (SELECT pos FROM seq WHERE pb = 1),
    dist AS (SELECT t.pos, min(abs(t.pos - p.pos)) AS d FROM tpos t CROSS JOIN ppos p GROUP BY t.pos),
    mae AS (SELECT (SELECT count(*) FROM tpos) AS n_true, (SELECT count(*) FROM ppos) AS n_pred,
                   CASE WHEN (SELECT count(*) FROM tpos) = 0 OR (SELECT count(*) FROM ppos) = 0
                        THEN CAST((SELECT count(*) FROM tpos) + (SELECT count(*) FROM ppos) AS DOUBLE)
                        ELSE (SELECT avg(d) FROM dist) END AS mae)"""


def _seq(spark, sf_dir, scope="global"):
    return metrics.sequence_boundaries(fx.preds(spark, sf_dir), "topic_shift", "pred_shift", scope)


@register("m8_window_size", sql(["preds"], """
    SELECT round(count(*) / (2.0 * sum(tb)), 6) AS window_size FROM seq""", _SEQ))
def m8_window_size(spark, sf_dir):
    return metrics.window_size(_seq(spark, sf_dir)).select(r6("window_size").alias("window_size"))


@register("m9_m10_window_errors", sql(["preds"], """
    SELECT n, pk_errors, wd_errors, round(pk_errors / (n - 2), 6) AS pk,
           round(wd_errors / (n - 2), 6) AS window_diff FROM errs""", _SEQ))
def m9_m10_window_errors(spark, sf_dir):
    """Pk (M9) and WindowDiff (M10), k = 2, over the whole label sequence."""
    e = metrics.window_errors(_seq(spark, sf_dir), 2)
    return e.select("n", "pk_errors", "wd_errors", r6("pk").alias("pk"), r6("window_diff").alias("window_diff"))


@register("m11_boundary_mae", sql(["preds"], """
    SELECT n_true, n_pred, round(mae, 6) AS mae FROM mae""", _SEQ))
def m11_boundary_mae(spark, sf_dir):
    m = metrics.boundary_mae(_seq(spark, sf_dir))
    return m.select("n_true", "n_pred", r6("mae").alias("mae"))


@register("m12_segmentation_report", sql(["preds"], """
    SELECT round(pk_errors / (n - 2), 6) AS Pk, round(wd_errors / (n - 2), 6) AS WD, round(mae, 6) AS MAE
    FROM errs CROSS JOIN mae""", _SEQ))
def m12_segmentation_report(spark, sf_dir):
    r = metrics.segmentation_report(fx.preds(spark, sf_dir), "topic_shift", "pred_shift", 2)
    return r.select(r6("Pk").alias("Pk"), r6("WD").alias("WD"), r6("MAE").alias("MAE"))


_SEQ_CONV = f"""
    cseq AS (SELECT conversation_id, row_number() OVER ({_W}) - 1 AS pos,
                    CASE WHEN coalesce(lag(topic_shift) OVER ({_W}), topic_shift) <> topic_shift
                         THEN 1 ELSE 0 END AS tb,
                    CASE WHEN coalesce(lag(pred_shift) OVER ({_W}), pred_shift) <> pred_shift
                         THEN 1 ELSE 0 END AS pb
             FROM preds),
    cn AS (SELECT conversation_id, count(*) AS n, count_if(tb = 1) AS nt, count_if(pb = 1) AS np
           FROM cseq GROUP BY 1),
    cwin AS (SELECT i.conversation_id, i.pos AS i, sum(s.tb) AS tc, sum(s.pb) AS pc
             FROM cseq i JOIN cn USING (conversation_id)
             JOIN cseq s ON s.conversation_id = i.conversation_id AND s.pos >= i.pos AND s.pos < i.pos + 2
             WHERE i.pos < cn.n - 2 GROUP BY 1, 2),
    cerr AS (SELECT conversation_id, count_if((tc > 0) <> (pc > 0)) AS pke, count_if(tc <> pc) AS wde
             FROM cwin GROUP BY 1),
    cd AS (SELECT t.conversation_id, t.pos, min(abs(t.pos - p.pos)) AS d
           FROM cseq t JOIN cseq p ON p.conversation_id = t.conversation_id AND p.pb = 1
           WHERE t.tb = 1 GROUP BY 1, 2)"""


@register("m12_segmentation_report_conversation", sql(["preds"], """
    SELECT cn.conversation_id,
           round(CASE WHEN n > 2 THEN coalesce(pke, 0) / (n - 2) END, 6) AS Pk,
           round(CASE WHEN n > 2 THEN coalesce(wde, 0) / (n - 2) END, 6) AS WD,
           round(CASE WHEN nt = 0 OR np = 0 THEN CAST(nt + np AS DOUBLE)
                      ELSE (SELECT avg(d) FROM cd WHERE cd.conversation_id = cn.conversation_id) END, 6) AS MAE
    FROM cn LEFT JOIN cerr USING (conversation_id)""", _SEQ_CONV))
def m12_segmentation_report_conversation(spark, sf_dir):
    r = metrics.segmentation_report(fx.preds(spark, sf_dir), "topic_shift", "pred_shift", 2,
                                    scope="conversation")
    return r.select("conversation_id", r6("Pk").alias("Pk"), r6("WD").alias("WD"), r6("MAE").alias("MAE"))


@register("m13_fit_classifier")
def m13_fit_classifier(spark, sf_dir):
    """Weighted logistic regression on the turn vectors (rows-only check)."""
    e = fx.emb_turns(spark, sf_dir).select("conversation_id", "turn_id", "embedding", "topic_shift")
    m = model.fit_classifier(e, "embedding", "topic_shift", weighted=True, max_iter=50)
    p = model.predict(m, e, "embedding", ["conversation_id", "turn_id", "topic_shift"])
    return p.select("conversation_id", "turn_id", "topic_shift", "prediction", r6("p1").alias("p1"))


@register("m13_classifier_report")
def m13_classifier_report(spark, sf_dir):
    """M13 predictions scored with the classification report (M7)."""
    p = m13_fit_classifier(spark, sf_dir)
    r = metrics.classification_report(p, "topic_shift", "prediction")
    return r.select("class_name", r6("precision").alias("precision"), r6("recall").alias("recall"),
                    r6("f1_score").alias("f1_score"), "support")


FOCAL_RIDGE, SPLIT = 1e-3, 0.8


def _focal(spark, sf_dir):
    """Focal-loss weights fitted on the training conversations (G5), and all rows with their split."""
    e = fx.emb_turns(spark, sf_dir).select("conversation_id", "turn_id", "embedding", "topic_shift")
    e = augment.split_conversations(e, SPLIT, 42)
    return model.fit_focal(e.where("split = 'train'"), "embedding", "topic_shift", ridge=FOCAL_RIDGE), e


@register("m13_focal_stationary", sql([], """
    SELECT i, TRUE AS zero_gradient FROM (SELECT unnest(range(0, (SELECT max(len(embedding)) FROM embeddings) + 1)) AS i)"""))
def m13_focal_stationary(spark, sf_dir):
    """Every component of the gradient at the fitted weights, recomputed by column expressions: zero within 1e-6."""
    w, e = _focal(spark, sf_dir)
    t = model.with_score(e.where("split = 'train'").withColumnRenamed("topic_shift", "label"), w)
    t = t.withColumn("slope", model.focal_slope())
    x = F.concat(F.transform("embedding", lambda v: v.cast("double")), F.array(F.lit(1.0)))
    g = t.select("slope", F.posexplode(x).alias("i", "x")).groupBy("i").agg(F.avg(F.col("slope") * F.col("x")).alias("g"))
    ridge = F.array(*[F.lit(FOCAL_RIDGE * v) for v in [*w[:-1], 0.0]])
    return g.select(F.col("i").cast("long").alias("i"), (F.abs(F.col("g") + F.get(ridge, F.col("i"))) < 1e-6).alias("zero_gradient"))


@register("m13_focal_report")
def m13_focal_report(spark, sf_dir):
    """M13 with the focal loss: fitted on the training conversations, scored on the others (M7)."""
    w, e = _focal(spark, sf_dir)
    p = model.predict_focal(e.where("split = 'test'"), w, keep=["topic_shift"])
    r = metrics.classification_report(p, "topic_shift", "prediction")
    return r.select("class_name", r6("precision").alias("precision"), r6("recall").alias("recall"),
                    r6("f1_score").alias("f1_score"), "support")


@register("st_stream_thresholds", sql(["logits"], """
    SELECT conversation_id, turn_id, round(1.0 / (1.0 + exp(logit0 - logit1)), 6) AS p1,
           CASE WHEN 1.0 / (1.0 + exp(logit0 - logit1)) > 0.63 THEN 1 ELSE 0 END AS pred,
           CASE WHEN logit1 > logit0 THEN 1 ELSE 0 END AS pred_argmax
    FROM logits"""))
def st_stream_thresholds(spark, sf_dir):
    """M1/M2 on a Structured Streaming file source with a parquet sink (availableNow)."""
    from ..streaming.rowwise import stream_labels
    d = stream_labels(spark, fx.logits(spark, sf_dir), 0.63)
    return d.select("conversation_id", "turn_id", r6("p1").alias("p1"), "pred", "pred_argmax")
