"""Registered label-inference and learning queries."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import evaluate as V
from ..operators import labels as L
from ..operators import logistic as LL
from ..operators import models as M
from ..operators import splits as P
from ..operators import tables as D
from ..operators.evaluate import rounded
from ..session import cut_lineage
from ..sources import store as W
from . import inputs as I
from . import oracle_text as O
from .registry import register, table

# ---------------------------------------------------------------- confidence rules on partial labels

_PRED = O.LABELS + """, pr AS (SELECT doc_id, CASE WHEN quality IS NULL THEN '' ELSE lang END AS tag, source AS family, doc_id * 7 % 100 / 100.0 AS conf,
  doc_id * 3 % 100 / 100.0 AS conf2, CAST(quality IS NOT NULL AS INT) AS has_tag FROM pl)"""


def _pred(spark, sf):
    k = F.col("doc_id")
    return I.partial_labels(spark, sf).select(
        "doc_id", F.when(F.col("quality").isNull(), "").otherwise(F.col("lang")).alias("tag"), F.col("source").alias("family"),
        (k * 7 % 100 / 100.0).alias("conf"), (k * 3 % 100 / 100.0).alias("conf2"), F.col("quality").isNotNull().cast("int").alias("has_tag"))


@register("high_confidence", "P13", O.with_(_PRED) + "SELECT doc_id, family, CAST(conf AS DOUBLE) AS conf FROM pr WHERE conf >= 0.7")
def high_confidence(spark, sf):
    return _pred(spark, sf).filter(F.col("conf") >= 0.7).select("doc_id", "family", "conf")


@register("enhanced_tags", "P17", O.with_(_PRED) + "SELECT doc_id, CASE WHEN tag = '' AND conf >= 0.7 THEN family || ' (predicted)' ELSE tag END AS tag FROM pr")
def enhanced_tags(spark, sf):
    return _pred(spark, sf).select("doc_id", D.enhance_tags(F.col("tag"), F.col("family"), F.col("conf")).alias("tag"))


@register("enhanced_tags_by_method", "P18", O.with_(_PRED) + "SELECT doc_id, CASE WHEN tag = '' AND conf >= 0.7 THEN family || ' (predicted-' || CASE WHEN conf2 > conf THEN 'book' ELSE 'ml' END || ')' ELSE tag END AS tag FROM pr")
def enhanced_tags_by_method(spark, sf):
    method = F.when(F.col("conf2") > F.col("conf"), "book").otherwise("ml")
    return _pred(spark, sf).select("doc_id", D.enhance_tags(F.col("tag"), F.col("family"), F.col("conf"), method).alias("tag"))


@register("tag_provenance", "P19", O.with_(_PRED) + "SELECT doc_id, has_tag AS has_original_tag, CAST(has_tag = 1 OR conf >= 0.7 AS INT) AS has_predicted_tag, CAST(CASE WHEN has_tag = 1 THEN 1 ELSE conf END AS DOUBLE) AS tag_prediction_confidence FROM pr")
def tag_provenance(spark, sf):
    cols = D.provenance_columns(F.col("tag"), F.col("conf"))
    return _pred(spark, sf).select("doc_id", *[c.alias(n) for n, c in cols.items()])


@register("effective_tags", "P20", O.with_(_PRED) + "SELECT doc_id, CAST(has_tag = 0 AND greatest(conf, conf2) >= 0.8 AS INT) AS high_confidence_inference, CAST(has_tag = 1 OR greatest(conf, conf2) >= 0.8 AS INT) AS effective_has_tags FROM pr")
def effective_tags(spark, sf):
    cols = D.effective_tag(F.col("has_tag"), [F.col("conf"), F.col("conf2")])
    return _pred(spark, sf).select("doc_id", *[c.alias(n) for n, c in cols.items()])


@register("sample_weights", "P21", O.with_(_PRED) + "SELECT doc_id, CAST(CASE WHEN has_tag = 1 THEN 1.0 WHEN greatest(conf, conf2) >= 0.8 THEN 0.8 WHEN conf2 >= 0.6 OR conf >= 0.7 THEN 0.5 ELSE 0.3 END AS DOUBLE) AS weight FROM pr")
def sample_weights(spark, sf):
    return _weighted(spark, sf).select("doc_id", "weight")


def _weighted(spark, sf):
    rows = _pred(spark, sf)
    rows = rows.withColumns(D.effective_tag(F.col("has_tag"), [F.col("conf"), F.col("conf2")]))
    return rows.withColumn("weight", D.sample_weight(F.col("has_tag"), F.col("high_confidence_inference"), F.col("conf2"), F.col("conf")))


@register("supported_labels", "A3", O.with_(O.LABELS) + "SELECT doc_id, source FROM pl WHERE source IN (SELECT source FROM pl WHERE quality IS NOT NULL GROUP BY 1 HAVING count(*) >= 5)")
def supported_labels(spark, sf):
    pl = I.partial_labels(spark, sf)
    good = D.label_support(pl.filter("quality is not null"), "source", 5)
    return D.keep_members(pl.select("doc_id", "source"), good, "source").select("doc_id", "source")


@register("confidence_summary", "A14", O.with_(_PRED) + "SELECT CAST(count(*) FILTER (conf >= 0.7) AS BIGINT) AS high_confidence, round(100.0 * count(*) FILTER (conf >= 0.7) / count(*), 6) AS high_confidence_pct, round(avg(conf), 6) AS avg_confidence FROM pr")
def confidence_summary(spark, sf):
    return L.confidence_summary(_pred(spark, sf), "conf")


_VOTES = """mt AS (SELECT doc_id, source AS l1, doc_id * 7 % 100 / 100.0 AS c1, lang AS l2, doc_id * 3 % 100 / 100.0 AS c2, CASE WHEN doc_id % 4 = 0 THEN lang ELSE source END AS l3, doc_id * 11 % 100 / 100.0 AS c3 FROM pl),
v AS (SELECT doc_id, l1 AS l, c1 AS c FROM mt UNION ALL SELECT doc_id, l2, c2 FROM mt UNION ALL SELECT doc_id, l3, c3 FROM mt),
s AS (SELECT doc_id, l, sum(c) AS w FROM v WHERE c > 0 GROUP BY 1, 2),
vote AS (SELECT doc_id, l AS ensemble_family, w / t AS conf FROM (SELECT *, sum(w) OVER (PARTITION BY doc_id) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, l) AS rn FROM s) WHERE rn = 1)"""


def _votes(spark, sf):
    k = F.col("doc_id")
    rows = I.partial_labels(spark, sf).select(
        "doc_id", F.col("source").alias("l1"), (k * 7 % 100).alias("c1"), F.col("lang").alias("l2"), (k * 3 % 100).alias("c2"),
        F.when(k % 4 == 0, F.col("lang")).otherwise(F.col("source")).alias("l3"), (k * 11 % 100).alias("c3"))
    return L.weighted_vote(rows, "doc_id", [("l1", "c1"), ("l2", "c2"), ("l3", "c3")])


@register("weighted_vote", "A15", O.with_(O.LABELS, _VOTES) + "SELECT doc_id, ensemble_family, round(conf, 6) AS ensemble_confidence FROM vote")
def weighted_vote(spark, sf):
    return _votes(spark, sf).withColumn("ensemble_confidence", rounded(F.col("ensemble_confidence")))


@register("vote_write_back", "L17", O.with_(_PRED, _VOTES) + "SELECT doc_id, CASE WHEN tag = '' AND coalesce(vote.conf, 0) >= 0.6 THEN ensemble_family ELSE tag END AS tag, CAST(tag = '' AND coalesce(vote.conf, 0) >= 0.6 AS INT) AS has_inferred_tags FROM pr LEFT JOIN vote USING (doc_id)")
def vote_write_back(spark, sf):
    return L.write_back(_pred(spark, sf).select("doc_id", "tag"), _votes(spark, sf), "doc_id", "tag").select("doc_id", "tag", "has_inferred_tags")


@register("book_or_model", "L18", O.with_(_PRED) + """, c AS (SELECT *, CASE WHEN has_tag = 1 THEN '' WHEN conf2 > 0 AND (conf2 > conf OR conf = 0) THEN 'book' WHEN conf > 0 THEN 'ml' ELSE '' END AS m FROM pr),
  d AS (SELECT *, CASE m WHEN 'book' THEN 'B' || family WHEN 'ml' THEN family ELSE '' END AS o, CASE m WHEN 'book' THEN conf2 WHEN 'ml' THEN conf ELSE 0 END AS cf FROM c)
  SELECT doc_id, m AS prediction_method, o AS predicted_opening, CAST(cf AS DOUBLE) AS prediction_confidence, CASE WHEN has_tag = 0 AND cf >= 0.7 THEN o || ' (predicted-' || m || ')' ELSE tag END AS tag FROM d""")
def book_or_model(spark, sf):
    p = _pred(spark, sf)
    model = p.select("doc_id", F.col("family").alias("label"), "conf")
    book = p.select("doc_id", F.concat(F.lit("B"), "family").alias("label"), F.col("conf2").alias("conf"))
    return L.book_or_model(p.select("doc_id", "tag"), model, book, "doc_id", "tag")


@register("cluster_label_transfer", "J13", """WITH e AS (SELECT v.vec_id, v.label AS cluster, d.lang, l.quality FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id LEFT JOIN labels l ON l.doc_id = v.vec_id),
  c AS (SELECT cluster, lang, count(*) AS n FROM e WHERE quality IS NOT NULL GROUP BY 1, 2),
  p AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY cluster) AS t, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, lang) AS rn FROM c) WHERE rn = 1)
  SELECT vec_id, p.lang AS cluster_inferred_family, round(n * 1.0 / t, 6) AS cluster_inference_confidence FROM e JOIN p USING (cluster) WHERE quality IS NULL AND t >= 5 AND n * 1.0 / t >= 0.3""")
def cluster_label_transfer(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"), "quality")
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cluster")).join(d, "vec_id").join(lab, "vec_id", "left")
    profile = D.dominant_label(e.filter("quality is not null"), "cluster", "lang")
    out = L.cluster_transfer(e.filter("quality is null"), profile, "vec_id", "cluster", share=0.3)
    return out.withColumn("cluster_inference_confidence", rounded(F.col("cluster_inference_confidence")))


@register("fold_mean_forecast", "L9 W4", O.with_(O.RATED) + """, f AS (SELECT o_orderkey, rating, CAST(CAST('0x' || substr(md5('42:' || o_orderkey), 1, 8) AS BIGINT) % 5 AS INT) AS fold FROM rated),
  s AS (SELECT fold, sum(rating) AS s, count(*) AS n FROM f GROUP BY 1)
  SELECT o_orderkey, f.fold, round(((SELECT sum(s) FROM s) - s.s) / ((SELECT sum(n) FROM s) - s.n), 6) AS prediction FROM f JOIN s USING (fold)""")
def fold_mean_forecast(spark, sf):
    """Mean of the other folds: the baseline every regressor has to beat."""
    rows = I.rated(spark, sf).select("o_orderkey", "rating", P.fold_of(F.col("o_orderkey")).alias("fold"))
    sums = rows.groupBy("fold").agg(F.sum("rating").alias("s"), F.count("*").alias("n"))  # one row per fold
    total = D.one_row(sums.agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
    means = sums.withColumn("t", total).select("fold", ((F.col("t.s") - F.col("s")) / (F.col("t.n") - F.col("n"))).alias("prediction"))
    return rows.join(F.broadcast(means), "fold").select("o_orderkey", "fold", rounded(F.col("prediction")).alias("prediction"))


# ---------------------------------------------------------------- learned labels

def _documents(spark, sf):
    """Materialised once: every fit and every prediction below reads the same rows."""
    return cut_lineage(I.document_features(spark, sf))


def _training(spark, sf):
    return cut_lineage(I.training_rows(spark, sf))


@register("family_classifier", "L1")
def family_classifier(spark, sf):
    rows = _documents(spark, sf)
    known = rows.filter(D.has_text(F.col("tag"))).withColumn("family", L.primary_family(F.col("tag")))
    model = M.fit_classifier(known, "family", I.DOCUMENT_FEATURES)
    return M.classify(model, rows.filter(~D.has_text(F.col("tag"))), "doc_id")


@register("variation_classifiers", "L2")
def variation_classifiers(spark, sf):
    rows = _documents(spark, sf).withColumns({"family": F.col("lang"), "variation": F.col("source")})
    models = M.variation_models(rows.filter(D.has_text(F.col("tag"))), "family", "variation", I.DOCUMENT_FEATURES)
    return M.classify_variations(models, rows.filter(~D.has_text(F.col("tag"))), "doc_id", "family")


@register("missing_tag_predictions", "L1 L2 L3 L4 L5")
def missing_tag_predictions(spark, sf):
    rows = _documents(spark, sf)
    return M.predict_missing(rows, "doc_id", "tag", L.primary_family(F.col("tag")), L.variation(F.col("tag")), I.DOCUMENT_FEATURES)


@register("balanced_label_forest", "L16")
def balanced_label_forest(spark, sf):
    rows = _documents(spark, sf)
    known = M.balanced_weights(rows.filter(D.has_text(F.col("tag"))).withColumn("family", L.primary_family(F.col("tag"))), "family")
    model = M.fit_classifier(known, "family", I.DOCUMENT_FEATURES, weight="_w")
    pred = M.classify(model, rows.filter(~D.has_text(F.col("tag"))), "doc_id")
    hits = F.when(F.col("conf") >= 0.7, F.col("conf")).otherwise(0.0)
    return pred.select("doc_id", "label", "conf", *[F.when(F.col("label") == n, hits).otherwise(0.0).alias(f"open_fam_{n}") for n in M.class_names(model)])


@register("label_model_scores", "L6 A13")
def label_model_scores(spark, sf):
    _, scores = LL.fit_label_lines(_documents(spark, sf), "doc_id", ["quality", "toxic"], I.DOCUMENT_FEATURES)
    return spark.createDataFrame(scores, "label string, auc double, verdict string")


@register("multi_label_predictions", "L7")
def multi_label_predictions(spark, sf):
    rows = _documents(spark, sf)
    models, _ = LL.fit_label_lines(rows, "doc_id", ["quality", "toxic"], I.DOCUMENT_FEATURES, least_auc=0.0)
    return LL.label_texts(models, rows.filter("quality is null"), "doc_id", 0.3).select("doc_id", "labels")


@register("weighted_training_errors", "L19")
def weighted_training_errors(spark, sf):
    """Forest trained with provenance weights; accuracy per provenance class on held-out rows."""
    rows = _documents(spark, sf).join(_weighted(spark, sf).select("doc_id", "weight", "high_confidence_inference", "has_tag"), "doc_id")
    test = P.in_test(F.col("doc_id"), 0.2)
    model = M.fit_classifier(rows.filter(~test), "lang", I.DOCUMENT_FEATURES, weight="weight")
    pred = M.classify(model, rows.filter(test), "doc_id").join(rows.select("doc_id", "lang", "has_tag", "high_confidence_inference"), "doc_id")
    cls = F.when(F.col("has_tag") == 1, "original").when(F.col("high_confidence_inference") == 1, "inferred").otherwise("none")
    return pred.groupBy(cls.alias("provenance")).agg(F.count("*").alias("n"), rounded(F.avg((F.col("label") == F.col("lang")).cast("int"))).alias("accuracy"))


@register("embedding_clusters", "L15")
def embedding_clusters(spark, sf):
    c = I.curve(spark, sf)
    return M.clusters(c, "vec_id", [n for n in c.columns if n.startswith("success_prob_")])


@register("curve_embeddings", "L14")
def curve_embeddings(spark, sf):
    c = I.curve(spark, sf)
    modes = {m: [n for n in c.columns if m in n] for m in ("rapid", "blitz")}
    return M.kernel_embeddings(c, "vec_id", modes)


# ---------------------------------------------------------------- regressors

_FX = I.TRAINING_FEATURES


@register("regressor_errors", "L8 A10")
def regressor_errors(spark, sf):
    """Three regressors, saved and loaded again, on a held-out split; and the mean as the baseline."""
    rows = _training(spark, sf)
    test = P.in_test(F.col("l_orderkey"), 0.2)
    train, held = rows.filter(~test), rows.filter(test)
    root, out = W.new_folder(spark, "models"), None
    for kind in ("linear", "forest", "gbt"):
        path = os.path.join(root, kind)
        M.save_model(M.fit_regressor(train, kind, _FX, "rating"), path)
        e = V.regression_errors(M.with_prediction(M.load_model(path), held, "p"), "rating", "p").withColumn("model", F.lit(kind))
        out = e if out is None else out.unionByName(e)
    base = V.regression_errors(held.withColumn("p", train.agg(F.avg("rating")).scalar()), "rating", "p").withColumn("model", F.lit("mean"))
    return out.unionByName(base).select("model", "rmse", "mae", "r2")


@register("feature_importances", "L20")
def feature_importances(spark, sf):
    model = M.fit_regressor(_training(spark, sf), "forest", _FX, "rating")
    return M.importances(model, _FX, spark)


@register("fold_training", "L9 A12")
def fold_training(spark, sf):
    oof, _ = M.out_of_fold(_training(spark, sf), "l_orderkey", "linear", _FX, "rating", 5)
    return V.fold_errors(oof, "fold", "rating", "prediction")


@register("fold_averaged_forecast", "L9")
def fold_averaged_forecast(spark, sf):
    rows = _training(spark, sf)
    test = P.in_test(F.col("l_orderkey"), 0.2, 7)
    _, models = M.out_of_fold(rows.filter(~test), "l_orderkey", "linear", _FX, "rating")
    return M.averaged(models, rows.filter(test)).select("l_orderkey", "prediction")


@register("stacked_forecast", "L10 L12")
def stacked_forecast(spark, sf):
    rows = _training(spark, sf)
    test = P.in_test(F.col("l_orderkey"), 0.2)
    stack = M.build_stack(rows.filter(~test), "l_orderkey", "rating", _FX, bases=("forest", "linear"), meta="linear")
    return stack.predict(rows.filter(test)).select("l_orderkey", "rating", "prediction")


@register("meta_search", "L13 L12")
def meta_search(spark, sf):
    """A hundred random picks of a penalised linear meta learner's parameters, each judged on the same hash split."""
    picks = M.random_grid({"regParam": [round(0.001 * 1.6 ** i, 6) for i in range(25)], "elasticNetParam": [i / 9 for i in range(10)]}, 100)
    _, scores = M.search_regressor(_training(spark, sf), "linear", _FX, "rating", picks, "l_orderkey")
    return spark.createDataFrame([(float(p["regParam"]), float(p["elasticNetParam"]), float(s)) for p, s in scores], "reg_param double, elastic_net double, rmse double")


@register("boosted_meta_search", "L13 L12")
def boosted_meta_search(spark, sf):
    """A stack whose boosted meta learner comes from an adaptive search of a hundred trials over depth, rounds and step: all trials with their errors."""
    stack = M.build_stack(_training(spark, sf), "l_orderkey", "rating", _FX, bases=("linear",), meta="gbt", search={"trials": 100})
    rows = [(n, p["maxDepth"], p["maxIter"], p["stepSize"], e) for n, (p, e) in enumerate(stack.trials)]
    return spark.createDataFrame(rows, "trial int, depth int, rounds int, step double, rmse double")


@register("range_model_forecast", "L11")
def range_model_forecast(spark, sf):
    rows = _training(spark, sf)
    test = P.in_test(F.col("l_orderkey"), 0.2)
    model = M.RangeModels("linear", _FX).fit(rows.filter(~test), "rating")
    return model.predict(rows.filter(test)).select("l_orderkey", "rating", "prediction")
