"""Learned operators on tasks whose answer SQL can restate: one-feature least squares, labels that are thresholds of a feature, norms, separated clusters."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import discriminants as DA
from ..operators import logistic as LL
from ..operators import models as M
from ..operators import text as X
from ..session import cut_lineage
from ..sources import readers as R
from ..sources import store as W
from . import inputs as I
from .registry import register, table

_X = "CAST(o_custkey AS DOUBLE)"
_Y = "o_totalprice / 150.0"
_LEAST = {"regParam": 0.0}


def _priced(spark, sf):
    return cut_lineage(table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("x"), (F.col("o_totalprice") / 150.0).alias("y")))


@register("least_squares_forecast", "L8", f"""WITH m AS (SELECT regr_slope({_Y}, {_X}) AS b, regr_intercept({_Y}, {_X}) AS a FROM orders)
  SELECT o_orderkey, round(a + b * {_X}, 3) AS prediction FROM orders, m""")
def least_squares_forecast(spark, sf):
    """Fit, save, load, predict."""
    rows = _priced(spark, sf)
    path = os.path.join(W.new_folder(spark, "models"), "line")
    M.save_model(M.fit_regressor(rows, "linear", ["x"], "y", **_LEAST), path)
    return M.with_prediction(M.load_model(path), rows, "p").select("o_orderkey", F.round("p", 3).alias("prediction"))


@register("least_squares_importance", "L20", f"SELECT 'x' AS feature, round(abs(regr_slope({_Y}, {_X})), 6) AS importance FROM orders")
def least_squares_importance(spark, sf):
    model = M.fit_regressor(_priced(spark, sf), "linear", ["x"], "y", **_LEAST)
    return M.importances(model, ["x"], spark).select("feature", F.round("importance", 6).alias("importance"))


_W = "(1 + o_orderkey % 3)"


@register("weighted_least_squares", "L19", f"""WITH r AS (SELECT {_X} AS x, {_Y} AS y, CAST({_W} AS DOUBLE) AS w FROM orders),
  b AS (SELECT (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)) AS b FROM r),
  m AS (SELECT b, (sum(w * y) - b * sum(w * x)) / sum(w) AS a FROM r, b GROUP BY b)
  SELECT CAST(w AS BIGINT) AS provenance, count(*) AS n, round(sqrt(avg((y - a - b * x) * (y - a - b * x))), 4) AS rmse FROM r, m GROUP BY w""")
def weighted_least_squares(spark, sf):
    """A fit with provenance weights, and its error in each class of rows."""
    rows = cut_lineage(table(spark, sf, "orders").select(F.col("o_custkey").cast("double").alias("x"), (F.col("o_totalprice") / 150.0).alias("y"), (1 + F.col("o_orderkey") % 3).alias("provenance")))
    rows = rows.withColumn("w", F.col("provenance").cast("double"))
    out = M.with_prediction(M.fit_regressor(rows, "linear", ["x"], "y", weight="w", **_LEAST), rows, "p")
    return out.groupBy("provenance").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg((F.col("y") - F.col("p")) ** 2)), 4).alias("rmse"))


_FOLD = "CAST('0x' || substr(md5('42:' || CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 5"


@register("least_squares_stack", "L10", f"""WITH r AS (SELECT o_orderkey, {_X} AS x, {_Y} AS y, {_FOLD} AS fold FROM orders),
  f AS (SELECT k, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM r, range(5) t(k) WHERE fold <> k GROUP BY k),
  o AS (SELECT y, a + b * x AS p FROM r JOIN f ON k = fold), m AS (SELECT regr_slope(y, p) AS mb, regr_intercept(y, p) AS ma FROM o),
  w AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM r) SELECT o_orderkey, round(ma + mb * (a + b * x), 2) AS prediction FROM r, m, w""")
def least_squares_stack(spark, sf):
    """Out-of-fold predictions of one base feed the meta learner; the base fitted on all rows feeds the forecast."""
    rows = _priced(spark, sf)
    stack = M.build_stack(rows, "o_orderkey", "y", ["x"], bases=("linear",), meta="linear", use_features=False, linear=_LEAST)
    return stack.predict(rows).select("o_orderkey", F.round("prediction", 2).alias("prediction"))


@register("searched_stack", "L12 L13", f"SELECT o_orderkey, round(3.0 * {_X} + 7, 1) AS prediction FROM orders")
def searched_stack(spark, sf):
    """A stack whose meta learner comes from a search: on a straight line the unpenalised pick has the smallest error and gives the line back."""
    rows = _priced(spark, sf).withColumn("y", F.col("x") * 3 + 7)
    stack = M.build_stack(rows, "o_orderkey", "y", ["x"], bases=("linear",), meta="linear", use_features=False, search={"regParam": [500.0, 0.0, 50.0], "elasticNetParam": [0.0, 0.5]},
                          linear=_LEAST)
    return stack.predict(rows).select("o_orderkey", F.round("prediction", 1).alias("prediction"))


@register("range_meta_forecast", "L11", f"SELECT o_orderkey, round({_X} * 2.5 + 400, 1) AS prediction FROM orders")
def range_meta_forecast(spark, sf):
    """Range models on a straight line agree on it, and so does their meta learner, trained on rows that its stand-ins did not see."""
    rows = _priced(spark, sf).withColumn("y", F.col("x") * 2.5 + 400)
    model = M.RangeModels("linear", ["x"], meta="linear", **_LEAST).fit(rows, "y")
    return model.predict(rows).select("o_orderkey", F.round("prediction", 1).alias("prediction"))


_RANGES = "(VALUES (0, 1000), (1000, 1500), (1500, 2000), (2000, 2500), (2500, 3000), (3000, 3500)) t(lo, hi)"


@register("range_line_forecast", "L11", f"""WITH r AS (SELECT o_orderkey, {_X} AS x, {_Y} AS y FROM orders),
  m AS (SELECT lo, hi, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM r, {_RANGES} WHERE y BETWEEN lo - 100 AND hi + 100 GROUP BY 1, 2 HAVING count(*) >= 100),
  p AS (SELECT o_orderkey, a + b * x AS p, greatest(lo - (a + b * x), (a + b * x) - hi, 0) AS away FROM r, m),
  w AS (SELECT o_orderkey, p, CASE WHEN away <= 100 THEN 1 - away / 100 ELSE 0 END AS w FROM p)
  SELECT o_orderkey, round(CASE WHEN sum(w) > 0 THEN sum(w * p) / sum(w) ELSE avg(p) END, 3) AS prediction FROM w GROUP BY 1""")
def range_line_forecast(spark, sf):
    """A line for each rating range and its overlaps, all from one pass, weighted by how well each fits its own range."""
    rows = _priced(spark, sf)
    return M.RangeModels("linear", ["x"], **_LEAST).fit(rows, "y").predict(rows).select("o_orderkey", F.round("prediction", 3).alias("prediction"))


# ---------------------------------------------------------------- labels that are thresholds

def _lines(spark, sf, written=True):
    """A row per line item; its number within the order decides every label below. What reads few of the columns reads them from the table."""
    key = F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("double").alias("x"), key.alias("key"))
    return cut_lineage(rows) if written else rows


_KEY = "concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


@register("recovered_families", "L1 L16", f"SELECT {_KEY} AS key, CASE WHEN l_linenumber <= 3 THEN 'near' ELSE 'far' END AS label FROM lineitem WHERE l_orderkey % 3 = 0")
def recovered_families(spark, sf):
    rows = _lines(spark, sf, False).withColumn("family", F.when(F.col("x") <= 3, "near").otherwise("far"))
    shared = cut_lineage(M.shared_rows(rows.filter("l_orderkey % 3 != 0"), ["family", "x"]))
    known = M.balanced_weights(shared, "family", count="_n")
    return M.classify(M.fit_classifier(known, "family", ["x"], weight="_w"), rows.filter("l_orderkey % 3 = 0"), "key").select("key", "label")


@register("recovered_variations", "L2", f"""SELECT {_KEY} AS key, CASE WHEN l_linenumber <= 2 + l_orderkey % 2 THEN 'a' ELSE 'b' END AS variation FROM lineitem WHERE l_orderkey % 3 = 0""")
def recovered_variations(spark, sf):
    rows = _lines(spark, sf).withColumn("family", F.concat(F.lit("f"), (F.col("l_orderkey") % 2).cast("string"))).withColumn(
        "variation", F.when(F.col("x") <= 2 + F.col("l_orderkey") % 2, "a").otherwise("b"))
    models = M.variation_models(rows.filter("l_orderkey % 3 != 0"), "family", "variation", ["x"])
    return M.classify_variations(models, rows.filter("l_orderkey % 3 = 0"), "key", "family").select("key", "variation")


@register("variations_of_many_families", "L2", f"""SELECT {_KEY} AS key, CASE WHEN l_linenumber <= 3 THEN 'a' || l_suppkey ELSE 'b' || l_suppkey END AS variation FROM lineitem
  WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) >= 10 AND count(DISTINCT l_linenumber <= 3) = 2)""")
def variations_of_many_families(spark, sf):
    """A classifier for each supplier, all fitted together: the classes of a family are its own, and lie far apart on one feature."""
    rows = cut_lineage(table(spark, sf, "lineitem").select(F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"), F.col("l_suppkey").cast("string").alias("family"),
                                                           (F.when(F.col("l_linenumber") <= 3, 0.0).otherwise(10.0) + F.col("l_quantity") / 100).alias("x"), F.col("l_tax").alias("z"), "l_linenumber"))
    known = rows.withColumn("variation", F.concat(F.when(F.col("l_linenumber") <= 3, "a").otherwise("b"), "family"))
    return DA.classify_families(DA.fit_families(known, "family", "variation", ["x", "z"]), rows, "key", "family", ["x", "z"]).select("key", "variation")


_HELD = "CAST('0x' || substr(md5('42:' || " + _KEY + "), 1, 8) AS BIGINT) < 858993459"


@register("separable_label_scores", "L6", f"""WITH h AS (SELECT l_linenumber AS x, l_orderkey % 2 AS odd FROM lineitem WHERE {_HELD}),
  a AS (SELECT sum(CASE WHEN p.odd = 1 AND q.odd = 0 THEN p.n * q.n * CASE WHEN p.x > q.x THEN 1.0 WHEN p.x = q.x THEN 0.5 ELSE 0 END END) / sum(CASE WHEN p.odd = 1 AND q.odd = 0 THEN p.n * q.n END) AS auc
    FROM (SELECT x, odd, count(*) AS n FROM h GROUP BY 1, 2) p, (SELECT x, odd, count(*) AS n FROM h GROUP BY 1, 2) q),
  d AS (SELECT corr(l_linenumber, l_orderkey % 2) >= 0 AS up FROM lineitem WHERE NOT {_HELD})
  SELECT 'late' AS label, CAST(1.0 AS DOUBLE) AS auc, 'kept' AS verdict UNION ALL SELECT 'never', NULL, 'skipped'
  UNION ALL SELECT 'odd', round(CAST(CASE WHEN up THEN auc ELSE 1 - auc END AS DOUBLE), 6), 'dropped' FROM a, d""")
def separable_label_scores(spark, sf):
    """A label that a threshold decides has an area of 1; one that has nothing to do with the feature keeps the area of its order, and goes; one without positives is skipped."""
    rows = _lines(spark, sf).withColumns({"late": (F.col("x") > 3).cast("int"), "never": F.lit(0), "odd": (F.col("l_orderkey") % 2).cast("int")})
    _, scores = LL.fit_label_lines(rows, "key", ["late", "never", "odd"], ["x"])
    return spark.createDataFrame(scores, "label string, auc double, verdict string").withColumn("auc", F.round("auc", 6))


@register("separable_labels", "L7", f"SELECT {_KEY} AS key, CASE WHEN l_linenumber > 6 THEN 'late' WHEN l_linenumber < 2 THEN 'first' ELSE '' END AS labels FROM lineitem")
def separable_labels(spark, sf):
    """Two labels of a line, each on one side of all others; every line is labelled."""
    rows = _lines(spark, sf).withColumn("late", (F.col("x") > 6).cast("int")).withColumn("first", (F.col("x") < 2).cast("int"))
    models, _ = LL.fit_label_lines(rows, "key", ["first", "late"], ["x"], ridge=1e-5)
    return LL.label_texts(models, rows, "key").select("key", "labels")


_WEIGHT = f"CASE WHEN {_Y} < 0 THEN 0 WHEN {_Y} < 1200 THEN 1.0 WHEN {_Y} < 1800 THEN 1.5 WHEN {_Y} < 2400 THEN 1.2 WHEN {_Y} < 3500 THEN 1.0 ELSE 0 END"


@register("bucket_weighted_line", "A20 L8", f"""WITH r AS (SELECT o_orderkey, {_X} AS x, {_Y} AS y, CAST({_WEIGHT} AS DOUBLE) AS w FROM orders), s AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM r),
  b AS (SELECT mx, my, sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS b FROM r, s GROUP BY 1, 2) SELECT o_orderkey, round(my + b * (x - mx), 3) AS prediction FROM r, b""")
def bucket_weighted_line(spark, sf):
    """A fit in which an error counts by the bucket of its target: the weights of the loss as weights of the rows."""
    rows = _priced(spark, sf)
    model = M.fit_bucket_weighted(rows, "linear", ["x"], "y", **_LEAST)
    return M.with_prediction(model, rows, "p").select("o_orderkey", F.round("p", 3).alias("prediction"))


# ---------------------------------------------------------------- vectors and clusters

@register("full_embedding_norms", "L14", """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding[1:11], lambda e: CAST(e AS DOUBLE) * e))), 5) AS norm FROM embeddings""")
def full_embedding_norms(spark, sf):
    """With as many components as levels a curve only turns: its length stays."""
    c = I.curve(spark, sf)
    rapid = [n for n in c.columns if "rapid" in n]
    out = M.curve_embeddings(c, "vec_id", {"rapid": rapid}, len(rapid))
    return out.select("vec_id", F.round(F.sqrt(sum((F.col(f"rapid_emb_{i}") ** 2 for i in range(len(rapid))), F.lit(0.0))), 5).alias("norm"))


@register("separated_clusters", "L15", "SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_orderkey % 3) AS head FROM orders")
def separated_clusters(spark, sf):
    """Three far groups of points: each cluster is one of them, named by its smallest key."""
    k = F.col("o_orderkey") % 3
    rows = cut_lineage(table(spark, sf, "orders").select("o_orderkey", (k * 1000.0).alias("a"), (k * k * 1000.0 + F.col("o_custkey") % 7).alias("b")))
    got = cut_lineage(M.clusters(rows, "o_orderkey", ["a", "b"], k=3))
    return got.join(got.groupBy("position_cluster").agg(F.min("o_orderkey").alias("head")), "position_cluster").select("o_orderkey", "head")


@register("topic_shares", "T19", "SELECT doc_id, CAST(1.0 AS DOUBLE) AS total, 1 AS fits FROM documents")
def topic_shares(spark, sf):
    """Topic shares of a text sum to 1 and the dominant topic holds the largest."""
    t = X.topic_features(table(spark, sf, "documents"), "doc_id", F.col("text"))
    shares = F.array(*[F.col(f"topic_{i}") for i in range(8)])
    total = F.round(sum((F.col(f"topic_{i}") for i in range(8)), F.lit(0.0)), 6)
    empty = F.round(total, 6) == 0  # a text without a listed word has no shares
    return t.select("doc_id", F.when(empty, 1.0).otherwise(total).alias("total"), (F.element_at(shares, F.col("dominant_topic") + 1) == F.array_max(shares)).cast("int").alias("fits"))


@register("text_vector_norms", "T17", """WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_type), ' ')) AS t FROM part) SELECT p_partkey, CAST(1.0 AS DOUBLE) AS norm FROM w WHERE t <> '' GROUP BY 1""")
def text_vector_norms(spark, sf):
    """With as many directions as terms a text vector keeps its length of 1."""
    part = table(spark, sf, "part")
    terms = part.select(F.explode(F.split(F.lower("p_type"), " ")).alias("t")).where("t != ''").distinct().count()
    out = X.svd_features(part, "p_partkey", F.col("p_type"), k=terms, least=1, most=terms)
    return out.select("p_partkey", F.round(F.sqrt(sum((F.col(f"svd_{i}") ** 2 for i in range(terms)), F.lit(0.0))), 6).alias("norm"))


# ---------------------------------------------------------------- book files

@register("book_from_csv", "S9", "SELECT DISTINCT 'name ' || CAST(o_custkey AS VARCHAR) AS name, 'place' || CAST(o_custkey AS VARCHAR) AS placement, 'A' || CAST(o_custkey % 7 AS VARCHAR) AS eco FROM orders")
def book_from_csv(spark, sf):
    """A book of every customer of an order, written as CSV and read back with positions cut to their first field."""
    n, path = F.col("o_custkey"), os.path.join(W.new_folder(spark, "book"), "csv")
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("place"), n.cast("string"), F.lit(" w - - 0 1")).alias("fen"), F.concat(F.lit("name "), n.cast("string")).alias("name"),
        F.concat(F.lit("A"), (n % 7).cast("string")).alias("eco")).distinct()
    rows.write.option("header", True).csv(path)
    return R.read_book(spark, path)
