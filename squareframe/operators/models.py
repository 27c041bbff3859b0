"""Learning jobs on ``pyspark.ml``: classifiers for missing labels, multi-label models, regressors, folds, stacks, ranges.

Loops run over models (families, labels, folds, ranges), never over rows; each fit is a distributed job. Predictions of
several models are added as columns of one row, so combining them needs no shuffle.
"""

from __future__ import annotations

import itertools
import random
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, Bucketizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..fixed_values import MODEL_RANGES, RANGE_OVERLAP
from ..session import cut_lineage, shared_folder
from . import least_squares as LS
from .evaluate import bucket_weight, label_scores, range_weight
from .labels import assemble_predictions, blend, joined_tag, overall_confidence
from .search import adaptive_search
from .splits import fold_of, in_test, key_hash
from .tables import has_text


def rows_per_range(df: DataFrame, target: str, ranges=None, overlap: float = RANGE_OVERLAP) -> DataFrame:
    """One copy of a row per rating range (widened by the overlap) that holds its target. The few ranges are literals."""
    listed = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in ranges or MODEL_RANGES])
    mine = F.filter(listed, lambda r: F.col(target).between(r["lo"] - overlap, r["hi"] + overlap))
    return df.select("*", F.explode(mine).alias("_r")).select(*df.columns, F.col("_r.lo").alias("lo"), F.col("_r.hi").alias("hi"))


def fit_side_by_side(session, fits: list[Callable], parallelism: int = 1) -> list:
    """Run independent fits, ``parallelism`` at a time. On one machine side-by-side fits were slower, so 1 is the default."""
    from multiprocessing.pool import ThreadPool

    from pyspark.util import inheritable_thread_target

    if not fits:
        return []
    with ThreadPool(min(parallelism, len(fits))) as pool:
        return pool.map(lambda f: f(), [inheritable_thread_target(session)(f) for f in fits])


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")


# ---------------------------------------------------------------- label classifiers

def fit_classifier(train: DataFrame, label: str, features: list[str], trees: int = 50, depth: int = 6, seed: int = 42,
                   weight: str | None = None) -> PipelineModel:
    """Forest over any number of classes. Rows that have the vector of ``features`` as ``_x`` already aren't assembled again."""
    forest = RandomForestClassifier(labelCol="_y", featuresCol="_x", numTrees=trees, maxDepth=depth, seed=seed)
    if weight:
        forest = forest.setWeightCol(weight)
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip")
    ready = "_x" in train.columns
    model = Pipeline(stages=[index, forest] if ready else [index, assembler(features), forest]).fit(train)
    # a copy leaves the training summary behind, which holds the session and cannot be sent to executors
    return PipelineModel([model.stages[0], assembler(features), model.stages[-1].copy()])


def class_names(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def classify(model: PipelineModel, rows: DataFrame, key: str, label: str = "label", conf: str = "conf", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns to keep, label, confidence): most probable class and its probability. Rows that have their vector ``_x`` already aren't assembled again."""
    scored = PipelineModel(model.stages[-1:] if "_x" in rows.columns else model.stages[1:]).transform(rows)
    names = F.array(*[F.lit(n) for n in class_names(model)])
    p = vector_to_array("probability")
    return scored.select(key, *keep, F.element_at(names, F.array_position(p, F.array_max(p)).cast("int")).alias(label), F.array_max(p).alias(conf))


#: Rows that stand for equal rows of a fit at most: enough for the draws of a forest to differ from tree to tree.
SHARES = 256


def shared_rows(df: DataFrame, columns: list[str], out: str = "_n", shares: int = SHARES) -> DataFrame:
    """(columns, ``out``): equal rows as ``shares`` rows at most, which carry their number in equal parts. Every row counts; fits on few distinct values don't grow with the rows."""
    whole = df.groupBy(*columns).agg(F.count("*").alias("_all"))
    part = F.least("_all", F.lit(shares))
    return whole.select(*columns, (F.col("_all") / part).alias(out), F.explode(F.sequence(F.lit(1), part)).alias("_share")).drop("_share")


def balanced_weights(df: DataFrame, label: str, out: str = "_w", count: str | None = None) -> DataFrame:
    """Weight n / (classes * class size). One row per class is joined back; Spark chooses the join by its size. ``count`` names a column that tells how many rows a row stands for."""
    sizes = df.groupBy(label).agg((F.sum(count) if count else F.count("*")).alias("_n"))
    totals = sizes.agg(F.sum("_n").alias("n"), F.count("*").alias("k"))
    total = totals.select(F.struct("n", "k")).scalar()
    weights = sizes.withColumn("_t", total).select(label, (F.col("_t.n") / (F.col("_t.k") * F.col("_n"))).alias(out))
    return df.join(weights, label).withColumn(out, F.col(out) * F.col(count)) if count else df.join(weights, label)


def split_rows(rows: DataFrame, column: str, values: list[str]) -> list[DataFrame]:
    """The rows of each value, written once in a folder per value, so that reading one passes over no other."""
    if not values:
        return []
    parts = numbered_parts(rows, column, values)
    return [parts.filter(F.col("_part") == i).drop("_part") for i in range(1, len(values) + 1)]


def numbered_parts(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """The rows of the listed values with the place of theirs in the list, from 1, as ``_part``; written once in a folder per value."""
    spark, folder = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/split_rows/{uuid.uuid4().hex}"
    at = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))
    rows.filter(F.col(column).isin(values)).withColumn("_part", at).write.partitionBy("_part").parquet(folder)
    return spark.read.schema(rows.schema.add("_part", "long")).parquet(folder)


def variation_models(train: DataFrame, family: str, variation: str, features: list[str], least_rows: int = 10, **kw) -> dict[str, PipelineModel]:
    """One classifier per family with at least two variations and enough rows."""
    eligible = families_with_variations(train, family, variation, least_rows)
    rows = assembler(features).transform(train.filter(has_text(F.col(variation)))).select(family, variation, "_x")  # one narrow column for all fits
    return fit_variations(eligible, split_rows(rows, family, eligible), variation, features, **kw)


def families_with_variations(train: DataFrame, family: str, variation: str, least_rows: int = 10) -> list[str]:
    sizes = train.filter(has_text(F.col(variation))).groupBy(family, variation).agg(F.count("*").alias("n")).groupBy(family).agg(
        F.sum("n").alias("n"), F.count("*").alias("classes"))
    return [r[0] for r in sizes.filter((F.col("n") >= least_rows) & (F.col("classes") >= 2)).orderBy(family).collect()]


#: Fits of families that run at a time: each has many short jobs, between which tasks would wait for the driver.
FITS = 3


def fit_variations(families: list[str], own: list[DataFrame], variation: str, features: list[str], **kw) -> dict[str, PipelineModel]:
    """A classifier of variations from the rows of each family."""
    fits = [lambda rows=rows: fit_classifier(rows, variation, features, **kw) for rows in own]
    return dict(zip(families, fit_side_by_side(own[0].sparkSession, fits, FITS))) if own else {}


def classify_variations(models: dict[str, PipelineModel], rows: DataFrame, key: str, family: str) -> DataFrame:
    """(key, variation, variation_conf) for rows whose family has a model. Rows are written once and split by family, so each meets the model of its own only."""
    if not models:
        return rows.select(key, F.lit("").alias("variation"), F.lit(0.0).alias("variation_conf")).limit(0)
    p, parts = F.col("_p"), []
    ready = (rows if "_x" in rows.columns else next(iter(models.values())).stages[1].transform(rows)).select(key, family, "_x")
    for m, known in zip(models.values(), split_rows(ready, family, list(models))):
        scored = m.stages[-1].transform(known).withColumn("_p", vector_to_array("probability"))
        names = F.array(*[F.lit(n) for n in class_names(m)])
        parts.append(scored.select(key, F.element_at(names, F.array_position(p, F.array_max(p)).cast("int")).alias("variation"), F.array_max(p).alias("variation_conf")))
    return reduce(DataFrame.unionByName, parts)


def predict_missing(df: DataFrame, key: str, tag: str, family: Column, variation: Column, features: list[str],
                    evidence: DataFrame | None = None, least_support: int = 5, tags: DataFrame | None = None, **kw) -> DataFrame:
    """Two-level prediction of missing tags: family, pattern evidence, variation, overall confidence, originals kept.

    ``evidence`` holds (key, eco_family, eco_variation) where patterns matched. ``tags`` has key and tag of the same rows, where those of ``df`` are costly to read.

    Vectors are assembled and written once, in a folder for each family with enough rows and one for the rows without a tag: the fit of families reads all of the former,
    the fit of a family's variations its own, and both kinds of forecast the last.
    """
    own = has_text(F.col(tag))
    tags = df.select(key, tag) if tags is None else tags
    enough = tags.withColumn("_family", family).filter(own).groupBy("_family").agg(F.count("*").alias("_n")).filter((F.col("_n") >= least_support) & F.col("_family").isNotNull())
    families = [r[0] for r in enough.orderBy("_family").collect()]  # the classes of the forest, which the model holds as well
    rows = df.withColumns({"_family": family, "_variation": variation, "_side": F.when(own, F.concat(F.lit("="), family)).otherwise(F.lit(""))})
    rows = assembler(features).transform(rows).select(key, "_family", "_variation", "_x", "_side")
    parts = numbered_parts(rows, "_side", ["", *[f"={f}" for f in families]])
    train, bare = parts.filter("_part > 1"), parts.filter("_part = 1")
    pred = classify(fit_classifier(train, "_family", features, **kw), bare, key, "family", "family_conf", ("_x",))
    if evidence is not None:
        pred = pred.join(evidence, key, "left")
        fam, conf = blend(F.col("family"), F.col("family_conf"), F.col("eco_family"))
        pred = pred.withColumns({"family": fam, "family_conf": conf})
    pred = cut_lineage(pred)  # read by the variation step and by the join after it
    eligible = families_with_variations(train, "_family", "_variation")
    held = [parts.filter(F.col("_part") == families.index(f) + 2).filter(has_text(F.col("_variation"))) for f in eligible]
    models = fit_variations(eligible, held, "_variation", features, **kw)
    pred = pred.join(classify_variations(models, pred, key, "family"), key, "left")
    if evidence is not None:
        same = F.when((F.col("family") == F.col("eco_family")) & F.col("variation").isNotNull(), F.col("eco_variation"))
        var, conf = blend(F.col("variation"), F.col("variation_conf"), same)
        pred = pred.withColumns({"variation": var, "variation_conf": conf})
    v, vc = F.coalesce("variation", F.lit("")), F.coalesce("variation_conf", F.lit(0.0))
    pred = pred.select(key, joined_tag(F.col("family"), v).alias("tag"), overall_confidence(F.col("family_conf"), v, vc).alias("conf"),
                       "family", v.alias("variation"), "family_conf", vc.alias("variation_conf"))
    return assemble_predictions(tags, pred, key, tag)


# ---------------------------------------------------------------- one model per label

def fit_label_models(df: DataFrame, key: str, labels: list[str], features: list[str], least_positives: int = 10, least_auc: float = 0.7,
                     boosted: bool = False, seed: int = 42) -> tuple[dict[str, PipelineModel], list[tuple]]:
    """A binary model per 0/1 column. Rare labels are skipped, models under the AUC bound dropped; scores are returned."""
    positives = df.agg(*[F.sum(F.coalesce(F.col(n), F.lit(0))).alias(n) for n in labels]).first()
    models, scores = {}, []
    for name in labels:
        if (positives[name] or 0) < least_positives:
            scores.append((name, None, "skipped"))
            continue
        rows = df.filter(F.col(name).isNotNull()).withColumn("_y", F.col(name).cast("double"))
        test = in_test(F.col(key), 0.2, seed)
        learner = GBTClassifier(labelCol="_y", featuresCol="_x", maxIter=20, seed=seed) if boosted else LogisticRegression(
            labelCol="_y", featuresCol="_x", regParam=0.01)
        model = without_summary(Pipeline(stages=[assembler(features), learner]).fit(rows.filter(~test)), df.sparkSession)
        held = model.transform(rows.filter(test)).select(F.lit(name).alias("label"), "_y", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
        got = label_scores(held, "label", "_y", "score").first()  # one row per label
        auc = got.auc if got is not None and got.auc is not None else 0.5
        keep = auc >= least_auc
        scores.append((name, float(auc), "kept" if keep else "dropped"))
        if keep:
            models[name] = model
    return models, scores


def multi_label(models: dict[str, PipelineModel], rows: DataFrame, key: str, features: list[str], threshold: float = 0.5) -> DataFrame:
    """(key, labels, confidences): labels at or above the threshold, most confident first, joined to text. Row-local."""
    out = assembler(features).transform(rows)
    for name, model in models.items():
        scored = model.stages[-1].transform(out)
        out = scored.withColumn(f"_p_{name}", F.get(vector_to_array("probability"), F.lit(1))).drop("rawPrediction", "probability", "prediction")
    pairs = F.array(*[F.struct((-F.col(f"_p_{n}")).alias("m"), F.lit(n).alias("label")) for n in models]) if models else F.expr(
        "cast(array() as array<struct<m:double,label:string>>)")
    hits = F.array_sort(F.filter(pairs, lambda x: -x["m"] >= threshold))
    return out.select(key, F.array_join(F.transform(hits, lambda x: x["label"]), " ").alias("labels"),
                      F.transform(hits, lambda x: -x["m"]).alias("confidences"))


# ---------------------------------------------------------------- regressors

REGRESSORS: dict[str, Callable] = {
    "gbt": lambda **kw: GBTRegressor(featuresCol="_x", **{"maxIter": 20, "maxDepth": 5, "seed": 42, **kw}),
    "forest": lambda **kw: RandomForestRegressor(featuresCol="_x", **{"numTrees": 30, "maxDepth": 8, "seed": 42, **kw}),
    "linear": lambda **kw: LinearRegression(featuresCol="_x", **{"regParam": 0.01, **kw}),
}


#: Rows of a forest's fit, of which its trees draw: cells are dealt into shares until there are about as many, or one for each row.
DRAWN = 1 << 20


def bin_bounds(df: DataFrame, features: list[str], bins: int = 32) -> Bucketizer:
    """Bins of each feature at even shares of the rows, found in one pass; the last of ``bins`` is for missing values. Columns ``_bin_0`` and on."""
    found = df.select(*[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)]).approxQuantile(
        [f"_{i}" for i in range(len(features))], [i / (bins - 1) for i in range(1, bins - 1)], 0.001)
    cuts = [sorted({q + 0.0 for q in qs if abs(q) < float("inf")}) or [0.0] for qs in found]
    return Bucketizer(inputCols=features, outputCols=_bins(features), splitsArray=[[-float("inf"), *c, float("inf")] for c in cuts], handleInvalid="keep")


def _bins(features: list[str]) -> list[str]:
    return [f"_bin_{i}" for i in range(len(features))]


def cells(df: DataFrame, bounds: Bucketizer, target: str, weight: str | None = None, by: Column | None = None) -> DataFrame:
    """(bins, ``_by``, _n, _y, _within, _rows): rows that agree in all bins as one, with their weight, mean target and squared deviations from it. Written once.

    Trees split between bins, so they choose and forecast by these as by the rows: what rows of a cell differ by is in every node's impurity alike. A target that is
    null is not left out: its cell has none, which a fit refuses.
    """
    names = _bins(bounds.getInputCols())
    w, y = (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"), F.col(target).cast("double").alias("_t")
    rows = bounds.transform(df.select(*[F.col(f) for f in bounds.getInputCols()], w, y, (F.lit(0) if by is None else by).alias("_by")))
    whole = F.count("_t") == F.count("*")
    mean = F.when(whole, F.sum(F.col("_w") * F.col("_t")) / F.sum("_w")).alias("_y")
    last = [len(cut) - 1 for cut in bounds.getSplitsArray()]  # of missing values; null lies to the right of every split too
    got = rows.groupBy("_by", *[F.coalesce(F.col(n).cast("int"), F.lit(i)).alias(n) for n, i in zip(names, last, strict=True)]).agg(
        F.sum("_w").alias("_n"), mean, (F.var_pop("_t") * F.count("_t")).alias("_within"), F.count("*").alias("_rows"))
    return cut_lineage(got.where(~F.col("_n").eqNullSafe(F.lit(0.0))))


def merged_cells(parts: DataFrame, names: list[str]) -> DataFrame:
    """Cells of several groups as those of all their rows."""
    mean = F.when(F.count("_y") == F.count("*"), F.sum(F.col("_n") * F.col("_y")) / F.sum("_n")).alias("_y")
    return cut_lineage(parts.groupBy(*names).agg(F.sum("_n").alias("_n"), mean, F.sum("_rows").alias("_rows")))


def tree_learner(kind: str, bins: int = 32, **kw):
    return REGRESSORS[kind](labelCol="_y", weightCol="_n", maxBins=max(bins, 2), **kw)


def fit_on_cells(own: DataFrame, bounds: Bucketizer, kind: str, **kw) -> PipelineModel:
    """A forest or boosted trees from cells. All rows count in every fit. A forest draws cells, or shares of a cell where there are few, not single rows."""
    names = _bins(bounds.getInputCols())
    if kind == "forest":
        part = F.least("_rows", F.lit(max(1, min(SHARES, DRAWN // max(1, own.count())))).cast("long"))
        own = own.withColumn("_n", F.col("_n") / part).withColumn("_share", F.explode(F.sequence(F.lit(1).cast("long"), part)))
    rows = assembler(names)
    bins = kw.pop("maxBins", 32)
    model = tree_learner(kind, bins, **kw).fit(rows.transform(own).select("_x", "_y", "_n"))
    return without_summary(PipelineModel([bounds, rows, model]), own.sparkSession)


def on_cells(df: DataFrame, kind: str, features: list[str]) -> bool:
    return kind in ("forest", "gbt") and all(isinstance(df.schema[f].dataType, NumericType) for f in features)


def fit_regressor(df: DataFrame, kind: str, features: list[str], target: str, weight: str | None = None, **kw) -> PipelineModel:
    """Forests and boosted trees over numbers are fitted on the cells of ``df``: two passes over the rows, whatever the number and depth of trees."""
    if on_cells(df, kind, features):
        bounds = bin_bounds(df, features, kw.get("maxBins", 32))
        return fit_on_cells(cells(df, bounds, target, weight), bounds, kind, **kw)
    learner = REGRESSORS[kind](labelCol=target, **kw)
    if weight:
        learner = learner.setWeightCol(weight)
    return without_summary(Pipeline(stages=[assembler(features), learner]).fit(df), df.sparkSession)


def fit_bucket_weighted(df: DataFrame, kind: str, features: list[str], target: str, ranges=None, **kw) -> PipelineModel | LineModel:
    """A regressor trained with the loss that weighs an error by the bucket of its target; rows outside all buckets take no part."""
    rows = df.withColumn("_bucket_weight", bucket_weight(F.col(target), ranges)).where("_bucket_weight > 0")
    if kind == "linear" and (settings := linear_settings(kw)) is not None:
        got = LS.moments(rows, features, target, F.array(F.lit(0)), "_bucket_weight")
        return LineModel(features, got.get(0, LS.Moments.none(len(features) + 1)).fit(**settings))
    return fit_regressor(rows, kind, features, target, "_bucket_weight", **kw)


def without_summary(model: PipelineModel, spark) -> PipelineModel:
    """The model as it is read back from the shared folder: without the training summary, which holds on to the session and its plans."""
    path = f"{shared_folder(spark)}/models/{uuid.uuid4().hex}"
    save_model(model, path)
    return load_model(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


class LineModel:
    """A linear model that came from sums: its features and their line."""

    def __init__(self, features: list[str], line: LS.Line):
        self.features, self.line = features, line


def linear_settings(kw: dict) -> dict | None:
    """Penalty and its kind, where the settings of a linear model are no others and sums give its fit."""
    known = {"regParam": 0.01, "elasticNetParam": 0.0, **kw}
    return {"penalty": known["regParam"], "lasso": known["elasticNetParam"]} if set(known) == {"regParam", "elasticNetParam"} else None


def with_prediction(model: PipelineModel | LineModel, df: DataFrame, out: str) -> DataFrame:
    if isinstance(model, LineModel):
        return df.withColumn(out, model.line.column(model.features))
    scored = model.transform(df)
    return scored.withColumnRenamed("prediction", out).drop("_x", *[c for c in scored.columns if c.startswith("_bin_")])


def importances(model: PipelineModel, features: list[str], spark) -> DataFrame:
    """(feature, importance), largest first; absolute coefficients for a linear model."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    rows = [(n, float(v)) for n, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def out_of_fold(df: DataFrame, key: str, kind: str, features: list[str], target: str, k: int = 5, seed: int = 42, **kw):
    """Predictions of every row by the model that did not see it, and the k models. Linear models of all folds come from one pass, trees from one table of cells."""
    rows = df.withColumn("fold", fold_of(F.col(key), k, seed))
    models, _ = fold_models(rows, "fold", kind, features, target, k, **kw)
    return with_fold_prediction(rows, "fold", models, features, "prediction").select(key, "fold", target, "prediction"), models


def fold_models(rows: DataFrame, fold: str, kind: str, features: list[str], target: str, k: int, **kw) -> tuple[list, Callable]:
    """The k models that each leave one fold out, and what makes the model of all rows. Bins of trees come from the features of all folds, never from a target."""
    if kind == "linear" and (settings := linear_settings(kw)) is not None:
        parts = fold_moments(rows, features, target, k, fold)
        return [LineModel(features, m.fit(**settings)) for m in LS.left_out(parts)], lambda: LineModel(features, sum(parts[1:], parts[0]).fit(**settings))
    if on_cells(rows, kind, features):
        bounds = bin_bounds(rows, features, kw.get("maxBins", 32))
        own, names = cells(rows, bounds, target, by=F.col(fold)), _bins(features)
        fits = [lambda i=i: fit_on_cells(merged_cells(own.where(F.col("_by") != i), names), bounds, kind, **kw) for i in range(k)]
        return fit_side_by_side(rows.sparkSession, fits), lambda: fit_on_cells(merged_cells(own, names), bounds, kind, **kw)
    fits = [lambda i=i: fit_regressor(rows.filter(F.col(fold) != i), kind, features, target, **kw) for i in range(k)]
    return fit_side_by_side(rows.sparkSession, fits), lambda: fit_regressor(rows, kind, features, target, **kw)


def with_fold_prediction(rows: DataFrame, fold: str, models: list, features: list[str], out: str) -> DataFrame:
    """``rows`` with the prediction of the model that left their fold out, on the same row: no join."""
    if all(isinstance(m, LineModel) for m in models):
        return rows.withColumn(out, LS.by_fold([m.line for m in models], features, F.col(fold)))
    return reduce(DataFrame.unionByName, [with_prediction(m, rows.filter(F.col(fold) == i), out) for i, m in enumerate(models)])


def fold_moments(rows: DataFrame, features: list[str], target: str, k: int, fold: str = "fold") -> list[LS.Moments]:
    got = LS.moments(rows, features, target, F.array(fold))
    return [got.get(i, LS.Moments.none(len(features) + 1)) for i in range(k)]


def averaged(models: list[PipelineModel], df: DataFrame, out: str = "prediction") -> DataFrame:
    """Mean prediction of several models, all on the same row."""
    rows = df
    for i, m in enumerate(models):
        rows = with_prediction(m, rows, f"_m{i}")
    names = [f"_m{i}" for i in range(len(models))]
    total = F.lit(0.0)
    for n in names:
        total = total + F.col(n)
    return rows.withColumn(out, total / len(names)).drop(*names)


def log_rmse(df: DataFrame, target: str, prediction: str = "prediction") -> float:
    return RegressionEvaluator(labelCol=target, predictionCol=prediction, metricName="rmse").evaluate(df)


class Stack:
    """Base regressors whose out-of-fold predictions (and, if asked for, the features) feed a meta learner."""

    def __init__(self, bases: list[str], meta: str, features: list[str], use_features: bool = True, k: int = 5, seed: int = 42, **kw):
        self.bases, self.meta_kind, self.features, self.use_features, self.k, self.seed, self.kw = bases, meta, features, use_features, k, seed, kw
        self.models: dict[str, PipelineModel] = {}
        self.meta: PipelineModel | None = None

    def _meta_features(self) -> list[str]:
        return [f"{b}_pred" for b in self.bases] + (self.features if self.use_features else [])

    def fit(self, df: DataFrame, key: str, target: str, search: dict | None = None) -> "Stack":
        base, meta = (linear_settings(self.kw.get(n, {})) for n in ("linear", self.meta_kind))
        if set(self.bases) == {"linear"} and len(self.bases) == 1 and self.meta_kind == "linear" and base is not None and meta is not None and not search:
            # folds, base and meta learner from one pass: a forecast is linear in the features, so its moments follow from theirs
            parts = fold_moments(df.withColumn("fold", fold_of(F.col(key), self.k, self.seed)), self.features, target, self.k)
            lines = [m.fit(**base) for m in LS.left_out(parts)]
            total = sum(parts[1:], parts[0])
            self.models["linear"] = LineModel(self.features, total.fit(**base))
            self.meta = LineModel(self._meta_features(), LS.stacked(parts, lines, self.use_features).fit(**meta))
            return self
        df = df.withColumn("_fold", fold_of(F.col(key), self.k, self.seed))
        rows = df.where(F.col(key).isNotNull())
        for b in self.bases:
            left_out, whole = fold_models(df, "_fold", b, self.features, target, self.k, **self.kw.get(b, {}))
            rows = with_fold_prediction(rows, "_fold", left_out, self.features, f"{b}_pred")
            self.models[b] = whole()
        rows = rows.drop("_fold")
        if search and self.meta_kind == "gbt":  # depth, rounds and step; ``trials`` of them
            choices = {n: search.get(n, v) for n, v in BOOSTED_CHOICES.items()}
            self.meta, self.trials = search_boosted(rows, self._meta_features(), target, key, search.get("trials", 100), choices, self.seed)
        elif search:
            self.meta, _ = search_regressor(rows, self.meta_kind, self._meta_features(), target, search, key, self.seed, **self.kw.get(self.meta_kind, {}))
        elif self.meta_kind == "linear" and meta is not None:
            got = LS.moments(rows, self._meta_features(), target, F.array(F.lit(0)))
            self.meta = LineModel(self._meta_features(), got.get(0, LS.Moments.none(len(self._meta_features()) + 1)).fit(**meta))
        else:
            self.meta = fit_regressor(rows, self.meta_kind, self._meta_features(), target, **self.kw.get(self.meta_kind, {}))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        rows = df
        for b in self.bases:
            rows = with_prediction(self.models[b], rows, f"{b}_pred")
        return with_prediction(self.meta, rows, "prediction")


def build_stack(df: DataFrame, key: str, target: str, features: list[str], bases=("forest", "linear"), meta: str = "gbt",
                search: dict | None = None, **kw) -> Stack:
    return Stack(list(bases), meta, features, **kw).fit(df, key, target, search)


def search_regressor(df: DataFrame, kind: str, features: list[str], target: str, grid: dict[str, list] | list[dict], key: str | None = None, seed: int = 42, **kw):
    """Best model of a parameter grid, or of a list of picks, by RMSE on a hash split (by ``key``, else by the row), and the (parameters, score) list.

    Linear picks that only penalise are fitted and judged from the sums of both halves, made in one pass over ``df`` whatever the number of picks.
    """
    picks = grid if isinstance(grid, list) else random_grid(grid, 1 << 30)
    test = in_test(F.col(key), 0.2, seed) if key else in_test(F.concat_ws("|", target, *features), 0.2, seed)
    settings = [linear_settings({**kw, **p}) for p in picks] if kind == "linear" else [None]
    if all(p is not None for p in settings):
        got, none = LS.moments(df, features, target, F.array(test.cast("int"))), LS.Moments.none(len(features) + 1)
        train, held = got.get(0, none), got.get(1, none)
        held = held if held.n else train
        lines = [train.fit(**p) for p in settings]
        errors = [(held.squared_error(x) / max(held.n, 1)) ** 0.5 for x in lines]
        return LineModel(features, lines[min(range(len(errors)), key=errors.__getitem__)]), list(zip(picks, errors))
    learner = REGRESSORS[kind](labelCol=target, **kw)
    pipe = Pipeline(stages=[assembler(features), learner])
    maps = [{learner.getParam(n): v for n, v in p.items()} for p in picks]
    train, held = cut_lineage(df.filter(~test)), cut_lineage(df.filter(test))
    fits = [lambda m=m: pipe.fit(train, m) for m in maps]
    models = [without_summary(m, df.sparkSession) for m in fit_side_by_side(df.sparkSession, fits)]
    errors = [log_rmse(m.transform(held), target) for m in models]
    scores = [({p.name: v for p, v in m.items()}, e) for m, e in zip(maps, errors)]
    return models[min(range(len(errors)), key=errors.__getitem__)], scores


#: Settings of a boosted meta learner that a search chooses from.
BOOSTED_CHOICES = {"maxDepth": [2, 3, 4], "stepSize": [0.05, 0.1, 0.2, 0.4], "maxIter": list(range(1, 17))}


def search_boosted(df: DataFrame, features: list[str], target: str, key: str, trials: int = 100, choices: dict[str, list] | None = None, seed: int = 42):
    """Best boosted regressor by an adaptive search over depth, rounds and step, judged by RMSE on a hash split; and the (settings, score) list.

    Boosting adds trees to those before, so one fit with the most rounds tells the error of every smaller number: a trial with a depth and a step that were seen costs nothing.
    Fits and errors are those of the cells of both halves, made in two passes over ``df``; bins come from the half that trains.
    """
    choices = choices or BOOSTED_CHOICES
    test = in_test(F.col(key), 0.2, seed)
    bounds, names = bin_bounds(df.filter(~test), features), _bins(features)
    every = cells(df, bounds, target, by=test.cast("int"))
    rows = assembler(names)
    train, held = (rows.transform(every.where(F.col("_by") == side)).select("_x", "_y", "_n", "_within") for side in (0, 1))
    if held.isEmpty():
        held = train
    apart = held.agg((F.sum("_within") / F.sum("_n")).alias("e")).first().e or 0.0  # squared error that no tree over these bins can take away
    errors: dict[tuple, list[float]] = {}
    most = max(choices["maxIter"])

    def objective(p: dict) -> float:
        shape = (p["maxDepth"], p["stepSize"])
        if shape not in errors:
            learner = tree_learner("gbt", maxDepth=shape[0], stepSize=shape[1], maxIter=most)
            errors[shape] = learner.fit(train).evaluateEachIteration(held, "squared")
        return (errors[shape][p["maxIter"] - 1] + apart) ** 0.5

    best, done = adaptive_search(objective, choices, trials, seed)
    return fit_on_cells(merged_cells(every, names), bounds, "gbt", **best), done


def random_grid(choices: dict[str, list], draws: int = 100, seed: int = 42) -> list[dict]:
    """``draws`` different random picks from the choices (all, if there are fewer): the parameters of a search without a full grid."""
    every = [dict(zip(choices, values)) for values in itertools.product(*choices.values())]
    return random.Random(seed).sample(every, min(draws, len(every)))


class RangeModels:
    """One regressor per rating range (with overlap); predictions weighted by how well each fits its own range."""

    def __init__(self, kind: str, features: list[str], ranges=None, overlap: float = RANGE_OVERLAP, least_rows: int = 100, meta: str | None = None, **kw):
        self.kind, self.features, self.ranges, self.overlap, self.least_rows, self.meta_kind, self.kw = kind, features, list(ranges or MODEL_RANGES), overlap, least_rows, meta, kw
        self.models: dict[tuple, PipelineModel] = {}
        self.meta: PipelineModel | None = None

    def _from_sums(self, df: DataFrame, target: str, settings: dict) -> "RangeModels":
        """Linear ranges, their stand-ins and a linear meta learner from one pass: groups are (range, half) and the half of all rows that trains the meta learner."""
        side = in_test(F.concat_ws("|", target, *self.features), 0.5).cast("int")
        mine = [F.when(F.col(target).between(lo - self.overlap, hi + self.overlap), F.lit(2 * i) + side) for i, (lo, hi) in enumerate(self.ranges)]
        last = 2 * len(self.ranges)
        got = LS.moments(df, self.features, target, F.array_compact(F.array(*mine, F.when(side == 1, last))))
        none = LS.Moments.none(len(self.features) + 1)
        halves = {r: (got.get(2 * i, none), got.get(2 * i + 1, none)) for i, r in enumerate(self.ranges)}
        used = [r for r, (a, b) in halves.items() if a.n + b.n >= self.least_rows]
        self.models = {r: LineModel(self.features, (halves[r][0] + halves[r][1]).fit(**settings)) for r in used}
        if self.meta_kind:
            stand_ins = [halves[r][0].fit(**settings) for r in used]
            width = len(self.features) + 1
            matrix = np.concatenate([[np.append(s.coef, 0.0)] for s in stand_ins] + [np.eye(width)[-1:]])
            seen = got.get(last, none).mapped(matrix, np.array([*(s.intercept for s in stand_ins), 0.0]))
            self.meta = LineModel(self._names(), seen.fit(**linear_settings({})))
        return self

    def fit(self, df: DataFrame, target: str) -> "RangeModels":
        settings = linear_settings(self.kw)
        if self.kind == "linear" and settings is not None and self.meta_kind in (None, "linear"):
            return self._from_sums(df, target, settings)
        sizes = {(r["lo"], r["hi"]): r["n"] for r in rows_per_range(df.select(target), target, self.ranges, self.overlap).groupBy("lo", "hi").agg(F.count("*").alias("n")).collect()}
        used = [r for r in self.ranges if sizes.get(r, 0) >= self.least_rows]
        fits = [lambda r=r: fit_regressor(df.filter(F.col(target).between(r[0] - self.overlap, r[1] + self.overlap)), self.kind, self.features, target,
                                          **self.kw) for r in used]
        self.models = dict(zip(used, fit_side_by_side(df.sparkSession, fits)))
        if self.meta_kind:  # half of the rows fit stand-ins of the base models, the other half's predictions train the meta learner
            side = in_test(F.concat_ws("|", target, *self.features), 0.5)
            bases, self.models = self.models, {r: fit_regressor(df.filter(~side & F.col(target).between(r[0] - self.overlap, r[1] + self.overlap)), self.kind, self.features, target, **self.kw)
                                               for r in self.models}
            self.meta = fit_regressor(self._base(df.filter(side)), self.meta_kind, self._names(), target)
            self.models = bases
        return self

    def _names(self) -> list[str]:
        return [f"range_{lo}_{hi}_pred" for lo, hi in self.models]

    def _base(self, df: DataFrame) -> DataFrame:
        for (lo, hi), m in self.models.items():
            df = with_prediction(m, df, f"range_{lo}_{hi}_pred")
        return df

    def predict(self, df: DataFrame) -> DataFrame:
        rows = self._base(df)
        if self.meta is not None:
            return with_prediction(self.meta, rows, "prediction")
        total, weighted, plain = F.lit(0.0), F.lit(0.0), F.lit(0.0)
        for (lo, hi), name in zip(self.models, self._names()):
            w = range_weight(F.col(name), F.lit(float(lo)), F.lit(float(hi)), self.overlap)
            total, weighted, plain = total + w, weighted + w * F.col(name), plain + F.col(name)
        mean = plain / max(1, len(self.models))
        return rows.withColumn("prediction", F.when(total > 0, weighted / total).otherwise(mean)).drop(*self._names())


# ---------------------------------------------------------------- curves and clusters

def curve_embeddings(df: DataFrame, key: str, modes: dict[str, list[str]], k: int = 16) -> DataFrame:
    """Principal components of each curve. Rows with a null level are left out of the fit and get null components."""
    out = df.select(key)
    for mode, cols in modes.items():
        size = min(k, len(cols))
        whole = VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="skip").transform(df.select(key, *cols))
        a = vector_to_array("_z")
        part = PCA(k=size, inputCol="_x", outputCol="_z").fit(whole).transform(whole).select(
            key, *[F.get(a, F.lit(i)).alias(f"{mode}_emb_{i}") for i in range(size)])
        out = out.join(part, key, "left")
    return out


#: Curves whose kernel with every curve makes the map: those with the smallest key hashes.
LANDMARKS = 256


def kernel_embeddings(df: DataFrame, key: str, modes: dict[str, list[str]], k: int = 16, width: float = 1.5, landmarks: int = LANDMARKS, seed: int = 42) -> DataFrame:
    """(key, {mode}_emb_0 .. {mode}_emb_{k-1}): ``k`` directions of a Gaussian kernel between curves, also where a curve has fewer levels than that.

    Nystroem's map: ``landmarks`` curves (a bounded sample by key hash; only the map rests on it, every row is mapped) give the kernel's leading eigenvectors, and each curve
    is placed by its kernel values with them, row by row. The kernel is ``width`` times the median distance of the landmarks wide. Rows with a null or non-finite level get
    null components; directions beyond the rank are zero. Without a whole curve all components are null.
    """
    out = df.select(key)
    for mode, cols in modes.items():
        names = [f"{mode}_emb_{i}" for i in range(k)]
        curve = F.array(*[F.col(c).cast("double") for c in cols])
        rows = df.select(key, F.when(F.forall(curve, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), curve).alias("_c"))
        chosen = rows.where("_c is not null").orderBy(key_hash(F.col(key), seed), key).limit(landmarks).select("_c").toArrow()
        fields = rows.select(key).schema
        for n in names:
            fields = fields.add(n, "double")
        if not chosen.num_rows:
            out = out.join(rows.select(key, *[F.lit(None).cast("double").alias(n) for n in names]), key, "left")
            continue
        marks = np.array(chosen["_c"].to_pylist())
        apart = ((marks[:, None] - marks[None]) ** 2).sum(axis=2)
        scale = 2 * width * width * (float(np.median(apart[apart > 0])) if (apart > 0).any() else 1.0)
        values, vectors = np.linalg.eigh(np.exp(-apart / scale))
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        live = values > 1e-10 * values[0]
        to_map = np.zeros((len(marks), k))
        to_map[:, :len(values)][:, live] = vectors[:, live] / np.sqrt(values[live])
        to_map *= np.where(to_map[np.abs(to_map).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)

        def run(batches: Iterator[pa.RecordBatch], marks=marks, scale=scale, to_map=to_map, names=names) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column(1)
                good = np.asarray(lists.is_valid())
                x = np.asarray(lists.drop_null().flatten(), np.float64).reshape(-1, marks.shape[1])
                far = (x * x).sum(axis=1)[:, None] + (marks * marks).sum(axis=1) - 2 * x @ marks.T
                got = np.exp(-np.maximum(far, 0) / scale) @ to_map
                whole = np.zeros((b.num_rows, len(names)))
                whole[good] = got
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(whole[:, i], mask=~good) for i in range(len(names)))], [key, *names])

        out = out.join(rows.mapInArrow(run, fields), key, "left")
    return out


def clusters(df: DataFrame, key: str, features: list[str], k: int = 50, seed: int = 42) -> DataFrame:
    """(key, position_cluster) by k-means over standardised features."""
    pipe = Pipeline(stages=[assembler(features), StandardScaler(inputCol="_x", outputCol="_s", withMean=True),
                            KMeans(featuresCol="_s", predictionCol="position_cluster", k=k, seed=seed)])
    rows = df.select(key, *features)
    return pipe.fit(rows).transform(rows).select(key, "position_cluster")
