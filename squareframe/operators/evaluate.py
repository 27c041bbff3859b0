"""Errors and quality figures of predictions, all as single aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import LOSS_RANGES, RANGE_OVERLAP
from .splits import with_sum_before


def rounded(c: Column, places: int = 6) -> Column:
    return F.round(c, places)


def bucket_label(value: Column, bounds: list[int]) -> Column:
    """Half-open buckets ``[lo, hi)`` named ``lo-hi``; the last one is open. Null below the first bound."""
    out = None
    for lo, hi in zip(bounds, bounds[1:] + [None]):
        cond = (value >= lo) & (value < hi) if hi is not None else value >= lo
        name = f"{lo}-{'inf' if hi is None else hi}"
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def closed_label(value: Column, ranges, default: str = "Unknown") -> Column:
    """First closed range that holds the value, else the default."""
    out = None
    for lo, hi, name in ranges:
        out = F.when(value.between(lo, hi), name) if out is None else out.when(value.between(lo, hi), name)
    return out.otherwise(default)


def _rmse(target: str, forecast: str) -> Column:
    d = F.col(target) - F.col(forecast)
    return rounded(F.sqrt(F.avg(d * d)))


def error_by_bucket(df: DataFrame, bucket: str, target: str, forecast: str) -> DataFrame:
    return df.groupBy(bucket).agg(F.count("*").alias("n"), _rmse(target, forecast).alias("rmse"))


def regression_errors(df: DataFrame, target: str, forecast: str) -> DataFrame:
    """RMSE, MAE and R2 from running sums: one pass, one row."""
    d = F.col(target) - F.col(forecast)
    return df.agg(
        rounded(F.sqrt(F.avg(d * d))).alias("rmse"), rounded(F.avg(F.abs(d))).alias("mae"),
        rounded(1 - F.sum(d * d) / (F.var_pop(target) * F.count(target))).alias("r2"))


def fold_errors(df: DataFrame, fold: str, target: str, forecast: str) -> DataFrame:
    """RMSE per fold and over all rows (fold -1), by one rollup."""
    return df.rollup(fold).agg(_rmse(target, forecast).alias("rmse"), F.count("*").alias("n")).select(
        F.coalesce(F.col(fold), F.lit(-1)).alias(fold), "rmse", "n")


def label_scores(df: DataFrame, label: str, truth: str, score: str, threshold: float = 0.5) -> DataFrame:
    """F1 and AUC per label. The AUC is the rank sum over counts per distinct score; the order is over (label, score) in range partitions, so a label with as many
    scores as rows spreads over tasks."""
    pos, hit = F.col(truth) == 1, F.col(score) >= threshold
    counts = df.groupBy(label, score).agg(
        F.count_if(pos).alias("p"), F.count_if(~pos).alias("n"))
    counts = with_sum_before(counts, [label, score], "n", "_before")
    starts = counts.groupBy(label).agg(F.min("_before").alias("_start"))
    counts = counts.join(starts, label).withColumn("n_below", F.col("_before") - F.col("_start"))
    hit = F.col(score) >= threshold
    tp, fp = F.sum(F.when(hit, F.col("p")).otherwise(0)), F.sum(F.when(hit, F.col("n")).otherwise(0))
    fn = F.sum(F.when(~hit, F.col("p")).otherwise(0))
    return counts.groupBy(label).agg(
        rounded(F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0))).alias("f1"),
        rounded(F.sum(F.col("p") * (F.col("n_below") + F.col("n") / 2))
                / F.nullif((F.sum("p") * F.sum("n")).cast("double"), F.lit(0.0))).alias("auc"))


def degradation(current: DataFrame, baseline: DataFrame, keys: list[str], warn: float = 5.0, fail: float = 10.0) -> DataFrame:
    """Percent change of ``value`` against a baseline metric table, graded ok, warn or fail."""
    joined = current.join(baseline.withColumnRenamed("value", "baseline"), keys)
    change = (F.col("value") - F.col("baseline")) / F.col("baseline") * 100
    return joined.select(*keys, rounded(change).alias("change_pct"),
                         F.when(change > fail, "fail").when(change > warn, "warn").otherwise("ok").alias("verdict"))


def bucket_weight(target: Column, ranges=None) -> Column:
    """Loss weight by target range; 0 outside all ranges."""
    out = None
    for lo, hi, w in ranges or LOSS_RANGES:
        cond = (target >= lo) & (target < hi)
        out = F.when(cond, w) if out is None else out.when(cond, w)
    return out.otherwise(0.0)


def range_weight(pred: Column, lo: Column, hi: Column, overlap: float = RANGE_OVERLAP) -> Column:
    """1 inside the range, falling to 0 over the overlap on both sides."""
    away = F.greatest(lo - pred, pred - hi, F.lit(0.0))
    return F.when(away <= overlap, 1 - away / overlap).otherwise(0.0)


def combine_ranges(preds: DataFrame, key: str, pred: str = "pred", overlap: float = RANGE_OVERLAP,
                   zero_when_unweighted: bool = False) -> DataFrame:
    """Weighted mean of range-model predictions given as rows (key, lo, hi, pred).

    Where every weight is 0 the plain mean is used, or 0 when asked for.
    """
    w = range_weight(F.col(pred), F.col("lo").cast("double"), F.col("hi").cast("double"), overlap)
    rows = preds.withColumn("w", w)
    total, weighted = F.sum("w"), F.sum(F.col("w") * F.col(pred))
    fallback = F.lit(0.0) if zero_when_unweighted else F.avg(pred)
    return rows.groupBy(key).agg(F.when(total > 0, weighted / total).otherwise(fallback).alias("prediction"))
