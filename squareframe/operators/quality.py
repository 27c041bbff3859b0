"""Validation and profiles. Each is one aggregation over the table, in long form where columns vary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import MAX_MISSING_SHARE, RATING_BOUNDS
from .splits import exact_median


class ValidationError(ValueError):
    pass


def require_columns(df: DataFrame, required: list[str], train_only: tuple[str, ...] = ("rating",), is_train: bool = True) -> None:
    missing = [c for c in required if c not in df.columns and (is_train or c not in train_only)]
    if missing:
        raise ValidationError(f"missing columns: {', '.join(missing)}")


def _unpivot(one_row: DataFrame, names: list[str], value: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias(value)) for n in names])
    return one_row.select(F.explode(pairs).alias("p")).select("p.*")


def null_counts(df: DataFrame, columns: list[str], blank_is_null: bool = False) -> DataFrame:
    """(column, missing, percent) for the given columns."""
    def gone(c):
        return F.col(c).isNull() | (F.col(c).cast("string") == "") if blank_is_null else F.col(c).isNull()

    one = df.agg(*[F.struct(F.count_if(gone(c)).alias("missing"), F.count("*").alias("rows")).alias(c) for c in columns])
    out = _unpivot(one, columns, "v")
    return out.select("column", F.col("v.missing").alias("missing"),
                      F.round(100 * F.col("v.missing") / F.greatest(F.col("v.rows"), F.lit(1)), 6).alias("percent"))


def missing_verdict(df: DataFrame, columns: list[str], limit: float = MAX_MISSING_SHARE) -> DataFrame:
    return null_counts(df, columns).withColumn("passes", (F.col("percent") <= limit * 100).cast("int"))


def require_complete(df: DataFrame, columns: list[str], limit: float = MAX_MISSING_SHARE) -> None:
    bad = missing_verdict(df, columns, limit).filter("passes = 0").select("column").collect()  # at most one row per column
    if bad:
        raise ValidationError(f"too many missing values: {', '.join(r[0] for r in bad)}")


def out_of_range(df: DataFrame, column: str, bounds: tuple[float, float] = RATING_BOUNDS) -> DataFrame:
    """Counted, never dropped."""
    return df.agg(F.count_if(~F.col(column).between(*bounds)).alias("out_of_range"), F.count(column).alias("rows"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def target_profile(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(
        F.round(F.min(c), 6).alias("target_min"), F.round(F.max(c), 6).alias("target_max"), F.round(F.avg(c), 6).alias("target_mean"),
        F.round(F.stddev_samp(c), 6).alias("target_std")).withColumn("target_median", F.round(exact_median(df, column).scalar(), 6)).select(
        "target_min", "target_max", "target_mean", "target_median", "target_std")


def matrix_check(df: DataFrame, columns: list[str], bound: float = 1000.0) -> DataFrame:
    """Nulls and largest absolute value over all feature columns."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))
    top = F.max(F.greatest(*[F.abs(F.col(c)) for c in columns], F.lit(0.0)))
    return df.agg(nulls.alias("nulls"), F.round(top, 6).alias("largest"), (top <= bound).cast("int").alias("within"))


def feature_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*[F.struct(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.min(c).cast("double"), 6).alias("min"),
                            F.round(F.max(c).cast("double"), 6).alias("max")).alias(c) for c in columns])
    return _unpivot(one, columns, "v").select("column", "v.n", "v.mean", "v.min", "v.max")


def flag_sum_preserved(before: DataFrame, after: DataFrame, flag: str = "is_train") -> DataFrame:
    one = before.agg(F.sum(flag).alias("before")).withColumn("after", after.agg(F.sum(flag)).scalar())
    return one.withColumn("preserved", (F.col("before") == F.col("after")).cast("int"))
