"""Stage tables, step store, exports and the metric table.

Stages are Parquet folders named by step and content fingerprint, plus a log row per write. A stage is reused only when
the fingerprint of its input is the same, so a second input never reads the features of the first one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SCHEMA = T.StructType([
    T.StructField("step", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("rows", T.LongType()),
    T.StructField("columns", T.StringType()), T.StructField("written_at", T.TimestampType())])

METRIC_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("category", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("ts", T.TimestampType()), T.StructField("value", T.DoubleType())])


def fingerprint_row(df: DataFrame) -> DataFrame:
    """One row: count and order-free hash sum over all columns of the whole table."""
    h = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("hash_sum"))


def fingerprint(df: DataFrame) -> str:
    r = fingerprint_row(df).first()
    names = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)
    spark = df.sparkSession
    return spark.range(1).select(F.md5(F.lit(f"{names}|{r.rows}|{r.hash_sum}"))).first()[0]


def fingerprint_md5(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same idea with md5, which other engines have as well."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    part = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return df.agg(F.count("*").alias("rows"), F.sum(part).alias("hash_sum"))


def _stage(root: str, step: str, fp: str) -> str:
    return os.path.join(root, "stages", f"step={step}", f"fp={fp}")


def _exists(spark: SparkSession, path: str) -> bool:
    """A finished write, on any file system Spark can reach."""
    done = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS"))
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def _log(spark: SparkSession, root: str, step: str, fp: str, rows: int, columns: list[str]) -> None:
    row = spark.range(1).select(
        F.lit(step).alias("step"), F.lit(fp).alias("fingerprint"), F.lit(rows).cast("long").alias("rows"),
        F.lit(",".join(columns)).alias("columns"), F.current_timestamp().alias("written_at"))
    row.write.mode("append").parquet(os.path.join(root, "stage_log"))


def save_stage(df: DataFrame, root: str, step: str, fp: str) -> DataFrame:
    """Write a stage, log its shape, return it read back. The count rides along in the write job."""
    spark, path = df.sparkSession, _stage(root, step, fp)
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    _log(spark, root, step, fp, seen.get["rows"], df.columns)
    return spark.read.parquet(path)


def stage_or_compute(source: DataFrame, root: str, step: str, compute: Callable[[DataFrame], DataFrame],
                     fp: str | None = None) -> DataFrame:
    """Reload the stage made from the same input, else compute and save it."""
    fp = fp or fingerprint(source)
    path = _stage(root, step, fp)
    spark = source.sparkSession
    return spark.read.parquet(path) if _exists(spark, path) else save_stage(compute(source), root, step, fp)


def stage_log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(os.path.join(root, "stage_log"))


def load_step(spark: SparkSession, root: str, step: str, fp: str | None = None) -> DataFrame:
    """A step by fingerprint, or the newest one written under its name."""
    if fp is None:
        newest = stage_log(spark, root).filter(F.col("step") == step).agg(F.max_by("fingerprint", "written_at")).first()[0]
        if newest is None:
            raise FileNotFoundError(f"no stage named {step}")
        fp = newest
    return spark.read.parquet(_stage(root, step, fp))


def export_table(df: DataFrame, root: str, name: str) -> tuple[str, str]:
    """Write a table as Parquet and as CSV; the CSV is made from the Parquet copy, so the plan runs once."""
    pq, csv = os.path.join(root, "export", name, "parquet"), os.path.join(root, "export", name, "csv")
    df.write.mode("overwrite").parquet(pq)
    df.sparkSession.read.parquet(pq).write.mode("overwrite").option("header", True).csv(csv)
    return pq, csv


def write_lines(lines: DataFrame, path: str) -> None:
    """Ordered one-column text. Part files are numbered in the order of the rows, so their names in order give the whole; no task holds more than its range."""
    lines.write.mode("overwrite").text(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a stage or export folder on any file system Spark can reach."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def append_metrics(metrics: DataFrame, root: str) -> None:
    metrics.select(*[F.col(f.name).cast(f.dataType) for f in METRIC_SCHEMA]).write.mode("append").parquet(os.path.join(root, "metrics"))


def read_metrics(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(METRIC_SCHEMA).parquet(os.path.join(root, "metrics"))


def new_folder(spark: SparkSession, name: str) -> str:
    from ..session import shared_folder

    return os.path.join(shared_folder(spark), name, uuid.uuid4().hex)
