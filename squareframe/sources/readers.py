"""Puzzle tables from CSV or Parquet with an explicit schema; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = range(1050, 2051, 100)


def puzzle_schema(train: bool = True) -> T.StructType:
    fields = [T.StructField("puzzle_id", T.StringType()), T.StructField("fen", T.StringType()), T.StructField("moves", T.StringType())]
    if train:
        fields += [T.StructField(n, T.IntegerType()) for n in ("rating", "rating_deviation", "popularity", "nb_plays")]
    fields += [T.StructField(n, T.StringType()) for n in ("themes", "game_url", "opening_tags")]
    fields += [T.StructField(f"success_prob_{mode}_{n}", T.DoubleType()) for mode in ("rapid", "blitz") for n in LEVELS]
    return T.StructType(fields)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header row; ``columns`` prunes the scan."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", False).option("escape", '"').csv(path)
    return df.select(*columns) if columns else df


def read_book(spark: SparkSession, path: str) -> DataFrame:
    """Opening book table from CSV: placement key, name, ECO code; positions are cut to their first field."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("fen", "name", "eco")])
    return read_csv(spark, path, schema).select(F.substring_index("fen", " ", 1).alias("placement"), "name", "eco")


def union_tables(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train over test by column name, with the origin flag; columns that one side lacks become null."""
    return train.withColumn("is_train", F.lit(1)).unionByName(test.withColumn("is_train", F.lit(0)), allowMissingColumns=True)


def suffix_number(name: str) -> int:
    return int(name.rsplit("_", 1)[1])


def columns_like(df: DataFrame, part: str) -> list[str]:
    """Columns whose name holds ``part``, ordered by their numeric suffix."""
    return sorted([c for c in df.columns if part in c], key=suffix_number)


def text_lines(df: DataFrame, value: Column, order: list[str]) -> DataFrame:
    """Rounded whole numbers as text in row order: the form of a submission file."""
    return df.orderBy(*order).select(F.bround(value).cast("long").cast("string").alias("value"))
