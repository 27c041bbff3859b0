"""Repeatable folds and splits. Random ones hash the key; ordered ones use a balanced global rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut_lineage

HASH_SPACE = 1 << 32


def key_hash(key: Column, seed: int = 42) -> Column:
    """32-bit number from the md5 of seed and key: the same on every engine and every plan."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long")


def fold_of(key: Column, k: int = 5, seed: int = 42) -> Column:
    return (key_hash(key, seed) % k).cast("int")


def in_test(key: Column, share: float = 0.2, seed: int = 42) -> Column:
    return key_hash(key, seed) < F.lit(int(share * HASH_SPACE)).cast("long")


def with_global_rank(df: DataFrame, order: list[str], rank: str = "rank") -> DataFrame:
    """Exact row number (from 0) over a total order without a single-task sort.

    Rows are range-partitioned on the whole order, so equal leading values spread over tasks, and are numbered inside
    their partition. The numbered rows are checkpointed before they are counted: range bounds come from a sample, and
    counts and rows must see the same partitions even when an executor is lost. Offsets are one row per partition.
    """
    numbered = (
        df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33)).withColumn("_pos", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_id"))
    numbered = cut_lineage(numbered)
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return numbered.join(F.broadcast(offsets), "_part").withColumn(rank, F.col("_off") + F.col("_pos")).drop("_part", "_pos", "_off")


def with_sum_before(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Exact sum of ``value`` over all rows before a row in a total order, by range partitions as in ``with_global_rank``."""
    dealt = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = dealt.groupBy("_part").agg(F.sum(value).alias("_all")).select("_part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_start"))
    placed = dealt.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(starts), "_part")
    return placed.withColumn(out, F.col("_start") + F.col("_inside")).drop("_part", "_inside", "_start")


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """One row ``median``: mean of the two middle values, null without any. Values are counted first, so a common one is a single row of the ranking."""
    counts = df.select(F.col(column).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    ranked = with_sum_before(counts, ["v"], "n", "below")
    total = ranked.agg(F.sum("n")).scalar()
    low, high = F.floor((total - 1) / 2), F.floor(total / 2)
    holds = lambda r: (F.col("below") <= r) & (r < F.col("below") + F.col("n"))
    return ranked.agg(((F.max(F.when(holds(low), F.col("v"))) + F.max(F.when(holds(high), F.col("v")))) / 2).alias("median"))


def with_rank_in_label(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Random but repeatable position of each row within its label, and the label size."""
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    ranked = with_global_rank(hashed, [label, "_h", key], "_rank")
    starts = ranked.groupBy(label).agg(F.min("_rank").alias("_start"), F.count("*").alias("_size"))
    out = ranked.join(starts, label)  # the number of labels is data-dependent, so Spark picks the join by size
    return out.withColumn("rank_in_label", F.col("_rank") - F.col("_start")).withColumn("label_size", F.col("_size")).drop(
        "_h", "_rank", "_start", "_size")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    return with_rank_in_label(df, label, key, seed).withColumn("fold", (F.col("rank_in_label") % k).cast("int")).drop(
        "rank_in_label", "label_size")


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``is_test`` marks floor(share * size) rows of every label."""
    ranked = with_rank_in_label(df, label, key, seed)
    cut = F.floor(F.col("label_size") * share)
    return ranked.withColumn("is_test", (F.col("rank_in_label") < cut).cast("int")).drop("rank_in_label", "label_size")


def time_split(df: DataFrame, ts: str, key: str, share: float = 0.8) -> DataFrame:
    """``is_test`` is 0 for the first floor(share * n) rows in time order."""
    ranked = with_global_rank(df, [ts, key])
    cut = ranked.agg(F.floor(F.count("*") * share)).scalar()
    return ranked.withColumn("is_test", (F.col("rank") >= cut).cast("int")).drop("rank")


def time_folds(df: DataFrame, ts: str, key: str, n_splits: int = 5) -> DataFrame:
    """Block number of each row in time order; rows beyond n_splits equal blocks have none (-1)."""
    ranked = with_global_rank(df, [ts, key])
    size = ranked.agg(F.floor(F.count("*") / n_splits)).scalar()
    block = F.floor(F.col("rank") / F.nullif(size, F.lit(0))).cast("int")
    return ranked.withColumn("block", F.when(block < n_splits, block).otherwise(-1)).drop("rank")


def expanding_windows(blocks: DataFrame, n_splits: int = 5) -> DataFrame:
    """(split, role) copies: split i trains on blocks up to i and validates on block i + 1."""
    splits = F.filter(F.sequence(F.lit(0), F.lit(n_splits - 2)), lambda i: i + 1 >= F.col("block"))
    rows = blocks.filter("block >= 0").select("*", F.explode(splits).alias("split"))
    return rows.withColumn("role", F.when(F.col("block") <= F.col("split"), "train").otherwise("validate"))
