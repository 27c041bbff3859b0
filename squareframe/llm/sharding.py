"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries, rows are dealt to ranges, overfull ranges are divided again, and the exact
sizes of the ranges place every row on the line from 0 to the total size, which is cut into equal shards.

The order is (hash of the text, key, hash of both), so equal texts lie next to each other and a hot text is still divided by its keys.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Ranges aimed at, samples drawn for each range, and how much above its share a range may be before it is divided.
RANGES = 64
#: Rows that a range should hold; more rows make more ranges, up to a number that fits into one search.
ROWS_IN_RANGE, MOST_RANGES = 1 << 20, 512
SAMPLES_PER_RANGE = 16
OVERFULL = 2.0
ORDER = ["_k1", "_k2", "_k3"]


@dataclass(frozen=True)
class Splitters:
    """Sorted boundary keys, ``MOST_RANGES`` and those of three rounds of division at most."""

    keys: list[tuple[int, int, int]]

    def range_of(self, df: DataFrame) -> DataFrame:
        """``_range``: number of boundaries at or before a row. An ordered search of nested conditions inside generated code."""
        key = F.struct(*ORDER)

        def search(lo: int, hi: int):
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(key < F.struct(*[F.lit(x).cast("long").alias(c) for x, c in zip(self.keys[mid], ORDER, strict=True)]), search(lo, mid)).otherwise(search(mid + 1, hi))

        return df.withColumn("_range", search(0, len(self.keys)).cast("int"))


def _weighted_sample(df: DataFrame, total: int, wanted: int) -> list[tuple[tuple[int, int, int], float]]:
    """Rows drawn with a chance in proportion to their size, by a hash of the key (the same on each run), with the weight each stands for. About ``wanted`` rows."""
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(wanted / max(1, total)))
    dice = F.pmod(F.xxhash64(F.lit("dice"), *ORDER), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = df.withColumn("_c", chance).where(dice < F.col("_c")).select(*ORDER, (F.col("size") / F.col("_c")).alias("w"))
    return sorted(((r[0], r[1], r[2]), r[3]) for r in drawn.collect())


def _quantiles(sample, parts: int) -> list[tuple[int, int, int]]:
    total, run, out = sum(w for _, w in sample), 0.0, []
    for key, w in sample:
        run += w
        if run >= total * (len(out) + 1) / parts and len(out) < parts - 1:
            out.append(key)
    return out


def splitters(rows: DataFrame, total: int, ranges: int = RANGES) -> Splitters:
    """Boundaries after the sampling round and up to three rounds that divide ranges over ``OVERFULL`` times their share."""
    keys = sorted(set(_quantiles(_weighted_sample(rows, total, ranges * SAMPLES_PER_RANGE), ranges)))
    for _ in range(3):
        dealt = Splitters(keys).range_of(rows)
        sizes = {r._range: r.size for r in dealt.groupBy("_range").agg(F.sum("size").alias("size")).collect()}  # one row per range
        over = {k: v for k, v in sizes.items() if v > OVERFULL * total / ranges}
        if not over:
            break
        within = sum(over.values())
        sample = _weighted_sample(dealt.where(F.col("_range").isin(list(over))), within, len(over) * SAMPLES_PER_RANGE * 4)
        new, edges = set(keys), keys
        for k, v in over.items():
            new |= set(_quantiles([x for x in sample if bisect.bisect_right(edges, x[0]) == k], int(v * ranges / total) + 1))
        if len(new) == len(keys):
            break
        keys = sorted(new)
    return Splitters(keys)


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot) of each row. Law ``bytes``: shards are equal parts of the whole size, up to one row.

    Size is the UTF-8 length plus 1; a null text has size 1 and the checksum of no bytes. ``slot`` counts from 0 without gaps in each shard. Null keys come first
    among equal texts; rows that are equal in both are told apart by their place only, so which of them comes first doesn't matter. An empty table gives an empty
    result. Only key, size and hashes are shuffled, never texts. Ranges follow the number of rows; one that is still overfull after three rounds of division
    (rows equal in text and key can't be divided) costs time in its task, not the balance of the shards.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(t) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
                       F.xxhash64(t).alias("_k1"), F.coalesce(F.xxhash64(F.lit("key"), F.col(key)), F.lit(0)).alias("_k2"))
    rows = cut_lineage(rows.withColumn("_k3", F.xxhash64("text_crc32", "_k1", "_k2")))  # texts are read once
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    dealt = splitters(rows, total, max(RANGES, min(MOST_RANGES, -(-n // ROWS_IN_RANGE)))).range_of(rows)
    order = Window.partitionBy("_range").orderBy("_k1", "_k2", F.col("key").asc_nulls_first())
    placed = dealt.withColumn("_at", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_nth", F.row_number().over(order))
    sizes = dealt.groupBy("_range").agg(F.sum("size").alias("_size"), F.count("*").alias("_n"))
    line = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range, a bounded number
    before = sizes.select("_range", F.coalesce(F.sum("_size").over(line), F.lit(0)).alias("_b"), F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_c"))
    middle = (F.col("_at") + F.col("_b")) * 2 - F.col("size")  # twice the place of a row's middle
    cut = F.floor(middle.cast("double") * F.lit(shards / max(1, 2 * total))).cast("int")
    placed = placed.join(F.broadcast(before), "_range").withColumn("shard", F.greatest(F.lit(0), F.least(F.lit(shards - 1), cut)))
    placed = cut_lineage(placed.select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("_c") + F.col("_nth") - 1).alias("_line")))
    starts = placed.groupBy("shard").agg(F.min("_line").alias("_start"))  # one row per shard
    return placed.join(F.broadcast(starts), "shard").select(key, "size", "text_crc32", "shard", (F.col("_line") - F.col("_start")).alias("slot"))


def write_shards(docs: DataFrame, folder: str, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write whole rows to ``folder``/shard=n, in the order of their slots, and give back the assignment. Keys must be unique and not null."""
    where = cut_lineage(shard(docs, shards, key, text).select(F.col(key), F.col("shard"), F.col("slot")))
    rows = docs.drop("shard", "slot").join(where, key)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(folder)
    return where
