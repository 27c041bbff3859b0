"""Exact top-k search by tiled matrix products: shards of candidates, tiles of queries, selection inside each tile, merging of the top lists in a tree.

Vectors become integers floor(scale * x), so scores are exact and ties are decided by key. Candidates are dealt to shards of bounded size; every shard meets all
query tiles (one row per tile), multiplies tile by tile and keeps k per query; lists are merged ``FAN`` shards at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SHARD_ROWS = 8192
TILE_ROWS = 512
FAN = 16


def usable(vec: Column) -> Column:
    """Vectors that are not null and hold finite numbers only."""
    return vec.isNotNull() & F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in float64 where every partial sum is below 2**53, else in int64, else in Python's integers (held to the range of long)."""
    width = max(1, q.shape[1])
    bound = (int(np.abs(q).max(initial=0)) or 1) * (int(np.abs(c).max(initial=0)) or 1) * width
    if bound < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return q @ c.T
    exact = np.array([[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in c] for x in q], object).reshape(len(q), len(c))
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _padded(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """Row and column of the k best of each row, ties to smaller ids; ``ids`` is sorted, a row's own id doesn't count."""
    rows, cols = [], []
    left, right = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
    for r, s in enumerate(scores):
        pool = np.arange(len(ids)) if left[r] == right[r] else np.concatenate([np.arange(left[r]), np.arange(right[r], len(ids))])
        v = s[pool]
        if len(v) > k:
            kth = np.partition(v, len(v) - k)[len(v) - k]
            above = np.flatnonzero(v > kth)
            pick = np.concatenate([above, np.flatnonzero(v == kth)[:k - len(above)]])
        else:
            pick = np.arange(len(v))
        rows.append(np.full(len(pick), r))
        cols.append(pool[pick])
    return np.concatenate(rows), np.concatenate(cols)


def _pack(scale: int, rows: int):
    """Rows (shard, id, vec) to tiles: ids and a row-major matrix of int64 as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                part = b.slice(i, rows)
                vecs = part.column("vec")
                sizes = np.asarray(vecs.value_lengths().fill_null(0))
                width = int(sizes.max(initial=0))
                m = np.zeros((len(sizes), width))
                m[np.arange(width) < sizes[:, None]] = np.asarray(vecs.flatten(), np.float64)
                whole = np.floor(m * scale)
                if np.abs(whole).max(initial=0) >= 2.0 ** 63:
                    whole = np.clip(whole, -(2.0 ** 63), 2.0 ** 63 - 1024)
                yield pa.RecordBatch.from_arrays([
                    pa.array([np.asarray(part.column("id")).tobytes()], pa.binary()), pa.array([whole.astype(np.int64).tobytes()], pa.binary()), pa.array([width], pa.int32())],
                    ["ids", "matrix", "width"])
    return run


def _search(k: int):
    def tile(ids: bytes, matrix: bytes, width: int):
        i = np.frombuffer(ids, np.int64)
        return i, np.frombuffer(matrix, np.int64).reshape(len(i), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, ready = None, [], None
        for b in batches:
            for r in b.to_pylist():
                if r["shard"] != shard:
                    shard, parts, ready = r["shard"], [], None
                if r["kind"] == 0:
                    parts.append((r["id"], r["vec"]))
                    continue
                if not parts:
                    continue
                if ready is None:
                    ids = np.array([x for x, _ in parts], np.int64)
                    width = max(len(v) // 8 for _, v in parts)
                    m = np.zeros((len(parts), width), np.int64)
                    for n, (_, v) in enumerate(parts):
                        m[n, :len(v) // 8] = np.frombuffer(v, np.int64)
                    order = np.argsort(ids, kind="stable")
                    ready = ids[order], m[order]
                ids, m = ready
                own, q = tile(r["ids"], r["matrix"], r["width"])
                width = max(m.shape[1], q.shape[1])
                scores = _products(_padded(q, width), _padded(m, width))
                rows, cols = _best(scores, ids, own, k)
                yield pa.RecordBatch.from_arrays([pa.array(own[rows]), pa.array(np.full(len(rows), shard, np.int64)), pa.array(ids[cols]), pa.array(scores[rows, cols])],
                                                 ["query_id", "shard", "id", "score"])
    return run


def _scaled(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = b.column("vec")
            sizes, values = np.asarray(vecs.value_lengths()), np.asarray(vecs.flatten(), np.float64)
            whole = np.clip(np.floor(values * scale), -(2.0 ** 63), 2.0 ** 63 - 1024).astype(np.int64).tobytes()
            ends = np.cumsum(sizes) * 8
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("id"), pa.array([whole[e - 8 * n:e] for e, n in zip(ends, sizes, strict=True)], pa.binary())], ["shard", "id", "vec"])
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vec: str = "embedding", scale: int = 1024, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), ``key``, score: the k highest integer inner products of each query row with all rows of another key.

    Vectors that are null or hold nulls or non-finite numbers, and rows with a null key, take no part. A shorter vector counts as padded with zeros. Ties go to
    the smaller key. Repeated candidate rows count each; repeated query keys are one query (the smallest vector). Fewer than k candidates: all. Components beyond
    the range of long are held to it. Empty tables give empty results.
    """
    good = vectors.where(F.col(key).isNotNull() & usable(F.col(vec))).select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"), is_query.alias("is_query"))
    n = good.count()
    shards = max(1, math.ceil(n / shard_rows))
    queries = good.where("is_query").groupBy("id").agg(F.min("vec").alias("vec"))
    tiles = queries.mapInArrow(_pack(scale, TILE_ROWS), "ids binary, matrix binary, width int")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    none = F.lit(None)
    asked = tiles.select(every, F.lit(1).alias("kind"), none.cast("long").alias("id"), none.cast("binary").alias("vec"), "ids", "matrix", "width")
    dealt = good.select(F.pmod(F.xxhash64("id", "vec"), F.lit(shards)).cast("int").alias("shard"), "id", "vec").mapInArrow(_scaled(scale), "shard int, id long, vec binary")
    offered = dealt.select("shard", F.lit(0).alias("kind"), "id", "vec", none.cast("binary").alias("ids"), none.cast("binary").alias("matrix"), none.cast("int").alias("width"))
    met = offered.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    lists = met.mapInArrow(_search(k), "query_id long, shard long, id long, score long")
    while shards > 1:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN))
        shards = math.ceil(shards / FAN)
        order = Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "id")
        lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


