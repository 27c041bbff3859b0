"""Term statistics and text vectors: TF-IDF in long form, hashed features, SVD, topics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, written
from .tags import token_rows, vocabulary


def tf_idf(df: DataFrame, key: str, text: Column, least: int = 1, most: int | None = None) -> DataFrame:
    """(key, token, weight): tf times smooth idf, each row scaled to length 1.

    Keys are dealt to as many parts as there are shuffle partitions. Texts are spread by part and split once; a part writes its tokens as lists of keys and counts, which meet
    the document frequencies and go back to their part as lists, so that a token is moved once per part and not once per text. In the join the long side is neither sorted nor held:
    tasks hold their share of the vocabulary (one row per token). Norms are sums over a key's rows within its part; a list is at most as long as its part has keys.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(_part_of(df, key, parts).alias("_part"), F.col(key).alias("_key"), text.alias("_text")).repartition(parts, "_part")
    rows = token_rows(dealt, ("_part", "_key"), F.col("_text"))
    counts = rows.groupBy("_part", "_key", "token").agg(F.count("*").alias("tf"))
    lists = counts.groupBy("_part", "token").agg(F.collect_list(F.struct("_key", "tf")).alias("l"), F.sum("tf").alias("n"))
    lists = written(lists.select("_part", "token", "n", F.col("l._key").alias("keys"), F.col("l.tf").alias("tfs")), "term_lists")
    vocab = lists.groupBy("token").agg(F.sum(F.size("keys")).alias("df"), F.sum("n").alias("n")).filter(F.col("df") >= least)
    if most is not None:
        vocab = vocab.orderBy(F.desc("n"), F.asc("token")).limit(most)
    n_docs = df.agg(F.count("*")).scalar()
    idf = vocab.select("token", (F.log((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))
    back = written(lists.drop("n").join(idf.hint("shuffle_hash"), "token"), "term_lists")  # the files of this exchange go before those of the next are written
    each = back.repartition(parts, "_part").select("_part", "token", "idf", F.explode(F.arrays_zip("keys", "tfs")).alias("d"))
    weighted = each.select("_part", F.col("d.keys").alias(key), "token", (F.col("d.tfs") * F.col("idf")).alias("w")).where(F.col(key).isNotNull())
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("_part", key)))
    return weighted.select(key, "token", (F.col("w") / norm).alias("weight"))


def _part_of(df: DataFrame, key: str, parts: int) -> Column:
    """A number for each key, of as many as ``parts``, which Spark's exchange sends to different tasks: those of its first numbers that it sends to each."""
    at = df.sparkSession.range(32 * parts).select(F.col("id").cast("int").alias("i")).groupBy(F.pmod(F.hash("i"), F.lit(parts))).agg(F.min("i").alias("i"))
    numbers = sorted(r.i for r in at.collect())
    return F.element_at(F.array(*[F.lit(i) for i in numbers]), (F.pmod(F.xxhash64(key), F.lit(len(numbers))) + 1).cast("int"))


def hash_bucket(token: Column, buckets: int) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def hashed_features(df: DataFrame, key: str, text: Column, buckets: int = 15) -> DataFrame:
    """(key, hash_0 .. hash_{n-1}): token counts per bucket without sign, scaled to length 1. Row-local: no shuffle."""
    toks = F.transform(_tokens(F.lower(text)), lambda t: hash_bucket(t, buckets))
    rows = df.select(key, F.explode(F.array(F.struct(toks.alias("b")))).alias("s")).select(key, "s.b")
    counts = rows.select(key, F.transform(F.array(*[F.lit(i) for i in range(buckets)]),
                                          lambda i: F.size(F.filter(F.col("b"), lambda x: x == i)).cast("double")).alias("c"))
    normed = counts.withColumn("len", F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x)))
    return normed.select(key, *[F.coalesce(F.get("c", F.lit(i)) / F.nullif(F.col("len"), F.lit(0.0)), F.lit(0.0)).alias(f"hash_{i}")
                                for i in range(buckets)])


def _tokens(text: Column) -> Column:
    from .moves import tokens

    return tokens(text)


def _listed_terms(rows: DataFrame, least: int, most: int) -> list:
    """(term, rows that hold it) of the ``most`` frequent terms of ``rows`` (tokens, _n) that ``least`` rows hold; a row counts ``_n`` times. One job, bounded by ``most``."""
    every = rows.select(F.explode("tokens").alias("t"), F.col("_n").alias("n"), F.lit(0).cast("long").alias("df"))
    once = rows.select(F.explode(F.array_distinct("tokens")).alias("t"), F.lit(0).cast("long").alias("n"), F.col("_n").alias("df"))
    terms = every.unionByName(once).groupBy("t").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).where(F.col("df") >= least)
    return terms.orderBy(F.desc("n"), "t").limit(most).collect()


def _token_rows(df: DataFrame, key: str, text: Column, weight: str | None) -> DataFrame:
    return df.select(key, _tokens(F.lower(text)).alias("tokens"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_n"))


def term_vectors(df: DataFrame, key: str, text: Column, least: int = 2, most: int = 1000, weight: str | None = None):
    """TF-IDF vectors over a bounded vocabulary, by the ML stages that keep everything distributed; None and no vectors without a listed term.

    ``weight`` names a column that tells how often a row counts in the vocabulary and the frequencies.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    rows = _token_rows(df, key, text, weight)
    listed = _listed_terms(rows, least, most)
    if not listed:
        return None, None
    total = df.agg(F.sum(F.col(weight)) if weight else F.count("*")).first()[0]
    idf = Vectors.dense([math.log((total + 1) / (r.df + 1)) for r in listed])
    model = PipelineModel([
        CountVectorizerModel.from_vocabulary([r.t for r in listed], inputCol="tokens", outputCol="tf"),
        ElementwiseProduct(scalingVec=idf, inputCol="tf", outputCol="idf"), Normalizer(inputCol="idf", outputCol="features")])
    return model, model.transform(rows)


#: Directions beyond those asked for, passes at most, and the relative change of singular values that ends them.
SVD_SPARE, SVD_PASSES, SVD_SETTLED = 10, 40, 1e-7


def truncated_svd(vectors: DataFrame, terms: int, k: int, features: str = "features", seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """:func:`truncated_svd_rows` of a vector column."""
    return truncated_svd_rows(cut_lineage(vectors.select(_sparse(features))), terms, k, seed)


def truncated_svd_rows(rows: DataFrame, terms: int, k: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, terms x k right vectors) of the matrix of sparse rows, not centred: a randomised range finder.

    A tall block of ``k + SVD_SPARE`` directions over the terms goes through the rows once per pass: each task multiplies its rows with the block and back, Spark adds the
    results by term, and a tall-skinny QR makes the block orthonormal again. Nothing of terms x terms is made; the block (terms x directions, bounded by the
    vocabulary's limit) is all that tasks and driver hold. Passes end when the values stand. Signs make each vector's largest entry positive.
    """
    size = min(k + SVD_SPARE, terms)
    block, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, size)))
    last = None
    for _ in range(SVD_PASSES):
        product = _there_and_back(rows, block)
        small = block.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        found = np.sqrt(np.maximum(values[::-1][:k], 0))
        if last is not None and np.abs(found - last).max() <= SVD_SETTLED * max(found.max(), 1e-300):
            break
        last = found
        block, _ = np.linalg.qr(product)
    right = (block @ turn[:, ::-1])[:, :k]
    lead = np.abs(right).argmax(axis=0)
    return found, right * np.sign(right[lead, np.arange(right.shape[1])])


def _sparse(features: str, scale: Column | None = None) -> Column:
    """Indices and values (times ``scale``) of a vector column as arrays."""
    v = F.unwrap_udt(features)
    every = F.when(F.size(v["values"]) > 0, F.sequence(F.lit(0), F.size(v["values"]) - 1)).otherwise(F.array().cast("array<int>"))
    return F.struct(F.when(v["type"] == 0, v["indices"]).otherwise(every).alias("i"), (v["values"] if scale is None else F.transform(v["values"], lambda x: x * scale)).alias("x")).alias("row")


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and value of each entry of a batch of sparse rows."""
    lists = batch.column(batch.num_columns - 1)
    index = lists.field("i")
    return np.repeat(np.arange(batch.num_rows), np.asarray(index.value_lengths())), np.asarray(index.flatten()), np.asarray(lists.field("x").flatten())


def _there_and_back(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """A' (A block): sums over the rows by task, then by term."""
    terms, size = block.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            at, index, value = _entries(b)
            if not len(index):
                continue
            total = np.zeros((terms, size)) if total is None else total
            for c in range(size):
                dots = np.bincount(at, weights=value * block[index, c], minlength=b.num_rows)
                total[:, c] += np.bincount(index, weights=value * dots[at], minlength=terms)
        if total is not None:
            used = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(total[used, c]) for c in range(size))], ["t", *(f"c{c}" for c in range(size))])

    sums = rows.mapInArrow(run, "t long, " + ", ".join(f"c{c} double" for c in range(size))).groupBy("t").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(size)]).toArrow()
    out = np.zeros(block.shape)
    if sums.num_rows:
        out[sums["t"].to_numpy()] = np.stack([sums[f"c{c}"].to_numpy() for c in range(size)], 1)
    return out


def svd_features(df: DataFrame, key: str, text: Column, k: int = 10, least: int = 2, most: int = 1000, weight: str | None = None) -> DataFrame:
    """(key, svd_0 .. svd_{k-1}): each text's TF-IDF vector in the ``k`` leading right singular directions, not centred; zeros beyond the rank or the number of terms.

    ``most`` bounds the vocabulary and with it the memory (``most`` x (k + 10) numbers); 100,000 terms are about 16 MB for k = 10. Repeated rows are kept; texts without
    a listed term have zeros. A row that stands for ``weight`` equal ones goes through the fit once, times the root of its weight.
    """
    model, vectors = term_vectors(df, key, text, least, most, weight)
    if model is None:
        return df.select(key, *[F.lit(0.0).alias(f"svd_{i}") for i in range(k)])
    terms = len(model.stages[0].vocabulary)
    scaled = [_sparse("features", F.sqrt("_n")).alias("scaled")] if weight else []
    rows = cut_lineage(vectors.select(key, *scaled, _sparse("features")))  # read once per pass
    _, right = truncated_svd_rows(rows.select("scaled" if weight else "row"), terms, min(k, terms))
    size = right.shape[1]
    names = [f"svd_{i}" for i in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, index, value = _entries(b)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.bincount(at, weights=value * right[index, c], minlength=b.num_rows)) for c in range(size))], [key, *names])

    fields = rows.select(key).schema
    for n in names:
        fields = fields.add(n, "double")
    return rows.mapInArrow(run, fields).select(key, *names, *[F.lit(0.0).alias(f"svd_{i}") for i in range(size, k)])


#: Copies of a row that stands for many, made by one task.
COPIES = 1000


def topic_features(df: DataFrame, key: str, text: Column, k: int = 8, most: int = 200, least: int = 2, seed: int = 42,
                   iterations: int = 10, weight: str | None = None) -> DataFrame:
    """(key, topic_0 .. topic_{k-1}, dominant_topic) from an LDA over the most frequent words.

    Texts are cut into terms once, and the fit reads those counts from the shared folder in each of its passes. A row that stands for ``weight`` equal ones
    is fitted as often and placed once.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizerModel
    from pyspark.ml.functions import vector_to_array

    rows = _token_rows(df, key, text, weight)
    listed = _listed_terms(rows, least, most)
    if not listed:
        return df.select(key, *[F.lit(1.0 / k).alias(f"topic_{i}") for i in range(k)], F.lit(0).alias("dominant_topic"))
    model = CountVectorizerModel.from_vocabulary([r.t for r in listed], inputCol="tokens", outputCol="features")
    counts = cut_lineage(model.transform(rows).select(key, "_n", "features"))
    fitted = counts.select("features")
    if weight:  # a text with very many copies is dealt to many tasks
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = counts.where("_n > 0").select("features", "_n", F.explode(F.expr(f"sequence(0L, (_n - 1) div {COPIES})")).alias("c")).repartition(parts)
        fitted = cut_lineage(dealt.select("features", F.explode(F.expr(f"sequence(1L, least({COPIES}L, _n - c * {COPIES}))")).alias("c")).select("features"))
    topics = LDA(k=k, seed=seed, maxIter=iterations).fit(fitted).transform(counts)
    a = vector_to_array("topicDistribution")
    return topics.select(key, *[F.get(a, F.lit(i)).alias(f"topic_{i}") for i in range(k)], argmax(a).alias("dominant_topic"))


def argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


__all__ = ["argmax", "hash_bucket", "hashed_features", "svd_features", "term_vectors", "tf_idf", "topic_features", "vocabulary"]
