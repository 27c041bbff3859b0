"""A corpus pipeline of five stages, each one operator of ``squareframe.llm`` over all rows that the stage before it kept.

Stages take and give the columns of ``documents``; the last gives token ids. Extra columns ride along. Nulls, empty texts, repeated rows and empty tables have the
results that the operators state.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squareframe.llm import mixing, near_dedup, quality_bayes, queries, sentencepiece_codec, suffix_dedup
from squareframe.session import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (text, source and language together) rejects go. The model is fitted on the labelled rows of ``docs``.

    The columns travel under other names, so one that is called like a result of the classifier stays as it is.
    """
    own = {c: f"_own_{c}" for c in docs.columns}
    judged = quality_bayes.hierarchical_quality(docs.withColumnsRenamed(own), queries.quality_model(spark, sf_dir, docs), own["text"], own["source"], own["lang"])
    return judged.where("kept").select(*[F.col(new).alias(c) for c, new in own.items()])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by similarity of five-word shingles of 0.8 and more, the smallest doc_id stays. SimHash proposes the first links."""
    return near_dedup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes and more that also start earlier go; every document stays with the rest of its text."""
    return suffix_dedup.dedup(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or more."""
    return mixing.mixed_rows(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether decoding gives the text back."""
    path = public_tokenizers.path(queries.PIECES)
    marked = docs.withColumn("text_md5", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    coded = sentencepiece_codec.encode_pieces(marked, path, "text", "decoded_md5", remember=False)
    return coded.withColumn("decodes", F.col("decoded_md5") == F.col("text_md5")).drop("decoded_md5", "text_md5")


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", pieces),
]

#: Five stages share the memory of one executor: rows that go to Python at a time, and bytes that a task holds before it writes them.
BATCH, ROWS_IN_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"
ROW_GROUP_BYTES = 32 << 20
#: Shuffle files go when the step that wrote them ends: steps are cut by checkpoints, so no later one reads them, and many steps would otherwise keep theirs on disk.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: A fitted model, hashes with rotations, and merges of pieces have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus_pipeline/{uuid.uuid4().hex}"
    before = {BATCH: spark.conf.get(BATCH), CLEANUP: spark.conf.get(CLEANUP, "false")}
    spark.conf.set(BATCH, ROWS_IN_BATCH)
    spark.conf.set(CLEANUP, "true")
    try:
        for n, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{folder}/{n}")
            docs = spark.read.parquet(f"{folder}/{n}")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return docs
