"""One query per operator, with its production parameters, over whole tables. Results carry ids and digests; the operators keep their own outputs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from . import alignment, bpe_trie, hashed_lr, mixing, quality_bayes, quality_rules, sentencepiece_codec, sharding, simhash, suffix_dedup, token_files, topk, url_filter, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
BYTE_PAIRS = "byte_bpe_50k.json"
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def _register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_model(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> hashed_lr.Model:
    """The quality model of the labelled documents: 1 is good. Labels meet documents by id; only the hashed sample of both classes reaches the fit."""
    docs = documents if documents is not None else _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", "quality")
    return hashed_lr.fit(labels.join(docs.select("doc_id", "text"), "doc_id"), "doc_id", "text", F.col("quality"))


@_register("op1_exact_topk", """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
      from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 10""")
def op1(spark, sf_dir):
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@_register("op2_suffix_array_dedup")
def op2(spark, sf_dir):
    return suffix_dedup.removed_spans(_table(spark, sf_dir, "documents"))


@_register("op3_source_mixing")
def op3(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@_register("op4_token_files")
def op4(spark, sf_dir):
    folder = f"{shared_folder(spark)}/token_files/{uuid.uuid4().hex}"
    token_files.write_tokens(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER))
    index, digests = token_files.read_index(spark, folder), token_files.read_digests(spark, folder).drop("doc_id")
    return index.join(digests, ["file", "row"]).select("doc_id", "start", "n_tokens", "ids_crc32")


@_register("op5_sentencepiece")
def op5(spark, sf_dir):
    return sentencepiece_codec.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


@_register("op6_simhash")
def op6(spark, sf_dir):
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


@_register("op7_url_filter")
def op7(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.train(url_filter.parsed(pages, RULES))
    return url_filter.url_filter(pages, model, RULES).select("page_id", "host", "path", "rule", "verdict", "blocked")


@_register("op8_quality_rules")
def op8(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.quality_rules(docs, quality_model(spark, sf_dir))
    return judged.select("doc_id", *quality_rules.NAMES, "base_failed", "kept", "quality")


@_register("op9_sampled_sharding")
def op9(spark, sf_dir):
    placed = sharding.shard(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_register("op10_quality_bayes")
def op10(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality_bayes.hierarchical_quality(docs, quality_model(spark, sf_dir), with_text=False)


@_register("op11_tokenizer_alignment")
def op11(spark, sf_dir):
    return alignment.aligned(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_PAIRS), public_tokenizers.path(PIECES))


@_register("op12_feast_whitening")
def op12(spark, sf_dir):
    white = whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))


@_register("op13_bpe_trie")
def op13(spark, sf_dir):
    return bpe_trie.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_PAIRS))
