"""Inference of missing labels: pattern evidence, books, transpositions, clusters, votes."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import squares as S
from . import boards as B
from .splits import exact_median
from .tables import dominant_label, enhance_tags, has_text


def primary_family(tag: Column) -> Column:
    """First part of the first tag; 'Unknown' without a tag."""
    first = F.substring_index(F.trim(F.coalesce(tag, F.lit(""))), " ", 1)
    return F.when(has_text(tag), F.substring_index(first, "_", 1)).otherwise("Unknown")


def variation(tag: Column) -> Column:
    """Rest of the first tag after its first part, '' without one."""
    first = F.substring_index(F.trim(F.coalesce(tag, F.lit(""))), " ", 1)
    return F.when(F.contains(first, F.lit("_")), F.substring(first, F.instr(first, "_") + 1, F.length(first))).otherwise("")


def two_part_family(tag: Column) -> Column:
    first = F.substring_index(F.trim(F.coalesce(tag, F.lit(""))), " ", 1)
    return F.when(has_text(tag), F.substring_index(first, "_", 2)).otherwise("Unknown")


# ---------------------------------------------------------------- pattern evidence

def pattern_mapping(patterns: DataFrame, labelled: DataFrame, key: str, least: int = 5, least_variation: int = 3, times: Column | None = None) -> DataFrame:
    """(pattern_id, family, variation): most frequent family per pattern with enough support, and inside it the most
    frequent variation if it occurs often enough. Ties by name. Counts are aggregated before any ranking. ``times``: how often a labelled row counts."""
    counts = patterns.join(labelled.select(key, "family", "variation", (F.lit(1) if times is None else times).cast("long").alias("_n")), key).groupBy(
        "pattern_id", "family", "variation").agg(F.sum("_n").alias("n"))
    fam = counts.groupBy("pattern_id", "family").agg(
        F.sum("n").alias("fn"), F.min(F.struct((-F.col("n")).alias("m"), F.col("variation").alias("v"))).alias("top"))
    best = fam.groupBy("pattern_id").agg(
        F.sum("fn").alias("support"), F.min(F.struct((-F.col("fn")).alias("m"), F.col("family").alias("f"), F.col("top").alias("top"))).alias("b"))
    return best.filter(F.col("support") >= least).select(
        "pattern_id", F.col("b.f").alias("family"), F.when(-F.col("b.top.m") >= least_variation, F.col("b.top.v")).otherwise("").alias("variation"))


def mapped_label(patterns: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Family and variation of the first pattern (by priority) that the mapping knows. One row per known pattern is broadcast."""
    hits = patterns.join(F.broadcast(mapping), "pattern_id")  # at most one row per listed pattern
    return hits.groupBy(key).agg(F.min_by(F.struct("family", "variation"), "priority").alias("b")).select(
        key, F.col("b.family").alias("eco_family"), F.col("b.variation").alias("eco_variation"))


def blend(model_label: Column, model_conf: Column, evidence: Column, evidence_conf: float = 0.8) -> tuple[Column, Column]:
    """Agreement adds 0.15 up to 0.95; a disagreeing evidence of higher confidence takes over."""
    known = has_text(evidence)
    agree = known & (model_label == evidence)
    take = known & ~agree & (F.lit(evidence_conf) > model_conf)
    return (F.when(take, evidence).otherwise(model_label),
            F.when(agree, F.least(F.lit(0.95), model_conf + 0.15)).when(take, F.lit(evidence_conf)).otherwise(model_conf))


def overall_confidence(family_conf: Column, variation_label: Column, variation_conf: Column) -> Column:
    return 0.7 * family_conf + F.when(has_text(variation_label), 0.3 * variation_conf).otherwise(0.0)


def joined_tag(family: Column, variation_label: Column) -> Column:
    return F.when(has_text(variation_label), F.concat(family, F.lit("_"), variation_label)).otherwise(family)


def assemble_predictions(rows: DataFrame, predictions: DataFrame, key: str, tag: str) -> DataFrame:
    """One prediction row per input row. Rows with an original tag keep it with confidence 1, split once at ':'."""
    j = rows.select(key, F.col(tag).alias("_t")).join(predictions, key, "left")
    own = has_text(F.col("_t"))
    colon = F.contains(F.col("_t"), F.lit(":"))
    fam = F.when(colon, F.trim(F.substring_index("_t", ":", 1))).otherwise(F.col("_t"))
    var = F.when(colon, F.trim(F.substring(F.col("_t"), F.instr(F.col("_t"), ":") + 1, F.length(F.col("_t"))))).otherwise("")
    return j.select(
        key,
        F.when(own, F.col("_t")).otherwise(F.coalesce("tag", F.lit(""))).alias("predicted_family"),
        F.when(own, 1.0).otherwise(F.coalesce("conf", F.lit(0.0))).alias("prediction_confidence"),
        F.when(own, fam).otherwise(F.coalesce("family", F.lit(""))).alias("family_only"),
        F.when(own, var).otherwise(F.coalesce("variation", F.lit(""))).alias("variation_only"),
        F.when(own, 1.0).otherwise(F.coalesce("family_conf", F.lit(0.0))).alias("family_confidence"),
        F.when(own, F.when(var != "", 1.0).otherwise(0.0)).otherwise(F.coalesce("variation_conf", F.lit(0.0))).alias("variation_confidence"))


def confidence_summary(predictions: DataFrame, conf: str, threshold: float = 0.7) -> DataFrame:
    high = F.count_if(F.col(conf) >= threshold)
    return predictions.agg(high.alias("high_confidence"), F.round(100 * high / F.greatest(F.count("*"), F.lit(1)), 6).alias("high_confidence_pct"),
                           F.round(F.avg(conf), 6).alias("avg_confidence"))


# ---------------------------------------------------------------- books

def merge_books(books: list[DataFrame], weight: str = "weight", on: str = "placement", tie: str = "line") -> DataFrame:
    """Heaviest entry per position over all books; ties go to the smallest ``tie`` value."""
    every = reduce(lambda a, b: a.unionByName(b), books)
    rest = [c for c in every.columns if c not in (on, weight, tie)]
    best = every.groupBy(on).agg(F.min(F.struct((-F.col(weight)).alias("w"), F.col(tie).alias("t"), *rest)).alias("b"))
    return best.select(on, (-F.col("b.w")).alias(weight), F.col("b.t").alias(tie), *[F.col("b")[c].alias(c) for c in rest])


def exact_book(rows: DataFrame, book: DataFrame, key: str, fen: str = "fen") -> DataFrame:
    """Book entry of the same placement, confidence 1. Spark broadcasts the book when its size allows."""
    at = rows.select(key, B.placement_key(F.col(fen)).alias("placement")).filter(F.col("placement") != "")
    return at.join(book, "placement").drop("placement").withColumn("confidence", F.lit(1.0))


def similar_book(rows: DataFrame, book: DataFrame, key: str, name: str = "name", least: float = 0.85) -> DataFrame:
    """Most similar book position with similarity above ``least``; ties by name. ``rows`` and ``book`` hold board sets.

    Exact blocking: with d differing squares allowed, the 64 squares are cut into d + 2 interleaved bands, and any
    qualifying pair is equal on at least two whole bands. So candidates come from an equality join on the contents of
    two bands together instead of all pairs, and none is missed; two bands hold enough squares that empty ones are rare.
    """
    differing = math.ceil(64 * (1 - least) - 1e-9) - 1
    bands = differing + 2
    of = [sum(1 << s for s in range(64) if s % bands == j) for j in range(bands)]
    masks = [S.constant(a | b) for a, b in combinations(of, 2)]

    def banded(df, prefix, keep):
        planes = df.select(*keep, *[c.alias(f"{prefix}p{k}") for k, c in enumerate(B.bit_planes())])
        keys = F.array(*[F.xxhash64(F.lit(j), *[S.common(F.col(f"{prefix}p{k}"), m) for k in range(4)]) for j, m in enumerate(masks)])
        return planes.select("*", F.explode(keys).alias("band"))

    pairs = banded(rows, "a_", [key]).join(banded(book, "b_", [F.col(name).alias("name")]), "band")
    scored = pairs.select(key, "name", B.differing_squares("a_", "b_").alias("d")).filter(F.col("d") <= differing)
    best = scored.groupBy(key).agg(F.min(F.struct("d", "name")).alias("b"))
    return best.select(key, F.col("b.name").alias("book_name"), (1 - F.col("b.d") / 64.0).alias("similarity"))


# ---------------------------------------------------------------- transpositions and clusters

def signature_labels(signatures: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Dominant label and its share per position signature. Labels that stand several times at a key are counted before they meet its signatures."""
    counted = labels.groupBy(key, label).agg(F.count("*").alias("_n"))
    return dominant_label(signatures.join(counted, key), "signature", label, F.col("_n"))


def transposed_labels(signatures: DataFrame, known: DataFrame, key: str, discount: float = 0.9) -> DataFrame:
    """Label of the deepest signature that is known, its share times the discount."""
    hits = signatures.join(known, "signature")
    return hits.groupBy(key).agg(F.max_by(F.struct("dominant", "share", "n"), "n").alias("b")).select(
        key, F.col("b.dominant").alias("transposition_opening"), (F.col("b.share") * discount).alias("transposition_confidence"))


def cluster_transfer(rows: DataFrame, profile: DataFrame, key: str, cluster: str, least: int = 5, share: float = 0.5) -> DataFrame:
    """Dominant label of the cluster for rows without a label, from clusters with enough labelled rows."""
    good = profile.filter((F.col("sample_size") >= least) & (F.col("share") >= share))
    return rows.join(good, cluster).select(
        key, F.col("dominant").alias("cluster_inferred_family"), F.col("share").alias("cluster_inference_confidence"))


# ---------------------------------------------------------------- votes

def weighted_vote(rows: DataFrame, key: str, methods: list[tuple[str, str]]) -> DataFrame:
    """Winner and share over (label, confidence) column pairs; ties by label. A row-local unpivot, then two aggregations
    of at most one row per method."""
    pairs = F.array(*[F.struct(F.col(a).alias("label"), F.col(c).cast("double").alias("conf")) for a, c in methods])
    votes = rows.select(key, F.explode(pairs).alias("v")).select(key, "v.*").filter((F.coalesce("label", F.lit("")) != "") & (F.col("conf") > 0))
    summed = votes.groupBy(key, "label").agg(F.sum("conf").alias("w"))
    return summed.groupBy(key).agg(F.min(F.struct((-F.col("w")).alias("m"), F.col("label").alias("l"))).alias("b"), F.sum("w").alias("t")).select(
        key, F.col("b.l").alias("ensemble_family"), (-F.col("b.m") / F.col("t")).alias("ensemble_confidence"))


def write_back(rows: DataFrame, votes: DataFrame, key: str, tag: str, least: float = 0.6) -> DataFrame:
    """Votes with a large enough share fill missing tags."""
    j = rows.join(votes, key, "left")
    take = ~has_text(F.col(tag)) & (F.coalesce("ensemble_confidence", F.lit(0.0)) >= least)
    return j.withColumns({tag: F.when(take, F.col("ensemble_family")).otherwise(F.col(tag)), "has_inferred_tags": take.cast("int")})


def book_or_model(rows: DataFrame, model: DataFrame, book: DataFrame, key: str, tag: str, threshold: float = 0.7) -> DataFrame:
    """Missing tags from the model, or from the book where it is more confident, with the method in the marker."""
    j = rows.join(model.select(key, F.col("label").alias("_ml"), F.col("conf").alias("_mc")), key, "left").join(
        book.select(key, F.col("label").alias("_bl"), F.col("conf").alias("_bc")), key, "left")
    mc, bc = F.coalesce("_mc", F.lit(0.0)), F.coalesce("_bc", F.lit(0.0))
    use_book = (bc > 0) & ((bc > mc) | (mc == 0))
    free = ~has_text(F.col(tag))
    method = F.when(~free, "").when(use_book, "book").when(mc > 0, "ml").otherwise("")
    out = j.withColumns({
        "prediction_method": method,
        "predicted_opening": F.when(method == "book", F.col("_bl")).when(method == "ml", F.col("_ml")).otherwise(""),
        "prediction_confidence": F.when(method == "book", bc).when(method == "ml", mc).otherwise(0.0)})
    return out.withColumn(tag, enhance_tags(F.col(tag), F.col("predicted_opening"), F.col("prediction_confidence"),
                                            F.col("prediction_method"), threshold)).drop("_ml", "_mc", "_bl", "_bc")


def engine_summary(df: DataFrame, capture: Column, check: Column, promotion: Column, depth: Column, score: Column, error: Column) -> DataFrame:
    """Shares of move kinds, mean depth, median score and errors of an engine result table."""
    pct = lambda c: F.round(F.avg(c.cast("int")) * 100, 6)
    return df.agg(F.count("*").alias("rows"), pct(capture).alias("capture_pct"), pct(check).alias("check_pct"), pct(promotion).alias("promotion_pct"),
                  F.round(F.avg(depth), 6).alias("mean_depth"), F.count_if(error).alias("errors")).withColumn(
        "median_score", F.round(exact_median(df.select(score.alias("score")), "score").scalar(), 6))
