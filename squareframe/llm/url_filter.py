"""URL filter: listed rules first, then logistic regression on hashed character n-grams of host and path, trained from a small labelled table of URLs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashed_lr import Model, fit

BLOCK_FROM = 0.5
#: Labelled URLs of each class that the fit reads at most.
SAMPLE_URLS = 2000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?``, ``#`` or the end. Both empty without ``://`` or for null."""
    found = F.locate("://", url)
    rest = F.when(found > 0, F.expr("substring(_url, locate('://', _url) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one; of equally long rules the first listed. ``rules``: a short list of (verdict, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, r in sorted(reversed(rules), key=lambda x: len(x[1])):  # a later one overrides
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def parsed(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and listed (the rule's verdict or null). Columns of these names are replaced."""
    out = pages.drop("host", "path", "rule", "listed").withColumn("_url", F.coalesce(F.col(url), F.lit("")))
    host, path = host_and_path(F.col("_url"))
    out = out.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return out.withColumn("rule", rule).withColumn("listed", verdict).drop("_url")


def spelled() -> Column:
    """What the model reads: host and path with marks at both ends, so that n-grams tell where they stand."""
    return F.concat(F.lit("^"), F.col("host"), F.lit("/"), F.col("path"), F.lit("$"))


def train(labelled: DataFrame, key: str = "page_id") -> Model:
    """A model of blocked URLs from rows with host, path and ``listed`` (block or allow)."""
    rows = labelled.where("listed is not null").select(F.col(key), spelled().alias("_spelled"), (F.col("listed") == "block").cast("int").alias("_y"))
    return fit(rows, key, "_spelled", F.col("_y"), sample_rows=SAMPLE_URLS, with_words=False)


def url_filter(pages: DataFrame, model: Model, rules: list[tuple[str, str]], url: str = "url", threshold: float = BLOCK_FROM) -> DataFrame:
    """``pages`` with host, path, rule, blocked (probability) and verdict: the longest rule's, else block where the probability is ``threshold`` or more.

    A null URL, or one without ``://``, has empty host and path and is judged by the model. Repeated rows are judged alike; empty tables give empty results.
    """
    rows = parsed(pages, rules, url).drop("blocked", "verdict")
    rows = rows.withColumn("_spelled", spelled())
    names = [c for c in rows.columns if c != "_spelled"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = 1 / (1 + np.exp(-np.clip(model.logit(b.column("_spelled")), -40, 40)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(p)], [*names, "blocked"])

    judged = rows.mapInArrow(run, rows.select(*names).schema.add("blocked", "double"))
    verdict = F.coalesce(F.col("listed"), F.when(F.col("blocked") >= threshold, "block").otherwise("allow"))
    return judged.withColumn("verdict", verdict).drop("listed")
