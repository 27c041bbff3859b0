"""Quality classifier by hierarchical empirical Bayes: evidence of the text, of its site and of its path, sparse groups shrunk toward the level above.

1. A calibrated logistic regression on hashed n-grams gives each text a probability p.
2. Grouped sums of p give the mean of each site and each (site, path). The strength of each prior comes from the spread of the group means (method of moments).
3. A site's mean is shrunk toward the global mean, a path's mean toward its site. The document itself is left out of the groups it is judged by, so a site with one
   document says nothing about it.
4. Log-odds of the document plus the log-odds of its path against the global mean decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .flat import give_back
from .hashed_lr import Model

KEEP_FROM = 0.5
#: Groups that are broadcast at most: six numbers and two names each, a few megabytes.
SMALL = 20_000
_OWN = "_llm_p"


def with_probability(docs: DataFrame, model: Model, text: str, name: str = _OWN) -> DataFrame:
    """``docs`` with the classifier's probability of each whole text; null counts as an empty text."""
    names = [c for c in docs.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = 1 / (1 + np.exp(-np.clip(model.logit(b.column(text)), -12, 12)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(p)], [*names, name])
        give_back()

    return docs.select(*names).mapInArrow(run, docs.select(*names).schema.add(name, "double"))


def _logit(p):
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean, prior) -> float:
    """Beta prior's strength: prior variance over the variance of group means beyond what sampling explains, from one row of sums; large where groups agree."""
    r = groups.where("n >= 2").agg(
        F.count("*").alias("g"), F.avg((mean - prior) ** 2).alias("between"),
        F.avg(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)) / F.col("n")).alias("within"), F.avg(prior * (1 - prior)).alias("spread")).first()
    if not r.g or r.spread is None:
        return 1000.0
    return float(np.clip(r.spread / max(r.between - r.within, 1e-9) - 1, 1.0, 1000.0))


def hierarchical_quality(docs: DataFrame, model: Model, text: str = "text", site: str = "source", path: str = "lang", threshold: float = KEEP_FROM, with_text: bool = True) -> DataFrame:
    """``docs`` with ``text_quality``, ``site_quality``, ``path_quality``, ``quality`` and ``kept``; without the text column, if so asked.

    ``site`` and ``path`` name any two columns, the second finer than the first: host and first part of a url's path, or source and language. Null sites and paths are
    groups of their own. Ties with the threshold are kept. An empty table gives an empty result. Columns of the new names are replaced. Texts are read whole, a slice
    at a time. Groups are summed before they are shuffled, so a site that holds a third of all rows is a row per task. Up to ``SMALL`` groups are broadcast to the rows,
    more are joined by shuffling. Without the text, rows are scored once and written narrow; with it they are scored once for the groups and once for the result,
    which moves no text.
    """
    new = ["text_quality", "site_quality", "path_quality", "quality", "kept"]
    docs = docs.drop(*new, _OWN)
    if with_text:
        rows = with_probability(docs, model, text)
        scored = with_probability(docs.select(F.col(site).alias("site"), F.col(path).alias("path"), F.col(text).alias("text")), model, "text").drop("text")
    else:
        rows = cut_lineage(with_probability(docs, model, text).drop(text))
        scored = rows.select(F.col(site).alias("site"), F.col(path).alias("path"), _OWN)
    paths = scored.groupBy("site", "path").agg(F.count("*").alias("n"), F.sum(_OWN).alias("s"), F.sum(F.col(_OWN) ** 2).alias("ss"))
    paths = cut_lineage(paths)  # one row per group
    sites = paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("groups")).first()
    m0 = float(np.clip((total.s + 1) / (total.n + 2), 1e-6, 1 - 1e-6)) if total.n else 0.5
    k_site = _strength(sites, F.col("s") / F.col("n"), F.lit(m0))
    site_mean = (F.lit(k_site * m0) + F.col("site_s")) / (F.lit(k_site) + F.col("site_n"))
    both = paths.join(sites.select(F.col("site").alias("_site"), F.col("n").alias("site_n"), F.col("s").alias("site_s")), F.col("site").eqNullSafe(F.col("_site"))).drop("_site")
    k_path = _strength(both, F.col("s") / F.col("n"), site_mean)
    mine = {c: f"_llm_{c}" for c in ("site", "path", "n", "s", "site_n", "site_s")}
    both = both.select(*[F.col(c).alias(own) for c, own in mine.items()])
    if total.groups <= SMALL:
        both = F.broadcast(both)
    p, g = F.col(_OWN), {c: F.col(own) for c, own in mine.items()}
    joined = rows.join(both, F.col(site).eqNullSafe(g["site"]) & F.col(path).eqNullSafe(g["path"]))
    own_site = (F.lit(k_site * m0) + g["site_s"] - p) / (F.lit(k_site) + g["site_n"] - 1)
    own_path = (F.lit(k_path) * F.col("site_quality") + g["s"] - p) / (F.lit(k_path) + g["n"] - 1)
    clipped = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
    odds = _logit(p) + _logit(F.col("path_quality")) - F.lit(float(np.log(m0 / (1 - m0))))
    return (joined.withColumn("text_quality", p).withColumn("site_quality", clipped(own_site)).withColumn("path_quality", clipped(own_path))
            .withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("kept", F.col("quality") >= threshold).drop(_OWN, *mine.values()))
