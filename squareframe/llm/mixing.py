"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree.

Every document of a source should be taken f = target / size of the source times. Its whole part is sure; the fraction is a chance. Blocks of documents of one
source pair their fractions: a pair moves words from one to the other, in a random direction whose odds keep every chance as it was, until one of the two is a
whole number. So the words taken never change within a pair. What a block can't settle (one survivor and a small ladder of documents of all sizes) goes up to the
next level, ``FAN`` blocks at a time; the root rounds the ladder from large to small, so that the words taken end next to the target.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.splits import with_global_rank
from ..session import cut_lineage
from .simhash import unused

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK_ROWS = 8192
FAN = 64
LADDER = 2
_EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), any number of sources.

    Weights repeat over the sources by code point, null last. The excess of sources at their limit is dealt again by weight until none is above; each round is
    one sum over the table.
    """
    ranked = with_global_rank(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_n")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    table = cut_lineage(ranked.select("source", "source_size", w.alias("w"), (F.col("source_size") * most).alias("limit")))
    wanted = share * float(table.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    for _ in range(10_000):
        r = table.agg(F.sum(F.when(F.col("limit") <= F.col("w") * level, F.col("limit")).otherwise(0.0)), F.sum(F.when(F.col("limit") > F.col("w") * level, F.col("w")).otherwise(0.0))).first()
        if not r[1]:
            break
        nxt = (wanted - (r[0] or 0.0)) / r[1]
        if nxt <= level * (1 + 1e-12):
            break
        level = nxt
    return table.select("source", "source_size", F.least(F.col("limit"), F.col("w") * F.lit(level)).alias("target"))


def _pivot(frac: list[float], size: list[int], dice: np.random.Generator) -> tuple[list[float], int | None]:
    """Settle all but one of the fractions, in order; the words sum(frac * size) stay the same. Returns the fractions and the survivor."""
    held = None
    for j in range(len(frac)):
        if frac[j] < _EPS or frac[j] > 1 - _EPS:
            frac[j] = float(round(frac[j]))
            continue
        if held is None:
            held = j
            continue
        i = held
        up = min((1 - frac[i]) * size[i], frac[j] * size[j])  # words that i can take from j
        down = min(frac[i] * size[i], (1 - frac[j]) * size[j])
        moved = up if dice.random() * (up + down) < down else -down
        frac[i] += moved / size[i]
        frac[j] -= moved / size[j]
        for x in (i, j):
            if frac[x] < _EPS or frac[x] > 1 - _EPS:
                frac[x] = float(round(frac[x]))
        open_ = [x for x in (i, j) if 0 < frac[x] < 1]
        held = open_[0] if open_ else None
    return frac, held


def _settle(u: dict[str, np.ndarray], last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Fractions after this node, and which rows go up. ``u``: size, frac and h (a random hash) of the units of one source."""
    n = len(u["size"])
    order = np.lexsort((u["h"], -u["size"]))
    size, frac = u["size"][order], u["frac"][order].astype(float)
    step = np.floor(np.log2(np.maximum(size, 1))).astype(int)
    ladder = np.zeros(n, bool)
    for s in np.unique(step):
        of = np.flatnonzero((step == s) & (frac > _EPS) & (frac < 1 - _EPS))
        ladder[of[np.argsort(u["h"][order][of], kind="stable")[:LADDER]]] = True
    rest = np.flatnonzero(~ladder)
    dice = np.random.default_rng(np.abs(np.bitwise_xor.reduce(u["h"])) if n else 0)
    got, held = _pivot(frac[rest].tolist(), size[rest].tolist(), dice)
    frac[rest] = got
    up = ladder.copy()
    if held is not None:
        up[rest[held]] = True
    if last:
        error, rows = 0.0, np.flatnonzero(up)  # from large to small
        lower, upper = frac[rows] * size[rows], (frac[rows] - 1) * size[rows]  # words missing, or too many, after rounding down or up
        least, most = -(lower.sum() - np.cumsum(lower)), -(upper.sum() - np.cumsum(upper))  # errors that the smaller ones can still make good
        for r, i in enumerate(rows):
            down, over = error + lower[r], error + upper[r]
            beyond = lambda e, r=r: (max(least[r] - e, e - most[r], 0.0), abs(e))
            frac[i], error = (0.0, down) if beyond(down) <= beyond(over) else (1.0, over)
        up[:] = False
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return frac[back], up[back]


def _level(units: DataFrame, last_of: str) -> DataFrame:
    """One level of the tree: every (source, block) settles its units; ``up`` marks those that go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def node():
            t = pa.Table.from_batches(held).combine_chunks()
            u = {c: t[c].to_numpy() for c in ("size", "frac", "h")}
            frac, up = _settle(u, bool(t[last_of][0].as_py()))
            out = t.set_column(t.column_names.index("frac"), "frac", pa.array(frac)).set_column(t.column_names.index("up"), "up", pa.array(up))
            held.clear()
            return out.to_batches()

        for b in batches:
            g, k = b.column("group").to_numpy(), b.column("block").to_numpy()
            cuts = np.flatnonzero((g[1:] != g[:-1]) | (k[1:] != k[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, len(g)], strict=True):
                now = (g[i], k[i])
                if held and now != key:
                    yield from node()
                key = now
                held.append(b.slice(i, j - i))
        if held:
            yield from node()

    sorted_ = units.repartition("group", "block").sortWithinPartitions("group", "block", "h")
    return sorted_.mapInArrow(run, units.schema)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(key, size, source, source_size, target, mark, copies, taken) of each row; ``copies`` is a whole number up to ``most`` rounded up.

    Null texts and texts without a word have size 0 and are never taken. Null sources are one source, the last. Repeated rows are rows of their own. An empty table
    gives an empty result. Chances come from hashes of the rows: runs agree. ``mark`` is a hash of the text that tells rows with one key apart.
    """
    rows = docs.select(F.col(key).alias("key"), word_count(F.col(text)).alias("size"), F.col(source).cast("string").alias("source"), F.xxhash64(text).alias("mark"))
    rows = cut_lineage(rows)
    facts = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    facts = cut_lineage(targets(facts.select("source", "source_size"), weights, share, most).join(
        facts.select(F.col("source").alias("_s"), "_rows"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    wide = rows.withColumnRenamed("source", "_src").join(facts, F.col("_src").eqNullSafe(F.col("source"))).drop("_src")
    times = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(0.0)
    h = F.xxhash64(F.lit("pivot"), "key", "mark", "source", "size")
    units = wide.withColumn("_f", F.when(F.col("size") > 0, times).otherwise(0.0)).select(
        "key", "size", "source", "source_size", "target", "mark", F.floor("_f").alias("whole"), (F.col("_f") - F.floor("_f")).alias("frac"), h.alias("h"),
        F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("group"),
        F.ceil(F.col("_rows") / BLOCK_ROWS).cast("long").alias("blocks"), F.lit(False).alias("up"))
    units = units.withColumn("block", F.pmod("h", F.col("blocks"))).withColumn("root", F.col("blocks") == 1)
    deepest, level = int(facts.agg(F.max(F.ceil(F.col("_rows") / BLOCK_ROWS))).first()[0] or 1), 0
    done = None
    while True:
        got = cut_lineage(_level(units, "root"))
        settled = got.where(~F.col("up"))
        done = settled if done is None else done.unionByName(settled)
        if deepest <= 1:
            break
        deepest, level = math.ceil(deepest / FAN), level + 1
        units = got.where("up").withColumn("up", F.lit(False)).withColumn("block", F.floor(F.col("block") / FAN)).withColumn("blocks", F.ceil(F.col("blocks") / FAN)).withColumn("root", F.col("blocks") == 1)
    out = done.withColumn("copies", (F.col("whole") + F.round("frac")).cast("long"))
    return out.select(F.col("key").alias(key), "size", "source", "source_size", "target", "mark", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it. Rows equal in key, text and source share the sum of their copies in near equal parts. Columns of any name
    ride along: those made here have names that no column has."""
    k, mark, s, copies, twins, m, t, own, n = (unused(docs, x) for x in ("key", "mark", "source", "copies", "twins", "own_mark", "own_source", "own", "copy"))
    plan = mix(docs.select(key, text, source), key, text, source).groupBy(F.col(key).alias(k), F.col("mark").alias(mark), F.col("source").alias(s)).agg(
        F.sum("copies").alias(copies), F.count("*").alias(twins)).where(F.col(copies) > 0)
    plan = cut_lineage(plan)
    rows = docs.withColumn(m, F.xxhash64(text)).withColumn(t, F.col(source).cast("string"))
    same = F.col(key).eqNullSafe(F.col(k)) & (F.col(m) == F.col(mark)) & F.col(t).eqNullSafe(F.col(s))
    single = rows.join(plan.where(F.col(twins) == 1), same).withColumn(own, F.col(copies))
    order = Window.partitionBy(k, mark, s).orderBy(F.xxhash64(*docs.columns))
    several = rows.join(plan.where(F.col(twins) > 1), same).withColumn(own, F.floor((F.col(copies) + F.col(twins) - F.row_number().over(order)) / F.col(twins)))
    taken = single.unionByName(several).where(F.col(own) > 0)
    return taken.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(own).cast("int")))).select(*docs.columns)
