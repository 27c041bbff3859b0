"""SimHash near-duplicates: 64-bit fingerprints of word shingles, pigeonhole blocks, Hamming check, components.

Fingerprints are made distinct first, so copies cost one row. Two fingerprints that differ in at most ``d`` bits agree on at least ``b - d`` of ``b`` blocks; each
choice of agreeing blocks is a key. Buckets up to ``ROOM`` fingerprints are compared in a stream of numpy shifts that emits a spanning forest, never all pairs.
Larger buckets go to the next, finer split, of which the last leaves 12 free bits: no bucket there can exceed 4,096 distinct fingerprints, so the way is exact
and bounded for groups of any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components
from .flat import flat

SEED = 42
DISTANCE = 3
ROOM = 4096
#: Blocks of each split, from coarse to fine; all but ``DISTANCE`` of them must agree.
SPLITS = (5, 8, 16)


def fingerprint(text: bytes, shingle: int) -> int:
    """Bits set in over half the hashes of the shingles of a lower-cased text; zero without a word."""
    parts = text.lower().split()  # bytes: A-Z only, and blanks 0x20, 0x09 to 0x0D
    if not parts:
        return 0
    joined, n = b" ".join(parts), len(parts)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, seed=SEED)
    lengths = np.fromiter(map(len, parts), np.int64, n) + 1
    end = np.cumsum(lengths) - 1
    start = end - lengths + 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[s:e], seed=SEED) for s, e in zip(start[:n - shingle + 1].tolist(), end[shingle - 1:].tolist(), strict=True)], np.uint64, n - shingle + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((ones * 2 > len(h)).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(key, mark, fp): fp as a signed long with the fingerprint's bits, mark a hash of the text that tells rows with one key apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat(b.column(2))
            view = memoryview(data)
            fp = np.fromiter((fingerprint(bytes(view[i:j]), shingle) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)), np.uint64, len(off) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["key", "mark", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, mark long, fp long")


def _masks(blocks: int, distance: int) -> list[int]:
    """For each choice of blocks that agree: the mask of their bits."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    own = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(own[i] for i in some) for some in combinations(range(blocks), blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _keys(fps: DataFrame, blocks: int, distance: int) -> DataFrame:
    masks = F.array(*[F.lit(_signed(m)) for m in _masks(blocks, distance)])  # folded to one constant
    return fps.select("fp", F.posexplode(masks).alias("choice", "mask")).select("choice", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), "fp")


def _forest(choice, bits, fp, distance):
    """Edges of a spanning forest of the close pairs in each run of equal keys."""
    n = len(fp)
    run = np.concatenate([[True], (choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1])])
    last = np.append(np.flatnonzero(run)[1:], n)[np.cumsum(run) - 1]  # end of each row's run
    root = np.arange(n)
    live, step = np.arange(n), 1
    while len(live := live[live + step < last[live]]):
        a, b = live, live + step
        near = np.bitwise_count(fp[a] ^ fp[b]) <= distance
        a, b = a[near], b[near]
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (deeper := root[root]).tobytes() != root.tobytes():
                root = deeper
        step += 1
    tied = np.flatnonzero(root != np.arange(n))
    return fp[tied], fp[root[tied]]


def _close(keyed: DataFrame, distance: int) -> DataFrame:
    """(u, v) edges, and (fp, null) for the members of buckets over ROOM, which a finer split must compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows, big = 0, None  # big: the key of a bucket over ROOM while its rows go by

        def out(u, v):
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), v if isinstance(v, pa.Array) else pa.array(v.view(np.int64))], ["u", "v"])

        def pieces(table, final):
            """Edges of the runs that are complete; the rest is held back."""
            nonlocal big
            choice, bits, fp = table
            n = len(fp)
            tail = n if final else int(np.flatnonzero((choice != choice[-1]) | (bits != bits[-1]))[-1] + 1 if ((choice != choice[-1]) | (bits != bits[-1])).any() else 0)
            if big is not None:
                same = (choice == big[0]) & (bits == big[1])
                k = int(same.sum())  # sorted: these come first
                if k:
                    yield out(fp[:k], pa.nulls(k, pa.int64()))
                    choice, bits, fp, tail, n = choice[k:], bits[k:], fp[k:], max(0, tail - k), n - k
                if n:
                    big = None
            if not final and n - tail > ROOM:
                big = (choice[-1], bits[-1])
                yield out(fp[tail:], pa.nulls(n - tail, pa.int64()))
                n = tail
            if tail:
                c, b, f = choice[:tail], bits[:tail], fp[:tail]
                begin = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (b[1:] != b[:-1])]))
                size = np.repeat(np.diff(np.append(begin, tail)), np.diff(np.append(begin, tail)))
                if (over := size > ROOM).any():
                    yield out(f[over], pa.nulls(int(over.sum()), pa.int64()))
                small = (size > 1) & ~over
                if small.any():
                    yield out(*_forest(c[small], b[small], f[small], distance))
            held[:] = [np.stack([choice[tail:n].astype(np.uint64), bits[tail:n], fp[tail:n]])] if n > tail else []

        for b in batches:
            held.append(np.stack([np.asarray(b.column(0)).astype(np.uint64), np.asarray(b.column(1)).view(np.uint64), np.asarray(b.column(2)).view(np.uint64)]))
            rows = sum(x.shape[1] for x in held)
            if rows >= 1 << 16:
                yield from pieces(np.concatenate(held, axis=1), False)
        if held:
            yield from pieces(np.concatenate(held, axis=1), True)

    spread = keyed.repartition("choice", "bits").sortWithinPartitions("choice", "bits", "fp")
    return spread.select("choice", "bits", "fp").mapInArrow(run, "u long, v long")


def close_edges(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of distinct ``fp`` at ``distance`` or less."""
    edges = None
    for blocks in SPLITS:
        found = _close(_keys(fps, blocks, distance), distance)

        found = cut_lineage(found)
        links = found.where("v is not null")
        edges = links if edges is None else edges.unionByName(links)
        fps = found.where("v is null").select(F.col("u").alias("fp")).distinct()
        if fps.isEmpty():
            return edges
    raise AssertionError("a bucket of the finest split is over its bound")  # 3 blocks of 4 free bits: 4096 values


def _members(docs: DataFrame, key: str, text: str, shingle: int, distance: int) -> DataFrame:
    """(key, mark, fp, root, component_id) of each row; ``root`` is the smallest fingerprint of the component."""
    prints = cut_lineage(fingerprints(docs, key, text, shingle))
    nodes = prints.groupBy("fp").agg(F.min("key").alias("least"))
    tied = components(close_edges(nodes.select("fp"), distance)).join(nodes.withColumnRenamed("fp", "node"), "node")
    named = tied.join(tied.groupBy("component").agg(F.min("least").alias("component_id")), "component").select(
        F.col("node").alias("fp"), F.col("component").alias("root"), "component_id")
    whole = nodes.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(whole, "fp")


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = DISTANCE) -> DataFrame:
    """(key, fingerprint, component_id) of each row; ``component_id`` is the smallest key that links can reach.

    Null and empty texts have fingerprint zero, which links like any other. Rows with a null key have a fingerprint and belong to their component, but don't name
    it (a component of such rows only has a null id). Repeated rows are kept. An empty table gives an empty result.
    """
    return _members(docs, key, text, shingle, distance).select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest key. A row with a null key stays only where no row of its group has a key; of equal rows
    (key and text) one stays. The groups are reduced to (key, hash of the text) before they meet the texts.

    Fingerprints alone decide, so texts that share one dominant word can be one group; ``near_dedup.keep_one`` verifies every link on the whole texts."""
    first = F.min(F.struct(F.col("key").isNull().alias("blank"), "key", "mark")).alias("first")
    return only_heads(docs, _members(docs, key, text, shingle, distance).groupBy("root").agg(first), key, text)


def only_heads(docs: DataFrame, heads: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``docs`` that ``heads`` names in ``first``, a struct with key and mark; of equal rows one. Columns of any name ride along."""
    mark, own_key, own_mark = (unused(docs, n) for n in ("mark", "head_key", "head_mark"))
    heads = heads.select(F.col("first.key").alias(own_key), F.col("first.mark").alias(own_mark))
    marked = docs.withColumn(mark, F.xxhash64(text))
    kept = marked.join(heads, F.col(key).eqNullSafe(F.col(own_key)) & (F.col(mark) == F.col(own_mark)), "left_semi")
    if not marked.groupBy(key, mark).count().where("count > 1").isEmpty():  # narrow rows tell whether the texts have to move once more
        kept = kept.dropDuplicates([key, mark])
    return kept.select(*docs.columns)


def unused(df: DataFrame, name: str) -> str:
    """``name`` with an underscore, or as many more as it takes for a name that no column has."""
    taken, name = {c.lower() for c in df.columns}, f"_{name}"
    while name.lower() in taken:
        name = "_" + name
    return name
