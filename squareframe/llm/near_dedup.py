"""Near-duplicates by exact similarity: SimHash proposes links, a prefix-filter join proposes all the others, and only what whole shingle sets confirm counts.

1. A node is a distinct set of word shingles, known by a 128-bit digest of the whole set, so copies cost one row. Similarity is shared shingles over all shingles of two
   sets (equality of 64-bit hashes). Nodes get a number; links are made and followed on numbers.
2. First links, linear in the nodes: SimHash's forest and stars of equal fingerprints or least hashes. Each link is verified on the whole sets; those that hold
   join nodes into groups, so that a large group of near copies is never compared with itself.
3. All other pairs: in any one order of the shingles, two sets of similarity ``LEAST`` and more share one of their first ``n - ceil(LEAST * n) + 1`` shingles. The
   order puts shingles last that are frequent in a sample of the nodes; the result doesn't depend on it. A node's first shingles cross the network once, dealt by shingle;
   those of shingles that two groups hold go on with the sketch of their node; sorted by size there, each meets only partners that can reach ``LEAST``. Pairs of
   different groups whose sketches allow it are verified too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components
from .flat import BASE, SECOND_BASE, SECOND_VALUE, Prefix, flat, give_back, mixed, slices, words
from .simhash import close_edges, fingerprint, only_heads

#: Similarity as a fraction, in whole numbers.
LEAST = (4, 5)
#: Least hashes of a node beside its fingerprint; nodes of which one stands in the sample for the order, and shingles that the order puts last at most.
STARS, SAMPLE, COMMON = 4, 16, 1 << 17
#: Bits of the map of nodes whose sets a join needs (the first bytes of their digests); others with the same bit come along and find no partner.
BITS = 24
#: Words of more bytes are hashed by xxhash: polynomials of words as long as this and regular can agree. Nodes that a task remembers, to give each once.
LONG_WORD, SEEN = 255, 1 << 17
#: Bytes of whole texts that are cut at a time.
SLICE = 1 << 18
#: Words of 64 bits of a node's sketch. A bit is the parity of the shingles that hash to it, so two sketches differ in no more bits than their sets in shingles.
SKETCH = 32
#: Rows that a task lets meet at a time (more where one shingle has more), and pairs whose sketches are compared at a time.
MET, SOME = 1 << 15, 1 << 13
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, off: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, ascending, and n + 1 offsets. A text of ``shingle`` words or fewer is one shingle, without a word it has none."""
    data = _LOWER[data]
    start, end, first = words(data, off)
    word = mixed(Prefix(data).hash(start, end)) + mixed(Prefix(data, SECOND_BASE, SECOND_VALUE).hash(start, end)) * np.uint64(SECOND_BASE)
    for k in np.flatnonzero(end - start > LONG_WORD).tolist():
        word[k] = xxhash.xxh64_intdigest(data[start[k]:end[k]].tobytes(), seed=1)
    many = np.diff(first)
    count = np.where(many > shingle, many - shingle + 1, np.minimum(many, 1))
    of = np.repeat(np.arange(len(many)), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][of]
    last = first[1:][of]
    h = np.zeros(len(of), np.uint64)
    for j in range(shingle):
        here = at + j < last
        h[here] = mixed(h[here] * np.uint64(BASE) + word[at[here] + j] + np.uint64(j + 1))
    o = np.lexsort((h, of))
    h, of = h[o], of[o]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.searchsorted(of[new], np.arange(len(many) + 1))


def _nodes(h: np.ndarray, off: np.ndarray) -> list[bytes]:
    """The digest of each set, of 16 bytes."""
    raw = memoryview(h.tobytes())
    return [xxhash.xxh3_128_digest(raw[8 * i:8 * j]) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def _prints(shingle: int):
    """(key, mark, text) to (key, mark, node, marks): fingerprint, least hashes, size of the set, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat(b.column(2))
            node, marks = [], []
            for i, j in slices(off, SLICE):
                h, o = shingle_sets(data[off[i]:off[j]], off[i:j + 1] - off[i], shingle)
                node += _nodes(h, o)
                own = np.zeros((j - i, STARS + 2 + SKETCH), np.int64)
                some = np.flatnonzero(np.diff(o))
                for k in range(STARS if len(some) else 0):
                    own[some, k + 1] = np.minimum.reduceat(mixed(h * np.uint64(2 * k + 3) + np.uint64(k)), o[some]).view(np.int64)
                sketch, at = np.zeros((j - i, SKETCH), np.uint64), mixed(h ^ np.uint64(SECOND_BASE)) & np.uint64(SKETCH * 64 - 1)
                np.bitwise_xor.at(sketch.reshape(-1), np.repeat(np.arange(j - i), np.diff(o)) * SKETCH + (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
                own[:, STARS + 1], own[:, STARS + 2:] = np.diff(o), sketch.view(np.int64)
                view = memoryview(data)
                own[:, 0] = np.fromiter((fingerprint(bytes(view[off[x]:off[x + 1]]), shingle) for x in range(i, j)), np.uint64, j - i).view(np.int64)
                marks.append(own)
            if not node:
                continue
            flat_marks = np.concatenate(marks)
            lists = pa.ListArray.from_arrays(np.arange(0, flat_marks.size + 1, STARS + 2 + SKETCH, dtype=np.int32), pa.array(flat_marks.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.binary()), lists], ["key", "mark", "node", "marks"])
        give_back()
    return run


def _each_node(shingle: int, make, names: list[str]):
    """Texts to what ``make`` yields for the sets of a slice, each node once in a task as far as it remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            data, off = flat(b.column(0))
            for i, j in slices(off, SLICE):
                h, o = shingle_sets(data[off[i]:off[j]], off[i:j + 1] - off[i], shingle)
                node = _nodes(h, o)
                if len(seen) > SEEN:
                    seen.clear()
                fresh = np.array([not (x in seen or seen.add(x)) for x in node], bool) & (np.diff(o) > 0)
                if fresh.any():
                    cols = make(h, o, node, fresh)
                    if len(cols[0]):
                        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names)
        seen.clear()
        give_back()
    return run


def _lead(node: list[bytes]) -> np.ndarray:
    """The first bytes of digests as numbers under 2**BITS."""
    return np.fromiter((int.from_bytes(x[:BITS // 8], "big") for x in node), np.int64, len(node))


def _sampled(h, o, node, fresh):
    return [h[np.repeat(fresh & (_lead(node) % SAMPLE == 0), np.diff(o))].view(np.int64)]


def _chosen(node: list[bytes], which: np.ndarray) -> pa.Array:
    return pa.array([x for x, w in zip(node, which.tolist(), strict=True) if w], pa.binary())


def _prefixes(common: np.ndarray, rank: np.ndarray):
    """(node, size of its set, its first shingles in order)."""

    def make(h, o, node, fresh):
        size = np.diff(o)
        of = np.repeat(np.arange(len(size)), size)
        late = np.zeros(len(h), np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, h), len(common) - 1)
            late = np.where(common[at] == h, rank[at], 0)
        order = np.lexsort((h, late, of))
        place = np.arange(len(h)) - o[:-1][of]
        many = np.where(fresh, size + 1 - -(-LEAST[0] * size // LEAST[1]), 0)
        first = place < many[of]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many[fresh])]).astype(np.int32)), pa.array(h[order][first].view(np.int64)))
        return [_chosen(node, fresh), size[fresh].astype(np.int32), lists]
    return make


def _needed(bits: np.ndarray):
    """Whole sets of the nodes whose bit is set. Eight bits stay in a byte: each worker holds the map."""

    def make(h, o, node, fresh):
        lead = _lead(node)
        fresh = fresh & (bits[lead >> 3] >> (lead & 7) & 1).astype(bool)
        size = np.diff(o)
        own = h[np.repeat(fresh, size)]
        ends = np.concatenate([[0], np.cumsum(size[fresh] * 8)]).astype(np.int32)
        return [_chosen(node, fresh), pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(own.tobytes())])]
    return make


def _holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, set of u, set of v) to the pairs that are similar enough."""
    for b in batches:
        good = np.zeros(b.num_rows, bool)
        for k, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            good[k] = both * LEAST[1] >= LEAST[0] * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), b.column(1).filter(pa.array(good))], ["u", "v"])
    give_back()


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` without those whose sketches differ in more bits than sets of similarity ``LEAST`` can differ in shingles."""
    t, w = LEAST
    x, y = nodes.select(F.col("nid").alias("u"), F.col("marks").alias("x")), nodes.select(F.col("nid").alias("v"), F.col("marks").alias("y"))
    apart = f"aggregate(zip_with(slice(x, {STARS + 3}, {SKETCH}), slice(y, {STARS + 3}, {SKETCH}), (a, b) -> bit_count(a ^ b)), 0, (a, b) -> a + b)"
    return cut_lineage(pairs.join(x, "u").join(y, "v").where(f"{w + t} * {apart} <= {w - t} * (x[{STARS + 1}] + y[{STARS + 1}])").select("u", "v"))


def _verified(texts: DataFrame, pairs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """The pairs (u, v) of numbers of nodes of similarity ``LEAST`` and more. Sets are cut from the texts again, those of nodes that stand in a pair."""
    names = nodes.select("nid", "node")
    named = pairs.join(names.toDF("u", "a"), "u").join(names.toDF("v", "b"), "v")
    named = cut_lineage(named)
    low = named.select(F.explode(F.array("a", "b")).alias("x")).select(F.conv(F.hex(F.substring("x", 1, BITS // 8)), 16, 10).cast("long").alias("x"))
    held = low.groupBy(F.shiftright("x", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("m")).toArrow()  # 2**18 rows at most
    table = np.zeros(1 << (BITS - 6), np.int64)
    table[held["w"].to_numpy()] = held["m"].to_numpy()
    sets = texts.mapInArrow(_each_node(shingle, _needed(table.view(np.uint8)), ["node", "shingles"]), "node binary, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    both = named.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return cut_lineage(both.select("u", "v", "x", "y").mapInArrow(_holds, "u long, v long"))


def _first_links(nodes: DataFrame) -> DataFrame:
    """(u, v): each node to that smallest node of its fingerprint or a least hash that most of them name, and the forest of close fingerprints."""
    keyed = nodes.select("nid", F.posexplode(F.slice("marks", 1, STARS + 1)).alias("i", "m"))
    least = keyed.groupBy("i", "m").agg(F.min("nid").alias("least"))
    votes = keyed.join(least, ["i", "m"]).where("nid != least").groupBy("nid", "least").count()
    stars = votes.groupBy(F.col("nid").alias("u")).agg(F.max_by("least", F.struct("count", "least")).alias("v"))
    heads = least.where("i = 0").select(F.col("m").alias("fp"), "least")
    near = close_edges(heads.select("fp")).join(heads.toDF("u", "a"), "u").join(heads.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return stars.unionByName(near).where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (s, n, nid, g, i, p, sketch) sorted by shingle and size to pairs of different groups that can be similar by their sizes, the places of the shingle and their
    sketches. Two nodes whose shingles before this one (p, at place i - 1) are equal too have met there."""
    t, w = LEAST
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def pairs(rows, sketch):
        s, n, nid, g, i, p = rows
        last = np.append(np.flatnonzero(s[1:] != s[:-1]) + 1, len(s))
        last = last[np.searchsorted(last, np.arange(len(s)), "right")]  # end of each row's run
        live, step, found = np.arange(len(s)), 1, []
        while len(live := live[live + step < last[live]]):
            live = live[w * n[live] >= t * n[live + step]]  # sizes rise in a run: none further on fits either
            a, b = live, live + step
            shared = np.minimum(i[a], i[b]) + np.minimum(n[a] - i[a], n[b] - i[b])  # at most, as the shingle stands at these places of both orders
            fits = (g[a] != g[b]) & ((t + w) * shared >= t * (n[a] + n[b])) & ~((i[a] > 0) & (i[b] > 0) & (p[a] == p[b]))
            a, b = a[fits], b[fits]
            if len(a):
                apart = np.concatenate([np.bitwise_count(sketch[a[k:k + SOME]] ^ sketch[b[k:k + SOME]]).sum(axis=1, dtype=np.int64) for k in range(0, len(a), SOME)])
                near = (w + t) * apart <= (w - t) * (n[a] + n[b])
                a, b = a[near], b[near]
            if len(a):
                found.append(np.stack([np.maximum(nid[a], nid[b]), np.minimum(nid[a], nid[b])], 1))
                if sum(map(len, found)) > 1 << 18:
                    yield np.unique(np.concatenate(found), axis=0)
                    found = []
            step += 1
        if found:
            yield np.unique(np.concatenate(found), axis=0)

    def joined():
        return np.concatenate([x for x, _ in held], axis=1), np.concatenate([x for _, x in held])

    def out(x):
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["u", "v"])

    for b in batches:
        sketch = np.asarray(b.column(6).flatten()).view(np.uint64).reshape(-1, SKETCH)
        held.append((np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(6)]), sketch))
        if sum(len(x) for _, x in held) >= MET:
            rows, sketch = joined()
            cut = int(np.searchsorted(rows[0], rows[0, -1]))  # the last shingle may go on
            held = [(rows[:, cut:], sketch[cut:])]
            if cut:
                yield from map(out, pairs(rows[:, :cut], sketch[:cut]))
    if held:
        yield from map(out, pairs(*joined()))


def _other_pairs(texts: DataFrame, nodes: DataFrame, groups: DataFrame, shingle: int) -> DataFrame:
    """(u, v): nodes of different groups that share a shingle of their prefixes and can be similar by their sizes, its places and their sketches.

    Sketches travel only with the rows of shingles that two groups hold.
    """
    counted = texts.mapInArrow(_each_node(shingle, _sampled, ["s"]), "s long").groupBy("s").count().where("count > 2")
    common = counted.orderBy(F.desc("count"), "s").limit(COMMON).toArrow()
    h = common["s"].to_numpy().view(np.uint64)
    o = np.argsort(h)
    make = _prefixes(h[o], common["count"].to_numpy()[o])
    own = texts.mapInArrow(_each_node(shingle, make, ["node", "n", "first"]), "node binary, n int, first array<long>").dropDuplicates(["node"])  # a node comes from every task that has it
    tied = nodes.select("node", "nid").join(groups.toDF("nid", "g"), "nid", "left").select("node", "nid", F.coalesce("g", "nid").alias("g"))
    rows = own.join(tied, "node").select("n", "nid", "g", "first", F.posexplode("first").alias("i", "s"))
    rows = rows.select("s", "n", "nid", "g", "i", F.coalesce(F.get("first", F.col("i") - 1), "s").alias("p"))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "s")
    met = rows.groupBy("s").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low < high").select("s")
    sketches = nodes.select("nid", F.slice("marks", STARS + 3, SKETCH).alias("sketch"))
    rows = rows.join(met, "s", "left_semi").join(sketches, "nid").select("s", "n", "nid", "g", "i", "p", "sketch")
    return rows.repartition(parts, "s").sortWithinPartitions("s", "n", "nid").mapInArrow(_meet, "u long, v long").distinct()


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """``docs`` with one row of each group that links of similarity ``LEAST`` and more can reach: the one with the smallest key.

    Similarity is that of the sets of word shingles of the whole texts, lower-cased in A to Z. Null and empty texts are copies of each other. A row with a null key
    stays only where no row of its group has a key; of equal rows (key and text) one stays. An empty table gives an empty result. Texts are read whole: memory
    follows the longest one (about 100 bytes for each of its bytes), never a group. Extra columns ride along.
    """
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(text).alias("text"))
    prints = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")).mapInArrow(_prints(shingle), f"key {kind}, mark long, node binary, marks array<long>")
    first = F.min(F.struct(F.col("key").isNull().alias("blank"), "key", "mark")).alias("first")
    nodes = cut_lineage(prints.groupBy("node").agg(first, F.first("marks").alias("marks")).withColumn("nid", F.monotonically_increasing_id()))
    sure = _verified(texts, _likely(_first_links(nodes), nodes), nodes, shingle)
    # of the other pairs first one for each node: what it ties needs no further pair, so a cluster of many groups isn't verified group by group
    likely = cut_lineage(_other_pairs(texts, nodes, components(sure), shingle))
    star = likely.groupBy("u").agg(F.min("v").alias("v"))
    sure = cut_lineage(sure.unionByName(_verified(texts, star, nodes, shingle)))
    groups = components(sure)
    apart = likely.join(groups.toDF("u", "g"), "u", "left").join(groups.toDF("v", "h"), "v", "left").where(F.coalesce("g", "u") != F.coalesce("h", "v"))
    left = cut_lineage(apart.select("u", "v").join(star, ["u", "v"], "left_anti"))
    if not left.isEmpty():
        sure = sure.unionByName(_verified(texts, left, nodes, shingle))
        groups = components(sure)
    tied = groups.toDF("nid", "component")
    heads = nodes.select("nid", "first").join(tied, "nid", "left").groupBy(F.coalesce("component", "nid").alias("root")).agg(F.min("first").alias("first"))
    return only_heads(docs, heads, key, text)
