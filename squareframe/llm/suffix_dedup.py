"""Suffix-array dedup: bytes covered by a long string that also starts earlier, found by a sparse suffix sort with hash comparisons.

1. Sampling. Every window of ``length`` bytes takes its smallest ``GRAM``-byte gram as anchor, so two equal windows have equal anchors at equal places, and only
   about one suffix in 35 is looked at. An anchor's region is the text of all windows it stands for.
2. Bucketing. Anchors are shuffled by the hash of their gram. Regions with equal hashes (128 bits with the gram's) but the first are removed whole; a gram with one
   region has no common extension and is dropped. Each task does this for its own rows before the shuffle, so copies cost one row per task. Of the regions that it
   has of one gram, the first ``FEW`` are dealt by the gram, the others by gram and region: so a gram in very many different places isn't gathered anywhere.
3. Suffix sort. The remaining regions of a gram fetch their text. Suffixes from the anchors, and the reversed texts before them, are sorted by mergesort, in
   which prefix polynomial hashes and binary search find the common extension of two suffixes; bytes of neighbours are compared afterwards, and another base is
   taken if a hash lied. Common extensions of neighbours tell for every window which earlier regions share it.
4. Grams with more than ``HOT`` regions are not gathered in one task: their windows are grouped by their own bytes with partial aggregation, and met again in a join.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from .flat import BASE, BYTE_VALUE, SECOND_BASE, SECOND_VALUE, Prefix, flat, give_back, mixed, slices

LENGTH = 100
GRAM = 32
#: Anchors that a task combines at a time, regions that are sorted at a time, and regions of one gram that are gathered at most.
COMBINE, CHUNK, HOT = 1 << 18, 1 << 14, 20_000
#: Regions of one gram, of those that a task combines, that are dealt by the gram; two or more, so that whoever has another one there learns that it has company.
FEW = 4
NULL_ID = -(1 << 63)


def _anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int):
    """Anchor, first and last window of each, for all texts of a slice."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none
    bits = np.uint64(max(24, len(data).bit_length()))
    m = len(data) - gram + 1
    at = np.arange(m)
    key = (mixed(Prefix(data).hash(at, at + gram)) >> bits << bits) | at.astype(np.uint64)
    width, span = length - gram + 1, 1
    while span * 2 <= width:
        key, span = np.minimum(key[:-span], key[span:]), span * 2
    if width > span:
        key = np.minimum(key[:-(width - span)], key[width - span:])
    begin, stop = off[:-1], np.maximum(off[:-1], off[1:] - length + 1)
    turn = np.zeros(len(data) + 1, np.int32)
    np.add.at(turn, begin, 1)
    np.add.at(turn, stop, -1)
    s = np.flatnonzero(np.cumsum(turn)[:len(key)] > 0)
    if not len(s):
        return none, none, none
    p = (key[s] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    return p[new], s[new], s[np.append(new[1:], len(s)) - 1]


def _merge(doc, mark, a, end):
    """Union of intervals within each (doc, mark)."""
    if not len(a):
        return doc, mark, a, end
    o = np.lexsort((a, mark, doc))
    doc, mark, a, end = doc[o], mark[o], a[o], end[o]
    fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])])
    number = np.cumsum(fresh) - 1
    lift = number * (int(end.max()) + 2)  # so that a running maximum starts anew with each text
    reach = np.maximum.accumulate(end + lift)
    fresh[1:] |= a[1:] + lift[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    stop = np.maximum.reduceat(end, first)
    return doc[first], mark[first], a[first], stop


_ROW = "deal long, kgram long, region long, doc long, mark long, a long, b long"


def _scan(length: int, gram: int):
    """(doc, mark, text) to anchors (b = size of the region << 8 | place of the anchor) and intervals already known to go (b = -size).

    ``deal`` is the gram's hash, or another number for a gram's regions beyond ``FEW``, which are thereby known to have company.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            kgram, region, doc, mark, a, b = np.concatenate(held, axis=1)
            held.clear()
            o = np.lexsort((a, mark, doc, region, kgram))
            kgram, region, doc, mark, a, b = (x[o] for x in (kgram, region, doc, mark, a, b))
            head = np.concatenate([[True], (kgram[1:] != kgram[:-1]) | (region[1:] != region[:-1])])
            first = np.flatnonzero(head)[np.cumsum(head) - 1]
            later = (doc != doc[first]) | (mark != mark[first]) | (a != a[first])
            d, m, x, end = _merge(doc[later], mark[later], a[later], a[later] + (b[later] >> 8))
            keep = head
            spread = mixed(mixed(d.view(np.uint64)) + x.view(np.uint64)).view(np.int64)
            k, r = kgram[keep], region[keep]
            fresh = np.concatenate([[True], k[1:] != k[:-1]])
            nth = np.arange(len(k)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            deal = np.where(nth < FEW, k, mixed(mixed(k.view(np.uint64)) + r.view(np.uint64)).view(np.int64))
            cols = [deal, k, r, doc[keep], mark[keep], a[keep], b[keep]]
            cols = [np.concatenate(uv) for uv in zip(cols, (spread, spread, np.zeros_like(spread), d, m, x, x - end), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["deal", "kgram", "region", "doc", "mark", "a", "b"])

        for batch in batches:
            data, off = flat(batch.column(2))
            docs, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j in slices(off, 1 << 18):
                part, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                p, first, last = _anchors(part, o, length, gram)
                if not len(p):
                    continue
                k = mixed(Prefix(part).hash(p, p + gram))
                shape = (p - first).astype(np.uint64) * np.uint64(1 << 8) + (p - last).astype(np.uint64)
                r = mixed(Prefix(part, SECOND_BASE, SECOND_VALUE).hash(first, last + length) + shape * np.uint64(BASE))
                of = np.searchsorted(o, p, "right") - 1
                held.append(np.stack([k.view(np.int64), r.view(np.int64), docs[i + of], marks[i + of], first - o[of], (last + length - first) << 8 | (p - first)]))
                if sum(x.shape[1] for x in held) >= COMBINE:
                    yield from flush()
        if held:
            yield from flush()
        give_back()
    return run


def _cut_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with doc, mark, text and wanted to (kgram, doc, mark, a, at, piece); other columns are passed over."""
    for batch in batches:
        data, off = flat(batch.column("text"))
        lists = batch.column("wanted")
        n, w = lists.value_lengths().to_numpy(), lists.flatten()
        a, b, kgram = (w.field(i).to_numpy() for i in range(3))
        of = np.repeat(np.arange(len(n)), n)
        begin, size = off[:-1][of] + a, b >> 8
        for i in range(0, len(a), 1 << 16):
            x, y = begin[i:i + (1 << 16)], size[i:i + (1 << 16)]
            out = np.concatenate([[0], np.cumsum(y)])
            index = np.repeat(x - out[:-1], y) + np.arange(out[-1])
            pieces = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(out.astype(np.int32).tobytes()), pa.py_buffer(data[index].tobytes())])
            o = of[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(kgram[i:i + (1 << 16)]), batch.column("doc").take(pa.array(o)), batch.column("mark").take(pa.array(o)), pa.array(a[i:i + (1 << 16)]),
                                              pa.array(b[i:i + (1 << 16)] & 255), pieces], ["kgram", "doc", "mark", "a", "at", "piece"])


def _common(h: Prefix, x, y, most):
    """Length of the common extension of the suffixes at x and y, at most ``most``: binary search over hashes."""
    low, high = np.zeros(len(x), np.int64), most.copy()
    while (open_ := low < high).any():
        mid = (low + high + 1) >> 1
        same = h.hash(x, x + mid) == h.hash(y, y + mid)
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
    return low


def suffix_sort(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes within each group (``group`` is sorted), and the common extension of each with the one before it (0 at a group's start).

    Bottom-up mergesort of all groups together: each suffix finds its rank in the sibling run by binary search, each comparison finds the common extension by
    binary search over prefix polynomial hashes. Neighbours are then compared byte by byte; if a hash lied, the sort is done again with another base.
    """
    n = len(start)
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(begin, n))
    first, many = np.repeat(begin, sizes), np.repeat(sizes, sizes)
    tail = np.append(data, 0)
    for base in (BASE, SECOND_BASE, *(0x2545F4914F6CDD1D + 2 * i for i in range(20))):
        h, order = Prefix(data, base, BYTE_VALUE), np.arange(n)
        run = 1
        while (live := np.flatnonzero(many > run)).size:
            place = live - first[live]
            side = (place // run) % 2
            sib = first[live] + (place // run + np.where(side == 0, 1, -1)) * run
            stop = np.minimum(sib + run, first[live] + many[live])
            low, high = np.minimum(sib, stop), stop.copy()
            mine = order[live]
            while (todo := np.flatnonzero(low < high)).size:
                mid = (low[todo] + high[todo]) >> 1
                x, y = mine[todo], order[mid]
                most = np.minimum(size[x], size[y])
                c = _common(h, start[x], start[y], most)
                at_end = c == most
                less = np.where(at_end, size[y] < size[x], tail[start[y] + np.minimum(c, most)] < tail[start[x] + np.minimum(c, most)])
                tie = at_end & (size[y] == size[x])
                before = np.where(tie, side[todo] == 1, less)  # equal ones of the left run stay first
                low[todo], high[todo] = np.where(before, mid + 1, low[todo]), np.where(before, high[todo], mid)
            merged = order.copy()
            left_start = first[live] + (place // (2 * run)) * 2 * run
            merged[left_start + place % run + (low - np.minimum(sib, stop))] = mine
            order, run = merged, run * 2
        lcp = np.zeros(n, np.int64)
        inner = np.flatnonzero(np.concatenate([[False], group[1:] == group[:-1]]))
        x, y = order[inner - 1], order[inner]
        most = np.minimum(size[x], size[y])
        lcp[inner] = c = _common(h, start[x], start[y], most)
        if _verified(tail, start[x], start[y], c, most, size[x], size[y]):
            return order, lcp
    raise ArithmeticError("no base without collisions")


def _verified(tail, x, y, c, most, sx, sy) -> bool:
    """Neighbours agree on the whole common extension, differ after it, and stand in order."""
    for i in range(0, len(x), 4096):
        k = slice(i, i + 4096)
        step = np.arange(int(c[k].max(initial=0)))
        inside = step < c[k][:, None]
        if (inside & (tail[np.minimum(x[k][:, None] + step, len(tail) - 1)] != tail[np.minimum(y[k][:, None] + step, len(tail) - 1)])).any():
            return False
    ended = c == most
    later = tail[np.minimum(x + c, len(tail) - 1)] < tail[np.minimum(y + c, len(tail) - 1)]
    return bool(np.where(ended, sx <= sy, later).all())


def _shared(data, off, at, group, length):
    """First and last start (from the region's start) of the windows of each region that an earlier region of its gram has, -1 without one."""
    n = len(at)
    anchor, size = off[:-1] + at, np.diff(off)
    right = size - at
    order, lcp = suffix_sort(data, anchor, right, group)
    back, turned = suffix_sort(data[::-1].copy(), len(data) - anchor, at, group)
    low, high = np.full(n, -1), np.full(n, -1)
    for d in range(int(at.max(initial=0)) + 1):  # windows that begin d bytes before their anchors
        valid = np.flatnonzero((at >= d) & (right >= length - d))
        if len(valid) < 2:
            continue
        r, l = np.empty(n, np.int64), np.empty(n, np.int64)
        r[order], l[back] = np.cumsum(lcp < length - d), np.cumsum((turned < d) | (np.concatenate([[True], group[1:] != group[:-1]])))
        key = r[valid] * (n + 1) + l[valid]
        o = np.argsort(key, kind="stable")
        again = valid[o[1:][key[o][1:] == key[o][:-1]]]
        s = at[again] - d
        high[again] = np.maximum(high[again], s)
        low[again] = s  # d grows, so s falls
    return low, high


def _resolve(length: int):
    """Sorted (kgram, doc, mark, a, at, piece) to removed intervals (doc, mark, a, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(t: pa.Table):
            place = [t[c].to_numpy() for c in ("kgram", "doc", "mark", "a")]
            again = np.ones(len(t) - 1, bool)
            for x in place:
                again &= x[1:] == x[:-1]
            if again.any():  # rows that are equal in key and text brought the same regions
                t = t.filter(pa.array(np.concatenate([[True], ~again]))).combine_chunks()
            data, off = _binary(t["piece"])
            kgram = t["kgram"].to_numpy()
            low, high = _shared(data, off, t["at"].to_numpy(), kgram, length)
            hit = np.flatnonzero(low >= 0)
            a = t["a"].to_numpy()[hit]
            d, m, x, end = _merge(t["doc"].to_numpy()[hit], t["mark"].to_numpy()[hit], a + low[hit], a + high[hit] + length)
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (d, m, x, end)], ["doc", "mark", "a", "e"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= CHUNK:
                t = pa.Table.from_batches(held).combine_chunks()
                k = t["kgram"].to_numpy()
                cut = int(np.searchsorted(k, k[-1]))  # the last gram may go on
                held = [x for x in t.slice(cut).to_batches() if x.num_rows]
                if cut:
                    yield work(t.slice(0, cut).combine_chunks())
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())
        held.clear()
        give_back()
    return run


def _binary(column) -> tuple[np.ndarray, np.ndarray]:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    c = c.cast(pa.large_binary())
    off = np.frombuffer(c.buffers()[1], np.int64)[c.offset:c.offset + len(c) + 1]
    return np.frombuffer(c.buffers()[2], np.uint8)[off[0]:off[-1]], off - off[0]


def _windows(length: int):
    """(kgram, doc, mark, a, at, piece) to (window, doc, mark, a): each string of ``length`` bytes of a region."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = _binary(b.column(5))
            many = np.diff(off) - length + 1
            of = np.repeat(np.arange(len(many)), many)
            s = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            x = off[:-1][of] + s
            for i in range(0, len(x), 1 << 16):
                k = slice(i, i + (1 << 16))
                text = np.lib.stride_tricks.sliding_window_view(data, length)[x[k]]
                yield pa.RecordBatch.from_arrays([
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(text), [None, pa.py_buffer(text.tobytes())]).cast(pa.binary()),
                    b.column(1).take(pa.array(of[k])), b.column(2).take(pa.array(of[k])), pa.array(b.column(3).to_numpy()[of[k]] + s[k])], ["window", "doc", "mark", "a"])
    return run


def _spans(rows: DataFrame, placed: DataFrame, length: int, gram: int, parts: int) -> DataFrame:
    """(doc, mark, a, e) intervals to remove, some of them overlapping. ``placed``: the rows dealt by (doc, mark)."""
    spark = rows.sparkSession
    anchors = rows.mapInArrow(_scan(length, gram), _ROW).repartition(parts, "deal")
    region = Window.partitionBy("deal", "kgram", "region").orderBy("doc", "mark", "a")
    gram_here = Window.partitionBy("deal", "kgram")
    place = F.struct("doc", "mark", "a")
    ranked = anchors.withColumn("first", F.first(place).over(region)).withColumn("nth", F.row_number().over(region))
    ranked = ranked.withColumn("several", (F.col("deal") != F.col("kgram")) | (F.min("region").over(gram_here) != F.max("region").over(gram_here)))
    gone = (F.col("b") < 0) | (F.col("first") != place)
    size = F.when(F.col("b") < 0, -F.col("b")).otherwise(F.shiftright("b", 8))
    found = ranked.where(gone | (F.col("several") & (F.col("nth") == 1))).select("doc", "mark", "a", "b", "kgram", gone.alias("gone"), (F.col("a") + size).alias("e"))
    folder = f"{shared_folder(spark)}/suffix_dedup/{uuid.uuid4().hex}"
    found.write.parquet(folder)
    found = spark.read.parquet(folder)
    whole = found.where("gone").select("doc", "mark", "a", "e")
    wanted = found.where("not gone").select("doc", "mark", "a", "b", "kgram")
    lists = wanted.groupBy("doc", "mark").agg(F.collect_list(F.struct("a", "b", "kgram")).alias("wanted"))
    # all columns, so that this is the exchange that the texts are trimmed from, and not another one
    pieces = placed.join(lists, ["doc", "mark"]).mapInArrow(_cut_regions, "kgram long, doc long, mark long, a long, at long, piece binary")
    hot = wanted.groupBy("kgram").count().where(F.col("count") > HOT).select("kgram")
    some = not hot.isEmpty()
    cold = pieces.join(hot, "kgram", "left_anti") if some else pieces
    cold = cold.repartition(parts, "kgram").sortWithinPartitions("kgram", "doc", "mark", "a")
    out = whole.unionByName(cold.mapInArrow(_resolve(length), "doc long, mark long, a long, e long"))
    if some:  # the bytes themselves are the key, met by partial aggregation
        windows = pieces.join(hot, "kgram", "left_semi").mapInArrow(_windows(length), "window binary, doc long, mark long, a long")
        least = windows.groupBy("window").agg(F.min(place).alias("first"))
        out = out.unionByName(windows.join(least, "window").where(F.col("first") != place).select("doc", "mark", "a", (F.col("a") + length).alias("e")))
    return out


def _trim(names: list[str], length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # rows are sorted by (doc, mark): a row equal to the one before it goes whole
        for b in batches:
            data, off = flat(b.column("text"))
            docs, marks, spans = b.column("doc").to_pylist(), b.column("mark").to_pylist(), b.column("spans")
            removed, runs, digest, texts = [], [], [], []
            for i in range(b.num_rows):
                text = data[off[i]:off[i + 1]]
                got = spans[i].values if spans[i].is_valid else None
                if (docs[i], marks[i]) == before and len(text) >= length:
                    a, e = np.array([0]), np.array([len(text)])
                elif got is None or not len(got):
                    a = e = np.zeros(0, np.int64)
                else:
                    x, y = got.field(0).to_numpy(), got.field(1).to_numpy()
                    zero = np.zeros(len(x), np.int64)
                    _, _, a, e = _merge(zero, zero, x, y)
                before = docs[i], marks[i]
                turn = np.zeros(len(text) + 1, np.int8)
                turn[a] += 1
                turn[e] -= 1
                kept = text[np.cumsum(turn[:-1], dtype=np.int32) == 0].tobytes() if len(a) else text.tobytes()
                removed.append(len(text) - len(kept))
                runs.append(len(a))
                digest.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode("utf-8", "ignore"))
            cols = [b.column(c) for c in names] + [pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(texts, pa.string())] if with_text else []), [*names, *_NEW, *(["kept_text"] if with_text else [])])
        give_back()
    return run


_NEW = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def removed_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """(key, *carry, n_bytes, n_removed, n_spans, kept_sha256) of each row, with ``kept_text`` if asked for.

    A byte goes if a ``length``-byte string that covers it also starts earlier: in a smaller key, or further left in the same text. Nulls are empty texts; a null key
    is the smallest. Rows with one key stand in the order of a hash of their text; of equal rows the first stays whole. Texts shorter than ``length`` stay whole.
    ``kept_text`` drops what is left of characters cut in two. An empty table gives an empty result.
    """
    rows = docs.withColumn("doc", F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)))
    once = rows.groupBy("doc").count().where("count > 1").isEmpty()
    # not a literal: that would be folded out of the joins, whose partitioning would then differ from that of ``placed``
    rows = rows.withColumn("mark", F.col("doc").bitwiseAND(F.lit(0)) if once else F.coalesce(F.xxhash64(text), F.lit(0)))
    rows = rows.select(*[F.col(c).alias(f"_c_{c}") for c in carry], "doc", "mark", F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartition(parts, "doc", "mark")
    spans = _spans(rows.select("doc", "mark", "text"), placed, length, gram, parts).groupBy("doc", "mark").agg(F.collect_list(F.struct("a", "e")).alias("spans"))
    joined = placed.join(spans, ["doc", "mark"], "left").sortWithinPartitions("doc", "mark")
    names = [f"_c_{c}" for c in carry] + ["doc"]
    fields = joined.select(*names).schema
    for c, t in zip(_NEW, ("long", "long", "long", "string"), strict=True):
        fields = fields.add(c, t)
    out = joined.select(*names, "mark", "text", "spans").mapInArrow(_trim(names, length, with_text), fields.add("kept_text", "string") if with_text else fields)
    kind = docs.schema[key].dataType
    return out.select(F.nullif("doc", F.lit(NULL_ID)).cast(kind).alias(key), *[F.col(f"_c_{c}").alias(c) for c in carry], *_NEW, *(["kept_text"] if with_text else []))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated strings taken out of their texts, columns as before; ``n_chars``, where there is one, is counted again."""
    own = {c: f"_own_{c}" for c in docs.columns}  # a column may be called like one of the figures
    carry = tuple(own[c] for c in docs.columns if c not in (key, text))
    out = removed_spans(docs.withColumnsRenamed(own), own[key], own[text], length, carry=carry, with_text=True)
    got = {c: F.col("kept_text" if c == text else own[c]) for c in docs.columns}
    if "n_chars" in got:
        got["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[x.alias(c) for c, x in got.items()])
