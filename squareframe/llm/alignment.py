"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes, by diagonal run skipping, and counts of linked ids over the corpus.

1. Both tokenizers write a text as the same bytes, so a token is known by the byte where it ends. Where both have an end, a group ends.
2. Most groups are one to one, in runs on one diagonal (a fixed difference of the two token numbers). A run is jumped by exponential probing: slices of the two arrays
   of ends are compared at the current shift, each twice as long as the one before, and halved again where they differ. Between runs the side that is behind
   steps on until the ends meet, which is a group of its own, and the shift is updated.
3. Documents are worked in blocks of bounded size. A block writes its distinct linked id pairs once, with counts; these meet in one aggregation over the corpus, and the
   totals go back to the block, not to each document. A document keeps the places of its pairs in its block's list.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import shared_folder
from .bpe_trie import codec as byte_codec
from .bpe_trie import text_slices, texts_of
from .flat import flat
from .sentencepiece_codec import MARK
from .sentencepiece_codec import codec as piece_codec

#: Bytes of text that are aligned together, and that share a list of id pairs; entries of that list in one row.
SLICE, BLOCK_BYTES, PAIRS_IN_ROW = 1 << 20, 8 << 20, 1 << 16
#: Characters beyond which a text's pieces are found word by word, in bounded memory, instead of by the library.
LONG_TEXT = 1 << 20
#: An id pair as one number.
ID_BITS = 24


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(last a, last b) of each group in order, and (a, b) of each link: pairs of tokens whose bytes overlap. Ends rise and the last ones are equal."""
    n = len(ends_a)
    raw_a, raw_b = ends_a.astype(np.int64, copy=False).tobytes(), ends_b.astype(np.int64, copy=False).tobytes()
    list_a, list_b = ends_a.tolist(), ends_b.tolist()
    run_a, run_b, sizes = [], [], []
    i = j = 0
    while i < n:
        start = i
        if list_a[i] == list_b[j]:
            i, j, wide = i + 1, j + 1, 1
            while i < n and raw_a[8 * i:8 * (i + wide)] == raw_b[8 * j:8 * (j + wide)]:
                step = min(wide, n - i)  # slices cut at the ends of both arrays are equal only if as much is left of both
                i, j, wide = i + step, j + step, wide * 2
            while wide > 1:
                wide //= 2
                if i < n and raw_a[8 * i:8 * (i + wide)] == raw_b[8 * j:8 * (j + wide)]:
                    step = min(wide, n - i)
                    i, j = i + step, j + step
        if i > start:
            run_a.append(start)
            run_b.append(j - (i - start))
            sizes.append(i - start)
        if i >= n:
            break
        end_a, end_b = list_a[i], list_b[j]
        while end_a != end_b:
            if end_a < end_b:
                i += 1
                end_a = list_a[i]
            else:
                j += 1
                end_b = list_b[j]
    size = np.array(sizes, np.int64)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    group_a, group_b = np.repeat(np.array(run_a, np.int64), size) + inside, np.repeat(np.array(run_b, np.int64), size) + inside
    # inside a group, each end that only one side has is a link with the token of the other side around it
    inner_a, inner_b = np.ones(n, bool), np.ones(len(ends_b), bool)
    inner_a[group_a], inner_b[group_b] = False, False
    near_a, near_b = np.flatnonzero(inner_a), np.flatnonzero(inner_b)
    link_a = np.concatenate([group_a, near_a, np.searchsorted(ends_a, ends_b[near_b])])
    return group_a, group_b, link_a, np.concatenate([group_b, np.searchsorted(ends_b, ends_a[near_a]), near_b])


class _Digits:
    """Ids as decimal text by a table."""

    def __init__(self, size: int):
        self.width = len(str(max(0, size - 1)))
        text = [str(i) for i in range(size)]
        self.length = np.array([len(t) for t in text], np.int64)
        self.letters = np.frombuffer("".join(t.ljust(self.width + 1) for t in text).encode(), np.uint8).reshape(size, self.width + 1)

    def write(self, ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, each with a sign after it, and where each id begins."""
        length = self.length[ids]
        letters = self.letters[ids]
        letters[np.arange(len(ids)), length] = after
        return letters[np.arange(self.width + 1) <= length[:, None]], np.concatenate([[0], np.cumsum(length + 1)])


def _group_text(digits: _Digits, ids_a, ids_b, last_a, last_b) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` of all groups as bytes, and where the text of each group begins."""
    of_a = np.repeat(np.arange(len(last_a)), np.diff(last_a, prepend=-1))
    of_b = np.repeat(np.arange(len(last_b)), np.diff(last_b, prepend=-1))
    at_a = np.arange(len(ids_a)) + np.concatenate([[0], last_b[:-1] + 1])[of_a]
    at_b = np.arange(len(ids_b)) + (last_a + 1)[of_b]
    ids, after = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = ids_a, ids_b
    after[at_a[last_a]], after[at_b[last_b]] = ord("|"), ord(";")
    text, begin = digits.write(ids, after)
    return text, np.append(begin[np.concatenate([[0], (last_a + last_b + 2)[:-1]])], begin[-1])


class _Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a, self.path_b = byte_codec(path_a, True), path_b
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = self.a.bytes
        self.bytes_b = [self._piece(i) for i in range(self.b.vocab_size())]
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.empty_b = {i for i, t in enumerate(self.bytes_b) if not t}
        self.digits = _Digits(max(len(self.bytes_a), len(self.bytes_b)))

    def _piece(self, i: int) -> bytes:
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode()

    def ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both tokenizers for each text; none where the text is empty or either writes other bytes than a blank and the text."""
        none = np.zeros(0, np.int64)
        a = [np.frombuffer(x, "<i4").astype(np.int64) for x in self.a.encode_all([" " + t for t in texts])]
        b, short = [none] * len(texts), [k for k, t in enumerate(texts) if len(t) <= LONG_TEXT]
        whole = dict(zip(short, self.b.encode([texts[k] for k in short], num_threads=1), strict=True))
        for k, t in enumerate(texts):
            if len(t) > LONG_TEXT and MARK not in t:  # with a mark its bytes differ in any case
                whole[k] = np.frombuffer(piece_codec(self.path_b).encode(t), "<i4").tolist()
            want, ids = b" " + t.encode(), whole.get(k, [])
            # the first tokenizer maps bytes one to one, so its lengths tell; the second one's bytes are compared
            if t and self.size_a[a[k]].sum() == len(want) and b"".join(map(self.bytes_b.__getitem__, ids)) == want and (not self.empty_b or self.empty_b.isdisjoint(ids)):
                b[k] = np.array(ids, np.int64)
            else:
                a[k] = none
        return a, b


_pairs: dict[tuple[str, str], _Pair] = {}


def _pair(path_a: str, path_b: str) -> _Pair:
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = _Pair(path_a, path_b)
    return _pairs[path_a, path_b]


class Aligned:
    """A slice of texts, aligned: per text the numbers of tokens, groups and links, groups as text on demand, and its distinct id pairs with counts."""

    def __init__(self, pair: _Pair, texts: list[str]):
        a, b = pair.ids(texts)
        self.n_a, self.n_b = (np.fromiter(map(len, x), np.int64, len(texts)) for x in (a, b))
        ids_a, ids_b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        last_a, last_b, link_a, link_b = align(np.cumsum(pair.size_a[ids_a]), np.cumsum(pair.size_b[ids_b]))
        edge = np.concatenate([[0], np.cumsum(self.n_a)])
        self.group = np.searchsorted(last_a, edge)  # groups before each text; a text ends in a group's end
        self.n_groups = np.diff(self.group)
        of = np.searchsorted(edge, link_a, "right") - 1
        self.n_links = np.bincount(of, minlength=len(texts))
        self.text, self.begin = _group_text(pair.digits, ids_a, ids_b, last_a, last_b) if len(ids_a) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        wide_a, wide_b = (max(1, len(x).bit_length()) for x in (pair.bytes_a, pair.bytes_b))
        if len(texts).bit_length() + wide_a + wide_b < 64:  # text and both ids in one number
            whole = np.sort(of << (wide_a + wide_b) | ids_a[link_a] << wide_b | ids_b[link_b])
            of, code = whole >> (wide_a + wide_b), whole & ((1 << (wide_a + wide_b)) - 1)
            code = (code >> wide_b) << ID_BITS | (code & ((1 << wide_b) - 1))
        else:
            code = ids_a[link_a] << ID_BITS | ids_b[link_b]
            order = np.lexsort((code, of))
            of, code = of[order], code[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(new)
        self.code, self.times = code[first], np.diff(np.append(first, len(code)))
        self.cut = np.searchsorted(of[first], np.arange(len(texts) + 1))

    def groups(self, k: int) -> bytes:
        return self.text[self.begin[self.group[k]]:max(self.begin[self.group[k]], self.begin[self.group[k + 1]] - 1)].tobytes()


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of four widths, told by the first byte."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * w - (w == 8)))
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


_FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def _first_pass(path_a: str, path_b: str, kind: pa.DataType):
    """(key, text) to rows of a block: one for each text (kind 1), then the block's id pairs (kind 0) in order."""
    names = ["block", "kind", "key", *_FIGURES, "groups_sha256", "places", "times", "pairs", "counts"]
    types = [pa.int64(), pa.int32(), kind, *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def rows(n, **cols):
        return pa.RecordBatch.from_arrays([cols[c] if isinstance(cols.get(c), pa.Array) else pa.array(cols[c], t) if c in cols else pa.nulls(n, t)
                                           for c, t in zip(names, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, context = _pair(path_a, path_b), TaskContext.get()
        block, held, size = (context.partitionId() if context else 0) << 32, [], 0

        def flush():
            nonlocal block, held, size
            code = np.concatenate([x.code for _, x, _ in held])
            total = np.concatenate([x.times for _, x, _ in held])
            distinct, place = np.unique(code, return_inverse=True)
            count, at = np.bincount(place, weights=total, minlength=len(distinct)).astype(np.int64), 0
            for keys, x, digests in held:
                own = place[at:at + len(x.code)]
                at += len(x.code)
                n = len(keys)
                spans = list(zip(x.cut[:-1].tolist(), x.cut[1:].tolist(), strict=True))
                yield rows(n, block=np.full(n, block), kind=np.full(n, 1, np.int32), key=keys, groups_sha256=digests, **{c: getattr(x, c) for c in _FIGURES},
                           places=[_packed(np.diff(own[i:j], prepend=0)) for i, j in spans], times=[_packed(x.times[i:j]) for i, j in spans])
            for i in range(0, len(distinct), PAIRS_IN_ROW):
                yield rows(1, block=[block], kind=[0], pairs=[distinct[i:i + PAIRS_IN_ROW]], counts=[count[i:i + PAIRS_IN_ROW]])
            block, held, size = block + 1, [], 0

        for b in batches:
            data, off = flat(b.column(1))
            for i, j in text_slices(off, SLICE):
                x = Aligned(pair, texts_of(data, off, i, j))
                digests = [hashlib.sha256(x.groups(k)).hexdigest() if x.n_a[k] else "" for k in range(j - i)]
                x.text = x.begin = None
                held.append((b.column(0).slice(i, j - i), x, digests))
                size += int(off[j] - off[i])
                if size >= BLOCK_BYTES:
                    yield from flush()
        if held:
            yield from flush()
    return run


def _second_pass(key: str):
    """Rows of blocks, the totals of a block's pairs before its texts, to the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, totals, best, parts = None, None, None, []
        for b in batches:
            blocks, kinds = b.column("block").to_numpy(), b.column("kind").to_numpy()
            edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)], strict=True):
                if j == i:
                    continue
                if blocks[i] != block:
                    block, totals, parts = blocks[i], None, []
                part = b.slice(i, j - i)
                if kinds[i] == 0:
                    parts.append((part.column("total").to_numpy(), part.column("top").to_numpy(zero_copy_only=False)))
                    continue
                if totals is None:
                    totals, best = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in ((0, np.int64), (1, bool)))
                n_best, count_sum = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                for r, (places, times) in enumerate(zip(part.column("places"), part.column("times"), strict=True)):
                    at, n = np.cumsum(_unpacked(places.as_py())), _unpacked(times.as_py())
                    n_best[r], count_sum[r] = n[best[at]].sum(), (n * totals[at]).sum()
                yield pa.RecordBatch.from_arrays([part.column("key"), *(part.column(c) for c in _FIGURES), pa.array(n_best), pa.array(count_sum), part.column("groups_sha256")],
                                                 [key, *_FIGURES, "n_best", "count_sum", "groups_sha256"])
    return run


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row: a byte-level tokenizers file against a sentencepiece model.

    ``n_best`` counts the links whose id pair is the most frequent one of its second id in the corpus, ties included; ``count_sum`` adds up the corpus counts of all links.
    Null and empty texts, and those that a tokenizer writes as other bytes, have no tokens: zeros and an empty digest. Repeated rows are kept and count each. An empty
    table gives an empty result. Memory follows the block and the longest text.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    fields = f"block long, kind int, key {kind.simpleString()}, " + ", ".join(f"{c} long" for c in _FIGURES) + ", groups_sha256 string, places binary, times binary, pairs array<long>, counts array<long>"
    folder = f"{shared_folder(spark)}/alignment/{uuid.uuid4().hex}"
    docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_first_pass(path_a, path_b, to_arrow_type(kind)), fields).write.parquet(folder)
    blocks = spark.read.schema(fields).parquet(folder)
    pairs = blocks.where("kind = 0").select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("block", F.col("p.pairs").alias("code"), F.col("p.counts").alias("n"))
    totals = pairs.groupBy("code").agg(F.sum("n").alias("total")).withColumn("b", F.col("code").bitwiseAND(F.lit((1 << ID_BITS) - 1)))
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    known = totals.join(most, "b").select("code", "total", (F.col("total") == F.col("most")).alias("top"))
    back = pairs.join(known, "code").select("block", F.lit(0).alias("kind"), "code", "total", "top")
    texts = blocks.where("kind = 1").select("block", "kind", "key", *_FIGURES, "groups_sha256", "places", "times")
    met = back.unionByName(texts, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind", "code")
    out = f"{key} {kind.simpleString()}, " + ", ".join(f"{c} long" for c in (*_FIGURES, "n_best", "count_sum")) + ", groups_sha256 string"
    return met.mapInArrow(_second_pass(key), out)
