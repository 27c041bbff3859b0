"""Byte-level BPE encoding and decoding by a walk over a trie of words that carries last tokens.

The encoding of a prefix of a word ends in exactly one token: the token t for which the encoding of what is before t ends in a token that keeps its border with t when
both are merged in rank order. So a node of the trie of words needs one number, its last token, found from those of its ancestors, and the encodings of all words below a
node share it. The walk is depth-first over the distinct new words of a slice of texts, in sorted order: the common prefix with the word before is the part of
the path that has been walked. A word's ids are read backwards from its own node.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .flat import flat

#: Bytes of texts whose words meet in one trie; words of a longer text that are held at a time.
SLICE, WORDS_AT_ONCE = 2 << 20, 1 << 18
#: Words and pairs of tokens that a Python worker remembers at most, and their length; beyond, it starts anew. About 150 MB in all.
WORDS_KEPT, PAIRS_KEPT, LONGEST_KEPT = 300_000, 1_000_000, 64
#: The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100 in their order.
_OWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
LETTER_OF_BYTE = {b: chr(b) for b in _OWN} | {b: chr(256 + n) for n, b in enumerate(sorted({*range(256)} - {*_OWN}))}
BYTE_OF_LETTER = {c: b for b, c in LETTER_OF_BYTE.items()}
#: Texts of these characters only are split by the faster library: nothing that it and the tokenizer see as different kinds.
_PLAIN = re.compile("[\t-\r\x20-\x7eÀ-ÖØ-öø-ɏ]*+").fullmatch
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_KINDS = {"normalizer": None, "post_processor": None}


def _spelled(token: str) -> bytes | None:
    """Bytes of a token in the byte-level alphabet; None if another letter is in it."""
    return bytes(map(BYTE_OF_LETTER.__getitem__, token)) if all(c in BYTE_OF_LETTER for c in token) else None


def _word_pattern(path: str) -> regex.Pattern:
    """The byte-level word pattern, with the characters that the tokenizer's own library doesn't count as letters or numbers taken out of them."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str

    def strange(kind: str, frame: str) -> str:
        found = regex.findall(kind, "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
        whole = {word for word, _ in split("!".join(frame + c + frame for c in found))}
        spell = lambda s: "".join(LETTER_OF_BYTE[b] for b in s.encode())
        return "".join(c for c in found if spell(frame + c + frame) not in whole)

    letters, numbers = strange(r"\p{L}", "a"), strange(r"\p{N}", "1")
    less = lambda kind, odd: f"[{kind}--[{odd}]]" if odd else kind
    p_l, p_n = less(r"\p{L}", letters), less(r"\p{N}", numbers)
    return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{p_l}+| ?{p_n}+| ?[^\s||{p_l}||{p_n}]+|\s+(?!\S)|\s+")


class TrieCodec:
    """Merges of a tokenizers file of kind byte-level BPE. With ``plain_specials`` the strings of added tokens are ordinary text."""

    def __init__(self, path: str, plain_specials: bool = False):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, pre = made["model"], made["pre_tokenizer"] or {}
        if (model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
                or any(made[k] is not v for k, v in _KINDS.items()) or any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "ignore_merges"))):
            raise ValueError("not a plain byte-level BPE tokenizer")
        added = made["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens with rules for their surroundings")
        spelled = {_spelled(t): i for t, i in model["vocab"].items()}
        self.ids: dict[bytes, int] = {t: i for t, i in spelled.items() if t is not None}
        size = max([*model["vocab"].values(), *(t["id"] for t in added)]) + 1
        self.bytes: list[bytes] = [b""] * size
        for t, i in self.ids.items():
            self.bytes[i] = t
        self.specials = {t["content"]: t["id"] for t in added}
        for t, i in self.specials.items():
            self.bytes[i] = _spelled(t) or t.encode()
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError("a byte has no token")
        # merges: when a pair is joined, and the halves of what it makes
        self.rank, self.made, self.halves = {}, [-1] * size, {}
        for n, pair in enumerate(model["merges"]):
            left, right = map(_spelled, pair if isinstance(pair, list) else pair.split(" "))
            a, b, c = self.ids[left], self.ids[right], self.ids[left + right]
            if c in self.halves:
                raise ValueError("a token that two merges make")
            self.rank[a << 32 | b], self.made[c], self.halves[c] = n, n, (a, b)
        for t, i in list(self.ids.items()):  # in rank order a token's halves stand before it
            if len(t) > 1 and not (i in self.halves and self._stands(*self.halves[i], self.made[i])):
                del self.ids[t]
        self.longest = max(map(len, self.ids))
        self.path = path
        self.cut = None if plain_specials or not self.specials else re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def _stands(self, a: int, b: int, until: float = float("inf")) -> bool:
        """Whether the border of two neighbours outlives all merges of ranks under ``until``.

        Goes back in time: whichever neighbour was made later is taken apart, and what then lies at the border must not be a pair that joins before that moment.
        Equal merges go from left to right.
        """
        while True:
            joined = self.rank.get(a << 32 | b)
            if joined is not None and joined < until:
                return False
            if self.made[a] > self.made[b]:
                until, a = self.made[a], self.halves[a][1]
            elif self.made[b] >= 0:
                until, b = self.made[b] + 1, self.halves[b][0]
            else:
                return True

    def walk(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of the sorted distinct words, as 32-bit integers."""
        ids, pairs, longest, stands, bytes_of = self.ids.get, self.pairs, self.longest, self._stands, self.bytes
        path, before, out = [-1], b"", []  # path[e]: the last token of the encoding of the first e bytes of the word
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del path[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                for start in range(end - 1, max(-1, end - 1 - longest), -1):
                    token = ids(word[start:end])
                    if token is None:
                        continue
                    if start:
                        pair = path[start] << 32 | token
                        good = pairs.get(pair)
                        if good is None:
                            if len(pairs) >= PAIRS_KEPT:
                                pairs.clear()
                            good = pairs[pair] = stands(path[start], token)
                        if not good:
                            continue
                    path.append(token)
                    break
            back, end = [], len(word)
            while end:
                back.append(path[end])
                end -= len(bytes_of[path[end]])
            back.reverse()
            out.append(array("i", back).tobytes())
            before = word
        return out

    def _all_known(self, words: set[str]) -> dict[str, bytes]:
        """Ids of all words; the new ones are walked together."""
        new = words.difference(self.known)
        fresh: dict[str, bytes] = {}
        if new:
            spelled = {w.encode(): w for w in new}
            order = sorted(spelled)
            fresh = {spelled[w]: ids for w, ids in zip(order, self.walk(order), strict=True)}
            if len(self.known) + len(fresh) > WORDS_KEPT:
                fresh = {w: self.known[w] for w in words if w in self.known} | fresh
                self.known = {}
                return fresh
            self.known.update((w, ids) for w, ids in fresh.items() if len(w) <= LONGEST_KEPT)
        return fresh

    def _ids(self, lists: list[list[str]]) -> list[bytes]:
        fresh = self._all_known(set().union(*lists))
        known = self.known
        return [b"".join([known[w] if w in known else fresh[w] for w in words]) for words in lists]

    @cached_property
    def pattern(self) -> regex.Pattern:
        """Made for the first text that needs it: it takes a few seconds."""
        return _word_pattern(self.path)

    def _words(self, text: str) -> re.Pattern | regex.Pattern:
        return _PLAIN_WORDS if _PLAIN(text) else self.pattern

    def _plain(self, text: str) -> Iterator[bytes]:
        """Ids of a text without added tokens, in runs; few words of a long text are held at a time."""
        if len(text) <= SLICE:
            yield self._ids([self._words(text).findall(text)])[0]
            return
        found = (m[0] for m in self._words(text).finditer(text))
        while words := list(islice(found, WORDS_AT_ONCE)):
            yield self._ids([words])[0]

    def runs(self, text: str) -> Iterator[bytes]:
        """Ids of a whole text as runs of 32-bit integers."""
        if self.cut is None:
            yield from self._plain(text)
            return
        for part in self.cut.split(text):
            if part in self.specials:
                yield array("i", [self.specials[part]]).tobytes()
            elif part:
                yield from self._plain(part)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each of a slice of texts; words of texts that hold no added token share one walk."""
        simple = [len(t) <= SLICE and (self.cut is None or not self.cut.search(t)) for t in texts]
        together = iter(self._ids([self._words(t).findall(t) for t, s in zip(texts, simple, strict=True) if s]) if any(simple) else [])
        return [next(together) if s else b"".join(self.runs(t)) for t, s in zip(texts, simple, strict=True)]

    def raw(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.raw(ids).decode("utf-8", "replace")


_codecs: dict[tuple[str, bool], TrieCodec] = {}


def codec(path: str, plain_specials: bool = False) -> TrieCodec:
    if (path, plain_specials) not in _codecs:
        _codecs[path, plain_specials] = TrieCodec(path, plain_specials)
    return _codecs[path, plain_specials]


def text_slices(off: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, min(n, int(np.searchsorted(off, off[i] + most, "right")) - 1))
        yield i, j
        i = j


def texts_of(data: np.ndarray, off: np.ndarray, i: int, j: int) -> list[str]:
    view = memoryview(data)
    return [str(view[x:y], "utf-8") for x, y in zip(off[i:j].tolist(), off[i + 1:j + 1].tolist(), strict=True)]


def encode(docs: DataFrame, path: str, text: str = "text", plain_specials: bool = False) -> DataFrame:
    """``docs`` without the text, with ``ids`` (array of int) and ``n_tokens``; columns of these names are replaced.

    Null and empty texts have no ids. Repeated rows are kept, an empty table gives an empty result. ``path`` is a tokenizers file on every machine.
    """
    names = [c for c in docs.columns if c not in (text, "ids", "n_tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, plain_specials)
        for b in batches:
            data, off = flat(b.column(text))
            for i, j in text_slices(off):
                ids = c.encode_all(texts_of(data, off, i, j))
                sizes = np.fromiter(map(len, ids), np.int64, j - i) // 4
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([*(b.column(n).slice(i, j - i) for n in names), lists, pa.array(sizes)], [*names, "ids", "n_tokens"])

    fields = docs.select(*names).schema.add("ids", ArrayType(IntegerType())).add("n_tokens", "long")
    return docs.select(*names, text).mapInArrow(run, fields)


def decode(rows: DataFrame, path: str, name: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ``ids``, added tokens written out; null ids give an empty text. Bytes that are no UTF-8 become U+FFFD."""
    names = [c for c in rows.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            lists = b.column("ids")
            values, at, sizes = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), lists.value_lengths().fill_null(0).to_numpy()
            texts = [c.decode(values[i:i + n].tolist()) for i, n in zip(at[:-1].tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(texts, pa.string())], [*names, name])

    return rows.select(*names).mapInArrow(run, rows.select(*names).schema.add(name, "string"))


def _digests(c: TrieCodec, runs: Iterator[bytes]) -> tuple[int, str, str]:
    n, ids, text, partial = 0, hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
    for run in runs:
        n += len(run) // 4
        ids.update(run)
        text.update(partial.decode(c.raw(memoryview(run).cast("i"))).encode())
    text.update(partial.decode(b"", True).encode())
    return n, ids.hexdigest(), text.hexdigest()


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row, encoded and decoded in one pass; digests of ids as little-endian 32-bit integers and of the decoded text.

    Null counts as empty. Repeated rows are kept, an empty table gives an empty result. A very long text is held as a text, its ids run by run.
    """
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            data, off = flat(b.column(1))
            for i, j in text_slices(off):
                texts = texts_of(data, off, i, j)
                if len(texts) == 1:
                    got = [_digests(c, c.runs(texts[0]))]
                else:
                    got = [_digests(c, iter([ids])) for ids in c.encode_all(texts)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array([g[k] for g in got]) for k in range(3))], names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
