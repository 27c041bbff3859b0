"""SentencePiece encoding and decoding on Spark: an Aho-Corasick automaton over the pieces drives one pass over a word, relaxing the best score at each position
along the output links.

For a unigram model every piece is admissible and the pass is Viterbi's. For a BPE model a piece may follow the best one only if merging in rank order would leave
the border between the two in place; then exactly one path reaches each position that the merges would leave as an end, and the result is that of the merges.
A blank is written U+2581 in front of the word after it, as in the model. Characters without a piece become byte pieces, and so does a literal U+2581, so
decoding gives back every text exactly.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .flat import flat, give_back

MARK = "▁"
#: Segments, words and pairs of pieces that a Python worker remembers at most, and their length; beyond, it starts anew. About 200 MB in all.
SEGMENTS_KEPT, WORDS_KEPT, BORDERS_KEPT, LONGEST_KEPT = 300_000, 300_000, 600_000, 48
UNKNOWN_SCORE = -1e12
_RUN = re.compile(r"(?=.)( *)([^ ]*)", re.DOTALL)


def _letter(c: str) -> bool:
    return c.isalnum() and not c.isdecimal()


class Codec:
    """Pieces, scores and kinds of a vocabulary; ``merges`` says that scores are ranks of merges."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], special: set[int], merges: bool):
        self.pieces, self.scores, self.byte_ids, self.merges = pieces, scores, byte_ids, merges
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special and i not in set(byte_ids)}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.borders: dict[int, bool] = {}
        self.follow: list[dict[int, bool]] = [{} for _ in pieces]  # for each piece: what was tried behind it
        self.followed = 0
        self.letters = {p for p in self.ids if len(p) == 1}
        self.known: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # words of the memory before, so that frequent ones outlive its end
        self.machine = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if (p.strip(MARK) or p == MARK) and (not merges or self._reachable(p)):  # runs of marks have a rule of their own
                self.machine.add_word(p, (i, len(p), self.follow[i]))
        self.machine.make_automaton()
        self.anything = dict.fromkeys(self.ids.values(), True)  # what may stand at the start of a word
        self.runs = sorted((len(p) for p in self.ids if not p.strip(MARK)), reverse=True)
        self.decoded = [p.replace(MARK, " ").encode() for p in pieces]
        for n, i in enumerate(byte_ids):
            self.decoded[i] = bytes([n])
        for i in special:
            self.decoded[i] = b""
        # no piece joins a letter to anything else, but for these characters; so runs of letters with the blanks before them stand alone
        odd = {c for p in self.ids for x, y in zip(p.lstrip(MARK), p.lstrip(MARK)[1:]) for c in (x, y) if _letter(x) != _letter(y)}
        odd |= {c for p in self.ids if MARK in p.lstrip(MARK) for c in p}
        letter = r"[^\W\d_" + re.escape("".join(sorted(odd))) + "]"
        other = r"[\W\d_" + re.escape("".join(sorted(odd))) + "]"
        self.split = re.compile(f" *+{letter}++|(?:(?! ){other}| ++(?!{letter}))++").findall
        self.one = re.compile(f"{letter}++").fullmatch

    @classmethod
    def load(cls, path: str) -> Codec:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {i for i in range(n) if sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)}
        if len(set(byte_ids)) < 256 or not all(sp.is_byte(i) for i in byte_ids):
            raise ValueError("a model with byte pieces is needed: other characters could not be decoded")
        scores = [sp.get_score(i) for i in range(n)]
        ranks = sum(float(s).is_integer() for s in scores) == n
        return cls([sp.id_to_piece(i) for i in range(n)], scores, byte_ids, special, ranks)

    # merges

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The last merge that makes a piece, when its characters are merged in rank order; None for a character, or where merges end elsewhere."""
        if piece not in self.halves:
            parts = list(piece)
            while len(parts) > 2:
                best = max(range(len(parts) - 1), key=lambda k: (self.scores[self.ids[parts[k] + parts[k + 1]]] if parts[k] + parts[k + 1] in self.ids else -1e18, -k))
                if parts[best] + parts[best + 1] not in self.ids:
                    break
                parts[best:best + 2] = [parts[best] + parts[best + 1]]
            self.halves[piece] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[piece]

    def _reachable(self, piece: str) -> bool:
        return len(piece) == 1 or (self._halves(piece) is not None and self._border_stands(*self._halves(piece), self.scores[self.ids[piece]]))

    def _border_stands(self, left: str, right: str, until: float = -1e18) -> bool:
        """Whether merging ``left`` + ``right`` in rank order keeps their border, as far as merges of a rank over ``until`` go.

        Walks back in time: the later made of the two neighbours is taken apart on the side of the border, and at each moment the two neighbours must not be a pair
        that would merge before either of them grows.
        """
        rank = lambda p: self.scores[self.ids[p]] if len(p) > 1 else 1e18  # noqa: E731  when a piece was made; characters at the start
        end = until  # the pair stood side by side until a merge of this score
        strict = True  # at the same score: does the other merge come first
        while True:
            both = left + right
            if both in self.ids:
                s = self.scores[self.ids[both]]
                if s > end or (s == end and not strict):
                    return False
            a, b = rank(left), rank(right)
            if len(left) == 1 and len(right) == 1:
                return True
            if a < b:  # left was made last; among equals the one further left goes first
                half = self._halves(left)
                if half is None:
                    return False
                end, strict, left = a, True, half[1]
            else:
                half = self._halves(right)
                if half is None:
                    return False
                end, strict, right = b, False, half[0]

    def _admissible(self, i: int, j: int) -> bool:
        key = i << 20 | j
        got = self.borders.get(key)
        if got is None:
            if len(self.borders) > BORDERS_KEPT:
                self.borders.clear()
            got = self.borders[key] = self._border_stands(self.pieces[i], self.pieces[j])
        return got

    # encoding

    def _merged_path(self, word: str) -> list[int]:
        """``best_path`` for merges and a word whose characters all have a piece: only one path reaches a position, so no score is kept, but what may follow its last piece."""
        n = len(word)
        after: list[dict[int, bool] | None] = [None] * (n + 1)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        after[0] = self.anything
        for end, (i, size, follow) in self.machine.iter(word):
            s = end + 1 - size
            may = after[s]
            if may is None:
                continue
            ok = may.get(i)
            if ok is None:
                ok = may[i] = self._border_stands(self.pieces[last[s]], self.pieces[i])
                self.followed += 1
            if ok:
                end += 1
                after[end], last[end], start[end] = follow, i, s
        if self.followed > BORDERS_KEPT:
            self._unfollow()
        out: list[int] = []
        while n:
            out.append(last[n])
            n = start[n]
        out.reverse()
        return out

    def _unfollow(self) -> None:
        for tried in self.follow:
            tried.clear()
        self.followed = 0

    def best_path(self, word: str) -> list[int]:
        """Pieces of a string without runs of marks. Position e keeps the best score of a path that ends there, its last piece and where that starts."""
        if self.merges and self.letters.issuperset(word):
            return self._merged_path(word)
        n = len(word)
        score, last, start = [None] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        score[0] = 0.0
        merges, known, scores, admissible = self.merges, self.borders.get, self.scores, self._admissible
        strange = [e for e in range(1, n + 1) if word[e - 1] not in self.ids]

        def unknown(e: int) -> None:
            """A character without a piece: its bytes, unless a piece that ends there is better."""
            if score[e - 1] is not None and (score[e] is None or score[e - 1] + UNKNOWN_SCORE > score[e]):
                score[e], last[e], start[e] = score[e - 1] + UNKNOWN_SCORE, -1, e - 1

        for end, (i, size, _) in self.machine.iter(word):
            while strange and strange[0] <= end:
                unknown(strange.pop(0))
            e = end + 1
            s = e - size
            before = score[s]
            if before is None:
                continue
            if merges and (p := last[s]) >= 0:
                ok = known(p << 20 | i)
                if ok is False or (ok is None and not admissible(p, i)):
                    continue
            before += scores[i]
            if score[e] is None or before > score[e]:
                score[e], last[e], start[e] = before, i, s
        for e in strange:
            unknown(e)
        out: list[int] = []
        e = n
        while e:
            if last[e] >= 0:
                out.append(last[e])
            else:
                out.extend(self.byte_ids[b] for b in reversed(word[start[e]:e].encode()))
            e = start[e]
        out.reverse()
        return out

    def _word(self, word: str) -> list[int]:
        """A word in which marks are literal, except for one in front."""
        out: list[int] = []
        for n, part in enumerate(word.split(MARK) if not word.startswith(MARK) else [word[:1] + word[1:].split(MARK)[0], *word[1:].split(MARK)[1:]]):
            out += ([self.byte_ids[b] for b in MARK.encode()] if n else []) + (self.best_path(part) if part else [])
        return out

    def _blanks(self, n: int) -> list[int]:
        """A run of blanks as the longest pieces from the left."""
        out: list[int] = []
        for size in self.runs:
            out += [self.ids[MARK * size]] * (n // size)
            n %= size
        return out

    def _segment(self, text: str) -> list[int]:
        """Any text, without the blank that the model puts in front. The last blank before a word belongs to it if a piece joins them."""
        if MARK not in text and " " not in text[1:]:
            return self.best_path(MARK + text[1:] if text[0] == " " else text)
        ids: list[int] = []
        at = 0
        for m in _RUN.finditer(text):
            blanks, word = m.end(1) - m.start(1), m[2]
            at = m.end()
            if not blanks:
                ids += self._first(word)
            elif not word or word[0] == MARK:
                ids += self._blanks(blanks) + (self._first(word) if word else [])
            else:
                own = self._word(MARK + word)
                ids += self._blanks(blanks) + own[1:] if own[0] == self.ids.get(MARK) else self._blanks(blanks - 1) + own
        assert at == len(text)
        return ids

    def _first(self, word: str) -> list[int]:
        return self._word(word) if not word.startswith(MARK) else [self.byte_ids[b] for b in MARK.encode()] + self._first(word[1:]) if word else []

    def _segments(self, text: str) -> list[bytes]:
        segments = self.split(text)
        out = list(map(self.known.get, segments))
        if None in out:
            if len(self.known) > SEGMENTS_KEPT:
                self.known.clear()
            for n, got in enumerate(out):
                if got is None:
                    s = segments[n]
                    out[n] = array("i", self._segment(s)).tobytes()
                    if len(s) <= LONGEST_KEPT:
                        self.known[s] = out[n]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as 32-bit integers; nothing for an empty text. The model puts a blank in front."""
        if not text:
            return b""
        parts = text.split(" ")
        if "" in parts:  # runs of blanks
            return b"".join(self._segments(" " + text))
        out = list(map(self.chunks.get, parts))
        if None in out:
            if len(self.chunks) > WORDS_KEPT // 2:
                self.older, self.chunks = self.chunks, {}
            older = self.older.get
            for n, got in enumerate(out):
                if got is None:
                    if (got := older(parts[n])) is not None:
                        out[n] = self.chunks[parts[n]] = got
                        continue
                    # letters alone are one segment, which needs no second entry among the segments
                    out[n] = array("i", self.best_path(MARK + parts[n])).tobytes() if self.one(parts[n]) else b"".join(self._segments(" " + parts[n]))
                    if len(parts[n]) <= LONGEST_KEPT:
                        self.chunks[parts[n]] = out[n]
        return b"".join(out)

    def forget(self) -> None:
        for memory in (self.known, self.chunks, self.older, self.borders):
            memory.clear()
        self._unfollow()

    def decode(self, ids) -> str:
        """The text of ids; the blank in front is dropped."""
        raw = b"".join(map(self.decoded.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec.load(path)
    return _codecs[path]


def _lists(ids: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """(list array, sizes) of encoded texts."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4"))), pa.array(sizes)


def encode_pieces(docs: DataFrame, path: str, text: str = "text", decoded: str | None = None, remember: bool = True) -> DataFrame:
    """``docs`` without the text column, with ``ids`` (array of int) and ``n_tokens``. A null text has no ids. Columns of these names are replaced.

    ``decoded`` names a column for the MD5 digest of what the ids decode to, made in the same pass. Without ``remember`` a task gives its memory of words back when it ends.
    """
    new = ["ids", "n_tokens", *([decoded] if decoded else [])]
    names = [c for c in docs.columns if c != text and c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            data, off = flat(b.column(text))
            view = memoryview(data)
            for i in range(0, b.num_rows, 64):
                j = min(i + 64, b.num_rows)
                ids = [c.encode(str(view[x:y], "utf-8")) for x, y in zip(off[i:j].tolist(), off[i + 1:j + 1].tolist(), strict=True)]
                digest = [pa.array([hashlib.md5(c.decode(array("i", x)).encode()).hexdigest() for x in ids], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*(b.column(n).slice(i, j - i) for n in names), *_lists(ids), *digest], [*names, *new])
        if not remember:
            c.forget()
            give_back()

    fields = docs.select(*names).schema.add("ids", ArrayType(IntegerType())).add("n_tokens", "long")
    return docs.select(*names, text).mapInArrow(run, fields.add(decoded, "string") if decoded else fields)


def decode_pieces(rows: DataFrame, path: str, name: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ``ids``; null ids give an empty text."""
    names = [c for c in rows.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            lists = b.column("ids")
            values, at, sizes = lists.values.to_numpy(), lists.offsets.to_numpy(), lists.value_lengths().fill_null(0).to_numpy()
            texts = [c.decode(values[i:i + n].tolist()) for i, n in zip(at[:-1].tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(texts, pa.string())], [*names, name])

    return rows.select(*names).mapInArrow(run, rows.select(*names).schema.add(name, "string"))


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, text_md5, decoded_md5): the digests agree for every text. Repeated rows are kept; an empty table gives an empty result."""
    t = docs.select(F.col(key), F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("text_md5"), F.col(text))
    return encode_pieces(t, path, text, "decoded_md5").select(key, "n_tokens", "ids", "text_md5", "decoded_md5")
