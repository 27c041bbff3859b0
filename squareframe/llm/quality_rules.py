"""Quality rules: counted rules of a text, then a calibrated logistic regression on hashed n-grams against a fixed threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .flat import Prefix, flat, mixed, slices, words
from .hashed_lr import Model

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_FROM = 0.5
#: Bytes that are compared at a time.
COMPARE = 1 << 20
#: Characters that count as symbols; a fixed value.
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_LEADS = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def _repeats(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which items have an equal one, and which have an equal earlier one."""
    n = len(keys[0])
    order = np.lexsort((np.arange(n), *keys))
    same = np.ones(max(0, n - 1), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    later, twice = np.zeros(n, bool), np.zeros(n, bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: Prefix) -> np.ndarray:
    """A number for each substring, equal where and only where the bytes are.

    Substrings are sorted by a hash; each is compared byte by byte with the first of its hash, and if any differs, all are numbered by their bytes.
    """
    sizes = ends - starts
    hashes, first, number = np.unique(mixed(prefix.hash(starts, ends) + sizes.astype(np.uint64)), return_index=True, return_inverse=True)
    like = first[number]
    other = np.flatnonzero(like != np.arange(len(starts)))
    good = bool((sizes[other] == sizes[like[other]]).all())
    at = 0
    while good and at < len(other):  # about COMPARE bytes at a time
        end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[other[at:at + COMPARE]]), COMPARE)) + at)
        part = other[at:end]
        n = sizes[part]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        good = bool((data[np.repeat(starts[part], n) + step] == data[np.repeat(starts[like[part]], n) + step]).all())
        at = end
    if good:
        return number
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(data[i:j].tobytes(), len(known)) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)


def counts(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The five counts of each text of a slice. Words and lines are told apart by their bytes, windows by the numbers of their words."""
    n = len(off) - 1
    starts, ends, of = words(data, off)
    n_words = np.diff(of)
    leads = np.concatenate([[0], np.cumsum(_LEADS[data], dtype=np.int64)])
    chars = np.concatenate([[0], np.cumsum(leads[ends] - leads[starts])])
    one = Prefix(data)
    text_of_word = np.repeat(np.arange(n), n_words)
    a = numbered(data, starts, ends, one)
    # windows of three words
    m = max(0, len(a) - 2)
    inside = text_of_word[:m] == text_of_word[2:]
    pos = np.flatnonzero(inside)
    if int(a.max(initial=0)) < 1 << 21:
        window = [a[pos] << 42 | a[pos + 1] << 21 | a[pos + 2]]
    else:
        window = [a[pos], a[pos + 1], a[pos + 2]]
    twice, _ = _repeats([*window, text_of_word[pos]])
    covered = np.zeros(len(a), bool)
    for k in range(3):
        covered[pos[twice] + k] = True
    repeat = np.bincount(text_of_word[covered], minlength=n)
    # lines with a word
    breaks = np.flatnonzero(data == 10)
    begins = np.union1d(off[:-1], breaks + 1)
    begins = begins[begins < len(data)]
    stops = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, begins)], off[np.searchsorted(off, begins, "right")]) if len(begins) else begins
    worded = np.searchsorted(starts, begins) < np.searchsorted(starts, stops)
    begins, stops = begins[worded], stops[worded]
    text_of_line = np.searchsorted(off, begins, "right") - 1
    _, later = _repeats([numbered(data, begins, stops, one), text_of_line])
    dup = np.bincount(text_of_line[later], minlength=n)
    return [n_words, chars[of[1:]] - chars[of[:-1]], _per_text(_IS_SYMBOL[data], off), dup, repeat]


def quality_rules(docs: DataFrame, model: Model, text: str = "text", threshold: float = KEEP_FROM) -> DataFrame:
    """``docs`` with the five counts, ``base_failed``, ``quality`` (calibrated probability) and ``kept``.

    A null text has no words, so it fails. Empty tables give empty results; repeated rows are judged alike; a probability equal to the threshold is kept.
    Columns of these names in ``docs`` are replaced. Texts are read whole, a slice at a time.
    """
    new = [*NAMES, "base_failed", "quality", "kept"]
    names = [c for c in docs.columns if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat(b.column(text))
            got = [np.zeros(len(off) - 1, np.int64) for _ in NAMES]
            for i, j in slices(off):
                for out, x in zip(got, counts(data[off[i]:off[j]], off[i:j + 1] - off[i]), strict=True):
                    out[i:j] = x
            p = 1 / (1 + np.exp(-np.clip(model.logit(b.column(text)), -40, 40)))
            failed = (got[0] < MIN_WORDS) | (100 * got[4] > MAX_REPEAT_PERCENT * got[0])
            cols = [pa.array(x.astype(np.int64)) for x in got] + [pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + cols, [*names, *new])

    fields = docs.select(*names).schema
    for c in NAMES:
        fields = fields.add(c, "long")
    fields = fields.add("base_failed", "boolean").add("quality", "double").add("kept", "boolean")
    return docs.select(*names).mapInArrow(run, fields)
