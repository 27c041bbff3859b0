"""Token ids as Parquet list columns: encoding in Arrow batches, files in key order with controlled row groups, pages and integer encoding, selective reads.

Files are written by Spark's Parquet writer: version 2 pages (ids that don't pay for a dictionary are delta-packed), page indexes, and row groups of a set size, so
a reader of ``n_tokens`` touches no token page and a reader of a key range skips row groups and pages.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .flat import flat

END_ID = 1
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
#: Texts in a file at most, so that a running sum over one file is bounded.
ROWS_IN_FILE = 1 << 20
#: Words, and runs of letters or signs, that a Python worker remembers at most; beyond, it starts anew. Longer ones than LONGEST_KEPT are not kept.
WORDS_KEPT, RUNS_KEPT, LONGEST_KEPT = 600_000, 400_000, 64
#: ASCII and the composed Latin letters: no form changes under NFC, lower-casing goes letter by letter.
_LETTERS = "\u00df-\u00f6\u00f8-\u012f\u0131-\u017f"
_PLAIN = re.compile(f"[\x21-\x7e\u00c0-\u00d6\u00d8-\u00de{_LETTERS}]*+").fullmatch
#: The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100.
_KEPT = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LETTER = {b: b for b in _KEPT} | {b: 256 + n for n, b in enumerate(sorted({*range(256)} - _KEPT))}

#: How the tokenizer that the shortcuts below stand for prepares a text.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

_tokenizers: dict[str, Encoder] = {}


class Encoder:
    """A tokenizers file behind a memory of words.

    It needs a byte-level tokenizer that drops white space and splits by the pattern of ``word_bpe_49k``: a text's ids are those of its words in turn, and a word's
    are those of its runs. Words are looked up; new ones are split into runs, and new runs go to the library's model. Words with other characters than ``_PLAIN``,
    or with the brackets of special tokens, go through the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        kind = json.loads(self.library.to_str())
        if kind["normalizer"] != NORMALIZER or kind["pre_tokenizer"] != PRE_TOKENIZER or kind["model"]["type"] != "BPE":
            raise ValueError(f"{path} doesn't split texts as word_bpe_49k does")
        self.model = self.library.model
        self.words: dict[bytes, bytes] = _Remembered(self._word, WORDS_KEPT)
        self.runs: dict[str, bytes] = _Remembered(self._run, RUNS_KEPT)
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LETTERS}]+|[0-9]|[^a-z0-9{_LETTERS}]+").findall

    def _run(self, run: str) -> bytes:
        spelled = run if run.isascii() else run.encode().decode("latin-1").translate(_BYTE_LETTER)
        return array("i", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if text.isascii() and text.isalpha():  # one run
            return self.runs[text.lower()]
        if "<|" not in text and (text.isascii() and text.isprintable() or _PLAIN(text)):
            return b"".join(map(self.runs.__getitem__, self.split(text.lower())))
        return array("i", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: bytes) -> bytes:
        """Ids of a text as 32-bit integers. Blanks 0x20 and 0x09 to 0x0D part words; other white space stays inside and is the library's matter."""
        return b"".join(map(self.words.__getitem__, text.split()))


class _Remembered(dict):
    """Values of ``make`` by key, ``most`` at once: beyond, the memory starts anew. Only a missing key costs a call from Python."""

    def __init__(self, make: Callable, most: int):
        self.make, self.most = make, most

    def __missing__(self, key):
        got = self.make(key)
        if len(self) >= self.most:
            self.clear()
        if len(key) <= LONGEST_KEPT:
            self[key] = got
        return got


def _encoder(path: str) -> Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """(key, n_tokens, tokens): ids of each whole text and ``end_id``; null counts as empty. ``path`` is a tokenizers file on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(path), np.array([end_id], "<i4").tobytes()
        for b in batches:
            data, off = flat(b.column(1))
            view = memoryview(data)
            i, n = 0, len(off) - 1
            while i < n:
                j = max(i + 1, min(n, int(np.searchsorted(off, off[i] + (1 << 20), "right")) - 1))
                ids = [encoder.encode(bytes(view[x:y])) for x, y in zip(off[i:j].tolist(), off[i + 1:j + 1].tolist(), strict=True)]
                sizes = np.fromiter(map(len, ids), np.int64, j - i) // 4 + 1
                values = pa.array(np.frombuffer(end.join([*ids, b""]), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(sizes), lists], [key, "n_tokens", "tokens"])
                i = j

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens long, tokens array<int>")


def write_tokens(docs: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Encode ``docs`` and write them to ``folder`` in ascending key order (null keys first; equal keys by a hash of their text)."""
    mark = F.xxhash64(text)
    ordered = docs.select(key, text, mark.alias("_mark")).repartitionByRange(F.col(key), F.col("_mark")).sortWithinPartitions(key, "_mark")
    (encode(ordered, path, key, text, end_id).write.mode("overwrite")
     .option("parquet.writer.version", "v2").option("parquet.enable.dictionary#n_tokens", "true").option("parquet.block.size", str(ROW_GROUP_BYTES))
     .option("parquet.page.size", str(PAGE_BYTES)).option("parquet.page.write-checksum.enabled", "true").option("maxRecordsPerFile", str(ROWS_IN_FILE)).option("compression", "zstd").parquet(folder))


def read_index(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, start, file, row): where each text lies in the whole stream of ids. Reads no token page.

    Places inside a file come from a running sum per file, whose rows the writer bounds; files are summed to a row each before their own running sum. Files stand in the
    order of the two numbers in their names (task, and file of the task), which is that of the keys.
    """
    rows = spark.read.parquet(folder).select(key, "n_tokens", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("_all"))
    number = lambda pattern: F.coalesce(F.regexp_extract("file", pattern, 1).try_cast("long"), F.lit(0))
    line = Window.orderBy(number(r"^part-(\d+)"), number(r"-c(\d+)\."), "file").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("file", F.coalesce(F.sum("_all").over(line), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(before, "file").select(key, "n_tokens", (F.col("_before") + F.col("_inside")).alias("start"), "file", "row")


def read_digests(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, file, row, ids_crc32) from the token pages: checksum of each text's ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            values = np.asarray(lists.values).astype("<u4", copy=False).tobytes()
            at = lists.offsets.to_numpy()
            crc = pa.array([zlib.crc32(values[4 * i:4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), crc], [key, "file", "row", "ids_crc32"])

    rows = spark.read.parquet(folder).select(key, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), "tokens")
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {kind}, file string, row long, ids_crc32 long")


def read_range(spark: SparkSession, folder: str, low: int, high: int, key: str = "doc_id") -> DataFrame:
    """Ids of the texts with low <= key < high; row groups and pages of other keys are skipped by their statistics."""
    return spark.read.parquet(folder).where((F.col(key) >= low) & (F.col(key) < high))
