"""Byte-level BPE by the trie walk against the tokenizers library, and its round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from squareframe.llm import bpe_trie, queries

PATH = public_tokenizers.path(queries.BYTE_PAIRS)
LETTERS = [*"aaaabbbeeettthhh  \n\t'sdlrevm1290_-.<|>", " ", "é", "ü", "▁", "日", "🙂", "́", "ᲊ", "²", "Ⅷ", "٣", " ", "\x85", "\x1c", "ǅ", "<|endoftext|>", "the", " '"]


def _random_texts(n=4000):
    rnd = random.Random(5)
    return ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 60))) for _ in range(n)] + [
        "", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "a" * 3000, " " * 2000, "ab" * 3000, "".join(map(chr, range(0x20, 0x2100)))]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _ids(raw):
    return np.frombuffer(raw, "<i4").tolist()


@pytest.mark.parametrize("plain", [False, True])
def test_ids_are_those_of_the_library(plain):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = plain
    codec, texts = bpe_trie.TrieCodec(PATH, plain), _random_texts()
    for text, got, want in zip(texts, codec.encode_all(texts), tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert _ids(got) == want.ids
        assert codec.decode(_ids(got)) == text == (tokenizer.decode(want.ids, skip_special_tokens=False))


def test_the_walk_equals_merging_in_rank_order():
    """Against plain merges, one at a time, of words that share prefixes."""
    codec, rnd = bpe_trie.codec(PATH), random.Random(1)

    def merged(word):
        parts = [codec.ids[bytes([b])] for b in word]
        while len(parts) > 1:
            rank, k = min((codec.rank.get(parts[k] << 32 | parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[k:k + 2] = [codec.ids[codec.bytes[parts[k]] + codec.bytes[parts[k + 1]]]]
        return parts

    words = {bytes(rnd.choice(b"aabehinorst ") for _ in range(rnd.randint(1, 14))) for _ in range(1500)}
    words |= {w[:k] for w in words for k in range(1, len(w))}
    order = sorted(words)
    assert [_ids(x) for x in codec.walk(order)] == [merged(w) for w in order]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe_trie, "WORDS_KEPT", 50)
    monkeypatch.setattr(bpe_trie, "PAIRS_KEPT", 20)
    monkeypatch.setattr(bpe_trie, "SLICE", 40)
    monkeypatch.setattr(bpe_trie, "WORDS_AT_ONCE", 7)
    codec, tokenizer, texts = bpe_trie.TrieCodec(PATH), Tokenizer.from_file(PATH), _random_texts(400)
    for _ in range(2):
        assert [_ids(x) for x in codec.encode_all(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert len(codec.pairs) <= 20


def test_round_trip_of_odd_rows(spark, library):
    long = "Nulla dies sine linea. " * 60_000
    rows = [(1, None, 5), (2, "", 6), (3, "one two", 7), (3, "one two", 7), (None, "three<|endoftext|>", 8), (4, long, 9), (5, "żółć 日本 ▁ " * 9, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe_trie.round_trip(docs, PATH).collect()
    assert len(got) == len(rows)
    for r, (key, text, _) in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.n_tokens)), sorted(rows, key=lambda r: (r[0] or 0, len(r[1] or ""))), strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens) == (key, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe_trie.round_trip(docs.where("false"), PATH).count() == 0
    coded = bpe_trie.encode(docs.withColumn("extra", F.lit(1)), PATH)
    assert coded.columns == ["doc_id", "extra", "ids", "n_tokens"]
    back = {(r.doc_id, r.decoded) for r in bpe_trie.decode(coded, PATH).collect()}
    assert back == {(k, t or "") for k, t, _ in rows}
    assert bpe_trie.decode(coded.withColumn("ids", F.lit(None).cast("array<int>")), PATH).select("decoded").distinct().first().decoded == ""


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe_trie.TrieCodec(public_tokenizers.path(queries.TOKENIZER))
