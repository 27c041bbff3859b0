"""Alignment of two tokenizers against plain loops over the libraries' ids."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from squareframe.llm import alignment, queries
from squareframe.llm.bpe_trie import BYTE_OF_LETTER

A, B = public_tokenizers.path(queries.BYTE_PAIRS), public_tokenizers.path(queries.PIECES)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def _tokens(libraries, text):
    a, b = libraries
    want = (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(BYTE_OF_LETTER[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return [], [], [], []
    return ids_a, np.cumsum([*map(len, bytes_a)]).tolist(), ids_b, np.cumsum([*map(len, bytes_b)]).tolist()


def _brute(libraries, texts):
    """All contract columns by all pairs of spans, one text after another."""
    rows, counts = [], Counter()
    for text in texts:
        ids_a, ends_a, ids_b, ends_b = _tokens(libraries, text or "")
        starts_a, starts_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
        links = [(ids_a[i], ids_b[j]) for i in range(len(ids_a)) for j in range(len(ids_b)) if starts_a[i] < ends_b[j] and starts_b[j] < ends_a[i]]
        common = sorted(set(ends_a) & set(ends_b))
        groups = []
        for low, high in zip([0, *common], common, strict=False):
            side = lambda ids, ends: ",".join(str(i) for i, e in zip(ids, ends, strict=True) if low < e <= high)  # noqa: B023, E731
            groups.append(side(ids_a, ends_a) + "|" + side(ids_b, ends_b))
        rows.append((len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
        counts.update(links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(na, nb, g, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest) for na, nb, g, links, digest in rows]


def _texts():
    rnd = random.Random(2)
    words = ["the", "tokenizer", "aligns", "Straße", "日本語", "🙂", "ﬁn", "x<|endoftext|>y", "<s>", "123,456", "é", " ", "<0x41>", "zażółć", "\t", "\n\n", "  "]
    return [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 25))) for _ in range(120)] + [None, "", " ", "a", "a", "one ▁ two", "  lead", "same text twice"] * 2


def test_runs_and_links_of_random_ends():
    rnd = random.Random(4)
    for _ in range(300):
        total = rnd.randint(1, 80)
        a, b = (sorted({*rnd.sample(range(1, total + 1), rnd.randint(0, total)), total}) for _ in "ab")
        if rnd.random() < 0.4:  # long one-to-one stretches with a few differences
            b = sorted(set(a) ^ set(rnd.sample(range(1, total), min(3, total - 1))) | {total}) if total > 1 else a
        last_a, last_b, i, j = alignment.align(np.array(a), np.array(b))
        common = sorted(set(a) & set(b))
        assert last_a.tolist() == [a.index(e) for e in common] and last_b.tolist() == [b.index(e) for e in common]
        want = {(p, q) for p in range(len(a)) for q in range(len(b)) if ([0, *a][p] < b[q]) and ([0, *b][q] < a[p])}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)


def test_columns_against_plain_loops(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 600)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(alignment, "PAIRS_IN_ROW", 10)
    texts = _texts()
    docs = spark.createDataFrame([(i if i else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, block int").repartition(3)
    got = {r.doc_id or 0: r for r in alignment.aligned(docs, A, B).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(_brute(libraries, texts)):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want, texts[i]
    assert alignment.aligned(docs.where("false"), A, B).count() == 0


def test_long_texts_and_repeated_rows(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "LONG_TEXT", 50)
    long = " ".join(["Über den Wolken", "the quick brown fox"] * 40)
    docs = spark.createDataFrame([(1, long), (1, long), (2, long + " ▁")], "doc_id int, text string")
    got = sorted(tuple(r)[1:] for r in alignment.aligned(docs, A, B).collect())
    assert got == sorted(_brute(libraries, [long, long, long + " ▁"])) and got[0] == (0, 0, 0, 0, 0, 0, "")
    assert alignment.aligned(docs, A, B).schema["doc_id"].dataType.simpleString() == "int"
