"""Pieces of words: the pass without scores gives what the pass with scores gives, and frequent words outlive the end of a memory."""

import random

import public_tokenizers
import pytest

from squareframe.llm import queries
from squareframe.llm import sentencepiece_codec as S


@pytest.fixture(scope="module")
def codec():
    return S.Codec.load(public_tokenizers.path(queries.PIECES))


def test_words_have_the_pieces_of_the_pass_with_scores(codec, monkeypatch):
    rng = random.Random(3)
    parts = ["th", "er", "tion", "ing", "ß", "é", "ll", "1", "22", ".", ",", "s", "un", "ness", "ment", "qx", "中", "ö"]
    words = [S.MARK + "".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(4000)]
    plain = [codec._merged_path(w) if codec.letters.issuperset(w) else None for w in words]
    monkeypatch.setattr(codec, "letters", set())  # nothing is in it: every word takes the other way
    assert sum(p is not None for p in plain) > 2000
    assert all(p is None or p == codec.best_path(w) for p, w in zip(plain, words))


def test_frequent_words_are_cut_once_however_many_others_pass(codec, monkeypatch):
    monkeypatch.setattr(S, "WORDS_KEPT", 40)
    monkeypatch.setattr(S, "SEGMENTS_KEPT", 40)
    seen, path = [], codec.best_path
    monkeypatch.setattr(codec, "best_path", lambda w: seen.append(w) or path(w))
    codec.forget()
    for k in range(100):
        codec.encode("often " + " ".join("qz" + "abcdefghij"[k // 10] + "abcdefghij"[k % 10] + c for c in "lmnop"))
    assert seen.count(S.MARK + "often") == 1
    codec.forget()
