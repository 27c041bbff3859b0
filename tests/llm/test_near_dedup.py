"""The near-dedup stage against all pairs by exact similarity of five-word shingles."""

import random

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def kept(rows):
    """Smallest key of each group; keys are distinct and not null."""
    rows = sorted(rows)
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            both = len(a & b)
            if 5 * both >= 4 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted({rows[find(i)][0] for i in range(len(rows))})


def stage(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect())


def near_texts(seed=5):
    """Bases with copies at similarities around 0.8, a common line in most texts, short, empty and repeated texts."""
    rnd, texts = random.Random(seed), [None, "", " \n", "one", "ONE", "a b c d e", "A b  c\td e", "a b c d f"]
    line = [f"line{i}" for i in range(30)]
    for _ in range(12):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(40, 200))]
        texts.append(" ".join(base))
        for changes in (0, 1, 1, 2, 3, 4, 5):
            w = list(base)
            for _ in range(changes):
                w[rnd.randrange(len(w))] = "changed"
            texts.append(" ".join(line + w if rnd.random() < 0.6 else w))
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)]


def test_stage_finds_every_pair_of_similarity_four_fifths(spark):
    rows = near_texts()
    assert stage(spark, rows) == kept(rows)
    assert stage(spark, []) == []


def test_stage_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert stage(spark, rows) == kept(rows)


def test_similarity_at_the_border(spark):
    """Eight of ten shingles are shared in the first pair (four fifths), 7 of 9 in the second."""
    a = [f"x{i}" for i in range(13)]
    assert stage(spark, [(1, " ".join(a[:12])), (2, " ".join(a[:12] + ["y", "z"]))]) == [1]
    assert stage(spark, [(1, " ".join(a[:11])), (2, " ".join(a[:11] + ["y", "z"]))]) == [1, 2]

@pytest.mark.parametrize("times", [200, 2000])
def test_one_dominant_word_does_not_make_copies(spark, times):
    rows = [(i, " ".join([f"{c}{k}" for k in range(100)] + ["pad"] * times)) for i, c in enumerate("ab")]
    assert stage(spark, rows) == [0, 1]
    assert stage(spark, [*rows, (2, rows[0][1] + " pad")]) == [0, 1]


def test_texts_whose_polynomials_agree_are_told_apart(spark):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"t{i}" for i in range(9))
    rows = [(1, word), (2, other), (3, f"{word} {tail}"), (4, f"{other} {tail}"), (5, word)]
    assert stage(spark, rows) == kept(rows) == [1, 2, 3, 4]


def test_columns_with_clashing_names_and_long_texts(spark):
    from squareframe.llm import near_dedup

    long = " ".join(f"w{i % 997} v{i}" for i in range(60_000))
    rows = [(1, long, 1, 2, 3), (2, long + " more", 4, 5, 6), (None, "alone", 7, 8, 9), (3, "", 1, 1, 1), (4, None, 1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int, head_key int, nid int")
    kept_rows = near_dedup.keep_one(docs)
    assert kept_rows.columns == docs.columns
    assert {tuple(r) for r in kept_rows.collect()} == {rows[0], rows[2], rows[3]}


def test_pairs_meet_once_and_only_where_their_sketches_allow_it():
    """60 nodes of far sketches under one frequent shingle make no row; two alike that share 40 neighbouring shingles make one."""
    import numpy as np
    import pyarrow as pa

    from squareframe.llm import near_dedup as N

    bits = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, (60, N.SKETCH))

    def made(rows):
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(6)]
        batch = pa.RecordBatch.from_arrays([*cols, pa.array([bits[r[6]].tolist() for r in rows], pa.list_(pa.int64()))], ["s", "n", "nid", "g", "i", "p", "sketch"])
        return [p for b in N._meet(iter([batch])) for p in zip(*(c.to_pylist() for c in b.columns))]

    assert made([(5, 300, k, k, 0, 5, k) for k in range(60)]) == []
    assert made([(s, 300, k, k, s, max(s - 1, 0), 0) for s in range(40) for k in (1, 2)]) == [(2, 1)]
    assert sorted(made([(s, 300, k, k, s, 100 * k + s, 0) for s in range(2) for k in (1, 2)])) == [(2, 1)]


def test_shuffle_files_of_a_step_go_with_it(spark, monkeypatch):
    """While stages run Spark removes what a finished step shuffled; the session's own setting comes back."""
    seen, name = [], "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.set(name, "false")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", lambda spark, docs, sf: (seen.append(spark.conf.get(name)), docs)[1])])
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert seen == ["true"] and spark.conf.get(name) == "false"
