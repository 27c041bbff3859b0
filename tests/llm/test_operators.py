"""Operators against plain versions, on small tables with nulls, ties, repeated rows, empty and long texts, and columns with clashing names."""

import random
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
import test_near_dedup
from pyspark.sql import functions as F

from squareframe.llm import components, hashed_lr, mixing, quality_bayes, quality_rules, sentencepiece_codec, sharding, simhash, suffix_dedup, token_files, topk, url_filter
from squareframe.llm.queries import PIECES, RULES, TOKENIZER

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, lang string, fp long, key string, size int, block int"
LETTERS = "aeothnr \n.,'–éÉ漢😀\t#|"


def made(n=120, seed=3):
    """Documents with copies, near copies, shared passages, repeated words and odd characters."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdéhorst") for _ in range(rnd.randint(1, 7))) for _ in range(80)]
    passage = " ".join(rnd.choice(vocab) for _ in range(60))
    texts = []
    for i in range(n):
        kind = i % 8
        words = [rnd.choice(vocab) for _ in range(rnd.randint(0, 150))]
        if kind == 1 and texts:
            texts.append(rnd.choice(texts))
            continue
        if kind == 2 and texts:
            w = (rnd.choice(texts) or "a").split(" ")
            w[rnd.randrange(len(w))] = "changed"
            words = w
        if kind == 3:
            words[len(words) // 2:len(words) // 2] = passage.split(" ")
        if kind == 4:
            words = ["tick", "tock"] * rnd.randint(0, 60)
        if kind == 5:
            words = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 50))) for _ in range(8)]
        texts.append(" ".join(words))
    texts[0], texts[7], texts[8] = None, "", "x" * 5000
    return [(i * 3 - 20, t, [None, "b", "a", "é", "z"][i % 5] if i % 3 else "hot", "en", i, "k", i, 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_top_k_equals_brute_force(spark):
    rnd = np.random.default_rng(5)
    vecs = [(i, rnd.integers(-2, 3, 4).astype(float).tolist()) for i in range(-100, 320)]
    vecs += [(5, [1.0, float("nan"), 0.0, 0.0]), (6, None), (7, [None, 1.0, 1.0, 1.0]), (None, [9.0] * 4), (8, [float("inf")] * 4), (9, []), (10, [3.0]), (11, [1.0] * 4), (11, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vecs], "vec_id long, embedding array<double>, shard int")
    for shard_rows in (50, 8192):
        got = topk.top_k(df, F.col("vec_id") % 100 == 0, shard_rows=shard_rows)
        want = brute.top_k([(i, v + [0.0] * (4 - len(v)) if v is not None else None) for i, v in vecs])
        assert sorted(map(tuple, got.collect())) == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_large_numbers(spark):
    vecs = [(i, [1e9 * i, 3.0]) for i in range(5)] + [(100, [2e9, -1.0])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect()}
    exact = lambda a, b: max(-(1 << 63), min((1 << 63) - 1, sum(int(x * 1024) * int(y * 1024) for x, y in zip(a, b))))
    assert got[0, 1][1] == max(exact(vecs[0][1], v) for i, v in vecs if i != 0)
    assert got[100, 1] == (1, (1 << 63) - 1) or got[100, 1][1] == max(exact(vecs[-1][1], v) for i, v in vecs if i != 100)


def test_suffix_dedup_equals_brute_force(spark, docs, rows, empty):
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removed_spans(docs).collect()}
    assert got == brute.dedup([r[:2] for r in rows])
    assert suffix_dedup.removed_spans(empty).count() == 0
    assert suffix_dedup.dedup(docs).columns == docs.columns


def test_suffix_dedup_hot_grams_and_slices(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removed_spans(docs).collect()} == brute.dedup([r[:2] for r in rows])


def test_suffix_dedup_deals_a_hot_gram_to_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefgh"))
    own = ["".join(rng.choice(letters, 70)) for _ in range(400)]
    line = "a passage that stands in every text between others, whole "
    rows = [(i, own[i % 390] + line + own[(i * 7 + i // 390) % 390][:60]) for i in range(400)]
    rows += [(500 + k, rows[k * 9][1][20:] + "x" * k) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.dedup(rows)
    for few in (suffix_dedup.FEW, 2):
        monkeypatch.setattr(suffix_dedup, "FEW", few)
        assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removed_spans(df.repartition(3)).collect()} == want
    anchors = df.select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("mark"), "text").coalesce(1).mapInArrow(suffix_dedup._scan(100, 32), suffix_dedup._ROW)
    by_gram = anchors.where("b > 0").groupBy("kgram").agg(F.count("*").alias("n"), F.count_if(F.col("deal") == F.col("kgram")).alias("here"))
    top = by_gram.orderBy(F.desc("n")).first()
    assert top.n > 300 and top.here == 2


def test_suffix_dedup_repeated_keys(spark):
    rnd = random.Random(11)
    t, u = ("".join(rnd.choice("abcdefgh ") for _ in range(n)) for n in (153, 253))
    df = spark.createDataFrame([(1, t), (1, t), (None, u), (2, u + t), (1, "")], "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.removed_spans(df).collect())
    assert got == [(False, 0, len(u), 0), (True, 1, 0, 0), (True, 1, len(t), 0), (True, 1, len(t), len(t)), (True, 2, len(u + t), len(u + t))]


def test_suffix_sort_orders_and_verifies():
    rnd = random.Random(1)
    data = np.frombuffer("".join(rnd.choice("ab") for _ in range(400)).encode(), np.uint8)
    start = np.array([rnd.randrange(300) for _ in range(200)])
    size = np.array([rnd.randint(0, 60) for _ in range(200)])
    group = np.sort(np.array([rnd.randrange(5) for _ in range(200)]))
    order, lcp = suffix_dedup.suffix_sort(data, start, size, group)
    text = [data[s:s + n].tobytes() for s, n in zip(start, size)]
    assert [text[i] for i in order] == [text[i] for i in sorted(range(200), key=lambda i: (group[i], text[i]))]
    for k in range(1, 200):
        a, b = text[order[k - 1]], text[order[k]]
        if group[k] == group[k - 1]:
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == n


def test_mix_meets_targets(spark, docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    sizes, taken, largest, target = Counter(), Counter(), Counter(), {}
    for r in got:
        assert r.size == len(brute.WORD.findall(text[r.doc_id] or "")) and r.taken == r.copies * r.size <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    want = brute.targets(dict(sizes))
    for s in want:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    assert {tuple(r) for r in mixing.mix(docs.repartition(2)).collect()} == {tuple(r) for r in got}
    assert mixing.mix(empty).count() == 0
    assert sum(r.copies for r in got) == mixing.mixed_rows(docs).count()


def test_mix_by_a_tree_of_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 20)
    monkeypatch.setattr(mixing, "FAN", 3)
    rnd = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(int(rnd.paretovariate(1.1)) % 400)), "hot" if i % 3 else str(i % 7)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    r = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("m")).collect()
    assert len(r) == 8 and all(abs(x.taken - x.target) <= max(3, 0.02 * x.target) for x in r)
    twins = spark.createDataFrame([(1, "a b", "s")] * 7 + [(None, "c", None)] * 3, "doc_id long, text string, source string")
    assert mixing.mixed_rows(twins).count() == mixing.mix(twins).agg(F.sum("copies")).first()[0]


def test_token_files_round_trip(spark, docs, rows, tmp_path, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(TOKENIZER)
    lib = Tokenizer.from_file(path)
    token_files.write_tokens(docs, str(tmp_path / "t"), path)
    index, digests = token_files.read_index(spark, str(tmp_path / "t")), token_files.read_digests(spark, str(tmp_path / "t")).drop("doc_id")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in index.join(digests, ["file", "row"]).collect()}
    assert got == brute.tokens([r[:2] for r in rows], lambda t: lib.encode(t, add_special_tokens=False).ids)
    part = token_files.read_range(spark, str(tmp_path / "t"), -5, 50)
    assert {r.doc_id for r in part.collect()} == {r[0] for r in rows if -5 <= r[0] < 50}
    token_files.write_tokens(empty, str(tmp_path / "e"), path)
    assert token_files.read_index(spark, str(tmp_path / "e")).count() == 0


def test_token_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path(TOKENIZER)
    lib, mine, rnd = Tokenizer.from_file(path), token_files.Encoder(path), random.Random(2)
    texts = ["".join(rnd.choice("aeothn  i\n.,'–éΩÉ漢😀\t 0129<>²İſŉ́ \x1c\x00¼ÑSTLR'") for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    for t in [*texts, "<|endoftext|> a<|startoftext|>B", "i'll DON'T we've ''s", "a b", "w" * 500]:
        assert np.frombuffer(mine.encode(t.encode()), "<i4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_pieces_equal_the_library_and_round_trip(spark, docs):
    import sentencepiece

    path = public_tokenizers.path(PIECES)
    mine, lib, rnd = sentencepiece_codec.Codec.load(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(1)
    texts = ["".join(rnd.choice("aeothn  i\n.,'–éΩ漢😀\t  0129<>²") for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += [" " * n for n in range(40)] + ["a" * n for n in range(40)] + ["the thethethe" * 3, " x ", "\n \n"]
    for t in texts:
        ids = np.frombuffer(mine.encode(t), "<i4").tolist()
        assert ids == lib.encode(t), t
        assert mine.decode(ids) == t
    assert mine.decode(np.frombuffer(mine.encode("a▁b ▁ c▁"), "<i4").tolist()) == "a▁b ▁ c▁"
    r = sentencepiece_codec.round_trip(docs, path).collect()
    assert len(r) == docs.count() and all(x.text_md5 == x.decoded_md5 for x in r)


def test_unigram_pass_is_viterbi():
    rnd = random.Random(6)
    pieces = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 4))) for _ in range(14)} - {"a"}) + ["▁"]
    names = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], *pieces]
    scores = [0.0] * 257 + [-rnd.random() * len(p) ** 0.5 - 0.3 for p in pieces]
    c = sentencepiece_codec.Codec(names, scores, list(range(1, 257)), {0}, merges=False)
    table = dict(zip(pieces, scores[257:]))
    for _ in range(200):
        w = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9)))
        ids, total = c.best_path(w), 0.0
        for i in ids:
            total += scores[i] if i > 256 else sentencepiece_codec.UNKNOWN_SCORE
        assert total == pytest.approx(brute.best_segmentation(w, table, sentencepiece_codec.UNKNOWN_SCORE), rel=1e-9)
        assert c.decode(ids) == w


def test_simhash_equals_brute_force(spark, docs, rows, empty):
    got = sorted((tuple(r) for r in simhash.simhash_groups(docs).collect()), key=str)
    assert got == brute.simhash([r[:2] for r in rows])
    assert simhash.simhash_groups(empty).count() == 0
    extra = [(None, "p q r s"), (4, "p q r s"), (4, "p q r s"), (None, "only null keys here"), (None, "only null keys here")]
    df = spark.createDataFrame(extra, "doc_id long, text string")
    assert sorted((tuple(r) for r in simhash.simhash_groups(df).collect()), key=str) == brute.simhash(extra)
    assert sorted(map(str, (r.doc_id for r in simhash.keep_one(df).collect()))) == ["4", "None"]


def test_simhash_keeps_one_of_each_group(docs, rows):
    want = {c for _, _, c in brute.simhash([r[:2] for r in rows], n=5)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_dense_buckets_go_to_finer_splits(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ROOM", 100)
    rnd = random.Random(8)
    centre = rnd.getrandbits(64)
    fps = {centre} | {centre ^ sum(1 << rnd.randrange(24) for _ in range(2)) for _ in range(250)} | {rnd.getrandbits(64) for _ in range(100)}
    fps = [f - (1 << 64) if f >> 63 else f for f in fps if f < 1 << 64]
    edges = [(r.u, r.v) for r in simhash.close_edges(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    a = np.array(fps, np.int64).view(np.uint64)
    close = [(fps[i], fps[j]) for i in range(len(fps)) for j in range(i) if np.bitwise_count(a[i] ^ a[j]) <= 3]
    assert all(bin((u ^ v) & ((1 << 64) - 1)).count("1") for u, v in edges)
    same = lambda e: {frozenset(k for k, c in m.items() if c == n) for m in [brute.components(e)] for n in set(m.values())}
    assert same(edges) == same(close)
    assert len(edges) < len(fps) * 626  # a forest for each choice of blocks, not all pairs


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2200)]
    df = spark.createDataFrame([*edges, (5, 5), (None, 3)], "u long, v long")
    got = {r.node: r.component for r in components.components(df).collect()}
    assert got == brute.components([e for e in edges if e[0] != e[1]])
    assert components.components(df.limit(0)).count() == 0


def test_url_filter(spark):
    urls = [None, "", "nothing", "http://", "http://EXAMPLE.org/es/1", "https://a.example.org/en/12?x#y", "ftp://b.org", "x://c.com/fr/?q", "http://d.com/de/#z", "http://e.net/a/b?c://d", "org://org/", "http://notexample.org/es/1"]
    pages = [(i, u, "h", "r") for i, u in enumerate(urls)] + [(100 + i, f"http://h{i % 9}.example.{('com', 'net', 'org')[i % 3]}/{('fr', 'de', 'en', 'es')[i % 4]}/{i}", "h", "r") for i in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string, host string, rule string")
    model = url_filter.train(url_filter.parsed(df, RULES))
    got = {r.page_id: r for r in url_filter.url_filter(df, model, RULES).collect()}
    assert len(got) == len(pages)
    for i, u, *_ in pages:
        host, path, best = brute.url(u, RULES)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, best[1] if best else None)
        assert r.verdict == (best[0] if best else "block" if r.blocked >= 0.5 else "allow")
    listed = [(r.blocked >= 0.5) == (r.verdict == "block") for r in got.values() if r.rule and r.page_id >= 100]
    assert sum(listed) / len(listed) > 0.9
    assert url_filter.url_filter(df.limit(0), url_filter.train(url_filter.parsed(df.limit(0), RULES)), RULES).count() == 0


def test_quality_counts_equal_brute_force(docs, rows, empty):
    model = hashed_lr.Model(np.zeros((4, hashed_lr.DIMS)), 0.0)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules.quality_rules(docs, model).collect()}
    for i, t, *_ in rows:
        want = brute.quality_counts(t)
        assert got[i] == (*want, not want[5])
    assert quality_rules.quality_rules(empty, model).count() == 0


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    pairs = labels.join(docs, "doc_id").withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    return docs, pairs, hashed_lr.fit(pairs.where("not held"), "doc_id", "text", F.col("quality"))


def test_classifier_on_held_out_rows(trained):
    docs, pairs, model = trained
    held = quality_bayes.hierarchical_quality(docs, model).join(pairs.where("held").select("doc_id", F.col("quality").alias("label")), "doc_id")
    rows = held.select("kept", "label").collect()
    assert sum(r.kept == (r.label == 1) for r in rows) / len(rows) > 0.95
    assert min(sum(r.kept for r in rows if r.label == 1) / sum(r.label == 1 for r in rows), sum(not r.kept for r in rows if r.label == 0) / sum(r.label == 0 for r in rows)) > 0.9


def test_bayes_shrinks_sparse_sites(spark, trained, empty):
    model = hashed_lr.Model(np.zeros((4, hashed_lr.DIMS)), 0.0)
    docs, _, good = trained
    assert quality_bayes.hierarchical_quality(empty, model).count() == 0
    text = {bool(r.kept): r.text for r in quality_bayes.hierarchical_quality(docs, good).orderBy("quality").collect()}
    rows = [(i, text[True], "fine" if i < 30 else None, "en") for i in range(40)] + [(50 + i, text[False], "poor", "en") for i in range(40)]
    rows += [(200, text[True], "poor", "en"), (201, text[True], "alone", None), (202, None, "alone", None)]
    got = {r.doc_id: r for r in quality_bayes.hierarchical_quality(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), good).collect()}
    assert len(got) == len(rows)
    assert got[200].site_quality < got[201].site_quality < got[0].site_quality
    assert got[200].quality < got[0].quality


def test_fit_without_labels(spark, docs):
    assert hashed_lr.fit(docs.withColumn("y", F.lit(None).cast("int")), "doc_id", "text", F.col("y")).shift == 0.0
    assert hashed_lr.fit(docs, "doc_id", "text", F.lit(1)).shift > 3


def test_shards(spark, docs, rows, empty):
    for n in (1, 8, 9):
        got = sharding.shard(docs, n).collect()
        assert len(got) == len(rows)
        text = {r[0]: r[1] for r in rows}
        size = Counter()
        for r in got:
            b = (text[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32) == (len(b) + 1, zlib.crc32(b))
            size[r.shard] += r["size"]
        for s in size:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        assert max(size.values()) - sum(size.values()) / n <= 5001 and set(size) <= set(range(n))
    assert sharding.shard(empty).count() == 0


def test_shards_of_one_hot_text(spark, tmp_path):
    df = spark.createDataFrame([(i, "same text" if i % 3 else f"t{i}", i % 2) for i in range(3000)], "doc_id long, text string, shard int")
    size = {r.shard: r.n for r in sharding.shard(df).groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    assert max(size.values()) - min(size.values()) <= 20
    sharding.write_shards(df, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r.doc_id, r.text) for r in df.collect()}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    from squareframe.llm import queries

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, steps[-1], SF)
        out.write.parquet(str(tmp_path / str(len(steps))))
        steps.append(spark.read.parquet(str(tmp_path / str(len(steps)))))
    assert all(s.columns == docs.columns for s in steps[:-1])
    table = [{r.doc_id: r for r in s.collect()} for s in steps]
    assert set(table[1]) == {r.doc_id for r in quality_bayes.hierarchical_quality(docs, queries.quality_model(spark, SF, docs)).where("kept").collect()}
    assert sorted(table[2]) == test_near_dedup.kept([(i, r.text) for i, r in table[1].items()])
    want = brute.dedup([(i, r.text) for i, r in table[2].items()])
    assert set(table[3]) == set(want)
    for i, r in table[3].items():
        assert want[i][0] - want[i][1] - 6 * want[i][2] <= len(r.text.encode()) <= want[i][0] - want[i][1] and r.n_chars == len(r.text)
    sizes = Counter()
    for r in table[3].values():
        sizes[r.source] += len(brute.WORD.findall(r.text))
    taken = Counter()
    for r in steps[4].collect():
        assert r == table[3][r.doc_id]
        taken[r.source] += len(brute.WORD.findall(r.text))
    goal = brute.targets(dict(sizes))
    assert all(abs(taken[s] - goal[s]) <= 0.2 * goal[s] + 30 for s in goal)
    last = steps[5].collect()
    assert len(last) == steps[4].count() and all(r.decodes for r in last)


def test_pipeline_keeps_columns_with_clashing_names(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    names = ["quality", "kept", "n_bytes", "kept_text", "mark", "doc", "copies", "size", "fp", "key", "component_id", "site", "taken", "frac", "_n", "text_quality"]
    wide = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names])
    wide = wide.unionByName(wide.limit(1)).unionByName(wide.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")}))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n}:{r.doc_id}" for r in rows for n in names if r.doc_id is not None), name
    assert {"ids", "n_tokens", "decodes", "doc_id"} <= set(corpus_pipeline.STAGES[-1][1](spark, wide, SF).columns)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def thue_morse(n, a="a", b="b"):
    """A word of n letters and its complement: polynomials modulo 2**64 of any odd base agree on them from 2,048 letters on."""
    word = "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))
    return word, word.translate(str.maketrans(a + b, b + a))


def test_quality_counts_of_texts_whose_hashes_agree(spark):
    x, y = thue_morse(2048)
    texts = [f"{x}\n{y}", f"{x}\n{y}\n{x}", f"{x} one two {y} one two", f"{x} one two {x} one two", "\n".join([x, y] * 3)]
    model = hashed_lr.Model(np.zeros((4, hashed_lr.DIMS)), 0.0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(docs, model).collect()}
    assert got == {i: brute.quality_counts(t) for i, t in enumerate(texts)} and got[0][3] == 0


def test_token_files_in_the_order_of_their_numbers(spark, tmp_path, docs, rows, monkeypatch):
    """Starts follow the numbers in file names, not their letters: part-100000 comes after part-99999; and files are bounded."""
    import os
    import re

    from tokenizers import Tokenizer

    path = public_tokenizers.path(TOKENIZER)
    monkeypatch.setattr(token_files, "ROWS_IN_FILE", 7)
    token_files.write_tokens(docs, str(tmp_path / "t"), path)
    names = sorted(n for n in os.listdir(tmp_path / "t") if n.startswith("part-"))
    assert len(names) > 8
    shift = 99_998  # the first tasks become part-99998, part-99999, the others part-100000 and so on
    for n in names:
        moved = re.sub(r"^part-(\d+)", lambda m: f"part-{int(m[1]) + shift:05d}", n)
        os.rename(tmp_path / "t" / n, tmp_path / "t" / moved)
        if os.path.exists(tmp_path / "t" / f".{n}.crc"):
            os.rename(tmp_path / "t" / f".{n}.crc", tmp_path / "t" / f".{moved}.crc")
    lib = Tokenizer.from_file(path)
    want = brute.tokens([r[:2] for r in rows], lambda t: lib.encode(t, add_special_tokens=False).ids)
    assert {r.doc_id: (r.start, r.n_tokens) for r in token_files.read_index(spark, str(tmp_path / "t")).collect()} == {k: v[:2] for k, v in want.items()}


def test_token_files_hold_what_the_writer_promises(docs, tmp_path):
    import glob

    import pyarrow.parquet as pq

    token_files.write_tokens(docs, str(tmp_path / "t"), public_tokenizers.path(TOKENIZER))
    for f in glob.glob(str(tmp_path / "t" / "part-*.parquet")):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            cols = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            tokens = next(v for k, v in cols.items() if k.startswith("tokens"))
            assert tokens.has_offset_index and tokens.has_column_index and tokens.compression == "ZSTD"
            assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED", "PLAIN_DICTIONARY"} & set(tokens.encodings)
            assert cols["doc_id"].statistics.has_min_max


def test_another_tokenizer_is_refused():
    with pytest.raises(ValueError):
        token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_mixed_rows_keep_columns_with_made_names(spark):
    names = ["_key", "_mark", "_source", "_copies", "_twins", "_own", "_own_mark", "_own_source", "_copy", "_m", "_s", "mark", "copies"]
    df = spark.createDataFrame([(i, "w " * (i + 1), "s") for i in range(30)] * 2, "doc_id long, text string, source string")
    wide = df.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    got = mixing.mixed_rows(wide)
    assert got.columns == wide.columns and all(r[n] == f"{n}{r.doc_id}" for r in got.collect() for n in names)
    assert got.count() == mixing.mixed_rows(df).count()


def test_ranges_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_IN_RANGE", 20)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.pmod(F.col("id"), F.lit(9)).cast("int")).alias("text"))
    size = {r.shard: r.n for r in sharding.shard(df).groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    assert max(size.values()) - min(size.values()) <= 20


def test_words_are_remembered_up_to_a_limit():
    import public_tokenizers

    from squareframe.llm import token_files

    made = []
    kept = token_files._Remembered(lambda k: made.append(k) or k * 2, 2)
    assert [kept[k] for k in ("a", "b", "a", "c", "a")] == ["aa", "bb", "aa", "cc", "aa"] and made == ["a", "b", "c", "a"] and len(kept) == 2
    long = "x" * (token_files.LONGEST_KEPT + 1)
    assert kept[long] == long * 2 and long not in kept
    encoder = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("Plain words IT'S don't a1b2", "straße Ünï ſharp x\x00y \x7f", "<|endoftext|> a<|b", "", "日本  x", "K İx"):
        want = encoder.library.encode(text, add_special_tokens=False).ids
        assert memoryview(encoder.encode(text.encode())).cast("i").tolist() == want, text
