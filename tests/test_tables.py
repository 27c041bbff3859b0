import pytest
from pyspark.sql import functions as F

from squareframe.operators import labels as L
from squareframe.operators import models as M
from squareframe.operators import quality as Q
from squareframe.operators import splits as P
from squareframe.operators import tables as D
from squareframe.operators import tags as G
from squareframe.plans import jobs as J
from squareframe.sources import readers as R
from squareframe.sources import store as W


def test_tag_parsing(spark):
    rows = [(1, "Sicilian_Defense Sicilian_Defense_Najdorf_Variation"), (2, "Ruy_Lopez_Berlin_Defense"), (3, "Kings_Indian_Defense"), (4, None), (5, ""),
            (6, "Queens_Gambit_Declined"), (7, "McDonnellGambit"), (8, "French_Defense_Advance_Variation")]
    df = spark.createDataFrame(rows, "id int, tag string")
    p = {r["id"]: r for r in G.parsed_tags(df, "id", "tag").collect()}
    assert p[1]["n_tags"] == 2 and p[1]["parts"] == ["sicilian", "defense"]
    assert p[2]["parts"] == ["ruy_lopez", "berlin", "defense"] and p[4]["parts"] == [] and p[5]["n_tags"] == 0
    assert p[7]["parts"] == ["mc", "donnell", "gambit"]
    fam = dict(G.parsed_tags(df, "id", "tag").select("id", G.standard_family(F.col("parts"))).collect())
    assert fam[3] == "kings_indian" and fam[6] == "queens_gambit" and fam[4] == "unknown"
    var = {r["id"]: r["variation"] for r in G.parsed_tags(df, "id", "tag").select("id", *[c.alias(n) for n, c in G.variation_columns(F.col("parts")).items()]).collect()}
    assert var[8] == "french_defense" and var[2] == "ruy_lopez_berlin_defense"
    prim = dict(df.select("id", L.primary_family(F.col("tag"))).collect())
    assert prim[2] == "Ruy" and prim[4] == "Unknown"


def test_splits_are_exact_disjoint_and_repeatable(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, "a").otherwise("b").alias("label"), F.timestamp_seconds(F.lit(5)).alias("ts"))
    a = dict(P.stratified_split(df, "label", "id").select("id", "is_test").collect())
    b = dict(P.stratified_split(df.repartition(9), "label", "id").select("id", "is_test").collect())
    assert a == b and sum(a.values()) == 200 and sum(v for k, v in a.items() if k < 700) == 140
    t = dict(P.time_split(df, "ts", "id").select("id", "is_test").collect())  # one timestamp for all rows
    assert all(t[i] == (1 if i >= 800 else 0) for i in range(1000))
    w = P.expanding_windows(P.time_folds(df, "ts", "id")).groupBy("split", "role").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).collect()
    edge = {(r["split"], r["role"]): (r["lo"], r["hi"]) for r in w}
    assert all(edge[(i, "train")][1] < edge[(i, "validate")][0] for i in range(4))


def test_stage_is_reused_only_for_the_same_input(spark):
    root, calls = W.new_folder(spark, "t"), []

    def compute(df):
        calls.append(1)
        return df.withColumn("y", F.col("id") + 1)

    a, b = spark.range(10), spark.range(11)
    W.stage_or_compute(a, root, "s", compute)
    assert W.stage_or_compute(spark.range(10).repartition(3), root, "s", compute).count() == 10 and len(calls) == 1
    assert W.stage_or_compute(b, root, "s", compute).count() == 11 and len(calls) == 2
    assert W.load_step(spark, root, "s").count() == 11


def test_validation(spark):
    df = spark.createDataFrame([("1", None), ("2", None), ("3", 5)], "puzzle_id string, rating int")
    with pytest.raises(Q.ValidationError):
        Q.require_columns(df.drop("rating"), ["puzzle_id", "rating"])
    Q.require_columns(df.drop("rating"), ["puzzle_id", "rating"], is_train=False)
    with pytest.raises(Q.ValidationError):
        Q.require_complete(df, ["rating"])


def test_csv_round_trip_with_full_schema(spark):
    import os

    schema = R.puzzle_schema()
    row = ["a1", "8/8/8/8/8/8/8/8 w - - 0 1", "e2e4", 1500, 80, 90, 10, "fork, \"pin\"", "u", None] + [0.5] * 22
    path = os.path.join(W.new_folder(spark, "csv"), "p")
    spark.createDataFrame([row], schema).write.option("header", True).option("escape", '"').csv(path)
    back = R.read_csv(spark, path, schema, ["puzzle_id", "rating", "themes", "success_prob_blitz_2050"]).first()
    assert back["rating"] == 1500 and back["themes"] == 'fork, "pin"' and back["success_prob_blitz_2050"] == 0.5
    assert len(schema.fields) == 32


def test_similar_book_matches_brute_force(spark):
    import random

    from squareframe.operators import boards as B

    rnd = random.Random(5)
    base = [[rnd.choice("PNBRQKpnbrqk......") for _ in range(64)] for _ in range(30)]
    near = []
    for cells in base:
        for changes in (0, 3, 9, 10, 14):
            c = list(cells)
            for s in rnd.sample(range(64), changes):
                c[s] = "." if c[s] != "." else "P"
            near.append("".join(c))
    rows = B.sets_from_cells(spark.createDataFrame(list(enumerate(near)), "id int, cells string"))
    book = B.sets_from_cells(spark.createDataFrame([(f"b{i:02d}", "".join(c)) for i, c in enumerate(base)], "name string, cells string"))
    got = {r["id"]: (r["book_name"], r["similarity"]) for r in L.similar_book(rows, book, "id").collect()}
    want = {}
    for i, c in enumerate(near):
        best = min((sum(x != y for x, y in zip(c, b)), f"b{j:02d}") for j, b in enumerate(base))
        if 1 - best[0] / 64 > 0.85:
            want[i] = (best[1], 1 - best[0] / 64)
    assert got == want


def test_align_keeps_all_keys_and_renames_clashes(spark):
    a = spark.createDataFrame([(1, 5), (2, 6)], "k int, x int")
    b = spark.createDataFrame([(2, 7), (3, 8)], "k int, x int")
    got = {r["k"]: (r["x_a"], r["x_b"]) for r in D.align({"a": a, "b": b}, "k").collect()}
    assert got == {1: (5, 0), 2: (6, 7), 3: (0, 8)}


def test_regressors_beat_the_mean_and_ranges_combine(spark):
    df = spark.range(600).select("id", (F.col("id") % 37).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b")).withColumn(
        "rating", 600 + 50 * F.col("a") + 20 * F.col("b"))
    sd = df.agg(F.stddev_pop("rating")).first()[0]
    oof, models = M.out_of_fold(df, "id", "linear", ["a", "b"], "rating", 3)
    assert oof.count() == 600 and len(models) == 3 and M.log_rmse(oof, "rating") < 0.1 * sd
    stack = M.build_stack(df, "id", "rating", ["a", "b"], bases=("linear", "forest"), meta="linear", k=2, forest={"numTrees": 5})
    assert M.log_rmse(stack.predict(df), "rating") < 0.5 * sd
    ranges = M.RangeModels("linear", ["a", "b"], least_rows=50).fit(df, "rating")
    assert len(ranges.models) >= 3 and M.log_rmse(ranges.predict(df), "rating") < 0.5 * sd


def test_missing_tags_are_predicted_and_originals_kept(spark):
    df = spark.range(400).select("id", (F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 4 >= 2).cast("double").alias("z"))
    name = F.concat(F.when(F.col("x") == 0, "Ruy").otherwise("Slav"), F.lit("_"), F.when(F.col("z") == 0, "Long").otherwise("Short"))
    df = df.withColumn("tag", F.when(F.col("id") < 300, name).otherwise("")).withColumn("truth", name)
    out = M.predict_missing(df, "id", "tag", L.primary_family(F.col("tag")), L.variation(F.col("tag")), ["x", "z"], trees=5, depth=3)
    rows = out.join(df.select("id", "truth"), "id").collect()
    assert len(rows) == 400 and all(r["predicted_family"] == r["truth"] for r in rows)
    assert all(r["prediction_confidence"] == 1.0 for r in rows if r["id"] < 300)


def test_header_fields_on_a_stream(spark, tmp_path):
    """Row-local operators take a streaming frame unchanged."""
    from squareframe.operators import boards as B

    spark.createDataFrame([(1, "8/8/8/8/8/8/8/K6k b - - 3 9")], "id int, fen string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, fen string").parquet(str(tmp_path / "in"))
    q = B.decode_positions(stream).select("id", "white_to_move", "fullmove_number").writeStream.format("memory").queryName("hdr").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("hdr").collect()[0][1:] == (0, 9)
    assert J.DEFAULTS["moves"] == ""
