"""Rows and long tables are never broadcast however small Spark guesses them; sets of values are joined whole; vectors are made once."""

import pytest
from pyspark.sql import functions as F

from squareframe.operators import labels as L
from squareframe.operators import models as M
from squareframe.operators import tables as D
from squareframe.plans import job_queries as Q
from squareframe.plans import jobs as J


@pytest.fixture
def eager(spark):
    """Spark takes every table for small."""
    plain = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 40))
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", plain)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]


def test_parts_meet_orders_in_an_exchange(eager):
    assert "SortMergeJoin [_p#" in _plan(Q.puzzles(eager, "/root/testdata/sf0.001"))


def test_features_are_not_broadcast_to_their_rows(eager, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "complete_features", lambda df, key: df.select(key, F.lit(1).alias("n")))
    rows = eager.createDataFrame([(str(i), "f", "m", i) for i in range(20)], "puzzle_id string, fen string, moves string, rating int")
    train, test = J.data_job(rows.filter("rating % 2 = 0"), rows.filter("rating % 2 = 1").drop("rating"), str(tmp_path))
    assert "SortMergeJoin [puzzle_id#" in _plan(train) and "Broadcast" not in _plan(train)
    assert train.count() == test.count() == 10


def test_neither_rows_nor_many_values_are_broadcast(eager, monkeypatch):
    rows = eager.createDataFrame([(i, None if i % 3 == 0 else f"t{i % 3}") for i in range(30)], "k int, t string")
    got, values = D.with_value_ids(rows, ["t"], "_at")
    assert "BuildLeft" not in _plan(got)
    monkeypatch.setattr(D, "MANY", 2)
    got, values = D.with_value_ids(rows, ["t"], "_at")
    assert "Broadcast" not in _plan(got)
    ids = {r.t: r._at for r in values.collect()}
    assert len(ids) == 3 and sorted((r.k, r.t, r._at) for r in got.collect()) == sorted((r.k, r.t, ids[r.t]) for r in rows.collect())


def test_sets_travel_as_one_column_each(eager, monkeypatch):
    rows = eager.createDataFrame([("x", 1, 5, 0.5), ("y", 2, 6, None), ("z", 1, 9, 1.5)], "id string, a int, b int, own double")
    one = eager.createDataFrame([(1, 10, 11.0, "p"), (2, None, float("nan"), None)], "a int, m int, n double, s string")
    two = eager.createDataFrame([(5, 7, 8), (6, 70, 80)], "b int, m int, o int")
    monkeypatch.setattr(D, "MANY", 1)
    monkeypatch.setattr(D, "SMALL", 8 * 2 * 2)
    got = D.attach(rows, [("one", one, "a"), ("mine", ["own"], "id"), ("two", two, "b")], "id", {"a": 2, "b": 2})
    assert got.columns == ["id", "m_one", "n", "s", "own", "m_two", "o"]
    assert sorted(map(tuple, got.collect())) == [("x", 10, 11.0, "p", 0.5, 7, 8), ("y", 0, 0.0, None, 0.0, 70, 80), ("z", 10, 11.0, "p", 1.5, 0, 0)]
    plan = _plan(got)
    assert plan.count("SortMergeJoin [a#") == 1 and plan.count("BroadcastHashJoin [b#") == 1  # three numbers a row are too many here, two are not
    assert plan.index("BroadcastHashJoin [b#") < plan.index("SortMergeJoin [a#")  # the exchange comes first


def test_themes_count_as_often_as_they_stand(spark):
    values = spark.createDataFrame([(1, "mate fork"), (2, "mate pin"), (3, "rare")], "_theme int, _t string")
    rows = spark.createDataFrame([(i, 1 if i < 4 else 2 if i < 8 else 3) for i in range(9)], "id int, _theme int")
    got = J.theme_values(rows, values, least=4)
    assert {"theme_mate", "theme_fork", "theme_pin"} <= set(got.columns) and "theme_rare" not in got.columns
    assert {r._theme: (r.theme_mate, r.theme_fork, r.theme_count) for r in got.collect()} == {1: (1, 1, 2), 2: (1, 0, 2), 3: (0, 0, 1)}


def test_evidence_of_lines_counts_rows(spark):
    lines = spark.createDataFrame([(1, "e4 c5 Nf3"), (2, "d4 d5 c4")], "_line int, line string")
    rows = spark.createDataFrame([(i, 1 if i < 6 else 2, "Sicilian_Najdorf" if i < 4 else "" if i < 6 else "Slav") for i in range(10)], "id int, _line int, opening_tags string")
    per_row = rows.join(lines, "_line").withColumn("_line", F.col("id") + 100)  # each row a line of its own
    want = J.pattern_evidence(per_row, per_row.select("_line", "line"), "id").collect()
    assert sorted(map(tuple, J.pattern_evidence(rows, lines, "id").collect())) == sorted(map(tuple, want))
    mapped = L.pattern_mapping(spark.createDataFrame([(1, "p")], "_line int, pattern_id string"), spark.createDataFrame([(1, "f", "v", 7)], "_line int, family string, variation string, n int"),
                               "_line", times=F.col("n")).collect()
    assert [tuple(r) for r in mapped] == [("p", "f", "v")]


def test_vectors_of_an_inference_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return float(x)
    rows = spark.createDataFrame([(i, ("" if i % 5 == 0 else ("A_x", "A_y", "B_x", "B_y")[i % 4]), i % 4) for i in range(100)], "id int, tag string, v int")
    got = M.predict_missing(rows.withColumn("x", F.udf(counted, "double").asNondeterministic()("v")), "id", "tag", L.primary_family(F.col("tag")), L.variation(F.col("tag")), ["x"],
                            tags=rows.select("id", "tag"), trees=5, depth=3).collect()
    assert seen.value == 100
    assert all(r.predicted_family == ("A_x", "A_y", "B_x", "B_y")[r.id % 4] for r in got) and len(got) == 100
