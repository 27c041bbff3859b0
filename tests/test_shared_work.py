"""Shared folder, stages keyed by settings, exact medians, prefix sums, predicted tags, models fitted twice in one session."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from squareframe import session
from squareframe.operators import models as M
from squareframe.operators import plies as Y
from squareframe.operators import splits as P
from squareframe.plans import jobs as J


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return self.folder

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    Session.sparkContext.folder = None
    with pytest.raises(RuntimeError):
        session.shared_folder(Session)
    Session.sparkContext.folder = "hdfs://x/y"
    assert session.shared_folder(Session) == "hdfs://x/y"


def test_exact_median_and_prefix_sums(spark):
    rnd = random.Random(1)
    for n in (0, 1, 2, 7, 500):
        values = [rnd.choice([1.5, 2.0, rnd.random() * 9]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        assert P.exact_median(df, "v").first()[0] == (pytest.approx(statistics.median(values)) if n else None)
    rows = [(i, rnd.randint(0, 5)) for i in range(300)]
    got = {r.k: r.before for r in P.with_sum_before(spark.createDataFrame(rows, "k int, n long").repartition(5), ["k"], "n", "before").collect()}
    assert all(got[k] == sum(m for j, m in rows if j < k) for k, _ in rows)


def test_stages_follow_their_settings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "complete_features", lambda df, key, flag=0: df.withColumn("flag", F.lit(flag)))
    rows = spark.createDataFrame([("a",), ("b",)], "puzzle_id string")
    assert [J.staged_features(rows, str(tmp_path), flag=f).first().flag for f in (0, 1, 0)] == [0, 1, 0]
    monkeypatch.setattr(J, "complete_features", lambda df, key, flag=0: df.withColumn("flag", F.lit(9)))
    assert J.staged_features(rows, str(tmp_path), flag=1).first().flag == 1
    monkeypatch.setattr(J, "FEATURE_VERSION", 99)
    assert J.staged_features(rows, str(tmp_path), flag=1).first().flag == 9


def test_predicted_tags_count_once_and_listed_names_come_first(spark):
    rows = [(str(i), "Sicilian_Defense (predicted)") for i in range(30)] + [(str(100 + i), "Rare_Game") for i in range(21)] + [("x", None)]
    df = spark.createDataFrame(rows, "puzzle_id string, opening_tags string")
    got = {r.puzzle_id: r for r in J.opening_features(df, "puzzle_id").collect()}
    assert got["0"].opening_num_tags == 1 and got["x"].opening_num_tags == 0
    vocabulary = spark.createDataFrame([("Rare_Game",)], "tag string")
    listed = J.opening_features(df, "puzzle_id", families=1, vocabulary=vocabulary)
    assert {r.puzzle_id: r for r in listed.collect()}["0"].opening_num_tags == 0
    assert len([c for c in listed.columns if c.startswith("open_fam_")]) == 1


def test_label_models_twice_in_one_session(spark):
    rows = spark.createDataFrame([(i, float(i % 10), int(i % 10 > 4)) for i in range(400)], "k int, x double, y int")
    for _ in range(2):
        models, scores = M.fit_label_models(rows, "k", ["y"], ["x"])
        assert scores == [("y", 1.0, "kept")] and not models["y"].stages[-1].hasSummary


def test_replay_of_long_games(spark):
    moves = " ".join(["g1f3", "g8f6", "f3g1", "f6g8"] * 60)
    start = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
    rows = Y.replay(spark.createDataFrame([("a", start, moves)], "k string, fen string, moves string"), "k")
    got = rows.agg(F.count("*"), F.sum("playable"), F.max("ply")).first()
    assert tuple(got) == (240, 240, 240)
    assert rows.where("ply % 4 = 0").select("cells").distinct().count() == 1


def test_shared_values_are_worked_on_once(spark, monkeypatch):
    fens = ["rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1", "4k3/8/8/8/8/8/8/4K2R w - - 0 1", None]
    rows = [(str(i), fens[i % 3], ["e2e4 e7e5", "h1h8"][i % 2], "a b", "Ruy_Lopez", ["e4 e5", "d4"][i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "puzzle_id string, fen string, moves string, themes string, opening_tags string, line string")
    seen = {}
    for owner, name in ((J, "position_features"), (J, "move_features"), (J.Y, "replay")):
        def counted(rows, key, *rest, _f=getattr(owner, name), _n=name):
            seen[_n] = rows.count()
            return _f(rows, key, *rest)
        monkeypatch.setattr(owner, name, counted)
    got = J.complete_features(df, "puzzle_id", infer_tags=False, text_vectors=False)
    assert seen == {"position_features": 3, "move_features": 2, "replay": 6}
    assert got.count() == 60 and got.drop("puzzle_id").distinct().count() == 6
    assert {(r.total_material, r.n_moves, r.opening_num_tags) for r in got.collect()} == {(78, 2, 1), (78, 1, 1), (5, 2, 1), (5, 1, 1), (0, 2, 1), (0, 1, 1)}


def test_rows_of_a_value_are_read_without_the_others(spark):
    rows = spark.createDataFrame([(i, ["a", "2024", "", None][i % 4]) for i in range(40)], "k int, v string")
    parts = M.split_rows(rows, "v", ["2024", "a"])
    assert [{r.v for r in p.collect()} for p in parts] == [{"2024"}, {"a"}] and [p.count() for p in parts] == [10, 10]
    assert all("PartitionFilters: [isnotnull(_part" in p._jdf.queryExecution().executedPlan().toString() for p in parts)


def test_a_list_is_replayed_once_for_all_its_games(spark):
    start = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
    lists = [(start, "e2e4 e7e5"), (None, "e2e4"), (start, None)]
    games = spark.createDataFrame([(i, *lists[i % 3]) for i in range(30)], "k int, fen string, moves string")
    seen = []

    def work(rows, at):
        seen.append(rows.count())
        return Y.replay(rows, at)

    shared = Y.per_list(games, "k", work)
    assert seen == [3]
    plain = Y.replay(games, "k")
    assert sorted(map(str, shared.select(*plain.columns).collect())) == sorted(map(str, plain.collect())) and shared.count() == 30


def test_facts_of_a_first_move_come_from_one_row_per_list(spark, monkeypatch):
    rows = [("a", "4k3/8/8/8/8/8/8/R3K3 w - - 0 1", "a1a8 e8e7 a8a7 z9z9"), ("b", "4k3/P7/8/8/8/8/8/4K3 w - - 0 1", "a7a8q"), ("c", None, "e2e4 e7e5"), ("d", None, "")]
    seen, checks = [], Y.with_checks
    monkeypatch.setattr(Y, "with_checks", lambda plies: seen.append(plies.count()) or checks(plies))
    got = Y.suggested_move_facts(spark.createDataFrame(rows, "k string, fen string, moves string"), "k", "fen", "moves")
    assert {tuple(r) for r in got.collect()} == {("a", 0, 1, 0, "R", 2), ("b", 0, 1, 1, "P", 0), ("c", 0, 0, 0, "", 0)}
    assert seen == [3]
