from pyspark.sql import functions as F

from squareframe.operators import moves as M
from squareframe.operators import plies as Y

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
F5 = "r1bqkbnr/pppp1ppp/2n5/4p3/4P3/5N2/PPPP1PPP/RNBQKB1R w KQkq - 2 3"


def _replay(spark, *rows):
    return Y.replay(spark.createDataFrame([(i, f, m) for i, (f, m) in enumerate(rows)], "id int, fen string, moves string"), "id")


def _end(plies):
    from squareframe.operators.boards import placement_from_cells

    return {r["id"]: r["p"] for r in plies.groupBy("id").agg(F.max_by(placement_from_cells(F.col("cells")), "ply").alias("p")).collect()}


def test_replay_golden_lines(spark):
    plies = _replay(spark, (START, "e2e4 e7e5 g1f3 b8c6 f1b5"), (F5, "f1b5 g8f6 e1g1"), (START, "e2e4 c7c5 g1f3 d7d6 d2d4 c5d4"))
    end = _end(plies)
    assert end[0] == "r1bqkbnr/pppp1ppp/2n5/1B2p3/4P3/5N2/PPPP1PPP/RNBQK2R"
    assert end[1] == "r1bqkb1r/pppp1ppp/2n2n2/1B2p3/4P3/5N2/PPPP1PPP/RNBQ1RK1"
    counts = {r["id"]: r for r in Y.sequence_counts(plies, "id").collect()}
    assert (counts[2]["n_moves"], counts[2]["move_captures_count"], counts[2]["move_checks_count"]) == (6, 1, 0)
    last = Y.with_material_change(plies).filter("id = 2 and ply = 6").first()
    assert (last["balance"], last["captured"]) == (-1, "P")
    assert plies.filter("id = 1 and ply = 3").first()["castling"] == "K"


def test_special_moves(spark):
    plies = _replay(
        spark,
        ("4k3/8/8/4pP2/8/8/8/4K3 w - e6 0 1", "f5e6"),  # takes beside the target
        ("4k3/P7/8/8/8/8/8/4K3 w - - 0 1", "a7a8q e8e7"),
        ("r3k3/8/8/8/8/8/8/4K3 b q - 0 1", "e8c8"),
        (START, "e2e5 e7e5 e1e2 xx99 d1h5"))
    end = _end(plies)
    assert end[0] == "4k3/8/4P3/8/8/8/8/4K3"
    assert end[1] == "Q7/4k3/8/8/8/8/8/4K3"
    assert end[2] == "2kr4/8/8/8/8/8/8/4K3"
    checks = {(r["id"], r["ply"]): r["gives_check"] for r in Y.with_checks(plies).collect()}
    assert checks[(1, 1)] == 1
    flags = {r["ply"]: (r["playable"], r["follows"]) for r in plies.filter("id = 3").collect()}
    assert flags == {1: (1, True), 2: (1, True), 3: (1, True), 4: (0, False), 5: (1, False)}


def test_transpositions_share_a_signature(spark):
    plies = _replay(spark, (START, "e2e4 e7e5 g1f3 b8c6 f1b5 a7a6"), (START, "g1f3 b8c6 e2e4 e7e5 f1b5 a7a6"))
    sig = {(r["id"], r["n"]): r["signature"] for r in Y.signatures(plies, "id").collect()}
    assert sig[(0, 3)] == sig[(1, 3)] and sig[(0, 6)] == sig[(0, 3)]


def test_patterns_and_castling(spark):
    df = spark.createDataFrame([(1, "e4 e5 Nf3 Nc6 Bc4 Bc5 O-O Nf6 d3 O-O"), (2, None), (3, ""), (4, "d4 d5 c4 e6 Nc3 c6 O-O-O")], "id int, moves string")
    t = df.select("id", M.tokens(M.plain_castling(F.col("moves"))).alias("t"), M.tokens(F.col("moves")).alias("r"))
    eco = {r["id"]: r for r in t.select("id", *[c.alias(n) for n, c in M.eco_columns(F.col("t")).items()]).collect()}
    assert eco[1]["eco_C_Italian"] == 1 and eco[1]["eco_C_Open_Game"] == 0 and eco[4]["eco_D_Semi_Slav"] == 1
    assert all(v == 0 for k, v in eco[2].asDict().items() if k != "id")
    castle = {r["id"]: r for r in t.select("id", *[c.alias(n) for n, c in M.castling_columns(F.col("r")).items()]).collect()}
    assert castle[1]["white_kingside_castle"] == 1 and castle[1]["black_kingside_castle"] == 1
    assert castle[4]["white_queenside_castle"] == 1 and castle[4]["white_kingside_castle"] == 0
    best = {r["id"]: r for r in M.longest_pattern(df, "id", "moves").collect()}
    assert best[1]["moves_inferred_family"] == "Italian_Game" and abs(best[1]["moves_match_confidence"] - 0.95) < 1e-9 and 3 not in best


def test_replay_folds_once_and_in_linear_time(spark):
    import time

    games = spark.createDataFrame([(1, START, "e2e4 e7e5"), (2, START, None), (3, START, "")], "id int, fen string, moves string")
    plan = Y.replay(games, "id").where("ply > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and not any("aggregate(" in line for line in plan.split("\n") if "Filter" in line)
    assert {r["id"] for r in Y.replay(games, "id").collect()} == {1}
    cost = {}
    for plies in (200, 400):
        moves = " ".join(["g1f3", "g8f6", "f3g1", "f6g8"] * (plies // 4))
        rows = Y.replay(spark.range(400).select("id", F.lit(START).alias("fen"), F.lit(moves).alias("moves")), "id")
        assert rows.count() == 400 * plies
        best = []
        for _ in range(3):
            t = time.time()
            rows.write.format("noop").mode("overwrite").save()
            best.append(time.time() - t)
        cost[plies] = min(best)
    assert cost[400] < 2.6 * cost[200]  # 2 and some noise; copying all states at each ply would tend to 4
