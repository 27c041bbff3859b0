"""Golden boards: values worked out by hand or by a separate small calculation."""

import pytest

from squareframe.operators import attacks as A
from squareframe.operators import boards as B
from squareframe.operators import endgames as E
from squareframe.plans import jobs as J

FENS = [
    "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1",
    "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq e3 0 1",
    "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq e6 0 2",
    "rnbqkbnr/pppp1ppp/8/4p3/4P3/5N2/PPPP1PPP/RNBQKB1R b KQkq - 1 2",
    "r1bqkbnr/pppp1ppp/2n5/4p3/4P3/5N2/PPPP1PPP/RNBQKB1R w KQkq - 2 3",
    "q3k1nr/1pp1nQpp/3p4/1P2p3/4P3/B1PP1b2/B5PP/5K2 b k - 0 17",
    "r6k/pp2r2p/4Rp1Q/3p4/8/1N1P2R1/PqP2bPP/7K b - - 0 24",
    "r1bq1rk1/ppp2ppp/2np1n2/1B2p3/4P3/2P2N2/PP1P1PPP/RNBQR1K1 w - - 0 8",
    "2r3k1/2r4p/4p1p1/1p1q1pP1/p1bP1P1Q/P6R/5B2/2R3K1 b - - 5 34",
    "8/5k2/8/3P4/8/2K5/8/8 w - - 0 1",
    "4k3/8/8/8/4r3/8/4N3/4K3 w - - 0 1",
    "8/2k5/p1p5/8/P1P5/2K5/8/8 b - - 0 40",
]
# n, balance, total, endgame
TOTALS = [(32, 0, 78, 0)] * 5 + [(22, -8, 50, 0), (20, 0, 54, 0), (31, 3, 75, 0), (20, -2, 54, 0), (3, 1, 1, 1), (4, -2, 8, 1), (6, 0, 4, 1)]
# doubled, isolated, islands, chains, longest, members, centre, passed, zone, shield, open files, safety, king attackers, pins, discovered
WHITE = [
    (0, 0, 1, 0, 0, 0, 0, 0, 0, 3, 0, 6, 0, 0, 0), (0, 0, 1, 0, 0, 0, 1, 0, 0, 2, 0, 4, 0, 0, 0), (0, 0, 1, 0, 0, 0, 1, 0, 0, 2, 0, 4, 0, 0, 0),
    (0, 0, 1, 0, 0, 0, 3, 0, 0, 2, 0, 4, 0, 0, 0), (0, 0, 1, 0, 0, 0, 3, 0, 0, 2, 0, 4, 0, 0, 0), (0, 0, 2, 1, 2, 2, 5, 0, 2, 1, 1, -6, 0, 0, 0),
    (0, 1, 3, 1, 2, 2, 4, 0, 1, 2, 0, 5, 0, 0, 0), (0, 0, 1, 1, 3, 3, 5, 0, 0, 3, 0, 10, 0, 0, 0), (0, 2, 3, 1, 2, 2, 3, 0, 3, 0, 0, -5, 0, 0, 0),
    (0, 1, 1, 0, 0, 0, 1, 1, 0, 1, 2, 2, 0, 0, 0), (0, 0, 0, 0, 0, 0, 1, 0, 1, 0, 3, -9, 0, 1, 0), (0, 2, 2, 0, 0, 0, 2, 0, 0, 1, 2, 2, 0, 0, 0)]
BLACK = [
    (0, 0, 1, 0, 0, 0, 0, 0, 0, 3, 0, 6, 0, 0, 0), (0, 0, 1, 0, 0, 0, 0, 0, 0, 3, 0, 6, 0, 0, 0), (0, 0, 1, 0, 0, 0, 1, 0, 0, 2, 0, 4, 0, 0, 0),
    (0, 0, 1, 0, 0, 0, 1, 0, 0, 2, 0, 4, 0, 0, 0), (0, 0, 1, 0, 0, 0, 3, 0, 0, 2, 0, 4, 0, 0, 0), (0, 0, 2, 1, 3, 3, 4, 0, 4, 1, 1, -12, 1, 0, 0),
    (0, 3, 4, 0, 0, 0, 5, 0, 4, 1, 0, -6, 0, 1, 0), (0, 0, 1, 1, 3, 3, 6, 0, 0, 3, 0, 10, 0, 0, 0), (0, 0, 2, 2, 4, 6, 6, 0, 1, 2, 0, 5, 0, 0, 0),
    (0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 3, -9, 0, 0, 0), (0, 0, 0, 0, 0, 0, 2, 0, 0, 0, 3, -6, 0, 0, 0), (0, 2, 2, 0, 0, 0, 1, 0, 0, 1, 2, 2, 0, 0, 0)]
NAMES = ["doubled_pawns", "isolated_pawns", "pawn_islands", "pawn_chains", "longest_chain", "pawns_in_chains", "center_control", "passed_pawns",
         "king_attackers", "pawn_shield", "king_open_files", "king_safety", "checkers", "total_pinned_pieces", "discovered_attacks"]


@pytest.fixture(scope="module")
def boards(spark):
    df = spark.createDataFrame([(i + 1, f) for i, f in enumerate(FENS)], "f int, fen string")
    return B.decode_positions(df)


@pytest.fixture(scope="module")
def features(boards):
    return {r["f"]: r for r in J.position_features(boards, "f").collect()}


def test_square_table(boards):
    counts = dict(B.squares_table(boards, "f").groupBy("f").count().collect())
    assert [counts[i + 1] for i in range(12)] == [t[0] for t in TOTALS]
    kings = {(r["f"], r["color"]): r["sq"] for r in B.squares_table(boards, "f").filter("upper(piece) = 'K'").collect()}
    assert kings[(1, "white")] == 4 and kings[(1, "black")] == 60 and kings[(7, "white")] == 7


def test_material_and_endgame(features):
    for i, (_, balance, total, end) in enumerate(TOTALS):
        r = features[i + 1]
        assert (r["material_balance"], r["total_material"], r["is_endgame"]) == (balance, total, end), FENS[i]


@pytest.mark.parametrize("side,golden", [("white", WHITE), ("black", BLACK)])
def test_golden_sides(features, side, golden):
    for i, want in enumerate(golden):
        got = tuple(features[i + 1][f"{side}_{n}"] for n in NAMES)
        assert got == want, (FENS[i], dict(zip(NAMES, zip(got, want))))


def test_separate_operators_agree_with_the_job(boards, features):
    for op in (A.centre_control, A.forks, A.lone_mobility, A.move_counts, A.king_safety, A.pins, A.discovered_attacks, A.tactical_totals, B.pawn_chains):
        for r in op(boards, "f").collect():
            job = features[r["f"]].asDict()
            assert all(job[k] == v for k, v in r.asDict().items()), op


def test_attacked_area_is_union_of_piece_attacks(boards):
    area = A.with_attacked_sets(boards).select("f", "white_attacks", "black_attacks").collect()
    pairs = A.attack_pairs(boards, "f").select("f", "color", "to_sq").distinct().collect()
    want = {}
    for f, c, s in pairs:
        want[(f, c)] = want.get((f, c), 0) | (1 << s)
    for r in area:
        for c, v in ((0, r["white_attacks"]), (1, r["black_attacks"])):
            assert v & (2**64 - 1) == want.get((r["f"], c), 0)


def test_first_position_has_twenty_moves(features):
    assert features[1]["move_count"] == 20 and features[1]["white_mobility"] == features[1]["black_mobility"]


def test_round_trip_and_empty_board(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "8/8/8/8/8/8/8/8 w - - 0 1"), (2, None), (3, FENS[6])], "f int, fen string")
    rows = B.decode_positions(df)
    back = B.cells_from_sets(rows.drop("cells")).select("f", B.placement_from_cells(F.col("cells")).alias("p"))
    assert dict(back.collect()) == {1: "8/8/8/8/8/8/8/8", 2: "8/8/8/8/8/8/8/8", 3: FENS[6].split(" ")[0]}
    assert {r["f"]: r["white_center_control"] for r in A.centre_control(rows, "f").collect()}[1] == 0
    assert J.position_features(rows, "f").count() == 3


def test_small_boards(spark):
    rows = [(1, "8/8/8/8/4k3/8/8/K6Q w - - 0 1", (1, 0, 10)), (2, "8/8/8/8/4k3/8/8/K6R w - - 0 1", (1, 0, 16)), (3, "8/8/8/8/4k3/8/8/KBN5 w - - 0 1", (1, 0, 33)),
            (4, "8/P7/8/8/4k3/8/8/K7 w - - 0 1", (1, 0, 15)), (5, "8/8/8/P7/4k3/8/8/K7 w - - 0 1", (0, 1, 0)), (6, "8/8/8/8/4k3/8/8/KN6 w - - 0 1", (0, 1, 0)),
            (7, "8/8/8/8/4k3/8/8/K7 w - - 0 1", (0, 1, 0)), (8, "8/8/8/8/4k3/8/8/KRR5 w - - 0 1", (0, 0, 0))]
    df = B.decode_positions(spark.createDataFrame([r[:2] for r in rows], "f int, fen string"))
    got = {r["f"]: (r["theoretical_win"], r["theoretical_draw"], r["tablebase_dtm_estimate"]) for r in E.project(df, "f", E.small_board_columns()).collect()}
    assert got == {r[0]: r[2] for r in rows}


def test_results_do_not_depend_on_partitioning(boards):
    a = sorted(A.attack_features(boards.repartition(7), "f").collect())
    assert a == sorted(A.attack_features(boards.coalesce(1), "f").collect())
