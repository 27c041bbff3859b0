"""Inputs derived from the given tables by plain arithmetic, as DataFrames; ``oracle_text`` holds the same as SQL.

Boards come from ``lineitem``, position strings and UCI moves from those boards, SAN lines and tags from ``orders``
and ``part``, partial labels from ``documents`` and ``labels``. All of them grow with their tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import squares as S
from ..operators import boards as B
from .registry import table

# opening lines and continuations in algebraic notation; an order combines one of each by its keys
OPENINGS = [
    "e4 e5 Nf3 Nc6 Bb5", "e4 e5 Nf3 Nc6 Bc4 Bc5", "e4 c5 Nf3 d6 d4 cxd4", "d4 Nf6 c4 g6 Nc3 Bg7",
    "e4 e6 d4 d5 Nc3 Bb4", "e4 c6 d4 d5 Nc3 dxe4", "d4 d5 c4 e6 Nc3 Nf6", "d4 d5 c4 c6", "c4 e5", "Nf3 d5 c4",
    "g3 d5", "f4 d5", "e4 d5 exd5 Qxd5", "e4 d6", "e4 Nf6", "d4 f5", "d4 Nf6 c4 c5", "d4 Nf6 c4 e6 g3",
    "e4 e5 f4 exf4", "d4 Nf6 c4 g6 Nc3 d5", "d4 d5 c4 e6 Nc3 c6", "b3 e5", "Nc3 d5", "a3", "Nf3 Nf6 c4 g6 b4",
]
CONTINUATIONS = [
    "", "O-O O-O", "Qxf7#", "Rxe8+ Rxe8 Qd7", "O-O-O O-O Kb1", "Bxf7+ Kxf7 Ng5+", "h3 O-O-O", "Re1 Qd6 Qe2 Rfe8 Qd1",
    "a4 a5 h4 h5 Ra3 Ra6 O-O", "e8=Q+ Kf7 Qe7#", "Nd5 Nxd5 exd5",
    "a3 a6 b3 b6 h3 h6 a4 a5 b4 bxa5 h4 h5 Ra2 Ra7 Rh2 Rh7 O-O O-O-O", "Qh5 Nf6 Qxf7#",
]

TAG_FAMILIES = [
    "Sicilian_Defense", "Ruy_Lopez", "Queens_Gambit_Declined", "Kings_Indian_Defense", "French_Defense",
    "Italian_Game", "Caro-Kann_Defense", "English_Opening", "Semi_Slav_Defense", "Nimzo_Indian_Defense", "Reti",
    "Queens_Pawn", "ScotchGame", "Vienna_Game", "Slav_Defense", "Kings_Pawn", "Bogo_Indian_Defense",
]
TAG_DETAILS = [
    "", "Najdorf_Variation", "Berlin_Defense", "Advance_Variation", "Exchange_Variation_Main_Line", "Dragon_Variation",
    "Kings_Attack", "Modern_System", "Other_variations", "Marshall_Attack_Long", "Accepted",
]


def piece_rows(spark: SparkSession, sf_dir: str, per: int = 8) -> DataFrame:
    """Raw (board_id, sq, pc) rows; several rows may claim one square."""
    return table(spark, sf_dir, "lineitem").select(
        F.expr(f"l_orderkey div {per}").alias("board_id"),
        ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 3 + F.col("l_linenumber")) % 64).cast("int").alias("sq"),
        ((F.col("l_partkey") + F.col("l_suppkey")) % 12).cast("int").alias("pc"),
    )


def boards(spark: SparkSession, sf_dir: str, per: int = 8) -> DataFrame:
    """One row per board: board_id, twelve sets, side to move."""
    return B.sets_from_squares(piece_rows(spark, sf_dir, per), "board_id").withColumn(
        "white_to_move", (F.col("board_id") % 2 == 0).cast("int"))


def _rights() -> Column:
    text = F.concat(*[F.when(F.expr(f"board_id div {d}") % 2 == 1, ch).otherwise("") for d, ch in
                      [(1, "K"), (2, "Q"), (4, "k"), (8, "q")]])
    return F.when(text == "", "-").otherwise(text)


def fens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(board_id, fen): position strings written from the boards, header fields from the key."""
    b = B.cells_from_sets(boards(spark, sf_dir))
    fen = F.concat_ws(
        " ", B.placement_from_cells(F.col("cells")), F.when(F.col("white_to_move") == 1, "w").otherwise("b"), _rights(),
        F.lit("-"), (F.col("board_id") % 50).cast("string"), (F.col("board_id") % 80 + 1).cast("string"))
    return b.select("board_id", fen.alias("fen"))


UCI_PLIES = 8


def _on(group: Column):
    """Squares of a board text whose letter belongs to ``group``."""
    return lambda i: F.contains(group, F.substring(F.col("cells"), i + 1, F.lit(1)))


def uci_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(board_id, fen, moves): eight UCI moves per board, colours in turn, from squares that the colour holds at first.

    Later moves may start from an emptied square, so the lists hold both playable and invalid moves.
    """
    b = B.cells_from_sets(boards(spark, sf_dir))
    squares = F.array(*[F.lit(i) for i in range(64)])
    lists = F.struct(*[
        F.filter(squares, _on(F.lit(group))).alias(name) for name, group in (("_w", S.LETTERS[:6]), ("_b", S.LETTERS[6:]))])
    b = b.select("*", F.explode(F.array(lists)).alias("_l")).select("*", "_l._w", "_l._b")  # lists are made once per board
    name = lambda s: F.concat(F.substring(F.lit("abcdefgh"), s % 8 + 1, F.lit(1)), (F.floor(s / 8) + 1).cast("string"))

    def source(i):
        own = F.when((F.col("white_to_move") + i) % 2 == 1, F.col("_w")).otherwise(F.col("_b"))
        at = ((i * 3 + F.col("board_id")) % F.greatest(F.size(own), F.lit(1))).cast("int")
        return F.struct(i.alias("i"), F.coalesce(F.get(own, at), F.lit(0)).cast("bigint").alias("src"))

    def token(m):
        dst = (m["src"] * 5 + F.col("board_id") * 3 + m["i"] * 11 + 7) % 64
        return F.concat(name(m["src"]), name(dst), F.when((F.col("board_id") + m["i"]) % 13 == 0, "q").otherwise(""))

    plies = F.array(*[F.lit(i) for i in range(UCI_PLIES)])
    moves = F.array_join(F.transform(F.transform(plies, source), token), " ")
    fen = F.concat_ws(" ", B.placement_from_cells(F.col("cells")),
                      F.when(F.col("white_to_move") == 1, "w").otherwise("b"), F.lit("- - 0 1"))
    return b.select("board_id", fen.alias("fen"), moves.alias("moves"))


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, moves): algebraic move list per order."""
    return table(spark, sf_dir, "orders").select("o_orderkey", line_text().alias("moves"))


def line_text() -> Column:
    """Algebraic move list of a row of ``orders``."""
    return F.trim(F.concat(pick(OPENINGS, F.col("o_orderkey") % len(OPENINGS)), F.lit(" "), pick(CONTINUATIONS, F.col("o_custkey") % len(CONTINUATIONS))))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, tags): zero to two opening tags per order."""
    return table(spark, sf_dir, "orders").select("o_orderkey", tag_text().alias("tags"))


def tag_text() -> Column:
    """Opening tags of a row of ``orders``."""
    fam, det = F.col("o_orderkey") % len(TAG_FAMILIES), F.col("o_custkey") % len(TAG_DETAILS)
    family, detail = pick(TAG_FAMILIES, fam), pick(TAG_DETAILS, det)
    full = F.when(detail == "", family).otherwise(F.concat(family, F.lit("_"), detail))
    two = F.when(F.col("o_custkey") % 3 == 0, F.concat(family, F.lit(" "), full)).otherwise(full)
    return F.when((F.col("o_orderkey") + F.col("o_custkey")) % 5 == 0, "").otherwise(two)


def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, themes): blank-separated words of a part: name, type, brand."""
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("themes"))


def partial_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their label where one exists: the stand-in for rows with and without tags."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(
        table(spark, sf_dir, "labels"), "doc_id", "left")


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, success_prob_rapid_*, success_prob_blitz_*): the first 22 vector elements as two curves of 11 levels."""
    levels = range(1050, 2051, 100)
    e = F.col("embedding")
    cols = [F.get(e, F.lit(i)).cast("double").alias(f"success_prob_rapid_{n}") for i, n in enumerate(levels)]
    cols += [F.get(e, F.lit(11 + i)).cast("double").alias(f"success_prob_blitz_{n}") for i, n in enumerate(levels)]
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *cols)


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, rating, prediction, o_orderpriority, o_custkey): price scaled to ratings, group mean as prediction."""
    t = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", (F.col("o_totalprice") / 150.0).alias("rating"))
    means = t.groupBy("o_orderpriority").agg(F.avg("rating").alias("prediction"))
    return t.join(F.broadcast(means), "o_orderpriority")


# UCI openings from the initial position, several of them transposing into each other, and continuations
UCI_OPENINGS = [
    "e2e4 e7e5 g1f3 b8c6 f1b5 a7a6", "e2e4 b8c6 g1f3 e7e5 f1b5 a7a6", "g1f3 b8c6 e2e4 e7e5 f1b5 a7a6",
    "d2d4 d7d5 c2c4 e7e6 b1c3 g8f6", "c2c4 e7e6 d2d4 d7d5 b1c3 g8f6", "d2d4 g8f6 c2c4 e7e6 b1c3 d7d5",
    "e2e4 c7c5 g1f3 d7d6 d2d4 c5d4", "e2e4 c7c5 d2d4 c5d4 g1f3 d7d6", "e2e4 e7e6 d2d4 d7d5 b1c3 f8b4",
    "d2d4 e7e6 e2e4 d7d5 b1c3 f8b4", "e2e4 c7c6 d2d4 d7d5 b1c3 d5e4", "c2c4 e7e5",
    "e2e4 d7d5 e4e5 f7f5 e5f6 e8f7 f6g7 a7a6 g7h8q",
]
UCI_TAILS = [
    "", "f3d4 g8f6 b1c3 a7a6", "e1g1 e8g8", "g1f3 f8e7 c1g5 e8g8", "d1h5 g8f6 h5f7", "a2a3 h7h6 b2b4 z9z9 c1b2",
    "f1e2 f8e7 e1g1 e8g8 f1e1",
]
START_FEN = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"


def uci_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, fen, moves): UCI list per order from the initial position."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit(START_FEN).alias("fen"),
        F.trim(F.concat(pick(UCI_OPENINGS, F.col("o_orderkey") % len(UCI_OPENINGS)), F.lit(" "),
                        pick(UCI_TAILS, F.col("o_custkey") % len(UCI_TAILS)))).alias("moves"))


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, rating, features): mean line price of an order scaled to ratings, to be explained by its lines."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        (F.avg("l_extendedprice") / 25.0).alias("rating"), F.count("*").cast("double").alias("n_lines"), F.avg("l_quantity").alias("quantity"),
        F.max("l_quantity").alias("most"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))


TRAINING_FEATURES = ["n_lines", "quantity", "most", "discount", "tax"]


def document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, family, variation, quality, toxic, features): language and source as a two-level label, known where a
    document is labelled; letter statistics of the whole text as features."""
    d = table(spark, sf_dir, "documents")
    text = F.lower("text")
    share = lambda ch: (F.length("text") - F.length(F.replace(text, F.lit(ch), F.lit("")))) / F.greatest(F.length("text"), F.lit(1))
    stats = d.select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"),
                     *[share(ch).alias(f"f_{i}") for i, ch in enumerate(["e", "the", "é", "ß", "ch", "o", "a", " "])])
    rows = stats.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    tag = F.when(F.col("quality").isNotNull(), F.concat_ws("_", "lang", "source")).otherwise("")
    return rows.withColumn("tag", tag)


DOCUMENT_FEATURES = ["n_chars"] + [f"f_{i}" for i in range(8)]
