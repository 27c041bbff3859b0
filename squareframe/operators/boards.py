"""Boards as rows of twelve square sets: decoding, counts, material, pawns, kings, development."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import EMPTY_BOARD, KING_SAFETY, MATERIAL
from ..functions import squares as S

KINDS = ["pawn", "knight", "bishop", "rook", "queen", "king"]
SIDES = [("white", "w"), ("black", "b")]


def keys_of(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


# ---------------------------------------------------------------- decoding

def placement_key(fen: Column) -> Column:
    """First field of a position string; the key for exact position lookups."""
    return F.substring_index(F.coalesce(fen, F.lit("")), " ", 1)


def cells_from_placement(placement: Column) -> Column:
    """Placement text to 64 letters in square order a1, b1, .. h8, dots for empty squares."""
    spread = placement
    for n in range(1, 9):
        spread = F.replace(spread, F.lit(str(n)), F.lit("." * n))
    spread = F.replace(spread, F.lit("/"), F.lit(""))
    return F.concat(*[F.substring(spread, 57 - 8 * r, 8) for r in range(8)])


def placement_from_cells(cells: Column) -> Column:
    """Inverse of :func:`cells_from_placement`."""
    text = F.concat_ws("/", *[F.substring(cells, 57 - 8 * r, 8) for r in range(8)])
    for n in range(8, 0, -1):
        text = F.replace(text, F.lit("." * n), F.lit(str(n)))
    return text


def is_position(fen: Column) -> Column:
    """Six fields, known letters, eight ranks of eight squares."""
    spread = F.split(F.regexp_replace(placement_key(fen), "/", " "), " ")
    full = F.transform(spread, lambda rank: F.length(_spread_rank(rank)))
    shape = fen.rlike(r"^[1-8PNBRQKpnbrqk/]+ [wb] (-|K?Q?k?q?) (-|[a-h][36]) \d+ \d+$")
    return shape & (F.size(spread) == 8) & F.forall(full, lambda n: n == 8)


def _spread_rank(rank: Column) -> Column:
    for n in range(1, 9):
        rank = F.replace(rank, F.lit(str(n)), F.lit("." * n))
    return rank


def header_columns(fen: Column) -> dict[str, Column]:
    """Side to move, castling rights and the two counters."""
    part = F.split(fen, " ")
    rights = F.get(part, F.lit(2))
    flag = {name: F.contains(rights, F.lit(ch)).cast("int")
            for name, ch in [("can_castle_wk", "K"), ("can_castle_wq", "Q"), ("can_castle_bk", "k"), ("can_castle_bq", "q")]}
    return {
        "white_to_move": (F.get(part, F.lit(1)) == "w").cast("int"),
        **flag,
        "halfmove_clock": F.get(part, F.lit(4)).cast("int"),
        "fullmove_number": F.get(part, F.lit(5)).cast("int"),
    }


def decode_positions(df: DataFrame, fen: str = "fen") -> DataFrame:
    """Add cells, header fields and the twelve sets. Narrow; null positions count as the empty board."""
    text = F.coalesce(F.col(fen), F.lit(EMPTY_BOARD))
    out = df.withColumns({"cells": cells_from_placement(placement_key(text)), **header_columns(text)})
    return sets_from_cells(out)


def sets_from_cells(df: DataFrame, cells: str = "cells") -> DataFrame:
    """64 letters to twelve BIGINT sets, no per-square work: the letters' numbers from 1 as four planes of bits, by one translate and one base
    conversion each, then a set as the squares whose four bits are those of its number."""
    alphabet = S.LETTERS + "."
    bits = F.reverse(F.col(cells))
    planes = {f"_plane{k}": F.conv(F.translate(bits, alphabet, "".join(str((i + 1) % 13 >> k & 1) for i in range(13))), 2, -10).cast("long") for k in range(4)}
    sets = {name: reduce(S.common, [F.col(p) if (i + 1) >> k & 1 else F.bitwise_not(F.col(p)) for k, p in enumerate(planes)]) for i, name in enumerate(S.SETS)}
    return df.withColumns(planes).withColumns(sets).drop(*planes)


def sets_from_squares(long: DataFrame, key, sq: str = "sq", pc: str = "pc") -> DataFrame:
    """(key, square, piece code) rows to one row of sets per key.

    One aggregation with a partial step before the shuffle, so a key that holds a third of all rows is one
    row per task by then. Where several codes claim a square the smallest code gets it.
    """
    ks = keys_of(key)
    at = S.bit(F.col(sq))
    zero = F.lit(0).cast("long")
    raw = long.groupBy(*ks).agg(
        *[F.bit_or(F.when(F.col(pc) == i, at).otherwise(zero)).alias(f"_{name}") for i, name in enumerate(S.SETS)]
    )
    out = raw
    taken = None
    cols = {}
    for name in S.SETS:
        mine = F.col(f"_{name}")
        cols[name] = mine if taken is None else S.without(mine, taken)
        taken = mine if taken is None else taken.bitwiseOR(mine)
    return out.select(*ks, *[c.alias(n) for n, c in cols.items()])


def squares_table(boards: DataFrame, key, cells: str = "cells") -> DataFrame:
    """One row per occupied square: key, sq, file, rank, color, piece."""
    ks = keys_of(key)
    return (
        boards.select(*ks, F.posexplode(F.split(F.col(cells), "")).alias("sq", "letter"))
        .filter((F.col("letter") != ".") & (F.col("letter") != ""))
        .select(
            *ks, "sq", (F.col("sq") % 8).alias("file"), F.expr("sq div 8").cast("int").alias("rank"),
            F.when(F.col("letter") == F.upper("letter"), "white").otherwise("black").alias("color"),
            F.col("letter").alias("piece"),
        )
    )


def cells_from_sets(df: DataFrame) -> DataFrame:
    """Add the 64-letter text of a board held as sets (used to write positions out).

    The twelve sets fold to four bit planes of the piece number first. Each quarter of a plane is spread to one bit in four, so that four planes together are the
    numbers of sixteen squares as hexadecimal digits. All of it is arithmetic in generated code; no expression runs square by square.
    """
    names = [c for c in df.columns if c != "cells"]
    quarters = [(k, q) for k in range(4) for q in range(4)]
    rows = df.select(*names, *[c.alias(f"_p{k}") for k, c in enumerate(bit_planes())])
    low = S.constant(0xFFFF)
    rows = rows.select(*names, *[F.shiftrightunsigned(f"_p{k}", 16 * q).bitwiseAND(low).alias(f"_p{k}{q}") for k, q in quarters])
    for by, mask in ((24, 0x000000FF000000FF), (12, 0x000F000F000F000F), (6, 0x0303030303030303), (3, 0x1111111111111111)):
        rows = rows.select(*names, *[F.col(f"_p{k}{q}").bitwiseOR(F.shiftleft(f"_p{k}{q}", by)).bitwiseAND(S.constant(mask)).alias(f"_p{k}{q}") for k, q in quarters])

    def sixteen(q):
        digits = reduce(Column.bitwiseOR, [F.shiftleft(f"_p{k}{q}", k) for k in range(4)])
        return F.reverse(F.lpad(F.hex(digits), 16, "0"))

    text = F.translate(F.concat(*[sixteen(q) for q in range(4)]), "0123456789ABC", "." + S.LETTERS)
    return rows.select(*names, F.explode_outer(F.array(text)).alias("cells"))  # a filter on the text would else be moved down with copies of every step


def pieces(boards: DataFrame, key, carry: list[str] | None = None) -> DataFrame:
    """One row per piece: key, carried columns, pc (0..11) and sq. A generator over 64 constants; no shuffle.

    An empty board keeps one row with a null code, so that aggregates still know its key.
    """
    ks = keys_of(key)
    keep = [c for c in (carry or []) if c not in S.SETS]
    kept_sets = [c for c in (carry or []) if c in S.SETS]
    every = S.union(*[F.col(n) for n in S.SETS])
    rows = boards.select(*ks, *keep, *S.SETS, every.alias("_any"),
                         F.explode(F.array(*[F.lit(i) for i in range(64)])).alias("sq"))
    rows = rows.filter(S.has(S.common(F.col("_any"), S.bit(F.col("sq")))) | ((F.col("_any") == 0) & (F.col("sq") == 0)))
    at = S.bit(F.col("sq"))
    pc = None
    for i, name in enumerate(S.SETS):
        cond = S.has(S.common(F.col(name), at))
        pc = F.when(cond, i) if pc is None else pc.when(cond, i)
    return rows.select(*ks, *keep, *kept_sets, "sq", pc.alias("pc"))


# ---------------------------------------------------------------- counts and material

def piece_count_columns() -> dict[str, Column]:
    return {f"{side}_{kind}s": S.size(F.col(p + k)) for side, p in SIDES for kind, k in zip(KINDS, "pnbrqk")}


def material(prefix: str, values: dict[str, int] | None = None) -> Column:
    values = values or MATERIAL
    total = F.lit(0)
    for k in "pnbrqk":
        if values[k]:
            total = total + S.size(F.col(prefix + k)) * F.lit(values[k])
    return total


def material_columns(values: dict[str, int] | None = None) -> dict[str, Column]:
    w, b = material("w", values), material("b", values)
    return {"material_balance": w - b, "total_material": w + b}


def side_relative_columns(turn: str = "white_to_move", values: dict[str, int] | None = None) -> dict[str, Column]:
    """Counts and material of the side to move and of its opponent."""
    mine = F.col(turn) == 1
    out = {}
    for who, first, second in (("active", "w", "b"), ("opponent", "b", "w")):
        for kind, k in zip(KINDS, "pnbrqk"):
            out[f"{who}_{kind}_count"] = F.when(mine, S.size(F.col(first + k))).otherwise(S.size(F.col(second + k)))
        out[f"{who}_material"] = F.when(mine, material(first, values)).otherwise(material(second, values))
    w, b = material("w", values), material("b", values)
    out["material_diff"] = F.when(mine, w - b).otherwise(b - w)
    out["total_material"] = w + b
    return out


# ---------------------------------------------------------------- pawns

def _ahead(side: str, a: Column) -> Column:
    return S.all_north(a) if side == "w" else S.all_south(a)


def _behind(side: str, a: Column) -> Column:
    return S.all_south(a) if side == "w" else S.all_north(a)


def doubled_files(p: Column) -> Column:
    return S.size(S.files(S.common(p, S.all_north(p))))


def isolated_files(p: Column) -> Column:
    f = S.files(p)
    return S.size(S.without(f, F.shiftleft(f, 1).bitwiseOR(F.shiftrightunsigned(f, 1))))


def islands(p: Column) -> Column:
    f = S.files(p)
    return S.size(S.without(f, F.shiftleft(f, 1)))


def passed(side: str) -> Column:
    """Own pawns without an enemy pawn in front of them on the same or a neighbouring file."""
    foe = F.col("bp") if side == "w" else F.col("wp")
    shadow = _behind(side, foe)
    return S.without(F.col(side + "p"), S.widen(shadow))


def pawn_structure_columns() -> dict[str, Column]:
    out = {}
    for side, p in SIDES:
        own = F.col(p + "p")
        out[f"{side}_doubled_pawns"] = doubled_files(own)
        out[f"{side}_isolated_pawns"] = isolated_files(own)
        out[f"{side}_pawn_islands"] = islands(own)
    return out


def passed_pawn_columns() -> dict[str, Column]:
    return {f"{side}_passed_pawns": S.size(passed(p)) for side, p in SIDES}


def most_advanced_columns() -> dict[str, Column]:
    """Rank index counted from the own side, 0 without pawns."""
    return {
        "white_most_advanced_pawn_rank": F.coalesce(F.floor(S.highest(F.col("wp")) / 8).cast("int"), F.lit(0)),
        "black_most_advanced_pawn_rank": F.coalesce(7 - F.floor(S.lowest(F.col("bp")) / 8).cast("int"), F.lit(0)),
    }


def connected_passed_columns() -> dict[str, Column]:
    """Pairs of neighbouring files that both hold a passed pawn of the side."""
    out = {}
    for side, p in SIDES:
        f = S.files(passed(p))
        out[f"{side}_connected_passed_pawns"] = S.size(S.common(f, F.shiftleft(f, 1)))
    return out


def blocked(side: str) -> Column:
    """Own pawns with any piece on the square straight ahead."""
    every = S.union(*[F.col(n) for n in S.SETS])
    own = F.col(side + "p")
    return S.common(own, S.south(every) if side == "w" else S.north(every))


def pawn_set_columns() -> dict[str, Column]:
    out = {}
    for side, p in SIDES:
        own = F.col(p + "p")
        out[f"{side}_passed"] = S.size(passed(p))
        out[f"{side}_isolated"] = isolated_files(own)
        out[f"{side}_doubled"] = doubled_files(own)
        out[f"{side}_blocked"] = S.size(blocked(p))
    return out


def pawn_chains(boards: DataFrame, key) -> DataFrame:
    """Components of two or more diagonally touching pawns: how many, the longest, total members.

    Each chained pawn grows its own component by as many rounds as the side has chained pawns, which is always
    enough. The pawn on the lowest square of a component stands for it, so one aggregation per key finishes it.
    """
    ks = keys_of(key)
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(p + "p").alias("p")) for side, p in SIDES])
    rows = (
        boards.select(*ks, F.explode(sides).alias("s")).select(*ks, "s.side", "s.p")
        .withColumn("linked", S.common(F.col("p"), S.diagonal_neighbours(F.col("p"))))
        .select(*ks, "side", "linked", F.explode(F.array(*[F.lit(i) for i in range(64)])).alias("at"))
        .withColumn("sq", F.when(S.has(S.common(F.col("linked"), S.bit(F.col("at")))), F.col("at")))
        .filter(F.col("sq").isNotNull() | ((F.col("at") == 0) & (F.col("linked") == 0)))
        .withColumn(
            "part",
            F.when(F.col("sq").isNotNull(), F.aggregate(
                F.sequence(F.lit(2), F.greatest(F.lit(2), S.size(F.col("linked")))),
                S.bit(F.col("sq")),
                lambda acc, _: acc.bitwiseOR(S.diagonal_neighbours(acc)).bitwiseAND(F.col("linked")),
            )),
        )
    )
    aggs = []
    for side, _ in SIDES:
        here = (F.col("side") == side) & F.col("sq").isNotNull()
        first = here & (F.col("sq") == S.lowest(F.col("part")))
        aggs += [
            F.count_if(first).alias(f"{side}_pawn_chains"),
            F.coalesce(F.max(F.when(here, S.size(F.col("part")))), F.lit(0)).alias(f"{side}_longest_chain"),
            F.count_if(here).alias(f"{side}_pawns_in_chains"),
        ]
    return rows.groupBy(*ks).agg(*aggs)


# ---------------------------------------------------------------- kings

def king_square(p: str) -> Column:
    return S.lowest(F.col(p + "k"))


def with_kings(boards: DataFrame) -> DataFrame:
    """Add king squares (null when absent), king bits, 3x3 zones and the two colour sets."""
    out = boards.withColumns({
        "white_king_sq": king_square("w"), "black_king_sq": king_square("b"),
        "white_all": S.union(*[F.col(n) for n in S.SETS[:6]]),
        "black_all": S.union(*[F.col(n) for n in S.SETS[6:]]),
    })
    out = out.withColumns({
        f"{side}_king_bit": F.coalesce(S.bit(F.col(f"{side}_king_sq")), F.lit(0).cast("long")) for side, _ in SIDES
    })
    row = {f"{side}_king_row": S.widen(F.col(f"{side}_king_bit")) for side, _ in SIDES}
    out = out.withColumns(row)
    return out.withColumns({
        f"{side}_king_zone": S.union(F.col(f"{side}_king_row"), S.north(F.col(f"{side}_king_row")),
                                     S.south(F.col(f"{side}_king_row")))
        for side, _ in SIDES
    })


KING_CONTEXT = [f"{side}_{c}" for c in ("king_sq", "all", "king_bit", "king_row", "king_zone") for side in ("white", "black")]


def king_wing_columns() -> dict[str, Column]:
    out = {}
    for side, _ in SIDES:
        f = F.col(f"{side}_king_sq") % 8
        out[f"{side}_king_castled_kingside"] = F.coalesce((f >= 6).cast("int"), F.lit(0))
        out[f"{side}_king_castled_queenside"] = F.coalesce((f <= 2).cast("int"), F.lit(0))
        out[f"{side}_king_center"] = F.coalesce(f.between(3, 4).cast("int"), F.lit(0))
    return out


def pawn_shield_columns() -> dict[str, Column]:
    """Own pawns one and two ranks ahead of the king; near the far edge the view turns round."""
    out = {}
    for side, p in SIDES:
        row, sq = F.col(f"{side}_king_row"), F.col(f"{side}_king_sq")
        up = S.north(row).bitwiseOR(S.north(row, 2))
        down = S.south(row).bitwiseOR(S.south(row, 2))
        look_up = (sq < 48) if p == "w" else (sq < 16)
        out[f"{side}_pawn_shield"] = F.when(sq.isNull(), 0).otherwise(
            S.size(S.common(F.when(look_up, up).otherwise(down), F.col(p + "p"))))
    return out


def king_open_file_columns() -> dict[str, Column]:
    pawn_files = S.files(F.col("wp").bitwiseOR(F.col("bp")))
    return {f"{side}_king_open_files": S.size(S.without(S.files(F.col(f"{side}_king_row")), pawn_files)) for side, _ in SIDES}


def king_safety_columns(weights: dict[str, int] | None = None) -> dict[str, Column]:
    """Score from the shield, attacker, open-file and wing columns; 0 without a king."""
    w = weights or KING_SAFETY
    out = {}
    for side, _ in SIDES:
        wing = (F.col(f"{side}_king_castled_kingside") + F.col(f"{side}_king_castled_queenside")) > 0
        score = (F.col(f"{side}_pawn_shield") * F.lit(w["pawn_shield"])
                 + F.col(f"{side}_king_attackers") * F.lit(w["king_attackers"])
                 + F.col(f"{side}_king_open_files") * F.lit(w["king_open_files"])
                 + F.when(wing, F.lit(w["castling_bonus"])).otherwise(0))
        out[f"{side}_king_safety"] = F.when(F.col(f"{side}_king_sq").isNull(), 0).otherwise(score)
    return out


def developed_minor_columns() -> dict[str, Column]:
    return {
        "white_minor_pieces_developed": S.size(S.without(F.col("wn").bitwiseOR(F.col("wb")), S.constant(S.rank_bits(0)))),
        "black_minor_pieces_developed": S.size(S.without(F.col("bn").bitwiseOR(F.col("bb")), S.constant(S.rank_bits(7)))),
    }


# ---------------------------------------------------------------- comparing positions

def bit_planes() -> list[Column]:
    """The twelve sets as four sets: plane k holds the squares whose piece number (1 to 12, 0 for empty) has bit k."""
    return [S.union(*[F.col(n) for i, n in enumerate(S.SETS) if (i + 1) >> k & 1]) for k in range(4)]


def differing_squares(a: str, b: str) -> Column:
    """Squares on which two boards differ. ``a`` and ``b`` prefix the columns p0 to p3 made by :func:`bit_planes`."""
    return S.size(S.union(*[F.col(f"{a}p{k}").bitwiseXOR(F.col(f"{b}p{k}")) for k in range(4)]))


def position_similarity(a: str, b: str) -> Column:
    return F.lit(1.0) - differing_squares(a, b) / F.lit(64.0)
