"""Game phases, endgame types, king geometry and small-board verdicts: narrow projections over board sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import squares as S
from .boards import material_columns


def _both(kinds: str) -> Column:
    total = F.lit(0)
    for k in kinds:
        total = total + S.size(F.col("w" + k)) + S.size(F.col("b" + k))
    return total


def phase_columns() -> dict[str, Column]:
    """Endgame below 30 material points, opening above 62, middlegame between."""
    m = material_columns()["total_material"]
    return {
        "is_endgame": (m < 30).cast("int"),
        "is_middlegame": m.between(30, 62).cast("int"),
        "is_opening": (m > 62).cast("int"),
    }


def piece_phase_columns() -> dict[str, Column]:
    """Phase flags from officers on the board and material; flags may overlap."""
    n, m = _both("nbrq"), material_columns()["total_material"]
    return {
        "opening_phase": ((n >= 6) & (m >= 24)).cast("int"),
        "middlegame_phase": (n.between(3, 5) | ((n >= 6) & (m < 24))).cast("int"),
        "endgame_phase": ((n < 3) | (m < 15)).cast("int"),
    }


def is_endgame() -> Column:
    return (_both("q") == 0) | (_both("qrbn") <= 2) | (material_columns()["total_material"] <= 20)


def endgame_type_columns() -> dict[str, Column]:
    end = is_endgame()
    p, n, b, r, q = (_both(k) for k in "pnbrq")
    return {
        "is_endgame": end.cast("int"),
        "king_pawn_endgame": (end & (p > 0) & (n + b + r + q == 0)).cast("int"),
        "rook_endgame": (end & (r > 0) & (q == 0)).cast("int"),
        "minor_piece_endgame": (end & (n + b > 0) & (r == 0) & (q == 0)).cast("int"),
        "queen_endgame": (end & (q > 0)).cast("int"),
    }


def bishop_colour_columns() -> dict[str, Column]:
    """Same or opposite square colour, only with exactly one bishop a side in an endgame."""
    single = is_endgame() & (S.size(F.col("wb")) == 1) & (S.size(F.col("bb")) == 1)
    light = S.constant(S.LIGHT)
    same = S.has(S.common(F.col("wb"), light)) == S.has(S.common(F.col("bb"), light))
    return {
        "opposite_colored_bishops": (single & ~same).cast("int"),
        "same_colored_bishops": (single & same).cast("int"),
    }


def king_geometry_columns() -> dict[str, Column]:
    """Chebyshev distances of the two kings; all 0 when one is missing. Needs the king squares as columns."""
    out, pos = {}, {}
    w, b = F.col("white_king_sq"), F.col("black_king_sq")
    both = w.isNotNull() & b.isNotNull()
    for side, k in (("white", w), ("black", b)):
        f, r = k % 8, F.floor(k / 8).cast("int")
        pos[side] = (f, r)
        out[f"{side}_king_center_distance"] = F.greatest(3 - f, f - 4, 3 - r, r - 4, F.lit(0))
        out[f"{side}_king_edge_distance"] = F.least(f, 7 - f, r, 7 - r)
    (wf, wr), (bf, br) = pos["white"], pos["black"]
    out["king_distance"] = F.greatest(F.abs(wf - bf), F.abs(wr - br))
    out["has_opposition"] = ((out["king_distance"] == 2) & ((wf == bf) | (wr == br))).cast("int")
    return {name: F.when(both, c).otherwise(0) for name, c in out.items()}


def zugzwang_column(move_count: Column) -> Column:
    """0..3 from king distance and the number of moves, in endgames with both kings."""
    d = king_geometry_columns()["king_distance"]
    known = is_endgame() & F.col("white_king_sq").isNotNull() & F.col("black_king_sq").isNotNull()
    return F.when(~known, 0).when((d <= 2) & (move_count <= 5), 3).when((d <= 3) & (move_count <= 8), 2).when(
        (d <= 4) & (move_count <= 10), 1).otherwise(0)


def small_board_columns() -> dict[str, Column]:
    """Verdict and distance estimate for boards of at most five pieces, from the material of both sides."""
    n = {c + k: S.size(F.col(c + k)) for c in "wb" for k in "pnbrqk"}
    total = {c: n[c + "p"] + n[c + "n"] + n[c + "b"] + n[c + "r"] + n[c + "q"] + n[c + "k"] for c in "wb"}

    def lead(size: int, **need) -> Column:
        """Either side has ``size`` pieces with the needed ones against a single piece."""
        cond = F.lit(False)
        for me, foe in (("w", "b"), ("b", "w")):
            here = (total[me] == size) & (total[foe] == 1)
            for k, v in need.items():
                here = here & (n[me + k] == v)
            cond = cond | here
        return cond

    advanced = F.when(n["wp"] == 1, S.lowest(F.col("wp")) >= 40).otherwise(S.lowest(F.col("bp")) < 24)
    verdict = (
        F.when(total["w"] + total["b"] > 5, "none")
        .when(lead(2, q=1) | lead(2, r=1) | lead(3, b=1, n=1), "win")
        .when(lead(2, p=1), F.when(advanced, "win").otherwise("draw"))
        .when(lead(2, n=1) | lead(2, b=1) | ((total["w"] == 1) & (total["b"] == 1)), "draw")
        .otherwise("none")
    )
    either = lambda k: (n["w" + k] == 1) | (n["b" + k] == 1)
    pair = ((n["wb"] == 1) & (n["wn"] == 1)) | ((n["bb"] == 1) & (n["bn"] == 1))
    distance = F.when(either("q"), 10).when(either("r"), 16).when(pair, 33).when(either("p"), 15).otherwise(0)
    return {
        "in_tablebase": (total["w"] + total["b"] <= 5).cast("int"),
        "theoretical_win": (verdict == "win").cast("int"),
        "theoretical_draw": (verdict == "draw").cast("int"),
        "tablebase_dtm_estimate": F.when(verdict == "win", distance).otherwise(0),
    }


def project(boards: DataFrame, key, columns: dict[str, Column]) -> DataFrame:
    from .boards import keys_of

    return boards.select(*keys_of(key), *[c.alias(n) for n, c in columns.items()])
