"""Sets of board squares held in one BIGINT column each.

Bit ``sq`` of a set says whether square ``sq`` belongs to it, with ``sq = rank * 8 + file`` and a1 = 0.
Everything here is a built-in bit expression, so it stays inside whole-stage code generation: a board is
one row of twelve sets and most questions about it are narrow projections without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETS = ["wp", "wn", "wb", "wr", "wq", "wk", "bp", "bn", "bb", "br", "bq", "bk"]
LETTERS = "PNBRQKpnbrqk"
TOP_BIT = -(1 << 63)
FULL = (1 << 64) - 1


def signed(bits: int) -> int:
    bits &= FULL
    return bits - (1 << 64) if bits >> 63 else bits


def constant(bits: int) -> Column:
    return F.lit(signed(bits)).cast("long")


def file_bits(f: int) -> int:
    return sum(1 << (8 * r + f) for r in range(8))


def rank_bits(r: int) -> int:
    return 0xFF << (8 * r)


CENTRE = sum(1 << s for s in (27, 28, 35, 36))
LIGHT = sum(1 << s for s in range(64) if (s // 8 + s % 8) % 2 == 1)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, also where ``body`` uses it in an inner lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def union(*sets: Column) -> Column:
    out = sets[0]
    for s in sets[1:]:
        out = out.bitwiseOR(s)
    return out


def common(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def without(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b))


def size(a: Column) -> Column:
    return F.bit_count(a)


def has(a: Column) -> Column:
    return a != F.lit(0).cast("long")


def bit(sq: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), sq.cast("int"))


def lowest(a: Column) -> Column:
    """Index of the lowest member, null for the empty set."""
    return F.when(a == 0, None).when(a == F.lit(TOP_BIT), 63).otherwise(
        F.bit_count(F.bitwise_not(a).bitwiseAND(a - 1))
    )


def highest(a: Column) -> Column:
    return F.when(a != 0, F.length(F.bin(a)) - 1)


def north(a: Column, n: int = 1) -> Column:
    return F.shiftleft(a, 8 * n)


def south(a: Column, n: int = 1) -> Column:
    return F.shiftrightunsigned(a, 8 * n)


def east(a: Column) -> Column:
    return F.shiftleft(common(a, constant(FULL ^ file_bits(7))), 1)


def west(a: Column) -> Column:
    return F.shiftrightunsigned(common(a, constant(FULL ^ file_bits(0))), 1)


def all_north(a: Column) -> Column:
    """Every square strictly in front of a member, seen from the first rank."""
    a = north(a)
    for n in (1, 2, 4):
        a = a.bitwiseOR(north(a, n))
    return a


def all_south(a: Column) -> Column:
    a = south(a)
    for n in (1, 2, 4):
        a = a.bitwiseOR(south(a, n))
    return a


def widen(a: Column) -> Column:
    """The set and its left and right neighbours."""
    return union(a, east(a), west(a))


def files(a: Column) -> Column:
    """Occupied files as the low eight bits."""
    for n in (1, 2, 4):
        a = a.bitwiseOR(south(a, n))
    return common(a, constant(0xFF))


def diagonal_neighbours(a: Column) -> Column:
    return union(north(east(a)), north(west(a)), south(east(a)), south(west(a)))


def each_member(df: DataFrame, name: str, out: str = "sq") -> DataFrame:
    """One row per member of the set column ``name``: a generator over 64 constants and a bit test, both compiled.

    The set must be a column of ``df``. It is computed below the generator, once per row.
    """
    rows = df.select("*", F.explode(F.array(*[F.lit(i) for i in range(64)])).alias(out))
    return rows.filter(has(common(F.col(name), bit(F.col(out)))))


def _shift(a: Column, d: int, times: int = 1) -> Column:
    """Move a set ``times`` squares in direction ``d`` without looking at the board edge."""
    f, r = DIRECTIONS[d]
    n = (r * 8 + f) * times
    return F.shiftleft(a, n) if n > 0 else F.shiftrightunsigned(a, -n)


def slide_all(movers: Column, free: Column, d: int) -> Column:
    """Squares that any of ``movers`` sees in direction ``d``: a fill over free squares in three doubling steps."""
    f = DIRECTIONS[d][0]
    inside = constant(FULL if f == 0 else FULL ^ file_bits(0 if f > 0 else 7))
    p1 = common(free, inside)
    g1 = union(movers, common(p1, _shift(movers, d)))
    p2 = common(p1, _shift(p1, d))
    g2 = union(g1, common(p2, _shift(g1, d, 2)))
    p3 = common(p2, _shift(p2, d, 2))
    g3 = union(g2, common(p3, _shift(g2, d, 4)))
    return common(inside, _shift(g3, d))


def knight_hops(a: Column) -> Column:
    one = union(east(a), west(a))
    two = union(east(east(a)), west(west(a)))
    return union(north(one, 2), south(one, 2), north(two), south(two))


def king_steps(a: Column) -> Column:
    row = widen(a)
    return union(east(a), west(a), north(row), south(row))


def clip_up(ray: Column, inner: Column, occupied: Column) -> Column:
    """Part of a ray towards higher squares that is visible: up to and with the first occupied square.

    ``inner`` is the ray without its last square. The last square never hides another one, so leaving it out
    changes nothing and keeps the top bit clear, which makes ``b - 1`` safe under ANSI arithmetic.
    """
    b = common(inner, occupied)
    return common(ray, b.bitwiseXOR(b - 1))


def clip_down(ray: Column, inner: Column, occupied: Column) -> Column:
    b = common(inner, occupied)
    return common(ray, F.call_function("shiftleft", F.lit(-1).cast("long"), F.length(F.bin(b)) - 1))


# direction number -> (file step, rank step); 0-3 go to higher squares, 4-7 to lower ones
DIRECTIONS = [(0, 1), (1, 1), (1, 0), (-1, 1), (0, -1), (-1, -1), (-1, 0), (1, -1)]


def _walk(sq: int, df: int, dr: int, limit: int = 7) -> list[int]:
    out, f, r = [], sq % 8 + df, sq // 8 + dr
    while 0 <= f <= 7 and 0 <= r <= 7 and len(out) < limit:
        out.append(r * 8 + f)
        f, r = f + df, r + dr
    return out


def _bits(squares) -> int:
    return sum(1 << s for s in set(squares))


def _steps(sq: int, offsets) -> list[int]:
    return [t for df, dr in offsets for t in _walk(sq, df, dr, 1)]


KNIGHT = [(1, 2), (2, 1), (2, -1), (1, -2), (-1, -2), (-2, -1), (-2, 1), (-1, 2)]


def _push_squares(pc: int, sq: int) -> list[int]:
    forward, first_ranks = (1, (0, 1)) if pc == 0 else (-1, (7, 6))
    return _walk(sq, 0, forward, 2 if sq // 8 in first_ranks else 1)


def reach_table(spark: SparkSession) -> DataFrame:
    """768 rows, one per piece code and square: steps, rays and empty-board moves. Built from movement rules."""
    import pandas as pd

    rows = []
    for pc in range(12):
        kind = pc % 6
        for sq in range(64):
            dirs = {2: (1, 3, 5, 7), 3: (0, 2, 4, 6), 4: range(8)}.get(kind, ())
            rays = [_walk(sq, *DIRECTIONS[d]) if d in dirs else [] for d in range(8)]
            if kind == 0:
                forward = 1 if pc == 0 else -1
                steps = _steps(sq, [(-1, forward), (1, forward)])
                targets = _push_squares(pc, sq)
                lone = sum(4 if t // 8 in (0, 7) else 1 for t in targets)
            else:
                steps = _steps(sq, KNIGHT if kind == 1 else DIRECTIONS if kind == 5 else [])
                targets = steps + [t for ray in rays for t in ray]
                lone = len(targets)
            row = {"cell": pc * 64 + sq, "steps": signed(_bits(steps)),
                   "lone_targets": signed(_bits(targets)), "lone_moves": lone}
            for d, ray in enumerate(rays):
                row[f"ray{d}"] = signed(_bits(ray))
                row[f"inner{d}"] = signed(_bits(ray[:-1]))
            rows.append(row)
    return spark.createDataFrame(pd.DataFrame(rows)).withColumns(
        {"cell": F.col("cell").cast("int"), "lone_moves": F.col("lone_moves").cast("int")})


def ray_table(spark: SparkSession) -> DataFrame:
    """One row per square and direction with a non-empty ray (420 rows)."""
    import pandas as pd

    rows = []
    for sq in range(64):
        for d, step in enumerate(DIRECTIONS):
            ray = _walk(sq, *step)
            if ray:
                rows.append({"ray_sq": sq, "dir": d, "ray": signed(_bits(ray)), "inner": signed(_bits(ray[:-1]))})
    return spark.createDataFrame(pd.DataFrame(rows)).withColumns(
        {"ray_sq": F.col("ray_sq").cast("int"), "dir": F.col("dir").cast("int")})
