"""Attacks, mobility, pins, forks and checks.

A piece meets the 768-row reach table in a broadcast join; its rays are clipped at the first occupied square with
bit arithmetic. The result is one row per piece with the attacked squares as a set, so counts over any target
squares are sums of bit counts and reach one row per board in a partial aggregation before the only shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import TACTICS
from ..functions import squares as S
from .boards import KING_CONTEXT, KINDS, SIDES, keys_of, pieces, with_kings


def piece_attacks(boards: DataFrame, key, carry: list[str] | None = None) -> DataFrame:
    """One row per piece: key, pc, color (0 white, 1 black), sq, ``attacks`` set, empty-board moves, king context."""
    ks = keys_of(key)
    context = KING_CONTEXT + (carry or [])
    rows = pieces(with_kings(boards), key, context)
    rows = rows.withColumns({
        "cell": (F.col("pc") * 64 + F.col("sq")).cast("int"),
        "color": F.when(F.col("pc") >= 6, 1).when(F.col("pc") >= 0, 0),
        "occupied": F.col("white_all").bitwiseOR(F.col("black_all")),
    })
    rows = rows.join(F.broadcast(S.reach_table(boards.sparkSession)), "cell", "left")
    occ = F.col("occupied")
    seen = [F.col("steps")]
    for d in range(8):
        clip = S.clip_up if d < 4 else S.clip_down
        seen.append(F.when(F.col(f"ray{d}") == 0, F.lit(0).cast("long")).otherwise(
            clip(F.col(f"ray{d}"), F.col(f"inner{d}"), occ)))
    return rows.select(
        *ks, "pc", "color", "sq", S.union(*seen).alias("attacks"), "lone_moves", "lone_targets", "occupied",
        F.when(F.col("color") == 0, F.col("white_all")).otherwise(F.col("black_all")).alias("own"),
        F.when(F.col("color") == 0, F.col("black_all")).otherwise(F.col("white_all")).alias("foe"),
        *context,
    )


def attack_pairs(boards: DataFrame, key) -> DataFrame:
    """Long form: one row per (attacking piece, attacked square), first occupied square included."""
    ks = keys_of(key)
    rows = piece_attacks(boards, key).select(*ks, "color", "pc", F.col("sq").alias("from_sq"), "attacks")
    return S.each_member(rows, "attacks", "to_sq").drop("attacks")


def with_attacked_sets(boards: DataFrame) -> DataFrame:
    """Add ``white_attacks`` and ``black_attacks``: all squares a side attacks, by set-wise fills on one board row.

    Use this when only the attacked area matters: no piece rows, no join, no aggregation.
    """
    out = boards
    if "white_all" not in out.columns:
        out = out.withColumns({"white_all": S.union(*[F.col(n) for n in S.SETS[:6]]), "black_all": S.union(*[F.col(n) for n in S.SETS[6:]])})
    out = out.withColumns({
        "_free": F.bitwise_not(F.col("white_all").bitwiseOR(F.col("black_all"))),
        **{f"_{p}_straight": F.col(p + "r").bitwiseOR(F.col(p + "q")) for _, p in SIDES},
        **{f"_{p}_slanted": F.col(p + "b").bitwiseOR(F.col(p + "q")) for _, p in SIDES}})
    areas = {}
    for side, p in SIDES:
        ahead = S.north(F.col("wp")) if p == "w" else S.south(F.col("bp"))
        areas[f"{side}_attacks"] = S.union(
            S.east(ahead), S.west(ahead), S.knight_hops(F.col(p + "n")), S.king_steps(F.col(p + "k")),
            *[S.slide_all(F.col(f"_{p}_straight"), F.col("_free"), d) for d in (0, 2, 4, 6)],
            *[S.slide_all(F.col(f"_{p}_slanted"), F.col("_free"), d) for d in (1, 3, 5, 7)])
    return out.withColumns(areas).drop("_free", "_w_straight", "_w_slanted", "_b_straight", "_b_slanted")


def _sum(cond: Column, value: Column) -> Column:
    return F.sum(F.when(cond, value).otherwise(0)).cast("bigint")


def _hits(targets: Column) -> Column:
    return S.size(S.common(F.col("attacks"), targets))


def _is(side: str) -> Column:
    return F.col("color") == (0 if side == "white" else 1)


def _other(side: str) -> str:
    return "black" if side == "white" else "white"


def centre_control(boards: DataFrame, key) -> DataFrame:
    rows = piece_attacks(boards, key)
    hit = _hits(S.constant(S.CENTRE))
    out = rows.groupBy(*keys_of(key)).agg(*[_sum(_is(s), hit).alias(f"{s}_center_control") for s, _ in SIDES])
    return out.withColumn("center_control_balance", F.col("white_center_control") - F.col("black_center_control"))


def king_zone_attackers(boards: DataFrame, key) -> DataFrame:
    """Attackers of each square of the 3x3 king zone, counted per square; 0 without a king."""
    rows = piece_attacks(boards, key)
    return rows.groupBy(*keys_of(key)).agg(
        *[_sum(_is(_other(s)), _hits(F.col(f"{s}_king_zone"))).alias(f"{s}_king_attackers") for s, _ in SIDES])


def king_checks(boards: DataFrame, key, turn: str = "white_to_move") -> DataFrame:
    """Attackers of each king and whether the side to move is in check."""
    rows = piece_attacks(boards, key, [turn])
    out = rows.groupBy(*keys_of(key)).agg(
        *[_sum(_is(_other(s)), _hits(F.col(f"{s}_king_bit"))).alias(f"{s}_king_attackers") for s, _ in SIDES],
        F.max(turn).alias("_turn"),
    )
    mine = F.when(F.col("_turn") == 1, F.col("white_king_attackers")).otherwise(F.col("black_king_attackers"))
    return out.withColumn("is_check", (mine > 0).cast("int")).drop("_turn")


def attack_totals(boards: DataFrame, key) -> DataFrame:
    """Attackers per side summed over all occupied and the four centre squares."""
    rows = piece_attacks(boards, key)
    hit = _hits(F.col("occupied").bitwiseOR(S.constant(S.CENTRE)))
    return rows.groupBy(*keys_of(key)).agg(*[_sum(_is(s), hit).alias(f"{s}_attackers") for s, _ in SIDES])


def lone_mobility(boards: DataFrame, key) -> DataFrame:
    """Moves of every piece as if it stood alone on the board, per kind and side, with ratios and advantages."""
    rows = piece_attacks(boards, key)
    aggs = []
    for i, kind in enumerate(KINDS):
        for j, (side, _) in enumerate(SIDES):
            aggs.append(_sum(F.col("pc") == i + 6 * j, F.col("lone_moves")).alias(f"{side}_{kind}_mobility"))
    aggs += [_sum(_is(s), F.col("lone_moves")).alias(f"{s}_mobility") for s, _ in SIDES]
    return rows.groupBy(*keys_of(key)).agg(*aggs)


def mobility_ratio_columns() -> dict[str, Column]:
    out = {"mobility_balance": F.col("white_mobility") - F.col("black_mobility")}
    for s, _ in SIDES:
        rest = F.col(f"{s}_mobility") - F.col(f"{s}_pawn_mobility") - F.col(f"{s}_king_mobility")
        minor = F.col(f"{s}_knight_mobility") + F.col(f"{s}_bishop_mobility")
        out[f"{s}_minor_piece_mobility_ratio"] = minor / F.greatest(F.lit(1), rest)
    for kind in KINDS:
        out[f"{kind}_mobility_advantage"] = F.col(f"white_{kind}_mobility") - F.col(f"black_{kind}_mobility")
    return out


def forks(boards: DataFrame, key) -> DataFrame:
    """Pieces whose empty-board moves land on two or more enemy pieces other than pawns."""
    rows = piece_attacks(boards, key, ["wp", "bp"])
    victims = S.without(F.col("foe"), F.col("wp").bitwiseOR(F.col("bp")))
    forking = S.size(S.common(F.col("lone_targets"), victims)) >= 2
    aggs = []
    for j, (side, _) in enumerate(SIDES):
        for i, kind in enumerate(KINDS[:5]):
            aggs.append(F.count_if(forking & (F.col("pc") == i + 6 * j)).alias(f"{side}_{kind}_forks"))
        aggs.append(F.count_if(forking & _is(side)).alias(f"{side}_total_forks"))
    return rows.groupBy(*keys_of(key)).agg(*aggs)


def king_rays(boards: DataFrame, key, carry: list[str] | None = None) -> DataFrame:
    """First and second piece seen from each king along each direction, as one-square sets."""
    ks = keys_of(key)
    kings = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_king_sq").alias("ray_sq"),
                               F.col(f"{s}_all").alias("own"), F.col(f"{_other(s)}_all").alias("foe")) for s, _ in SIDES])
    straight = S.union(*[F.col(n) for n in ("wr", "wq", "br", "bq")])
    slanted = S.union(*[F.col(n) for n in ("wb", "wq", "bb", "bq")])
    rows = (
        with_kings(boards)
        .select(*ks, *(carry or []), straight.alias("straight"), slanted.alias("slanted"), F.explode(kings).alias("k"))
        .select(*ks, *(carry or []), "straight", "slanted", "k.*")
        .filter(F.col("ray_sq").isNotNull())
        .join(F.broadcast(S.ray_table(boards.sparkSession)), "ray_sq")
        .withColumn("occupied", F.col("own").bitwiseOR(F.col("foe")))
        .withColumn("sliders", F.when(F.col("dir") % 2 == 0, F.col("straight")).otherwise(F.col("slanted")))
    )

    def nearest(occ: Column) -> Column:
        view = F.when(F.col("dir") < 4, S.clip_up(F.col("ray"), F.col("inner"), occ)).otherwise(
            S.clip_down(F.col("ray"), F.col("inner"), occ))
        return S.common(view, occ)

    rows = rows.withColumn("first", nearest(F.col("occupied")))
    rows = rows.withColumn("rest", S.without(F.col("occupied"), F.col("first")))
    return rows.withColumn("second", nearest(F.col("rest"))).drop("rest")


def pins(boards: DataFrame, key) -> DataFrame:
    """Own pieces between the own king and an enemy slider of the matching direction, each pin once."""
    ks = keys_of(key)
    sets = [n for n in S.SETS if n[1] != "k"]
    rows = king_rays(boards, key, sets)
    pinned = S.has(S.common(F.col("first"), F.col("own"))) & S.has(
        S.common(S.common(F.col("second"), F.col("foe")), F.col("sliders")))
    rows = rows.filter(pinned)
    aggs = []
    for side, p in SIDES:
        mine = F.col("side") == side
        for kind, k in zip(KINDS[:5], "pnbrq"):
            aggs.append(F.count_if(mine & S.has(S.common(F.col("first"), F.col(p + k)))).alias(f"{side}_pinned_{kind}s"))
        aggs.append(F.count_if(mine).alias(f"{side}_total_pinned_pieces"))
    return _every_board(boards, rows.groupBy(*ks).agg(*aggs), ks)


def _every_board(boards: DataFrame, found: DataFrame, ks: list[str]) -> DataFrame:
    names = [c for c in found.columns if c not in ks]
    return boards.select(*ks).join(found, ks, "left").fillna(0, subset=names)


def discovered_attacks(boards: DataFrame, key) -> DataFrame:
    """Own piece, then own slider of the matching direction, seen from the enemy king."""
    ks = keys_of(key)
    rows = king_rays(boards, key)
    hidden = S.has(S.common(F.col("first"), F.col("foe"))) & S.has(
        S.common(S.common(F.col("second"), F.col("foe")), F.col("sliders")))
    rows = rows.filter(hidden)
    found = rows.groupBy(*ks).agg(
        *[F.count_if(F.col("side") == _other(s)).alias(f"{s}_discovered_attacks") for s, _ in SIDES])
    return _every_board(boards, found, ks)


def king_ray_features(boards: DataFrame, key) -> DataFrame:
    """Pins and discovered attacks of both sides from one pass over the king rays; boards without any are absent."""
    sets = [n for n in S.SETS if n[1] != "k"]
    rows = king_rays(boards, key, sets)
    slider = S.has(S.common(S.common(F.col("second"), F.col("foe")), F.col("sliders")))
    rows = rows.withColumns({"pin": slider & S.has(S.common(F.col("first"), F.col("own"))),
                             "hidden": slider & S.has(S.common(F.col("first"), F.col("foe")))}).filter("pin or hidden")
    aggs = []
    for side, p in SIDES:
        pin = F.col("pin") & (F.col("side") == side)
        for kind, k in zip(KINDS[:5], "pnbrq"):
            aggs.append(F.count_if(pin & S.has(S.common(F.col("first"), F.col(p + k)))).alias(f"{side}_pinned_{kind}s"))
        aggs.append(F.count_if(pin).alias(f"{side}_total_pinned_pieces"))
        aggs.append(F.count_if(F.col("hidden") & (F.col("side") == _other(side))).alias(f"{side}_discovered_attacks"))
    return rows.groupBy(*keys_of(key)).agg(*aggs)


def tactical_total_columns(weights: dict[str, int] | None = None) -> dict[str, Column]:
    w = weights or TACTICS
    pin = F.col("white_total_pinned_pieces") - F.col("black_total_pinned_pieces")
    fork = F.col("white_total_forks") - F.col("black_total_forks")
    found = F.col("white_discovered_attacks") - F.col("black_discovered_attacks")
    return {"tactical_advantage_pins": pin, "tactical_advantage_forks": fork, "tactical_advantage_discovered": found,
            "overall_tactical_advantage": pin * w["pins"] + fork * w["forks"] + found * w["discovered_attacks"]}


def tactical_totals(boards: DataFrame, key, weights: dict[str, int] | None = None) -> DataFrame:
    """Pins, forks and discovered attacks per side, their differences and the weighted sum.

    Both parts are keyed alike, so the join needs no partitioning beyond that of the aggregations.
    """
    ks = keys_of(key)
    out = forks(boards, key).join(king_ray_features(boards, key), ks, "left").fillna(0)
    return out.withColumns(tactical_total_columns(weights))


def _pushes(side: str) -> Column:
    """Quiet pawn moves from the sets of a board row; a move to the last rank counts as its four promotions."""
    every = S.union(*[F.col(n) for n in S.SETS])
    free = F.bitwise_not(every)
    if side == "white":
        one = S.common(S.north(F.col("wp")), free)
        two = S.common(S.common(S.north(one), free), S.constant(S.rank_bits(2) | S.rank_bits(3)))
        last = S.constant(S.rank_bits(7))
    else:
        one = S.common(S.south(F.col("bp")), free)
        two = S.common(S.common(S.south(one), free), S.constant(S.rank_bits(5) | S.rank_bits(4)))
        last = S.constant(S.rank_bits(0))
    return S.size(one) + S.size(two) + S.size(S.common(one, last)) * 3


def _move_total(turn: str) -> Column:
    """Sum over piece rows of the moves of the side to move, plus the quiet pawn moves carried in ``_push``."""
    takes = S.common(F.col("attacks"), F.col("foe"))
    last = S.constant(S.rank_bits(7) | S.rank_bits(0))
    count = F.when(F.col("pc") % 6 == 0, S.size(takes) + 3 * S.size(S.common(takes, last))).otherwise(
        S.size(S.without(F.col("attacks"), F.col("own"))))
    mover = F.col("color") == F.when(F.col(turn) == 1, 0).otherwise(1)
    return _sum(mover, count) + F.max("_push")


def _with_pushes(boards: DataFrame, turn: str) -> DataFrame:
    return boards.withColumn("_push", F.when(F.col(turn) == 1, _pushes("white")).otherwise(_pushes("black")))


def move_counts(boards: DataFrame, key, turn: str = "white_to_move") -> DataFrame:
    """Pseudo-legal moves of the side to move: no castling, no en passant, checks and pins not looked at."""
    rows = piece_attacks(_with_pushes(boards, turn), key, [turn, "_push"])
    return rows.groupBy(*keys_of(key)).agg(_move_total(turn).alias("move_count"))


def king_set(boards: DataFrame, key) -> DataFrame:
    """Per side: king mobility, enemy attacks on and own guards of the ring, centrality, checked.

    Mobility counts ring squares free of own pieces, centrality is 3 minus the distance to the centre, a ring hit
    is one piece-square pair. These definitions are this library's own.
    """
    rows = piece_attacks(boards, key)
    ring = {s: S.without(F.col(f"{s}_king_zone"), F.col(f"{s}_king_bit")) for s, _ in SIDES}
    aggs = []
    for s, _ in SIDES:
        k = F.col(f"{s}_king_sq")
        f, r = k % 8, F.floor(k / 8).cast("int")
        away = F.greatest(F.greatest(3 - f, f - 4, F.lit(0)), F.greatest(3 - r, r - 4, F.lit(0)))
        aggs += [
            F.max(S.size(S.without(ring[s], F.col(f"{s}_all")))).cast("bigint").alias(f"{s}_king_mobility"),
            _sum(_is(_other(s)), _hits(ring[s])).alias(f"{s}_ring_attackers"),
            _sum(_is(s), _hits(ring[s])).alias(f"{s}_ring_defenders"),
            F.max(F.when(k.isNull(), 0).otherwise(3 - away)).cast("bigint").alias(f"{s}_king_centrality"),
            F.max(F.when(_is(_other(s)) & (_hits(F.col(f"{s}_king_bit")) > 0), 1).otherwise(0)).alias(f"{s}_checked"),
        ]
    return rows.groupBy(*keys_of(key)).agg(*aggs)


def board_set(boards: DataFrame, key) -> DataFrame:
    """Per side: bishop pair, mobility by kind (attacked squares without own pieces), guarded own pieces."""
    rows = piece_attacks(boards, key, ["wb", "bb"])
    reach = S.size(S.without(F.col("attacks"), F.col("own")))
    aggs = []
    for j, (s, p) in enumerate(SIDES):
        aggs.append(F.max((S.size(F.col(p + "b")) >= 2).cast("int")).alias(f"{s}_bishop_pair"))
        for kind, code in (("queens", 4), ("rooks", 3), ("knights", 1), ("bishops", 2)):
            aggs.append(_sum(F.col("pc") == code + 6 * j, reach).alias(f"{s}_{kind}_mobility"))
        guarded = F.bit_or(F.when(_is(s), S.common(F.col("attacks"), F.col("own"))).otherwise(F.lit(0).cast("long")))
        aggs.append(S.size(guarded).alias(f"{s}_connectivity"))
    return rows.groupBy(*keys_of(key)).agg(*aggs)


def attack_features(boards: DataFrame, key, turn: str = "white_to_move") -> DataFrame:
    """Everything that needs attack sets in one pass: centre, zones, checks, mobility, forks, move count."""
    rows = piece_attacks(_with_pushes(boards, turn), key, [turn, "_push", "wp", "bp"])
    victims = S.without(F.col("foe"), F.col("wp").bitwiseOR(F.col("bp")))
    rows = rows.withColumns({
        "_centre": _hits(S.constant(S.CENTRE)),
        "_forking": S.size(S.common(F.col("lone_targets"), victims)) >= 2,
    })
    aggs = []
    for j, (s, _) in enumerate(SIDES):
        mine, other = _is(s), _is(_other(s))
        aggs.append(_sum(mine, F.col("_centre")).alias(f"{s}_center_control"))
        aggs.append(_sum(other, _hits(F.col(f"{s}_king_zone"))).alias(f"{s}_king_attackers"))
        aggs.append(_sum(other, _hits(F.col(f"{s}_king_bit"))).alias(f"{s}_checkers"))
        aggs.append(_sum(mine, F.col("lone_moves")).alias(f"{s}_mobility"))
        for i, kind in enumerate(KINDS):
            aggs.append(_sum(F.col("pc") == i + 6 * j, F.col("lone_moves")).alias(f"{s}_{kind}_mobility"))
        for i, kind in enumerate(KINDS[:5]):
            aggs.append(F.count_if(F.col("_forking") & (F.col("pc") == i + 6 * j)).alias(f"{s}_{kind}_forks"))
        aggs.append(F.count_if(F.col("_forking") & mine).alias(f"{s}_total_forks"))
    aggs.append(_move_total(turn).alias("move_count"))
    return rows.groupBy(*keys_of(key)).agg(*aggs)


def king_safety(boards: DataFrame, key, weights: dict[str, int] | None = None) -> DataFrame:
    """Weighted score of pawn shield, zone attackers, open files and wing position per king."""
    from .boards import king_open_file_columns, king_safety_columns, king_wing_columns, pawn_shield_columns

    ks = keys_of(key)
    ready = with_kings(boards)
    parts = ready.withColumns({**pawn_shield_columns(), **king_open_file_columns(), **king_wing_columns()})
    keep = [f"{s}_{c}" for s, _ in SIDES for c in ("king_sq", "pawn_shield", "king_open_files", "king_castled_kingside",
                                                 "king_castled_queenside")]
    joined = parts.select(*ks, *keep).join(king_zone_attackers(boards, key), ks)
    return joined.select(*ks, *[c.alias(n) for n, c in king_safety_columns(weights).items()])
