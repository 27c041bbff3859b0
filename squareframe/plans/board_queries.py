"""Registered board queries: positions, pawns, kings, attacks, endgames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import squares as S
from ..operators import attacks as A
from ..operators import boards as B
from ..operators import endgames as E
from ..operators import evaluate as V
from . import inputs as I
from . import oracle_text as O
from .registry import register, table

K = "board_id"


def _proj(spark, sf, columns, kings=False, per=8):
    b = I.boards(spark, sf, per)
    return E.project(B.with_kings(b) if kings else b, K, columns)


def _count(cond: str, name: str) -> str:
    return f"CAST(count(*) FILTER ({cond}) AS BIGINT) AS {name}"


def _both(template: str) -> str:
    """Fill a column template for white (0) and black (1)."""
    return ",\n ".join(template.format(s=s, c=c, o=1 - c, p=p) for s, c, p in (("white", 0, "w"), ("black", 1, "b")))


MATERIAL = "CASE kind WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 5 WHEN 4 THEN 9 ELSE 0 END"
MATERIAL_CTE = f"""mat AS (SELECT board_id, CAST(sum({MATERIAL} * (1 - 2*color)) AS BIGINT) AS material_balance,
  CAST(sum({MATERIAL}) AS BIGINT) AS total_material FROM p GROUP BY 1)"""
NAMES = ["pawns", "knights", "bishops", "rooks", "queens", "kings"]

# ---------------------------------------------------------------- decoding


@register("board_squares", "B1 S9", O.with_(O.BD) + """SELECT board_id, sq, f AS file, r AS rank,
  CASE WHEN color = 0 THEN 'white' ELSE 'black' END AS color, substr('PNBRQKpnbrqk', pc + 1, 1) AS piece FROM p""")
def board_squares(spark, sf):
    return B.squares_table(B.decode_positions(I.fens(spark, sf)), K)


@register("position_header", "B2", O.with_(O.FENS) + """SELECT board_id, CAST(split_part(fen, ' ', 2) = 'w' AS INT) AS white_to_move,
  CAST(contains(split_part(fen, ' ', 3), 'K') AS INT) AS can_castle_wk, CAST(contains(split_part(fen, ' ', 3), 'Q') AS INT) AS can_castle_wq,
  CAST(contains(split_part(fen, ' ', 3), 'k') AS INT) AS can_castle_bk, CAST(contains(split_part(fen, ' ', 3), 'q') AS INT) AS can_castle_bq,
  CAST(split_part(fen, ' ', 5) AS INT) AS halfmove_clock, CAST(split_part(fen, ' ', 6) AS INT) AS fullmove_number FROM fens""")
def position_header(spark, sf):
    return E.project(I.fens(spark, sf), K, B.header_columns(F.col("fen")))


_COUNTS = ", ".join(_count(f"pc = {i + 6 * c}", f"{s}_{n}") for c, s in enumerate(("white", "black")) for i, n in enumerate(NAMES))


@register("piece_counts", "B3", O.with_(O.BD) + f"SELECT board_id, {_COUNTS} FROM p GROUP BY 1")
def piece_counts(spark, sf):
    return E.project(I.boards(spark, sf), K, B.piece_count_columns())


@register("piece_counts_from_position", "B3 B1", O.with_(O.BD) + f"SELECT board_id, {_COUNTS} FROM p GROUP BY 1")
def piece_counts_from_position(spark, sf):
    return E.project(B.decode_positions(I.fens(spark, sf)), K, B.piece_count_columns())


@register("position_key", "B40", O.with_(O.FENS) + "SELECT board_id, split_part(fen, ' ', 1) AS placement FROM fens")
def position_key(spark, sf):
    return E.project(I.fens(spark, sf), K, {"placement": B.placement_key(F.col("fen"))})


@register("position_is_valid", "V8", O.with_(O.FENS) + """, bent AS (SELECT board_id, CASE WHEN board_id % 7 = 0 THEN replace(fen, '/', '1/')
    WHEN board_id % 7 = 1 THEN replace(fen, ' - ', ' ') WHEN board_id % 7 = 2 THEN regexp_replace(fen, '/', '') ELSE fen END AS fen FROM fens)
  SELECT board_id, CAST(regexp_matches(fen, '^[1-8PNBRQKpnbrqk/]+ [wb] (-|K?Q?k?q?) (-|[a-h][36]) [0-9]+ [0-9]+$')
    AND len(split(split_part(fen, ' ', 1), '/')) = 8
    AND len(list_filter(split(split_part(fen, ' ', 1), '/'), lambda x: list_sum(list_transform(split(x, ''),
        lambda y: CASE WHEN y BETWEEN '1' AND '8' THEN CAST(y AS INT) ELSE 1 END)) <> 8)) = 0 AS INT) AS valid FROM bent""")
def position_is_valid(spark, sf):
    f = F.col("fen")
    bent = I.fens(spark, sf).withColumn("fen", F.when(F.col(K) % 7 == 0, F.replace(f, F.lit("/"), F.lit("1/")))
                                       .when(F.col(K) % 7 == 1, F.replace(f, F.lit(" - "), F.lit(" ")))
                                       .when(F.col(K) % 7 == 2, F.regexp_replace(f, "^([^/]*)/", "$1")).otherwise(f))
    return bent.select(K, B.is_position(F.col("fen")).cast("int").alias("valid"))


@register("side_relative_material", "B35", O.with_(O.FENS) + f"""SELECT board_id,
 {", ".join(_count(f"kind = {i} AND color = board_id % 2", f"active_{k}_count") for i, k in enumerate(B.KINDS))},
 {", ".join(_count(f"kind = {i} AND color <> board_id % 2", f"opponent_{k}_count") for i, k in enumerate(B.KINDS))},
 CAST(sum(CASE WHEN color = board_id % 2 THEN {MATERIAL} ELSE 0 END) AS BIGINT) AS active_material,
 CAST(sum(CASE WHEN color <> board_id % 2 THEN {MATERIAL} ELSE 0 END) AS BIGINT) AS opponent_material,
 CAST(sum(CASE WHEN color = board_id % 2 THEN {MATERIAL} ELSE -{MATERIAL} END) AS BIGINT) AS material_diff,
 CAST(sum({MATERIAL}) AS BIGINT) AS total_material FROM p GROUP BY 1""")
def side_relative_material(spark, sf):
    return E.project(B.decode_positions(I.fens(spark, sf)), K, B.side_relative_columns())


@register("position_similarity", "B41", O.with_(O.BD) + """SELECT a.board_id, 1.0 - CAST(count(*) FILTER (x.pc IS DISTINCT FROM y.pc) AS DOUBLE) / 64 AS similarity
  FROM ids a JOIN ids b ON b.board_id = a.board_id + 1 CROSS JOIN (SELECT CAST(range AS INT) AS sq FROM range(64)) s
  LEFT JOIN bd x ON x.board_id = a.board_id AND x.sq = s.sq LEFT JOIN bd y ON y.board_id = b.board_id AND y.sq = s.sq GROUP BY 1""")
def position_similarity(spark, sf):
    b = I.boards(spark, sf).drop("white_to_move")
    planes = b.select(K, *[c.alias(f"p{k}") for k, c in enumerate(B.bit_planes())])
    left = planes.select(K, *[F.col(f"p{k}").alias(f"a_p{k}") for k in range(4)])
    right = planes.select((F.col(K) - 1).alias(K), *[F.col(f"p{k}").alias(f"b_p{k}") for k in range(4)])
    return left.join(right, K).select(K, B.position_similarity("a_", "b_").alias("similarity"))


# ---------------------------------------------------------------- material and phase

@register("material_balance", "B4", O.with_(O.BD, MATERIAL_CTE) + "SELECT * FROM mat")
def material_balance(spark, sf):
    return _proj(spark, sf, B.material_columns())


@register("game_phase", "B24", O.with_(O.BD, MATERIAL_CTE) + """SELECT board_id, CAST(total_material < 30 AS INT) AS is_endgame,
  CAST(total_material BETWEEN 30 AND 62 AS INT) AS is_middlegame, CAST(total_material > 62 AS INT) AS is_opening FROM mat""")
def game_phase(spark, sf):
    return _proj(spark, sf, E.phase_columns())


@register("game_phase_by_pieces", "B25", O.with_(O.BD, MATERIAL_CTE) + """, n AS (SELECT board_id, count(*) FILTER (kind BETWEEN 1 AND 4) AS n FROM p GROUP BY 1)
  SELECT board_id, CAST(n >= 6 AND total_material >= 24 AS INT) AS opening_phase,
  CAST(n BETWEEN 3 AND 5 OR (n >= 6 AND total_material < 24) AS INT) AS middlegame_phase,
  CAST(n < 3 OR total_material < 15 AS INT) AS endgame_phase FROM mat JOIN n USING (board_id)""")
def game_phase_by_pieces(spark, sf):
    return _proj(spark, sf, E.piece_phase_columns())


_SMALL = O.bd(1)
_KINDS_CTE = """k AS (SELECT board_id, count(*) FILTER (kind = 0) AS p, count(*) FILTER (kind = 1) AS n, count(*) FILTER (kind = 2) AS b,
  count(*) FILTER (kind = 3) AS r, count(*) FILTER (kind = 4) AS q, min(sq) FILTER (pc = 2) AS wbs, min(sq) FILTER (pc = 8) AS bbs,
  count(*) FILTER (pc = 2) AS wb, count(*) FILTER (pc = 8) AS bb,
  coalesce(sum(CASE kind WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 5 WHEN 4 THEN 9 ELSE 0 END), 0) AS m FROM p GROUP BY 1),
e AS (SELECT *, (q = 0 OR q + r + b + n <= 2 OR m <= 20) AS eg FROM k)"""


@register("endgame_predicate", "B26", O.with_(_SMALL, _KINDS_CTE) + "SELECT board_id, CAST(eg AS INT) AS is_endgame FROM e")
def endgame_predicate(spark, sf):
    return _proj(spark, sf, {"is_endgame": E.is_endgame().cast("int")}, per=1)


@register("endgame_type", "B27", O.with_(_SMALL, _KINDS_CTE) + """SELECT board_id, CAST(eg AS INT) AS is_endgame,
  CAST(eg AND p > 0 AND n + b + r + q = 0 AS INT) AS king_pawn_endgame, CAST(eg AND r > 0 AND q = 0 AS INT) AS rook_endgame,
  CAST(eg AND n + b > 0 AND r = 0 AND q = 0 AS INT) AS minor_piece_endgame, CAST(eg AND q > 0 AS INT) AS queen_endgame FROM e""")
def endgame_type(spark, sf):
    return _proj(spark, sf, E.endgame_type_columns(), per=1)


@register("bishop_colours", "B28", O.with_(_SMALL, _KINDS_CTE) + """SELECT board_id,
  CAST(coalesce(eg AND wb = 1 AND bb = 1 AND (wbs % 8 + wbs // 8) % 2 <> (bbs % 8 + bbs // 8) % 2, false) AS INT) AS opposite_colored_bishops,
  CAST(coalesce(eg AND wb = 1 AND bb = 1 AND (wbs % 8 + wbs // 8) % 2 = (bbs % 8 + bbs // 8) % 2, false) AS INT) AS same_colored_bishops FROM e""")
def bishop_colours(spark, sf):
    return _proj(spark, sf, E.bishop_colour_columns(), per=1)


_KING_PAIR = """kp AS (SELECT i.board_id, w.sq AS wsq, w.f AS wf, w.r AS wr, b.sq AS bsq, b.f AS bf, b.r AS br FROM ids i
  LEFT JOIN kings w ON w.board_id = i.board_id AND w.color = 0 LEFT JOIN kings b ON b.board_id = i.board_id AND b.color = 1)"""


@register("king_geometry", "B29 X14 X15", O.with_(O.BD, _KING_PAIR) + """, c AS (SELECT board_id,
   least(greatest(abs(wf-3),abs(wr-3)), greatest(abs(wf-4),abs(wr-3)), greatest(abs(wf-3),abs(wr-4)), greatest(abs(wf-4),abs(wr-4))) AS wc,
   least(greatest(abs(bf-3),abs(br-3)), greatest(abs(bf-4),abs(br-3)), greatest(abs(bf-3),abs(br-4)), greatest(abs(bf-4),abs(br-4))) AS bc,
   least(wf, 7-wf, wr, 7-wr) AS we, least(bf, 7-bf, br, 7-br) AS be, greatest(abs(wf-bf), abs(wr-br)) AS kd,
   (wf = bf OR wr = br) AS aligned, wsq IS NOT NULL AND bsq IS NOT NULL AS ok FROM kp)
  SELECT board_id, CASE WHEN ok THEN wc ELSE 0 END AS white_king_center_distance, CASE WHEN ok THEN bc ELSE 0 END AS black_king_center_distance,
   CASE WHEN ok THEN we ELSE 0 END AS white_king_edge_distance, CASE WHEN ok THEN be ELSE 0 END AS black_king_edge_distance,
   CASE WHEN ok THEN kd ELSE 0 END AS king_distance, CASE WHEN ok AND kd = 2 AND aligned THEN 1 ELSE 0 END AS has_opposition FROM c""")
def king_geometry(spark, sf):
    return _proj(spark, sf, E.king_geometry_columns(), kings=True)


@register("small_board_verdict", "B34", O.with_(_SMALL) + """, n AS (SELECT board_id, count(*) AS t,
   count(*) FILTER (color = 0) AS w, count(*) FILTER (color = 1) AS b,
   string_agg(substr('PNBRQK', kind + 1, 1), '' ORDER BY kind) FILTER (color = 0) AS ws,
   string_agg(substr('PNBRQK', kind + 1, 1), '' ORDER BY kind) FILTER (color = 1) AS bs,
   count(*) FILTER (pc = 0) AS wp, count(*) FILTER (pc = 6) AS bp, min(r) FILTER (pc = 0) AS wpr, min(r) FILTER (pc = 6) AS bpr,
   count(*) FILTER (pc=4) AS wq, count(*) FILTER (pc=10) AS bq, count(*) FILTER (pc=3) AS wr, count(*) FILTER (pc=9) AS br,
   count(*) FILTER (pc=1) AS wn, count(*) FILTER (pc=7) AS bn, count(*) FILTER (pc=2) AS wb, count(*) FILTER (pc=8) AS bb
   FROM p GROUP BY 1),
  m AS (SELECT *, CASE WHEN w >= b THEN ws ELSE bs END AS big, CASE WHEN w = 1 OR b = 1 THEN greatest(w, b) ELSE 0 END AS lead FROM n),
  v AS (SELECT *, CASE WHEN t > 5 THEN 'none'
     WHEN lead = 2 AND length(replace(big, 'Q', '')) = 1 THEN 'win' WHEN lead = 2 AND length(replace(big, 'R', '')) = 1 THEN 'win'
     WHEN lead = 3 AND length(replace(big, 'B', '')) = 2 AND length(replace(big, 'N', '')) = 2 THEN 'win'
     WHEN lead = 2 AND length(replace(big, 'P', '')) = 1 THEN CASE WHEN (CASE WHEN wp = 1 THEN wpr >= 5 ELSE bpr <= 2 END) THEN 'win' ELSE 'draw' END
     WHEN lead = 2 AND (length(replace(big, 'N', '')) = 1 OR length(replace(big, 'B', '')) = 1) THEN 'draw'
     WHEN w = 1 AND b = 1 THEN 'draw' ELSE 'none' END AS verdict FROM m)
  SELECT board_id, CAST(t <= 5 AS INT) AS in_tablebase, CAST(verdict = 'win' AS INT) AS theoretical_win,
    CAST(verdict = 'draw' AS INT) AS theoretical_draw, CASE WHEN verdict <> 'win' THEN 0 WHEN wq = 1 OR bq = 1 THEN 10 WHEN wr = 1 OR br = 1 THEN 16
    WHEN (wb = 1 AND wn = 1) OR (bb = 1 AND bn = 1) THEN 33 WHEN wp = 1 OR bp = 1 THEN 15 ELSE 0 END AS tablebase_dtm_estimate FROM v""")
def small_board_verdict(spark, sf):
    return _proj(spark, sf, E.small_board_columns(), per=1)


# ---------------------------------------------------------------- pawns

@register("doubled_pawns", "B5", O.with_(O.BD) + """, c AS (SELECT board_id, color, f, count(*) AS n FROM p WHERE kind = 0 GROUP BY 1, 2, 3)
  SELECT board_id, """ + _both("CAST(count(*) FILTER (color = {c} AND n > 1) AS BIGINT) AS {s}_doubled_pawns")
  + " FROM ids LEFT JOIN c USING (board_id) GROUP BY 1")
def doubled_pawns(spark, sf):
    return _proj(spark, sf, {f"{s}_doubled_pawns": B.doubled_files(F.col(p + "p")) for s, p in B.SIDES})


_FILES = "c AS (SELECT DISTINCT board_id, color, f FROM p WHERE kind = 0)"


@register("isolated_pawns", "B6", O.with_(O.BD, _FILES) + """SELECT board_id, """
  + _both("""CAST(count(*) FILTER (a.color = {c} AND NOT EXISTS (SELECT 1 FROM c b WHERE b.board_id = a.board_id AND b.color = a.color
     AND abs(b.f - a.f) = 1)) AS BIGINT) AS {s}_isolated_pawns""") + " FROM ids LEFT JOIN c a USING (board_id) GROUP BY 1")
def isolated_pawns(spark, sf):
    return _proj(spark, sf, {f"{s}_isolated_pawns": B.isolated_files(F.col(p + "p")) for s, p in B.SIDES})


@register("pawn_islands", "B8 W11", O.with_(O.BD, _FILES) + """, g AS (SELECT *, f - lag(f) OVER (PARTITION BY board_id, color ORDER BY f) AS gap FROM c)
  SELECT board_id, """ + _both("CAST(count(*) FILTER (color = {c} AND (gap IS NULL OR gap > 1)) AS BIGINT) AS {s}_pawn_islands")
  + " FROM ids LEFT JOIN g USING (board_id) GROUP BY 1")
def pawn_islands(spark, sf):
    return _proj(spark, sf, {f"{s}_pawn_islands": B.islands(F.col(p + "p")) for s, p in B.SIDES})


@register("pawn_chains", "B7", "WITH RECURSIVE " + O.BD + """, w AS (SELECT board_id, color, sq, f, r FROM p WHERE kind = 0),
  edge AS (SELECT a.board_id, a.color, a.sq AS a, b.sq AS b FROM w a JOIN w b ON a.board_id = b.board_id AND a.color = b.color
     AND abs(a.f - b.f) = 1 AND abs(a.r - b.r) = 1),
  reach AS (SELECT board_id, color, a, b FROM edge UNION SELECT r.board_id, r.color, r.a, e.b FROM reach r JOIN edge e
     ON e.board_id = r.board_id AND e.color = r.color AND e.a = r.b),
  comp AS (SELECT board_id, color, a, min(b) AS root FROM reach GROUP BY 1, 2, 3),
  sizes AS (SELECT board_id, color, root, count(*) AS n FROM comp GROUP BY 1, 2, 3)
  SELECT board_id, """ + _both("""CAST(count(*) FILTER (color = {c}) AS BIGINT) AS {s}_pawn_chains,
   CAST(coalesce(max(n) FILTER (color = {c}), 0) AS BIGINT) AS {s}_longest_chain,
   CAST(coalesce(sum(n) FILTER (color = {c}), 0) AS BIGINT) AS {s}_pawns_in_chains""")
  + " FROM ids LEFT JOIN sizes USING (board_id) GROUP BY 1")
def pawn_chains(spark, sf):
    return B.pawn_chains(I.boards(spark, sf), K)


_PASSED = """pass AS (SELECT a.* FROM p a WHERE kind = 0 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.board_id = a.board_id AND b.kind = 0
  AND b.color <> a.color AND abs(b.f - a.f) <= 1 AND CASE WHEN a.color = 0 THEN b.r > a.r ELSE b.r < a.r END))"""


@register("passed_pawns", "B30 J16", O.with_(O.BD, _PASSED) + "SELECT board_id, "
          + _both("CAST(count(*) FILTER (color = {c}) AS BIGINT) AS {s}_passed_pawns") + " FROM ids LEFT JOIN pass USING (board_id) GROUP BY 1")
def passed_pawns(spark, sf):
    return _proj(spark, sf, B.passed_pawn_columns())


@register("passed_pawn_squares", "J16", O.with_(O.BD, _PASSED) + "SELECT board_id, color, sq FROM pass")
def passed_pawn_squares(spark, sf):
    sides = F.array(*[F.struct(F.lit(c).alias("color"), B.passed(p).alias("who")) for c, p in enumerate("wb")])
    rows = I.boards(spark, sf).select(K, F.explode(sides).alias("s")).select(K, "s.color", "s.who")
    return S.each_member(rows, "who").drop("who")


@register("most_advanced_pawn", "B31", O.with_(O.BD) + """SELECT board_id, coalesce(max(r) FILTER (pc = 0), 0) AS white_most_advanced_pawn_rank,
  coalesce(7 - min(r) FILTER (pc = 6), 0) AS black_most_advanced_pawn_rank FROM p GROUP BY 1""")
def most_advanced_pawn(spark, sf):
    return _proj(spark, sf, B.most_advanced_columns())


@register("connected_passed_pawns", "B32", O.with_(O.BD, _PASSED) + """, pf AS (SELECT DISTINCT board_id, color, f FROM pass),
  duo AS (SELECT a.board_id, a.color FROM pf a JOIN pf b ON a.board_id = b.board_id AND a.color = b.color AND b.f = a.f + 1)
  SELECT board_id, """ + _both("CAST(count(*) FILTER (color = {c}) AS BIGINT) AS {s}_connected_passed_pawns")
  + " FROM ids LEFT JOIN duo USING (board_id) GROUP BY 1")
def connected_passed_pawns(spark, sf):
    return _proj(spark, sf, B.connected_passed_columns())


@register("pawn_set", "B37", O.with_(O.BD, _PASSED, _FILES) + """, blk AS (SELECT a.board_id, a.color FROM p a JOIN p b ON b.board_id = a.board_id
     AND b.sq = a.sq + CASE WHEN a.color = 0 THEN 8 ELSE -8 END WHERE a.kind = 0),
  dbl AS (SELECT board_id, color, f FROM p WHERE kind = 0 GROUP BY 1, 2, 3 HAVING count(*) > 1),
  iso AS (SELECT a.* FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.board_id = a.board_id AND b.color = a.color AND abs(b.f - a.f) = 1)),
  u AS (SELECT board_id, color, 1 AS t FROM pass UNION ALL SELECT board_id, color, 2 FROM iso UNION ALL SELECT board_id, color, 3 FROM dbl
     UNION ALL SELECT board_id, color, 4 FROM blk)
  SELECT board_id, """ + _both("""CAST(count(*) FILTER (color = {c} AND t = 1) AS BIGINT) AS {s}_passed,
  CAST(count(*) FILTER (color = {c} AND t = 2) AS BIGINT) AS {s}_isolated, CAST(count(*) FILTER (color = {c} AND t = 3) AS BIGINT) AS {s}_doubled,
  CAST(count(*) FILTER (color = {c} AND t = 4) AS BIGINT) AS {s}_blocked""") + " FROM ids LEFT JOIN u USING (board_id) GROUP BY 1")
def pawn_set(spark, sf):
    return _proj(spark, sf, B.pawn_set_columns())


# ---------------------------------------------------------------- kings

_WING = _both("CAST(coalesce({p}f >= 6, false) AS INT) AS {s}_king_castled_kingside, CAST(coalesce({p}f <= 2, false) AS INT) AS {s}_king_castled_queenside, "
              "CAST(coalesce({p}f BETWEEN 3 AND 4, false) AS INT) AS {s}_king_center")


@register("king_wings", "B10", O.with_(O.BD, _KING_PAIR) + f"SELECT board_id, {_WING} FROM kp")
def king_wings(spark, sf):
    return _proj(spark, sf, B.king_wing_columns(), kings=True)


_SHIELD = """sh AS (SELECT k.board_id, k.color FROM kings k JOIN p ON p.board_id = k.board_id AND p.color = k.color AND p.kind = 0 AND abs(p.f - k.f) <= 1
  AND (CASE WHEN (k.color = 0 AND k.r <= 5) OR (k.color = 1 AND k.r < 2) THEN p.r - k.r ELSE k.r - p.r END) BETWEEN 1 AND 2)"""
_OPEN = """op AS (SELECT k.board_id, k.color FROM kings k JOIN range(8) t(f) ON abs(t.f - k.f) <= 1
  WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.board_id = k.board_id AND p.kind = 0 AND p.f = t.f))"""


@register("pawn_shield", "B12", O.with_(O.BD, _SHIELD) + "SELECT board_id, "
          + _both("CAST(count(*) FILTER (color = {c}) AS BIGINT) AS {s}_pawn_shield") + " FROM ids LEFT JOIN sh USING (board_id) GROUP BY 1")
def pawn_shield(spark, sf):
    return _proj(spark, sf, B.pawn_shield_columns(), kings=True)


@register("king_open_files", "B13", O.with_(O.BD, _OPEN) + "SELECT board_id, "
          + _both("CAST(count(*) FILTER (color = {c}) AS BIGINT) AS {s}_king_open_files") + " FROM ids LEFT JOIN op USING (board_id) GROUP BY 1")
def king_open_files(spark, sf):
    return _proj(spark, sf, B.king_open_file_columns(), kings=True)


@register("developed_minors", "B15", O.with_(O.BD) + """SELECT board_id,
  CAST(count(*) FILTER (pc IN (1, 2) AND r <> 0) AS BIGINT) AS white_minor_pieces_developed,
  CAST(count(*) FILTER (pc IN (7, 8) AND r <> 7) AS BIGINT) AS black_minor_pieces_developed FROM p GROUP BY 1""")
def developed_minors(spark, sf):
    return _proj(spark, sf, B.developed_minor_columns())


# ---------------------------------------------------------------- attacks

@register("square_attacks", "J14", O.with_(O.BD, O.ATTACKS) + "SELECT board_id, color, pc, from_sq, to_sq FROM att")
def square_attacks(spark, sf):
    return A.attack_pairs(I.boards(spark, sf), K)


@register("attacked_area", "J14 B23", O.with_(O.BD, O.ATTACKS) + "SELECT board_id, "
          + _both("CAST(count(DISTINCT to_sq) FILTER (color = {c}) AS BIGINT) AS {s}_area") + " FROM ids LEFT JOIN att USING (board_id) GROUP BY 1")
def attacked_area(spark, sf):
    b = A.with_attacked_sets(I.boards(spark, sf))
    return b.select(K, *[S.size(F.col(f"{s}_attacks")).alias(f"{s}_area") for s, _ in B.SIDES])


@register("center_control", "B9", O.with_(O.BD, O.ATTACKS) + "SELECT board_id, "
          + _both("CAST(count(*) FILTER (color = {c} AND to_sq IN (27, 28, 35, 36)) AS BIGINT) AS {s}_center_control")
          + """, CAST(count(*) FILTER (color = 0 AND to_sq IN (27, 28, 35, 36)) - count(*) FILTER (color = 1 AND to_sq IN (27, 28, 35, 36)) AS BIGINT)
    AS center_control_balance FROM ids LEFT JOIN att USING (board_id) GROUP BY 1""")
def center_control(spark, sf):
    return A.centre_control(I.boards(spark, sf), K)


_ZONE = """zone AS (SELECT k.board_id, k.color, s.sq FROM kings k JOIN sqs s ON greatest(abs(s.f - k.f), abs(s.r - k.r)) <= 1),
za AS (SELECT z.board_id, z.color, a.color AS ac, z.sq FROM zone z JOIN att a ON a.board_id = z.board_id AND a.to_sq = z.sq)"""


@register("king_zone_attackers", "B11", O.with_(O.BD, O.ATTACKS, _ZONE) + "SELECT board_id, "
          + _both("CAST(count(*) FILTER (color = {c} AND ac = {o}) AS BIGINT) AS {s}_king_attackers") + " FROM ids LEFT JOIN za USING (board_id) GROUP BY 1")
def king_zone_attackers(spark, sf):
    return A.king_zone_attackers(I.boards(spark, sf), K)


@register("king_safety", "B14", O.with_(O.BD, O.ATTACKS, _ZONE, _SHIELD, _OPEN, _KING_PAIR) + """, u AS (
   SELECT board_id, color, -3 AS v FROM za WHERE ac <> color UNION ALL SELECT board_id, color, 2 FROM sh UNION ALL SELECT board_id, color, -2 FROM op
   UNION ALL SELECT board_id, color, 4 FROM kings WHERE f >= 6 OR f <= 2)
  SELECT board_id, """ + _both("CAST(coalesce(sum(v) FILTER (color = {c}), 0) AS BIGINT) AS {s}_king_safety")
  + " FROM ids LEFT JOIN u USING (board_id) GROUP BY 1")
def king_safety(spark, sf):
    return A.king_safety(I.boards(spark, sf), K)


@register("king_checks", "B22", O.with_(O.BD, O.ATTACKS) + """, ck AS (SELECT k.board_id, k.color FROM kings k JOIN att a
     ON a.board_id = k.board_id AND a.to_sq = k.sq AND a.color <> k.color)
  SELECT board_id, """ + _both("CAST(count(*) FILTER (color = {c}) AS BIGINT) AS {s}_king_attackers")
  + ", CAST(count(*) FILTER (color = board_id % 2) > 0 AS INT) AS is_check FROM ids LEFT JOIN ck USING (board_id) GROUP BY 1")
def king_checks(spark, sf):
    return A.king_checks(I.boards(spark, sf), K)


@register("attack_totals", "B23", O.with_(O.BD, O.ATTACKS) + """, t AS (SELECT board_id, sq FROM bd UNION SELECT board_id, s.sq FROM ids, sqs s WHERE s.sq IN (27, 28, 35, 36)),
  h AS (SELECT t.board_id, a.color FROM t JOIN att a ON a.board_id = t.board_id AND a.to_sq = t.sq)
  SELECT board_id, """ + _both("CAST(count(*) FILTER (color = {c}) AS BIGINT) AS {s}_attackers") + " FROM ids LEFT JOIN h USING (board_id) GROUP BY 1")
def attack_totals(spark, sf):
    return A.attack_totals(I.boards(spark, sf), K)


_MOB = ", ".join(f"CAST(coalesce(sum(n) FILTER (pc = {i + 6 * c}), 0) AS BIGINT) AS {s}_{k}_mobility"
                 for c, s in enumerate(("white", "black")) for i, k in enumerate(B.KINDS))
_MOB += ", " + _both("CAST(coalesce(sum(n) FILTER (color = {c}), 0) AS BIGINT) AS {s}_mobility")
_MOB_CTE = f"mob AS (SELECT board_id, {_MOB} FROM ids LEFT JOIN lone USING (board_id) GROUP BY 1)"


@register("lone_piece_mobility", "B16", O.with_(O.BD, O.LONE, _MOB_CTE) + "SELECT * FROM mob")
def lone_piece_mobility(spark, sf):
    return A.lone_mobility(I.boards(spark, sf), K)


@register("mobility_ratios", "B17 X21", O.with_(O.BD, O.LONE, _MOB_CTE) + """SELECT board_id, white_mobility - black_mobility AS mobility_balance,
  """ + _both("(CAST({s}_knight_mobility AS DOUBLE) + {s}_bishop_mobility) / greatest(1, {s}_mobility - {s}_pawn_mobility - {s}_king_mobility) AS {s}_minor_piece_mobility_ratio")
  + ", " + ", ".join(f"white_{k}_mobility - black_{k}_mobility AS {k}_mobility_advantage" for k in B.KINDS) + " FROM mob")
def mobility_ratios(spark, sf):
    return E.project(A.lone_mobility(I.boards(spark, sf), K), K, A.mobility_ratio_columns())


_PIN_COLS = _both(", ".join("CAST(count(*) FILTER (kc = {c} AND c1 = {c} AND c2 = {o} AND fits AND k1 = " + str(i) + ") AS BIGINT) AS {s}_pinned_" + k + "s"
                            for i, k in enumerate(B.KINDS[:5]))
                  + ", CAST(count(*) FILTER (kc = {c} AND c1 = {c} AND c2 = {o} AND fits) AS BIGINT) AS {s}_total_pinned_pieces")
_DISCOVERED = _both("CAST(count(*) FILTER (kc = {o} AND c1 = {c} AND c2 = {c} AND fits) AS BIGINT) AS {s}_discovered_attacks")


@register("pinned_pieces", "B18 J15", O.with_(O.BD, O.KING_RAYS) + f"SELECT board_id, {_PIN_COLS} FROM ids LEFT JOIN duo USING (board_id) GROUP BY 1")
def pinned_pieces(spark, sf):
    return A.pins(I.boards(spark, sf), K)


@register("king_ray_pieces", "J15", O.with_(O.BD, O.KING_RAYS) + """SELECT a.board_id, a.kc AS king_color, a.sq AS first_sq, b.sq AS second_sq
  FROM kray a LEFT JOIN kray b ON b.board_id = a.board_id AND b.kc = a.kc AND b.d = a.d AND b.rn = 2 WHERE a.rn = 1""")
def king_ray_pieces(spark, sf):
    rows = A.king_rays(I.boards(spark, sf), K)
    return rows.filter(S.has(F.col("first"))).select(
        K, F.when(F.col("side") == "white", 0).otherwise(1).alias("king_color"),
        S.lowest(F.col("first")).alias("first_sq"), S.lowest(F.col("second")).alias("second_sq"))


_FORK_CTE = """fk AS (SELECT l.board_id, l.color, l.kind, l.from_sq FROM lone l JOIN p e ON e.board_id = l.board_id AND e.sq = l.to_sq
  AND e.color <> l.color AND e.kind <> 0 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2)"""
_FORK_COLS = _both(", ".join("CAST(count(*) FILTER (color = {c} AND kind = " + str(i) + ") AS BIGINT) AS {s}_" + k + "_forks" for i, k in enumerate(B.KINDS[:5]))
                   + ", CAST(count(*) FILTER (color = {c}) AS BIGINT) AS {s}_total_forks")


@register("forks", "B19", O.with_(O.BD, O.LONE, _FORK_CTE) + f"SELECT board_id, {_FORK_COLS} FROM ids LEFT JOIN fk USING (board_id) GROUP BY 1")
def forks(spark, sf):
    return A.forks(I.boards(spark, sf), K)


@register("discovered_attacks", "B20", O.with_(O.BD, O.KING_RAYS) + f"SELECT board_id, {_DISCOVERED} FROM ids LEFT JOIN duo USING (board_id) GROUP BY 1")
def discovered_attacks(spark, sf):
    return A.discovered_attacks(I.boards(spark, sf), K)


@register("tactical_totals", "B21", O.with_(O.BD, O.KING_RAYS, O.LONE.replace(O.GEOMETRY + ",\n", ""), _FORK_CTE) + f""",
  a AS (SELECT board_id, {_PIN_COLS}, {_DISCOVERED} FROM ids LEFT JOIN duo USING (board_id) GROUP BY 1),
  b AS (SELECT board_id, {_FORK_COLS} FROM ids LEFT JOIN fk USING (board_id) GROUP BY 1),
  d AS (SELECT board_id, white_total_pinned_pieces - black_total_pinned_pieces AS tactical_advantage_pins,
    white_total_forks - black_total_forks AS tactical_advantage_forks,
    white_discovered_attacks - black_discovered_attacks AS tactical_advantage_discovered FROM a JOIN b USING (board_id))
  SELECT *, tactical_advantage_pins + 2 * tactical_advantage_forks + 3 * tactical_advantage_discovered AS overall_tactical_advantage FROM d""")
def tactical_totals(spark, sf):
    out = A.tactical_totals(I.boards(spark, sf), K)
    return out.select(K, *[c for c in out.columns if "tactical_advantage" in c])


_MOVES_CTE = """lo AS (SELECT a.board_id, a.pc, a.to_sq, t.r AS tr, e.color AS ec FROM att a JOIN sqs t ON t.sq = a.to_sq
  LEFT JOIN p e ON e.board_id = a.board_id AND e.sq = a.to_sq WHERE a.color = a.board_id % 2),
hits AS (SELECT board_id, sum(CASE WHEN pc % 6 = 0 THEN CASE WHEN ec = 1 - board_id % 2 THEN CASE WHEN tr IN (0, 7) THEN 4 ELSE 1 END ELSE 0 END
  WHEN ec = board_id % 2 THEN 0 ELSE 1 END) AS n FROM lo GROUP BY 1),
pawn AS (SELECT p.*, CASE WHEN color = 0 THEN 1 ELSE -1 END AS step FROM p WHERE kind = 0 AND color = board_id % 2),
push1 AS (SELECT q.board_id, CASE WHEN q.r + q.step IN (0, 7) THEN 4 ELSE 1 END AS n FROM pawn q WHERE q.r + q.step BETWEEN 0 AND 7
  AND NOT EXISTS (SELECT 1 FROM bd WHERE bd.board_id = q.board_id AND bd.sq = q.sq + 8 * q.step)),
push2 AS (SELECT q.board_id, 1 AS n FROM pawn q WHERE (CASE WHEN color = 0 THEN q.r <= 1 ELSE q.r >= 6 END)
  AND NOT EXISTS (SELECT 1 FROM bd WHERE bd.board_id = q.board_id AND bd.sq IN (q.sq + 8 * q.step, q.sq + 16 * q.step))),
allm AS (SELECT * FROM hits UNION ALL SELECT * FROM push1 UNION ALL SELECT * FROM push2),
mc AS (SELECT board_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS move_count FROM ids LEFT JOIN allm USING (board_id) GROUP BY 1)"""


@register("move_counts", "B36", O.with_(O.BD, O.ATTACKS, _MOVES_CTE) + "SELECT * FROM mc")
def move_counts(spark, sf):
    return A.move_counts(I.boards(spark, sf), K)


@register("zugzwang_score", "B33", O.with_(_SMALL, O.ATTACKS, _MOVES_CTE, _KINDS_CTE, _KING_PAIR) + """SELECT board_id,
  CASE WHEN NOT eg OR wsq IS NULL OR bsq IS NULL THEN 0
   WHEN greatest(abs(wf-bf), abs(wr-br)) <= 2 AND move_count <= 5 THEN 3 WHEN greatest(abs(wf-bf), abs(wr-br)) <= 3 AND move_count <= 8 THEN 2
   WHEN greatest(abs(wf-bf), abs(wr-br)) <= 4 AND move_count <= 10 THEN 1 ELSE 0 END AS zugzwang_potential
  FROM e JOIN kp USING (board_id) JOIN mc USING (board_id)""")
def zugzwang_score(spark, sf):
    b = I.boards(spark, sf, 1)
    return B.with_kings(b).join(A.move_counts(b, K), K).select(K, E.zugzwang_column(F.col("move_count")).alias("zugzwang_potential"))


@register("king_set", "B38", O.with_(O.BD, O.ATTACKS, _ZONE) + """, ring AS (SELECT z.* FROM zone z JOIN kings k USING (board_id, color) WHERE z.sq <> k.sq),
  ra AS (SELECT z.board_id, z.color, a.color AS ac FROM ring z JOIN att a ON a.board_id = z.board_id AND a.to_sq = z.sq),
  km AS (SELECT z.board_id, z.color FROM ring z LEFT JOIN p ON p.board_id = z.board_id AND p.sq = z.sq AND p.color = z.color WHERE p.sq IS NULL),
  ck AS (SELECT DISTINCT k.board_id, k.color FROM kings k JOIN att a ON a.board_id = k.board_id AND a.to_sq = k.sq AND a.color <> k.color),
  kc AS (SELECT board_id, color, 3 - least(greatest(abs(f-3),abs(r-3)), greatest(abs(f-4),abs(r-3)), greatest(abs(f-3),abs(r-4)), greatest(abs(f-4),abs(r-4))) AS v FROM kings),
  u AS (SELECT board_id, color, 1 AS t, 1 AS v FROM km UNION ALL SELECT board_id, color, CASE WHEN ac = color THEN 3 ELSE 2 END, 1 FROM ra
    UNION ALL SELECT board_id, color, 4, v FROM kc UNION ALL SELECT board_id, color, 5, 1 FROM ck)
  SELECT board_id, """ + _both("""CAST(coalesce(sum(v) FILTER (color = {c} AND t = 1), 0) AS BIGINT) AS {s}_king_mobility,
   CAST(coalesce(sum(v) FILTER (color = {c} AND t = 2), 0) AS BIGINT) AS {s}_ring_attackers,
   CAST(coalesce(sum(v) FILTER (color = {c} AND t = 3), 0) AS BIGINT) AS {s}_ring_defenders,
   CAST(coalesce(sum(v) FILTER (color = {c} AND t = 4), 0) AS BIGINT) AS {s}_king_centrality,
   CAST(coalesce(sum(v) FILTER (color = {c} AND t = 5), 0) AS BIGINT) AS {s}_checked""") + " FROM ids LEFT JOIN u USING (board_id) GROUP BY 1")
def king_set(spark, sf):
    return A.king_set(I.boards(spark, sf), K)


@register("board_set", "B39", O.with_(O.BD, O.ATTACKS) + """, x AS (SELECT a.board_id, a.color, a.pc % 6 AS kind, a.to_sq, e.color AS ec FROM att a
    LEFT JOIN p e ON e.board_id = a.board_id AND e.sq = a.to_sq),
  mob AS (SELECT board_id, color, kind, count(*) AS n FROM x WHERE ec IS DISTINCT FROM color GROUP BY 1, 2, 3),
  con AS (SELECT board_id, color, count(DISTINCT to_sq) AS n FROM x WHERE ec = color GROUP BY 1, 2),
  bp AS (SELECT board_id, color FROM p WHERE kind = 2 GROUP BY 1, 2 HAVING count(*) >= 2),
  u AS (SELECT board_id, color, kind AS t, n FROM mob UNION ALL SELECT board_id, color, 10, n FROM con UNION ALL SELECT board_id, color, 11, 1 FROM bp)
  SELECT board_id, """ + _both("""CAST(coalesce(sum(n) FILTER (color = {c} AND t = 11), 0) AS BIGINT) AS {s}_bishop_pair,
   CAST(coalesce(sum(n) FILTER (color = {c} AND t = 4), 0) AS BIGINT) AS {s}_queens_mobility,
   CAST(coalesce(sum(n) FILTER (color = {c} AND t = 3), 0) AS BIGINT) AS {s}_rooks_mobility,
   CAST(coalesce(sum(n) FILTER (color = {c} AND t = 1), 0) AS BIGINT) AS {s}_knights_mobility,
   CAST(coalesce(sum(n) FILTER (color = {c} AND t = 2), 0) AS BIGINT) AS {s}_bishops_mobility,
   CAST(coalesce(sum(n) FILTER (color = {c} AND t = 10), 0) AS BIGINT) AS {s}_connectivity""") + " FROM ids LEFT JOIN u USING (board_id) GROUP BY 1")
def board_set(spark, sf):
    return A.board_set(I.boards(spark, sf), K)


# ---------------------------------------------------------------- flagship

@register("material_bucket_error", "S1 B3 B4 B24 P15 A11", O.with_(O.BD, MATERIAL_CTE) + """,
  price AS (SELECT l_orderkey // 8 AS board_id, avg(l_extendedprice) AS target FROM lineitem GROUP BY 1),
  x AS (SELECT m.*, target, CASE WHEN total_material < 30 THEN 'endgame' WHEN total_material > 62 THEN 'opening' ELSE 'middlegame' END AS phase,
    CASE WHEN total_material < 40 THEN '0-40' WHEN total_material < 55 THEN '40-55' WHEN total_material < 70 THEN '55-70' WHEN total_material < 85 THEN '70-85'
     ELSE '85-inf' END AS bucket FROM mat m JOIN price USING (board_id)),
  y AS (SELECT *, avg(target) OVER (PARTITION BY phase) AS forecast FROM x)
  SELECT bucket, count(*) AS n, round(sqrt(avg((target - forecast) ** 2)), 6) AS rmse FROM y GROUP BY 1""")
def material_bucket_error(spark, sf):
    """Forecast the mean line price of a board by its phase; error per material bucket."""
    li = table(spark, sf, "lineitem")
    boards = I.boards(spark, sf).select(K, *[c.alias(n) for n, c in {**B.material_columns(), **E.phase_columns()}.items()])
    price = li.groupBy(F.expr("l_orderkey div 8").alias(K)).agg(F.avg("l_extendedprice").alias("target"))
    rows = boards.join(price, K).withColumn(
        "phase", F.when(F.col("is_endgame") == 1, "endgame").when(F.col("is_opening") == 1, "opening").otherwise("middlegame"))
    forecast = rows.groupBy("phase").agg(F.avg("target").alias("forecast"))
    rows = rows.join(F.broadcast(forecast), "phase")  # three rows, one per phase
    bucket = V.bucket_label(F.col("total_material"), [0, 40, 55, 70, 85])
    return V.error_by_bucket(rows.withColumn("bucket", bucket), "bucket", "target", "forecast")
