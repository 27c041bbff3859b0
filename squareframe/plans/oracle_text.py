"""The derived inputs and shared steps as DuckDB SQL, written independently of the Spark plans."""

from __future__ import annotations

from .inputs import CONTINUATIONS, OPENINGS, TAG_DETAILS, TAG_FAMILIES, UCI_OPENINGS, UCI_PLIES, UCI_TAILS


def bd(per: int = 8) -> str:
    return f"""bd AS (SELECT l_orderkey // {per} AS board_id, CAST((l_partkey*7 + l_suppkey*3 + l_linenumber) % 64 AS INT) AS sq,
  CAST(min((l_partkey + l_suppkey) % 12) AS INT) AS pc FROM lineitem GROUP BY 1, 2),
ids AS (SELECT DISTINCT board_id FROM bd),
p AS (SELECT board_id, sq, pc, sq % 8 AS f, sq // 8 AS r, pc // 6 AS color, pc % 6 AS kind FROM bd),
kings AS (SELECT board_id, color, min(sq) AS sq, min(sq) % 8 AS f, min(sq) // 8 AS r FROM p WHERE kind = 5 GROUP BY 1, 2)"""


BD = bd()

GEOMETRY = """sqs AS (SELECT CAST(range AS INT) AS sq, CAST(range % 8 AS INT) AS f, CAST(range // 8 AS INT) AS r FROM range(64)),
dirs(d, df, dr) AS (VALUES (0,0,1),(1,1,0),(2,0,-1),(3,-1,0),(4,1,1),(5,1,-1),(6,-1,1),(7,-1,-1)),
rays AS (SELECT s.sq AS from_sq, d, CAST(k AS INT) AS dist, CAST((s.r + dr*k)*8 + s.f + df*k AS INT) AS to_sq
  FROM sqs s, dirs, range(1, 8) t(k) WHERE s.f + df*k BETWEEN 0 AND 7 AND s.r + dr*k BETWEEN 0 AND 7),
steps AS (SELECT 1 AS kind, a.sq AS from_sq, b.sq AS to_sq FROM sqs a, sqs b WHERE abs(a.f-b.f)*abs(a.r-b.r) = 2
  UNION ALL SELECT 5, a.sq, b.sq FROM sqs a, sqs b WHERE greatest(abs(a.f-b.f), abs(a.r-b.r)) = 1)"""

ATTACKS = GEOMETRY + """,
slide AS (SELECT p.board_id, p.pc, p.sq AS from_sq, y.d, y.dist, y.to_sq, b.sq IS NOT NULL AS occ
  FROM p JOIN rays y ON y.from_sq = p.sq AND (p.kind = 4 OR (p.kind = 3 AND y.d < 4) OR (p.kind = 2 AND y.d >= 4))
  LEFT JOIN bd b ON b.board_id = p.board_id AND b.sq = y.to_sq),
seen AS (SELECT *, min(CASE WHEN occ THEN dist END) OVER (PARTITION BY board_id, from_sq, d) AS hit FROM slide),
att AS (SELECT board_id, pc // 6 AS color, pc, from_sq, to_sq FROM seen WHERE hit IS NULL OR dist <= hit
  UNION ALL SELECT p.board_id, p.color, p.pc, p.sq, s.to_sq FROM p JOIN steps s ON s.kind = p.kind AND s.from_sq = p.sq
  UNION ALL SELECT p.board_id, p.color, p.pc, p.sq, t.sq FROM p JOIN sqs t
    ON abs(t.f - p.f) = 1 AND t.r = p.r + CASE WHEN p.color = 0 THEN 1 ELSE -1 END WHERE p.kind = 0)"""

LONE = GEOMETRY + """,
lone AS (SELECT p.board_id, p.pc, p.color, p.kind, p.sq AS from_sq, y.to_sq, 1 AS n FROM p JOIN rays y
    ON y.from_sq = p.sq AND (p.kind = 4 OR (p.kind = 3 AND y.d < 4) OR (p.kind = 2 AND y.d >= 4))
  UNION ALL SELECT p.board_id, p.pc, p.color, p.kind, p.sq, s.to_sq, 1 FROM p JOIN steps s ON s.kind = p.kind AND s.from_sq = p.sq
  UNION ALL SELECT p.board_id, p.pc, p.color, 0, p.sq, t.sq, CASE WHEN t.r IN (0, 7) THEN 4 ELSE 1 END FROM p JOIN sqs t
    ON t.f = p.f AND ((p.color = 0 AND t.r - p.r BETWEEN 1 AND CASE WHEN p.r <= 1 THEN 2 ELSE 1 END)
                   OR (p.color = 1 AND p.r - t.r BETWEEN 1 AND CASE WHEN p.r >= 6 THEN 2 ELSE 1 END)) WHERE p.kind = 0)"""

KING_RAYS = GEOMETRY + """,
kray AS (SELECT k.board_id, k.color AS kc, y.d, y.dist, b.sq, b.pc, b.color, b.kind,
    row_number() OVER (PARTITION BY k.board_id, k.color, y.d ORDER BY y.dist) AS rn
  FROM kings k JOIN rays y ON y.from_sq = k.sq JOIN p b ON b.board_id = k.board_id AND b.sq = y.to_sq),
duo AS (SELECT a.board_id, a.kc, a.d, a.color AS c1, a.kind AS k1, b.color AS c2, b.kind AS k2,
    (b.kind = 4 OR (b.kind = 3 AND a.d < 4) OR (b.kind = 2 AND a.d >= 4)) AS fits
  FROM kray a JOIN kray b USING (board_id, kc, d) WHERE a.rn = 1 AND b.rn = 2)"""

CELLS = """cells AS (SELECT i.board_id, string_agg(coalesce(substr('PNBRQKpnbrqk', bd.pc + 1, 1), '.'), '' ORDER BY s.sq) AS cells
  FROM ids i CROSS JOIN (SELECT CAST(range AS INT) AS sq FROM range(64)) s LEFT JOIN bd ON bd.board_id = i.board_id AND bd.sq = s.sq GROUP BY 1)"""


def placement(cells: str = "cells") -> str:
    text = " || '/' || ".join(f"substr({cells}, {57 - 8 * r}, 8)" for r in range(8))
    for n in range(8, 0, -1):
        text = f"replace({text}, '{'.' * n}', '{n}')"
    return text


FENS = BD + ",\n" + CELLS + f""",
fens AS (SELECT board_id, {placement()} || ' ' || CASE WHEN board_id % 2 = 0 THEN 'w' ELSE 'b' END || ' ' ||
  CASE WHEN board_id % 16 = 0 THEN '-' ELSE CASE WHEN board_id % 2 = 1 THEN 'K' ELSE '' END ||
    CASE WHEN board_id // 2 % 2 = 1 THEN 'Q' ELSE '' END || CASE WHEN board_id // 4 % 2 = 1 THEN 'k' ELSE '' END ||
    CASE WHEN board_id // 8 % 2 = 1 THEN 'q' ELSE '' END END
  || ' - ' || (board_id % 50) || ' ' || (board_id % 80 + 1) AS fen FROM cells)"""


def _uci() -> str:
    name = lambda s: f"substr('abcdefgh', CAST({s} % 8 AS INT) + 1, 1) || CAST({s} // 8 + 1 AS VARCHAR)"
    parts = []
    for i in range(UCI_PLIES):
        own = f"CASE WHEN (board_id + {i}) % 2 = 0 THEN ws ELSE bs END"
        src = f"coalesce(({own})[({i * 3} + board_id) % greatest(coalesce(len({own}), 0), 1) + 1], 0)"
        parts.append(f"SELECT board_id, {i + 1} AS ply, CAST({src} AS BIGINT) AS src, "
                     f"CASE WHEN (board_id + {i}) % 13 = 0 THEN 'q' ELSE '' END AS promo, {i * 11 + 7} AS off FROM own")
    union = " UNION ALL ".join(parts)
    return f"""own AS (SELECT i.board_id, list(p.sq ORDER BY p.sq) FILTER (color = 0) AS ws, list(p.sq ORDER BY p.sq) FILTER (color = 1) AS bs
  FROM ids i JOIN p USING (board_id) GROUP BY 1),
u0 AS ({union}),
u1 AS (SELECT board_id, ply, src, promo, (src*5 + board_id*3 + off) % 64 AS dst FROM u0),
uci AS (SELECT board_id, ply, src, dst, promo, {name('src')} || {name('dst')} || promo AS move FROM u1),
games AS (SELECT board_id, string_agg(move, ' ' ORDER BY ply) AS moves FROM uci GROUP BY 1)"""


UCI = _uci()


def values(items: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in items) + "]"


LINES = f"""lines AS (SELECT o_orderkey, trim({values(OPENINGS)}[o_orderkey % {len(OPENINGS)} + 1] || ' ' ||
  {values(CONTINUATIONS)}[o_custkey % {len(CONTINUATIONS)} + 1]) AS moves FROM orders)"""

TAGS = f"""t0 AS (SELECT o_orderkey, o_custkey, {values(TAG_FAMILIES)}[o_orderkey % {len(TAG_FAMILIES)} + 1] AS fam,
  {values(TAG_DETAILS)}[o_custkey % {len(TAG_DETAILS)} + 1] AS det FROM orders),
t1 AS (SELECT *, CASE WHEN det = '' THEN fam ELSE fam || '_' || det END AS full_tag FROM t0),
tags AS (SELECT o_orderkey, CASE WHEN (o_orderkey + o_custkey) % 5 = 0 THEN '' WHEN o_custkey % 3 = 0 THEN fam || ' ' || full_tag
  ELSE full_tag END AS tags FROM t1)"""

THEMES = "themes AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS themes FROM part)"

LABELS = """pl AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"""

CURVE = "curve AS (SELECT vec_id, label, [CAST(embedding[i] AS DOUBLE) FOR i IN range(1, 23)] AS c FROM embeddings)"

RATED = """r0 AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice / 150.0 AS rating FROM orders),
rated AS (SELECT *, avg(rating) OVER (PARTITION BY o_orderpriority) AS prediction FROM r0)"""


START_CELLS = "RNBQKBNRPPPPPPPP" + "." * 32 + "pppppppprnbqkbnr"

UCI_LINES = f"""g AS (SELECT o_orderkey AS id, '{START_CELLS}' AS c0, true AS w0, string_split(trim({values(UCI_OPENINGS)}[o_orderkey % {len(UCI_OPENINGS)} + 1] || ' ' ||
  {values(UCI_TAILS)}[o_custkey % {len(UCI_TAILS)} + 1]), ' ') AS mv FROM orders)"""

UCI_GAMES = "g AS (SELECT board_id AS id, cells AS c0, board_id % 2 = 0 AS w0, string_split(moves, ' ') AS mv FROM cells JOIN games USING (board_id))"


def _put(cells: str, sq: str, letter: str) -> str:
    return f"(substr({cells}, 1, {sq}) || {letter} || substr({cells}, {sq} + 2))"


def _replay() -> str:
    moved = _put(_put("before", "src", "'.'"), "dst", "placed")
    castled = _put(_put(moved, "rf", "'.'"), "rt", "rook")
    return f"""rp AS (SELECT id, 0 AS ply, c0 AS before, c0 AS cells, '' AS move, w0 AS w, 0 AS src, 0 AS dst, '' AS piece, '' AS captured, '' AS promo, '' AS castling, true AS playable FROM g
  UNION ALL
  SELECT id, ply, before, CASE WHEN NOT playable THEN before WHEN ep THEN {_put(moved, "beside", "'.'")}
      WHEN cas AND substr(before, rf + 1, 1) = rook THEN {castled} ELSE {moved} END, move, w, src, dst, piece,
    CASE WHEN ep THEN CASE WHEN w THEN 'p' ELSE 'P' END WHEN target <> '.' THEN target ELSE '' END, promo,
    CASE WHEN cas THEN CASE WHEN dst > src THEN 'K' ELSE 'Q' END ELSE '' END, playable
  FROM (SELECT *, CASE WHEN promo = '' THEN piece WHEN w THEN upper(promo) ELSE promo END AS placed,
      upper(piece) = 'P' AND target = '.' AND abs(dst % 8 - src % 8) = 1 AND substr(before, beside + 1, 1) = CASE WHEN w THEN 'p' ELSE 'P' END AS ep,
      upper(piece) = 'K' AND abs(dst - src) = 2 AND src % 8 = 4 AS cas, CASE WHEN dst > src THEN src + 3 ELSE greatest(src - 4, 0) END AS rf,
      CASE WHEN dst > src THEN src + 1 ELSE greatest(src - 1, 0) END AS rt, CASE WHEN w THEN 'R' ELSE 'r' END AS rook
   FROM (SELECT *, substr(before, src + 1, 1) AS piece, substr(before, dst + 1, 1) AS target, src - src % 8 + dst % 8 AS beside,
      wf AND CASE WHEN w THEN instr('PNBRQK', substr(before, src + 1, 1)) > 0 AND instr('PNBRQK', substr(before, dst + 1, 1)) = 0
        ELSE instr('pnbrqk', substr(before, src + 1, 1)) > 0 AND instr('pnbrqk', substr(before, dst + 1, 1)) = 0 END AS playable
    FROM (SELECT id, ply, before, move, w, wf, lower(substr(move, 5, 1)) AS promo,
       CASE WHEN wf THEN ascii(substr(move, 1, 1)) - 97 + 8 * (ascii(substr(move, 2, 1)) - 49) ELSE 0 END AS src,
       CASE WHEN wf THEN ascii(substr(move, 3, 1)) - 97 + 8 * (ascii(substr(move, 4, 1)) - 49) ELSE 0 END AS dst
     FROM (SELECT r.id, r.ply + 1 AS ply, r.cells AS before, g.mv[r.ply + 1] AS move, (g.w0 = (r.ply % 2 = 0)) AS w,
         regexp_matches(g.mv[r.ply + 1], '^[a-h][1-8][a-h][1-8][nbrqNBRQ]?$') AS wf
       FROM rp r JOIN g ON g.id = r.id WHERE r.ply < len(g.mv))))))
,
ply AS (SELECT * FROM rp WHERE ply > 0)"""


REPLAY = _replay()

# pieces and attacks of every ply board, under the names the attack steps use
PLY_BOARDS = """pid AS (SELECT id, ply, id * 100 + ply AS board_id, cells, before, w, playable FROM ply),
bd AS (SELECT board_id, sq, CAST(instr('PNBRQKpnbrqk', substr(cells, sq + 1, 1)) - 1 AS INT) AS pc FROM pid, (SELECT CAST(range AS INT) AS sq FROM range(64))
  WHERE substr(cells, sq + 1, 1) <> '.'),
p AS (SELECT board_id, sq, pc, sq % 8 AS f, sq // 8 AS r, pc // 6 AS color, pc % 6 AS kind FROM bd),
kings AS (SELECT board_id, color, min(sq) AS sq FROM p WHERE kind = 5 GROUP BY 1, 2)"""

PLY_FACTS = """hit AS (SELECT a.board_id, a.color, max(CASE WHEN k.color IS NOT NULL THEN 1 ELSE 0 END) AS chk, max(CASE WHEN e.color IS NOT NULL THEN 1 ELSE 0 END) AS thr
  FROM att a LEFT JOIN kings k ON k.board_id = a.board_id AND k.sq = a.to_sq AND k.color <> a.color
  LEFT JOIN p e ON e.board_id = a.board_id AND e.sq = a.to_sq AND e.color <> a.color GROUP BY 1, 2),
mat AS (SELECT board_id, sum((1 - 2*color) * CASE kind WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 5 WHEN 4 THEN 9 ELSE 0 END) AS bal FROM p GROUP BY 1),
facts AS (SELECT y.id, y.ply, y.w, y.playable, y.captured, y.promo, y.piece, coalesce(CASE WHEN y.playable THEN a.chk END, 0) AS chk,
  coalesce(CASE WHEN y.playable THEN b.thr END, 0) AS thr, coalesce(mat.bal, 0) AS bal
  FROM ply y LEFT JOIN hit a ON a.board_id = y.id * 100 + y.ply AND a.color = CASE WHEN y.w THEN 0 ELSE 1 END
  LEFT JOIN hit b ON b.board_id = y.id * 100 + y.ply AND b.color = CASE WHEN y.w THEN 1 ELSE 0 END LEFT JOIN mat ON mat.board_id = y.id * 100 + y.ply)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
