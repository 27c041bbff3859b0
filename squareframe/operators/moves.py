"""Move lists as token arrays: counts, first moves, named sequences, ECO patterns, castling, pattern lookups.

All of these are row-local array expressions, or joins to small pattern tables built from the fixed lists.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import ECO_PATTERNS, FIRST_MOVES, LINE_FAMILIES, OPENING_SEQUENCES, REPLIES_D4, REPLIES_E4


def tokens(moves: Column) -> Column:
    """Blank-separated tokens; null or blank text gives an empty array."""
    return F.filter(F.split(F.trim(F.coalesce(moves, F.lit(""))), r"\s+"), lambda t: t != "")


def plain_castling(moves: Column) -> Column:
    """Castling tokens as king and queen targets, the notation the pattern lists expect."""
    text = F.coalesce(moves, F.lit(""))
    return F.replace(F.replace(text, F.lit("O-O-O"), F.lit("Qa1")), F.lit("O-O"), F.lit("Kg1"))


def _first_listed(token: Column, names: list[str]) -> Column:
    out = None
    for n in names:
        out = F.when(F.contains(token, F.lit(n)), n) if out is None else out.when(F.contains(token, F.lit(n)), n)
    return out


def first_move_columns(toks: Column) -> dict[str, Column]:
    """One flag per listed first move; the first listed one that occurs in the token wins."""
    hit = _first_listed(F.get(toks, F.lit(0)), FIRST_MOVES)
    return {f"first_move_{n}": F.coalesce((hit == n).cast("int"), F.lit(0)) for n in FIRST_MOVES}


def reply_columns(toks: Column) -> dict[str, Column]:
    first, reply = F.get(toks, F.lit(0)), F.get(toks, F.lit(1))
    e4 = F.coalesce(F.contains(first, F.lit("e4")), F.lit(False))
    d4 = ~e4 & F.coalesce(F.contains(first, F.lit("d4")), F.lit(False))
    out = {}
    for name, cond, listed in (("e4", e4, REPLIES_E4), ("d4", d4, REPLIES_D4)):
        hit = F.when(cond, _first_listed(reply, listed))
        out.update({f"response_to_{name}_{n}": F.coalesce((hit == n).cast("int"), F.lit(0)) for n in listed})
    return out


def starts_with_line(toks: Column, line: str, exact: bool = False) -> Column:
    """The first tokens hold the moves of ``line`` in order (as substrings unless ``exact``)."""
    parts = []
    for i, move in enumerate(line.split()):
        t = F.get(toks, F.lit(i))
        parts.append(F.coalesce(t == move if exact else F.contains(t, F.lit(move)), F.lit(False)))
    return reduce(lambda a, b: a & b, parts)


def sequence_columns(toks: Column, sequences: dict[str, str] | None = None, exact: bool = False) -> dict[str, Column]:
    return {f"opening_seq_{n}": starts_with_line(toks, line, exact).cast("int") for n, line in (sequences or OPENING_SEQUENCES).items()}


def eco_hits(toks: Column, longest: bool = True) -> dict[str, Column]:
    """Per ECO letter the winning pattern name or null: the longest match, or the first listed one."""
    out = {}
    for letter in sorted({p[0] for p in ECO_PATTERNS}):
        listed = [(name, line) for le, name, line in ECO_PATTERNS if le == letter]
        if longest:
            listed = sorted(listed, key=lambda p: -len(p[1].split()))
        hit = None
        for name, line in listed:
            cond = starts_with_line(toks, line)
            hit = F.when(cond, name) if hit is None else hit.when(cond, name)
        out[letter] = hit
    return out


def eco_columns(toks: Column, longest: bool = True) -> dict[str, Column]:
    hits, out = eco_hits(toks, longest), {}
    for letter, hit in hits.items():
        out[f"eco_{letter}"] = hit.isNotNull().cast("int")
        for le, name, _ in ECO_PATTERNS:
            if le == letter:
                out[f"eco_{letter}_{name}"] = F.coalesce((hit == name).cast("int"), F.lit(0))
    return out


def _of_parity(parity: int):
    return lambda _, i: i % 2 == parity


def castling_columns(toks: Column, plies: int = 20) -> dict[str, Column]:
    """Castling of each side within the first plies, read from the original tokens by parity of the ply."""
    head = F.slice(toks, 1, plies)
    out = {}
    for side, parity in (("white", 0), ("black", 1)):
        mine = F.filter(head, _of_parity(parity))
        long = F.exists(mine, lambda t: F.contains(t, F.lit("O-O-O")))
        short = F.exists(mine, lambda t: F.contains(t, F.lit("O-O")) & ~F.contains(t, F.lit("O-O-O")))
        out[f"{side}_kingside_castle"] = short.cast("int")
        out[f"{side}_queenside_castle"] = long.cast("int")
    return out


def early_castling_columns(toks: Column) -> dict[str, Column]:
    """Castled, and the line no longer than 12 plies (White) or 13 (Black)."""
    out = {}
    for name, flag in castling_columns(toks).items():
        limit = 12 if name.startswith("white") else 13
        out[f"early_{name}"] = F.when(F.size(toks) <= limit, flag).otherwise(0)
    return out


def notation_columns(toks: Column) -> dict[str, Column]:
    n = lambda ch: F.size(F.filter(toks, lambda t: F.contains(t, F.lit(ch))))
    return {
        "solution_num_half_moves": F.size(toks),
        "solution_num_captures": n("x"),
        "solution_num_checks": n("+"),
        "solution_is_checkmate": F.coalesce(F.contains(F.element_at(F.nullif(toks, F.array().cast("array<string>")), -1), F.lit("#")).cast("int"), F.lit(0)),
    }


def first_moves_text(toks: Column, k: int = 8) -> Column:
    return F.array_join(F.slice(toks, 1, k), " ")


# ---------------------------------------------------------------- pattern tables

def pattern_table(spark: SparkSession, rows=None) -> DataFrame:
    """(pattern, family, eco) lookup; twenty rows by default, so it is broadcast."""
    return spark.createDataFrame([tuple(r) for r in rows or LINE_FAMILIES], "pattern string, family string, eco string")


def with_prefixes(df: DataFrame, key: str, text: Column, longest: int) -> DataFrame:
    """(key, prefix, n): every token prefix up to ``longest`` tokens, for equi-joins instead of a theta join."""
    toks = tokens(text)
    rows = df.select(key, toks.alias("_t")).filter(F.size("_t") > 0).select(key, "_t", F.explode(
        F.sequence(F.lit(1), F.least(F.size("_t"), F.lit(longest)))).alias("n"))
    return rows.select(key, "n", F.array_join(F.slice("_t", F.lit(1), F.col("n")), " ").alias("prefix"))


def longest_pattern(df: DataFrame, key: str, moves: str, patterns: DataFrame | None = None, longest: int | None = None) -> DataFrame:
    """Longest pattern that the move list starts with, its family, letter and ``min(0.95, 0.5 + 0.1 * n)``.

    The list is turned into its few token prefixes, so the lookup is an equality join on the prefix. The longest
    pattern length comes from the pattern table, so no pattern is cut off.
    """
    patterns = patterns if patterns is not None else pattern_table(df.sparkSession)
    if longest is None:
        longest = patterns.agg(F.max(F.size(tokens(F.col("pattern"))))).first()[0] or 0
    hits = with_prefixes(df, key, F.col(moves), longest).join(patterns.withColumnRenamed("pattern", "prefix"), "prefix")
    best = hits.groupBy(key).agg(F.max_by(F.struct("family", "eco", "n"), "n").alias("b"))
    return best.select(
        key, F.col("b.family").alias("moves_inferred_family"), F.col("b.eco").alias("moves_matched_eco"),
        F.least(F.lit(0.95), 0.5 + 0.1 * F.col("b.n")).alias("moves_match_confidence"))


def eco_pattern_rows(df: DataFrame, key: str, moves: str, longest: bool = True) -> DataFrame:
    """(key, pattern_id, priority): the winning ECO patterns of each move list in long form."""
    toks = tokens(plain_castling(F.col(moves)))
    order = {f"eco_{le}_{n}": i for i, (le, n, _) in enumerate(ECO_PATTERNS)}
    hits = eco_hits(F.col("_t"), longest)
    ids = F.array(*[F.concat(F.lit(f"eco_{le}_"), hit) for le, hit in hits.items()])
    rows = df.select("*", toks.alias("_t")).select(key, F.explode(F.filter(ids, lambda x: x.isNotNull())).alias("pattern_id"))
    rank = None
    for name, i in order.items():
        rank = F.when(F.col("pattern_id") == name, i) if rank is None else rank.when(F.col("pattern_id") == name, i)
    return rows.withColumn("priority", rank)
