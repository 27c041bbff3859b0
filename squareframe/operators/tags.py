"""Theme and opening tags: tokens, families, variations, vocabularies, flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (ECO_NAME_TERMS, FIRST_PAIR_TERMS, PREFIX_WORDS, STRUCTURE_TERMS, STYLE_TERMS, THEME_FLAGS,
                            TYPE_WORDS)
from .moves import tokens

CAMEL = r"[A-Z][a-z0-9'\-]*|[A-Z]+(?![a-z])"

# ---------------------------------------------------------------- tokens and vocabularies


def theme_columns(text: Column) -> dict[str, Column]:
    toks = tokens(text)
    return {"theme_count": F.size(toks), "has_themes": (F.size(toks) > 0).cast("int")}


def token_rows(df: DataFrame, key: str | tuple[str, ...], text: Column, lower: bool = True) -> DataFrame:
    """(key or keys, token), one row per token occurrence: those of :func:`tokens`, but blanks go as rows, inside generated code, not by a lambda over each list."""
    t = F.explode_outer(F.split(F.lower(text) if lower else text, r"\s+")).alias("token")  # an outer one: no filter that splits again is inferred
    return df.select(*([key] if isinstance(key, str) else key), t).where("token != ''")


def vocabulary(rows: DataFrame, token: str = "token", least: int = 1, most: int | None = None, times: Column | None = None) -> DataFrame:
    """(token, n) by falling count, ties by token; a row counts ``times``. Counting pre-aggregates before the shuffle; the top-N is a bounded
    take-ordered, not a global sort."""
    counts = rows.groupBy(token).agg((F.count("*") if times is None else F.sum(times)).alias("n")).filter(F.col("n") >= least)
    return counts if most is None else counts.orderBy(F.desc("n"), F.asc(token)).limit(most)


def vocabulary_list(vocab: DataFrame, token: str = "token") -> list[str]:
    """Vocabulary as a driver-side list. Only for vocabularies bounded by a top-N."""
    return [r[0] for r in vocab.select(token).orderBy(token).collect()]


def one_hot(text: Column, words: list[str], prefix: str, lower: bool = True) -> dict[str, Column]:
    toks = tokens(F.lower(text) if lower else text)
    return {f"{prefix}_{w}": F.array_contains(toks, w).cast("int") for w in words}


def category_columns(text: Column) -> dict[str, Column]:
    """Ten category flags: mate by substring, the others by exact word."""
    toks = tokens(F.lower(text))
    out = {"is_mate": F.exists(toks, lambda t: F.contains(t, F.lit("mate"))).cast("int")}
    out.update({name: F.array_contains(toks, word).cast("int") for name, word in THEME_FLAGS.items()})
    return out


def bag_of_words(rows: DataFrame, key: str, vocab: DataFrame) -> DataFrame:
    """Binary incidence in long form, restricted to the vocabulary: the schema never depends on the data."""
    return rows.select(key, "token").distinct().join(vocab.select("token"), "token", "left_semi").select(key, "token")


# ---------------------------------------------------------------- opening tags

def tag_parts(tag: Column) -> Column:
    """Parts of a tag: split at ``_``, then at capitals; a part without capitals stays whole."""
    def words(part):
        found = F.regexp_extract_all(part, F.lit(CAMEL), F.lit(0))
        return F.when(F.size(found) > 0, found).when(part != "", F.array(part)).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.split(tag, "_"), words))


def merged_parts(parts: Column) -> Column:
    """Lower-case parts with prefix words joined to the word after them, read from the left.

    Joining is a text replacement over the parts set apart by blanks. A prefix word that was itself joined to an
    earlier prefix does not join again, because the pattern consumes both words.
    """
    text = F.array_join(parts, " ")
    joined = F.regexp_replace(text, rf"(?<![^ ])({'|'.join(PREFIX_WORDS)}) ([^ ]+)", "$1_$2")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.lower(joined), " "))


def standard_family(parts: Column) -> Column:
    """Family name of the parsed parts, with king and queen openings brought to one spelling."""
    first = F.get(parts, F.lit(0))
    second = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    rest = lambda n: F.substring(first, n + 1, F.length(first))
    return (
        F.when(F.size(parts) == 0, "unknown")
        .when(F.startswith(first, F.lit("kings")), F.concat(F.lit("kings"), rest(5)))
        .when(F.startswith(first, F.lit("king")), F.concat(F.lit("kings_"), rest(4)))
        .when(F.startswith(first, F.lit("queens")), F.concat(F.lit("queens"), rest(6)))
        .when(F.startswith(first, F.lit("queen")), F.concat(F.lit("queens_"), rest(5)))
        .when((first == "ruy") & (second == "lopez"), "ruy_lopez")
        .when((first == "nimzo") & F.contains(second, F.lit("indian")), "nimzo_indian")
        .otherwise(first))


def first_type_word(parts: Column) -> Column:
    """1-based position of the first type word, 0 without one."""
    at = [F.array_position(parts, w) for w in TYPE_WORDS]
    big = F.lit(1 << 30).cast("long")
    low = F.least(*[F.when(a > 0, a).otherwise(big) for a in at])
    return F.when(low < big, low).otherwise(F.lit(0)).cast("int")


def variation_columns(parts: Column) -> dict[str, Column]:
    """Level-2 and level-3 names: up to the first type word and one part more; without one the first two or three parts."""
    n, t = F.size(parts), first_type_word(parts)
    head = lambda k: F.array_join(F.slice(parts, F.lit(1), k), "_")
    two = F.when(n < 2, "").when(t > 1, head(t)).when(t == 1, "").otherwise(head(F.least(n, F.lit(3))))
    return {"variation": two, "sub_variation": F.when((n >= 2) & (t > 1) & (t < n), head(t + 1)).otherwise("")}


def parsed_tags(df: DataFrame, key: str, tag: str) -> DataFrame:
    """(key, n_tags, parts): number of tags and the merged parts of the first one."""
    toks = tokens(F.col(tag))
    first = F.coalesce(F.get(toks, F.lit(0)), F.lit(""))
    return df.select(key, F.size(toks).alias("n_tags"), merged_parts(tag_parts(first)).alias("parts"))


def listed_tags(df: DataFrame, key: str, tag: str, vocab: DataFrame) -> DataFrame:
    """(key, pos, tag): tags that the vocabulary table knows, in their order. Spark broadcasts a small vocabulary."""
    rows = df.select(key, F.posexplode(tokens(F.col(tag))).alias("pos", "tag"))
    return rows.join(vocab.select("tag"), "tag", "left_semi").select(key, "pos", "tag")


def name_counts(parsed: DataFrame, times: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(name, n) of families and of variations; a sub-variation counts as well. ``times``: how often a row stands."""
    p, times = F.col("parts"), F.lit(1) if times is None else times
    some = parsed.filter(F.size("parts") > 0)
    fam = some.groupBy(standard_family(p).alias("name")).agg(F.sum(times).alias("n"))
    v = variation_columns(p)
    names = F.filter(F.array(v["variation"], v["sub_variation"]), lambda x: x != "")
    var = some.select(F.explode(names).alias("name"), times.alias("_times")).groupBy("name").agg(F.sum("_times").alias("n"))
    return fam, var


def top_names(counts: DataFrame, known: DataFrame, most: int, least: int) -> DataFrame:
    """Names of the vocabulary first, then by count, ties by name."""
    flagged = counts.filter(F.col("n") >= least).join(known.select("name", F.lit(1).alias("listed")).distinct(), "name", "left")
    return flagged.withColumn("listed", F.coalesce("listed", F.lit(0))).orderBy(F.desc("listed"), F.desc("n"), F.asc("name")).limit(most)


def opening_columns(parts: Column, n_tags: Column) -> dict[str, Column]:
    flag = lambda w: F.array_contains(parts, w).cast("int")
    return {
        "opening_num_tags": n_tags, "has_opening_tags": (n_tags > 0).cast("int"), "opening_depth": F.size(parts),
        "opening_is_gambit": flag("gambit"), "opening_is_defense": flag("defense"), "opening_is_attack": flag("attack"),
        "opening_is_system": flag("system"), "opening_has_variation": flag("variation"),
    }


def name_one_hot(family: Column, variation: Column, parts: Column, families: list[str], variations: list[str],
                 keywords: list[str]) -> dict[str, Column]:
    out = {f"open_fam_{n}": (family == n).cast("int") for n in families}
    out.update({f"open_var_{n}": (variation == n).cast("int") for n in variations})
    out.update({f"open_kw_{n}": F.array_contains(parts, n).cast("int") for n in keywords})
    return out


def group_columns(family: Column, variation: Column) -> dict[str, Column]:
    """28 group flags: a term of the group occurs in the family or the variation name. ECO groups look at the family only."""
    def held(terms, *names):
        return reduce(lambda a, b: a | b, [F.contains(n, F.lit(t)) for n in names for t in terms]).cast("int")

    out = {f"eco_{g}": held(t, family) for g, t in ECO_NAME_TERMS.items()}
    for prefix, groups in (("style", STYLE_TERMS), ("move", FIRST_PAIR_TERMS), ("structure", STRUCTURE_TERMS)):
        out.update({f"{prefix}_{g}": held(t, family, variation) for g, t in groups.items()})
    return out
