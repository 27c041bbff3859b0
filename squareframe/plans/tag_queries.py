"""Registered tag, text and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import (ECO_NAME_TERMS, FIRST_PAIR_TERMS, PREFIX_WORDS, STRUCTURE_TERMS, STYLE_TERMS, THEME_FLAGS,
                            TYPE_WORDS)
from ..operators import labels as L
from ..operators import tables as D
from ..operators import tags as G
from ..operators import text as X
from ..operators.endgames import project
from ..operators.evaluate import rounded
from . import inputs as I
from . import oracle_text as O
from .registry import register, table

K = "o_orderkey"

# ---------------------------------------------------------------- themes

TH = O.THEMES + ", tt AS (SELECT p_partkey, list_filter(string_split(lower(themes), ' '), lambda x: x <> '') AS t FROM themes)"
_TOKENS = "tok AS (SELECT p_partkey, unnest(t) AS token FROM tt)"


def _themes(spark, sf):
    return I.themes(spark, sf)


@register("theme_tokens", "T1 X4 X9", O.with_(TH) + "SELECT p_partkey, CAST(len(t) AS INT) AS theme_count, CAST(len(t) > 0 AS INT) AS has_themes, CAST(length(trim(themes)) AS INT) AS n_chars FROM tt JOIN themes USING (p_partkey)")
def theme_tokens(spark, sf):
    return project(_themes(spark, sf), "p_partkey", {**G.theme_columns(F.col("themes")), "n_chars": F.length(F.trim("themes"))})


@register("top_tokens", "A1 W1", O.with_(TH, _TOKENS) + "SELECT token, CAST(count(*) AS BIGINT) AS n FROM tok GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, token LIMIT 20")
def top_tokens(spark, sf):
    return G.vocabulary(G.token_rows(_themes(spark, sf), "p_partkey", F.col("themes")), least=5, most=20)


_DOC_TOK = "dt AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(trim(lower(text)), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS token FROM documents)"


@register("frequent_tokens", "A2", O.with_(_DOC_TOK) + "SELECT token, CAST(count(*) AS BIGINT) AS n FROM dt GROUP BY 1 HAVING count(*) >= 10")
def frequent_tokens(spark, sf):
    return G.vocabulary(G.token_rows(table(spark, sf, "documents"), "doc_id", F.col("text")), least=10)


@register("rare_terms", "U5", O.with_(TH, _TOKENS) + "SELECT DISTINCT token FROM tok EXCEPT (SELECT token FROM tok GROUP BY 1 ORDER BY count(*) DESC, token LIMIT 20)")
def rare_terms(spark, sf):
    rows = G.token_rows(_themes(spark, sf), "p_partkey", F.col("themes"))
    return D.missing_members(rows.select("token").distinct(), G.vocabulary(rows, most=20), "token")


_WORDS = ["blue", "brass", "economy", "promo", "ring", "small", "standard", "widget"]


@register("theme_one_hot", "T2 X11", O.with_(TH) + "SELECT p_partkey, " + ", ".join(f"CAST(list_contains(t, '{w}') AS INT) AS theme_{w}" for w in _WORDS) + " FROM tt")
def theme_one_hot(spark, sf):
    return project(_themes(spark, sf), "p_partkey", G.one_hot(F.col("themes"), _WORDS, "theme"))


_TH2 = """, th2 AS (SELECT p_partkey, list_filter(string_split(lower(replace(replace(replace(themes, 'small', 'mateIn2'), 'red', 'discoveredAttack'), 'ring', 'endgame fork')), ' '), lambda x: x <> '') AS t FROM themes)"""


@register("theme_categories", "T3 X13", O.with_(O.THEMES) + _TH2.replace(", th2", ", th2", 1) + " SELECT p_partkey, CAST(len(list_filter(t, lambda x: contains(x, 'mate'))) > 0 AS INT) AS is_mate, "
          + ", ".join(f"CAST(list_contains(t, '{w}') AS INT) AS {n}" for n, w in THEME_FLAGS.items()) + " FROM th2")
def theme_categories(spark, sf):
    text = F.col("themes")
    for a, b in (("small", "mateIn2"), ("red", "discoveredAttack"), ("ring", "endgame fork")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return project(_themes(spark, sf), "p_partkey", G.category_columns(text))


@register("binary_bag_of_words", "T14 T15", O.with_(TH, _TOKENS) + ", v AS (SELECT token FROM tok GROUP BY 1 HAVING count(DISTINCT p_partkey) >= 40) SELECT DISTINCT p_partkey, token FROM tok JOIN v USING (token)")
def binary_bag_of_words(spark, sf):
    rows = G.token_rows(_themes(spark, sf), "p_partkey", F.col("themes")).distinct()
    return G.bag_of_words(rows, "p_partkey", G.vocabulary(rows, least=40))


# ---------------------------------------------------------------- opening tags

_PRE = "|".join(PREFIX_WORDS)
PARTS = O.TAGS + f""", pt AS (SELECT o_orderkey, tags, list_filter(string_split(tags, ' '), lambda x: x <> '') AS tl FROM tags),
p0 AS (SELECT o_orderkey, len(tl) AS n_tags, flatten(list_transform(string_split(coalesce(tl[1], ''), '_'), lambda x: CASE WHEN regexp_matches(x, '[A-Z]')
   THEN regexp_extract_all(x, '[A-Z][a-z0-9''\\-]*') WHEN x <> '' THEN [x] ELSE [] END)) AS raw FROM pt),
pp AS (SELECT o_orderkey, n_tags, CASE WHEN len(raw) = 0 THEN [] ELSE string_split(lower(regexp_replace(array_to_string(raw, ' '), '(^| )({_PRE}) ([^ ]+)', '\\1\\2_\\3', 'g')), ' ') END AS parts FROM p0)"""

FAMILY = """CASE WHEN len(parts) = 0 THEN 'unknown' WHEN parts[1] LIKE 'kings%' THEN 'kings' || substr(parts[1], 6) WHEN parts[1] LIKE 'king%' THEN 'kings_' || substr(parts[1], 5)
 WHEN parts[1] LIKE 'queens%' THEN 'queens' || substr(parts[1], 7) WHEN parts[1] LIKE 'queen%' THEN 'queens_' || substr(parts[1], 6)
 WHEN parts[1] = 'ruy' AND parts[2] = 'lopez' THEN 'ruy_lopez' WHEN parts[1] = 'nimzo' AND contains(coalesce(parts[2], ''), 'indian') THEN 'nimzo_indian' ELSE parts[1] END"""
_TYPES = O.values(TYPE_WORDS)
NAMES = PARTS + f""", ty AS (SELECT *, {FAMILY} AS family, coalesce(list_min(list_filter(list_transform(range(1, len(parts) + 1), lambda i: CASE WHEN list_contains({_TYPES}, parts[i]) THEN i ELSE 999 END), lambda i: i < 999)), 0) AS tp FROM pp),
nm AS (SELECT *, CASE WHEN len(parts) < 2 OR tp = 1 THEN '' WHEN tp > 1 THEN array_to_string(parts[1:tp], '_') ELSE array_to_string(parts[1:least(3, len(parts))], '_') END AS variation,
  CASE WHEN len(parts) >= 2 AND tp > 1 AND tp < len(parts) THEN array_to_string(parts[1:tp+1], '_') ELSE '' END AS sub_variation FROM ty)"""


def _parsed(spark, sf):
    return G.parsed_tags(I.tags(spark, sf), K, "tags")


@register("opening_tag_parts", "T4 T5 X7", O.with_(PARTS) + "SELECT o_orderkey, CAST(n_tags AS INT) AS n_tags, array_to_string(parts, '|') AS parts FROM pp")
def opening_tag_parts(spark, sf):
    return _parsed(spark, sf).withColumn("parts", F.array_join("parts", "|"))


@register("camel_case_parts", "T4 T20", "SELECT p_partkey, array_to_string(regexp_extract_all(upper(substr(p_name, 1, 1)) || substr(replace(p_name, ' ', 'X'), 2), '[A-Z][a-z0-9''\\-]*'), '|') AS parts FROM part")
def camel_case_parts(spark, sf):
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.substr(F.replace("p_name", F.lit(" "), F.lit("X")), F.lit(2)))
    return table(spark, sf, "part").select("p_partkey", F.array_join(G.tag_parts(name), "|").alias("parts"))


@register("standard_families", "T6 X5", O.with_(PARTS) + f"SELECT o_orderkey, {FAMILY} AS family FROM pp")
def standard_families(spark, sf):
    return _parsed(spark, sf).select(K, G.standard_family(F.col("parts")).alias("family"))


@register("primary_families", "T7", O.with_(O.TAGS) + """SELECT o_orderkey, CASE WHEN tags = '' THEN 'Unknown' ELSE split_part(split_part(tags, ' ', 1), '_', 1) END AS family,
  CASE WHEN contains(split_part(tags, ' ', 1), '_') THEN substr(split_part(tags, ' ', 1), instr(split_part(tags, ' ', 1), '_') + 1) ELSE '' END AS variation FROM tags""")
def primary_families(spark, sf):
    return I.tags(spark, sf).select(K, L.primary_family(F.col("tags")).alias("family"), L.variation(F.col("tags")).alias("variation"))


@register("two_part_families", "T8", O.with_(O.TAGS) + "SELECT o_orderkey, CASE WHEN tags = '' THEN 'Unknown' ELSE array_to_string(string_split(split_part(tags, ' ', 1), '_')[1:2], '_') END AS family FROM tags")
def two_part_families(spark, sf):
    return I.tags(spark, sf).select(K, L.two_part_family(F.col("tags")).alias("family"))


_VOCAB = "voc AS (SELECT tag FROM (SELECT unnest(list_filter(string_split(tags, ' '), lambda x: x <> '')) AS tag FROM tags) GROUP BY 1 HAVING count(*) >= 30)"


def _vocab(spark, sf):
    return G.vocabulary(G.token_rows(I.tags(spark, sf), K, F.col("tags"), lower=False), least=30).withColumnRenamed("token", "tag")


@register("listed_tags", "T9", O.with_(O.TAGS, _VOCAB) + ", e AS (SELECT o_orderkey, unnest(tl) AS tag, generate_subscripts(tl, 1) - 1 AS pos FROM (SELECT o_orderkey, list_filter(string_split(tags, ' '), lambda x: x <> '') AS tl FROM tags)) SELECT o_orderkey, CAST(pos AS INT) AS pos, tag FROM e JOIN voc USING (tag)")
def listed_tags(spark, sf):
    return G.listed_tags(I.tags(spark, sf), K, "tags", _vocab(spark, sf))


@register("variation_names", "T10", O.with_(NAMES) + "SELECT o_orderkey, variation, sub_variation FROM nm")
def variation_names(spark, sf):
    return project(_parsed(spark, sf), K, G.variation_columns(F.col("parts")))


_KNOWN = ["queens_gambit", "sicilian", "slav_defense", "ruy_lopez_berlin_defense", "kings_pawn", "absent_name"]
_KN = "kn AS (SELECT unnest(" + O.values(_KNOWN) + ") AS name)"
_FAM_COUNTS = "fcn AS (SELECT family AS name, count(*) AS n FROM nm WHERE len(parts) > 0 GROUP BY 1)"
_VAR_COUNTS = "vcn AS (SELECT name, count(*) AS n FROM (SELECT variation AS name FROM nm UNION ALL SELECT sub_variation FROM nm) WHERE name <> '' GROUP BY 1)"


def _known(spark):
    return spark.createDataFrame([(n,) for n in _KNOWN], "name string")


@register("top_families", "T11", O.with_(NAMES, _KN, _FAM_COUNTS) + "SELECT name, CAST(n AS BIGINT) AS n, CAST(name IN (SELECT name FROM kn) AS INT) AS listed FROM fcn WHERE n >= 20 ORDER BY listed DESC, n DESC, name LIMIT 8")
def top_families(spark, sf):
    fam, _ = G.name_counts(_parsed(spark, sf))
    return G.top_names(fam, _known(spark), 8, 20)


@register("top_variations", "T11", O.with_(NAMES, _KN, _VAR_COUNTS) + "SELECT name, CAST(n AS BIGINT) AS n, CAST(name IN (SELECT name FROM kn) AS INT) AS listed FROM vcn WHERE n >= 10 ORDER BY listed DESC, n DESC, name LIMIT 15")
def top_variations(spark, sf):
    _, var = G.name_counts(_parsed(spark, sf))
    return G.top_names(var, _known(spark), 15, 10)


_FAMS, _VARS, _KWS = ["sicilian", "ruy_lopez", "queens_gambit"], ["sicilian_defense", "italian_game", "queens_gambit_declined"], ["defense", "modern", "exchange"]


@register("opening_features", "T12", O.with_(NAMES) + """SELECT o_orderkey, CAST(n_tags AS INT) AS opening_num_tags, CAST(n_tags > 0 AS INT) AS has_opening_tags, CAST(len(parts) AS INT) AS opening_depth,
 """ + ", ".join(f"CAST(list_contains(parts, '{w}') AS INT) AS {n}" for n, w in (("opening_is_gambit", "gambit"), ("opening_is_defense", "defense"), ("opening_is_attack", "attack"),
                                                                              ("opening_is_system", "system"), ("opening_has_variation", "variation"))) + ", "
          + ", ".join([f"CAST(family = '{n}' AS INT) AS open_fam_{n}" for n in _FAMS] + [f"CAST(variation = '{n}' AS INT) AS open_var_{n}" for n in _VARS]
                      + [f"CAST(list_contains(parts, '{n}') AS INT) AS open_kw_{n}" for n in _KWS]) + " FROM nm")
def opening_features(spark, sf):
    p = F.col("parts")
    cols = {**G.opening_columns(p, F.col("n_tags")), **G.name_one_hot(G.standard_family(p), G.variation_columns(p)["variation"], p, _FAMS, _VARS, _KWS)}
    return project(_parsed(spark, sf), K, cols)


def _held(terms, *cols):
    return "CAST(" + " OR ".join(f"contains({c}, '{t}')" for c in cols for t in terms) + " AS INT)"


_GROUPS = ", ".join([f"{_held(t, 'family')} AS eco_{g}" for g, t in ECO_NAME_TERMS.items()] + [
    f'{_held(t, "family", "variation")} AS "{pre}_{g}"' for pre, groups in (("style", STYLE_TERMS), ("move", FIRST_PAIR_TERMS), ("structure", STRUCTURE_TERMS)) for g, t in groups.items()])


@register("opening_groups", "T13 A8 T20", O.with_(NAMES) + f"SELECT o_orderkey, {_GROUPS} FROM nm")
def opening_groups(spark, sf):
    p = _parsed(spark, sf).select(K, G.standard_family(F.col("parts")).alias("family"), G.variation_columns(F.col("parts"))["variation"].alias("variation"))
    return project(p, K, G.group_columns(F.col("family"), F.col("variation")))


# ---------------------------------------------------------------- text vectors

@register("tf_idf", "T16", O.with_(_DOC_TOK) + """, c AS (SELECT doc_id, token, count(*) AS tf FROM dt GROUP BY 1, 2), v AS (SELECT token, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 5),
  w AS (SELECT doc_id, token, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM c JOIN v USING (token)),
  s AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1) SELECT doc_id, token, round(w / norm, 6) AS weight FROM w JOIN s USING (doc_id)""")
def tf_idf(spark, sf):
    out = X.tf_idf(table(spark, sf, "documents"), "doc_id", F.col("text"), least=5)
    return out.withColumn("weight", rounded(F.col("weight")))


@register("hashed_tokens", "T18", O.with_(TH) + """, b AS (SELECT p_partkey, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 15 AS b FROM (SELECT p_partkey, unnest(t) AS token FROM tt)),
  c AS (SELECT p_partkey, b, count(*) AS n FROM b GROUP BY 1, 2), l AS (SELECT p_partkey, sqrt(sum(n * n)) AS len FROM c GROUP BY 1)
  SELECT p_partkey, """ + ", ".join(f"round(coalesce(max(n / len) FILTER (b = {i}), 0), 6) AS hash_{i}" for i in range(15)) + " FROM c JOIN l USING (p_partkey) GROUP BY 1")
def hashed_tokens(spark, sf):
    out = X.hashed_features(_themes(spark, sf), "p_partkey", F.col("themes"), 15)
    return out.select("p_partkey", *[rounded(F.col(c)).alias(c) for c in out.columns if c != "p_partkey"])


@register("svd_text_features", "T17")
def svd_text_features(spark, sf):
    return X.svd_features(table(spark, sf, "documents"), "doc_id", F.col("text"), k=10)


@register("topic_text_features", "T19")
def topic_text_features(spark, sf):
    return X.topic_features(table(spark, sf, "documents"), "doc_id", F.col("text"), k=8)


# ---------------------------------------------------------------- scalar functions

@register("scalar_functions", "X14 X15 X16 X17 X18 X19 X21", """SELECT o_orderkey, CAST(abs(o_custkey - 500) AS BIGINT) AS distance, CAST(greatest(abs(o_custkey % 8 - 3), abs(o_orderkey % 8 - 4)) AS BIGINT) AS chebyshev,
  CAST(least(o_custkey, 900) AS BIGINT) AS capped, CAST(round_even(o_totalprice / 1000, 0) AS BIGINT) AS whole, round(ln(o_totalprice), 6) AS log_price, round(ln(1 + o_totalprice), 6) AS log1p_price,
  round(sqrt(o_totalprice), 6) AS root, CAST(sign(o_custkey - 500) AS BIGINT) AS side, CAST(o_custkey % 2 AS BIGINT) AS parity, round(o_totalprice / greatest(1, o_custkey - 500), 6) AS safe_ratio FROM orders""")
def scalar_functions(spark, sf):
    p, c, o = F.col("o_totalprice"), F.col("o_custkey"), F.col(K)
    return table(spark, sf, "orders").select(
        K, F.abs(c - 500).alias("distance"), F.greatest(F.abs(c % 8 - 3), F.abs(o % 8 - 4)).alias("chebyshev"), F.least(c, F.lit(900)).alias("capped"),
        F.bround(p / 1000).cast("long").alias("whole"), rounded(F.ln(p)).alias("log_price"), rounded(F.log1p(p)).alias("log1p_price"), rounded(F.sqrt(p)).alias("root"),
        F.signum(c - 500).cast("long").alias("side"), F.pmod(c, F.lit(2)).alias("parity"), rounded(p / F.greatest(F.lit(1), c - 500)).alias("safe_ratio"))


@register("strongest_curve_level", "X22", O.with_(O.CURVE) + "SELECT vec_id, CAST(list_position(c[1:11], list_max(c[1:11])) - 1 AS INT) AS level FROM curve")
def strongest_curve_level(spark, sf):
    c = I.curve(spark, sf)
    return c.select("vec_id", X.argmax(F.array(*[n for n in c.columns if "rapid" in n])).alias("level"))


@register("daily_dates", "X24", """SELECT e.event_type, strftime(d, '%Y-%m-%dT%H:%M:%S') AS day, CAST(count(*) FILTER (date_trunc('day', x.ts) = d) AS BIGINT) AS n
  FROM (SELECT event_type, unnest(generate_series(min(date_trunc('day', ts)), max(date_trunc('day', ts)), INTERVAL 1 DAY)) AS d FROM events GROUP BY 1) e JOIN events x USING (event_type) GROUP BY 1, 2""")
def daily_dates(spark, sf):
    """Every calendar day between the first and last event of a type, also those without events."""
    e = table(spark, sf, "events").select("event_type", F.date_trunc("day", "ts").alias("day"))
    span = e.groupBy("event_type").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = span.select("event_type", F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("day"))
    n = e.groupBy("event_type", "day").agg(F.count("*").alias("n"))
    return days.join(n, ["event_type", "day"], "left").select("event_type", F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))
