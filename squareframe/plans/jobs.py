"""Composed jobs: the whole feature table of a puzzle table, and the data job around it."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import EMPTY_BOARD, HIGH_CONFIDENCE
from ..operators import attacks as A
from ..operators import boards as B
from ..operators import endgames as E
from ..operators import labels as L
from ..operators import models as M
from ..operators import moves as V
from ..operators import plies as Y
from ..operators import quality as Q
from ..operators import tables as D
from ..operators import tags as G
from ..operators import text as X
from ..session import cut_lineage
from ..sources import readers as R
from ..sources import store as W

#: Raised whenever a feature changes, so that stages of older code are not read again.
FEATURE_VERSION = 5
PREDICTED_MARKER = r"\s*\(predicted[^()]*\)"
DEFAULTS = {"fen": EMPTY_BOARD, "moves": "", "line": "", "themes": "", "opening_tags": ""}


def preprocess(df: DataFrame) -> DataFrame:
    """Null defaults of the text columns that are present."""
    return df.fillna({c: v for c, v in DEFAULTS.items() if c in df.columns})


def position_features(boards: DataFrame, key: str) -> DataFrame:
    """All board features. Attacks, king rays and chains are one aggregation each on the same key, so joining them needs no
    further exchange; everything else is one projection on top."""
    att = A.attack_features(boards, key)
    parts = boards.select(key, *B.S.SETS).join(att, key, "left").join(A.king_ray_features(boards, key), key, "left").join(
        B.pawn_chains(boards, key), key, "left")
    counted = [c for c in parts.columns if c not in (key, *B.S.SETS)]
    rows = B.with_kings(parts.fillna(0, subset=counted))
    rows = rows.withColumns({**B.king_wing_columns(), **B.pawn_shield_columns(), **B.king_open_file_columns()})
    local = {
        **B.piece_count_columns(), **B.material_columns(), **B.pawn_structure_columns(), **B.passed_pawn_columns(),
        **B.most_advanced_columns(), **B.connected_passed_columns(), **B.developed_minor_columns(), **E.endgame_type_columns(),
        **E.bishop_colour_columns(), **E.king_geometry_columns(), **E.small_board_columns(),
        **{f"phase_{n}": c for n, c in E.phase_columns().items()},
        "center_control_balance": F.col("white_center_control") - F.col("black_center_control"), **A.mobility_ratio_columns(),
        **A.tactical_total_columns(), **B.king_safety_columns(), "zugzwang_potential": E.zugzwang_column(F.col("move_count"))}
    kept = [*counted, *B.king_wing_columns(), *B.pawn_shield_columns(), *B.king_open_file_columns()]
    return rows.select(key, *kept, *[c.alias(n) for n, c in local.items()])


def move_features(df: DataFrame, key: str, line: str = "line") -> DataFrame:
    plain, raw = V.tokens(V.plain_castling(F.col(line))), V.tokens(F.col(line))
    rows = df.select(key, plain.alias("_t"), raw.alias("_r"))
    return rows.select(key, F.size("_t").alias("num_moves"), *[c.alias(n) for n, c in {
        **V.first_move_columns(F.col("_t")), **V.reply_columns(F.col("_t")), **V.sequence_columns(F.col("_t")), **V.castling_columns(F.col("_r")),
        **V.notation_columns(F.col("_r"))}.items()])


def eco_features(df: DataFrame, key: str, line: str = "line") -> DataFrame:
    rows = df.select(key, V.tokens(V.plain_castling(F.col(line))).alias("_t"))
    return E.project(rows, key, V.eco_columns(F.col("_t")))


def move_analysis_features(df: DataFrame, key: str) -> DataFrame:
    counts = Y.sequence_counts(Y.replay(df, key), key)
    return counts.select("*", *[c.alias(n) for n, c in Y.forcing_columns().items()])


def theme_values(rows: DataFrame, values: DataFrame, most: int = 100, least: int = 5) -> DataFrame:
    """Theme flags of the distinct texts ``values`` (``_theme``, ``_t``) over the most frequent words; each text counts as often as it stands in ``rows``.
    The vocabulary is bounded by ``most`` and is the only thing collected."""
    t = F.col("_t")
    counted = values.join(rows.groupBy("_theme").agg(F.count("*").alias("_n")), "_theme")
    words = G.vocabulary_list(G.vocabulary(G.token_rows(counted, "_n", t), least=least, most=most, times=F.col("_n")))
    return E.project(values, "_theme", {**G.theme_columns(t), **G.one_hot(t, words, "theme"), **G.category_columns(t)})


def opening_features(df: DataFrame, key: str, tag: str = "opening_tags", families: int = 100, variations: int = 75, keywords: int = 200,
                     least: tuple[int, int, int] = (20, 10, 50), vocabulary: DataFrame | None = None) -> DataFrame:
    """Flags of families, variations and keywords. ``vocabulary`` (column ``tag``) leaves only tags that it lists, which also drops the marker of predicted ones,
    and its names come first in the ranking; without it the marker is cut off and counts alone rank. Each distinct text is parsed once."""
    rows, values = D.with_value_ids(df.select(key, F.col(tag).alias("_t")), ["_t"], "_tag")
    return rows.select(key, "_tag").join(opening_values(rows, values, families, variations, keywords, least, vocabulary), "_tag").drop("_tag")


def opening_values(rows: DataFrame, values: DataFrame, families: int = 100, variations: int = 75, keywords: int = 200,
                   least: tuple[int, int, int] = (20, 10, 50), vocabulary: DataFrame | None = None) -> DataFrame:
    """:func:`opening_features` of the distinct texts ``values`` (``_tag``, ``_t``); each counts as often as it stands in ``rows``."""
    key, df = "_tag", values
    if vocabulary is not None:
        kept = G.listed_tags(df, key, "_t", vocabulary).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("_l"))
        df = df.select(key).join(kept, key, "left").select(key, F.coalesce(F.array_join("_l.tag", " "), F.lit("")).alias("_t"))
        listed = G.parsed_tags(vocabulary.select("tag", F.col("tag").alias("_t")), "tag", "_t")
        known_fam, known_var = (c.select("name") for c in G.name_counts(listed))
    else:
        df = df.select(key, F.trim(F.regexp_replace(F.coalesce("_t", F.lit("")), PREDICTED_MARKER, "")).alias("_t"))
        known_fam = known_var = df.sparkSession.createDataFrame([], "name string")
    parsed = cut_lineage(G.parsed_tags(df, key, "_t").join(rows.groupBy(key).agg(F.count("*").alias("_n")), key))
    fam, var = G.name_counts(parsed, F.col("_n"))
    words = parsed.select(F.explode("parts").alias("name"), "_n").filter(F.length("name") > 2).groupBy("name").agg(F.sum("_n").alias("n"))
    fams, vars_ = ([r.name for r in G.top_names(c, known, n, lo).collect()] for c, known, n, lo in ((fam, known_fam, families, least[0]), (var, known_var, variations, least[1])))
    kws = [r[0] for r in words.filter(F.col("n") >= least[2]).orderBy(F.desc("n"), "name").limit(keywords).collect()]
    p = F.col("parts")
    out = parsed.select(key, "n_tags", "parts", G.standard_family(p).alias("_f"), G.variation_columns(p)["variation"].alias("_v"))
    return E.project(out, key, {**G.opening_columns(p, F.col("n_tags")), **G.name_one_hot(F.col("_f"), F.col("_v"), p, fams, vars_, kws),
                                **G.group_columns(F.col("_f"), F.col("_v"))})


def pattern_evidence(rows: DataFrame, lines: DataFrame, key: str, tag: str = "opening_tags") -> DataFrame:
    """(key, eco_family, eco_variation) of ``rows`` (key, ``_line``, tag) from the patterns of the distinct ``lines`` (``_line``, line): each is matched once."""
    patterns = cut_lineage(V.eco_pattern_rows(lines, "_line", "line"))
    known = rows.filter(D.has_text(F.col(tag))).select("_line", L.primary_family(F.col(tag)).alias("family"), L.variation(F.col(tag)).alias("variation"))
    counted = known.groupBy("_line", "family", "variation").agg(F.count("*").alias("n"))
    mapped = cut_lineage(L.mapped_label(patterns, L.pattern_mapping(patterns, counted, "_line", times=F.col("n")), "_line"))
    return rows.select(key, "_line").join(D.as_right_side(mapped, mapped.count()), "_line").drop("_line")


def text_features(values: dict[str, tuple[DataFrame, str]]) -> dict[str, tuple[DataFrame, str]]:
    """TF-IDF components, hashed tokens and topics of each text column, names prefixed by the column, and the key they are joined by.

    ``values`` has for each column its distinct texts (key, ``_t``, ``_n``: how many rows share one) and their key: each is worked on once, with its weight in the fits.
    """
    sets = {}
    for c, (df, at) in values.items():
        rows, text = df.select(at, F.translate(F.coalesce("_t", F.lit("")), "_", " ").alias("_text"), "_n"), F.col("_text")
        for kind, got in (("svd", X.svd_features(rows, at, text, weight="_n")), ("hash", X.hashed_features(rows, at, text)), ("topic", X.topic_features(rows, at, text, weight="_n"))):
            sets[f"{c}_{kind}"] = cut_lineage(got.select(at, *[F.col(n).alias(f"{c}_{n}") for n in got.columns if n != at])), at
    return sets


def complete_features(puzzles: DataFrame, key: str = "puzzle_id", infer_tags: bool = True, trees: int = 50, depth: int = 6, vocabulary: DataFrame | None = None,
                      text_vectors: bool = True) -> DataFrame:
    """Feature sets side by side: position, moves, ECO, move analysis, themes, openings with inferred tags, provenance, text vectors.

    A table without a notation column ``line`` gets the zero columns of the sets that read it. ``vocabulary``: see ``opening_features``.

    Rows are numbered by their values: a position, a list over a position, a notation line and a tag text are each worked on once, however many rows share
    them, and their features are joined back by number.
    """
    df = preprocess(puzzles if "line" in puzzles.columns else puzzles.withColumn("line", F.lit("")))
    rows, fens = D.with_value_ids(df.select(key, "fen", "moves", "line", "themes", "opening_tags"), ["fen"], "_fen")
    rows, lines = D.with_value_ids(rows, ["line"], "_line")
    rows, themes = D.with_value_ids(rows.withColumnRenamed("themes", "_t"), ["_t"], "_theme")
    rows = cut_lineage(rows.drop("_t"))
    rows, games = D.with_value_ids(rows, ["_fen", "moves"], "_game")
    rows = cut_lineage(rows.select(key, "_fen", "_line", "_game", "_theme", "opening_tags"))
    counts = {at: values.count() for at, values in (("_fen", fens), ("_line", lines), ("_theme", themes), ("_game", games))}
    boards = cut_lineage(B.decode_positions(fens).select("_fen", "white_to_move", *B.S.SETS))
    parts = D.rename_clashes({"position": position_features(boards, "_fen").withColumnRenamed("_fen", "_in"), "move": move_features(lines, "_line").withColumnRenamed("_line", "_in"),
                              "eco": eco_features(lines, "_line").withColumnRenamed("_line", "_in")}, "_in")
    base = [("base", cut_lineage(got.withColumnRenamed("_in", at)), at) for got, at in zip(parts.values(), ("_fen", "_line", "_line"))]
    analysis = move_analysis_features(games.join(fens, "_fen").select("_game", "fen", "moves"), "_game")
    sets = [*base, ("analysis", cut_lineage(analysis), "_game"), ("theme", cut_lineage(theme_values(rows, themes)), "_theme")]
    if infer_tags:
        train = rows.select(key, "opening_tags", "_fen", "_line")
        for at, values in (("_line", lines), ("_fen", fens)):  # the longer vector last
            vectors, width = value_vectors(values, [s for s in base if s[2] == at], at)
            train = train.join(D.as_right_side(vectors, counts[at], width), at, "left")
        pred = M.predict_missing(train, key, "opening_tags", L.primary_family(F.col("opening_tags")), L.variation(F.col("opening_tags")), ["_x_fen", "_x_line"],
                                 pattern_evidence(rows, lines, key), tags=rows.select(key, "opening_tags"), trees=trees, depth=depth)
        j = cut_lineage(rows.join(pred.select(key, "predicted_family", "prediction_confidence"), key, "left"))
        conf = F.coalesce("prediction_confidence", F.lit(0.0))
        own = D.provenance_columns(F.col("opening_tags"), conf)
        sets.append(("provenance", list(own), key))
        rows = j.withColumns(own).withColumn("opening_tags", D.enhance_tags(F.col("opening_tags"), F.col("predicted_family"), conf, threshold=HIGH_CONFIDENCE))
    rows, tags = D.with_value_ids(rows.withColumnRenamed("opening_tags", "_t"), ["_t"], "_tag")
    rows, counts["_tag"] = cut_lineage(rows.drop("_t", "predicted_family", "prediction_confidence")), tags.count()
    sets.append(("opening", cut_lineage(opening_values(rows, tags, vocabulary=vocabulary)), "_tag"))
    if text_vectors:
        counted = {"themes": (themes, "_theme"), "opening_tags": (tags, "_tag")}
        counted = {c: (cut_lineage(v.join(rows.groupBy(at).agg(F.count("*").alias("_n")), at)), at) for c, (v, at) in counted.items()}
        sets += [(n, got, at) for n, (got, at) in text_features(counted).items()]
    return D.attach(rows, sets, key, counts)


def value_vectors(values: DataFrame, sets: list[tuple[str, DataFrame, str]], at: str) -> tuple[DataFrame, int]:
    """(``at``, ``_x{at}``): the numbers of all sets of a value as one vector, which moves and is joined to rows as one column; and its length."""
    whole = D.attach(values, sets, at)
    names = D.numeric_columns(whole, [at])
    return cut_lineage(M.assembler(names).transform(whole).select(at, F.col("_x").alias(f"_x{at}"))), len(names)


def staged_features(rows: DataFrame, root: str, key: str = "puzzle_id", fp: str | None = None, **features) -> DataFrame:
    """The feature table of ``rows`` from the stage of the same input, settings and code version, else computed and saved there."""
    settings = sorted((k, W.fingerprint(v) if isinstance(v, DataFrame) else repr(v)) for k, v in features.items())
    made = hashlib.md5(repr((fp or W.fingerprint(rows), FEATURE_VERSION, key, settings)).encode()).hexdigest()
    return W.stage_or_compute(rows, root, "features", lambda df: complete_features(df, key, **features), made)


def data_job(train: DataFrame, test: DataFrame, root: str, key: str = "puzzle_id", required: tuple[str, ...] = ("puzzle_id", "fen", "moves", "rating"),
             run_id: str = "run", **features) -> tuple[DataFrame, DataFrame]:
    """Validate, unite, preprocess, build features (reusing the stage of the same input), split; figures go to the metric table.

    Returns (train features with the rating, test features).
    """
    spark = train.sparkSession
    Q.require_columns(train, list(required))
    Q.require_columns(test, list(required), is_train=False)
    Q.require_complete(train, [c for c in required if c in train.columns])
    Q.require_complete(test, [c for c in required if c in test.columns])
    both = R.union_tables(train, test)
    fp = W.fingerprint(both)
    ready = W.stage_or_compute(both, root, "preprocessed", preprocess, fp)
    feats = staged_features(ready, root, key, fp, **features)
    # both sides have all rows; a few columns of a wide, well packed stage look small to Spark, which would broadcast them
    joined = ready.select(key, "is_train", "rating").join(feats.drop("rating", "is_train").hint("merge"), key)
    profile = Q.target_profile(train, "rating").withColumn("out_of_range", Q.out_of_range(train, "rating").select("out_of_range").scalar())
    names = profile.columns
    metrics = profile.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("m.*")
    W.append_metrics(metrics.withColumns({"run_id": F.lit(run_id), "category": F.lit("target"), "ts": F.current_timestamp()}), root)
    tr, te = D.split_by_flag(joined)
    return tr.drop("is_train"), te.drop("is_train", "rating")
