"""Table-level operators: null defaults, flags, alignment joins, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import HIGH_CONFIDENCE
from ..session import cut_lineage

# ---------------------------------------------------------------- projections

def one_row(df: DataFrame) -> Column:
    """A one-row frame as a struct value usable in any projection: a scalar subquery, not a join."""
    return df.select(F.struct(*df.columns)).scalar()


def numeric_columns(df: DataFrame, drop: list[str] | None = None) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in (drop or [])]


def keep_numeric(df: DataFrame, key: str, drop: list[str] | None = None) -> DataFrame:
    return df.select(key, *numeric_columns(df, [key, *(drop or [])]))


def fill_numeric(df: DataFrame, value: float = 0, keep: list[str] | None = None) -> DataFrame:
    """Null numbers to ``value``; text is left alone."""
    return df.fillna(value, subset=numeric_columns(df, keep))


def project_present(df: DataFrame, wanted: list[str]) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])


def drop_named(df: DataFrame, terms: list[str]) -> DataFrame:
    return df.drop(*[c for c in df.columns if any(t in c for t in terms)])


def to_number(c: Column) -> Column:
    """Text to double, anything unreadable to 0."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def log_by_train_minimum(df: DataFrame, columns: list[str], flag: str = "is_train") -> DataFrame:
    """``log(x)`` when the train minimum is positive, else ``log1p(x - min(minimum, 0))``. The minimum is one row."""
    low = one_row(df.agg(*[F.min(F.when(F.col(flag) == 1, F.col(c))).alias(c) for c in columns]))
    out = df.withColumn("_low", low)
    logs = {}
    for c in columns:
        m = F.col("_low")[c]
        logs[f"{c}_log"] = F.when(m > 0, F.log(F.col(c))).otherwise(F.log1p(F.col(c) - F.least(m, F.lit(0.0))))
    return out.withColumns(logs).drop("_low")


def has_text(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def presence_interactions(df: DataFrame, has: str, columns: list[str], names: tuple[str, str] = ("no_tag", "with_tag")) -> DataFrame:
    return df.withColumns({
        **{f"{names[0]}_{c}": (1 - F.col(has)) * F.col(c) for c in columns},
        **{f"{names[1]}_{c}": F.col(has) * F.col(c) for c in columns}})


def row_statistics(columns: list[str], prefix: str) -> dict[str, Column]:
    """Mean and sample deviation over columns of a row, nulls skipped, by plain sums so it stays in generated code."""
    cs = [F.col(c) for c in columns]
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cs])
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cs])
    mean = total / F.nullif(n, F.lit(0))
    spread = reduce(lambda a, b: a + b, [F.coalesce((c - F.col(f"{prefix}_mean")) * (c - F.col(f"{prefix}_mean")), F.lit(0.0)) for c in cs])
    return {f"{prefix}_mean": mean, f"{prefix}_std": F.sqrt(spread / F.nullif(F.greatest(n - 1, F.lit(0)), F.lit(0)))}


def with_row_statistics(df: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    stats = row_statistics(columns, prefix)
    return df.withColumn(f"{prefix}_mean", stats[f"{prefix}_mean"]).withColumn(f"{prefix}_std", stats[f"{prefix}_std"])


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Z-scores with the sample deviation; constant columns and nulls become 0."""
    stats = one_row(df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns]))
    part = {c: F.col("_stats")[c] for c in columns}
    z = {c: F.coalesce((F.col(c) - part[c]["m"]) / F.nullif(part[c]["s"], F.lit(0.0)), F.lit(0.0)) for c in columns}
    return df.withColumn("_stats", stats).withColumns(z).select(*df.columns)


# ---------------------------------------------------------------- provenance of tags

def enhance_tags(tag: Column, family: Column, confidence: Column, suffix: Column | None = None,
                 threshold: float = HIGH_CONFIDENCE) -> Column:
    """Missing tags get the predicted family and a marker when the confidence is high enough."""
    mark = F.lit(" (predicted)") if suffix is None else F.concat(F.lit(" (predicted-"), suffix, F.lit(")"))
    return F.when(~has_text(tag) & (confidence >= threshold), F.concat(family, mark)).otherwise(tag)


def provenance_columns(tag: Column, confidence: Column, threshold: float = HIGH_CONFIDENCE) -> dict[str, Column]:
    original = has_text(tag)
    return {
        "has_original_tag": original.cast("int"),
        "has_predicted_tag": (original | F.coalesce(confidence >= threshold, F.lit(False))).cast("int"),
        "tag_prediction_confidence": F.when(original, 1.0).otherwise(F.coalesce(confidence, F.lit(0.0))),
    }


def effective_tag(original: Column, confidences: list[Column], threshold: float = 0.8) -> dict[str, Column]:
    best = F.greatest(*[F.coalesce(c, F.lit(0.0)) for c in confidences], F.lit(0.0))
    high = (best >= threshold) & (original == 0)
    return {"high_confidence_inference": high.cast("int"), "effective_has_tags": ((original == 1) | high).cast("int")}


def sample_weight(original: Column, high: Column, ensemble: Column, prediction: Column) -> Column:
    """1.0 original, 0.8 high, 0.5 medium, 0.3 low confidence."""
    medium = (F.coalesce(ensemble, F.lit(0.0)) >= 0.6) | (F.coalesce(prediction, F.lit(0.0)) >= 0.7)
    return F.when(original == 1, 1.0).when(high == 1, 0.8).when(medium, 0.5).otherwise(0.3)


# ---------------------------------------------------------------- joins

def rename_clashes(sets: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """Columns that occur in more than one set get the set name as suffix."""
    return dict(zip(sets, _without_clashes(list(sets.items()), {key})))


def _without_clashes(sets: list[tuple[str, DataFrame]], keys: set[str]) -> list[DataFrame]:
    seen: dict[str, int] = {}
    for _, df in sets:
        for c in df.columns:
            seen[c] = seen.get(c, 0) + 1
    return [df.select(*[F.col(c).alias(f"{c}_{name}") if c not in keys and seen[c] > 1 else F.col(c) for c in df.columns]) for name, df in sets]


#: Bytes of a table that every task may hold, and rows of one that none does, however small Spark guesses it from its packed file.
SMALL, MANY = 8 << 20, 100_000


def is_small(rows: int, numbers: int) -> bool:
    return rows * numbers * 8 <= SMALL


def as_right_side(df: DataFrame, rows: int, numbers: int | None = None) -> DataFrame:
    """A table of counted ``rows`` as the right side of a join: broadcast if its ``numbers`` per row make it small, met in an exchange if it has many rows, else as Spark decides."""
    if numbers is not None and is_small(rows, numbers):
        return F.broadcast(df)
    return df.hint("merge") if rows > MANY else df


def with_value_ids(df: DataFrame, inputs: list[str], at: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with the number of its value of ``inputs`` as column ``at``, and the distinct values (``at``, inputs). Nulls are values.

    Costly features of a value are then made once and joined back by number. Numbers are written, so they stand. Each row has its value, so the join is a left one, which
    never broadcasts ``df``.
    """
    values = cut_lineage(df.select(*inputs).distinct().select(F.monotonically_increasing_id().alias(at), *inputs))
    named = values.select(at, *[F.col(c).alias(f"_v_{c}") for c in inputs])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_v_{c}")) for c in inputs])
    return df.join(as_right_side(named, values.count()), same, "left").drop(*[f"_v_{c}" for c in inputs]), values


def attach(rows: DataFrame, sets: list[tuple[str, DataFrame | list[str], str]], key: str, counts: dict[str, int] | None = None) -> DataFrame:
    """(key, columns of all sets in order): each set (suffix for clashes, frame, its key column) joined to ``rows`` by its own key, numeric nulls filled.

    A list of names in place of a frame stands for columns of ``rows``. ``counts`` tells the number of values of a key column, where it is known. A set travels as one struct,
    which joins copy as bytes, and is taken apart by one projection at the end. The sets of one key are joined behind each other, keys with few columns first and
    small sets last, so the rows that move through an exchange stay as short as they can.
    """
    counts, keys = counts or {}, [at for _, _, at in sets]
    frames = [rows.select(key, *df) if isinstance(df, list) else df for _, df, _ in sets]
    named = _without_clashes([(n, df) for (n, _, _), df in zip(sets, frames)], set(keys))
    columns = [[c for c in df.columns if c != at] for df, at in zip(named, keys)]
    width = {at: sum(len(cs) for cs, a in zip(columns, keys) if a == at) for at in keys}
    own = [i for i, (_, df, _) in enumerate(sets) if isinstance(df, list)]
    out = rows.select(*dict.fromkeys([key, *keys]), *[F.struct(*[F.col(o).alias(c) for o, c in zip(sets[i][1], columns[i])]).alias(f"_set_{i}") for i in own])
    last = [at in counts and is_small(counts[at], len(cs)) for at, cs in zip(keys, columns)]
    for i in sorted(set(range(len(sets))) - set(own), key=lambda i: (last[i], keys[i] != key, width[keys[i]], keys[i])):
        part = named[i].select(keys[i], F.struct(*columns[i]).alias(f"_set_{i}"))
        out = out.join(as_right_side(part, counts[keys[i]], len(columns[i])) if keys[i] in counts else part, keys[i], "left")
    return fill_numeric(out.select(key, *[F.col(f"_set_{i}")[c].alias(c) for i, cs in enumerate(columns) for c in cs]), 0, [key])


def align(sets: dict[str, DataFrame], key: str, fill: float | None = 0) -> DataFrame:
    """Feature sets side by side on the key, all keys kept, clashes renamed, numeric nulls filled.

    All joins are on the same key, so each set is shuffled once and the chain adds no further exchange.
    """
    named = rename_clashes(sets, key)
    out = reduce(lambda a, b: a.join(b, key, "full_outer"), named.values())
    return out if fill is None else fill_numeric(out, fill, [key])


def merge_on_key(left: DataFrame, right: DataFrame, key: str, suffix: str = "_combined", how: str = "inner") -> DataFrame:
    clash = set(left.columns) & set(right.columns) - {key}
    return left.join(right.select(*[F.col(c).alias(c + suffix) if c in clash else F.col(c) for c in right.columns]), key, how)


def left_merge_filled(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left merge; numbers without a partner become 0, text stays null."""
    added = [c for c in right.columns if c not in left.columns]
    out = merge_on_key(left, right, key, how="left")
    return out.fillna(0, subset=[c for c in numeric_columns(out) if c in added])


def replace_features(left: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Drop the columns that the new feature set brings, then attach it, keeping all left rows."""
    overlap = [c for c in features.columns if c != key and c in left.columns]
    out = left.drop(*overlap).join(features, key, "left")
    return out.fillna(0, subset=[c for c in numeric_columns(features, [key])])


def engineered_train_raw_test(raw: DataFrame, features: DataFrame, key: str, flag: str = "is_train") -> DataFrame:
    """Train rows with engineered columns over raw test rows, joined by key."""
    clash = set(raw.columns) & set(features.columns) - {key}
    feats = features.select(*[F.col(c).alias(f"{c}_engineered") if c in clash else F.col(c) for c in features.columns])
    train = raw.filter(F.col(flag) == 1).join(feats, key, "left")
    return train.unionByName(raw.filter(F.col(flag) == 0), allowMissingColumns=True)


def keep_members(df: DataFrame, allowed: DataFrame, on: str) -> DataFrame:
    return df.join(allowed, on, "left_semi")


def missing_members(df: DataFrame, known: DataFrame, on: str) -> DataFrame:
    return df.join(known, on, "left_anti")


def results_for(rows: DataFrame, results: DataFrame, on: str) -> DataFrame:
    """Results for the distinct values of ``on`` found in ``rows``, one per value."""
    return results.dropDuplicates([on]).join(rows.select(on).distinct(), on, "left_semi")


def first_per(df: DataFrame, on: str, order: str) -> DataFrame:
    """One row per value of ``on``: the one with the smallest ``order``, by aggregation with a partial step."""
    rest = [c for c in df.columns if c != on]
    picked = df.groupBy(on).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return picked.select(on, *[F.col("r")[c].alias(c) for c in rest])


def replicate(df: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times, by a generator inside each task."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("copy"))


def split_by_flag(df: DataFrame, flag: str = "is_train") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(flag) == 1), df.filter(F.col(flag) == 0)


# ---------------------------------------------------------------- label counts

def label_support(df: DataFrame, label: str, least: int = 5) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def top_labels(df: DataFrame, label: str, n: int, least: int = 1) -> DataFrame:
    """Most frequent labels, ties by name."""
    counts = df.groupBy(label).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return counts.orderBy(F.desc("n"), F.asc(label)).limit(n)


def label_shares(df: DataFrame, split: str, label: str) -> DataFrame:
    """Share of each label within each split. The window runs over label counts, not rows."""
    from pyspark.sql import Window

    counts = df.groupBy(split, label).agg(F.count("*").alias("n"))
    return counts.select(split, label, (F.col("n") / F.sum("n").over(Window.partitionBy(split))).alias("share"))


def dominant_label(df: DataFrame, group: str, label: str, times: Column | None = None) -> DataFrame:
    """Most frequent label per group with its share and the group size; ties by name. Two partial aggregations. ``times``: how often a row counts."""
    counts = df.groupBy(group, label).agg(F.sum(F.lit(1) if times is None else times).alias("n"))
    top = counts.groupBy(group).agg(
        F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("l"))).alias("b"), F.sum("n").alias("sample_size"))
    return top.select(group, F.col("b.l").alias("dominant"), (-F.col("b.m") / F.col("sample_size")).alias("share"), "sample_size")
