"""Registered table queries: sources, projections, validation, joins, aggregates, splits, set operations."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import EVALUATION_BOUNDS, LABEL_RANGES, LOSS_RANGES, MODEL_RANGES
from ..functions import squares as S
from ..operators import boards as B
from ..operators import evaluate as V
from ..operators import quality as Q
from ..operators import splits as P
from ..operators import tables as D
from ..sources import readers as R
from ..sources import store as W
from . import inputs as I
from . import oracle_text as O
from .registry import register, table

# ---------------------------------------------------------------- sources and sinks


@register("read_csv_table", "S1 S2", "SELECT o_orderkey, o_totalprice FROM orders")
def read_csv_table(spark, sf):
    """Orders through a CSV file with an explicit schema, two columns read."""
    path = os.path.join(W.new_folder(spark, "csv"), "orders")
    table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice").write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
                           T.StructField("o_orderpriority", T.StringType()), T.StructField("o_totalprice", T.DoubleType())])
    return R.read_csv(spark, path, schema, ["o_orderkey", "o_totalprice"])


@register("pruned_scan", "S2", "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY 1")
def pruned_scan(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_quantity").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), V.rounded(F.sum("l_quantity")).alias("quantity"))


@register("keyed_feature_file", "S3", "SELECT p_partkey AS idx, p_size, p_retailprice FROM part")
def keyed_feature_file(spark, sf):
    path = os.path.join(W.new_folder(spark, "csv"), "features")
    table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), "p_size", "p_retailprice").write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("idx", T.LongType()), T.StructField("p_size", T.IntegerType()), T.StructField("p_retailprice", T.DoubleType())])
    return R.read_csv(spark, path, schema)


_STAGE = "SELECT l_suppkey, CAST(count(*) AS BIGINT) AS n, round(avg(l_extendedprice), 6) AS mean_price FROM lineitem GROUP BY 1"


def _supplier_stage(df):
    return df.groupBy("l_suppkey").agg(F.count("*").alias("n"), V.rounded(F.avg("l_extendedprice")).alias("mean_price"))


@register("stage_metadata", "S4", "SELECT 'suppliers' AS step, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS rows, 'l_suppkey,n,mean_price' AS columns FROM lineitem")
def stage_metadata(spark, sf):
    root = W.new_folder(spark, "stages")
    W.save_stage(_supplier_stage(table(spark, sf, "lineitem")), root, "suppliers", "first")
    return W.stage_log(spark, root).select("step", "rows", "columns")


@register("stage_reuse", "S5 S7", _STAGE)
def stage_reuse(spark, sf):
    """Computed once, then read back because the input has the same fingerprint."""
    root, src = W.new_folder(spark, "stages"), table(spark, sf, "lineitem")
    W.stage_or_compute(src, root, "suppliers", _supplier_stage)
    return W.stage_or_compute(src, root, "suppliers", lambda df: df.sparkSession.range(0))


@register("newest_step", "S7", _STAGE)
def newest_step(spark, sf):
    root, src = W.new_folder(spark, "steps"), table(spark, sf, "lineitem")
    W.save_stage(_supplier_stage(src).filter("n < 0"), root, "suppliers", "older")
    W.save_stage(_supplier_stage(src), root, "suppliers", "newer")
    return W.load_step(spark, root, "suppliers")


@register("export_twice", "S6", "SELECT c_custkey, c_mktsegment, 2 AS copies FROM customer")
def export_twice(spark, sf):
    """Parquet and CSV copies of one table, matched row by row."""
    src = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    pq, csv = W.export_table(src, W.new_folder(spark, "export"), "customer")
    both = spark.read.parquet(pq).unionByName(spark.read.schema(src.schema).option("header", True).csv(csv))
    return both.groupBy("c_custkey", "c_mktsegment").agg(F.count("*").cast("int").alias("copies"))


@register("submission_lines", "S8 X16", "SELECT CAST(CAST(round_even(o_totalprice / 150.0, 0) AS BIGINT) AS VARCHAR) AS value FROM orders ORDER BY o_orderkey")
def submission_lines(spark, sf):
    lines = R.text_lines(I.rated(spark, sf), F.col("rating"), ["o_orderkey"])
    path = os.path.join(W.new_folder(spark, "lines"), "out")
    W.write_lines(lines, path)
    return spark.read.text(path)


@register("metric_table", "S11", """SELECT 'orders' AS category, o_orderpriority AS name, round(avg(o_totalprice), 6) AS value FROM orders GROUP BY 2
  UNION ALL SELECT 'orders', 'rows', CAST(count(*) AS DOUBLE) FROM orders""")
def metric_table(spark, sf):
    root, t = W.new_folder(spark, "metrics"), table(spark, sf, "orders")
    means = t.groupBy(F.col("o_orderpriority").alias("name")).agg(F.avg("o_totalprice").alias("value"))
    rows = t.agg(F.lit("rows").alias("name"), F.count("*").cast("double").alias("value"))
    for m in (means, rows):
        W.append_metrics(m.withColumns({"run_id": F.lit("r"), "category": F.lit("orders"), "ts": F.current_timestamp()}), root)
    return W.read_metrics(spark, root).select("category", "name", V.rounded(F.col("value")).alias("value"))


# ---------------------------------------------------------------- projections and filters

_TT = """tt AS (SELECT o_orderkey AS id, o_totalprice AS price, o_orderpriority AS prio, 1 AS is_train FROM orders
  UNION ALL SELECT c_custkey, c_acctbal, NULL, 0 FROM customer)"""


def _train_test(spark, sf):
    train = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("prio"))
    test = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("price"))
    return R.union_tables(train, test)


@register("train_over_test", "P1 U1", O.with_(_TT) + "SELECT * FROM tt")
def train_over_test(spark, sf):
    return _train_test(spark, sf)


@register("curve_columns_in_order", "P2", O.with_(O.CURVE) + "SELECT vec_id, " + ", ".join(
    f"c[{i + 1}] AS success_prob_rapid_{n}" for i, n in enumerate(R.LEVELS)) + " FROM curve")
def curve_columns_in_order(spark, sf):
    c = I.curve(spark, sf)
    return c.select("vec_id", *R.columns_like(c, "rapid"))


@register("present_columns", "P3", "SELECT p_partkey, p_size FROM part")
def present_columns(spark, sf):
    return D.project_present(table(spark, sf, "part"), ["p_partkey", "rating_deviation", "p_size", "nb_plays"])


@register("null_defaults", "P4 X20", O.with_(O.LABELS) + "SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM pl")
def null_defaults(spark, sf):
    return I.partial_labels(spark, sf).fillna({"quality": -1, "toxic": 0}).select("doc_id", "quality", "toxic")


@register("numeric_null_fill", "P5", O.with_(O.LABELS) + "SELECT doc_id, lang, source, n_chars, coalesce(quality, -999) AS quality, coalesce(toxic, -999) AS toxic FROM pl")
def numeric_null_fill(spark, sf):
    return D.fill_numeric(I.partial_labels(spark, sf), -999)


@register("split_by_flag", "P6", O.with_(_TT) + "SELECT id, price FROM tt WHERE is_train = 1")
def split_by_flag(spark, sf):
    return D.split_by_flag(_train_test(spark, sf))[0].select("id", "price")


@register("numeric_columns_only", "P7", "SELECT o_orderkey, o_totalprice FROM orders")
def numeric_columns_only(spark, sf):
    return D.keep_numeric(table(spark, sf, "orders"), "o_orderkey", ["o_custkey"])


@register("coerced_numbers", "P8", "SELECT event_id, coalesce(TRY_CAST(split_part(event_type, 'i', 1) AS DOUBLE), 0) + coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN CAST(value AS VARCHAR) ELSE event_type END AS DOUBLE), 0) AS number FROM events")
def coerced_numbers(spark, sf):
    mixed = F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string")).otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", D.to_number(mixed).alias("number"))


@register("log_with_train_minimum", "P9 X17", O.with_(_TT) + """, m AS (SELECT min(price) FILTER (is_train = 1) AS lo FROM tt),
  m2 AS (SELECT min(price - 200000) FILTER (is_train = 1) AS lo FROM tt)
  SELECT id, is_train, round(CASE WHEN price <= 0 THEN -1 WHEN m.lo > 0 THEN ln(CASE WHEN price > 0 THEN price ELSE 1 END) ELSE ln(1 + price) END, 6) AS price_log,
   round(ln(1 + (CASE WHEN price > 0 THEN price ELSE 1000 END - 200000) - m2.lo + 200000), 6) AS shifted_log FROM tt, m, m2""")
def log_with_train_minimum(spark, sf):
    base = _train_test(spark, sf)
    base = base.withColumns({"positive": F.col("price") > 0, "shifted": F.when(F.col("price") > 0, F.col("price")).otherwise(1000) - 200000})
    out = D.log_by_train_minimum(base.withColumn("price", F.when(F.col("positive"), F.col("price")).otherwise(F.lit(None))), ["price"])
    low = D.one_row(base.agg(F.min(F.when(F.col("is_train") == 1, F.col("price") - 200000)).alias("lo")))["lo"]
    return out.select("id", "is_train", V.rounded(F.coalesce(F.col("price_log"), F.lit(-1.0))).alias("price_log"),
                      V.rounded(F.log1p(F.col("shifted") - low + 200000)).alias("shifted_log"))


@register("drop_columns_by_name", "P10", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def drop_columns_by_name(spark, sf):
    return D.drop_named(table(spark, sf, "orders"), ["status", "date", "priority"])


@register("presence_interactions", "P11", O.with_(O.LABELS) + """SELECT doc_id, CAST(quality IS NOT NULL AS INT) AS has_tag,
  CASE WHEN quality IS NULL THEN n_chars ELSE 0 END AS no_tag_n_chars, CASE WHEN quality IS NULL THEN 0 ELSE n_chars END AS with_tag_n_chars FROM pl""")
def presence_interactions(spark, sf):
    rows = I.partial_labels(spark, sf).select("doc_id", "n_chars", F.col("quality").isNotNull().cast("int").alias("has_tag"))
    return D.presence_interactions(rows, "has_tag", ["n_chars"]).drop("n_chars")


@register("has_tag", "P12", O.with_(O.TAGS) + "SELECT o_orderkey, CAST(tags <> '' AS INT) AS has_tag FROM tags")
def has_tag(spark, sf):
    return I.tags(spark, sf).select("o_orderkey", D.has_text(F.col("tags")).cast("int").alias("has_tag"))


@register("rating_range_members", "P14", O.with_(O.RATED) + """, r(lo, hi) AS (VALUES (0,1000),(1000,1500),(1500,2000),(2000,2500),(2500,3000),(3000,3500))
  SELECT o_orderkey, lo, hi FROM rated JOIN r ON rating >= lo - 100 AND rating <= hi + 100""")
def rating_range_members(spark, sf):
    from ..operators.models import rows_per_range

    return rows_per_range(I.rated(spark, sf).select("o_orderkey", "rating"), "rating").select("o_orderkey", "lo", "hi")


@register("rating_buckets", "P15", O.with_(O.RATED) + """SELECT o_orderkey, CASE WHEN rating < 1000 THEN '0-1000' WHEN rating < 1500 THEN '1000-1500' WHEN rating < 2000 THEN '1500-2000'
  WHEN rating < 2500 THEN '2000-2500' WHEN rating < 3000 THEN '2500-3000' ELSE '3000-inf' END AS bucket FROM rated""")
def rating_buckets(spark, sf):
    return I.rated(spark, sf).select("o_orderkey", V.bucket_label(F.col("rating"), EVALUATION_BOUNDS).alias("bucket"))


@register("rating_labels", "P16", O.with_(O.RATED) + """, r(lo, hi, label) AS (VALUES (0,1200,'Beginner'),(1201,1600,'Intermediate'),(1601,2000,'Advanced'),(2001,2400,'Expert'),(2401,3000,'Master'))
  SELECT o_orderkey, coalesce(label, 'Unknown') AS label FROM rated LEFT JOIN r ON rating BETWEEN lo AND hi""")
def rating_labels(spark, sf):
    return I.rated(spark, sf).select("o_orderkey", V.closed_label(F.col("rating"), LABEL_RANGES).alias("label"))


# ---------------------------------------------------------------- validation

@register("required_columns", "V1", "SELECT CAST(count(*) AS BIGINT) AS rows, 1 AS train_ok, 0 AS test_as_train_ok FROM orders")
def required_columns(spark, sf):
    t = table(spark, sf, "orders")

    def ok(df, is_train):
        try:
            Q.require_columns(df, ["o_orderkey", "rating"], is_train=is_train)
            return 1
        except Q.ValidationError:
            return 0

    return t.agg(F.count("*").alias("rows"), F.lit(ok(t.withColumn("rating", F.lit(1)), True)).alias("train_ok"), F.lit(ok(t, True)).alias("test_as_train_ok"))


_MISS = """SELECT 'lang' AS column, CAST(count(*) FILTER (lang IS NULL) AS BIGINT) AS missing, round(100.0 * count(*) FILTER (lang IS NULL) / count(*), 6) AS percent FROM pl
  UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL), round(100.0 * count(*) FILTER (quality IS NULL) / count(*), 6) FROM pl
  UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL), round(100.0 * count(*) FILTER (toxic IS NULL) / count(*), 6) FROM pl"""


@register("missing_share_verdict", "V2", O.with_(O.LABELS) + f"SELECT *, CAST(percent <= 20 AS INT) AS passes FROM ({_MISS})")
def missing_share_verdict(spark, sf):
    return Q.missing_verdict(I.partial_labels(spark, sf), ["lang", "quality", "toxic"])


@register("missing_counts", "V5", O.with_(O.LABELS) + _MISS)
def missing_counts(spark, sf):
    return Q.null_counts(I.partial_labels(spark, sf), ["lang", "quality", "toxic"])


@register("rating_out_of_range", "V3", O.with_(O.RATED) + "SELECT CAST(count(*) FILTER (NOT rating BETWEEN 500 AND 3500) AS BIGINT) AS out_of_range, CAST(count(rating) AS BIGINT) AS rows FROM rated")
def rating_out_of_range(spark, sf):
    return Q.out_of_range(I.rated(spark, sf), "rating")


@register("duplicate_keys", "V4", "SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return Q.duplicate_keys(table(spark, sf, "lineitem"), "l_orderkey")


@register("target_profile", "V6", O.with_(O.RATED) + """SELECT round(min(rating), 6) AS target_min, round(max(rating), 6) AS target_max, round(avg(rating), 6) AS target_mean,
  round(median(rating), 6) AS target_median, round(stddev_samp(rating), 6) AS target_std FROM rated""")
def target_profile(spark, sf):
    return Q.target_profile(I.rated(spark, sf), "rating")


@register("table_fingerprint", "V7 X23", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', p_partkey, p_name, p_brand, p_type, p_size)), 1, 8) AS BIGINT)) AS BIGINT) AS hash_sum FROM part")
def table_fingerprint(spark, sf):
    return W.fingerprint_md5(table(spark, sf, "part"), ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])


@register("matrix_check", "V9", O.with_(O.CURVE) + "SELECT CAST(0 AS BIGINT) AS nulls, round(max(list_max(list_transform(c, lambda x: abs(x)))), 6) AS largest, CAST(max(list_max(list_transform(c, lambda x: abs(x)))) <= 1000 AS INT) AS within FROM curve")
def matrix_check(spark, sf):
    c = I.curve(spark, sf)
    return Q.matrix_check(c, [n for n in c.columns if n.startswith("success_prob_")])


@register("feature_summary", "V10", "SELECT 'p_size' AS column, CAST(count(p_size) AS BIGINT) AS n, round(avg(p_size), 6) AS mean, CAST(min(p_size) AS DOUBLE) AS min, CAST(max(p_size) AS DOUBLE) AS max FROM part UNION ALL SELECT 'p_retailprice', count(p_retailprice), round(avg(p_retailprice), 6), round(min(p_retailprice), 6), round(max(p_retailprice), 6) FROM part")
def feature_summary(spark, sf):
    return Q.feature_summary(table(spark, sf, "part"), ["p_size", "p_retailprice"])


@register("train_rows_preserved", "V11", "SELECT CAST(count(*) AS BIGINT) AS before, CAST(count(*) AS BIGINT) AS after, 1 AS preserved FROM orders")
def train_rows_preserved(spark, sf):
    rows = _train_test(spark, sf)
    known = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("f"))
    return Q.flag_sum_preserved(rows, D.left_merge_filled(rows, known, "id"))


# ---------------------------------------------------------------- joins

_SETS = """a AS (SELECT l_suppkey AS k, CAST(count(*) AS BIGINT) AS n, round(avg(l_quantity), 6) AS v FROM lineitem GROUP BY 1),
b AS (SELECT s_suppkey AS k, s_acctbal AS bal, CAST(s_nationkey AS BIGINT) AS n FROM supplier),
c AS (SELECT l_suppkey AS k, CAST(count(*) AS BIGINT) AS late FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)"""


def _sets(spark, sf):
    li = table(spark, sf, "lineitem")
    a = li.groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"), V.rounded(F.avg("l_quantity")).alias("v"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"), F.col("s_nationkey").cast("long").alias("n"))
    c = li.filter("l_linestatus = 'F'").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("late"))
    return a, b, c


@register("aligned_feature_sets", "J1 J2", O.with_(_SETS) + """SELECT coalesce(a.k, b.k, c.k) AS k, coalesce(a.n, 0) AS n_items, coalesce(v, 0) AS v, coalesce(bal, 0) AS bal,
  coalesce(b.n, 0) AS n_home, coalesce(late, 0) AS late FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON c.k = coalesce(a.k, b.k)""")
def aligned_feature_sets(spark, sf):
    a, b, c = _sets(spark, sf)
    return D.align({"items": a, "home": b, "late": c}, "k")


@register("inner_merge", "J3", O.with_(_SETS) + "SELECT a.k, a.n, a.v, b.bal, b.n AS n_combined FROM a JOIN b ON a.k = b.k")
def inner_merge(spark, sf):
    a, b, _ = _sets(spark, sf)
    return D.merge_on_key(a, b, "k")


@register("left_merge_filled", "J4", "SELECT o_orderkey, o_custkey, coalesce(l.n, 0) AS n, l.flag FROM orders LEFT JOIN (SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, min(l_returnflag) AS flag FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def left_merge_filled(spark, sf):
    left = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    right = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.min("l_returnflag").alias("flag"))
    return D.left_merge_filled(left, right, "o_orderkey")


@register("replace_feature_set", "J5", "SELECT p_partkey, p_name, coalesce(l.n, 0) AS p_size FROM part LEFT JOIN (SELECT l_partkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1) l ON l_partkey = p_partkey")
def replace_feature_set(spark, sf):
    new = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("p_size"))
    return D.replace_features(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), new, "p_partkey")


@register("train_engineered_test_raw", "J6", O.with_(_TT) + """SELECT id, tt.price, prio, is_train, CASE WHEN is_train = 1 THEN n END AS n, CASE WHEN is_train = 1 THEN l.price END AS price_engineered
  FROM tt LEFT JOIN (SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, round(max(l_extendedprice), 6) AS price FROM lineitem GROUP BY 1) l ON l_orderkey = id""")
def train_engineered_test_raw(spark, sf):
    feats = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), V.rounded(F.max("l_extendedprice")).alias("price"))
    return D.engineered_train_raw_test(_train_test(spark, sf), feats, "id")


@register("members_only", "J9", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def members_only(spark, sf):
    allowed = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return D.keep_members(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), allowed, "o_custkey").select("o_orderkey")


@register("missing_members", "U5 J9", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def missing_members(spark, sf):
    known = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return D.missing_members(table(spark, sf, "customer").select("c_custkey"), known, "c_custkey")


@register("results_by_position", "J17", O.with_(O.FENS) + """, k AS (SELECT board_id, split_part(fen, ' ', 2) || split_part(fen, ' ', 3) || split_part(fen, ' ', 5) AS pos, CAST(split_part(fen, ' ', 5) AS INT) AS clock FROM fens),
  res AS (SELECT pos, CAST(count(*) AS BIGINT) AS depth FROM k WHERE clock < 30 GROUP BY 1)
  SELECT pos, depth FROM res WHERE pos IN (SELECT pos FROM k WHERE clock > 20)""")
def results_by_position(spark, sf):
    part = F.split("fen", " ")
    k = I.fens(spark, sf).select("board_id", F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(2)), F.get(part, F.lit(4))).alias("pos"), F.get(part, F.lit(4)).cast("int").alias("clock"))
    res = k.filter("clock < 30").groupBy("pos").agg(F.count("*").alias("depth"))
    return D.results_for(k.filter("clock > 20"), res, "pos")


@register("first_per_position", "U2", O.with_(O.FENS) + """, k AS (SELECT board_id, split_part(fen, ' ', 3) || split_part(fen, ' ', 5) AS pos FROM fens)
  SELECT pos, min(board_id) AS board_id FROM k GROUP BY 1""")
def first_per_position(spark, sf):
    part = F.split("fen", " ")
    k = I.fens(spark, sf).select("board_id", F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(4))).alias("pos"))
    return D.first_per(k, "pos", "board_id")


@register("replicated_rows", "U3", "SELECT s_suppkey, CAST(range AS INT) AS copy FROM supplier, range(50)")
def replicated_rows(spark, sf):
    return D.replicate(table(spark, sf, "supplier").select("s_suppkey"), 50)


# ---------------------------------------------------------------- aggregates

@register("curve_row_statistics", "A7", O.with_(O.CURVE) + "SELECT vec_id, round(list_avg(c), 6) AS prob_all_mean, round(list_stddev_samp(c), 6) AS prob_all_std, round(list_avg(c[1:11]), 6) AS prob_rapid_mean, round(list_avg(c[12:22]), 6) AS prob_blitz_mean FROM curve")
def curve_row_statistics(spark, sf):
    c = I.curve(spark, sf)
    for prefix, part in (("prob_all", "success_prob_"), ("prob_rapid", "rapid"), ("prob_blitz", "blitz")):
        c = D.with_row_statistics(c, [n for n in c.columns if n.startswith("success_prob_") and part in n], prefix)
    return c.select("vec_id", *[V.rounded(F.col(n)).alias(n) for n in ("prob_all_mean", "prob_all_std", "prob_rapid_mean", "prob_blitz_mean")])


@register("standardised_curve", "A9", O.with_(O.CURVE) + """, s AS (SELECT avg(c[1]) AS m1, stddev_samp(c[1]) AS s1, avg(c[12]) AS m2, stddev_samp(c[12]) AS s2 FROM curve)
  SELECT vec_id, round((c[1] - m1) / s1, 6) AS success_prob_rapid_1050, round((c[12] - m2) / s2, 6) AS success_prob_blitz_1050 FROM curve, s""")
def standardised_curve(spark, sf):
    names = ["success_prob_rapid_1050", "success_prob_blitz_1050"]
    out = D.standardise(I.curve(spark, sf).select("vec_id", *names), names)
    return out.select("vec_id", *[V.rounded(F.col(n)).alias(n) for n in names])


@register("regression_errors", "A10 X18", O.with_(O.RATED) + """SELECT round(sqrt(avg((rating - prediction) ** 2)), 6) AS rmse, round(avg(abs(rating - prediction)), 6) AS mae,
  round(1 - sum((rating - prediction) ** 2) / (SELECT sum((rating - m) ** 2) FROM rated, (SELECT avg(rating) AS m FROM rated)), 6) AS r2 FROM rated""")
def regression_errors(spark, sf):
    return V.regression_errors(I.rated(spark, sf), "rating", "prediction")


@register("error_by_rating_bucket", "A11", O.with_(O.RATED) + """SELECT CASE WHEN rating < 1000 THEN '0-1000' WHEN rating < 1500 THEN '1000-1500' WHEN rating < 2000 THEN '1500-2000'
  WHEN rating < 2500 THEN '2000-2500' WHEN rating < 3000 THEN '2500-3000' ELSE '3000-inf' END AS bucket, CAST(count(*) AS BIGINT) AS n, round(sqrt(avg((rating - prediction) ** 2)), 6) AS rmse FROM rated GROUP BY 1""")
def error_by_rating_bucket(spark, sf):
    r = I.rated(spark, sf).withColumn("bucket", V.bucket_label(F.col("rating"), EVALUATION_BOUNDS))
    return V.error_by_bucket(r, "bucket", "rating", "prediction")


def _fold_sql(k=5, key="o_orderkey", seed=42):
    return f"CAST(CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT) % {k} AS INT)"


@register("fold_errors", "A12", O.with_(O.RATED) + f""", f AS (SELECT *, {_fold_sql()} AS fold FROM rated)
  SELECT coalesce(fold, -1) AS fold, round(sqrt(avg((rating - prediction) ** 2)), 6) AS rmse, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY ROLLUP (fold)""")
def fold_errors(spark, sf):
    return V.fold_errors(I.rated(spark, sf).withColumn("fold", P.fold_of(F.col("o_orderkey"))), "fold", "rating", "prediction")


_SCORES = """sc AS (SELECT 'quality' AS label, quality AS truth, n_chars % 1000 / 1000.0 AS score FROM pl WHERE quality IS NOT NULL
  UNION ALL SELECT 'toxic', toxic, n_chars % 777 / 777.0 FROM pl WHERE toxic IS NOT NULL)"""


@register("label_scores", "A13", O.with_(O.LABELS, _SCORES) + """, pairs AS (SELECT a.label, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS auc
     FROM sc a JOIN sc b ON a.label = b.label AND a.truth = 1 AND b.truth = 0 GROUP BY 1),
  f AS (SELECT label, 2.0 * count(*) FILTER (score >= 0.5 AND truth = 1) / (2 * count(*) FILTER (score >= 0.5 AND truth = 1) + count(*) FILTER (score >= 0.5 AND truth = 0)
     + count(*) FILTER (score < 0.5 AND truth = 1)) AS f1 FROM sc GROUP BY 1)
  SELECT label, round(CAST(f1 AS DOUBLE), 6) AS f1, round(CAST(auc AS DOUBLE), 6) AS auc FROM f JOIN pairs USING (label)""")
def label_scores(spark, sf):
    pl = I.partial_labels(spark, sf)
    part = [pl.filter(f"{n} is not null").select(F.lit(n).alias("label"), F.col(n).alias("truth"), (F.col("n_chars") % m / float(m)).alias("score"))
            for n, m in (("quality", 1000), ("toxic", 777))]
    return V.label_scores(part[0].unionByName(part[1]), "label", "truth", "score")


_METRIC = """cur AS (SELECT event_type AS name, avg(value) AS value FROM events WHERE hour(ts) < 12 GROUP BY 1),
base AS (SELECT event_type AS name, avg(value) AS value FROM events WHERE hour(ts) >= 12 GROUP BY 1)"""


@register("metric_degradation", "A18", O.with_(_METRIC) + """SELECT name, round((c.value - b.value) / b.value * 100, 6) AS change_pct,
  CASE WHEN (c.value - b.value) / b.value * 100 > 10 THEN 'fail' WHEN (c.value - b.value) / b.value * 100 > 5 THEN 'warn' ELSE 'ok' END AS verdict FROM cur c JOIN base b USING (name)""")
def metric_degradation(spark, sf):
    """Mean value per event type, mornings against afternoons: two runs of one metric table."""
    e = table(spark, sf, "events").select(F.when(F.hour("ts") < 12, 0).otherwise(1).alias("run"), F.col("event_type").alias("name"), "value")
    means = e.groupBy("run", "name").agg(F.avg("value").alias("value"))
    return V.degradation(means.filter("run = 0").drop("run"), means.filter("run = 1").drop("run"), ["name"])


@register("engine_table_summary", "A17", """SELECT CAST(count(*) AS BIGINT) AS rows, round(avg(CAST(event_type = 'click' AS INT)) * 100, 6) AS capture_pct, round(avg(CAST(event_type = 'purchase' AS INT)) * 100, 6) AS check_pct,
  round(avg(CAST(event_type = 'signup' AS INT)) * 100, 6) AS promotion_pct, round(avg(value), 6) AS mean_depth, round(median(value), 6) AS median_score, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors FROM events""")
def engine_table_summary(spark, sf):
    from ..operators.labels import engine_summary

    e = table(spark, sf, "events")
    return engine_summary(e, capture=F.col("event_type") == "click", check=F.col("event_type") == "purchase", promotion=F.col("event_type") == "signup",
                          depth=F.col("value"), score=F.col("value"), error=F.col("event_type") == "error")


@register("label_shares_by_split", "A19", "SELECT o_orderpriority AS label, round(coalesce(max(share) FILTER (s = 0), 0) - coalesce(max(share) FILTER (s = 1), 0), 6) AS difference FROM (SELECT CAST(o_orderstatus = 'F' AS INT) AS s, o_orderpriority, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY CAST(o_orderstatus = 'F' AS INT)) AS share FROM orders GROUP BY 1, 2) GROUP BY 1")
def label_shares_by_split(spark, sf):
    t = table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("s"), F.col("o_orderpriority").alias("label"))
    shares = D.label_shares(t, "s", "label")
    part = lambda v: F.coalesce(F.max(F.when(F.col("s") == v, F.col("share"))), F.lit(0.0))
    return shares.groupBy("label").agg(V.rounded(part(0) - part(1)).alias("difference"))


@register("bucket_weighted_loss", "A20", O.with_(O.RATED) + """SELECT round(avg((rating - prediction) ** 2 * CASE WHEN rating < 1200 THEN 1.0 WHEN rating < 1800 THEN 1.5 WHEN rating < 2400 THEN 1.2
  WHEN rating < 3500 THEN 1.0 ELSE 0 END), 6) AS loss FROM rated""")
def bucket_weighted_loss(spark, sf):
    d = F.col("rating") - F.col("prediction")
    return I.rated(spark, sf).agg(V.rounded(F.avg(d * d * V.bucket_weight(F.col("rating"), LOSS_RANGES))).alias("loss"))


@register("range_weighted_average", "A16", O.with_(O.RATED) + """, r(lo, hi) AS (VALUES (0,1000),(1000,1500),(1500,2000),(2000,2500),(2500,3000),(3000,3500)),
  x AS (SELECT o_orderkey, rating * (0.9 + lo / 20000.0) AS pred, lo, hi FROM rated, r),
  w AS (SELECT *, CASE WHEN pred < lo THEN greatest(0, 1 - (lo - pred) / 100) WHEN pred > hi THEN greatest(0, 1 - (pred - hi) / 100) ELSE 1 END AS w FROM x)
  SELECT o_orderkey, round(CASE WHEN sum(w) > 0 THEN sum(w * pred) / sum(w) ELSE avg(pred) END, 6) AS prediction FROM w GROUP BY 1""")
def range_weighted_average(spark, sf):
    ranges = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in MODEL_RANGES])
    rows = I.rated(spark, sf).select("o_orderkey", "rating", F.explode(ranges).alias("r")).select(
        "o_orderkey", "r.lo", "r.hi", (F.col("rating") * (0.9 + F.col("r.lo") / 20000.0)).alias("pred"))
    return V.combine_ranges(rows, "o_orderkey").select("o_orderkey", V.rounded(F.col("prediction")).alias("prediction"))


@register("heaviest_book_entry", "A21", O.with_(O.FENS) + """, e AS (SELECT split_part(fen, ' ', 3) || ' ' || split_part(fen, ' ', 5) AS placement, board_id * 37 % 1001 AS weight, board_id FROM fens)
  SELECT placement, max(weight) AS weight, arg_max(board_id, weight * 1000000 - board_id) AS board_id FROM e GROUP BY 1""")
def heaviest_book_entry(spark, sf):
    from ..operators.labels import merge_books

    part = F.split("fen", " ")
    e = I.fens(spark, sf).select(F.concat_ws(" ", F.get(part, F.lit(2)), F.get(part, F.lit(4))).alias("placement"), (F.col("board_id") * 37 % 1001).alias("weight"), "board_id")
    return merge_books([e.filter("weight < 500"), e.filter("weight >= 500")], tie="board_id")


@register("timing_by_name", "A22", "SELECT event_type AS name, round(avg(value), 6) AS mean, round(min(value), 6) AS fastest, round(max(value), 6) AS slowest, CAST(count(*) AS BIGINT) AS calls FROM events GROUP BY 1")
def timing_by_name(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(
        V.rounded(F.avg("value")).alias("mean"), V.rounded(F.min("value")).alias("fastest"), V.rounded(F.max("value")).alias("slowest"), F.count("*").alias("calls"))


@register("slow_rows", "A23", "SELECT event_id, value FROM events WHERE value > 5 * (SELECT avg(value) FROM events)")
def slow_rows(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return e.filter(F.col("value") > 5 * e.agg(F.avg("value")).scalar())


# ---------------------------------------------------------------- splits

@register("hash_folds", "W4", f"SELECT o_orderkey, {_fold_sql()} AS fold FROM orders")
def hash_folds(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", P.fold_of(F.col("o_orderkey")).alias("fold"))


@register("hash_split", "W5", "SELECT o_orderkey, CAST(CAST('0x' || substr(md5('7:' || o_orderkey), 1, 8) AS BIGINT) < 858993459 AS INT) AS is_test FROM orders")
def hash_split(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", P.in_test(F.col("o_orderkey"), 0.2, 7).cast("int").alias("is_test"))


_STRAT = """s AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1 AS rn,
  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)"""


@register("stratified_folds", "W6", O.with_(_STRAT) + "SELECT o_orderkey, CAST(rn % 5 AS INT) AS fold FROM s")
def stratified_folds(spark, sf):
    return P.stratified_folds(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey").select("o_orderkey", "fold")


@register("stratified_split", "W6", O.with_(_STRAT) + "SELECT o_orderkey, CAST(rn < floor(n * 0.2) AS INT) AS is_test FROM s")
def stratified_split(spark, sf):
    return P.stratified_split(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey").select("o_orderkey", "is_test")


_TIME = "t AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn, count(*) OVER () AS n FROM events)"


@register("time_split", "W7", O.with_(_TIME) + "SELECT event_id, CAST(rn >= floor(n * 0.8) AS INT) AS is_test FROM t")
def time_split(spark, sf):
    return P.time_split(table(spark, sf, "events").select("event_id", "ts"), "ts", "event_id").select("event_id", "is_test")


@register("expanding_time_folds", "W8", O.with_(_TIME) + """, b AS (SELECT event_id, CAST(rn // (n // 5) AS INT) AS block FROM t WHERE rn // (n // 5) < 5)
  SELECT event_id, CAST(i AS INT) AS split, CASE WHEN block <= i THEN 'train' ELSE 'validate' END AS role FROM b JOIN range(4) r(i) ON block <= i + 1""")
def expanding_time_folds(spark, sf):
    blocks = P.time_folds(table(spark, sf, "events").select("event_id", "ts"), "ts", "event_id")
    return P.expanding_windows(blocks).select("event_id", "split", "role")


@register("dominant_label", "W9 A5", "SELECT c AS cluster, label AS dominant, round(n * 1.0 / t, 6) AS share, CAST(t AS BIGINT) AS sample_size FROM (SELECT e.label AS c, v.lang AS label, count(*) AS n, sum(count(*)) OVER (PARTITION BY e.label) AS t, row_number() OVER (PARTITION BY e.label ORDER BY count(*) DESC, v.lang) AS rn FROM embeddings e JOIN documents v ON v.doc_id = e.vec_id GROUP BY 1, 2) WHERE rn = 1")
def dominant_label(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster"))
    d = e.join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return D.dominant_label(d, "cluster", "lang").withColumn("share", V.rounded(F.col("share")))
