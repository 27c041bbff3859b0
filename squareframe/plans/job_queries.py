"""Registered composed jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits as P
from ..session import shared_folder
from ..sources import store as W
from . import inputs as I
from . import jobs as J
from . import oracle_text as O
from .board_queries import MATERIAL_CTE
from .registry import register, table


def puzzles(spark, sf):
    """A puzzle per order, all of them: the board and UCI moves of its block of line items, its tags, its line, the words of a part, its mean line price.

    Parts grow with the tables and their words are long, while their file is small: they meet the orders in an exchange, not on the driver.
    """
    games = I.uci_games(spark, sf).select(F.col("board_id").alias("_b"), "fen", "moves")
    rating = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.avg("l_extendedprice") / 25).cast("int").alias("rating"))
    themes = I.themes(spark, sf).withColumnRenamed("p_partkey", "_p")
    parts = table(spark, sf, "part").agg(F.max("p_partkey") + 1).scalar()
    orders = table(spark, sf, "orders").select("o_orderkey", F.expr("o_orderkey div 8").alias("_b"), (F.col("o_orderkey") % parts).alias("_p"),
                                               I.tag_text().alias("opening_tags"), I.line_text().alias("line"))
    out = orders.join(themes.hint("merge"), "_p", "left").join(rating, "o_orderkey", "left").join(games, "_b", "left")
    return out.withColumn("puzzle_id", F.col("o_orderkey").cast("string")).drop("o_orderkey", "_b", "_p")


def _features(spark, sf):
    """The whole feature job, tag inference and text vectors included; a second query on the same input reads the stage of the first."""
    rows = J.cut_lineage(puzzles(spark, sf))
    return J.staged_features(rows, f"{shared_folder(spark)}/feature_stages")


@register("feature_table", "L21")
def feature_table(spark, sf):
    return _features(spark, sf)


@register("feature_table_core", "L21 J1 B3 B4", O.with_(O.BD, MATERIAL_CTE, O.LINES, O.TAGS, O.THEMES) + """SELECT CAST(o.o_orderkey AS VARCHAR) AS puzzle_id, coalesce(material_balance, 0) AS material_balance, coalesce(total_material, 0) AS total_material,
  CAST(len(list_filter(string_split(coalesce(moves, ''), ' '), lambda x: x <> '')) AS INT) AS num_moves, CAST(len(list_filter(string_split(coalesce(themes, ''), ' '), lambda x: x <> '')) AS INT) AS theme_count,
  CAST(coalesce(tags, '') <> '' AS INT) AS had_opening_tags
  FROM orders o LEFT JOIN mat ON board_id = o.o_orderkey // 8 LEFT JOIN lines USING (o_orderkey) LEFT JOIN tags USING (o_orderkey)
  LEFT JOIN themes ON p_partkey = o.o_orderkey % (SELECT max(p_partkey) + 1 FROM part)""")
def feature_table_core(spark, sf):
    """The whole job, tag inference included; the columns that plain SQL can restate."""
    out = _features(spark, sf)
    return out.select("puzzle_id", "material_balance", "total_material", "num_moves", "theme_count", F.col("has_original_tag").alias("had_opening_tags"))


@register("data_job_summary", "L22 V1 V2 V6 S4 S5 P6")
def data_job_summary(spark, sf):
    """Load, validate, preprocess, features, split: row counts and feature counts of both halves."""
    rows = J.cut_lineage(puzzles(spark, sf))
    test = P.in_test(F.col("puzzle_id"), 0.2)
    train, held = J.data_job(rows.filter(~test), rows.filter(test).drop("rating"), W.new_folder(spark, "job"))
    out = train.agg(F.lit("train").alias("part"), F.count("*").alias("rows"), F.lit(len(train.columns)).alias("columns"), F.sum("material_balance").alias("balance"))
    return out.unionByName(held.agg(F.lit("test").alias("part"), F.count("*").alias("rows"), F.lit(len(held.columns)).alias("columns"), F.sum("material_balance").alias("balance")))


@register("data_job_rows", "L22 V1 V2 P6", O.with_(O.BD, MATERIAL_CTE) + """, half AS (SELECT o_orderkey, o_orderkey // 8 AS board_id,
  CASE WHEN CAST('0x' || substr(md5('42:' || CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) < 858993459 THEN 'test' ELSE 'train' END AS part FROM orders)
  SELECT part, count(*) AS rows, CAST(sum(coalesce(material_balance, 0)) AS BIGINT) AS balance FROM half LEFT JOIN mat USING (board_id) GROUP BY 1""")
def data_job_rows(spark, sf):
    """Rows and material of both halves after the whole data job without inference and text vectors."""
    rows = J.cut_lineage(puzzles(spark, sf)).fillna(0, subset=["rating"])
    test = P.in_test(F.col("puzzle_id"), 0.2)
    train, held = J.data_job(rows.filter(~test), rows.filter(test).drop("rating"), W.new_folder(spark, "job"), required=("puzzle_id", "moves", "rating"), infer_tags=False, text_vectors=False)
    one = lambda df, n: df.agg(F.lit(n).alias("part"), F.count("*").alias("rows"), F.sum("material_balance").cast("long").alias("balance"))
    return one(train, "train").unionByName(one(held, "test"))
