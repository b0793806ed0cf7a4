"""Fixture views over the driver tables (no driver table carries a rating).

Each view derives a rating-shaped table deterministically from the given
parquet tables, so every query's work grows with them. These are fixtures for
operator checks, not meaningful models. The SQL twins live in
``starling.plans.oracle``; both must stay in step.

Scale notes: every view is a projection of one scan, except ``scored`` (one
equi-join of lineitem and orders on the order key, pruned to two order
columns) and ``train_text`` (documents joined to labels on doc_id). Column
pruning and the filter on the label reach the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starling.domain import TARGET_ORIGIN, VALID_RATINGS
from starling.functions.decode import softmax
from starling.session import table_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def rating_of_class(c) -> F.Column:
    """0..3 -> 1, 2, 4, 5."""
    expr = None
    for idx, value in enumerate(VALID_RATINGS):
        cond = c == F.lit(idx)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr.cast("bigint")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> (row_id, review, rating, target_origin); rating by doc_id % 4."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("bigint").alias("row_id"),
        F.col("text").alias("review"),
        rating_of_class(F.col("doc_id") % 4).alias("rating"),
        F.lit(TARGET_ORIGIN).alias("target_origin"),
    )


def _label_of_priority() -> F.Column:
    return F.substring("o_orderpriority", 1, 1).cast("bigint")


def _pred(qty_cut: float, key: str) -> F.Column:
    return (F.when(F.col("l_quantity") > F.lit(qty_cut), F.col("label"))
            .otherwise(rating_of_class(F.col(key) % 4)))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem x orders: label = priority digit (3 removed), three systems.

    ``row_id`` is unique and deterministic: order key * 1000 + the position of
    the line within its order (ordered by every lineitem column, so exact
    duplicates, which are interchangeable, are simply numbered). The window is
    partitioned by the order key, so it reuses the join's shuffle.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    orders = (table(spark, sf_dir, "orders")
              .select(F.col("o_orderkey"), _label_of_priority().alias("label"))
              .where(F.col("label") != 3))
    joined = li.join(orders, li.l_orderkey == orders.o_orderkey, "inner").drop("o_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax")
    line_idx = F.row_number().over(w)
    return joined.select(
        "*",
        _pred(25.0, "l_partkey").alias("pred_a"),
        _pred(40.0, "l_suppkey").alias("pred_b"),
        (F.col("label").cast("double") + F.col("l_discount")).alias("pred_c"),
        F.when(line_idx < 1000, F.col("l_orderkey") * 1000 + line_idx)
         .otherwise(F.raise_error(F.lit("more than 999 lines in one order")).cast("bigint"))
         .alias("row_id"),
    )


def probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class probabilities per scored row: softmax of four scaled line values."""
    s = scored(spark, sf_dir)
    logits = F.array(
        F.col("l_quantity") / 10.0,
        F.col("l_extendedprice") / 30000.0,
        F.col("l_discount") * 20.0,
        F.col("l_tax") * 20.0,
    )
    return s.select("row_id", "l_orderkey", "l_linenumber", "label",
                    softmax(logits, 4).alias("probabilities"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: cumulative logits of an ordinal head over the whole vector, label % 4 as rank.

    The weight of component i is ((i mod 5) - 2) / 2; the three biases fall for labels below 5 and rise for the others, so
    that some of the models (one a label) have thresholds in the wrong order."""
    e = table(spark, sf_dir, "embeddings")
    products = F.transform("embedding", lambda x, i: x.cast("double") * (i % 5 - 2) / 2.0)
    z = F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
    sign = F.when(F.col("label") < 5, 1.0).otherwise(-1.0)
    return e.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("model_id"),
        F.array(z + sign * 0.5, z, z - sign * 0.5).alias("cumulative_logits"),
        (F.col("label") % 4).cast("bigint").alias("rank"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: group = label, mask = vec_id % 3 <> 0 (token-style mask)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("label").cast("bigint").alias("group_id"),
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("embedding"),
        F.when(F.col("vec_id") % 3 != 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("mask"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: run = event_type, candidate order = (ts, event_id), eval_mae = value.

    The epoch number itself is assigned by ``starling.operators.ordered`` (over
    sampled ranges, so that a whole run is never one task).
    """
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("run"),
        F.col("ts"),
        F.col("event_id").cast("bigint").alias("event_id"),
        F.col("value").cast("double").alias("eval_mae"),
    )


def train_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents x labels: class = 2*quality + (1 - toxic) -> rating 1, 2, 4, 5."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "inner")
    return j.select(
        F.col("doc_id").cast("bigint").alias("row_id"),
        F.col("text").alias("review"),
        rating_of_class(F.col("quality") * 2 + (F.lit(1) - F.col("toxic"))).alias("rating"),
        F.lit(TARGET_ORIGIN).alias("target_origin"),
    )
