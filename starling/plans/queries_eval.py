"""Registered queries: metrics, boards, baselines, distributions (A*, J1-J5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from starling.domain import VALID_RATINGS
from starling.functions import metrics as M
from starling.operators import evaluate as E
from starling.operators import position as P
from starling.plans import fixtures as X
from starling.plans.catalog import query, r, rounded
from starling.plans.oracle import with_views
from starling.session import scratch_path

SCORED_SYSTEMS = {"pred_a": "pred_a", "pred_b": "pred_b", "pred_c": "pred_c"}


def _metric_sql(y: str = "label", p: str = "prediction", w: str | None = None) -> dict[str, str]:
    """SQL twins of the metric aggregates (weighted when ``w`` is given)."""
    wt = w or "1"
    e = f"(CAST({p} AS DOUBLE) - CAST({y} AS DOUBLE))"
    den = f"SUM({wt})"
    return {
        "mae": f"SUM({wt} * abs({e})) / {den}",
        "rmse": f"sqrt(SUM({wt} * {e} * {e}) / {den})",
        "exact_accuracy": f"SUM({wt} * CASE WHEN abs({e}) <= 1e-8 + 1e-5 * abs(CAST({y} AS DOUBLE)) THEN 1.0 ELSE 0.0 END) / {den}",
        "within_one_accuracy": f"SUM({wt} * CASE WHEN abs({e}) <= 1.0 THEN 1.0 ELSE 0.0 END) / {den}",
        "polarity_accuracy": f"SUM({wt} * CASE WHEN (CAST({p} AS DOUBLE) >= 4.0) = (CAST({y} AS DOUBLE) >= 4.0) THEN 1.0 ELSE 0.0 END) / {den}",
    }


def sql_rank(expr: str) -> str:
    whens = " ".join(f"WHEN {v} THEN {i}" for i, v in enumerate(VALID_RATINGS))
    return f"CAST(CASE CAST({expr} AS DOUBLE) {' '.join(f'WHEN {float(v)} THEN {i}' for i, v in enumerate(VALID_RATINGS))} END AS DOUBLE)"


def sql_nearest(expr: str) -> str:
    """First domain element at minimal distance (numpy argmin on a tie)."""
    d = [f"abs(CAST({expr} AS DOUBLE) - {float(v)})" for v in VALID_RATINGS]
    low = f"least({', '.join(d)})"
    whens = " ".join(f"WHEN {di} = {low} THEN {v}" for di, v in zip(d, VALID_RATINGS))
    return f"CAST(CASE {whens} END AS BIGINT)"


def sql_qwk(y: str = "label", p: str = "prediction", w: str | None = None) -> str:
    wt = f"CAST({w} AS DOUBLE)" if w else "1.0"
    i = sql_rank(y)
    j = sql_rank(sql_nearest(p))
    n = f"SUM({wt})"
    sd = f"SUM({wt} * ({i} - {j}) * ({i} - {j}))"
    si, sj = f"SUM({wt} * {i})", f"SUM({wt} * {j})"
    sii, sjj = f"SUM({wt} * {i} * {i})", f"SUM({wt} * {j} * {j})"
    den = f"({n} * {sii} + {n} * {sjj} - 2.0 * {si} * {sj})"
    return f"CASE WHEN {den} = 0 THEN NULL ELSE 1.0 - {n} * {sd} / {den} END"


# ---------------------------------------------------------------- A3-A6
@query("rating_metrics", sql=with_views("scored") + f"""
SELECT CAST(COUNT(*) AS BIGINT) AS n,
       {r(_metric_sql('label', 'pred_a')['mae'])} AS mae,
       {r(_metric_sql('label', 'pred_a')['rmse'])} AS rmse,
       {r(_metric_sql('label', 'pred_a')['exact_accuracy'])} AS exact_accuracy,
       {r(_metric_sql('label', 'pred_a')['within_one_accuracy'])} AS within_one_accuracy
FROM scored""")
def q_rating_metrics(spark, sf_dir):
    s = X.scored(spark, sf_dir)
    return rounded(s.agg(F.count(F.lit(1)).alias("n"), *M.rating_metrics("label", "pred_a")))


# ---------------------------------------------------------------- A7
@query("polarity_accuracy", sql=with_views("scored") + f"""
SELECT {r(_metric_sql('label', 'pred_a')['polarity_accuracy'])} AS polarity_a,
       {r(_metric_sql('label', 'pred_c')['polarity_accuracy'])} AS polarity_c,
       {r(_metric_sql('label', 'pred_a')['within_one_accuracy'])} AS within_one_a,
       {r(_metric_sql('label', 'pred_c')['within_one_accuracy'])} AS within_one_c
FROM scored""")
def q_polarity(spark, sf_dir):
    s = X.scored(spark, sf_dir)
    return rounded(s.agg(
        M.polarity("label", "pred_a").alias("polarity_a"),
        M.polarity("label", "pred_c").alias("polarity_c"),
        M.within_one("label", "pred_a").alias("within_one_a"),
        M.within_one("label", "pred_c").alias("within_one_c"),
    ))


# ---------------------------------------------------------------- A8
@query("qwk", sql=with_views("scored") + f"""
SELECT {r(sql_qwk('label', 'pred_a'))} AS qwk_a,
       {r(sql_qwk('label', 'pred_b'))} AS qwk_b,
       {r(sql_qwk('label', 'pred_c'))} AS qwk_c
FROM scored""")
def q_qwk(spark, sf_dir):
    s = X.scored(spark, sf_dir)
    return rounded(s.agg(
        M.qwk("label", "pred_a").alias("qwk_a"),
        M.qwk("label", "pred_b").alias("qwk_b"),
        M.qwk("label", "pred_c").alias("qwk_c"),
    ))


# ---------------------------------------------------------------- A9 / J5 / L9
def _board_sql(source: str) -> str:
    m = _metric_sql("label", "prediction")
    return f"""
SELECT system, CAST(COUNT(*) AS BIGINT) AS n,
       {r(m['mae'])} AS mae, {r(m['rmse'])} AS rmse,
       {r(m['exact_accuracy'])} AS exact_accuracy,
       {r(m['within_one_accuracy'])} AS within_one_accuracy,
       {r(m['polarity_accuracy'])} AS polarity_accuracy,
       {r(sql_qwk('label', 'prediction'))} AS qwk
FROM {source} GROUP BY system"""


_LONG_SCORED_SQL = """
SELECT 'pred_a' AS system, label, CAST(pred_a AS DOUBLE) AS prediction FROM scored
UNION ALL SELECT 'pred_b', label, CAST(pred_b AS DOUBLE) FROM scored
UNION ALL SELECT 'pred_c', label, pred_c FROM scored"""


@query("leaderboard", sql=with_views("scored", extra={"long": _LONG_SCORED_SQL}) + _board_sql("long"))
def q_leaderboard(spark, sf_dir):
    s = X.scored(spark, sf_dir)
    long = E.long_predictions(s, SCORED_SYSTEMS, row_id=None)
    return rounded(E.leaderboard([long]))


# ---------------------------------------------------------------- J1
@query("align_predictions", sql=with_views("scored", extra={"long": _LONG_SCORED_SQL}) + f"""
SELECT system, CAST(COUNT(*) AS BIGINT) AS aligned, {r(_metric_sql('label', 'prediction')['mae'])} AS mae
FROM long GROUP BY system""")
def q_align_predictions(spark, sf_dir):
    """Labels and per-system predictions as separate tables, aligned by row key.

    The row key is the order key plus the line position within the order, a
    window partitioned by the order key (it reuses the join's distribution).
    """
    s = X.scored(spark, sf_dir)
    labels = s.select("row_id", "label")
    preds = E.long_predictions(s, SCORED_SYSTEMS).drop("label")
    joined, checked = E.align_predictions(labels, preds)
    m = joined.groupBy("system").agg(M.mae("label", "prediction").alias("mae"))
    return rounded(checked.join(m, "system"))


# ---------------------------------------------------------------- J1 without a key: by position
@query("align_by_position", sql=f"""
WITH e AS (SELECT event_id % 7 AS label, CAST(value AS DOUBLE) AS prediction, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events)
SELECT CAST(label AS BIGINT) AS label, CAST(COUNT(*) AS BIGINT) AS n, CAST(sum(position) AS BIGINT) AS positions,
       {r('sum(prediction) / 1000')} AS predictions, {r('avg(abs(prediction - label))')} AS mae
FROM e GROUP BY label""")
def q_align_by_position(spark, sf_dir):
    """Labels and predictions as two tables without a key, in files of different sizes, aligned by the rows' places."""
    ev = X.table(spark, sf_dir, "events").select(F.col("event_id").cast("bigint").alias("event_id"), (F.col("event_id") % 7).cast("bigint").alias("label"),
                                                 F.col("value").cast("double").alias("prediction"))
    labels, predictions = scratch_path(spark, "labels"), scratch_path(spark, "predictions")
    ev.repartitionByRange(5, "event_id").sortWithinPartitions("event_id").select("label").write.parquet(labels)
    ev.repartitionByRange(3, "event_id").sortWithinPartitions("event_id").select("prediction").write.parquet(predictions)
    both = P.align_by_position(spark.read.parquet(labels), spark.read.parquet(predictions))
    return rounded(both.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("position").alias("positions"), (F.sum("prediction") / 1000).alias("predictions"),
        F.avg(F.abs(F.col("prediction") - F.col("label"))).alias("mae")))


# ---------------------------------------------------------------- A8 with weights from the observed ranks
@query("qwk_observed", sql=with_views("scored", extra={
    "narrow": f"""SELECT {sql_rank('label')} AS i, {sql_rank(sql_nearest('CAST(pred_b AS DOUBLE)'))} AS j FROM scored WHERE label <> 2 AND pred_b <> 2""",
    "seen": "SELECT DISTINCT i AS k FROM narrow UNION SELECT DISTINCT j FROM narrow",
    "pos": "SELECT k, CAST(row_number() OVER (ORDER BY k) - 1 AS DOUBLE) AS p FROM seen",
    "x": "SELECT a.p AS i, b.p AS j FROM narrow JOIN pos a ON narrow.i = a.k JOIN pos b ON narrow.j = b.k"}) + f"""
SELECT {r("1.0 - COUNT(*) * sum((i - j) * (i - j)) / (COUNT(*) * sum(i * i) + COUNT(*) * sum(j * j) - 2.0 * sum(i) * sum(j))")} AS qwk FROM x""")
def q_qwk_observed(spark, sf_dir):
    """Kappa over rows in which one rating occurs on neither side, so that the scale closes up."""
    s = X.scored(spark, sf_dir).where("label <> 2 AND pred_b <> 2")
    return rounded(M.qwk_observed(s, "label", "pred_b"))


_POS = ("SELECT system, k, CAST(row_number() OVER (PARTITION BY system ORDER BY k) - 1 AS DOUBLE) AS p FROM "
        "(SELECT system, i AS k FROM narrow UNION SELECT system, j FROM narrow)")


@query("leaderboard_observed_qwk", sql=with_views("scored", extra={
    "long": _LONG_SCORED_SQL,
    "narrow": f"SELECT system, {sql_rank('label')} AS i, {sql_rank(sql_nearest('prediction'))} AS j FROM long WHERE label <> 4 AND abs(prediction - 4) > 0.5",
    "pos": _POS, "x": """SELECT narrow.system, a.p AS i, b.p AS j FROM narrow JOIN pos a ON narrow.system = a.system AND narrow.i = a.k
    JOIN pos b ON narrow.system = b.system AND narrow.j = b.k"""}) + f"""
SELECT system, CAST(COUNT(*) AS BIGINT) AS n,
       {r("1.0 - COUNT(*) * sum((i - j) * (i - j)) / (COUNT(*) * sum(i * i) + COUNT(*) * sum(j * j) - 2.0 * sum(i) * sum(j))")} AS qwk_observed
FROM x GROUP BY system""")
def q_leaderboard_observed_qwk(spark, sf_dir):
    """The observed-rank kappa for each system of a board in one aggregation, over rows in which one rating never occurs."""
    long = E.long_predictions(X.scored(spark, sf_dir), SCORED_SYSTEMS, row_id=None).where("label <> 4 AND abs(prediction - 4) > 0.5")
    return rounded(E.observed_kappa(long))
