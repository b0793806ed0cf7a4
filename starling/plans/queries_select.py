"""Registered queries: training logs, selection, early stopping, results payload."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from starling.operators import evaluate as E
from starling.operators import select as SL
from starling.plans import fixtures as X
from starling.plans.catalog import query, r, rounded
from starling.plans.oracle import with_views
from starling.plans.queries_eval import SCORED_SYSTEMS, _LONG_SCORED_SQL, _board_sql, _metric_sql
from starling.session import scratch_path
from starling.sources import io as IO

STEPS_PER_EPOCH = 100


def _epochs(spark, sf_dir):
    return SL.number_epochs(X.runs(spark, sf_dir))


def write_training_logs(history, path: str) -> None:
    """One JSON document per (run, checkpoint), shaped like a trainer state:
    a training-loss entry and an evaluation entry for that epoch."""
    step = F.col("epoch") * STEPS_PER_EPOCH
    ep = F.col("epoch").cast("double")
    train_entry = F.create_map(F.lit("epoch"), ep, F.lit("loss"), F.col("eval_mae") * 1.5,
                               F.lit("step"), step.cast("double"))
    eval_entry = F.create_map(F.lit("epoch"), ep, F.lit("eval_mae"), F.col("eval_mae"),
                              F.lit("eval_rmse"), F.col("eval_mae") * 2.0, F.lit("step"), step.cast("double"))
    docs = history.select(
        "run", F.concat(F.lit("checkpoint-"), step.cast("string")).alias("checkpoint"),
        F.array(train_entry, eval_entry).alias("log_history"),
        F.lit(None).cast("double").alias("best_metric"),
        F.lit(None).cast("string").alias("best_model_checkpoint"))
    docs.write.mode("overwrite").json(path)


def _logs(spark, sf_dir):
    path = scratch_path(spark, "trainer_state")
    write_training_logs(_epochs(spark, sf_dir), path)
    return IO.read_json(spark, path, IO.LOG_SCHEMA)


# ------------------------------------------------------------------ S8
@query("validation_history", sql=with_views("runs") + f"""
SELECT run, epoch, {r('eval_mae')} AS eval_mae, {r('eval_mae * 2.0')} AS eval_rmse, CAST(3 AS BIGINT) AS n_keys
FROM runs""")
def q_validation_history(spark, sf_dir):
    vh = IO.validation_history(_logs(spark, sf_dir))
    m = F.col("metrics")
    return rounded(vh.select("run", m["epoch"].cast("bigint").alias("epoch"), m["eval_mae"].alias("eval_mae"),
                             m["eval_rmse"].alias("eval_rmse"), F.size(m).cast("bigint").alias("n_keys")))


# ------------------------------------------------------------------ S9
@query("latest_checkpoint", sql=with_views("runs") + f"""
SELECT run, 'checkpoint-' || CAST(max(epoch) * {STEPS_PER_EPOCH} AS VARCHAR) AS latest_checkpoint,
       CAST(max(epoch) * {STEPS_PER_EPOCH} AS BIGINT) AS latest_step, CAST(COUNT(*) AS BIGINT) AS n_checkpoints
FROM runs GROUP BY run""")
def q_latest_checkpoint(spark, sf_dir):
    return IO.latest_checkpoint(_logs(spark, sf_dir))


# ------------------------------------------------------------------ S8 + S9: one training record for each run
SEGMENT_EPOCHS = 1000  # epochs whose entries stand in one document


def _cumulative_logs(spark, sf_dir, checkpoints: int = 4):
    """Logs as trainers write them: each of a run's checkpoints holds all entries so far, in order, training losses between them.
    A checkpoint's log is written in segments, so that no document grows with its run."""
    h = _epochs(spark, sf_dir).select("run", "epoch", "eval_mae")
    last = h.groupBy("run").agg(F.max("epoch").alias("last"))
    at = last.select("run", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(checkpoints)), lambda k: F.ceil(F.col("last") * k / checkpoints)))).alias("at"))
    seen = h.join(F.broadcast(at), "run").where("epoch <= at")  # a row for each checkpoint of a run
    heads = seen.groupBy("run", "at").agg(F.min_by("epoch", F.struct("eval_mae", "epoch")).alias("best"), F.min("eval_mae").alias("best_metric"))
    docs = seen.groupBy("run", "at", F.expr(f"(epoch - 1) div {SEGMENT_EPOCHS}").alias("segment")).agg(
        F.array_sort(F.collect_list(F.struct("epoch", "eval_mae"))).alias("e")).join(F.broadcast(heads), ["run", "at"])

    def entries(x):
        ep = x["epoch"].cast("double")
        return F.array(F.create_map(F.lit("epoch"), ep, F.lit("loss"), x["eval_mae"] * 1.5),
                       F.create_map(F.lit("epoch"), ep, F.lit("eval_mae"), x["eval_mae"], F.lit("step"), ep * STEPS_PER_EPOCH))

    name = lambda c: F.concat(F.lit("checkpoint-"), (F.col(c) * STEPS_PER_EPOCH).cast("string"))
    path = scratch_path(spark, "cumulative_logs")
    docs.select("run", name("at").alias("checkpoint"), F.flatten(F.transform("e", entries)).alias("log_history"), "best_metric",
                name("best").alias("best_model_checkpoint"), "segment").write.json(path)
    return IO.read_json(spark, path, IO.SEGMENTED_LOG_SCHEMA)


@query("training_metadata", sql=with_views("runs") + f"""
SELECT run, 'checkpoint-' || CAST(max(epoch) * {STEPS_PER_EPOCH} AS VARCHAR) AS latest_checkpoint, {r('min(eval_mae)')} AS best_metric,
       'checkpoint-' || CAST(arg_min(epoch, {{'m': eval_mae, 'e': epoch}}) * {STEPS_PER_EPOCH} AS VARCHAR) AS best_model_checkpoint,
       CAST(COUNT(*) AS BIGINT) AS n_entries, {r('sum(eval_mae * epoch) / 1000000')} AS weighted, CAST(2 AS BIGINT) AS n_keys
FROM runs GROUP BY run
UNION ALL SELECT 'never trained', NULL, NULL, NULL, NULL, NULL, NULL""")
def q_training_metadata(spark, sf_dir):
    """Records from cumulative logs: the newest checkpoint's entries once each, and a record of nulls for a run without any."""
    logs = _cumulative_logs(spark, sf_dir)
    names = [x["run"] for x in logs.select("run").distinct().collect()]  # the runs, a few
    m = IO.training_metadata(logs, [*names, "never trained"], whole=False)
    weighted = F.aggregate(F.transform("history", lambda e: e["eval_mae"] * e["epoch"]), F.lit(0.0), lambda a, x: a + x) / 1000000
    n = F.when(F.col("history").isNotNull(), F.size("history").cast("bigint"))
    keys = F.when(F.col("history").isNotNull(), F.array_max(F.transform("history", lambda e: F.size(e))).cast("bigint"))
    parts = m.select("run", "latest_checkpoint", "best_metric", "best_model_checkpoint", n.alias("n"), weighted.alias("w"), keys.alias("k"))
    m = parts.groupBy("run", "latest_checkpoint", "best_metric", "best_model_checkpoint").agg(
        F.sum("n").alias("n_entries"), F.when(F.count_if(F.col("w").isNull()) == 0, F.sum("w")).alias("weighted"), F.max("k").alias("n_keys"))
    return rounded(m)


# ------------------------------------------------------------------ L6
@query("candidate_metrics", sql=with_views("long") + f"""
SELECT system AS candidate, CAST(COUNT(*) AS BIGINT) AS n,
       {', '.join(f"{r(v)} AS {k}" for k, v in _metric_sql('label', 'prediction').items() if k != 'polarity_accuracy')}
FROM long GROUP BY system""")
def q_candidate_metrics(spark, sf_dir):
    s = X.scored(spark, sf_dir)
    cells = E.cells(E.long_predictions(s, SCORED_SYSTEMS, row_id=None)).withColumnRenamed("system", "candidate")
    return rounded(SL.candidate_metrics(cells))


# ------------------------------------------------------------------ L7
@query("best_candidate", sql=with_views("runs") + f"""
SELECT run, CAST(epoch AS BIGINT) AS best_epoch, {r('eval_mae')} AS best_eval_mae, n_candidates FROM (
  SELECT run, epoch, eval_mae, CAST(COUNT(*) OVER (PARTITION BY run) AS BIGINT) AS n_candidates,
         row_number() OVER (PARTITION BY run ORDER BY eval_mae, epoch) AS k
  FROM runs WHERE eval_mae IS NOT NULL) WHERE k = 1""")
def q_best_candidate(spark, sf_dir):
    return rounded(SL.best_candidate(_epochs(spark, sf_dir)))


# ------------------------------------------------------------------ L8
@query("early_stop", sql=with_views("runs", extra={
    "pm": """SELECT *, min(eval_mae) OVER (PARTITION BY run ORDER BY epoch
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_min FROM runs""",
    "st": """SELECT run, coalesce(min(epoch) FILTER (WHERE prior_min IS NOT NULL AND eval_mae >= prior_min), max(epoch)) AS stop_epoch,
                    min(epoch) FILTER (WHERE prior_min IS NOT NULL AND eval_mae >= prior_min) IS NOT NULL AS stopped_early
             FROM pm GROUP BY run""",
    "bk": """SELECT r.run, r.epoch, r.eval_mae, row_number() OVER (PARTITION BY r.run ORDER BY r.eval_mae, r.epoch) AS k
             FROM runs r JOIN st ON r.run = st.run WHERE r.epoch <= st.stop_epoch"""}) + f"""
SELECT st.run, CAST(st.stop_epoch AS BIGINT) AS stop_epoch, st.stopped_early,
       CAST(bk.epoch AS BIGINT) AS best_epoch, {r('bk.eval_mae')} AS best_eval_mae
FROM st JOIN bk ON st.run = bk.run AND bk.k = 1""")
def q_early_stop(spark, sf_dir):
    return rounded(SL.early_stop(_epochs(spark, sf_dir)))


# ------------------------------------------------------------------ S10
PAYLOAD_META = {"task": "rating prediction", "ratings": "1,2,4,5", "source": "scored"}
PAYLOAD_SCHEMA = T.StructType([
    T.StructField("task", T.StringType()), T.StructField("ratings", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("system", T.StringType()),
    T.StructField("test_results", T.StructType([
        T.StructField("n", T.LongType()), T.StructField("mae", T.DoubleType()),
        T.StructField("rmse", T.DoubleType()), T.StructField("exact_accuracy", T.DoubleType()),
        T.StructField("within_one_accuracy", T.DoubleType()), T.StructField("polarity_accuracy", T.DoubleType()),
        T.StructField("qwk", T.DoubleType())])),
])


@query("results_payload", sql=with_views("scored", extra={"long": _LONG_SCORED_SQL}) + _board_sql("long").replace(
    "SELECT system,", "SELECT 'rating prediction' AS task, '1,2,4,5' AS ratings, 'scored' AS source, system,"))
def q_results_payload(spark, sf_dir):
    """Board -> one JSON document per system (text sink) -> read back."""
    s = X.scored(spark, sf_dir)
    board = E.leaderboard([E.long_predictions(s, SCORED_SYSTEMS, row_id=None)])
    path = scratch_path(spark, "results")
    IO.write_text(IO.results_payload(board, PAYLOAD_META), "payload", path)
    back = spark.read.text(path).select(F.from_json("value", PAYLOAD_SCHEMA).alias("p"))
    t = F.col("p.test_results")
    return rounded(back.select(
        F.col("p.task").alias("task"), F.col("p.ratings").alias("ratings"), F.col("p.source").alias("source"),
        F.col("p.system").alias("system"), t["n"].alias("n"), t["mae"].alias("mae"), t["rmse"].alias("rmse"),
        t["exact_accuracy"].alias("exact_accuracy"), t["within_one_accuracy"].alias("within_one_accuracy"),
        t["polarity_accuracy"].alias("polarity_accuracy"), t["qwk"].alias("qwk")))
