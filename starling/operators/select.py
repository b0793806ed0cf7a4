"""Candidate metrics, best-candidate selection and early stopping.

Selection is by minimum validation MAE with the earliest candidate winning a
tie (``min_by`` over a (metric, order) struct, so the result does not depend
on partition order). Early stopping with patience 1 stops after the first
epoch whose metric does not improve on the best of all earlier epochs; the
running minimum goes over sampled ranges with carries, so one long run, or one far
outlier in time, is not a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.functions import metrics as M
from starling.operators.ordered import running


def number_epochs(events: DataFrame, run: str = "run", order: Sequence[str] = ("ts", "event_id"), name: str = "epoch") -> DataFrame:
    """Epoch = 1-based position of each evaluation within its run."""
    return running(events, [run], order, name)


def candidate_metrics(cells: DataFrame, by: Sequence[str] = ("candidate",)) -> DataFrame:
    """The per-evaluation metric record (MAE, RMSE, exact, within-one)."""
    return cells.groupBy(*by).agg(F.sum("n").alias("n"), *M.rating_metrics("label", "prediction", "n"))


def best_candidate(history: DataFrame, by: Sequence[str] = ("run",), order: str = "epoch",
                   metric: str = "eval_mae") -> DataFrame:
    """Per group: the candidate with the smallest metric, earliest on a tie."""
    key = F.struct(F.col(metric), F.col(order))
    return history.where(F.col(metric).isNotNull()).groupBy(*by).agg(
        F.min_by(F.col(order), key).alias(f"best_{order}"),
        F.min(metric).alias(f"best_{metric}"),
        F.count(F.lit(1)).alias("n_candidates"))


def early_stop(history: DataFrame, by: Sequence[str] = ("run",), order: str | Sequence[str] = "epoch",
               metric: str = "eval_mae", partitions: int | None = None) -> DataFrame:
    """Patience-1 early stopping, then the best kept epoch.

    ``order`` names the epoch column, or the columns that order evaluations without one; epochs are then positions.
    At the first epoch that does not improve, the least metric before it *is* the best kept epoch (earliest on a
    tie); without a stall it is the least of all, so one grouping finishes and nothing is joined back."""
    named = isinstance(order, str)
    known = history.where(F.col(metric).isNotNull())
    seen = running(known, by, [order] if named else order, "_at", metric, partitions)
    prior, own = F.col("prior"), F.struct(F.col(metric).cast("double").alias("value"), F.col("_at"))
    stall = prior.isNotNull() & (F.col(metric) >= prior["value"])
    at = F.struct(F.col("_at"), (F.col(order) if named else F.col("_at")).alias("e"))
    agg = seen.groupBy(*by).agg(F.min(F.when(stall, F.struct(at.alias("at"), prior.alias("p")))).alias("_stall"),
                                F.max(F.struct(at.alias("at"), F.least("prior", own).alias("p"))).alias("_last"))
    stopped = agg.select(*by, F.coalesce("_stall.at.e", "_last.at.e").alias("stop_epoch"), F.col("_stall").isNotNull().alias("stopped_early"),
                         F.coalesce("_stall.p", "_last.p").alias("_best"))
    if not named:
        return stopped.select(*by, "stop_epoch", "stopped_early", F.col("_best._at").alias("best_epoch"), F.col("_best.value").alias("best_eval_mae"))
    # the best epoch's own number, where epochs are not positions
    places = seen.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_at"), F.col(order).alias("best_epoch"))
    same = F.col("_best._at") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return stopped.join(places, same).select(*by, "stop_epoch", "stopped_early", "best_epoch", F.col("_best.value").alias("best_eval_mae"))
