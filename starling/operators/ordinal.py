"""CORAL algebra as Column / DataFrame operators.

The CORAL head is one shared projection ``w . x`` plus K-1 free biases; the
loss is the mean binary cross-entropy with logits over rows x thresholds with
targets ``1[rank > k]``. Everything is a per-row expression followed by a
plain aggregate, so it partial-aggregates and scales with the row count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from starling.domain import VALID_RATINGS

# Fixed tolerance that must equal the reference for right results.
MONOTONE_TOL = 1e-6
# End of fixed values.

#: Groups whose sums a pooling task holds at once.
MOST_GROUPS = 4096


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def dot(features: Column | str, weights: Sequence[float]) -> Column:
    """``features . weights`` accumulated left to right (features cast to double)."""
    f = _c(features)
    total = None
    for i, w in enumerate(weights):
        term = f.getItem(i).cast("double") * F.lit(float(w))
        total = term if total is None else total + term
    return total


def coral_logits(features: Column | str, weights: Sequence[float], biases: Sequence[float]) -> Column:
    """Cumulative logits ``w . x + b_k`` for every threshold k."""
    base = dot(features, weights)
    return F.array(*[base + F.lit(float(b)) for b in biases])


def coral_targets(rank: Column | str, n_thresholds: int = len(VALID_RATINGS) - 1) -> Column:
    """``array(rank > 0, rank > 1, ...)`` as 0/1 longs."""
    rk = _c(rank)
    return F.array(*[F.when(rk > k, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
                     for k in range(n_thresholds)])


def bce_with_logits(x: Column, t: Column) -> Column:
    """Numerically stable ``max(x,0) - x*t + log1p(exp(-|x|))``."""
    return F.greatest(x, F.lit(0.0)) - x * t.cast("double") + F.log1p(F.exp(-F.abs(x)))


def coral_loss(df: DataFrame, logits: str = "cumulative_logits", rank: str = "rank",
               n_thresholds: int = len(VALID_RATINGS) - 1) -> DataFrame:
    """Mean BCE over rows x thresholds (one aggregate; no explode needed)."""
    x = F.col(logits)
    row_sum = None
    for k in range(n_thresholds):
        term = bce_with_logits(x.getItem(k).cast("double"),
                               F.when(F.col(rank) > k, F.lit(1)).otherwise(F.lit(0)))
        row_sum = term if row_sum is None else row_sum + term
    return df.agg(
        (F.sum(row_sum) / (F.count(F.lit(1)) * F.lit(n_thresholds))).alias("loss"),
        F.count(F.lit(1)).alias("n"),
    )


def is_monotone(values: Column | str, width: int, tol: float = MONOTONE_TOL) -> Column:
    """Every successive difference ``v[i] - v[i-1] <= tol`` (non-increasing)."""
    v = _c(values)
    cond = F.lit(True)
    for i in range(1, width):
        cond = cond & ((v.getItem(i).cast("double") - v.getItem(i - 1).cast("double")) <= F.lit(tol))
    return cond


MONOTONE_NOTE = "each threshold is at most as likely to be passed as the one below it"
NOT_MONOTONE_NOTE = "some threshold is likelier to be passed than the one below it"


def bias_audit(models: DataFrame, biases: str = "biases", width: int = len(VALID_RATINGS) - 1) -> DataFrame:
    """Per model: monotone flag and a note, for a table of fitted bias vectors."""
    flag = is_monotone(biases, width)
    return models.select(
        "*",
        flag.alias("monotone_decreasing"),
        F.when(flag, F.lit(MONOTONE_NOTE)).otherwise(F.lit(NOT_MONOTONE_NOTE)).alias("note"),
    )


def masked_mean_pool(df: DataFrame, group: str, vector: str, mask: str) -> DataFrame:
    """Per group and dimension: ``sum(v * mask) / max(sum(mask), 1e-6)``.

    A task adds whole vectors, one running sum for each group it sees, and sends these: rows are never
    multiplied by their dimensions. A vector that is shorter than others adds to its own dimensions only, mask included.
    """
    kind = df.schema[group].dataType.simpleString()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            weight = batch.column("m").to_numpy(zero_copy_only=False)
            size = batch.column("v").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat, at = batch.column("v").flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
            for i, g in enumerate(batch.column("g").to_pylist()):
                n = size[i]
                held = sums.setdefault(g, [np.zeros(0), np.zeros(0)])
                if len(held[0]) < n:
                    sums[g] = held = [np.concatenate([h, np.zeros(n - len(h))]) for h in held]
                held[0][:n] += flat[at[i] : at[i] + n] * weight[i]
                held[1][:n] += weight[i]
            if len(sums) > MOST_GROUPS:  # what has been added so far goes on
                yield rows_of(sums)
                sums = {}
        if sums:
            yield rows_of(sums)

    def rows_of(sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), key_type), pa.array([list(range(len(s[0]))) for s in sums.values()], pa.list_(pa.int32())),
                                           pa.array([s[0] for s in sums.values()], pa.list_(pa.float64())),
                                           pa.array([s[1] for s in sums.values()], pa.list_(pa.float64()))], names=["g", "dim", "vm", "ms"])

    slim = df.select(F.col(group).alias("g"), F.coalesce(F.col(mask).cast("double"), F.lit(0.0)).alias("m"), F.col(vector).cast("array<double>").alias("v"))
    key_type = to_arrow_type(df.schema[group].dataType)
    partial = slim.mapInArrow(add, f"g {kind}, dim array<int>, vm array<double>, ms array<double>")
    each = partial.select("g", F.inline(F.arrays_zip("dim", "vm", "ms")))
    return each.groupBy(F.col("g").alias(group), "dim").agg((F.sum("vm") / F.greatest(F.sum("ms"), F.lit(1e-6))).alias("pooled"))
