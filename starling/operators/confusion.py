"""Confusion tables and per-class precision / recall / F1 (M1-M4).

All of these start from cells ``(by.., label, prediction, n)`` and run as
one aggregation of conditional sums per group followed by a narrow
``inline``; the class list is a short literal, never joined to the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.domain import VALID_RATINGS


def _sum_if(cond, n) -> F.Column:
    return F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("bigint")


def _per_group(cells: DataFrame, by: Sequence[str], aggs: list) -> DataFrame:
    return cells.groupBy(*by).agg(*aggs) if by else cells.agg(*aggs)


def confusion_long(cells: DataFrame, classes: Sequence[int] = VALID_RATINGS,
                   by: Sequence[str] = ()) -> DataFrame:
    """K x K counts per group; labels or predictions outside ``classes`` are
    skipped; empty cells are 0.

    One aggregation with K^2 conditional sums per group (partial + final, so a
    hot group costs one buffer row per task), then a narrow ``inline`` to K^2
    rows: no class grid, no distinct, no join.
    """
    y, p, n = F.col("label").cast("double"), F.col("prediction").cast("double"), F.col("n")
    ks = [int(c) for c in classes]
    aggs = [_sum_if((y == float(a)) & (p == float(b)), n).alias(f"_c{i}_{j}")
            for i, a in enumerate(ks) for j, b in enumerate(ks)]
    wide = _per_group(cells, by, aggs)
    entries = [F.struct(F.lit(a).cast("bigint").alias("label"), F.lit(b).cast("bigint").alias("prediction"),
                        F.col(f"_c{i}_{j}").alias("n"))
               for i, a in enumerate(ks) for j, b in enumerate(ks)]
    return wide.select(*by, F.inline(F.array(*entries)))


def confusion_wide(cells: DataFrame, classes: Sequence[int] = VALID_RATINGS,
                   by: Sequence[str] = ()) -> DataFrame:
    """One row per true class, one ``pred_<v>`` column per predicted class."""
    long = confusion_long(cells, classes, by)
    wide = long.groupBy(*by, "label").pivot("prediction", [int(c) for c in classes]).agg(F.sum("n"))
    return wide.select(*by, "label", *[F.coalesce(F.col(str(int(c))), F.lit(0)).cast("bigint")
                                       .alias(f"pred_{int(c)}") for c in classes])


def _pct_ratio(num, den):
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def per_class(cells: DataFrame, classes: Sequence[int] = VALID_RATINGS,
              by: Sequence[str] = ()) -> DataFrame:
    """TP, FP, FN, support, precision, recall, F1 per class; 0/0 -> 0.0.

    One aggregation of 4K conditional sums per group: TP (label = prediction
    = class), FP (prediction = class, any other label, including labels
    outside ``classes``), FN (label = class, any other prediction), support;
    then ``inline`` to K rows. Classes without rows appear with zeros.
    """
    y, p, n = F.col("label").cast("double"), F.col("prediction").cast("double"), F.col("n")
    ks = [int(c) for c in classes]
    aggs = []
    for i, k in enumerate(ks):
        kk = float(k)
        aggs += [_sum_if((y == kk) & (p == kk), n).alias(f"_tp{i}"),
                 _sum_if((p == kk) & (y != kk), n).alias(f"_fp{i}"),
                 _sum_if((y == kk) & (p != kk), n).alias(f"_fn{i}"),
                 _sum_if(y == kk, n).alias(f"_sup{i}")]
    wide = _per_group(cells, by, aggs)
    entries = [F.struct(F.lit(k).cast("bigint").alias("class"), F.col(f"_tp{i}").alias("tp"),
                        F.col(f"_fp{i}").alias("fp"), F.col(f"_fn{i}").alias("fn"),
                        F.col(f"_sup{i}").alias("support"))
               for i, k in enumerate(ks)]
    t = wide.select(*by, F.inline(F.array(*entries)))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision = _pct_ratio(tp, tp + fp)
    recall = _pct_ratio(tp, tp + fn)
    f1 = F.when(precision + recall == 0, F.lit(0.0)).otherwise(
        F.lit(2.0) * precision * recall / (precision + recall))
    return t.select("*", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))
