"""Exact McNemar test on paired predictions.

The discordant counts are one aggregate over paired cells. The exact
two-sided binomial p-value at 0.5 is ``min(1, 2 * P[X <= min(b, c)])`` with
``X ~ Bin(b + c, 1/2)``, evaluated in log space (2^-7532 underflows a
double) from the two counts: the largest term without cancellation, then the
terms below it until they no longer count, some sqrt(b + c) of them at most.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starling.functions.stats import ln_half_binomial_tail

LN2 = math.log(2.0)


def discordant_counts(paired: DataFrame, label: str = "label", a: str = "pred_a", b: str = "pred_b",
                      weight: str | None = None) -> DataFrame:
    """b = a right & b wrong, c = a wrong & b right; equality is exact."""
    w = F.col(weight) if weight else F.lit(1)
    ra = F.col(a).cast("double") == F.col(label).cast("double")
    rb = F.col(b).cast("double") == F.col(label).cast("double")
    return paired.agg(
        F.coalesce(F.sum(F.when(ra & ~rb, w)), F.lit(0)).cast("bigint").alias("a_right_b_wrong"),
        F.coalesce(F.sum(F.when(~ra & rb, w)), F.lit(0)).cast("bigint").alias("a_wrong_b_right"),
    )


def exact_ln_p(spark: SparkSession, b: int, c: int) -> DataFrame:
    """One-row DataFrame ``(ln_p)``: log of the exact two-sided p-value."""
    n, m = int(b) + int(c), min(int(b), int(c))
    ln_p = 0.0 if 2 * m == n else min(0.0, LN2 + ln_half_binomial_tail(n, m))
    return spark.range(1).select(F.lit(ln_p).alias("ln_p"))


def mcnemar(paired: DataFrame, label: str = "label", a: str = "pred_a", b: str = "pred_b",
            weight: str | None = None, alpha: float = 0.05) -> DataFrame:
    """Counts, p-value (and its log), significance at ``alpha``.

    The two counts are fetched (two scalars); the p-value is a function of them.
    """
    counts = discordant_counts(paired, label, a, b, weight).first()
    bb, cc = int(counts["a_right_b_wrong"]), int(counts["a_wrong_b_right"])
    lp = exact_ln_p(paired.sparkSession, bb, cc)
    return lp.select(
        F.lit(bb).cast("bigint").alias("a_right_b_wrong"),
        F.lit(cc).cast("bigint").alias("a_wrong_b_right"),
        F.lit(bb + cc).cast("bigint").alias("n_discordant"),
        F.col("ln_p"),
        F.exp("ln_p").alias("p_value"),
        (F.exp("ln_p") < F.lit(alpha)).alias("significant"),
    )
