"""Rating metrics as aggregate Columns over ``(label, prediction, weight)``.

A metric is a function ``(y, p, w) -> Column`` that returns an aggregate
expression. ``w`` is a row weight (a cell count after pre-aggregation, or 1).
Because every metric is a plain sum-style aggregate, Spark runs it as a
partial (map-side) + final aggregation: only one buffer row per group and
partition crosses the shuffle, so skewed systems or labels cost nothing extra.

A ``SumMetric`` says which row terms it sums and how the sums combine. Resampling needs no
more than that: weights are multiplied into the terms where the rows are, and only sums travel.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from starling.domain import VALID_RATINGS, rating_to_rank
from starling.functions.decode import nearest_rating

Metric = Callable[[Column, Column, Column], Column]


@dataclass(frozen=True)
class SumMetric:
    """``combine(weighted sums of terms(y, p), sum of weights)``; called as a metric, an aggregate Column."""

    terms: Callable[[Column, Column], list[Column]]
    combine: Callable[[Sequence[Column], Column], Column]

    def __call__(self, y, p, w=None) -> Column:
        w = _w(w)
        return self.combine([F.sum(w * t) for t in self.terms(_c(y), _c(p))], F.sum(w))

# Fixed values that must equal the reference for right results
# (numpy.isclose defaults: atol, rtol).
ISCLOSE_ATOL = 1e-8
ISCLOSE_RTOL = 1e-5
# End of fixed values.


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _w(w: Column | str | None) -> Column:
    return F.lit(1).cast("bigint") if w is None else _c(w)


def _mean(term: Callable[[Column, Column], Column]) -> SumMetric:
    return SumMetric(lambda y, p: [term(y, p)], lambda sums, n: sums[0] / n)


def error(y: Column, p: Column) -> Column:
    return p.cast("double") - y.cast("double")


def is_exact(y: Column | str, p: Column | str) -> Column:
    """numpy ``isclose(p, y)``: ``|p - y| <= atol + rtol * |y|``."""
    y, p = _c(y), _c(p)
    return F.abs(error(y, p)) <= F.lit(ISCLOSE_ATOL) + F.lit(ISCLOSE_RTOL) * F.abs(y.cast("double"))


def _flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


mae = _mean(lambda y, p: F.abs(error(y, p)))
rmse = SumMetric(lambda y, p: [error(y, p) * error(y, p)], lambda sums, n: F.sqrt(sums[0] / n))
exact = _mean(lambda y, p: _flag(is_exact(y, p)))
within_one = _mean(lambda y, p: _flag(F.abs(error(y, p)) <= F.lit(1.0)))


def polarity_at(cut: float = 4.0) -> SumMetric:
    """Share of rows whose prediction is on the same side of the 2/4 gap."""
    return _mean(lambda y, p: _flag((p.cast("double") >= F.lit(cut)) == (y.cast("double") >= F.lit(cut))))


polarity = polarity_at()


def qwk_from_parts(n, sd, si, sj, sii, sjj) -> Column:
    """``1 - n*sd / (n*sii + n*sjj - 2*si*sj)``; 0/0 (no spread at all) -> NULL."""
    den = n * sii + n * sjj - F.lit(2.0) * si * sj
    return F.when(den == 0, F.lit(None).cast("double")).otherwise(F.lit(1.0) - n * sd / den)


def qwk_over(domain: Sequence[int] = VALID_RATINGS) -> SumMetric:
    """Quadratic weighted kappa on ranks 0..K-1, prediction snapped to the domain.

    Single-pass algebra: with i the true rank and j the predicted rank,
    kappa = 1 - n*sum((i-j)^2) / (n*sum(i^2) + n*sum(j^2) - 2*sum(i)*sum(j)),
    which is the weighted-confusion definition expanded, so no K x K matrix
    is materialised.
    """

    def terms(y: Column, p: Column) -> list[Column]:
        i = rating_to_rank(y, domain).cast("double")
        j = rating_to_rank(nearest_rating(p, domain), domain).cast("double")
        return [(i - j) * (i - j), i, j, i * i, j * j]

    return SumMetric(terms, lambda sums, n: qwk_from_parts(n.cast("double"), *sums))


qwk = qwk_over()


METRICS: dict[str, Metric] = {
    "mae": mae,
    "rmse": rmse,
    "exact_accuracy": exact,
    "within_one_accuracy": within_one,
}


def rating_metrics(y="label", p="prediction", w=None, with_qwk: bool = False,
                   with_polarity: bool = False) -> list[Column]:
    """The reference's metric record as a list of aliased aggregate Columns."""
    cols = [fn(_c(y), _c(p), w).alias(name) for name, fn in METRICS.items()]
    if with_polarity:
        cols.append(polarity(y, p, w).alias("polarity_accuracy"))
    if with_qwk:
        cols.append(qwk(y, p, w).alias("qwk"))
    return cols


def qwk_observed(df, y: str = "label", p: str = "prediction", w: str | None = None,
                 domain: Sequence[int] = VALID_RATINGS):
    """QWK with weights from the positions of the *observed* ranks only (a
    rank absent from both sides compresses the scale), as a library kappa
    that builds its label list from the data does. One-row DataFrame.

    Which ranks occur is one small aggregate (K flags) entering as a scalar
    subquery; each rank is then replaced by its position among observed ranks.
    """
    i = rating_to_rank(_c(y), domain)
    j = rating_to_rank(nearest_rating(_c(p), domain), domain)
    seen = df.select(F.struct(*[F.max(F.when((i == k) | (j == k), F.lit(1)).otherwise(F.lit(0))).alias(f"k{k}")
                                for k in range(len(domain))])).scalar()

    def position(r):
        pos = F.lit(0)
        for k in range(len(domain)):
            pos = pos + F.when(F.lit(k) < r, seen.getField(f"k{k}")).otherwise(F.lit(0))
        return pos

    ranked = df.select(position(i).cast("double").alias("_i"), position(j).cast("double").alias("_j"),
                       _w(w).cast("double").alias("_w"))
    wi, ii, jj = F.col("_w"), F.col("_i"), F.col("_j")
    parts = [F.sum(wi), F.sum(wi * (ii - jj) * (ii - jj)), F.sum(wi * ii), F.sum(wi * jj),
             F.sum(wi * ii * ii), F.sum(wi * jj * jj)]
    return ranked.agg(qwk_from_parts(*parts).alias("qwk"))
