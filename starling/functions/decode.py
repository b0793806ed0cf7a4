"""Decoders and ordinal helpers as Column expressions.

Every function here returns a Column built from built-in expressions. For the
fixed, short domain the per-element work is unrolled into scalar CASE / least /
greatest expressions, which stay inside whole-stage codegen (array lambdas are
interpreted and cost more per row). Probability and logit arrays are expected
in domain order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from starling.domain import VALID_RATINGS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _elements(arr: Column | str, width: int) -> list[Column]:
    a = _col(arr)
    return [a.getItem(i).cast("double") for i in range(width)]


def _first_match(conds: Sequence[Column], values: Sequence[Column], default: Column) -> Column:
    expr = None
    for cond, value in zip(conds, values):
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(default)


def decode_argmax(probabilities: Column | str, domain: Sequence[int] = VALID_RATINGS) -> Column:
    """Rating of the highest probability; the first index wins a tie."""
    p = _elements(probabilities, len(domain))
    top = F.greatest(*p)
    ratings = [F.lit(int(r)).cast("bigint") for r in domain]
    return _first_match([x == top for x in p], ratings, F.lit(None).cast("bigint"))


def decode_expected(probabilities: Column | str, domain: Sequence[int] = VALID_RATINGS) -> Column:
    """Expected rating sum_i p_i * r_i, accumulated left to right in float64."""
    p = _elements(probabilities, len(domain))
    total = None
    for x, r in zip(p, domain):
        term = x * F.lit(float(r))
        total = term if total is None else total + term
    return total


def nearest_rating(value: Column | str, domain: Sequence[int] = VALID_RATINGS) -> Column:
    """Snap a value to the nearest domain element; the first element wins a tie."""
    v = _col(value).cast("double")
    dist = [F.abs(v - F.lit(float(r))) for r in domain]
    low = F.least(*dist)
    ratings = [F.lit(int(r)).cast("bigint") for r in domain]
    return _first_match([d == low for d in dist], ratings, F.lit(None).cast("bigint"))


def decode_rounded(probabilities: Column | str, domain: Sequence[int] = VALID_RATINGS) -> Column:
    """Expected value snapped to the nearest valid rating."""
    return nearest_rating(decode_expected(probabilities, domain), domain)


def decode_median(probabilities: Column | str, domain: Sequence[int] = VALID_RATINGS) -> Column:
    """Discrete median: ratings ascending, first cumulative probability >= 0.5.

    If no prefix reaches 0.5 (mass below one), the lowest rating is returned,
    as an argmax over an all-false mask does.
    """
    order = sorted(range(len(domain)), key=lambda i: domain[i])
    p = _elements(probabilities, len(domain))
    cumulative, conds, ratings = None, [], []
    for i in order:
        cumulative = p[i] if cumulative is None else cumulative + p[i]
        conds.append(cumulative >= F.lit(0.5))
        ratings.append(F.lit(int(domain[i])).cast("bigint"))
    return _first_match(conds, ratings, ratings[0])


def softmax(logits: Column | str, width: int) -> Column:
    """Max-shifted softmax of a fixed-width logit array -> array<double>."""
    x = _elements(logits, width)
    top = F.greatest(*x)
    e = [F.exp(v - top) for v in x]
    total = None
    for v in e:
        total = v if total is None else total + v
    return F.array(*[v / total for v in e])


def coral_decode(cumulative_logits: Column | str, width: int | None = None) -> Column:
    """CORAL rank = number of cumulative logits strictly above zero."""
    if width is None:
        return F.size(F.filter(_col(cumulative_logits), lambda x: x > 0)).cast("bigint")
    x = _elements(cumulative_logits, width)
    total = None
    for v in x:
        term = F.when(v > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        total = term if total is None else total + term
    return total


def ce_term(probabilities: Column | str, rank: Column | str) -> Column:
    """-ln p[true rank], floored at 1e-300 so a zero probability stays finite."""
    p = F.get(_col(probabilities), _col(rank).cast("int")).cast("double")
    return -F.log(F.greatest(p, F.lit(1e-300)))


def probability_map(probabilities: Column | str, domain: Sequence[int] = VALID_RATINGS) -> Column:
    """map<bigint,double> rating -> probability."""
    keys = F.array(*[F.lit(int(r)).cast("bigint") for r in domain])
    return F.map_from_arrays(keys, _col(probabilities).cast("array<double>"))


DECODERS = {
    "argmax": decode_argmax,
    "expected": decode_expected,
    "expected_rounded": decode_rounded,
    "median": decode_median,
}


def decode(probabilities: Column | str, decoder: str,
           domain: Sequence[int] = VALID_RATINGS) -> Column:
    if decoder not in DECODERS:
        raise ValueError(f"unknown decoder {decoder!r}; expected one of {sorted(DECODERS)}")
    return DECODERS[decoder](probabilities, domain)
