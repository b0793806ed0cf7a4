"""The ordered rating domain and the rank <-> rating mapping as Columns.

The domain is a short literal array, so every lookup compiles to a constant
expression inside whole-stage codegen; no join or broadcast is involved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference for right results.
VALID_RATINGS: tuple[int, ...] = (1, 2, 4, 5)
ALL_SCALE_VALUES: tuple[int, ...] = (1, 2, 3, 4, 5)
SEED = 42
TARGET_ORIGIN = "source_file"
# End of fixed values.


def domain_array(domain: Sequence[int] = VALID_RATINGS) -> Column:
    """``array(1, 2, 4, 5)`` as a literal long array."""
    return F.array(*[F.lit(int(v)).cast("bigint") for v in domain])


def rating_to_rank(rating: Column | str, domain: Sequence[int] = VALID_RATINGS,
                   strict: bool = True) -> Column:
    """Rating -> 0-based rank. An unknown rating raises (``strict``) or is null.

    Written as a CASE over the literal domain, which stays in codegen and is
    cheaper than ``array_position`` for a handful of values.
    """
    r = F.col(rating) if isinstance(rating, str) else rating
    expr = None
    for rank, value in enumerate(domain):
        cond = r == F.lit(value)
        expr = F.when(cond, F.lit(rank).cast("bigint")) if expr is None else expr.when(
            cond, F.lit(rank).cast("bigint"))
    if strict:
        return expr.when(r.isNull(), F.lit(None).cast("bigint")).otherwise(
            F.raise_error(F.concat(F.lit("rating without a rank: "), r.cast("string"))).cast("bigint"))
    return expr.otherwise(F.lit(None).cast("bigint"))


def rank_to_rating(rank: Column | str, domain: Sequence[int] = VALID_RATINGS) -> Column:
    """Rank -> rating, with the rank clipped to ``[0, K-1]`` first."""
    k = F.col(rank) if isinstance(rank, str) else rank
    clipped = F.least(F.greatest(k.cast("bigint"), F.lit(0)), F.lit(len(domain) - 1))
    expr = None
    for idx, value in enumerate(domain):
        cond = clipped == F.lit(idx)
        expr = F.when(cond, F.lit(value).cast("bigint")) if expr is None else expr.when(
            cond, F.lit(value).cast("bigint"))
    return expr
