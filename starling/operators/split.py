"""Deterministic stratified train / validation / test split.

Sizes follow a two-stage rule per class: the held-out side of stage 1 gets
``ceil(test_size * N)`` rows in total, split over classes by largest
remainder (lower class wins a tie); stage 2 splits the held-out rows into
test and validation the same way. All quota arithmetic is exact integer
arithmetic on a K-row table (K = number of classes, bounded by the domain).

Row choice: rows of a class stand in the order of ``md5(seed:text)`` (copies of a
text by their place in the table); the first ``test`` rows go to test, the next
``validation`` rows to validation, the rest to train. No row is ranked or moved for that:
the keys at the two cuts of each class are found by distributed selection
(``operators.selection``), and a row's split follows from comparing its key with
them. Texts take no part in any shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starling.domain import SEED
from starling.operators.bloom import shared_rows
from starling.operators.clean import text_digest
from starling.operators.selection import prefix_counts, select_keys
from starling.session import written

SPLITS = ("train", "validation", "test")


def _largest_remainder(counts: DataFrame, n_col: str, share: Fraction, out: str, label: str) -> DataFrame:
    """Add ``out`` = per-class held-out quota for ``share`` of ``n_col`` rows."""
    p, q = share.numerator, share.denominator
    whole = Window.partitionBy()
    c = counts.select(
        "*",
        F.expr(f"CAST(`{n_col}` * {p} div {q} AS BIGINT)").alias("_floor"),
        F.expr(f"CAST(`{n_col}` * {p} % {q} AS BIGINT)").alias("_rem"),
        F.sum(n_col).over(whole).alias("_all"),
    )
    c = c.select("*", F.expr(f"CAST((_all * {p} + {q - 1}) div {q} AS BIGINT)").alias("_total"))
    c = c.select("*", (F.col("_total") - F.sum("_floor").over(whole)).alias("_left"))
    order = Window.partitionBy().orderBy(F.col("_rem").desc(), F.col(label).asc())
    c = c.select("*", F.row_number().over(order).alias("_pos"))
    extra = F.when((F.col("_pos") <= F.col("_left")) & (F.col("_rem") > 0), F.lit(1)).otherwise(F.lit(0))
    return c.select(*counts.columns, (F.col("_floor") + extra).cast("bigint").alias(out))


def split_allocation(class_counts: DataFrame, label: str = "rating", n_col: str = "n",
                     test_size: float = 0.20, test_share_of_holdout: float = 0.50) -> DataFrame:
    """K-row table ``(label, n, n_holdout, n_test, n_validation, n_train)``."""
    s1 = Fraction(str(test_size))
    s2 = Fraction(str(test_share_of_holdout))
    a = _largest_remainder(class_counts, n_col, s1, "n_holdout", label)
    b = _largest_remainder(a, "n_holdout", s2, "n_test", label)
    return b.select(label, n_col, "n_holdout", "n_test",
                    (F.col("n_holdout") - F.col("n_test")).alias("n_validation"),
                    (F.col(n_col) - F.col("n_holdout")).alias("n_train"))


def holdout_sizes(counts: Mapping[object, int], test_size: float = 0.20, test_share_of_holdout: float = 0.50) -> dict[object, tuple[int, int]]:
    """``split_allocation`` of counts that are at hand: class -> (test, holdout)."""

    def quotas(sizes: dict[object, int], share: Fraction) -> dict[object, int]:
        exact = {g: n * share for g, n in sizes.items()}
        out = {g: int(q) for g, q in exact.items()}
        spare = -int(-sum(sizes.values()) * share // 1) - sum(out.values())
        by_rest = sorted((g for g in exact if exact[g] > out[g]), key=lambda g: (out[g] - exact[g], g is not None, g or 0))
        for g in by_rest[:spare]:
            out[g] += 1
        return out

    held = quotas(dict(counts), Fraction(str(test_size)))
    test = quotas(held, Fraction(str(test_share_of_holdout)))
    return {g: (test[g], held[g]) for g in counts}


def order_key(text: str = "review", seed: int = SEED):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(text)))


def stratified_split(df: DataFrame, label: str = "rating", text: str = "review",
                     seed: int = SEED, test_size: float = 0.20,
                     test_share_of_holdout: float = 0.50, bucket_digits: int = 4) -> DataFrame:
    """Add a ``split`` column with exact per-class sizes (see module doc).

    Plan: the input is written once with its keys to the shared scratch folder; counts by (class, key prefix), read
    from the key column alone, give the class sizes, hence the allocation, and the first step of the selection;
    each further step reads the keys again. The result is a narrow comparison with two keys for each class.
    Null labels are a class of their own.
    """
    place = F.lpad(F.lower(F.hex(F.monotonically_increasing_id())), 16, "0")
    keyed = written(df.withColumn("_key", F.concat(F.coalesce(order_key(text, seed), F.lit("")), place)), "split")
    keys = keyed.select(label, "_key")
    counts = prefix_counts(keys, label, "_key", bucket_digits)
    sizes = holdout_sizes({g: sum(n for _, n in found) for g, found in counts.items()}, test_size, test_share_of_holdout)
    bounds = select_keys(keys, label, "_key", sizes, bucket_digits, counts)
    split = F.lit("train")
    for group, (test, held) in bounds.items():  # a comparison for each class
        mine = F.when(F.col("_key") < test, F.lit("test")).when(F.col("_key") < held, F.lit("validation")).otherwise(F.lit("train"))
        split = F.when(F.col(label).eqNullSafe(F.lit(group)), mine).otherwise(split)
    return keyed.select(*df.columns, split.alias("split"))


def split_distribution(df: DataFrame, label: str = "rating") -> DataFrame:
    """Per split and class: count and share within the split."""
    c = df.groupBy("split", label).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("split"))
    return c.select("split", label, "n", share.alias("share"))


def leakage_report(df: DataFrame, text: str = "review", split: str = "split") -> DataFrame:
    """Pairwise disjointness of the split text sets.

    Bloom filters leave the rows whose text may stand in two splits (``operators.bloom``); only these are
    grouped, by their texts' digests, with three flags each. Then one global aggregate counts texts shared by
    each pair. ``disjoint`` is true when no text is in more than one split (also for empty input).
    """
    named = df.select(text_digest(F.col(text)).alias("_text"), F.col(split).cast("string").alias("split"))
    per_text = shared_rows(named, "_text", "split").groupBy("_text").agg(
        *[F.max(F.when(F.col("split") == s, F.lit(1)).otherwise(F.lit(0))).alias(f"in_{s}") for s in SPLITS])
    per_text = per_text.withColumn("n_splits", sum(F.col(f"in_{s}") for s in SPLITS))
    pairs = [("train", "validation"), ("train", "test"), ("validation", "test")]
    aggs = [F.count_if((F.col(f"in_{a}") == 1) & (F.col(f"in_{b}") == 1)).alias(f"shared_{a}_{b}")
            for a, b in pairs]
    aggs.append(F.count_if(F.col("n_splits") > 1).alias("leaking_texts"))
    out = per_text.agg(*aggs)
    return out.select("*", (F.col("leaking_texts") == 0).alias("disjoint"))
