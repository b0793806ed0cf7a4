"""Quality gates and cleaning.

Cleaning is one shuffle: group by the trimmed text with partial aggregation
``min(rating), max(rating), min(row_id), count``. A text with min <> max has
conflicting labels and all its rows are dropped; the rest keep their first
row. Partial aggregation makes a hot text cheap: each map task emits one
buffer row per distinct text, never the raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starling.domain import TARGET_ORIGIN, VALID_RATINGS, rating_to_rank
from starling.functions.text import unicode_trim
from starling.session import written


# ------------------------------------------------------------------ gates
def gate_report(df: DataFrame, expected_rows: Column | int | None = None, label: str = "rating",
                text: str = "review", origin: str = "target_origin",
                domain: Sequence[int] = VALID_RATINGS) -> DataFrame:
    """B1-B4 and B6 in one aggregate pass.

    Domain equality is checked without collecting the observed set: no row
    outside the domain and every domain value present. The observed set is
    reported as the present domain values plus a count of outside rows.
    """
    lab = F.col(label)
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(text).isNull()).alias("n_null_text"),
        F.count_if(~lab.isin(list(domain)) | lab.isNull()).alias("n_outside_domain"),
        F.coalesce(F.bool_and(F.col(origin) == F.lit(TARGET_ORIGIN)), F.lit(True)).alias("origin_ok"),
    ]
    for v in domain:
        aggs.append(F.count_if(lab == F.lit(v)).alias(f"_n{v}"))
    out = df.agg(*aggs)
    present = F.concat_ws(",", *[F.when(F.col(f"_n{v}") > 0, F.lit(str(v))) for v in domain])
    all_present = F.lit(True)
    for v in domain:
        all_present = all_present & (F.col(f"_n{v}") > 0)
    exp = F.lit(None) if expected_rows is None else (
        expected_rows if isinstance(expected_rows, Column) else F.lit(int(expected_rows)))
    return out.select(
        "n_rows",
        exp.cast("bigint").alias("expected_rows"),
        (F.col("n_rows") == exp if expected_rows is not None else F.lit(True)).alias("rows_ok"),
        "n_null_text",
        (F.col("n_null_text") == 0).alias("text_ok"),
        present.alias("ratings_present"),
        "n_outside_domain",
        ((F.col("n_outside_domain") == 0) & all_present).alias("domain_equal"),
        (F.col("n_outside_domain") == 0).alias("domain_subset"),
        "origin_ok",
    )


def enforce(report: DataFrame, checks: Sequence[str]) -> DataFrame:
    """Raise at run time with the first failing check name, else pass through."""
    first_fail = None
    for c in reversed(checks):
        first_fail = F.when(~F.col(c), F.lit(c)).otherwise(first_fail if first_fail is not None else F.lit(None))
    # a filter predicate is always evaluated (a dropped gate column would be pruned away)
    gate = F.when(first_fail.isNotNull(),
                  F.raise_error(F.concat(F.lit("quality gate failed: "), first_fail))
                  ).otherwise(F.lit(True)).cast("boolean")
    return report.where(gate)


# ------------------------------------------------------------------ projection
def trim_text(df: DataFrame, text: str = "review") -> DataFrame:
    return df.withColumn(text, unicode_trim(text))


def label_encode(df: DataFrame, label: str = "rating", out: str = "labels",
                 domain: Sequence[int] = VALID_RATINGS) -> DataFrame:
    """Rating -> class index; a rating with no class raises."""
    return df.withColumn(out, rating_to_rank(label, domain, strict=True))


def sample_n(df: DataFrame, n: int, seed: int, key: str = "row_id") -> DataFrame:
    """Seeded exact-n sample without replacement: the n smallest md5(seed:key).

    ``orderBy(..).limit(n)`` plans as a TakeOrderedAndProject: every task keeps
    its own top n and only those are merged, so the cost is one pass plus
    n rows per task; the limit is the feature here (an exact-n sample).
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.withColumn("_h", h).orderBy("_h", key).limit(int(n)).drop("_h")


# ------------------------------------------------------------------ cleaning
def text_digest(text: Column) -> Column:
    """256 bits that stand for a text wherever only its identity counts."""
    return F.unhex(F.sha2(text, 256))


def text_groups(raw: DataFrame, text: str = "review", label: str = "rating",
                row_id: str = "row_id") -> DataFrame:
    """Per trimmed text: lo/hi rating, first row id and row count (one shuffle)."""
    t = raw.select(F.col(row_id), unicode_trim(text).alias("review"), F.col(label).alias("rating"))
    return t.groupBy("review").agg(
        F.min("rating").alias("lo"), F.max("rating").alias("hi"),
        F.min(row_id).alias("row_id"), F.count(F.lit(1)).alias("n"))


def clean_reviews(raw: DataFrame, text: str = "review", label: str = "rating",
                  row_id: str = "row_id") -> DataFrame:
    """Trim, drop blanks, drop conflicting texts, keep the first row per text."""
    g = text_groups(raw, text, label, row_id)
    return g.where((F.length("review") > 0) & (F.col("lo") == F.col("hi"))).select(
        "row_id", "review", F.col("lo").alias("rating"), F.lit(TARGET_ORIGIN).alias("target_origin"))


def _verdicts(raw: DataFrame, text: str, label: str) -> DataFrame:
    """Per digest of a trimmed text: lo/hi rating and row count. Texts stay where they are."""
    t = raw.select(text_digest(unicode_trim(text)).alias("digest"), F.col(label).alias("rating"))
    return t.groupBy("digest").agg(F.min("rating").alias("lo"), F.max("rating").alias("hi"), F.count(F.lit(1)).alias("n"))


def conflict_removal(raw: DataFrame, text: str = "review", label: str = "rating",
                     row_id: str = "row_id") -> DataFrame:
    """All rows whose (trimmed, non-blank) text has a single rating; no dedupe.

    Texts with several ratings are told by digest and written, so their size is known before the
    rows are joined against them: few are broadcast, and no text moves. A null rating among others is no conflict, as is
    a text without any rating, which goes.
    """
    t = raw.select(F.col(row_id).alias("row_id"), unicode_trim(text).alias("review"),
                   F.col(label).alias("rating"))
    t = t.where(F.length("review") > 0).withColumn("_digest", text_digest(F.col("review")))
    mixed = written(_verdicts(raw, text, label).where("digest IS NOT NULL AND NOT coalesce(lo = hi, false)").select(F.col("digest").alias("_digest")), "conflicts")
    return t.join(mixed, "_digest", "left_anti").drop("_digest")


def clean_summary(raw: DataFrame, text: str = "review", label: str = "rating",
                  row_id: str = "row_id") -> DataFrame:
    """Raw, blank, conflicting rows/texts, duplicate rows and kept rows, from digests alone."""
    g = _verdicts(raw, text, label)
    blank = F.col("digest") == text_digest(F.lit(""))
    conflict = ~blank & (F.col("lo") != F.col("hi"))
    keep = ~blank & (F.col("lo") == F.col("hi"))
    return g.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw_rows"),
        F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("blank_rows"),
        F.coalesce(F.sum(F.when(conflict, F.col("n"))), F.lit(0)).alias("conflicting_rows"),
        F.count_if(conflict).alias("conflicting_texts"),
        F.coalesce(F.sum(F.when(keep, F.col("n") - 1)), F.lit(0)).alias("duplicate_rows"),
        F.count_if(keep).alias("kept_rows"),
    )
