"""Rows by their place in the files, and tables aligned by it (J1 without a key).

A file split is read by one task, in order, so a row's place is the rows in the splits before its own (by file name, then
offset) plus its number within the split. Counts and prefix sums over splits are all that is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_position(df: DataFrame, name: str = "position") -> DataFrame:
    """Adds the 0-based place of each row over all files of ``df``, a DataFrame as read from files (no filter or
    shuffle yet; columns may be selected afterwards). Files follow each other by path."""
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row")]
    rows = df.select("*", *place)
    splits = df.select(*place).groupBy("_file", "_start").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return rows.join(splits.drop("_n"), ["_file", "_start"]).select(
        *df.columns, (F.col("_before") + F.col("_row") - F.col("_first")).alias(name))


def align_by_position(left: DataFrame, right: DataFrame, name: str = "position") -> DataFrame:
    """Two tables read from files, row by row side by side. A row without a partner fails in the plan's own predicate, so
    tables of unequal length never align. Columns of ``right`` must have names of their own."""
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"both tables have columns {sorted(clash)}")
    a = with_position(left, name).withColumn("_left", F.lit(True))
    b = with_position(right, name).withColumn("_right", F.lit(True))
    both = a.join(b, name, "full_outer")
    whole = F.when(F.col("_left") & F.col("_right"), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("no partner for the row at "), F.col(name).cast("string"))).cast("boolean"))
    return both.where(whole).select(name, *left.columns, *right.columns)
