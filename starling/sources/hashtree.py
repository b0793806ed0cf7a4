"""Hash trees over split datasets (B7, S6, S7): verified reads that name what was tampered with.

A leaf is a file of one split: an order-free digest of its rows' digests. Each level above joins up to
``FANOUT`` digests in file order, until a split has one root; the roots make the dataset's. A reader recomputes the trees of
the splits it wants only (partition-pruned) and compares from the root down.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starling.domain import VALID_RATINGS
from starling.sources import io as IO

FANOUT = 16
TREE = "split string, level int, node long, name string, n_rows long, digest string"


def leaves(spark: SparkSession, path: str, splits: Sequence[str] | None = None) -> DataFrame:
    """(split, name, n_rows, digest) of each file that holds rows; one pass with partial sums."""
    df = spark.read.parquet(path)
    if splits is not None:
        df = df.where(F.col("split").isin(*splits))
    columns = sorted(set(df.columns) - {"split"})
    # a null is no empty text, and no text runs into its neighbour
    cells = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    rows = df.select("split", F.col("_metadata.file_name").alias("name"), F.sha2(F.concat(*cells), 256).alias("_h"))
    found = rows.groupBy("split", "name").agg(*IO._fingerprint_aggs(F.col("_h")))
    return found.select(F.col("split").cast("string").alias("split"), "name", "n_rows", IO._fingerprint_col().alias("digest"))


def tree(found: DataFrame) -> DataFrame:
    """All nodes above and with the leaves, as ``TREE`` rows. Level 0 are the leaves, numbered by name; the highest
    level of a split has one node."""
    by_name = Window.partitionBy("split").orderBy("name")  # a row for each file
    level = found.withColumn("node", (F.row_number().over(by_name) - 1).cast("long")).withColumn("level", F.lit(0))
    nodes, number = level, 0
    most = level.agg(F.max("node")).first()[0]
    while most is not None and (most > 0 or number == 0):
        number += 1
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))  # `FANOUT` at most
        level = level.groupBy("split", F.floor(F.col("node") / FANOUT).cast("long").alias("parent")).agg(
            F.sum("n_rows").alias("n_rows"), F.sha2(F.array_join(F.transform(children, lambda c: c["digest"]), ":"), 256).alias("digest"))
        level = level.select("split", F.lit(None).cast("string").alias("name"), "n_rows", "digest", F.col("parent").alias("node"), F.lit(number).alias("level"))
        nodes, most = nodes.unionByName(level), most // FANOUT
    return nodes.select("split", "level", "node", "name", "n_rows", "digest")


def write_tree(spark: SparkSession, path: str, tree_path: str) -> None:
    tree(leaves(spark, path)).write.mode("overwrite").parquet(tree_path)


def differences(spark: SparkSession, path: str, tree_path: str, splits: Sequence[str] | None = None) -> DataFrame:
    """(split, level, node, name, reason) of the nodes where the files of ``splits`` (default: all) differ from the tree."""
    kept = spark.read.schema(TREE).parquet(tree_path)
    if splits is not None:
        kept = kept.where(F.col("split").isin(*splits))
    now = tree(leaves(spark, path, splits))
    both = kept.alias("k").join(now.alias("n"), F.expr("k.split = n.split AND k.level = n.level AND k.node = n.node"), "full_outer")
    reason = (F.when(F.col("n.digest").isNull(), F.lit("missing")).when(F.col("k.digest").isNull(), F.lit("added"))
              .when(F.col("k.digest") != F.col("n.digest"), F.lit("changed")))
    out = both.select(*[F.coalesce(f"k.{c}", f"n.{c}").alias(c) for c in ("split", "level", "node", "name")], reason.alias("reason"))
    return out.where("reason IS NOT NULL")


def read_verified(spark: SparkSession, path: str, tree_path: str, splits: Sequence[str] | None = None,
                  domain: Sequence[int] = VALID_RATINGS, named: int = 20) -> DataFrame:
    """``read_splits`` of the wanted splits after their trees have been compared with the kept one; refuses, naming up to
    ``named`` files, where they differ. Other splits are not read."""
    kept = {r["split"] for r in spark.read.schema(TREE).parquet(tree_path).select("split").distinct().collect()}
    unknown = set(splits or ()) - kept
    if unknown:
        raise RuntimeError(f"no such split in the manifest: {sorted(unknown)}")
    bad = differences(spark, path, tree_path, splits).where("level = 0").orderBy("split", "name").limit(named).collect()
    if bad:
        raise RuntimeError("splits do not match their manifest: " + ", ".join(f"{r['split']}/{r['name']} {r['reason']}" for r in bad))
    df = IO.read_splits(spark, path, domain)
    return df if splits is None else df.where(F.col("split").isin(*splits))
