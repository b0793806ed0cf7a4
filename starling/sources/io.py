"""Readers and writers.

All writers go to a folder the caller names (on a cluster: under the shared
``spark.checkpoint.dir``); nothing is staged through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starling.domain import SEED, TARGET_ORIGIN, VALID_RATINGS
from starling.functions.text import PANDAS_NA_TOKENS, na_to_null

REVIEW_SCHEMA = T.StructType([
    T.StructField("rating", T.LongType(), True),
    T.StructField("review", T.StringType(), True),
])

# Fixed value that must equal the reference.
SPLIT_DESCRIPTION = "80/10/10 stratified after text deduplication"

SPLIT_COLUMNS = frozenset({"review", "rating", "target_origin"})


# ------------------------------------------------------------------ S1 TSV
def write_tsv(df: DataFrame, path: str) -> None:
    """Headerless TSV, RFC-4180 quoting (quote and escape are both ``"``),
    surrounding whitespace kept, so text survives a round trip exactly."""
    (df.write.mode("overwrite")
       .option("sep", "\t").option("quote", '"').option("escape", '"')
       .option("header", False)
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = REVIEW_SCHEMA,
             na_tokens: Sequence[str] = PANDAS_NA_TOKENS, multi_line: bool = True) -> DataFrame:
    """Headerless TSV with a declared schema; malformed rows fail the read.

    ``multi_line`` allows quoted fields to span lines, as pandas does; such a
    file is read by one task per file, so large sources should be many files.
    String fields equal to one of ``na_tokens`` become null (pandas default).
    """
    df = (spark.read.schema(schema)
          .option("sep", "\t").option("quote", '"').option("escape", '"')
          .option("header", False).option("multiLine", multi_line)
          .option("mode", "FAILFAST")
          .csv(path))
    cols = []
    for f in schema.fields:
        c = F.col(f.name)
        cols.append(na_to_null(c, na_tokens).alias(f.name) if isinstance(f.dataType, T.StringType) else c)
    return df.select(*cols)


# ------------------------------------------------------------------ S2 / S3 fingerprints
def file_fingerprint(spark: SparkSession, path: str, glob: str = "*", chunk: int = 1 << 20) -> DataFrame:
    """One row per file: name, byte length, SHA-256 of the content.

    Spark lists the files and deals them to tasks; a task streams each of its files in chunks of ``chunk`` bytes through
    an Arrow file system, so neither memory nor a cell ever holds a file, whatever its size. A store that
    only Spark's readers open is hashed from ``binaryFile`` cells instead (2 GB at most each). Spark's listing leaves
    empty files out.
    """
    b = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    name, length = F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").cast("bigint").alias("bytes")
    first = b.select("path").first()
    if first is None or not _arrow_opens(first["path"]):
        return b.select(name, length, F.sha2("content", 256).alias("sha256"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for uri in batch.column("path").to_pylist():
                store, at = pafs.FileSystem.from_uri(_uri(uri))
                digest = hashlib.sha256()
                with store.open_input_stream(at) as f:
                    while part := f.read(chunk):
                        digest.update(part)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(digests)], names=["path", "length", "sha256"])

    dealt = b.select("path", "length").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return dealt.mapInArrow(stream, "path string, length long, sha256 string").select(name, length, "sha256")


def _uri(path: str) -> str:
    """As Arrow parses it: Spark writes file:/a b for file:///a%20b."""
    path = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
    return quote(path, safe="/:@")


def _arrow_opens(uri: str) -> bool:
    try:
        pafs.FileSystem.from_uri(_uri(uri))
    except (pa.ArrowInvalid, OSError):
        return False
    return True


def row_digest(cols: Sequence[Column | str]) -> Column:
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.sha2(F.concat_ws(chr(31), *parts), 256)


def _fingerprint_aggs(h: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.conv(F.substring(h, 1, 15), 16, 10).cast("decimal(20,0)")),
                   F.lit(0).cast("decimal(20,0)")).cast("string").alias("hash_sum"),
        F.coalesce(F.bit_xor(F.conv(F.substring(h, 16, 15), 16, 10).cast("bigint")),
                   F.lit(0).cast("bigint")).alias("hash_xor"),
    ]


def _fingerprint_col() -> Column:
    return F.sha2(F.concat_ws(":", F.col("n_rows").cast("string"), "hash_sum",
                              F.col("hash_xor").cast("string")), 256)


def table_fingerprint(df: DataFrame, cols: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """Order-free content fingerprint of a table, in one aggregate pass.

    Per row SHA-256 over the unit-separator-joined columns; combined by row
    count, an exact decimal sum of the leading 60 bits and a XOR of the next
    60 bits. Neither combination depends on row order or partitioning, and
    the decimal sum cannot overflow. ``extra`` aggregates ride the same pass.
    """
    d = df.select(row_digest(cols).alias("_h"), *[c for c in df.columns if c not in ("_h",)])
    out = d.agg(*_fingerprint_aggs(F.col("_h")), *extra)
    return out.select("*", _fingerprint_col().alias("fingerprint"))


# ------------------------------------------------------------------ S4 / S6 manifests
SOURCE_MANIFEST_SCHEMA = T.StructType([
    T.StructField("source_name", T.StringType()),
    T.StructField("sha256", T.StringType()),
    T.StructField("expected_rows", T.LongType()),
    T.StructField("ratings_present", T.ArrayType(T.LongType())),
    T.StructField("target_origin", T.StringType()),
    T.StructField("created_at_utc", T.StringType()),
])


def source_manifest(df: DataFrame, source_name: str, cols: Sequence[str] = ("rating", "review"),
                    label: str = "rating", domain: Sequence[int] = VALID_RATINGS) -> DataFrame:
    """One-row manifest: fingerprint, row count, ratings present, origin, time
    (one aggregate pass over the source)."""
    flags = [F.max(F.when(F.col(label) == v, F.lit(1)).otherwise(F.lit(0))).alias(f"_p{v}") for v in domain]
    fp = table_fingerprint(df, cols, extra=flags)
    ratings = F.filter(F.array(*[F.when(F.col(f"_p{v}") == 1, F.lit(v).cast("bigint")) for v in domain]),
                       lambda x: x.isNotNull())
    return fp.select(
        F.lit(source_name).alias("source_name"),
        F.col("fingerprint").alias("sha256"),
        F.col("n_rows").alias("expected_rows"),
        ratings.alias("ratings_present"),
        F.lit(TARGET_ORIGIN).alias("target_origin"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at_utc"),
    )


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def split_manifest(splits: DataFrame, source_sha256: Column, seed: int = SEED,
                   disjoint: Column | None = None) -> DataFrame:
    """One row: source hash, seed, description, row count per split, origin, disjoint."""
    counts = splits.agg(*[F.count_if(F.col("split") == s).alias(f"{s}_rows")
                          for s in ("train", "validation", "test")])
    return counts.select(
        source_sha256.alias("source_sha256"),
        F.lit(seed).cast("bigint").alias("seed"),
        F.lit(SPLIT_DESCRIPTION).alias("split"),
        "train_rows", "validation_rows", "test_rows",
        F.lit(TARGET_ORIGIN).alias("target_origin"),
        (disjoint if disjoint is not None else F.lit(True)).alias("text_disjoint"),
    )


SPLIT_MANIFEST_SCHEMA = T.StructType([
    T.StructField("source_sha256", T.StringType()), T.StructField("seed", T.LongType()), T.StructField("split", T.StringType()),
    T.StructField("train_rows", T.LongType()), T.StructField("validation_rows", T.LongType()), T.StructField("test_rows", T.LongType()),
    T.StructField("target_origin", T.StringType()), T.StructField("text_disjoint", T.BooleanType()),
])


def manifest_gate(observed: DataFrame, manifest: DataFrame) -> DataFrame:
    """The observed fingerprint must equal the manifest's, origin must be
    the source file; the first failing reason is reported (NULL when ok)."""
    # the manifest is one row: its fields enter as scalar subqueries
    j = observed.select(
        F.col("fingerprint").alias("observed_sha256"), F.col("n_rows").alias("observed_rows"),
        manifest.select("sha256").scalar().alias("sha256"),
        manifest.select("expected_rows").scalar().alias("expected_rows"),
        manifest.select("target_origin").scalar().alias("target_origin"))
    reason = (F.when(F.col("observed_sha256") != F.col("sha256"), F.lit("fingerprint does not match the manifest"))
              .when(F.col("target_origin") != F.lit(TARGET_ORIGIN), F.lit("manifest does not prove the target origin"))
              .when(F.col("observed_rows") != F.col("expected_rows"), F.lit("row count does not match the manifest")))
    return j.select("observed_sha256", "observed_rows", reason.isNull().alias("manifest_ok"), reason.alias("reason"))


# ------------------------------------------------------------------ S5 / S7 split sink and reader
def write_splits(df: DataFrame, path: str) -> None:
    """One Parquet dataset partitioned by split (partition pruning on read)."""
    df.select("review", "rating", "target_origin", "split").write.mode("overwrite") \
        .partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str, domain: Sequence[int] = VALID_RATINGS) -> DataFrame:
    """Read the split dataset; B5 (column set, metadata only) is checked at
    once, B4/B6 (origin, domain subset) are checked per row at run time."""
    df = spark.read.parquet(path)
    cols = set(df.columns) - {"split"}
    if cols != SPLIT_COLUMNS:
        raise RuntimeError(f"split dataset has an unexpected schema: {sorted(cols)}")
    bad = (F.col("target_origin") != F.lit(TARGET_ORIGIN)) | ~F.col("rating").isin(list(domain)) \
        | F.col("target_origin").isNull() | F.col("rating").isNull()
    # a filter predicate is always evaluated (a dropped gate column would be pruned away)
    gate = F.when(bad, F.raise_error(F.concat(
        F.lit("split "), F.col("split"), F.lit(" holds a row that is not a source rating in the domain")))
    ).otherwise(F.lit(True)).cast("boolean")
    return df.where(gate)


# ------------------------------------------------------------------ S8 / S9 training logs
LOG_SCHEMA = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("checkpoint", T.StringType()),
    T.StructField("log_history", T.ArrayType(T.MapType(T.StringType(), T.DoubleType()))),
    T.StructField("best_metric", T.DoubleType()),
    T.StructField("best_model_checkpoint", T.StringType()),
])


#: A log that comes in several documents: each holds the next entries of its checkpoint's log, numbered from 0.
SEGMENTED_LOG_SCHEMA = T.StructType([*LOG_SCHEMA.fields, T.StructField("segment", T.LongType())])


TRAINER_STATE_SCHEMA = T.StructType([
    T.StructField("log_history", T.ArrayType(T.MapType(T.StringType(), T.DoubleType()))),
    T.StructField("best_metric", T.DoubleType()),
    T.StructField("best_model_checkpoint", T.StringType()),
    T.StructField("global_step", T.LongType()),
])


def read_trainer_states(spark: SparkSession, results_dir: str, run: str | None = None) -> DataFrame:
    """Read ``<results_dir>/checkpoint-<step>/trainer_state.json`` files (one
    multi-line JSON document each) into the log schema; the checkpoint name is
    taken from the file path. Each file is read by one task."""
    df = (spark.read.schema(TRAINER_STATE_SCHEMA).option("multiLine", True)
          .json(f"{results_dir.rstrip('/')}/checkpoint-*/trainer_state.json"))
    ckpt = F.regexp_extract(F.col("_metadata.file_path"), r"/(checkpoint-\d+)/[^/]+$", 1)
    return df.select(F.lit(run or results_dir.rstrip("/").split("/")[-1]).alias("run"), ckpt.alias("checkpoint"),
                     "log_history", "best_metric", "best_model_checkpoint")


def validation_history(logs: DataFrame) -> DataFrame:
    """Explode ``log_history``; keep entries that have ``eval_mae``; keep only
    the keys ``eval_*`` and ``epoch``."""
    e = logs.select("run", "checkpoint", F.explode("log_history").alias("entry"))
    e = e.where(F.map_contains_key("entry", "eval_mae"))
    kept = F.map_filter("entry", lambda k, v: k.startswith("eval_") | (k == "epoch"))
    return e.select("run", "checkpoint", kept.alias("metrics"))


def checkpoint_step(checkpoint: Column) -> Column:
    return F.regexp_extract(checkpoint, r"-(\d+)$", 1).cast("bigint")


def latest_checkpoint(logs: DataFrame) -> DataFrame:
    """Per run, the checkpoint with the largest numeric suffix (not the
    lexicographic last: checkpoint-900 < checkpoint-1000)."""
    step = checkpoint_step(F.col("checkpoint"))
    return logs.groupBy("run").agg(
        F.max_by("checkpoint", step).alias("latest_checkpoint"),
        F.max(step).alias("latest_step"),
        F.count(F.lit(1)).alias("n_checkpoints"))


def training_metadata(logs: DataFrame, runs: Sequence[str] | None = None, whole: bool = True) -> DataFrame:
    """One record per run: its newest checkpoint by number, the best metric and checkpoint noted there, and the
    validation entries of that checkpoint's log in order. Logs are cumulative, so older checkpoints of a run repeat what the newest
    holds and are not read again. With ``runs``, exactly these, and a run without a checkpoint has a record of nulls.

    A log may come in segments (a column ``segment``, see ``SEGMENTED_LOG_SCHEMA``). With ``whole=False`` the record is left
    in them: a row, with ``segment`` and its own ``history``, for each, so that no task holds a run's whole log."""
    step, segment = checkpoint_step(F.col("checkpoint")), F.col("segment") if "segment" in logs.columns else F.lit(0).cast("bigint")
    newest = logs.select("run", "checkpoint").groupBy("run").agg(F.max(step).alias("latest_step"))  # a row for each run
    mine = F.col("run").eqNullSafe(F.col("_run")) & (step == F.col("latest_step"))
    found = newest.withColumnRenamed("run", "_run")
    own = logs.withColumn("segment", segment).join(F.broadcast(found), mine).groupBy("run", "segment").agg(
        F.max_by(F.struct("checkpoint", "log_history", "best_metric", "best_model_checkpoint"), step).alias("c"))
    entries = F.filter("c.log_history", lambda e: F.map_contains_key(e, "eval_mae"))
    history = F.transform(entries, lambda e: F.map_filter(e, lambda k, v: k.startswith("eval_") | (k == "epoch")))
    record = own.select("run", F.col("c.checkpoint").alias("latest_checkpoint"), checkpoint_step(F.col("c.checkpoint")).alias("latest_step"),
                        F.col("c.best_metric").alias("best_metric"), F.col("c.best_model_checkpoint").alias("best_model_checkpoint"), history.alias("history"), "segment")
    if whole:
        first = ["latest_checkpoint", "latest_step", "best_metric", "best_model_checkpoint"]
        order = lambda a, b: F.when(a["segment"] < b["segment"], -1).when(a["segment"] > b["segment"], 1).otherwise(0)
        parts = F.array_sort(F.collect_list(F.struct("segment", "history")), order)
        record = record.groupBy("run").agg(F.min_by(F.struct(*first), "segment").alias("r"), parts.alias("p")).select(
            "run", *[F.col(f"r.{c}").alias(c) for c in first], F.flatten(F.col("p.history")).alias("history"))
    # records of nulls: runs that have no numbered checkpoint, and runs the caller named that have no log
    empty = newest.where("latest_step IS NULL").select("run")
    if runs is not None:
        wanted = logs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, runs))).alias("run"))
        empty = wanted.join(newest.where("latest_step IS NOT NULL"), "run", "left_anti")
        record = record.join(F.broadcast(wanted), "run")
    return record.unionByName(empty.select("run", *[F.lit(None).cast(f.dataType).alias(f.name) for f in record.schema.fields[1:]]))


# ------------------------------------------------------------------ S10 results payload
def results_payload(board: DataFrame, meta: dict) -> DataFrame:
    """One JSON document per system: fixed metadata plus its metric record."""
    metric_cols = [c for c in board.columns if c != "system"]
    record = F.struct(
        *[F.lit(v).alias(k) for k, v in meta.items()],
        F.col("system"),
        F.struct(*[F.col(c) for c in metric_cols]).alias("test_results"),
    )
    return board.select("system", F.to_json(record).alias("payload"))


def write_text(df: DataFrame, col: str, path: str) -> None:
    df.select(F.col(col).alias("value")).write.mode("overwrite").text(path)
