"""Bootstrap confidence intervals and paired deltas.

Every metric used here is a function of the counts of (label, prediction)
cells, so resampling n rows with replacement is exactly a multinomial draw
over cells. The strategies share one output shape
``(by.., metric, point, ci_low, ci_high, n_resamples)``:

* ``cells`` (default): one aggregation to cells, then a two-level multinomial.
  Cells are dealt by hash into parts. How many of a replicate's rows fall into a part follows from
  a tree of binomial draws over the parts, which every task walks down to its own part from the same seeds
  (log2(parts) draws a replicate); it draws these rows over its own cells. Metrics that are sums
  (``SumMetric``) are summed right there, so a task sends a row of sums for each replicate; for any other
  metric it sends the cells drawn. No task or driver holds all cells, so near-continuous
  predictions are no special case. Cost B x cells, spread over the parts. Same distribution as row resampling, not the same
  draws. The seed of a draw holds the group's own hash: a group's interval doesn't
  depend on which other groups are resampled beside it.
* ``little``: bag of little bootstraps, for any Python function of (labels, predictions, weights). Subsets of about
  n^0.6 rows are each resampled to the full n by multinomial weights; the subsets' intervals are averaged. Only the
  subsets' rows move, and no table of cells is made.
* ``hash``: reproducible in any SQL engine. Draw j of replicate b picks row
  ``md5(seed:b:j)[:15] mod n``; rows are ordered by cell, so the row maps to
  its cell by cumulative-count interval (equi-join on a coarse bucket of the
  interval, then a range filter). Draws are hashed in the JVM (``HashedDraws.java``), a thousand at a time, and counted
  between the rows where cells begin: a task sends a row for each cell and replicate. Where cells begin at more than
  65,536 rows, or the hashed texts may be longer than 55 bytes, draws are hashed in numpy; those that fall into a
  bucket that lies inside one cell of every group are only counted, so a task sends a row a bucket for them, and
  a row for each other draw. Cost B x n hashes. The 60-bit hash modulo n has bias
  below n / 2^60.
* ``poisson``: each row gets a Poisson(1) weight per replicate from a hash
  (for continuous predictions with near-unique cells). Cost B x n, fully
  parallel, approximate (the resample size varies).

Quantiles use linear interpolation (``percentile``), as numpy's default.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starling.domain import SEED
from starling.functions import metrics as M
from starling.functions.decode import nearest_rating
from starling.session import register_java, written

_BATCH_ROWS = 100_000  # drawn cells that a task hands on at once
_BATCH_DRAWS = 1 << 22  # draws (replicates x cells) that a task holds at once
_CHUNK_DRAWS = 1 << 20  # hashed draws of a replicate that are dealt to a task together
_TASK_DRAWS = 1 << 28  # hashed draws of a task
_COUNTED_CHUNK_DRAWS = 1 << 24  # draws of a replicate that one call counts between cuts, or more where cuts are many
_COUNTED_TASK_DRAWS = 1 << 27  # draws of such a task
_CUTS = 1 << 16  # rows where cells begin, that draws are counted between
_TEXT_BYTES = 55  # of a draw's text, that MD5 takes at once


# ------------------------------------------------------------------ metric adapters
def paired_delta_metric(metric: M.Metric, a: str = "pred_a", b: str = "pred_b") -> M.Metric:
    """metric(label, a) - metric(label, b) on the same weights."""
    if isinstance(metric, M.SumMetric):
        def combine(sums, n):
            half = len(sums) // 2
            return metric.combine(sums[:half], n) - metric.combine(sums[half:], n)

        return M.SumMetric(lambda y, _p: [*metric.terms(y, F.col(a)), *metric.terms(y, F.col(b))], combine)
    return lambda y, _p, w: metric(y, F.col(a), w) - metric(y, F.col(b), w)


def snapped(metric: M.Metric) -> M.Metric:
    """The metric applied to predictions snapped to the nearest valid rating."""
    if isinstance(metric, M.SumMetric):
        return M.SumMetric(lambda y, p: metric.terms(y, nearest_rating(p).cast("double")), metric.combine)
    return lambda y, p, w: metric(y, nearest_rating(p).cast("double"), w)


def _summarise(reps: DataFrame, point: DataFrame, by: Sequence[str], names: Sequence[str],
               n_resamples: int, confidence: float) -> DataFrame:
    alpha = (1.0 - confidence) / 2.0
    stack = F.inline(F.array(*[F.struct(F.lit(nm).alias("metric"), F.col(nm).cast("double").alias("value"))
                              for nm in names]))
    long = reps.select(*by, stack)
    q = long.groupBy(*by, "metric").agg(
        F.percentile(F.col("value"), F.array(F.lit(alpha), F.lit(1.0 - alpha))).alias("_q"))
    pt = point.select(*by, F.inline(F.array(*[F.struct(F.lit(nm).alias("metric"), F.col(nm).cast("double").alias("point"))
                                              for nm in names])))
    j = pt.join(q, [*by, "metric"], "inner")
    return j.select(*by, "metric", "point", F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"),
                    F.lit(int(n_resamples)).cast("bigint").alias("n_resamples"))


def _apply(df: DataFrame, by: Sequence[str], metrics: Mapping[str, M.Metric], w: str,
           label: str, pred: str) -> DataFrame:
    aggs = [fn(F.col(label), F.col(pred) if pred in df.columns else F.lit(None), F.col(w)).alias(nm)
            for nm, fn in metrics.items()]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


# ------------------------------------------------------------------ cells strategy
def rows_of_part(totals: np.ndarray, part: int, n_resamples: int, seed: Sequence[int]) -> np.ndarray:
    """How many of each replicate's rows fall into one part of a multinomial over ``totals``: binomial draws at the nodes on
    the way down to the part. Tasks that pass the same node draw the same numbers there, so parts add up."""
    upto = np.concatenate([[0], np.cumsum(totals)])
    low, high, n = 0, len(totals), np.full(n_resamples, upto[-1], np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        whole, left = upto[high] - upto[low], upto[middle] - upto[low]
        drawn = np.random.default_rng([*seed, low, high]).binomial(n, left / whole if whole else 0.0)
        if part < middle:
            high, n = middle, drawn
        else:
            low, n = middle, n - drawn
    return n


def bootstrap_cells(cells: DataFrame, metrics: Mapping[str, M.Metric], n_resamples: int = 1000,
                    seed: int = SEED, confidence: float = 0.95, by: Sequence[str] = (),
                    cell_cols: Sequence[str] = ("label", "prediction"), label: str = "label",
                    pred: str = "prediction", partitions: int | None = None) -> DataFrame:
    """Two-level multinomial resampling over cells (see the module's text).

    The driver sees one total per (group, part), never a cell.
    """
    spark, columns, b = cells.sparkSession, [*by, *cell_cols], int(n_resamples)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    y, p = F.col(label), F.col(pred) if pred in columns else F.lit(None)
    summed = all(isinstance(m, M.SumMetric) for m in metrics.values())
    terms = {name: m.terms(y, p) for name, m in metrics.items()} if summed else {}
    keyed = written(cells.where("n > 0").select(
        *columns, F.col("n").cast("bigint").alias("n"),
        (F.xxhash64(*by) if by else F.lit(0).cast("bigint")).alias("_group"), F.xxhash64(*cell_cols).alias("_cell"),
        F.array(*[F.coalesce(t.cast("double"), F.lit(0.0)) for each in terms.values() for t in each]).cast("array<double>").alias("_terms"))
        .withColumn("_part", F.pmod("_cell", F.lit(parts)).cast("int")), "cells")
    totals: dict[int, np.ndarray] = {}
    for t in keyed.groupBy("_group", "_part").agg(F.sum("n").alias("t")).toLocalIterator():
        totals.setdefault(t["_group"], np.zeros(parts, dtype=np.int64))[t["_part"]] = t["t"]
    shared = spark.sparkContext.broadcast(totals)  # parts x groups numbers
    names, n_terms = list(by), sum(map(len, terms.values()))
    held_cols = [*names, "n", "_group", "_part", "_cell", "_terms"] if summed else [*columns, "n", "_group", "_part", "_cell"]

    def draws(own: pd.DataFrame, group: int, part: int):
        """(first replicate, draws of some replicates over the part's cells, in the cells' own order)."""
        mark, n = group & 0xFFFFFFFFFFFFFFFF, own["n"].to_numpy(np.int64)
        mine, share = rows_of_part(shared.value[group], part, b, [int(seed), mark]), n / n.sum()
        rng, step = np.random.default_rng([int(seed), mark, part, parts, 1]), max(1, _BATCH_DRAWS // len(n))
        for at in range(0, b, step):
            yield at, rng.multinomial(mine[at : at + step], share)

    def sums_of(own: pd.DataFrame, group: int, part: int):
        held = np.stack(own["_terms"].to_numpy()).astype(float).reshape(len(own), n_terms)
        got = [(k.sum(axis=1), k @ held) for _, k in draws(own, group, part)]
        out = pd.DataFrame({"b": np.arange(b), "w": np.concatenate([w for w, _ in got]), "s": list(np.concatenate([x for _, x in got]))})
        yield out.assign(**{c: [own[c].iloc[0]] * b for c in names})

    def cells_of(own: pd.DataFrame, group: int, part: int):
        held, rows = [], 0
        for at, drawn in draws(own, group, part):
            for i, k in enumerate(drawn):
                hit = np.flatnonzero(k)
                held.append((np.full(len(hit), at + i), hit, k[hit]))
                rows += len(hit)
                if rows >= _BATCH_ROWS:
                    yield own[columns].iloc[np.concatenate([h[1] for h in held])].reset_index(drop=True).assign(
                        b=np.concatenate([h[0] for h in held]), w=np.concatenate([h[2] for h in held]))
                    held, rows = [], 0
        if rows:
            yield own[columns].iloc[np.concatenate([h[1] for h in held])].reset_index(drop=True).assign(
                b=np.concatenate([h[0] for h in held]), w=np.concatenate([h[2] for h in held]))

    each = sums_of if summed else cells_of

    def draw(batches):
        now, held = None, []
        for pdf in batches:
            for key, own in pdf.groupby(["_group", "_part"], sort=False):
                key = tuple(int(x) for x in key)
                if key != now and held:
                    yield from each(pd.concat(held, ignore_index=True), *now)
                    held = []
                now = key
                held.append(own)
        if held:
            yield from each(pd.concat(held, ignore_index=True), *now)

    drawn = [T.StructField("b", T.LongType()), T.StructField("w", T.LongType())]
    schema = T.StructType([*drawn, T.StructField("s", T.ArrayType(T.DoubleType())), *(keyed.schema[c] for c in names)] if summed
                          else [*(keyed.schema[c] for c in columns), *drawn])
    order = ["_group", "_part", "_cell", *cell_cols]  # the draws don't hang on how the cells arrived
    dealt = keyed.repartition("_group", "_part").sortWithinPartitions(*order).select(*held_cols)
    if summed:
        added = dealt.mapInPandas(draw, schema).groupBy(*names, "b").agg(
            F.sum("w").alias("w"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(n_terms)])
        at, out = 0, []
        for name, m in metrics.items():
            width = len(terms[name])
            out.append(m.combine([F.col(f"s{at + i}") for i in range(width)], F.col("w")).alias(name))
            at += width
        reps = added.select(*names, "b", *out)
    else:
        reps = _apply(dealt.mapInPandas(draw, schema), [*names, "b"], metrics, "w", label, pred)
    point = _apply(keyed, names, metrics, "n", label, pred)
    return _summarise(reps, point, by, list(metrics), n_resamples, confidence)


# ------------------------------------------------------------------ hash strategy
def draw_index(seed: int, b, j, n) -> F.Column:
    """Row drawn by draw j of replicate b: md5(seed:b:j), first 60 bits, mod n."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), b.cast("string"), F.lit(":"), j.cast("string")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint") % n


def bootstrap_hash(cells: DataFrame, metrics: Mapping[str, M.Metric], n_resamples: int = 1000,
                   seed: int = SEED, confidence: float = 0.95, by: Sequence[str] = (),
                   cell_cols: Sequence[str] = ("label", "prediction"), label: str = "label",
                   pred: str = "prediction", n_buckets: int = 4096) -> DataFrame:
    """Hash-drawn row resampling; every group must have the same row count n
    (systems scored on one test table). Draws are shared by all groups."""
    if int(n_resamples) < 1:
        raise ValueError("at least one resample is needed")
    # cut once, so that the actions below do not each re-aggregate the source rows
    keyed = written(cells.select(*by, *cell_cols, "n"), "cells")
    totals = keyed.groupBy(*by).agg(F.sum("n").alias("t")).select("t").distinct().collect()
    if len(totals) != 1:
        raise ValueError("hash bootstrap needs the same row count in every group")
    n = int(totals[0]["t"])
    width = max(1, math.ceil(n / n_buckets))
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(*cell_cols) \
        .rowsBetween(Window.unboundedPreceding, -1)
    iv = keyed.withColumn("lo", F.coalesce(F.sum("n").over(w), F.lit(0)))
    iv = iv.withColumn("hi", F.col("lo") + F.col("n"))
    spans = iv.withColumn("bucket", F.explode(F.sequence(
        F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    cuts = [r["lo"] for r in iv.where("lo > 0").select("lo").distinct().limit(_CUTS + 1).collect()]
    if len(cuts) <= _CUTS and len(f"{seed}:{int(n_resamples) - 1}:{n - 1}") <= _TEXT_BYTES:
        draws = spark_range_draws(cells.sparkSession, n_resamples, n, seed, width, [], sorted(cuts))
    else:
        shared = spans.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket").distinct()
        draws = spark_range_draws(cells.sparkSession, n_resamples, n, seed, width, [r["bucket"] for r in shared.collect()])  # n_buckets numbers at most
    hit = draws.join(spans, "bucket", "inner").where((F.col("idx") >= F.col("lo")) & (F.col("idx") < F.col("hi")))
    counts = hit.groupBy(*by, "b", *cell_cols).agg(F.sum("w").alias("w"))
    reps = _apply(counts, [*by, "b"], metrics, "w", label, pred)
    point = _apply(keyed, list(by), metrics, "n", label, pred)
    return _summarise(reps, point, by, list(metrics), n_resamples, confidence)


_SHIFTS = [x for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
_DIGITS = 4  # the last digits of j that change within a block of draws


def _md5_start(words: Sequence[int | np.ndarray], m: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two 32-bit words of the MD5 digests of m padded messages. ``words``: 16 for each 64 bytes, an int
    where all messages agree."""
    state = [np.full(m, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    f, t = np.empty(m, np.uint32), np.empty(m, np.uint32)
    for at in range(0, len(words), 16):
        a, b, c, d = (x.copy() for x in state)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
                k = i
            elif i < 32:
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
                k = (5 * i + 1) % 16
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                f ^= d
                k = (3 * i + 5) % 16
            else:
                np.invert(d, out=f)
                f |= b
                f ^= c
                k = 7 * i % 16
            word = words[at + k]
            f += a
            if isinstance(word, int):
                f += np.uint32((word + _SINES[i]) & 0xFFFFFFFF)
            else:
                f += word
                f += np.uint32(_SINES[i])
            np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=t)
            f <<= np.uint32(_SHIFTS[i])
            f |= t
            f += b
            a, b, c, d, f = d, f, b, c, a
        state = [x + y for x, y in zip(state, (a, b, c, d))]
    return state[0], state[1]


@lru_cache(maxsize=64)
def _tails(first: int, stop: int, digits: int) -> np.ndarray:
    """The ASCII digits of first .. stop - 1: a row for each digit."""
    return np.stack([np.arange(first, stop) // 10 ** (digits - 1 - i) % 10 + 48 for i in range(digits)]).astype(np.uint32)


def _drawn(prefix: str, tails: np.ndarray, n: int) -> np.ndarray:
    """``draw_index`` of the texts prefix + tail: ``tails`` holds the ASCII digits that differ, a column for each text."""
    digits, m = tails.shape
    size = len(prefix) + digits
    padded = bytearray(-(-(size + 9) // 64) * 64)
    padded[: len(prefix)], padded[size], padded[-8:] = prefix.encode(), 0x80, (8 * size).to_bytes(8, "little")
    words: list[int | np.ndarray] = np.frombuffer(bytes(padded), "<u4").tolist()
    for i in range(digits):
        word, byte = divmod(len(prefix) + i, 4)
        words[word] = words[word] + (tails[i] << np.uint32(8 * byte))
    high, low = (x.byteswap().astype(np.uint64) for x in _md5_start(words, m))
    return (((high << np.uint64(32)) | low) >> np.uint64(4)) % np.uint64(n)


def replicate_draws(seed: int, b: int, first: int, stop: int, n: int) -> Iterator[np.ndarray]:
    """Rows that draws first .. stop - 1 of replicate b pick (see ``draw_index``), some thousands at a time."""
    block, j = 10 ** _DIGITS, first
    while j < stop:
        end = min(stop, (j // block + 1) * block, 10 ** len(str(j)))  # numbers of one length that share all but their last digits
        digits = min(_DIGITS, len(str(j)))
        tails = _tails(j % block, j % block + end - j, digits)
        yield _drawn(f"{seed}:{b}:{str(j)[:-digits]}", tails, n).astype(np.int64)
        j = end


def counted_draws(spark, n_resamples: int, n: int, seed: int, starts: Sequence[int]) -> DataFrame:
    """(b, idx, w): how many draws of a chunk of replicate b fall between ``idx``, one of the ascending ``starts``, and the next."""
    function = register_java(spark, os.path.join(os.path.dirname(__file__), "HashedDraws.java"), "array<struct<idx: bigint, w: bigint>>")
    chunk = max(1, min(n, max(_COUNTED_CHUNK_DRAWS, 256 * len(starts))))
    chunks = -(-n // chunk)
    slices = min(n_resamples * chunks, max(3 * spark.sparkContext.defaultParallelism, n_resamples * n // _COUNTED_TASK_DRAWS))
    b, first = F.expr(f"id div {chunks}"), F.expr(f"id % {chunks} * {chunk}L")
    found = F.call_function(function, F.concat(F.lit(f"{seed}:"), b.cast("string"), F.lit(":")), first, F.least(first + chunk, F.lit(n).cast("long")),
                            F.lit(n).cast("long"), F.lit(np.array(starts, ">i8").tobytes()))
    return spark.range(0, n_resamples * chunks, 1, slices).select(b.alias("b"), F.inline(found))


def spark_range_draws(spark, n_resamples: int, n: int, seed: int, width: int, exact: Sequence[int],
                      cuts: Sequence[int] | None = None) -> DataFrame:
    """(b, idx, bucket, w) for all B x n draws, generated in parallel by ``range``. With ``cuts``, the ascending rows but
    the first where cells begin, a row stands for ``w`` draws from one cut up to the next. Without, in the buckets ``exact`` a row is one
    drawn index; in any other a row stands for all ``w`` draws of a task, at the bucket's first index."""
    total, n, width = int(n_resamples) * int(n), int(n), int(width)
    if cuts is not None:
        return counted_draws(spark, int(n_resamples), n, seed, [0, *cuts]).select("b", "idx", F.expr(f"idx div {width}").alias("bucket"), "w")
    single = np.zeros(-(-n // width), bool)
    single[list(exact)] = True
    chunk = max(1, min(n, _CHUNK_DRAWS))
    chunks = -(-n // chunk)
    schema = pa.schema([("b", pa.int64()), ("idx", pa.int64()), ("bucket", pa.int64()), ("w", pa.int64())])

    def rows(b: int, idx: np.ndarray, bucket: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(idx), b)), pa.array(idx), pa.array(bucket), pa.array(w)], schema=schema)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.zeros(len(single), np.int64)
        for batch in batches:
            for number in batch.column("id").to_pylist():
                b, at = divmod(number, chunks)
                if b != now and now is not None:
                    found = np.flatnonzero(held)
                    yield rows(now, found * width, found, held[found])
                    held[:] = 0
                now = b
                for idx in replicate_draws(seed, b, at * chunk, min(n, (at + 1) * chunk), n):
                    bucket = idx // width
                    alone = single[bucket]
                    if alone.any():
                        picked, w = np.unique(idx[alone], return_counts=True)
                        yield rows(b, picked, picked // width, w)
                    held += np.bincount(bucket[~alone], minlength=len(held))
        if now is not None:
            found = np.flatnonzero(held)
            yield rows(now, found * width, found, held[found])

    slices = min(int(n_resamples) * chunks, max(spark.sparkContext.defaultParallelism, -(-total // _TASK_DRAWS)))
    return spark.range(0, int(n_resamples) * chunks, 1, max(1, slices)).mapInArrow(draw, "b long, idx long, bucket long, w long")


# ------------------------------------------------------------------ poisson strategy
# Poisson(1) inverse CDF boundaries, computed from the pmf e^-1 / k!.
_POISSON_CDF = list(np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(20)]))


def poisson_weight(u: F.Column) -> F.Column:
    expr = None
    for k, c in enumerate(_POISSON_CDF):
        expr = F.when(u < F.lit(c), F.lit(k)) if expr is None else expr.when(u < F.lit(c), F.lit(k))
    return expr.otherwise(F.lit(len(_POISSON_CDF))).cast("bigint")


def bootstrap_poisson(rows: DataFrame, metrics: Mapping[str, M.Metric], n_resamples: int = 1000,
                      seed: int = SEED, confidence: float = 0.95, by: Sequence[str] = (),
                      key: str = "row_id", label: str = "label", pred: str = "prediction") -> DataFrame:
    """Poisson(1) weights per (row, replicate); partial aggregation keeps the
    shuffle at B rows per group and task."""
    reps_idx = F.explode(F.sequence(F.lit(0), F.lit(int(n_resamples) - 1))).alias("b")
    x = rows.select("*", reps_idx)
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("b").cast("string"), F.lit(":"), F.col(key).cast("string")))
    u = F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))
    x = x.withColumn("w", poisson_weight(u))
    reps = _apply(x, [*by, "b"], metrics, "w", label, pred)
    point = _apply(rows.withColumn("w", F.lit(1)), list(by), metrics, "w", label, pred)
    return _summarise(reps, point, by, list(metrics), n_resamples, confidence)


# ------------------------------------------------------------------ bag of little bootstraps
def bootstrap_little(rows: DataFrame, metrics: Mapping[str, Callable[[np.ndarray, np.ndarray, np.ndarray], float]], n_resamples: int = 100,
                     seed: int = SEED, confidence: float = 0.95, by: Sequence[str] = (), key: str = "row_id", label: str = "label",
                     pred: str = "prediction", subsets: int = 20, exponent: float = 0.6) -> DataFrame:
    """Intervals of any functions ``f(labels, predictions, weights) -> float`` over rows with a unique ``key``.

    A row's hash deals it into one of n^(1 - exponent) subsets of its group; up to ``subsets`` of them are used, each
    in a task of its own, where ``n_resamples`` multinomial weights that add up to the group's n make replicates
    of the full size. ``point``, ``ci_low`` and ``ci_high`` are means over the subsets. Rows whose label or prediction is null take no part."""
    names, alpha, b = list(by), (1.0 - confidence) / 2.0, int(n_resamples)
    slim = rows.select(*names, F.xxhash64(F.lit(int(seed)), F.col(key)).alias("_h"), F.col(label).cast("double").alias("_y"),
                       F.col(pred).cast("double").alias("_p")).where("_y IS NOT NULL AND _p IS NOT NULL")
    sizes = slim.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))  # a row for each group
    n_subsets = F.greatest(F.lit(1), F.floor(F.pow(F.col("_n").cast("double"), F.lit(1.0 - exponent)))).cast("long")
    sizes = sizes.withColumn("_of", n_subsets)
    with_size = slim.join(F.broadcast(sizes), names) if names else slim.crossJoin(F.broadcast(sizes))
    chosen = with_size.withColumn("_subset", F.pmod("_h", "_of")).where(F.col("_subset") < int(subsets)).drop("_of")
    schema = T.StructType([*(slim.schema[c] for c in names), *(T.StructField(c, T.DoubleType()) for c in ("point", "ci_low", "ci_high")), T.StructField("metric", T.StringType())])

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", "_y", "_p"])
        y, p, n = pdf["_y"].to_numpy(), pdf["_p"].to_numpy(), int(pdf["_n"].iloc[0])
        rng, even, ones = np.random.default_rng([int(seed), int(pdf["_subset"].iloc[0])]), np.full(len(y), 1 / len(y)), np.ones(len(y))
        values = {m: np.empty(b) for m in metrics}
        for i in range(b):
            w = rng.multinomial(n, even)
            for m, f in metrics.items():
                values[m][i] = f(y, p, w)
        out = [{"metric": m, "point": f(y, p, ones), "ci_low": np.quantile(values[m], alpha), "ci_high": np.quantile(values[m], 1 - alpha)} for m, f in metrics.items()]
        return pd.DataFrame(out).assign(**{c: pdf[c].iloc[0] for c in names})[schema.names]

    per_subset = chosen.groupBy(*names, "_subset").applyInPandas(resample, schema)
    return per_subset.groupBy(*names, "metric").agg(*[F.avg(c).alias(c) for c in ("point", "ci_low", "ci_high")], F.count(F.lit(1)).alias("n_subsets")) \
        .withColumn("n_resamples", F.lit(b).cast("bigint"))


def weighted_median(x: np.ndarray, w: np.ndarray) -> float:
    """The least value that at least half of the weight does not exceed."""
    order = np.argsort(x, kind="stable")
    upto = np.cumsum(w[order])
    return float(x[order][np.searchsorted(upto, 0.5 * upto[-1])])


def median_error(y: np.ndarray, p: np.ndarray, w: np.ndarray) -> float:
    """Median absolute error, which no sums give."""
    return weighted_median(np.abs(p - y), w)


def bootstrap_ci(cells_or_rows: DataFrame, metrics: Mapping[str, M.Metric], strategy: str = "cells",
                 **kwargs) -> DataFrame:
    if strategy == "cells":
        return bootstrap_cells(cells_or_rows, metrics, **kwargs)
    if strategy == "hash":
        return bootstrap_hash(cells_or_rows, metrics, **kwargs)
    if strategy == "poisson":
        return bootstrap_poisson(cells_or_rows, metrics, **kwargs)
    if strategy == "little":
        return bootstrap_little(cells_or_rows, metrics, **kwargs)
    raise ValueError(f"unknown strategy {strategy!r}")


def excludes_zero(ci: DataFrame) -> DataFrame:
    """Paired-delta verdict: the interval lies strictly on one side of zero."""
    return ci.withColumn("excludes_zero", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))
