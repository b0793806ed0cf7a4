"""Positions and running minima over ordered groups, whatever their sizes.

Rows are dealt by sampled ranges of (group, order), so partitions are even however the order is spread
and however large one group is, and sorted inside. One pass over each sorted partition numbers
its rows and keeps its own running minimum; what came before a partition is carried in: for the one
group that may continue into it, the rows and the least value of all earlier partitions. There are at
most as many carries as partitions, and the rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starling.session import written


def _differs(column: pa.Array) -> np.ndarray:
    """Where a row differs from the one before it (nulls are equal)."""
    here, before = column.slice(1), column.slice(0, len(column) - 1)
    valid, valid_before = here.is_valid().to_numpy(zero_copy_only=False), before.is_valid().to_numpy(zero_copy_only=False)
    unequal = pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
    return (valid != valid_before) | (valid & valid_before & unequal)


def _numbered(batches: Iterator[pa.RecordBatch], by: Sequence[str], value: str | None) -> Iterator[pa.RecordBatch]:
    """Adds the partition, the row's number in its group, and the number of the row that held the least value before it."""
    part, last, count = TaskContext.get().partitionId(), None, 0
    least, least_at = np.inf, 0  # of the group the last batch ended in; at 0: none yet
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        fresh = np.zeros(n, bool)
        for c in by:
            fresh[1:] |= _differs(batch.column(c))
        fresh[0] = last != tuple(batch.column(c)[0].as_py() for c in by)
        last = tuple(batch.column(c)[n - 1].as_py() for c in by)
        starts = np.flatnonzero(fresh)
        begin = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
        number = np.arange(n) - begin + 1
        number[begin < 0] = np.arange((begin < 0).sum()) + 1 + count
        out = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(number.astype(np.int64))]
        if value is not None:
            v = batch.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False)
            v = np.where(np.isnan(v), np.inf, v)  # a NaN is greater than every number
            prior = np.zeros(n, np.int64)
            prior_value = np.full(n, np.inf)
            for a, b in zip([0, *starts[starts > 0]], [*starts[starts > 0], n]):
                low, at = (np.inf, 0) if fresh[a] else (least, least_at)
                seen = np.concatenate([[low], v[a:b]])
                run = np.minimum.accumulate(seen)
                better = np.concatenate([[True], seen[1:] < run[:-1]])
                if at == 0:
                    better[1] = True
                places = np.concatenate([[at], number[a:b]])
                held = places[np.maximum.accumulate(np.where(better, np.arange(len(seen)), 0))]
                prior[a:b], prior_value[a:b] = held[:-1], run[:-1]
                least, least_at = run[-1], held[-1]
            out += [pa.array(prior, pa.int64(), mask=prior == 0), pa.array(prior_value, pa.float64(), mask=prior == 0)]
        count = int(number[-1])
        yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, "_part", "_number", *(["_prior", "_prior_value"] if value is not None else [])])


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "position", value: str | None = None,
            partitions: int | None = None) -> DataFrame:
    """Adds ``name``, the row's 1-based position in its group, and with ``value`` (a number, not null) the struct ``prior``
    (value, position) of the least value before the row, the earliest of equals; null at a group's first row.

    The order within a group should be total; rows that tie in it are numbered in some order. Null group keys form one group."""
    spark, columns = df.sparkSession, df.columns
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    extra = [("_part", T.IntegerType()), ("_number", T.LongType())]
    if value is not None:
        extra += [("_prior", T.LongType()), ("_prior_value", T.DoubleType())]
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, t) for c, t in extra)])
    by_, value_ = list(by), value  # plain values for the closure
    dealt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    parts = written(dealt.mapInArrow(lambda batches: _numbered(batches, by_, value_), schema), "ordered")

    held = [F.max("_number").alias("_n")]
    if value is not None:
        held.append(F.min(F.struct(F.col(value).cast("double").alias("value"), F.col("_number").alias("at"))).alias("_least"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.groupBy(*by, "_part").agg(*held).withColumn("_offset", F.sum("_n").over(earlier))
    if value is not None:
        moved = F.struct(F.col("_least.value").alias("value"), (F.col("_least.at") + F.coalesce("_offset", F.lit(0))).alias(name))
        carry = carry.withColumn("_moved", moved).withColumn("_carried", F.min("_moved").over(earlier))
    # one group at most continues into a partition, so there are no more carries than partitions
    carry = F.broadcast(carry.where("_offset IS NOT NULL").select(
        *[F.col(c).alias(f"_c_{c}") for c in by], F.col("_part").alias("_c_part"), "_offset", *(["_carried"] if value is not None else [])))
    same = F.col("_part") == F.col("_c_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    joined = parts.join(carry, same, "left").withColumn("_offset", F.coalesce("_offset", F.lit(0)))
    out: list[Column] = [*[F.col(c) for c in columns], (F.col("_number") + F.col("_offset")).alias(name)]
    if value is not None:
        own = F.when(F.col("_prior").isNotNull(), F.struct(F.col("_prior_value").alias("value"), (F.col("_prior") + F.col("_offset")).alias(name)))
        out.append(F.least("_carried", own).alias("prior"))
    return joined.select(*out)
