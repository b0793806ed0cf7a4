"""Distributed Bloom filters, and the disjointness of large text sets through them.

A filter's bits are set in the tasks that hold the keys; the tasks' arrays are cut into slices,
which are merged by OR on the executors. Its size follows from the number of keys and is bounded: beyond
``MOST_BYTES`` it lets more strangers pass, and never loses a member. What passes is checked exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strangers let through by a filter of full size, its size at most, and bytes of a slice.
FALSE_POSITIVES, MOST_BYTES, SLICE = 0.01, 32 << 20, 1 << 18


class Bloom:
    """A filter over 64-bit hashes: the bits, and how many of them a key sets."""

    def __init__(self, bits: np.ndarray, n_hashes: int):
        self.bits, self.n_hashes = bits, n_hashes

    @staticmethod
    def places(hashes: np.ndarray, n_bits: int, n_hashes: int) -> Iterator[np.ndarray]:
        h = hashes.astype(np.uint64)
        step = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17) | np.uint64(1)
        for i in range(n_hashes):
            yield ((h + np.uint64(i) * step) % np.uint64(n_bits)).astype(np.int64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self.places(hashes, 8 * len(self.bits), self.n_hashes):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def shape(n_keys: int, false_positives: float = FALSE_POSITIVES, most_bytes: int = MOST_BYTES) -> tuple[int, int]:
    """(bytes, hashes) of a filter for so many keys."""
    n_bytes = math.ceil(-max(n_keys, 1) * math.log(false_positives) / math.log(2) ** 2 / 8)
    n_bytes = max(64, min(n_bytes, most_bytes))
    return n_bytes, max(1, min(16, round(8 * n_bytes / max(n_keys, 1) * math.log(2))))


def build(hashes: DataFrame, n_keys: int, false_positives: float = FALSE_POSITIVES, most_bytes: int = MOST_BYTES) -> Bloom:
    """The filter of a one-column DataFrame of hashes (long)."""
    n_bytes, n_hashes = shape(n_keys, false_positives, most_bytes)
    column = hashes.columns[0]

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = None
        for batch in batches:
            if batch.num_rows:
                flags = np.zeros(8 * n_bytes, bool) if flags is None else flags
                for at in Bloom.places(batch.column(column).to_numpy(zero_copy_only=False), 8 * n_bytes, n_hashes):
                    flags[at] = True
        if flags is not None:
            bits = np.packbits(flags, bitorder="little")
            for k in range(0, n_bytes, SLICE):
                if bits[k : k + SLICE].any():
                    yield pa.RecordBatch.from_arrays([pa.array([k // SLICE], pa.int32()), pa.array([bits[k : k + SLICE].tobytes()], pa.binary())], names=["slice", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(bits, np.uint8)
                merged[k] = merged[k] | own if k in merged else own
        if merged:
            yield pa.RecordBatch.from_arrays([pa.array(list(merged), pa.int32()), pa.array([b.tobytes() for b in merged.values()], pa.binary())], names=["slice", "bits"])

    ddl, out = "slice int, bits binary", np.zeros(n_bytes, np.uint8)
    for r in hashes.mapInArrow(set_bits, ddl).repartition("slice").mapInArrow(merge, ddl).collect():  # `most_bytes` at most
        out[r["slice"] * SLICE : r["slice"] * SLICE + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return Bloom(out, n_hashes)


def passes(spark, bloom: Bloom, hashed: Column) -> Column:
    """Whether the filter lets a hash (long) through."""
    held = spark.sparkContext.broadcast(bloom)  # `most_bytes` at most

    @F.arrow_udf("boolean")
    def probe(h: pa.Array) -> pa.Array:
        return pa.array(held.value.holds(h.to_numpy(zero_copy_only=False)))

    return probe(hashed)


def shared_rows(df: DataFrame, key: str, member: str, false_positives: float = FALSE_POSITIVES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be in more than one set (``member`` names a row's set): all that truly are, and
    few others. The largest set is probed by a filter of all the others; what passes makes the filter that probes these.

    Null keys are left out. Nothing is shuffled but filters; sizes are counted first, a row for each set."""
    spark, hashed = df.sparkSession, F.xxhash64(key)
    rows = df.where(F.col(key).isNotNull())
    sizes = sorted(rows.groupBy(member).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["n"])
    if len(sizes) < 2:
        return rows.limit(0)
    largest = F.col(member).eqNullSafe(F.lit(sizes[-1][member]))
    small = rows.where(~largest)
    first = build(small.select(hashed.alias("h")), sum(r["n"] for r in sizes[:-1]), false_positives, most_bytes)
    survivors = rows.where(largest).where(passes(spark, first, hashed))
    if len(sizes) > 2:  # the small ones may share keys among themselves, too
        others = small.groupBy(hashed.alias("h")).agg(F.min(member).alias("a"), F.max(member).alias("b")).where("a <> b").select("h")
        keys = survivors.select(hashed.alias("h")).unionByName(others)
    else:
        keys = survivors.select(hashed.alias("h"))
    second = build(keys, keys.count(), false_positives, most_bytes)
    return survivors.unionByName(small.where(passes(spark, second, hashed)))
