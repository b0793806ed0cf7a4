"""Helpers shared by the operators: text batches, word hashes, packed records,
lineage cuts and connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starling.session import scratch_path

#: Bytes of text that one vectorised step handles at once.
SLICE_BYTES = 4 << 20
#: Bytes of packed records gathered by a task before they are sent on.
FLUSH_BYTES = 16 << 20
#: Members of a group that are compared in one place; larger groups are dealt into blocks.
BLOCK = 4096
#: Words longer than this are hashed one by one.
LONG_WORD = 1024

U8 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1

#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words made of ASCII letters and digits and of all bytes of other scripts.
ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared scratch folder and read it back:
    lineage ends there, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------------------ texts

def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of at most `limit` bytes of `column` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(size.astype(np.int64)), 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def ids(column: pa.Array) -> np.ndarray:
    """The ids as int64; nulls become 0 (look at the column's own validity where it matters)."""
    return pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: close inputs give unrelated outputs."""
    x = x.astype(U8, copy=True)
    x ^= x >> U8(30)
    x *= U8(0xBF58476D1CE4E5B9)
    x ^= x >> U8(27)
    x *= U8(0x94D049BB133111EB)
    x ^= x >> U8(31)
    return x


def powers(n: int, multiplier: int = _MULTIPLIER) -> np.ndarray:
    """multiplier ** (0 .. n-1) modulo 2^64."""
    out = np.full(n, multiplier, dtype=U8)
    out[:1] = 1
    return np.cumprod(out, dtype=U8)


_POWERS = powers(LONG_WORD + 1)


class Words:
    """The words of some texts: `start`, `end` (in `buf`), `doc` (index of the text)
    and `first` (index of the first word of each text, and the total at the end)."""

    def __init__(self, texts: list[bytes], letters: np.ndarray = NOT_SPACE):
        joined = b"\n".join(texts)
        self.buf = np.frombuffer(joined, dtype=np.uint8)
        inside = np.zeros(len(self.buf) + 2, dtype=bool)
        inside[1:-1] = letters[self.buf]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.start, begins)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, longest: int | None = None, slab: int = 1 << 18, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, or of its first `longest` bytes. Every seed is another hash function."""
        out, power = np.empty(len(self), dtype=U8), _POWERS if not seed else powers(LONG_WORD + 1, _MULTIPLIER + (seed << 17))
        end = self.end if longest is None else np.minimum(self.end, self.start + longest)
        size = end - self.start
        for a in range(0, len(self), slab):
            n = np.minimum(size[a : a + slab], LONG_WORD)
            offset = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(offset, n)
            terms = self.buf[np.repeat(self.start[a : a + slab], n) + place].astype(U8)
            terms += U8(1)
            terms *= power[place]
            out[a : a + slab] = np.add.reduceat(terms, offset) if len(n) else 0
        out = mix(out + size.astype(U8) * U8(0xD6E8FEB86659FD93))
        for i in np.flatnonzero(size > LONG_WORD):
            out[i] = xxhash.xxh64_intdigest(self.buf[self.start[i] : end[i]].tobytes(), seed)
        return out

    def grams(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every k consecutive words (in order), and which starts lie in one text."""
        n = len(words) - k + 1
        if n <= 0:
            return np.empty(0, U8), np.empty(0, bool)
        return gram_hashes(words, k), self.doc[:n] == self.doc[k - 1 :]


def gram_hashes(words: np.ndarray, k: int, multiplier: int = _MULTIPLIER) -> np.ndarray:
    n = len(words) - k + 1
    out, power = np.zeros(max(n, 0), dtype=U8), powers(k, multiplier)
    for j in range(k if n > 0 else 0):
        out += words[j : j + n] * power[j]
    return mix(out)


# --------------------------------------------------------- packed records

PACKED = "bucket int, kind int, payload binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def buckets(spark: SparkSession) -> int:
    """Buckets of keys: a few to each shuffle partition, so that they follow the cluster's setting."""
    return 4 * parallelism(spark)


class Packer:
    """Gathers fixed-width records with a 64-bit key and sends one row per bucket of keys:
    far fewer, larger rows than one per record.

    `combine` is applied to what is gathered before it is sent; it returns lists of
    (kind, records, keys), where keys say which bucket a record goes to. Without it,
    all records are of kind 0 and go by their first field."""

    def __init__(self, n: int, combine=None, flush: int = FLUSH_BYTES):
        self.n, self.flush, self.parts, self.held = n, flush, [], 0
        self.combine = combine or (lambda records: [(0, records, records[records.dtype.names[0]])])

    def add(self, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(records):
            self.parts.append(records)
            self.held += records.nbytes
        if self.held >= self.flush:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        gathered = np.concatenate(self.parts)
        self.parts, self.held = [], 0
        for kind, records, keys in self.combine(gathered):
            if not len(records):
                continue
            bucket = (keys % U8(self.n)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, records = bucket[order], records[order]
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            cuts = [*at.tolist(), len(records)]
            parts = [records[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), pa.array([kind] * len(at), pa.int32()), pa.array(parts, pa.binary())],
                                             schema=_PACKED)


def by_bucket(df: DataFrame) -> DataFrame:
    """Rows of one bucket together, one bucket after the other."""
    return df.repartition("bucket").sortWithinPartitions("bucket")


def bucket_records(batches: Iterable[pa.RecordBatch], *dtypes: np.dtype) -> Iterator[list[np.ndarray]]:
    """The records of each bucket, an array for each kind; one bucket is held at a time.
    Those of kind 0 are sorted by their first field."""
    now, parts = None, [[] for _ in dtypes]

    def whole() -> list[np.ndarray]:
        out = [np.frombuffer(b"".join(p), dtype=t) for p, t in zip(parts, dtypes)]
        out[0] = out[0][np.argsort(out[0][dtypes[0].names[0]], kind="stable")]
        return out

    for batch in batches:
        for bucket, kind, payload in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "payload"))):
            if bucket != now and now is not None:
                yield whole()
                parts = [[] for _ in dtypes]
            now = bucket
            parts[kind].append(payload)
    if now is not None:
        yield whole()


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys starts and ends."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return start, np.append(start[1:], len(keys))


def no_rows(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([], schema=schema)


# ---------------------------------------------------- connected components

def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of an undirected graph given as edges (a, b) of longs; a
    component is named by its smallest node. Alternating large-star and small-star
    steps: each round is two grouped minima and two joins over at most as many edges
    as before, cut by a checkpoint, until no edge changes."""
    now = edges.where("a != b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct().checkpoint()
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.selectExpr("b AS a", "a AS b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m")
        large = both.join(low, "a").where("b > a").selectExpr("b AS a", "m AS b").where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").selectExpr("b AS a", "m AS b").where("a != b").unionByName(low.selectExpr("a", "m AS b"))
        now = small.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct().checkpoint()
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(xxhash64(b, a) % 1000003)")).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.selectExpr("a AS node", "b AS component").unionByName(now.selectExpr("b AS node", "b AS component").distinct())


def block_pairs(members: DataFrame, key: str, member: str, block: int = BLOCK) -> DataFrame:
    """Deal each group's members into blocks of about `block`, and send every member to
    each pair of blocks it belongs to: columns key, i, j, and the members' own. All pairs of
    a group then meet somewhere, and no task holds more than two blocks of it."""
    sizes = members.groupBy(key).agg(F.count("*").alias("_n"))
    dealt = (members.join(sizes, key)
             .withColumn("_of", F.ceil(F.col("_n") / F.lit(block)).cast("int"))
             .withColumn("_c", F.expr(f"cast(pmod(xxhash64({member}), _of) AS int)"))
             .withColumn("_o", F.explode(F.expr("sequence(0, _of - 1)"))))
    return (dealt.withColumn("i", F.least("_c", "_o")).withColumn("j", F.greatest("_c", "_o"))
            .drop("_n", "_of", "_c", "_o"))
