"""SimHash near duplicates by fuzzy hashing with the binary Golay code.

A 64-bit fingerprint is cut into A (23 bits), B (23) and C (18). The perfect Golay code
[23, 12, 7] decodes any 23 bits to one of 4096 codewords. The keys of a 23-bit
segment are the words that it and its 23 one-bit neighbours decode to (one to six of
them); two segments at two or fewer bits' distance share a key, as some neighbour lies
between them. With 3 or fewer bits between two fingerprints, at least one of these holds
(a, b, c: bits that differ in A, B, C):

    c = 0 and a <= 2      key of A, and C as it is
    a = 3, so b = c = 0   B and C as they are
    b = 0 and a <= 2      key of A, and B as it is
    a = 0 and b <= 2      key of B, and A as it is
    a = b = c = 1         key of A, and a half of B and a half of C as they are
                          (one half of each is untouched)

So candidates are complete. Fingerprints that share a key meet in one task and are verified bit
by bit; only a spanning forest of the links is kept, never all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from starling.llm import common
from starling.llm.common import U8

MAX_DISTANCE = 3
#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
_SLAB = 1 << 16
_RECORD = np.dtype([("key", "<u8"), ("fp", "<u8")])


# ------------------------------------------------------------ fingerprints

def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text, A-Z lower-cased."""
    parts = text.lower().split()  # bytes: ASCII letters and white space only
    if not parts:
        return 0
    joined, n = b" ".join(parts), len(parts)
    begin, at = [], 0
    for p in parts:
        begin.append(at)
        at += len(p) + 1
    if n <= words:
        ends = [len(joined)]
    else:
        ends = [b - 1 for b in begin[words:]] + [len(joined)]
    total, count = np.zeros(64, np.int64), len(ends)
    for s in range(0, count, _SLAB):
        some = np.array([xxh64_intdigest(joined[b:e], seed) for b, e in zip(begin[s : s + _SLAB], ends[s : s + _SLAB])], dtype="<u8")
        total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of each row; fp holds the fingerprint's bits as a long."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def prints(batches):
        for rows in common.slices(batches, "text"):
            got = np.array([fingerprint(t, words, seed) for t in common.utf8(rows.column("text"))], dtype=U8)
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(got.view(np.int64))], schema=schema)

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(prints, "id long, fp long")


# -------------------------------------------------------------- Golay keys

def _syndrome(x: int) -> int:
    for shift in range(22, 10, -1):
        if x >> shift & 1:
            x ^= GENERATOR << (shift - 11)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the upper 12 bits, and the error that belongs to each syndrome (3 bits at most)."""
    unit = [_syndrome(1 << b) for b in range(23)]
    upper = np.zeros(1 << 12, dtype=np.int32)
    for b in range(12):
        upper[1 << b : 2 << b] = upper[: 1 << b] ^ unit[11 + b]
    error = np.zeros(1 << 11, dtype=np.int32)
    for i in range(23):
        error[unit[i]] = 1 << i
        for j in range(i):
            error[unit[i] ^ unit[j]] = 1 << i | 1 << j
            for k in range(j):
                error[unit[i] ^ unit[j] ^ unit[k]] = 1 << i | 1 << j | 1 << k
    return upper, error


_UPPER, _ERROR = _tables()


def decode(x: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit segment."""
    return (x ^ _ERROR[_UPPER[x >> 11] ^ (x & 0x7FF)]) >> 11


def golay_keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each segment: (index of the segment, key), without repeats."""
    near = np.stack([x, *(x ^ (1 << b) for b in range(23))], axis=1)
    found = np.sort(decode(near), axis=1)
    first = np.ones(found.shape, dtype=bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(first)[0], found[first]


def candidate_keys(fp: np.ndarray) -> np.ndarray:
    """Records (key, fingerprint): any two fingerprints at 3 or fewer bits share a key."""
    a, b, c = (fp & U8(0x7FFFFF)).astype(np.int32), (fp >> U8(23) & U8(0x7FFFFF)).astype(np.int32), (fp >> U8(46)).astype(np.int32)
    ia, ka = golay_keys(a)
    ib, kb = golay_keys(b)
    halves_b, halves_c = (b & 0x7FF, b >> 11), (c & 0x1FF, c >> 9)
    families = [(ia, ka, c[ia], 18), (np.arange(len(fp)), b, c, 18), (ia, ka, b[ia], 23), (ib, kb, a[ib], 23)]
    families += [(ia, ka, halves_b[i][ia] << 9 | halves_c[j][ia], 21) for i in (0, 1) for j in (0, 1)]
    out = []
    for number, (i, key, exact, bits) in enumerate(families):
        made = np.empty(len(i), _RECORD)
        made["key"] = common.mix((U8(number) << U8(60)) | (key.astype(U8) << U8(bits)) | exact.astype(U8))
        made["fp"] = fp[i]
        out.append(made)
    return np.concatenate(out)


# ------------------------------------------------------------------- links

def forest(fp: np.ndarray, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected at `limit` or fewer bits: each found member
    is compared with those not yet reached, which are ever fewer."""
    out, rest = [], fp
    while len(rest) > 1:
        ahead, rest = [rest[0]], rest[1:]
        while ahead and len(rest):
            x = ahead.pop()
            near = np.bitwise_count(rest ^ x) <= limit
            if near.any():
                hit = rest[near]
                out.append((np.full(len(hit), x, U8), hit))
                ahead += list(hit)
                rest = rest[~near]
    return out


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])


def _links(found: list) -> pa.RecordBatch:
    a = np.concatenate([x for x, _ in found]).view(np.int64)
    b = np.concatenate([y for _, y in found]).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], schema=_LINK)


def linked(distinct: DataFrame, limit: int = MAX_DISTANCE, block: int = common.BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect exactly what
    links of `limit` or fewer bits connect. Groups of more than `block` are dealt into blocks."""
    if not 0 <= limit <= MAX_DISTANCE:
        raise ValueError(f"the keys are complete up to {MAX_DISTANCE} bits, not {limit}")
    n = common.buckets(distinct.sparkSession)

    def send(batches):
        packer = common.Packer(n)
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(U8)
            for at in range(0, len(fp), 1 << 15):
                yield from packer.add(candidate_keys(fp[at : at + (1 << 15)]))
        yield from packer.end()

    def meet(batches):
        for (records,) in common.bucket_records(batches, _RECORD):
            start, stop = common.runs(records["key"])
            size = stop - start
            pair = start[size == 2]
            x, y = records["fp"][pair], records["fp"][pair + 1]
            near = np.bitwise_count(x ^ y) <= limit
            found = [(x[near], y[near])]
            large = []
            for s, e in zip(start[size > 2], stop[size > 2]):
                if e - s > block:
                    large.append(records[s:e])
                else:
                    found += forest(records["fp"][s:e], limit)
            yield _links(found)
            for group in large:  # too many for one place: dealt into blocks below
                fp = group["fp"].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(fp), pa.array(group["key"].view(np.int64))], schema=_LINK)

    def blocks(batches):
        def flush(rows):
            found = forest(np.unique(np.array(rows, np.int64)).view(U8), limit)
            if found:
                yield _links(found)

        now, rows = None, []
        for batch in batches:
            for key, i, j, a in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "a"))):
                if (key, i, j) != now and rows:
                    yield from flush(rows)
                    rows = []
                now = (key, i, j)
                rows.append(a)
        if rows:
            yield from flush(rows)

    met = common.cut(common.by_bucket(distinct.select("fp").mapInArrow(send, common.PACKED)).mapInArrow(meet, "a long, b long, key long")
                     .distinct(), "links")
    large = met.where("key IS NOT NULL").select("key", "a")
    if large.isEmpty():
        return met.select("a", "b")
    dealt = common.block_pairs(large, "key", "a", block).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = dealt.select("key", "i", "j", "a").mapInArrow(blocks, "a long, b long, key long")
    return met.where("key IS NULL").unionByName(more).select("a", "b").distinct()


def simhash_groups(docs: DataFrame, words: int = 3, limit: int = MAX_DISTANCE, seed: int = 42, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of each row: the fingerprint as 16 hexadecimal digits, and
    the smallest id reachable over links of `limit` or fewer bits.

    Texts without words (null, empty, white space) have fingerprint zero and link like any
    other. Null ids are never a component's name unless it has no other. Repeated rows are
    returned each; an empty table gives an empty result."""
    prints = common.cut(fingerprints(docs, words, seed, id_col, text_col), "fingerprints")
    distinct = common.cut(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    found = common.components(linked(distinct, limit))
    named = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, with all their columns, of one document of each group: that with the
    smallest id. Rows that share an id are one document and stay or go together; rows with
    a null id stay."""
    groups = simhash_groups(docs, id_col=id_col, text_col=text_col, **options)
    keep = groups.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("kept")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    own = F.col(f"row.`{id_col}`")
    return rows.join(keep, own == F.col("kept"), "left_semi").unionByName(rows.where(own.isNull())).select("row.*")
