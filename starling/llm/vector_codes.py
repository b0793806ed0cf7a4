"""Codes of a few bytes for vectors: product quantisation in exact integers.

Each vector is cut into equal parts; each part position has a codebook, improved by
rounds of assigning parts to their nearest entries and taking means. The parts of each
position are sorted along a Hilbert curve once and stored as flat blocks with the box around
their points and the points' sums. A round then works block by block: distances from the box to all entries bound
each entry from below and above, and only entries whose nearest corner is no farther than
the best entry's farthest one are short-listed for the exact kernel. A block with one entry on its list
is assigned whole, from its stored sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Points in a block, and blocks whose boxes are compared with all entries at once.
BLOCK, AT_ONCE = 128, 32
#: Bits of each component in the Hilbert order, which decides speed only.
CURVE_BITS = 4


def hilbert_keys(cells: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Places along the Hilbert curve of points (n, d) with components of `bits` bits, as rows of bytes
    that compare like the places (Skilling's transposed form, all points at once)."""
    n, d = cells.shape
    x = cells.astype(np.uint8, copy=True)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint8(q - 1)
        for i in range(d):
            far = (x[:, i] & q) != 0
            x[:, 0] ^= np.where(far, low, 0).astype(np.uint8)
            swap = np.where(far, 0, (x[:, 0] ^ x[:, i]) & low).astype(np.uint8)
            x[:, 0] ^= swap
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, np.uint8)
    q = 1 << (bits - 1)
    while q > 1 and d:
        turn ^= np.where(x[:, d - 1] & q, q - 1, 0).astype(np.uint8)
        q >>= 1
    x ^= turn[:, None]
    planes = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)], axis=1).reshape(n, bits * d)
    return np.packbits(planes, axis=1)


_BLOCK = pa.schema([("pos", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("points", pa.binary()),
                    ("low", pa.binary()), ("high", pa.binary()), ("sums", pa.binary())])
_BLOCK_DDL = "pos int, n int, ids binary, points binary, low binary, high binary, sums binary"


def blocks(numbered: DataFrame, width: int, reach: int, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """The flat blocks of all part positions. `reach` bounds the components' magnitude, `width` is a part's length."""
    schema = pa.schema([("pos", pa.int32()), ("key", pa.binary()), ("row", pa.int64()), ("point", pa.binary())])

    def cut_up(batches):
        for batch in batches:
            for rows in (batch.slice(a, 4096) for a in range(0, batch.num_rows, 4096)):
                whole, number = _matrix(rows.column("ints"), parts * width), rows.column("row")
                for pos in range(parts):
                    part = whole[:, pos * width : (pos + 1) * width]
                    cells = (part + reach) * ((1 << CURVE_BITS) - 1) // max(2 * reach, 1)
                    keys = [k.tobytes() for k in hilbert_keys(cells)]
                    yield pa.RecordBatch.from_arrays([pa.array([pos] * len(part), pa.int32()), pa.array(keys, pa.binary()), number,
                                                      pa.array([p.tobytes() for p in part.astype("<i4")], pa.binary())], schema=schema)

    def gather(batches):
        now, ids, points = None, [], []

        def whole() -> pa.RecordBatch:
            x = np.frombuffer(b"".join(points), "<i4").reshape(len(points), width).astype(np.int64)
            low, high = (x.min(axis=0), x.max(axis=0)) if width else (x[0], x[0])
            cells = [[now], [len(ids)], [np.array(ids, "<i8").tobytes()], [b"".join(points)], *([v.astype("<i8").tobytes()] for v in (low, high, x.sum(axis=0)))]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, _BLOCK)], schema=_BLOCK)

        for batch in batches:
            for pos, row, point in zip(*(batch.column(c).to_pylist() for c in ("pos", "row", "point"))):
                if ids and (pos != now or len(ids) == block):
                    yield whole()
                    ids, points = [], []
                now = pos
                ids.append(row)
                points.append(point)
        if ids:
            yield whole()

    spread = numbered.select("row", "ints").mapInArrow(cut_up, "pos int, key binary, row long, point binary")
    order = ["pos", "key", "row"]  # rows are told apart, so that a vector held by very many rows is still dealt out
    dealt = spread.repartitionByRange(common.parallelism(numbered.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.select("pos", "row", "point").mapInArrow(gather, _BLOCK_DDL)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows, filled up with zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    start = np.cumsum(size) - size
    out[np.repeat(np.arange(len(column)), size), np.arange(len(flat)) - np.repeat(start, size)] = flat
    return out


def short_lists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """For boxes (b, d) and entries (e, d): which entries can be nearest, ties included, to a point in the box."""
    under, over = low[:, None, :] - book[None], book[None] - high[:, None, :]
    near = (np.maximum(np.maximum(under, over), 0) ** 2).sum(axis=2)
    far = (np.maximum(np.abs(under), np.abs(over)) ** 2).sum(axis=2)
    return near <= far.min(axis=1, keepdims=True)


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point (the first of equals) and its squared distance, exactly: in doubles
    where every intermediate result is below 2^53, else in 64-bit integers."""
    most = int(max(np.abs(points).max(initial=0), np.abs(book).max(initial=0)))
    small = points.shape[1] * (2 * most) ** 2 < 1 << 53
    x, y = (points.astype(float), book.astype(float)) if small else (points, book)
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]
    best = d.argmin(axis=1)
    return best, d[np.arange(len(d)), best].astype(np.int64)


def _listed(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple[int, pa.StructScalar, np.ndarray]]:
    """(pos, the block's cells, its short-listed entries) of each block."""
    width = books.shape[2]
    for rows in (batch.slice(a, AT_ONCE) for a in range(0, batch.num_rows, AT_ONCE)):
        pos = rows.column("pos").to_numpy()
        low, high = (np.frombuffer(b"".join(rows.column(c).to_pylist()), "<i8").reshape(len(pos), width) for c in ("low", "high"))
        for p in np.unique(pos):
            at = np.flatnonzero(pos == p)
            for i, wanted in zip(at, short_lists(low[at], high[at], books[p])):
                yield int(p), {c: rows.column(c)[int(i)].as_py() for c in ("ids", "points", "sums")}, np.flatnonzero(wanted)


def _points(cells: dict, width: int) -> np.ndarray:
    return np.frombuffer(cells["points"], "<i4").reshape(len(cells["ids"]) // 8, width).astype(np.int64)


def improve(flat: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: each task adds up its blocks for each entry; at most parts x entries sums reach the driver."""
    parts, entries, width = books.shape

    def add_up(batches):
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for pos, cells, listed in _listed(batch, books):
                if len(listed) == 1:
                    n[pos, listed[0]] += len(cells["ids"]) // 8
                    total[pos, listed[0]] += np.frombuffer(cells["sums"], "<i8")
                else:
                    points = _points(cells, width)
                    entry = listed[nearest(points, books[pos][listed])[0]]
                    n[pos] += np.bincount(entry, minlength=entries)
                    np.add.at(total[pos], entry, points)
        pos, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[pos, entry], pa.int64()),
                                          pa.array(list(total[pos, entry]), pa.list_(pa.int64()))], names=["pos", "entry", "n", "total"])

    sums = flat.mapInArrow(add_up, "pos int, entry int, n long, total array<long>").groupBy("pos", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(width)]).alias("total"))
    better = books.copy()
    for r in sums.collect():
        better[r["pos"], r["entry"]] = [x // r["n"] for x in r["total"]]
    return better


def assign(flat: DataFrame, books: np.ndarray) -> DataFrame:
    """(row, pos, entry, error) of every part."""
    width = books.shape[2]
    schema = pa.schema([("row", pa.int64()), ("pos", pa.int32()), ("entry", pa.int32()), ("error", pa.int64())])

    def find(batches):
        for batch in batches:
            for pos, cells, listed in _listed(batch, books):
                entry, error = nearest(_points(cells, width), books[pos][listed])
                ids = np.frombuffer(cells["ids"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), pos), pa.int32()), pa.array(listed[entry], pa.int32()), pa.array(error)],
                                                 schema=schema)

    return flat.mapInArrow(find, "row long, pos int, entry int, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of each row whose vector is neither null nor holds null or
    non-finite components. The codebooks start from the `entries` smallest ids.

    Repeated rows are coded each. Rows of one id start the codebooks in the order of their vectors; null ids come last and stay null.
    Null labels are one label. Lengths that differ, or that `parts` doesn't divide, are filled up with zeros at the
    end to the next multiple above the longest. An empty table, or one without such a vector, gives an empty result. Distances must
    fit a long: components so large that they might not raise an error that says so."""
    x = F.col(vec_col)
    whole = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    kept = vectors.where(whole).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(label_col).alias("label"), ints.alias("ints"))
    numbered = common.cut(kept, "vectors")
    longest, reach = numbered.agg(F.max(F.size("ints")), F.max(F.array_max(F.transform("ints", F.abs)))).first()
    longest, reach = longest or 0, reach or 0
    width = -(-longest // parts)
    if reach >= 1 << 31 or width * (2 * reach) ** 2 >= 1 << 62:
        raise ValueError(f"squared distances of components up to {reach} in {width} dimensions don't fit a long")
    first = numbered.orderBy(F.asc_nulls_last("id"), "ints", "row").limit(entries).collect()  # `entries` rows at most
    books = np.zeros((parts, max(len(first), 1), width), np.int64)
    for e, r in enumerate(first):
        full = np.zeros(parts * width, np.int64)
        full[: len(r["ints"])] = r["ints"]
        books[:, e] = full.reshape(parts, width)
    flat = common.cut(blocks(numbered, width, reach, parts), "blocks")
    for _ in range(rounds if first else 0):
        books = improve(flat, books)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    code = F.concat(*[F.lpad(F.lower(F.hex(F.max(F.when(F.col("pos") == p, F.col("entry"))).cast("long"))), 2, "0") for p in range(parts)])
    coded = assign(flat, books).groupBy("row").agg(code.alias("code"), F.sum("error").alias("error"))
    named = common.cut(numbered.select("row", "id", "label").join(coded, "row"), "codes")
    by_label = named.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = named.alias("c").join(by_label.alias("l"), F.expr("c.label <=> l.label"))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
