"""Exact top-k inner-product search by norm buckets.

Vectors are dealt by length into buckets, longest first, and packed in blocks. A query
knows a lower bound of its k-th score from the longest block. A pair of blocks whose
longest members can't reach any bound isn't joined at all. Within a pair, the bound over
the two lengths is a local cosine threshold: where it is low, length alone cuts the
block's tail; where it is high, the query's two largest coordinates bound the
coordinates of any vector that can still reach it. What is left is verified by exact
integer products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starling.llm.common import cut

#: Vectors in a packed block of candidates, and queries in one of queries.
BLOCK, QUERIES = 2048, 256
#: Local cosine thresholds from which coordinates prune better than length.
COORDINATE_FROM = 0.35
_EXACT = float(1 << 53)

_BLOCK_SCHEMA = pa.schema([("longest", pa.float64()), ("n", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()),
                           ("parts", pa.binary()), ("low", pa.float64())])
_BLOCK_DDL = "longest double, n int, dim int, ids binary, parts binary, low double"


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, v, norm): components as floor(scale * x); rows with a null id, a null vector or a
    null or non-finite component are left out, exact repeats are one row."""
    x = F.col("v")
    good = x.isNotNull() & F.col("id").isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
            .where(good)
            .withColumn("v", F.transform("v", lambda c: F.floor(c * scale).cast("long")))
            .dropDuplicates(["id", "v"])
            .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))))


def _pack(size: int):
    def pack(batches):
        held: list = []

        def block(rows):
            dim = max(len(r[1]) for r in rows)
            parts = np.zeros((len(rows), dim), dtype=np.int64)
            for i, r in enumerate(rows):
                parts[i, : len(r[1])] = r[1]
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[0][2]]), pa.array([len(rows)], pa.int32()), pa.array([dim], pa.int32()),
                 pa.array([np.array([r[0] for r in rows], np.int64).tobytes()]), pa.array([parts.tobytes()]),
                 pa.array([float("-inf")])], schema=_BLOCK_SCHEMA)

        for batch in batches:
            held += zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), batch.column("norm").to_pylist())
            while len(held) >= size:
                yield block(held[:size])
                held = held[size:]
        if held:
            yield block(held)

    return pack


def _matrix(dim: int, ids: bytes, parts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(parts, np.int64).reshape(-1, dim)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; through doubles where these hold them exactly."""
    dim = min(a.shape[1], b.shape[1])  # vectors of unlike length: what one lacks counts as zero
    a, b = a[:, :dim], b[:, :dim]
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * max(dim, 1) < _EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best of some scores, ties to smaller ids."""
    if len(score) > 4 * k:
        keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return keep[np.lexsort((ids[keep], -score[keep]))][:k]
    return np.lexsort((ids, -score))[:k]


def search_block(q_ids, q, low, c_ids, c, k: int):
    """The k best candidates of a block for each query that may reach its bound `low`:
    lists of (query index, candidate indices, scores)."""
    q_norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    c_norm = np.sqrt((c.astype(np.float64) ** 2).sum(axis=1))
    slack = 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(low > 0, low / np.maximum(q_norm, 1e-300), 0.0)  # length a candidate must have
        cosine = np.where(low > 0, need / c_norm.max(), -1.0) if len(c) else np.full(len(q), 2.0)
        unit = np.where(c_norm[:, None] > 0, c / c_norm[:, None], 0.0)
    dim = min(q.shape[1], c.shape[1])
    out = []
    by_length = np.flatnonzero((cosine <= 1 + slack) & ((cosine < COORDINATE_FROM) | (dim < 2)))
    by_parts = np.flatnonzero((cosine <= 1 + slack) & (cosine >= COORDINATE_FROM)) if dim >= 2 else []
    order = np.argsort(-c_norm, kind="stable")
    for rows in np.array_split(by_length, max(1, len(by_length) // 64)) if len(by_length) else []:
        # candidates in falling length: those long enough for the least demanding query come first
        n = int(np.searchsorted(-c_norm[order], -(need[rows].min() * (1 - slack)), "right"))
        some = order[:n]
        score = _products(q[rows], c[some])
        for i, r in enumerate(rows):
            keep = np.flatnonzero((score[i] >= low[r]) & (c_ids[some] != q_ids[r]))
            best = keep[_best(score[i][keep], c_ids[some[keep]], k)]
            out.append((r, some[best], score[i][best]))
    for r in by_parts:
        n = int(np.searchsorted(-c_norm[order], -(need[r] * (1 - slack)), "right"))
        some = order[:n]
        t = min(float(cosine[r]), 1.0)
        direction = q[r][:dim] / q_norm[r]
        for f in np.argsort(-np.abs(direction))[:2]:
            x = float(direction[f])
            reach = np.sqrt(max(0.0, 1 - x * x) * (1 - t * t)) + 1e-9
            if x >= t:
                upper = 1.0 + 1e-9  # the whole cap around the axis is within reach
                lower = x * t - reach
            elif -x >= t:
                lower, upper = -1.0 - 1e-9, x * t + reach
            else:
                lower, upper = x * t - reach, x * t + reach
            some = some[(unit[some, f] >= lower) & (unit[some, f] <= upper)]
        if len(some):
            score = _products(q[r : r + 1], c[some])[0]
            keep = np.flatnonzero((score >= low[r]) & (c_ids[some] != q_ids[r]))
            best = keep[_best(score[keep], c_ids[some[keep]], k)]
            out.append((r, some[best], score[best]))
    return out


def top_k(vectors: DataFrame, queries: str = "id % 20 = 0", k: int = 20, id_col: str = "vec_id",
          vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector that the SQL condition `queries` (on
    `id`) picks, its k best others by integer inner product, ties to the smaller id.

    Rows with the query's own id aren't candidates. Vectors that are null or hold a null
    or non-finite component take no part, nor do null ids; exact repeats of a row count once;
    of vectors of unlike length the common components count. Fewer candidates give fewer
    ranks; an empty table gives none. Scores must fit in 64 bits."""
    spark = vectors.sparkSession
    rows = cut(valid_vectors(vectors, id_col, vec_col, scale), "vectors")
    sent = F.col("norm").desc(), F.col("id")
    blocks = cut(rows.repartitionByRange(*sent).sortWithinPartitions(*sent).mapInArrow(_pack(BLOCK), _BLOCK_DDL), "blocks")
    asked = rows.where(queries).repartitionByRange(*sent).sortWithinPartitions(*sent).mapInArrow(_pack(QUERIES), _BLOCK_DDL)
    head = blocks.orderBy(F.col("longest").desc(), "ids").limit(1).first()  # one block: at most BLOCK vectors
    if head is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    head_ids, head_parts = _matrix(head["dim"], head["ids"], head["parts"])

    def bounds(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q = _matrix(row["dim"], row["ids"], row["parts"])
                low = np.full(len(q), -np.inf)
                for r, _, score in search_block(q_ids, q, low, head_ids, head_parts, k):
                    if len(score) == k:
                        low[r] = score[-1]
                reach = np.where(low > 0, low / np.maximum(np.sqrt((q.astype(float) ** 2).sum(axis=1)), 1e-300), 0.0)
                yield pa.RecordBatch.from_pylist([row | {"lows": low.tobytes(), "low": float(reach.min())}], schema=asked_schema)

    asked_schema = pa.schema([*_BLOCK_SCHEMA, ("lows", pa.binary())])
    asked = cut(asked.mapInArrow(bounds, _BLOCK_DDL + ", lows binary"), "queries")

    # pairs of blocks, on their few numbers only; a block too short for every query of the other is left out
    number = Window.orderBy(F.col("longest").desc(), "key")
    named = blocks.withColumn("key", F.xxhash64("ids", "parts"))
    index = cut(named.select("key", "longest").withColumn("no", F.row_number().over(number)), "index")
    n_blocks = index.count()
    q_named = asked.withColumn("q_key", F.xxhash64("ids", "parts"))
    pairs = (q_named.select("q_key", F.col("low").alias("q_low"), F.explode(F.sequence(F.lit(1), F.lit(n_blocks))).alias("no"))
             .join(index, "no").where("longest >= q_low * (1 - 1e-9)").select("q_key", "key"))
    q_side = q_named.select("q_key", F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("parts").alias("q_parts"), "lows")
    joined = pairs.join(q_side, "q_key").join(named.select("key", "dim", "ids", "parts"), "key").drop("key", "q_key")

    out_schema = pa.schema([("query_id", pa.int64()), ("q_no", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def verify(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                q_ids, q = _matrix(row["q_dim"], row["q_ids"], row["q_parts"])
                c_ids, c = _matrix(row["dim"], row["ids"], row["parts"])
                got = search_block(q_ids, q, np.frombuffer(row["lows"]), c_ids, c, k)
                if got:
                    sizes = [len(s) for _, _, s in got]
                    mark = np.array([xxhash.xxh64_intdigest(q[r].tobytes()) >> 1 for r, _, _ in got], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(q_ids[[r for r, _, _ in got]], sizes)), pa.array(np.repeat(mark, sizes)),
                         pa.array(c_ids[np.concatenate([j for _, j, _ in got])]), pa.array(np.concatenate([s for _, _, s in got]))],
                        schema=out_schema)

    best = Window.partitionBy("query_id", "q_no").orderBy(F.col("score").desc(), "vec_id")
    return (joined.repartition(F.col("ids"), F.col("q_ids")).mapInArrow(verify, "query_id long, q_no long, vec_id long, score long")
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
