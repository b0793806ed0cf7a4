"""Full-batch fits of linear models by distributed gradients, with snapshots.

Rows are packed once into sparse blocks (flat index, value and rank arrays) and written to the shared
folder. Every step is one job: each task adds the loss and the gradient of its blocks, all thresholds or
classes of a row at once; the tasks' dense sums are cut into slices, added slice by slice on the executors,
and only the total, as long as the parameters, reaches the driver, which takes an L-BFGS step. The path of steps does
not depend on where it ends, so one run leaves a snapshot at every wanted length.

Losses (means, D11 and D17): ``coral``, the binary cross-entropy of the K-1 thresholds over one projection
with K-1 free biases; ``softmax``, the cross-entropy of the true class. Weights are penalised, biases are not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.session import written

#: Entries of a block (also the most that a task unfolds at once, but for a single longer row), and parameters of a slice.
BLOCK_ENTRIES, SLICE = 1 << 19, 1 << 15
_BLOCK = "n long, counts binary, idx binary, val binary, rank binary"


def dense_sum(df: DataFrame, add: Callable[[Iterable[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray | None:
    """The sum of what ``add`` returns in each task: vectors of one length, or none from a task without rows."""
    names = ["slice", "part"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = add(batches)
        for k in range(0, 0 if total is None else len(total), SLICE):
            yield pa.RecordBatch.from_arrays([pa.array([k // SLICE], pa.int32()), pa.array([total[k : k + SLICE].tobytes()], pa.binary())], names=names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(part)
                sums[k] = sums[k] + own if k in sums else own
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=names)

    ddl = "slice int, part binary"
    rows = df.mapInArrow(cut, ddl).repartition("slice").mapInArrow(join, ddl).collect()  # as long as one vector
    return np.concatenate([np.frombuffer(r["part"]) for r in sorted(rows, key=lambda r: r["slice"])]) if rows else None


def row_runs(lists: pa.Array, entries: int) -> Iterator[pa.Array]:
    """The lists cut into runs of rows of at most ``entries`` elements (one row at least)."""
    total, at = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(lists):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + entries, "right")))
        yield lists.slice(at, stop - at)
        at = stop


def pack(rows: DataFrame, idx: str = "idx", rank: str = "rank", val: str | None = None, entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(idx array<int>, [val array<double>,] rank) rows as blocks; an index that a row repeats is added up."""
    wanted = rows.select(F.col(idx).alias("idx"), F.col(rank).cast("long").alias("rank"), *([F.col(val).alias("val")] if val else []))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            cells = [sum(len(h[0]) for h in held)] + [np.concatenate([h[k] for h in held]).tobytes() for k in range(4)]
            return pa.RecordBatch.from_arrays([pa.array([c]) for c in cells], names=["n", "counts", "idx", "val", "rank"])

        for batch in batches:
            at = 0
            for lists in row_runs(batch.column("idx"), entries):
                n, own = len(lists), batch.slice(at, len(lists))
                at += n
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(n), sizes)
                value = own.column("val").flatten().to_numpy(zero_copy_only=False) if val else np.ones(len(flat))
                key, where = np.unique((row << 32) | flat, return_inverse=True)
                value = np.bincount(where, value, len(key)) if len(key) else np.empty(0)
                held.append((np.bincount(key >> 32, minlength=n).astype("<i8"), (key & 0xFFFFFFFF).astype("<i4"), value.astype("<f8"),
                             own.column("rank").to_numpy(zero_copy_only=False).astype("<i8")))
                size += len(key)
                if size >= entries:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    return written(wanted.mapInArrow(gather, _BLOCK), "blocks")


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(row of each entry, idx, val, rank of each row) of each block."""
    for batch in batches:
        for cells in zip(*(batch.column(c) for c in ("counts", "idx", "val", "rank"))):
            counts, idx, val, rank = (np.frombuffer(c.as_buffer(), t) for c, t in zip(cells, ("<i8", "<i4", "<f8", "<i8")))  # no copies
            yield np.repeat(np.arange(len(counts)), counts), idx, val, rank


def feature_scales(blocks: DataFrame, width: int) -> np.ndarray:
    """1 / root mean square of each feature over all rows (0 where it never occurs)."""

    def add(batches):
        out = None
        for row, idx, val, rank in _unpacked(batches):
            out = np.zeros(width + 1) if out is None else out
            out[:-1] += np.bincount(idx, val * val, width)
            out[-1] += len(rank)
        return out

    total = dense_sum(blocks, add)
    if total is None:
        return np.zeros(width)
    squares = total[:-1] / total[-1]
    return np.where(squares > 0, 1 / np.sqrt(np.maximum(squares, 1e-300)), 0.0)


@dataclass
class Linear:
    """Scores ``x @ weights + biases``; weights (features, m), m = 1 for ``coral``."""

    loss: str
    weights: np.ndarray
    biases: np.ndarray


def _loss_of(loss: str, z: np.ndarray, biases: np.ndarray, rank: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
    """(loss, its gradient by z, its gradient by the biases, terms) of rows with projections z (n, m), all as sums."""
    if loss == "coral":
        logits = z + biases[None, :]
        target = (rank[:, None] > np.arange(len(biases))[None, :]).astype(float)
        total = np.maximum(logits, 0) - logits * target + np.log1p(np.exp(-np.abs(logits)))
        slope = 0.5 * (1 + np.tanh(0.5 * logits)) - target
        return float(total.sum()), slope.sum(axis=1, keepdims=True), slope.sum(axis=0), slope.size
    logits = z + biases[None, :]
    top = logits.max(axis=1, keepdims=True)
    e = np.exp(logits - top)
    share = e / e.sum(axis=1, keepdims=True)
    at = np.arange(len(rank))
    total = (np.log(e.sum(axis=1)) + top[:, 0] - logits[at, rank]).sum()
    share[at, rank] -= 1
    return float(total), share, share.sum(axis=0), len(rank)


def evaluate(blocks: DataFrame, model: Linear, scales: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Mean penalised loss and its gradient by (weights, biases), over scaled features."""
    d, m = model.weights.shape
    held = blocks.sparkSession.sparkContext.broadcast((model, scales))  # as long as the parameters

    def add(batches):
        out, (now, scale) = None, held.value
        for row, idx, val, rank in _unpacked(batches):
            out = np.zeros(d * m + len(now.biases) + 2) if out is None else out
            x = val * scale[idx]
            z = np.stack([np.bincount(row, x * now.weights[idx, k], len(rank)) for k in range(m)], axis=1) if len(rank) else np.zeros((0, m))
            total, by_z, by_bias, terms = _loss_of(now.loss, z, now.biases, rank)
            grad = out[: d * m].reshape(d, m)
            for k in range(m):
                grad[:, k] += np.bincount(idx, x * by_z[row, k], d)
            out[d * m : -2] += by_bias
            out[-2:] += (total, terms)
        return out

    got = dense_sum(blocks, add)
    held.destroy()
    if got is None:
        return 0.0, np.zeros(d * m + len(model.biases))
    grad = got[:-2] / got[-1]
    flat = model.weights.reshape(-1)
    grad[: d * m] += penalty * flat
    return got[-2] / got[-1] + 0.5 * penalty * float(flat @ flat), grad


def fit(blocks: DataFrame, loss: str, width: int, classes: int, lengths: Sequence[int], penalty: float = 0.01, scales: np.ndarray | None = None,
        tolerance: float = 1e-5, memory: int = 10) -> dict[int, Linear]:
    """L-BFGS from zero; a model for each wanted length (steps taken). A run that has settled before a length leaves its
    last model there; without rows every model is zero. Weights returned apply to unscaled features."""
    scales = feature_scales(blocks, width) if scales is None else scales
    m, k = (1, classes - 1) if loss == "coral" else (classes, classes)

    def model(theta: np.ndarray) -> Linear:
        return Linear(loss, theta[: width * m].reshape(width, m), theta[width * m :])

    theta = np.zeros(width * m + k)
    value, grad = evaluate(blocks, model(theta), scales, penalty)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    out, settled = {}, False
    for step in range(1, max(lengths) + 1):
        if not settled and grad.any():
            q, used = grad.copy(), []
            for s, y in reversed(pairs):
                a = (s @ q) / (s @ y)
                used.append(a)
                q -= a * y
            q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(float(np.linalg.norm(grad)), 1.0)
            for (s, y), a in zip(pairs, reversed(used)):
                q += s * (a - (y @ q) / (s @ y))
            slope, size = -float(grad @ q), 1.0
            while True:
                ahead = theta - size * q
                new, new_grad = evaluate(blocks, model(ahead), scales, penalty)
                if new <= value + 1e-4 * size * slope or size < 1e-8:
                    break
                size *= 0.5
            if new > value:  # no way down is left
                settled = True
            else:
                s, y = ahead - theta, new_grad - grad
                if s @ y > 1e-12 * float(s @ s):
                    pairs = [*pairs, (s, y)][-memory:]
                settled = value - new <= tolerance * max(abs(value), abs(new), 1e-12)
                theta, value, grad = ahead, new, new_grad
        if step in lengths:
            now = model(theta)
            out[step] = Linear(loss, now.weights * scales[:, None], now.biases.copy())
    return out
