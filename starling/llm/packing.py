"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Pieces of a full sequence are sequences of their own. The shorter ones are dealt by
hash into neighbourhoods of a bounded size; each is packed by several islands, one
task each. A solution is a set of bins. Crossover injects whole well-filled bins of one
parent into the other, removes the bins that now hold a piece twice, and best-fits the
displaced pieces. An epoch goes on until the lower bound is met or `STALL` generations bring
no better solution. Between epochs each island's elite migrates to the next one; epochs end
when a migration brings no fewer bins. Bins that
aren't full enough are opened again and their pieces dealt into fewer neighbourhoods,
until one is left or no bin could be closed; so no neighbourhood's last bin stays half empty."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.llm.common import cut, slices
from starling.llm.encoding import Encoder, tokenizer_path

#: Pieces that a neighbourhood has on average.
NEIGHBOURHOOD = 3000
ISLANDS, POPULATION = 3, 12
#: Generations in a row without a better solution after which an island's epoch ends.
STALL = 40
#: Bins filled to this share stay closed between rounds.
CLOSED = 0.995


def pieces(docs: DataFrame, path: str | None = None, leading_space: bool = False, end_id: int = 1, capacity: int = 4096,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, id, piece, start, length, ids_crc32): each document's ids with `end_id` appended,
    cut into pieces of `capacity` where it is longer. `key` is unique to a piece."""
    path = path or tokenizer_path("word_bpe_49k.json")
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def tokenize(batches):
        from pyspark import TaskContext

        encoder = Encoder.of(path, leading_space)
        end, number = np.array([end_id], encoder.width).tobytes(), TaskContext.get().partitionId() << 40
        for rows in slices(batches, "text"):
            out = []
            for i, value in zip(rows.column("id").to_pylist(), encoder.values([t or "" for t in rows.column("text").to_pylist()])):
                ids = np.frombuffer(value + end, encoder.width).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    out.append((number, i, k, at, len(part), zlib.crc32(part.tobytes())))
                    number += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(tokenize, "key long, id long, piece int, start long, length long, ids_crc32 long")


# ----------------------------------------------------- one neighbourhood

def _best_fit(bins: list[list[int]], room: list[int], items: list[int], size: list[int], capacity: int) -> None:
    """Put items, largest first, each into the bin with the least room that holds it."""
    free = sorted((r, b) for b, r in enumerate(room))
    for i in sorted(items, key=lambda i: -size[i]):
        at = bisect_left(free, (size[i], -1))
        if at < len(free):
            _, b = free.pop(at)
        else:
            b = len(bins)
            bins.append([])
            room.append(capacity)
        bins[b].append(i)
        room[b] -= size[i]
        insort(free, (room[b], b))


def _fitness(room: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; among as many, the one whose filling is more uneven."""
    return -len(room), sum(((capacity - r) / capacity) ** 2 for r in room)


def _crossover(a, b, rng, size, capacity):
    """Bins of `b` that are well filled go whole into `a`; a's bins that share a piece with
    them go, and their other pieces are best-fitted."""
    (a_bins, a_room), (b_bins, b_room) = a, b
    order = sorted(range(len(b_bins)), key=lambda k: b_room[k])
    best = order[: max(1, len(order) // 2)]
    chosen = [k for k in best if rng.random() < 0.5] or best[:1]
    taken = {i for k in chosen for i in b_bins[k]}
    bins, room, displaced = [list(b_bins[k]) for k in chosen], [b_room[k] for k in chosen], []
    for content, r in zip(a_bins, a_room):
        if taken.isdisjoint(content):
            bins.append(list(content))
            room.append(r)
        else:
            displaced += [i for i in content if i not in taken]
    _best_fit(bins, room, displaced, size, capacity)
    return bins, room


def _mutate(one, rng, size, capacity):
    """The emptiest bins and a few random ones are opened and their pieces best-fitted."""
    bins, room = one
    order = sorted(range(len(bins)), key=lambda k: -room[k])
    opened = set(order[: max(1, len(order) // 50)]) | {int(k) for k in rng.integers(0, len(bins), 2)}
    kept = [k for k in range(len(bins)) if k not in opened]
    out = [list(bins[k]) for k in kept], [room[k] for k in kept]
    _best_fit(*out, [i for k in opened for i in bins[k]], size, capacity)
    return out


def _seeded(rng, size, capacity):
    """Best fit of the pieces in falling order, disturbed at random."""
    bins, room = [], []
    noise = rng.uniform(0.9, 1.1, len(size))
    order = sorted(range(len(size)), key=lambda i: -size[i] * noise[i])
    free: list = []
    for i in order:
        at = bisect_left(free, (size[i], -1))
        if at < len(free):
            _, b = free.pop(at)
        else:
            b = len(bins)
            bins.append([])
            room.append(capacity)
        bins[b].append(i)
        room[b] -= size[i]
        insort(free, (room[b], b))
    return bins, room


def _to_array(one, n: int) -> np.ndarray:
    out = np.empty(n, "<i4")
    for b, content in enumerate(one[0]):
        out[content] = b
    return out


def _from_array(assignment: np.ndarray, size: list[int], capacity: int):
    bins: list = [[] for _ in range(int(assignment.max()) + 1)]
    for i, b in enumerate(assignment.tolist()):
        bins[b].append(i)
    return bins, [capacity - sum(size[i] for i in content) for content in bins]


def evolve(size: list[int], capacity: int, seed: int, migrants=()):
    """One island's epoch over one neighbourhood: the best solution it finds."""
    rng = np.random.default_rng(seed)
    floor = -(-sum(size) // capacity)
    first: tuple = ([], [])
    _best_fit(*first, list(range(len(size))), size, capacity)
    population = [first, *migrants]
    key = lambda one: _fitness(one[1], capacity)
    while min(len(one[1]) for one in population) > floor and len(population) < POPULATION + len(migrants):
        population.append(_seeded(rng, size, capacity))
    population.sort(key=key, reverse=True)
    best, still = key(population[0]), 0
    while len(population[0][1]) > floor and still < STALL:  # at the floor, no solution has fewer bins
        a, b = (population[int(k)] for k in rng.choice(len(population), 2, replace=False))
        children = [_crossover(a, b, rng, size, capacity), _crossover(b, a, rng, size, capacity)]
        children.append(_mutate(children[0], rng, size, capacity))
        distinct = {key(one): one for one in reversed([*population, *children])}  # copies of one solution would crowd out the others
        population = sorted(distinct.values(), key=key, reverse=True)[: POPULATION + len(migrants)]
        while len(population) < 2:
            population.append(_seeded(rng, size, capacity))
        still = 0 if key(population[0]) > best else still + 1
        best = key(population[0])
    return population[0]


# ------------------------------------------------------------ distribution

_ELITE = "hood long, island int, bins int, spread double, assignment binary"


def _epoch(items: DataFrame, elites: DataFrame | None, capacity: int, epoch: int) -> DataFrame:
    """Every island of every neighbourhood evolves in a task of its own, from its own elite and
    the one that migrated to it."""
    islands = items.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))

    def run(key, pdf: pd.DataFrame, guests: pd.DataFrame | None) -> pd.DataFrame:
        hood, island = int(key[0]), int(key[1])
        if not len(pdf):
            return pd.DataFrame({"hood": [], "island": [], "bins": [], "spread": [], "assignment": []})
        size = pdf.sort_values("key")["length"].tolist()
        migrants = [_from_array(np.frombuffer(x, "<i4"), size, capacity) for x in (guests["assignment"] if guests is not None else ())]
        best = evolve(size, capacity, (hood * 1009 + island * 31 + epoch) & 0x7FFFFFFF, migrants)
        bins, spread = _fitness(best[1], capacity)
        return pd.DataFrame({"hood": [hood], "island": [island], "bins": [-bins], "spread": [spread],
                             "assignment": [_to_array(best, len(size)).tobytes()]})

    if elites is None:
        return islands.groupBy("hood", "island").applyInPandas(lambda key, pdf: run(key, pdf, None), _ELITE)
    moved = elites.withColumn("island", F.explode(F.array("island", ((F.col("island") + 1) % ISLANDS).cast("int"))))
    return islands.groupBy("hood", "island").cogroup(moved.groupBy("hood", "island")).applyInPandas(run, _ELITE)


def _pack(items: DataFrame, hoods: int, capacity: int, round_: int) -> DataFrame:
    """(key, length, hood, bin): the best of all islands' solutions for each neighbourhood."""
    dealt = cut(items.select("key", "length", F.pmod(F.xxhash64("key", F.lit(round_)), F.lit(hoods)).alias("hood")), "hoods")
    elites, bins, epoch = None, None, 0
    while True:
        elites = _epoch(dealt, elites, capacity, epoch).checkpoint()
        now = elites.groupBy("hood").agg(F.min("bins").alias("n")).agg(F.sum("n")).first()[0]
        if bins is not None and now >= bins:  # the guests of this epoch brought no fewer bins
            break
        bins, epoch = now, epoch + 1
    best = (elites.groupBy("hood").agg(F.max_by("assignment", F.struct(-F.col("bins"), "spread", -F.col("island"))).alias("assignment")))

    def place(key, pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        pdf["bin"] = np.frombuffer(found["assignment"].iloc[0], "<i4") if len(found) else []
        return pdf[["key", "length", "hood", "bin"]]

    return dealt.groupBy("hood").cogroup(best.groupBy("hood")).applyInPandas(place, "key long, length long, hood long, bin int")


def pack(docs: DataFrame, capacity: int = 4096, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of each document.

    Every id of every document is in exactly one piece, pieces of a sequence lie gapless
    from offset 0, and no sequence is over `capacity`. A null or empty text is just the end id;
    a null id stays null; repeated rows are packed each; an empty table gives no row."""
    spark = docs.sparkSession
    all_pieces = cut(pieces(docs, capacity=capacity, id_col=id_col, **options), "pieces")
    open_, done = all_pieces.where(F.col("length") < capacity).select("key", "length"), None
    n, hoods, round_ = open_.count(), None, 0
    while n:
        fewer = max(1, -(-n // NEIGHBOURHOOD))
        hoods = fewer if hoods is None else min(fewer, hoods - 1)
        packed = cut(_pack(open_, hoods, capacity, round_), "packed")
        filled = packed.groupBy("hood", "bin").agg(F.sum("length").alias("filled"))
        marked = packed.join(filled, ["hood", "bin"]).withColumn("round", F.lit(round_))
        left = cut(marked.where(F.col("filled") < F.lit(CLOSED) * capacity).select("key", "length"), "open")
        still_open = left.count()
        last = hoods == 1 or still_open == n  # one neighbourhood, or no bin was filled
        closed = marked if last else marked.where(F.col("filled") >= F.lit(CLOSED) * capacity)
        closed = closed.select("key", F.expr("struct(round, hood, bin)").alias("sequence"))
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        open_, n, round_ = left, still_open, round_ + 1
    # sequence numbers: round, neighbourhood and bin side by side; full pieces count down by their own key
    number = F.expr("(sequence.round * 10000000000L + sequence.hood) * 100000L + sequence.bin")
    full = all_pieces.where(F.col("length") >= capacity).select("key", (-1 - F.col("key")).alias("sequence_id"))
    numbered = full if done is None else done.select("key", number.alias("sequence_id")).unionByName(full)
    placed = all_pieces.join(numbered, "key")
    from pyspark.sql import Window

    before = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "key").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id",
                         F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
