"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are sequences of words. The CGK embedding reads a sequence with a random
walk: at step j it writes the current word and moves on by one or stays, as a
random bit of the word and the step says. Two walks over similar sequences fall into step
again after an edit, so edit distance becomes Hamming distance between what they wrote.

Every window of an item's size, at every word of every document, is read by
the same walks as the items. A repetition samples three coordinates of the embedding:
two near its start, for all windows at once, and one further on, for windows that agree
so far. A window that agrees in all three with an item, and in enough of the whole
embedding, is a candidate. How many repetitions reach the target recall is measured on edited
copies of the items. A candidate is verified by exact bit-parallel edit distance between the item and the best
stretch of words around the window.

A document is read where it lies: nothing is shuffled. Items travel to all tasks in
blocks of a checked size."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.llm import common
from starling.llm.common import ALNUM, U8, Words

#: Edits allowed, as a share of an item's words.
EDITS = 0.1
#: Items of fewer words take no part: a few words in a row are no passage.
MIN_WORDS = 8
RECALL, MOST_REPETITIONS = 0.97, 32
#: Words of all items that are sent to the tasks at once; more items go in several passes.
BLOCK_WORDS = 2_000_000
#: Share of the whole embedding in which a candidate agrees with its item (strangers agree in a few percent).
AGREEMENT = 0.3
#: Bytes of text read at once: the walks over it stay in the processor's cache.
SLICE_BYTES = 1 << 20
_EARLY, _LATE = 6, 12
_END = U8(0)


def words_of(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """Words of letters, digits and other scripts' bytes, A-Z lower-cased, as hashes."""
    words = Words([t.lower() for t in texts], ALNUM)
    return words, np.maximum(words.hashes(), U8(1))


class Sampler:
    """The coordinates and walks of one repetition."""

    def __init__(self, number: int):
        rng = np.random.default_rng(7919 + number)
        self.seed = U8(rng.integers(1, 1 << 62))
        self.early = np.sort(rng.choice(_EARLY, 2, replace=False)).tolist()
        self.late = float(rng.random())

    def late_of(self, n):
        """The third coordinate for items of n words."""
        return (_EARLY + self.late * np.minimum(n, _LATE)).astype(np.int64)

    def bits(self, words: np.ndarray, block: int) -> np.ndarray:
        return common.mix(words ^ (self.seed + U8(block)))


def walk(sampler: Sampler, words: np.ndarray, start: np.ndarray, size: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """What the walk writes at step `steps` in each window [start, start + size); _END past it."""
    at, end, out = start.copy(), start + size, np.full(len(start), _END, U8)
    bits, live = None, np.arange(len(start))
    for j in range(int(steps.max()) + 1 if len(steps) else 0):
        if j % 64 == 0:
            bits = sampler.bits(words, j // 64)
        here = at[live]
        inside = here < end[live]
        now = live[(steps[live] == j) & inside]
        out[now] = words[at[now]]
        live, here = live[inside & (steps[live] > j)], here[inside & (steps[live] > j)]
        at[live] = here + ((bits[here] >> U8(j % 64)) & U8(1)).astype(np.int64)
    return out


def agreement(sampler: Sampler, a: np.ndarray, a_start, a_size, b: np.ndarray, b_start, b_size) -> np.ndarray:
    """Share of the steps, up to the end of either sequence, at which two walks write the same: 1 less
    the relative Hamming distance of the embeddings."""
    x, y, steps, same = a_start.copy(), b_start.copy(), np.zeros(len(a_start)), np.zeros(len(a_start))
    a_end, b_end, live, j = a_start + a_size, b_start + b_size, np.arange(len(a_start)), 0
    while len(live):
        if j % 64 == 0:
            a_bits, b_bits = sampler.bits(a, j // 64), sampler.bits(b, j // 64)
        u, v = x[live], y[live]
        steps[live] += 1
        same[live] += a[u] == b[v]
        x[live] = u + ((a_bits[u] >> U8(j % 64)) & U8(1)).astype(np.int64)
        y[live] = v + ((b_bits[v] >> U8(j % 64)) & U8(1)).astype(np.int64)
        live, j = live[(x[live] < a_end[live]) & (y[live] < b_end[live])], j + 1
    return same / np.maximum(steps, 1)


def _joined(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return common.mix(one + common.mix(two))


class Items:
    """Benchmark items as word sequences, with their LSH keys for each repetition."""

    def __init__(self, names: list[int], texts: list[bytes], edits: float, least: int, recall: float):
        words, hashes = words_of(texts)
        size = np.diff(words.first)
        use = np.flatnonzero(size >= least)
        self.names = [names[i] for i in use]
        self.size = size[use]
        self.hashes, self.start = hashes, words.first[:-1][use]
        self.allowed = np.floor(self.size * edits + 1e-9).astype(np.int64)
        self.samplers, self.keys, self.recall = [], [], 0.0
        self._tables = None
        self._calibrate(recall)

    def tables(self) -> list[tuple[KeyTable, KeyTable]]:
        """For each repetition the items' first coordinates, and first and second together; made once a task."""
        if self._tables is None:
            self._tables = [(KeyTable(np.unique(a)), KeyTable(_joined(a, b))) for a, b, _ in self.keys]
        return self._tables

    def sequence(self, i: int) -> np.ndarray:
        return self.hashes[self.start[i] : self.start[i] + self.size[i]]

    def _keys(self, sampler: Sampler, hashes, start, size):
        a, b = (walk(sampler, hashes, start, size, np.full(len(start), c)) for c in sampler.early)
        return a, b, walk(sampler, hashes, start, size, sampler.late_of(size))

    def _calibrate(self, target: float) -> None:
        """Add repetitions until edited copies of the items are found at the target rate."""
        rng, copies, owner = np.random.default_rng(1), [], []
        some = range(0, len(self.names), max(1, len(self.names) // 200))
        for i in some:
            for _ in range(3):
                copy = self.sequence(i).tolist()
                for _ in range(int(self.allowed[i])):
                    at, kind = int(rng.integers(0, len(copy))), int(rng.integers(0, 3))
                    new = int(rng.integers(1, 1 << 62))
                    if kind == 0:
                        copy[at] = new
                    elif kind == 1:
                        copy.insert(at, new)
                    elif len(copy) > 1:
                        copy.pop(at)
                # the window that is read is as long as the item, whatever follows the copy
                copy = (copy + rng.integers(1, 1 << 62, int(self.size[i])).tolist())[: int(self.size[i])]
                copies.append(copy)
                owner.append(i)
        flat = np.array([w for c in copies for w in c], U8)
        size = np.array([len(c) for c in copies], np.int64)
        begin, found = np.cumsum(size) - size, np.zeros(len(copies), bool)
        for number in range(MOST_REPETITIONS):
            sampler = Sampler(number)
            own = self._keys(sampler, self.hashes, self.start, self.size)
            self.samplers.append(sampler)
            self.keys.append(own)
            if not copies:
                break
            theirs = self._keys(sampler, flat, begin, size)
            met = np.flatnonzero(np.logical_and.reduce([x[owner] == y for x, y in zip(own, theirs)]))
            item = np.array(owner)[met]
            found[met] |= agreement(sampler, flat, begin[met], size[met], self.hashes, self.start[item], self.size[item]) >= AGREEMENT
            self.recall = float(found.mean())
            if self.recall >= target:
                break


class KeyTable:
    """Which values are among `keys`: a bit table first, then a search among the sorted ones."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.sorted = keys[self.order]
        self.mask = U8((1 << max(16, (16 * len(keys)).bit_length())) - 1)
        self.seen = np.zeros(int(self.mask) + 1, bool)
        self.seen[(keys & self.mask).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, low, high): the values that occur, and where in `sorted` they do."""
        place = np.flatnonzero(self.seen[(values & self.mask).astype(np.int64)])
        low = np.searchsorted(self.sorted, values[place], "left")
        high = np.searchsorted(self.sorted, values[place], "right")
        keep = high > low
        return place[keep], low[keep], high[keep]


def candidates(items: Items, hashes: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, item): windows that agree with an item in all coordinates of a repetition. `last`:
    for each word, where its text ends."""
    found_at, found_item = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    n = len(hashes)
    padded = np.append(hashes, np.zeros(_EARLY, U8))  # a walk may pass the end by as many steps
    for sampler, (first, both), (_, _, third) in zip(items.samplers, items.tables(), items.keys):
        bits = sampler.bits(padded, 0)
        move = [((bits >> U8(j)) & U8(1)).astype(np.int8) for j in range(sampler.early[1])]
        # all windows: up to the first coordinate
        at = np.arange(n)
        for step in move[: sampler.early[0]]:
            at += step[at]
        hit = np.zeros(n + _EARLY, bool)
        hit[first.find(hashes)[0]] = True
        start = np.flatnonzero(hit[at] & (at < last))
        if not len(start):
            continue
        # those that agree in one: up to the second
        at = at[start]
        one = hashes[at]
        for step in move[sampler.early[0] :]:
            at += step[at]
        keep, low, high = both.find(_joined(one, padded[at]))
        inside = at[keep] < last[start[keep]]
        start, low, high = start[keep[inside]], low[inside], high[inside]
        if not len(start):
            continue
        order = both.order
        # those that agree in two, with each item they agree with: the third
        start, which = np.repeat(start, high - low), np.concatenate([order[a:b] for a, b in zip(low, high)])
        size = np.minimum(items.size[which], last[start] - start)
        third_here = walk(sampler, hashes, start, size, sampler.late_of(items.size[which]))
        agree = third_here == third[which]
        start, which, size = start[agree], which[agree], size[agree]
        near = agreement(sampler, hashes, start, size, items.hashes, items.start[which], items.size[which]) >= AGREEMENT
        found_at.append(start[near])
        found_item.append(which[near])
    pairs = np.unique(np.stack([np.concatenate(found_at), np.concatenate(found_item)]), axis=1)
    return pairs[0], pairs[1]


def best_stretch(item: list[int], words: list[int]) -> tuple[int, int]:
    """(edits, end): the fewest edits between the item and any stretch of `words`, by one
    bit-parallel sweep, and where the first such stretch ends."""
    m = len(item)
    places: dict = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(words, 1):
        match = places.get(w, 0)
        d0 = (((match & vp) + vp) ^ vp) | match | vn
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        score += bool(hp & top) - bool(hn & top)
        hp, hn = hp << 1, hn << 1  # a stretch may begin anywhere: the row above costs nothing
        vp, vn = (hn | ~(d0 | hp)) & full, hp & d0 & full
        if score < best:
            best, end = score, j
    return best, end


def _find(items: Items):
    schema = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("edits", pa.int64()), ("end_word", pa.int64()), ("item_words", pa.int64())])

    def find(batches):
        for rows in common.slices(batches, "text", SLICE_BYTES):
            words, hashes = words_of(common.utf8(rows.column("text")))
            if not len(words):
                continue
            last = words.first[words.doc + 1]
            best: dict = {}
            for at, i in zip(*(x.tolist() for x in candidates(items, hashes, last))):
                allowed, doc = int(items.allowed[i]), int(words.doc[at])
                low = max(at - allowed - _EARLY, int(words.first[doc]))
                high = min(at + int(items.size[i]) + allowed + _EARLY, int(last[at]))
                edits, end = best_stretch(items.sequence(i).tolist(), hashes[low:high].tolist())
                if edits <= allowed:
                    found = (edits, low + end - int(words.first[doc]))
                    best[doc, i] = min(best.get((doc, i), found), found)
            ids_ = rows.column("id").to_pylist()
            yield pa.RecordBatch.from_pylist(
                [{"id": ids_[d], "item": items.names[i], "edits": e, "end_word": end, "item_words": int(items.size[i])}
                 for (d, i), (e, end) in best.items()], schema=schema)

    return find


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int):
    """The benchmark's distinct items in blocks of a bounded number of words, streamed."""
    slim = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL").distinct()
    names, texts, held = [], [], 0
    for row in slim.orderBy("item", "text").toLocalIterator():
        raw = row["text"].encode("utf-8", "surrogatepass")
        names.append(row["item"])
        texts.append(raw)
        held += len(raw.split())
        if held >= block_words:
            yield names, texts
            names, texts, held = [], [], 0
    if names:
        yield names, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, least: int = MIN_WORDS, recall: float = RECALL,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                 block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, item, edits, end_word, item_words): documents that hold an item within
    `edits` * its words (rounded down) word edits, each pair once, with its fewest edits
    and the number of words up to that place's end.

    Null and empty texts on either side match nothing; items of fewer than `least` words take no
    part; a null document id or item id stays null; repeated rows count once; empty tables
    give an empty result. Copies without edits are always found, edited ones at the
    target recall."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ddl, found = "id long, item long, edits long, end_word long, item_words long", None
    for names, texts in _blocks(benchmark, item_col, item_text, block_words):
        items = Items(names, texts, edits, least, recall)
        if items.names:
            some = slim.mapInArrow(_find(items), ddl)
            found = some if found is None else found.unionByName(some)
    if found is None:
        found = docs.sparkSession.createDataFrame([], ddl)
    return (found.groupBy("id", "item").agg(F.min(F.struct("edits", "end_word", "item_words")).alias("best"))
            .select(F.col("id").alias(id_col), F.col("item").alias(item_col), "best.edits", "best.end_word", "best.item_words"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, with all columns, that hold no item of the benchmark. Rows are judged by
    their own text, whatever their id."""
    marked = docs.select(F.struct("*").alias("row"), F.xxhash64(text_col).alias("mark"))
    bad = contaminated(docs.select(F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text")), benchmark, id_col="mark", text_col="text", **options)
    return marked.join(bad.select("mark").distinct(), "mark", "left_anti").select("row.*")
