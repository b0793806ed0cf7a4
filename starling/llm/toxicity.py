"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words (letters only, lower-cased) and the words' first four and five
bytes, hashed. The model scores

    bias + sum of w[i] + sum over pairs of <v[i], v[j]>

over the distinct terms of a text, through a logistic function. The pairs, computed
in linear time as half of (sum of v)^2 - sum of v^2, let two terms together say what
neither says alone.

It is fitted on a bounded sample of the labelled rows, in one task; scoring is a single
pass over all texts without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.llm import common
from starling.llm.common import U8, Words

#: Terms are hashed to this many bits.
HASH_BITS = 22
#: Labelled rows that the model is fitted on, at most: those of least hash of their id.
SAMPLE_ROWS = 10_000
#: Terms in fewer sample rows than this are not learned, nor are those whose shares of rows in
#: the two classes differ by less than so many standard errors, unless a pair of terms tells more
#: than both do alone: by so much that chance shows it in one of all pairs with odds below PAIR_ODDS.
LEAST_ROWS, LEAST_ERRORS, PAIR_ODDS = 5, 3.0, 0.01
FACTORS, PASSES, BATCH, RATE, SHRINK = 4, 12, 256, 0.05, 2e-4
#: Folds by crc32 of the id as text; this one is held out.
FOLDS, HELD_OUT = 5, 0

#: Bytes of words: ASCII letters and all bytes of other scripts.
_LETTERS = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of each distinct term of each text, sorted."""
    words = Words([t.lower().encode("utf-8", "surrogatepass") for t in texts], _LETTERS)
    kinds = [words.hashes(), words.hashes(4) + U8(1), words.hashes(5) + U8(2)]
    shift = U8(64 - HASH_BITS)
    doc = np.tile(words.doc.astype(np.int64), len(kinds))
    found = np.unique(doc << HASH_BITS | (common.mix(np.concatenate(kinds)) >> shift).astype(np.int64))
    return found >> HASH_BITS, found & ((1 << HASH_BITS) - 1)


@dataclass
class Model:
    """A fitted machine: sorted terms with their weights and factors."""

    terms: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        doc, term = terms(texts)
        at = np.searchsorted(self.terms, term)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == term[known]
        return 1 / (1 + np.exp(-np.clip(self.margin(doc[known], at[known], len(texts)), -30, 30)))

    def margin(self, doc, at, n: int) -> np.ndarray:
        out = self.bias + np.bincount(doc, self.w[at], n)
        for f in range(self.v.shape[1]):
            v = self.v[at, f]
            out += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return out


def _evidence(ones, zeros, base):
    """How far, in nats, a share of ones lies from `base`: chance gets there with odds of exp(-this) at most."""
    share = ones / np.maximum(ones + zeros, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (np.where(ones > 0, ones * np.log(share / base), 0.0)
                + np.where(zeros > 0, zeros * np.log((1 - share) / (1 - base)), 0.0))


def paired(doc: np.ndarray, at: np.ndarray, label: np.ndarray, n_terms: int, block: int = 1024) -> np.ndarray:
    """Which terms belong to a pair whose rows are toxic more often than those of either term, or
    less often than those of either. Every pair of terms of enough rows is tested; the terms that
    are passed over first are those that no partner could bring to the bound."""
    count, ones = np.bincount(at, minlength=n_terms), np.bincount(at, label[doc], n_terms)
    frequent = int((count >= LEAST_ROWS).sum())
    bound = np.log(max(frequent * (frequent - 1) / 2, 1) / PAIR_ODDS)
    base = np.clip(ones / np.maximum(count, 1), 1e-9, 1 - 1e-9)
    can = (count >= LEAST_ROWS) & ((-ones * np.log(base) >= bound) | ((ones - count) * np.log1p(-base) >= bound))
    terms_, out = np.flatnonzero(can), np.zeros(n_terms, bool)
    rank = np.full(n_terms, -1)
    rank[terms_] = np.arange(len(terms_))
    row = np.empty(len(label), np.int64)  # toxic rows first
    row[np.argsort(-label, kind="stable")] = np.arange(len(label))
    toxic, mine = int(label.sum()), rank[at] >= 0
    column, place = rank[at[mine]], row[doc[mine]]
    order = np.argsort(column, kind="stable")
    column, place = column[order], place[order]

    def dense(start):
        a, b = np.searchsorted(column, [start, start + block])
        x = np.zeros((len(label), min(block, len(terms_) - start)), np.float32)
        x[place[a:b], column[a:b] - start] = 1
        return x

    for i in range(0, len(terms_), block):
        x, own = dense(i), terms_[i : i + block]
        for j in range(i, len(terms_), block):
            y, other = dense(j) if j > i else x, terms_[j : j + block]
            n1, n0 = (x[:toxic].T @ y[:toxic]).astype(np.float64), (x[toxic:].T @ y[toxic:]).astype(np.float64)
            share = n1 / np.maximum(n1 + n0, 1)
            high = np.maximum(base[own][:, None], base[other][None, :])
            low = np.minimum(base[own][:, None], base[other][None, :])
            a, b = np.nonzero((n1 + n0 >= LEAST_ROWS) & ((share > high) | (share < low)))
            beyond = np.where(share[a, b] > high[a, b], high[a, b], low[a, b])
            tells = (_evidence(n1[a, b], n0[a, b], beyond) >= bound) & (own[a] != other[b])
            out[own[a[tells]]] = out[other[b[tells]]] = True
    return out


def fit(doc: np.ndarray, term: np.ndarray, label: np.ndarray, seed: int = 7) -> Model:
    """Fit to rows of distinct terms (sorted by row) by adaptive gradient steps on the logistic
    loss. Only terms of enough rows, and unlike in the two classes by themselves or in a pair, are learned."""
    kept, at, count = np.unique(term, return_inverse=True, return_counts=True)
    ones = np.bincount(at, label[doc], len(kept)) if len(doc) else np.empty(0)
    n1 = float(label.sum())
    n0, share = len(label) - n1, count / max(len(label), 1)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / max(n1, 1) + 1 / max(n0, 1)))
    telling = np.abs(ones / max(n1, 1) - (count - ones) / max(n0, 1)) >= LEAST_ERRORS * error
    frequent = (count >= LEAST_ROWS) & (telling | paired(doc, at, label, len(kept)))
    number = np.cumsum(frequent) - 1
    use = frequent[at]
    doc, at, kept = doc[use], number[at[use]], kept[frequent]
    rng, n, k = np.random.default_rng(seed), len(label), len(kept)
    rate = float(np.clip(label.mean() if n else 0.0, 1e-3, 1 - 1e-3))
    model = Model(kept, float(np.log(rate / (1 - rate))), np.zeros(k), rng.normal(0, 0.01, (k, FACTORS)))
    seen_w, seen_v, seen_b = np.full(k, 1e-8), np.full((k, FACTORS), 1e-8), 1e-8
    first = np.searchsorted(doc, np.arange(n + 1))
    for _ in range(PASSES):
        order = rng.permutation(n)
        for s in range(0, n, BATCH):
            rows = order[s : s + BATCH]
            size = first[rows + 1] - first[rows]
            own = np.repeat(np.arange(len(rows)), size)
            x = at[np.repeat(first[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            sums = np.stack([np.bincount(own, model.v[x, f], len(rows)) for f in range(FACTORS)], axis=1)
            error = 1 / (1 + np.exp(-np.clip(model.margin(own, x, len(rows)), -30, 30))) - label[rows]
            touched, place = np.unique(x, return_inverse=True)
            each = error[own]
            grad = np.bincount(place, each) + SHRINK * len(rows) * model.w[touched]
            seen_w[touched] += grad**2
            model.w[touched] -= RATE * grad / np.sqrt(seen_w[touched])
            for f in range(FACTORS):
                g = np.bincount(place, each * (sums[own, f] - model.v[x, f])) + SHRINK * len(rows) * model.v[touched, f]
                seen_v[touched, f] += g**2
                model.v[touched, f] -= 0.2 * RATE * g / np.sqrt(seen_v[touched, f])
            g = float(error.sum())
            seen_b += g * g
            model.bias -= RATE * g / np.sqrt(seen_b)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `sample_rows` labelled rows outside the held-out fold, those of least hash
    of their id. Rows with a null id or label, and ids with labels of both kinds, are left out. Without
    any row the model says 0 for everything."""
    fold = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(FOLDS))
    usable = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
              .where("id IS NOT NULL AND label IS NOT NULL").where(fold != HELD_OUT)
              .groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other"))
    chosen = common.cut(usable.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("id", "label"), "sample")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # `chosen` has at most `sample_rows` rows of two numbers
    rows = rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))

    def features(batches):
        schema = pa.schema([("label", pa.int32()), ("terms", pa.list_(pa.int64())), ("id", pa.int64())])
        for batch in common.slices(batches, "text"):
            doc, term = terms([t or "" for t in batch.column("text").to_pylist()])
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.int32()), pa.ListArray.from_arrays(first.astype(np.int32), term),
                                              batch.column("id")], schema=schema)

    def fit_all(frames):
        parts = list(frames)
        if not parts:
            return
        pdf = pd.concat(parts).sort_values("id")  # the same sample gives the same model
        size = pdf["terms"].map(len).to_numpy()
        model = fit(np.repeat(np.arange(len(pdf)), size), np.concatenate(pdf["terms"].to_list()).astype(np.int64),
                    pdf["label"].to_numpy(np.float64))
        yield pd.DataFrame({"bias": [model.bias], "terms": [model.terms.astype("<i8").tobytes()],
                             "w": [model.w.astype("<f8").tobytes()], "v": [model.v.astype("<f8").tobytes()]})

    # one task: what it gets is bounded by `sample_rows`
    found = (rows.mapInArrow(features, "label int, terms array<long>, id long").repartition(1)
             .mapInPandas(fit_all, "bias double, terms binary, w binary, v binary").first())
    if found is None:
        return Model(np.empty(0, np.int64), -30.0, np.empty(0), np.empty((0, FACTORS)))
    return Model(np.frombuffer(found["terms"], "<i8"), found["bias"], np.frombuffer(found["w"], "<f8"),
                 np.frombuffer(found["v"], "<f8").reshape(-1, FACTORS))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of each row. Null and empty texts get the score of a text
    without terms; a null id isn't held out; repeated rows are scored each; an empty table
    gives an empty result. Only the text goes into a score."""
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's terms

    def score(batches):
        for rows in common.slices(batches, "text"):
            got = held.value.score([t or "" for t in rows.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(got, pa.float64())], schema=schema)

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    fold = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(FOLDS))
    return slim.mapInArrow(score, "id long, score double").select(
        F.col("id").alias(id_col), F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all columns, that score below `threshold`; judged one by one."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for s in range(0, len(texts), 500):
            out.append(held.value.score([t or "" for t in texts.iloc[s : s + 500]]))
        return pd.Series(np.concatenate(out) if out else [], dtype=float)

    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    return rows.where(score("text") < threshold).select("row.*")
