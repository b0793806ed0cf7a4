"""Repeated word spans over a compacted de Bruijn graph.

A window of k words is an edge from its first k - 1 words to its last k - 1. Edges that
begin in more than one document are repeated; what has to go are their later copies.
Three steps keep the graph small:

1. Every edge has a minimizer: the m-gram of least hash inside it. Equal edges have equal
   minimizers, so only edges whose minimizer stands in two documents can be repeated. Minimizers
   are far fewer than edges, and only they are counted over the corpus.
2. Such edges are grouped by minimizer with their neighbours of the same minimizer (super
   k-mers), so a path of edges travels as one record and meets its copies in one
   task. There each repeated edge gets its source: its first place, in the smallest document.
3. Edges that follow each other in a document and whose sources do so too don't branch:
   their pieces are compacted into one path (document, start, length, source, source start).

Both kinds of records are combined before they are sent: of a passage that very many documents
share, a task decides all but the first copy itself and sends that one only.

An edge travels as 128 bits that stand for its words. Before words are removed, the words of each path are
compared with those at its source's coordinates, by a digest of the words themselves. Where every path
holds, every edge's source is a true one, so nothing is missed; where one only shared hashes, all
edges are hashed anew by another function."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starling.llm import common
from starling.llm.common import U8, Words

WINDOW, MINIMIZER = 13, 5
_GRAM = np.dtype([("gram", "<u8"), ("id", "<i8"), ("shared", "u1")])
_PLACE = np.dtype([("id", "<i8"), ("start", "<i4"), ("n", "<i4"), ("source", "<i8"), ("source_start", "<i4")])
_SPANS = "array<struct<start:int,n:int>>"
_OUT = "id long, mark long, n_words long, n_removed long, kept_sha256 string, kept string, digests array<struct<start:int,n:int,digest:binary>>"


def _record(window: int, minimizer: int) -> np.dtype:
    return np.dtype([("gram", "<u8"), ("id", "<i8"), ("start", "<i4"), ("n", "<i4"), ("edges", "<u8", (window - minimizer + 1, 2))])


def minimizers(grams: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For every run of `reach` grams: the least hash in it, and its (leftmost) place."""
    n = len(grams) - reach + 1
    if n <= 0:
        return np.empty(0, U8), np.empty(0, np.int64)
    least, place = grams[:n].copy(), np.arange(n)
    for j in range(1, reach):
        less = grams[j : j + n] < least
        least[less] = grams[j : j + n][less]
        place[less] = np.flatnonzero(less) + j
    return least, place


def _edges(words: Words, hashes: np.ndarray, window: int, minimizer: int):
    """(first word, minimizer, its place) of every window that lies in one text."""
    grams = common.gram_hashes(hashes, minimizer)
    least, place = minimizers(grams, window - minimizer + 1)
    n = len(least)
    whole = np.flatnonzero(words.doc[:n] == words.doc[window - 1 : window - 1 + n])
    return whole, least[whole], place[whole]


def _share(records: np.ndarray) -> list:
    """Minimizers that two documents gathered here have are known to be shared; of these
    documents only the first goes on to the minimizer's bucket."""
    records = np.unique(records)
    start, stop = common.runs(records["gram"])
    many = np.repeat(stop - start > 1, stop - start)
    first = np.zeros(len(records), bool)
    first[start] = True
    records["shared"] = many
    apart = many & ~first
    return [(0, records[~apart], records["gram"][~apart]), (0, records[apart], common.mix(records["id"][apart].astype(U8)))]


def word_hashes(words: Words, seed: int) -> np.ndarray:
    return words.hashes(seed=seed)


def suspects(slim: DataFrame, window: int, minimizer: int, hashes=word_hashes, seed: int = 0) -> DataFrame:
    """(id, grams): minimizers of each document that also stand in another one."""
    n = common.buckets(slim.sparkSession)

    def send(batches):
        packer = common.Packer(n, _share)
        for rows in common.slices(batches, "text"):
            words = Words(common.utf8(rows.column("text")))
            first, least, _ = _edges(words, hashes(words, seed), window, minimizer)
            if not len(first):
                continue
            doc = words.doc[first]
            new = np.ones(len(first), bool)
            new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
            records = np.zeros(int(new.sum()), _GRAM)
            records["gram"], records["id"] = least[new], common.ids(rows.column("id"))[doc[new]]
            yield from packer.add(records)
        yield from packer.end()

    schema = pa.schema([("id", pa.int64()), ("gram", pa.int64())])

    def meet(batches):
        for (records,) in common.bucket_records(batches, _GRAM):
            start, stop = common.runs(records["gram"])
            least, most = np.minimum.reduceat(records["id"], start), np.maximum.reduceat(records["id"], start)
            shared = np.repeat(least != most, stop - start) | (records["shared"] > 0)
            found = np.unique(records[["gram", "id"]][shared])
            yield pa.RecordBatch.from_arrays([pa.array(found["id"].copy()), pa.array(found["gram"].copy().view(np.int64))], schema=schema)

    met = common.by_bucket(slim.select("id", "text").mapInArrow(send, common.PACKED)).mapInArrow(meet, "id long, gram long")
    return met.groupBy("id").agg(F.collect_set("gram").alias("grams"))


#: The second half of an edge's 128 bits.
_OTHER = 0xD1B54A32D192ED03


def _send_edges(n: int, window: int, minimizer: int, hashes, seed: int):
    dtype = _record(window, minimizer)

    def combine(records: np.ndarray) -> list:
        found, late = repeated(records, window, minimizer)
        rest = records[~late]
        return [(0, rest, rest["gram"]), (1, found, common.mix(found["id"].astype(U8)))]

    def send(batches):
        packer = common.Packer(n, combine)
        for rows in common.slices(batches, "text"):
            words = Words(common.utf8(rows.column("text")))
            hashed = hashes(words, seed)
            first, least, place = _edges(words, hashed, window, minimizer)
            if not len(first):
                continue
            doc = words.doc[first]
            # the document's own suspects: pairs of document and gram in one sorted list
            lists = rows.column("grams")
            owner = np.repeat(np.arange(rows.num_rows), np.diff(lists.offsets.to_numpy()))
            held = lists.flatten().to_numpy(zero_copy_only=False).view(U8)
            known = np.sort(common.mix(held + common.mix(owner.astype(U8))))
            asked = common.mix(least + common.mix(doc.astype(U8)))
            at = np.searchsorted(known, asked)
            keep = np.zeros(len(asked), bool)
            inside = at < len(known)
            keep[inside] = known[at[inside]] == asked[inside]
            first, least, place, doc = first[keep], least[keep], place[keep], doc[keep]
            if not len(first):
                continue
            new = np.ones(len(first), bool)  # another super k-mer: another minimizer, or a gap
            new[1:] = (place[1:] != place[:-1]) | (first[1:] != first[:-1] + 1) | (doc[1:] != doc[:-1])
            begin = np.flatnonzero(new)
            records = np.zeros(len(begin), dtype)
            records["gram"], records["id"] = least[begin], common.ids(rows.column("id"))[doc[begin]]
            records["start"] = first[begin] - words.first[doc[begin]]
            records["n"] = np.diff(np.append(begin, len(first)))
            whole = np.stack([common.gram_hashes(hashed, window), common.gram_hashes(hashed, window, _OTHER)], axis=1)
            reach = np.arange(window - minimizer + 1)[None, :]
            used = reach < records["n"][:, None]
            records["edges"] = np.where(used[:, :, None], whole[np.minimum(first[begin][:, None] + reach, len(whole) - 1)], 0)
            yield from packer.add(records)
        yield from packer.end()

    return send


_PIECE = "id long, start int, n int, source long, source_start int"


def repeated(records: np.ndarray, window: int, minimizer: int) -> tuple[np.ndarray, np.ndarray]:
    """Paths of edges (with their sources) that some smaller document among these super
    k-mers also has, and which super k-mers have only such edges."""
    record, j = np.nonzero(np.arange(window - minimizer + 1)[None, :] < records["n"][:, None])
    edge, other = records["edges"][record, j].T
    doc, at = records["id"][record], records["start"][record] + j.astype(np.int32)
    order = np.lexsort((at, doc, other, edge))
    new = np.ones(len(order), bool)
    new[1:] = (edge[order][1:] != edge[order][:-1]) | (other[order][1:] != other[order][:-1])
    start = np.flatnonzero(new)
    head = np.empty(len(order), np.int64)
    head[order] = np.repeat(order[start], np.diff(np.append(start, len(order))))
    source, source_at = doc[head], at[head]
    is_late = source < doc
    count = np.bincount(record[is_late], minlength=len(records))
    late = np.flatnonzero(is_late)
    r, shift = record[late], source_at[late] - at[late]
    new = np.ones(len(late), bool)
    new[1:] = (r[1:] != r[:-1]) | (at[late][1:] != at[late][:-1] + 1) | (source[late][1:] != source[late][:-1]) | (shift[1:] != shift[:-1])
    begin = np.flatnonzero(new)
    pick, out = late[begin], np.zeros(len(begin), _PLACE)
    out["id"], out["start"], out["n"] = doc[pick], at[pick], np.diff(np.append(begin, len(late)))
    out["source"], out["source_start"] = source[pick], source_at[pick]
    return out, count == records["n"]


def _meet_edges(window: int, minimizer: int):
    dtype = _record(window, minimizer)
    schema = pa.schema([("id", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())])

    def meet(batches):
        for records, known in common.bucket_records(batches, dtype, _PLACE):
            found, _ = repeated(records, window, minimizer)
            for places in (known, found):
                yield pa.RecordBatch.from_arrays([pa.array(places[f.name].copy()) for f in schema], schema=schema)

    return meet


def compacted(pieces: DataFrame) -> DataFrame:
    """Join the pieces of paths that don't branch: in a document one goes on where the one
    before it ended, and so do their sources."""
    order = Window.partitionBy("id").orderBy("start", "source", "source_start")
    rows = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a piece may come twice, from a task that saw some of its edges' copies and from the bucket
    pieces = pieces.groupBy("id", "start", "source", "source_start").agg(F.max("n").alias("n"))
    follows = ((F.lag(F.col("start") + F.col("n")).over(order) == F.col("start")) & (F.lag("source").over(order) == F.col("source"))
               & (F.lag(F.col("source_start") + F.col("n")).over(order) == F.col("source_start")))
    return (pieces.withColumn("new", F.when(follows, 0).otherwise(1))
            .withColumn("path", F.sum("new").over(rows))
            .groupBy("id", "path").agg(F.min("start").alias("start"), F.sum("n").cast("int").alias("n"), F.first("source").alias("source"),
                                       F.min("source_start").alias("source_start"))
            .drop("path"))


def _remove(window: int, texts: bool):
    schema = pa.schema([
        ("id", pa.int64()), ("mark", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()),
        ("digests", pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("digest", pa.binary())])))])

    def remove(batches):
        for rows in common.slices(batches, "text"):
            out = []
            for key, mark, text, spans, lent in zip(rows.column("id").to_pylist(), rows.column("mark").to_pylist(), common.utf8(rows.column("text")),
                                                    rows.column("spans").to_pylist(), rows.column("lent").to_pylist()):
                words = text.split()
                n = len(words)
                gone = np.zeros(n + 1, np.int32)
                for s in spans or ():
                    gone[min(s["start"], n)] += 1
                    gone[min(s["start"] + s["n"] + window - 1, n)] -= 1
                gone = np.cumsum(gone[:n]) > 0
                digests = [{"start": a, "n": k, "digest": xxhash.xxh3_128_digest(b" ".join(words[a : a + k + window - 1]))}
                           for a, k in sorted({(s["start"], s["n"]) for s in [*(spans or ()), *(lent or ())]})]
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words)
                out.append((key, mark, n, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if texts else None, digests))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return remove


def dedup_spans(docs: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER, id_col: str = "doc_id", text_col: str = "text",
                texts: bool = False, hashes=word_hashes) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept]) of each row: every word covered by a
    window of `window` words that also starts in a document with a smaller id is
    removed; windows are judged on the input. Words are `[^\\x20\\x09-\\x0D]+`; kept words are
    joined by one space.

    Null and empty texts have no words. Documents with a null id lose nothing and take
    nothing from others; rows with equal ids don't compete with each other. An empty table
    gives an empty result. `hashes(words, seed)` gives a 64-bit hash of each word, another function for each seed."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    named = slim.where("id IS NOT NULL")
    # the same exchange of texts serves both joins
    dealt, remove, seed, loose = named.repartition("id"), _remove(window, texts), 0, None
    while True:
        shared = common.cut(suspects(named, window, minimizer, hashes, seed), "suspects")
        edges = (dealt.select("id", "text").join(shared.hint("shuffle_hash"), "id")
                 .mapInArrow(_send_edges(common.buckets(docs.sparkSession), window, minimizer, hashes, seed), common.PACKED))
        pieces = common.by_bucket(edges).mapInArrow(_meet_edges(window, minimizer), _PIECE)
        if loose is None:
            paths = compacted(pieces)
        else:  # pieces of different texts of one id may have been joined: there they stay apart
            pieces = common.cut(pieces, "pieces")
            paths = compacted(pieces.join(loose, "id", "left_anti")).unionByName(pieces.join(loose, "id", "left_semi").distinct())
        paths = common.cut(paths, "paths")
        spans = paths.groupBy("id").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
        lent = (paths.select(F.col("source").alias("id"), F.col("source_start").alias("start"), "n").distinct()
                .groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("lent")))
        joined = named.join(spans, "id", "left").join(lent, "id", "left").select("id", "mark", "text", "spans", "lent")
        done = common.cut(joined.mapInArrow(remove, _OUT), "removed")
        said = done.select("id", F.explode("digests").alias("d")).select("id", "d.start", "d.n", "d.digest").distinct()
        theirs = said.selectExpr("id AS source", "start AS source_start", "n", "digest AS theirs")
        # rows of one id may have different texts: a path holds if some text of either id has its words
        false = (paths.join(said, ["id", "start", "n"]).join(theirs, ["source", "source_start", "n"])
                 .groupBy("id", "start", "n", "source", "source_start").agg(F.max(F.col("digest") == F.col("theirs")).alias("same")).where("NOT same"))
        false = common.cut(false.select("id").distinct(), "false")
        if false.isEmpty():
            break
        seed, loose = seed + 1, false if loose is None else loose.unionByName(false).distinct()
    unnamed = (slim.where("id IS NULL").withColumn("spans", F.lit(None).cast(_SPANS)).withColumn("lent", F.lit(None).cast(_SPANS))
               .mapInArrow(remove, _OUT))
    result = done.unionByName(unnamed)
    return result.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", *(["kept"] if texts else []))
