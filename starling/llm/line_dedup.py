"""Line duplicates by a segment-partition edit join.

A line is cut into threshold + 1 segments of nearly equal length. Of two lines within the
threshold, one segment of the shorter stands unchanged in the longer, and only at the few
places that leave enough edits for both sides. So each line goes to an index under its
segments (with number and line length), and probes it with its substrings at those
places, for its own and the next shorter lengths. Lines that meet are compared by counts
of character classes first, then verified by banded bit-parallel edit distance.

Exact copies are one line here: groups of copies never meet as pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from starling.llm import common
from starling.llm.common import U8

THRESHOLD = 2
#: Lines of fewer characters have no near copies: short lines are alike by chance.
MIN_CHARS = 20
_LAST = (1 << 63) - 1
_RECORD = np.dtype([("key", "<u8"), ("id", "<u8"), ("sig", "<u4")])
_INVERSE = pow(common._MULTIPLIER, -1, 1 << 64)
#: Sixteen-bit counters of eight character classes, four to a word.
_CLASSES = 8
_PROBE = np.uint32(1 << 31)


def line_id(line: str) -> int:
    """The 64-bit hash that names a line; two of n lines share one with odds of n^2 / 2^65."""
    return xxh64_intdigest(line.encode("utf-8", "surrogatepass"))


# ------------------------------------------------------------ edit distance

def edit_within(a: str, b: str, limit: int) -> bool:
    """Whether the edit distance is at most `limit`: a bit-parallel column of 2 * limit + 1 cells
    that follows the diagonal."""
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if m - n > limit:
        return False
    if a == b or m <= limit:
        return True
    top = 2 * limit
    mask, places = (1 << top + 1) - 1, {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << (i + limit)
    # bit k of column j stands for row j + k - limit of b; rows up to 0 hold no upward step.
    # score: the cell at the band's lower edge, and from the last row on the cell in that row
    vp, vn, score, spare = mask ^ ((1 << limit) - 1), 0, limit, n - m + limit
    for j, c in enumerate(a, 1):
        match = (places.get(c, 0) >> j - 1) & mask
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & mask
        hp, hn = (vn | ~(d0 | vp)) & mask, d0 & vp
        if j + limit <= m:
            score += not d0 >> top & 1
        else:
            score += (hp >> m - j + limit & 1) - (hn >> m - j + limit & 1)
        if score > limit + spare:
            return False
        vp, vn = (hn | ~(d0 >> 1 | hp)) & mask, (d0 >> 1) & hp
    return score <= limit


# ------------------------------------------------------- keys of a batch

def _sub(prefix, offset, start, size, inverse):
    """Hashes of substrings, the same wherever they stand."""
    begin = offset + start
    return (prefix[begin + size] - prefix[begin]) * inverse[start]


def _partition(length: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i: the last segments are longer by one where it doesn't divide."""
    base, extra = length // parts, length % parts
    longer = parts - extra
    start = i * base + np.maximum(0, i - longer)
    return start, base + (i >= longer)


def line_records(lines: list[str], ids: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Index and probe records of distinct lines."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    offset, longest = np.cumsum(size) - size, int(size.max())
    power, inverse = common.powers(longest + 1), common.powers(longest + 1, _INVERSE)
    place = np.arange(len(chars)) - np.repeat(offset, size)
    prefix = np.zeros(len(chars) + 1, U8)
    np.cumsum((chars.astype(U8) + U8(1)) * power[place], out=prefix[1:])
    sig, kind = np.zeros(len(lines), np.uint32), (chars * np.uint32(2654435761) >> np.uint32(29)).astype(np.uint64)
    for half in (0, 1):
        mine = (kind >> U8(2)) == half
        one = np.where(mine, U8(1) << (U8(16) * (kind & U8(3))), U8(0))
        count = np.add.reduceat(one, offset)
        for c in range(4):
            sig |= ((count >> U8(16 * c) & U8(7)) << U8(3 * (4 * half + c))).astype(np.uint32)
    sig[size > 0xFFFF] = np.uint32(1 << 30)  # counters may have run over: such lines pass unseen
    parts, out = threshold + 1, []

    def add(which, key_hash, i, length, probe):
        made = np.empty(len(which), _RECORD)
        made["key"] = common.mix(key_hash + common.mix((length.astype(U8) << U8(8)) | U8(i)))
        made["id"], made["sig"] = ids[which], sig[which] | (_PROBE if probe else np.uint32(0))
        out.append(made)

    everyone = np.arange(len(lines))
    for less in range(threshold + 1):
        length = size - less
        fit = everyone[length >= parts]
        for i in range(parts):
            start, span = _partition(length[fit], i, parts)
            low = max(-i, less - (threshold - i))
            high = min(i, less + (threshold - i))
            for shift in range(low, high + 1):
                at = start + shift
                good = (at >= 0) & (at + span <= size[fit])
                own = less == 0 and shift == 0  # the segment itself: index and probe in one
                which = fit[good]
                add(which, _sub(prefix, offset[which], at[good], span[good], inverse), i, length[which], not own)
    return np.concatenate(out)


def near_signatures(a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    """Whether counts of character classes allow `threshold` edits (each changes two of them by one at most)."""
    total = np.zeros(np.broadcast(a, b).shape, np.int64)
    for c in range(_CLASSES):
        d = ((a >> np.uint32(3 * c)) - (b >> np.uint32(3 * c))).astype(np.int64) & 7
        total += np.minimum(d, 8 - d)
    return (total <= 2 * threshold) | ((a | b) & np.uint32(1 << 30) > 0)


# ------------------------------------------------------------------- join

_MET = pa.schema([("part", pa.int64()), ("line", pa.int64()), ("whole", pa.bool_())])
_MET_DDL = "part long, line long, whole boolean"


def alike_parts(asked: np.ndarray, held: np.ndarray, threshold: int, step: int = 256) -> np.ndarray:
    """The lines (number of the asked record) joined through pairs whose signatures allow the threshold: for each asked
    record the number of its part. `held` marks the records that stand in the index; one of a pair does."""
    n = len(asked)
    part, index = np.arange(n), np.flatnonzero(held)
    while True:
        before = part.copy()
        for at in range(0, n, step):
            rows = slice(at, at + step)
            near = near_signatures(asked["sig"][rows, None], asked["sig"][None, index], threshold) & (asked["id"][rows, None] != asked["id"][None, index])
            near |= asked["id"][rows, None] == asked["id"][None, index]
            low = np.where(near, part[index][None, :], n).min(axis=1, initial=n)
            part[rows] = np.minimum(part[rows], low)
            up = np.where(near, part[rows][:, None], n).min(axis=0, initial=n)
            part[index] = np.minimum(part[index], up)
        part = part[part]
        if (part == before).all():
            return part


def _meet(threshold: int, block: int):
    """Lines that share a key as (part, line): a part's lines are joined through likely pairs, so rows grow with the lines of a
    key, not with its pairs. Lines of a key too common to compare are one part, not `whole`."""

    def meet(batches):
        for (records,) in common.bucket_records(batches, _RECORD):
            start, stop = common.runs(records["key"])
            many = stop - start > 1
            start, stop = start[many], stop[many]
            if not len(start):
                continue
            whole = np.column_stack([start, stop]).reshape(-1)
            if whole[-1] == len(records):
                whole = whole[:-1]
            least = np.minimum.reduceat(records["id"], whole)[::2]
            most = np.maximum.reduceat(records["id"], whole)[::2]
            indexed = np.minimum.reduceat(records["sig"] & _PROBE, whole)[::2] == 0
            parts, lines, compared = [], [], []
            for s, e in zip(start[(least != most) & indexed], stop[(least != most) & indexed]):
                group = records[s:e]
                _, first = np.unique(np.stack([group["id"], (group["sig"] & _PROBE).astype(U8)]), axis=1, return_index=True)
                group = group[first]
                small = len(group) <= block
                part = alike_parts(group, (group["sig"] & _PROBE) == 0, threshold) if small else np.zeros(len(group), np.int64)
                found = np.unique(np.stack([part.astype(U8), group["id"]]), axis=1)
                _, inverse, size = np.unique(found[0], return_inverse=True, return_counts=True)
                found = found[:, size[inverse] > 1]
                # a part is named by its own lines: the same lines under another key are the same part
                mark = common.mix(found[1])
                names, where = np.unique(found[0], return_inverse=True)
                name = np.zeros(len(names), U8)
                np.add.at(name, where, mark)
                parts.append(name[where] if small else np.full(found.shape[1], group["key"][0], U8))
                lines.append(found[1])
                compared.append(np.full(found.shape[1], small))
            if parts and sum(map(len, parts)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (parts, lines)] + [pa.array(np.concatenate(compared))], schema=_MET)

    return meet


def forest(names: list[int], texts: list[str], threshold: int) -> list[tuple[int, int]]:
    """Links that connect the lines within `threshold` edits, as few as connect them: from each line reached, to all
    lines not reached yet."""
    rest, out = list(zip(names, texts)), []
    while len(rest) > 1:
        ahead, rest = [rest[0]], rest[1:]
        while ahead and rest:
            name, text = ahead.pop()
            apart = []
            for other in rest:
                if abs(len(other[1]) - len(text)) <= threshold and edit_within(text, other[1], threshold):
                    out.append((name, other[0]))
                    ahead.append(other)
                else:
                    apart.append(other)
            rest = apart
    return out


def _lines(rows: pa.RecordBatch, least: int):
    """(index of the row, number of the line, line) of every line that takes part."""
    for i, text in enumerate(rows.column("text").to_pylist()):
        for k, line in enumerate((text or "").split("\n")):
            if len(line) >= least:
                yield i, k, line


def near_lines(slim: DataFrame, threshold: int = THRESHOLD, least: int = MIN_CHARS, block: int = common.BLOCK // 2) -> DataFrame:
    """(a, b): links between line ids that connect the distinct lines within `threshold` edits.
    Lines that meet are gathered with their texts, and a part's links are a forest over the pairs
    verified there: neither rows nor links grow with the pairs. A part of more than `block` lines of one key is dealt
    into pairs of blocks."""
    n = common.buckets(slim.sparkSession)

    def send(batches):
        packer, seen = common.Packer(n), set()
        for rows in common.slices(batches, "text", 2 << 20):
            lines = {}
            for _, _, line in _lines(rows, least):
                if (name := line_id(line)) not in seen:
                    lines[name] = line
            if len(seen) > 1_000_000:
                seen.clear()
            seen.update(lines)
            if lines:
                yield from packer.add(line_records(list(lines.values()), np.fromiter(lines, U8, len(lines)), threshold))
        yield from packer.end()

    met = common.cut(common.by_bucket(slim.select("text").mapInArrow(send, common.PACKED)).mapInArrow(_meet(threshold, block), _MET_DDL).distinct(), "met")
    wanted = common.cut(met.select("line").distinct(), "wanted")

    def texts(batches):
        schema = pa.schema([("line", pa.int64()), ("words", pa.string())])
        for rows in common.slices(batches, "text"):
            lines = {line_id(line): line for _, _, line in _lines(rows, least)}
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.fromiter(lines, U8, len(lines)).view(np.int64)), pa.array(list(lines.values()), pa.string())], schema=schema)

    # `wanted` is read from a file: Spark sees its size and broadcasts it only below its own threshold
    words = common.cut(slim.select("text").mapInArrow(texts, "line long, words string")
                       .join(wanted, "line", "left_semi").dropDuplicates(["line"]), "words")

    def connect(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("line").sort_values("line")
        return pd.DataFrame(forest(pdf["line"].tolist(), pdf["words"].tolist(), threshold), columns=["a", "b"], dtype="int64")

    links = met.where("whole").join(words, "line").groupBy("part").applyInPandas(connect, "a long, b long")
    large = met.where("NOT whole").select("part", "line")
    if large.isEmpty():
        return links
    dealt = common.block_pairs(large, "part", "line", block).join(words, "line")
    return links.unionByName(dealt.groupBy("part", "i", "j").applyInPandas(connect, "a long, b long"))


def line_classes(slim: DataFrame, threshold: int = THRESHOLD, least: int = MIN_CHARS, exact: int | None = None) -> DataFrame:
    """(id, mark, line_no, class_id, class_line): every line that repeats one before it,
    and the place (id of the document, number of the line) of its class's first line.
    `slim` has id, mark (hash of the text) and text; null ids come last."""
    schema = pa.schema([("line", pa.int64()), ("id", pa.int64()), ("mark", pa.int64()), ("line_no", pa.int32())])

    def places(batches):
        for rows in common.slices(batches, "text"):
            found = [(line_id(line), i, k) for i, k, line in _lines(rows, least if exact is None else max(1, min(exact, least)))]
            if found:
                name, i, k = zip(*found)
                own = rows.select(["id", "mark"]).take(pa.array(i, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(name, U8).view(np.int64)), own.column("id"), own.column("mark"), pa.array(k, pa.int32())], schema=schema)

    placed = common.cut(slim.mapInArrow(places, "line long, id long, mark long, line_no int"), "lines")
    place = F.struct(F.coalesce("id", F.lit(_LAST)).alias("id"), "mark", "line_no")
    first = placed.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    known = common.components(near_lines(slim, threshold, least))
    named = common.cut(first.join(known, first["line"] == known["node"], "left")
                       .select("line", "first", "n", "component").where("n > 1 OR component IS NOT NULL")
                       .withColumn("component", F.coalesce("component", "line")), "named")
    of_class = named.groupBy("component").agg(F.min("first").alias("first"))
    classes = named.select("line", "component").join(of_class, "component").select("line", "first")
    return (placed.join(classes, "line").where(place != F.col("first"))
            .select("id", "mark", "line_no", F.col("first.id").alias("class_id"), F.col("first.line_no").alias("class_line")))


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, least: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text",
                details: bool = False, exact: int | None = None) -> DataFrame:
    """The rows of `docs` with all their columns, each text without the lines that are
    within `threshold` edits (directly or over others) of one before it. Before means:
    in a document with a smaller id, or earlier in the same text.

    Lines end at \\n. Lines of fewer than `least` characters stay, except that those of `exact`
    characters or more go where they repeat one before them exactly; empty lines always stay. Null texts stay null,
    empty ones empty; null ids come after all others, and rows that repeat id and text are one
    document. With `details` the columns are the id, n_lines, n_removed, classes (document id and line
    number of the first line of each removed line's class, in line order) and text."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    gone = (line_classes(slim.where("text IS NOT NULL"), threshold, least, exact).distinct()
            .groupBy(F.coalesce("id", F.lit(_LAST)).alias("gone_id"), "mark")
            .agg(F.sort_array(F.collect_list(F.struct("line_no", "class_id", "class_line"))).alias("gone"))
            .withColumnRenamed("mark", "gone_mark"))

    @F.pandas_udf("string")
    def without(text: pd.Series, numbers: pd.Series) -> pd.Series:
        out = []
        for t, gone_ in zip(text, numbers):
            if t is not None and gone_ is not None and len(gone_):
                drop = set(gone_)
                t = "\n".join(line for k, line in enumerate(t.split("\n")) if k not in drop)
            out.append(t)
        return pd.Series(out, dtype=object)

    rows = docs.select(F.struct("*").alias("row"))
    text = F.col(f"row.`{text_col}`")
    joined = rows.join(gone, (F.coalesce(F.col(f"row.`{id_col}`").cast("long"), F.lit(_LAST)) == F.col("gone_id"))
                       & (F.xxhash64(text) == F.col("gone_mark")), "left").select("row", "gone")
    joined = joined.withColumn("kept", without(text, F.col("gone.line_no")))
    if details:
        return joined.select(F.col(f"row.`{id_col}`").alias(id_col), F.size(F.split(F.coalesce(text, F.lit("")), "\n")).cast("long").alias("n_lines"),
                             F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
                             F.coalesce(F.transform("gone", lambda g: F.struct(g["class_id"], g["class_line"])), F.array()).alias("classes"),
                             F.col("kept").alias(text_col))
    return joined.select(F.col("row").withField(f"`{text_col}`", F.col("kept")).alias("row")).select("row.*")
