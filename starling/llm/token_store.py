"""Token ids as binary shard files with Elias-Fano document boundaries.

A shard file is one concatenated id array of documents in id order, plus where each
document ends. File layout, all little-endian:

    header   8 bytes "STARTOK1", then 64-bit numbers: documents, ids, bytes an id,
             documents whose id is null (they come first), the first other id, and for
             the boundaries and then the document ids: low bits l and high words
    low      l bits of each boundary, packed, padded to 8 bytes
    high     the boundaries' upper parts in unary: bit (upper + i) is set for boundary i
    low, high of the document ids, as distances from the first one
    ids      2 or 4 bytes each

A boundary's upper part is found by selecting the i-th set bit; a sampled directory of
`_SAMPLE` set bits, built when a file is opened, makes that a short scan. The space is
l + 2 bits a document instead of 64.

Tasks write files through Arrow's file systems to the folder named, each under a new name, and
report them; Spark writes the manifest, so files of lost or repeated tasks are never
read."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starling.llm.common import slices
from starling.llm.encoding import Encoder, tokenizer_path
from starling.session import scratch_path

MAGIC = b"STARTOK1"
_HEADER = 8 + 9 * 8
_SAMPLE = 64
#: Bytes of ids after which a task starts another file (a document is never divided).
SHARD_BYTES = 32 << 20

_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()),
                       ("n_ids", pa.int64()), ("first_id", pa.int64())])
_MANIFEST_DDL = "part int, seq int, path string, n_docs long, n_ids long, first_id long"


class EliasFano:
    """A non-decreasing sequence in l + 2 bits a value, with select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high  # bytes; 64-bit words
        counts = np.bitwise_count(high).astype(np.int64)
        self._before = np.cumsum(counts) - counts
        # the word that holds every _SAMPLE-th set bit
        self._directory = np.searchsorted(self._before, np.arange(0, max(n, 1), _SAMPLE), "right") - 1

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        low_bits = max(0, int(values[-1] // np.uint64(n)).bit_length() - 1) if n else 0
        upper = (values >> np.uint64(low_bits)).astype(np.int64)
        bits = np.zeros(((int(upper[-1]) + n) // 64 + 1) * 64 if n else 64, dtype=np.uint8)
        bits[upper + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        rest = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, low_bits, np.packbits(rest.reshape(-1), bitorder="little"), high)

    def select(self, i: int) -> int:
        """Value i: the place of the i-th set bit less i, and the low bits."""
        word = int(self._directory[i // _SAMPLE])
        while word + 1 < len(self._before) and self._before[word + 1] <= i:
            word += 1
        bits, left = int(self.high[word]), i - int(self._before[word])
        for _ in range(left):
            bits &= bits - 1
        upper = word * 64 + (bits & -bits).bit_length() - 1 - i
        low, at = 0, i * self.low_bits
        for k in range(self.low_bits):
            low |= ((int(self.low[(at + k) >> 3]) >> ((at + k) & 7)) & 1) << k
        return upper << self.low_bits | low

    def all(self) -> np.ndarray:
        """Every value, in one sweep over the words."""
        place = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        upper = place - np.arange(self.n)
        rest = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        low = (rest.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1) if self.low_bits else 0
        return (upper << self.low_bits) + low


def shard_bytes(documents: list[bytes], names: list[int | None], width: int) -> bytes:
    """A shard file of these documents' ids (as little-endian bytes of `width` an id); their
    names are in ascending order, nulls first."""
    ends = np.cumsum([len(d) // width for d in documents]).astype(np.int64)
    known = np.array([x for x in names if x is not None], "<i8")
    index, called = EliasFano.encode(ends), EliasFano.encode(known.view("<u8") - known.view("<u8")[:1])
    header = np.array([len(documents), ends[-1] if len(ends) else 0, width, len(documents) - len(known),
                       known[0] if len(known) else 0, index.low_bits, len(index.high), called.low_bits, len(called.high)], "<i8")
    padded = [x.tobytes() + b"\0" * (-len(x) % 8) for x in (index.low, called.low)]
    return b"".join([MAGIC, header.tobytes(), padded[0], index.high.tobytes(), padded[1], called.high.tobytes(), *documents])


class Shard:
    """A shard file opened for reading: `len`, `name(i)`, `bounds(i)` and `ids(i)`."""

    def __init__(self, raw: bytes | memoryview):
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a token shard")
        n, self.n_ids, self.width, self.nulls, self.first, *sizes = np.frombuffer(raw, "<i8", 9, 8).tolist()
        at, found = _HEADER, []
        for count, low_bits, words in ((n, *sizes[:2]), (n - self.nulls, *sizes[2:])):
            size = (count * low_bits + 7) // 8
            high = at + size + -size % 8
            found.append(EliasFano(count, low_bits, np.frombuffer(raw, np.uint8, size, at), np.frombuffer(raw, "<u8", words, high)))
            at = high + 8 * words
        self.index, self.called = found
        self.values = np.frombuffer(raw, f"<u{self.width}", self.n_ids, at)

    def name(self, i: int) -> int | None:
        return None if i < self.nulls else self.first + self.called.select(i - self.nulls)

    def names(self) -> list[int | None]:
        return [None] * self.nulls + (self.called.all() + self.first).tolist()

    def __len__(self) -> int:
        return self.index.n

    def bounds(self, i: int) -> tuple[int, int]:
        return self.index.select(i - 1) if i else 0, self.index.select(i)

    def ids(self, i: int) -> np.ndarray:
        start, end = self.bounds(i)
        return self.values[start:end]


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _uri(folder: str) -> str:
    """Hadoop writes file:/x for what others call file:///x."""
    return "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, leading_space: bool = True, end_id: int = 2,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text, append `end_id`, and write shard files in ascending id order
    (null ids first, ties in order of the text's hash) under `folder`, which all
    executors share. Returns the manifest, read back from `folder`/manifest.

    A null or empty text is just `end_id`; repeated rows are written each; an empty table
    writes no shard."""
    spark = docs.sparkSession
    path = path or tokenizer_path("byte_bpe_50k.json")
    folder = _uri(folder)

    def write(batches):
        from pyspark import TaskContext

        encoder = Encoder.of(path, leading_space)
        width, part = encoder.width.itemsize, TaskContext.get().partitionId()
        end = np.array([end_id], encoder.width).tobytes()
        documents, names, held, seq = [], [], 0, 0

        def flush():
            system, base = _file_system(folder)
            system.create_dir(base, recursive=True)
            name = f"shard-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.tok"
            with system.open_output_stream(f"{base}/{name}") as out:
                out.write(shard_bytes(documents, names, width))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([f"{folder}/{name}"]),
                 pa.array([len(documents)]), pa.array([sum(map(len, documents)) // width]),
                 pa.array([next((x for x in names if x is not None), None)], pa.int64())], schema=_MANIFEST)

        for rows in slices(batches, "text"):
            ids_ = rows.column("id").to_pylist()
            for i, value in zip(ids_, encoder.values([t or "" for t in rows.column("text").to_pylist()])):
                documents.append(value + end)
                names.append(i)
                held += len(value) + len(end)
                if held >= SHARD_BYTES:
                    yield flush()
                    documents, names, held, seq = [], [], 0, seq + 1
        if documents:
            yield flush()

    ordered = F.col("id").asc_nulls_first(), F.xxhash64("text")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    (slim.repartitionByRange(*ordered).sortWithinPartitions(*ordered).mapInArrow(write, _MANIFEST_DDL)
     .write.parquet(f"{folder}/manifest"))
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with each shard's `start`: ids of all shards before it. Prefix sums run over
    one row per writing task, then inside each task's own shards."""
    shards = spark.read.schema(_MANIFEST_DDL).parquet(f"{folder}/manifest")
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return shards.withColumn("inside", inside).join(before, "part").withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


def read_digest(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the shard files themselves."""
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def digest(batches):
        for batch in batches:
            for row in batch.to_pylist():
                system, place = _file_system(row["path"])
                with system.open_input_file(place) as f:
                    shard = Shard(f.read())
                ends = shard.index.all()
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                crc = [zlib.crc32(shard.values[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.names(), pa.int64()), pa.array(starts + row["start"]), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    schema=schema)

    many = manifest.select("path", "start").repartition(F.col("path"))
    return (many.mapInArrow(digest, "id long, start long, n_tokens long, ids_crc32 long")
            .withColumnRenamed("id", id_col))


def stored_tokens(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write `docs` with `write_tokens` (to a new scratch folder where none is named) and read
    the documents' digests back from the files."""
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    return read_digest(write_tokens(docs, folder, **options), options.get("id_col", "doc_id"))
