"""Token counts of whole texts: Arrow batches in, lengths out.

Rows are encoded in batches of equal bytes, not of equal rows, and a text longer
than `LONG_TEXT` is cut at safe boundaries first, so one giant text is just more
pieces of ordinary size. Only lengths leave the worker. No shuffle: the work is split as
the scan is."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.llm.common import slices
from starling.llm.encoding import BOUNDARY, Encoder, tokenizer_path

#: Bytes that are encoded in one batch.
BATCH_BYTES = 1 << 20
#: Characters from which a text is cut into parts.
LONG_TEXT = 1 << 18


def parts(text: str, limit: int = LONG_TEXT) -> Iterator[tuple[str, bool]]:
    """The text in parts of about `limit` characters, cut at safe boundaries (later, where
    there is none): (part, whether it follows a boundary). A boundary's space is left off."""
    at, continued = 0, False
    while len(text) - at > limit:
        found = BOUNDARY.search(text, at + limit)
        if not found:
            break
        yield text[at : found.start()], continued
        at, continued = found.start() + 1, True
    yield text[at:], continued


def token_counts(docs: DataFrame, path: str | None = None, leading_space: bool = True, id_col: str = "doc_id",
                 text_col: str = "text", max_tokens: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row of `docs`.

    Counts are those of the tokenizer on the whole text without added special tokens.
    Null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows are
    counted each; an empty table gives an empty result. Other columns are not read."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches):
        encoder = Encoder.of(path, leading_space, counts_only=True)
        for rows in slices(batches, "text", BATCH_BYTES):
            texts, owner, continued = [], [], []
            for i, text in enumerate(rows.column("text").to_pylist()):
                for part, follows in parts(text or ""):
                    texts.append(part)
                    owner.append(i)
                    continued.append(follows)
            n = [0] * rows.num_rows
            for i, k in zip(owner, encoder.values(texts, continued)):
                n[i] += k
            size = pc.fill_null(pc.binary_length(rows.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("id"), size, pa.array(n, pa.int64())], schema=schema)

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return (slim.mapInArrow(count, "id long, n_bytes long, n_tokens long")
            .select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit")))
