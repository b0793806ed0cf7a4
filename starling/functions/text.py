"""Text helpers: Unicode trim, missing-value tokens, word tokens.

The trim character class is generated from Python's ``str.isspace`` (the rule
pandas' ``.str.strip()`` applies), rendered with ``\\x{..}`` escapes that both
Java regex (Spark) and RE2 (DuckDB) accept, so one pattern serves both engines.
Spark's own ``trim`` only removes U+0020.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def whitespace_class() -> str:
    points = [c for c in range(0x110000) if chr(c).isspace()]
    ranges: list[tuple[int, int]] = []
    for c in points:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1] = (ranges[-1][0], c)
        else:
            ranges.append((c, c))
    parts = []
    for lo, hi in ranges:
        parts.append(f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}")
    return "[" + "".join(parts) + "]"


@lru_cache(maxsize=1)
def trim_pattern() -> str:
    ws = whitespace_class()
    return f"\\A{ws}+|{ws}+\\z"


@lru_cache(maxsize=1)
def whitespace_chars() -> str:
    return "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def unicode_trim(c: Column | str) -> Column:
    """Strip leading and trailing Unicode whitespace (``str.strip()``).

    Uses ``trim(BOTH <set> FROM c)``, which only walks the whitespace at the
    two ends (a regex would scan the whole text). ``trim_pattern`` is the
    equivalent regex for engines without a character-set trim.
    """
    col = F.col(c) if isinstance(c, str) else c
    return F.trim(col, F.lit(whitespace_chars()))


# Fixed values that must equal the reference for right results: the tokens
# pandas.read_csv turns into a missing value by default.
PANDAS_NA_TOKENS: tuple[str, ...] = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# End of fixed values.


def na_to_null(c: Column | str, tokens: Sequence[str] = PANDAS_NA_TOKENS) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.isin(list(tokens)), F.lit(None).cast("string")).otherwise(col)


# Word tokens: runs of letters, digits or underscore in any script. The same
# pattern is valid in Java regex and RE2.
WORD_PATTERN = r"[\pL\pN_]+"


def word_tokens(c: Column | str, pattern: str = WORD_PATTERN) -> Column:
    """All word tokens of the whole text, in order."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(col, F.lit(pattern), 0)


def truncate_tokens(tokens: Column, max_length: int | None) -> Column:
    """Model-input window: the first ``max_length`` tokens (None keeps all)."""
    if max_length is None:
        return tokens
    return F.slice(tokens, 1, int(max_length))


def batch_tokenizer(tokenize_batch, max_length: int | None = None):
    """Wrap a Python batch tokenizer ``list[str] -> list[list[str]]`` (for
    example a subword tokenizer loaded once per worker) as an Arrow-batched
    pandas UDF returning ``array<string>``. Use only where the regex tokens
    of ``word_tokens`` are not enough: this is the Python path."""
    @F.pandas_udf("array<string>")
    def _tok(texts: pd.Series) -> pd.Series:
        out = tokenize_batch(texts.fillna("").tolist())
        if max_length is not None:
            out = [t[:max_length] for t in out]
        return pd.Series(out)

    return _tok
