"""The stateless decoders applied to a streaming source.

The reference has no streaming source and no stateful operator; nothing here
adds one. Its per-row decoders (argmax, expected value, nearest valid rating,
median, CORAL rank) are plain Column expressions, so the same functions run
unchanged on a ``readStream`` DataFrame: a stream of scored rows can be
decoded and written incrementally with no state and no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.functions import decode as D


def decode_stream(scored: DataFrame, probabilities: str = "probabilities") -> DataFrame:
    """Add the four decoded ratings to a (batch or streaming) DataFrame."""
    return scored.select(
        "*", *[fn(probabilities).alias(f"rating_{name}") for name, fn in D.DECODERS.items()])


def coral_stream(scored: DataFrame, logits: str = "cumulative_logits", width: int = 3) -> DataFrame:
    """Add the CORAL rank to a (batch or streaming) DataFrame."""
    return scored.withColumn("coral_rank", D.coral_decode(F.col(logits), width))
