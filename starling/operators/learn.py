"""Training and batch scoring.

* Features: word tokens of the whole text, hashed to ``num_features`` counts on the JVM side. A bag of
  words needs no window, so nothing is cut unless a caller names a ``max_length``. No vocabulary is collected.
* Training: ``operators.gradient``, a distributed full-batch fit of the cross-entropy classifier (L2) or of the
  K-1 thresholds of the ordinal one (L3), each feature scaled to unit root mean square. One run
  leaves a model at each candidate length.
* Scoring: a row's scores are sums of its tokens' weights, taken by an Arrow function over the hashed tokens
  only; texts stay on the JVM side, and decoders run as Column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starling.domain import VALID_RATINGS, rank_to_rating, rating_to_rank
from starling.functions.decode import coral_decode, softmax
from starling.functions.text import truncate_tokens, word_tokens  # noqa: F401  (re-exported)
from starling.operators import gradient as G

MAX_LENGTH = 128  # the model window of ``tokenize_truncate``; training and scoring see whole texts
NUM_FEATURES = 1 << 16


def tokenize(df: DataFrame, text: str = "review", max_length: int | None = None,
             lowercase: bool = True) -> DataFrame:
    """Adds ``tokens`` (the first ``max_length``, all by default) and ``n_tokens`` (whole text)."""
    toks = word_tokens(F.lower(F.col(text)) if lowercase else F.col(text))
    return df.withColumn("_all", toks).withColumns(
        {"n_tokens": F.size("_all"), "tokens": truncate_tokens(F.col("_all"), max_length)}).drop("_all")


def hashed_tokens(text: str = "review", num_features: int = NUM_FEATURES) -> Column:
    """The whole text's word tokens as feature numbers, repeats included; a null text has none."""
    return F.transform(word_tokens(F.lower(F.coalesce(F.col(text), F.lit("")))), lambda t: F.pmod(F.xxhash64(t), F.lit(num_features)).cast("int"))


@dataclass
class TextModel:
    """A linear model over hashed tokens, ``coral`` or ``softmax``."""

    linear: G.Linear
    text: str = "review"

    @property
    def biases(self) -> list[float]:
        return [float(b) for b in self.linear.biases]

    def _sums(self, spark: SparkSession):
        held, m = spark.sparkContext.broadcast(self.linear.weights), self.linear.weights.shape[1]  # as long as the features

        @F.arrow_udf("array<double>")
        def sums(tokens: pa.Array) -> pa.Array:
            found = [np.empty((0, m))]
            for some in G.row_runs(tokens, G.BLOCK_ENTRIES):
                flat = some.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(some)), some.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                found.append(np.stack([np.bincount(row, held.value[flat, k], len(some)) for k in range(m)], axis=1))
            out = np.concatenate(found)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1) * m, pa.int32()), pa.array(out.reshape(-1)))

        return sums(hashed_tokens(self.text, len(self.linear.weights)))

    def _scores(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_z", self._sums(df.sparkSession))

    def probabilities(self, df: DataFrame) -> DataFrame:
        """Adds ``probabilities`` (array<double>, domain order) of a ``softmax`` model."""
        logits = F.array(*[F.col("_z")[k] + F.lit(b) for k, b in enumerate(self.biases)])
        return self._scores(df).withColumn("probabilities", softmax(logits, len(self.biases))).drop("_z")

    def cumulative_logits(self, df: DataFrame) -> DataFrame:
        """Adds ``cumulative_logits`` = w.x + b_k for every threshold of a ``coral`` model."""
        logits = F.array(*[F.col("_z")[0] + F.lit(b) for b in self.biases])
        return self._scores(df).withColumn("cumulative_logits", logits).drop("_z")

    def ranks(self, df: DataFrame) -> DataFrame:
        out = self.cumulative_logits(df)
        rank = coral_decode("cumulative_logits", len(self.biases))
        return out.withColumn("rank", rank).withColumn("coral_rating", rank_to_rating(rank))

    def save(self, spark: SparkSession, path: str) -> None:
        """One Parquet row, written by Spark."""
        row = (self.linear.loss, self.text, self.linear.weights.shape[1], bytearray(self.linear.weights.astype("<f8").tobytes()), self.biases)
        spark.createDataFrame([row], "loss string, text string, m int, weights binary, biases array<double>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextModel:
        r = spark.read.parquet(path).first()
        weights = np.frombuffer(r["weights"], "<f8").reshape(-1, r["m"])
        return cls(G.Linear(r["loss"], weights, np.array(r["biases"])), r["text"])


def train_snapshots(train: DataFrame, loss: str, lengths: Sequence[int], label: str = "rating", reg_param: float = 0.01,
                    domain: Sequence[int] = VALID_RATINGS, num_features: int = NUM_FEATURES) -> dict[int, TextModel]:
    """Models after each of ``lengths`` steps of one run (``softmax`` or ``coral``) on hashed tokens of the whole texts."""
    rows = train.select(hashed_tokens("review", num_features).alias("idx"), rating_to_rank(label, domain).alias("rank"))
    found = G.fit(G.pack(rows), loss, num_features, len(domain), lengths, reg_param)
    return {n: TextModel(linear) for n, linear in found.items()}


def train_ce(train: DataFrame, label: str = "rating", reg_param: float = 0.01, max_iter: int = 30,
             domain: Sequence[int] = VALID_RATINGS, num_features: int = NUM_FEATURES) -> TextModel:
    """Multinomial cross-entropy classifier."""
    return train_snapshots(train, "softmax", [max_iter], label, reg_param, domain, num_features)[max_iter]


def train_coral(train: DataFrame, label: str = "rating", reg_param: float = 0.01, max_iter: int = 30,
                domain: Sequence[int] = VALID_RATINGS, num_features: int = NUM_FEATURES) -> TextModel:
    """Ordinal classifier: one projection, K-1 biases."""
    return train_snapshots(train, "coral", [max_iter], label, reg_param, domain, num_features)[max_iter]


def fit_coral_features(x: DataFrame, features: str = "features", rank: str = "rank", n_thresholds: int = 3,
                       reg_param: float = 0.0, max_iter: int = 200) -> tuple[list[float], list[float]]:
    """The ordinal fit on ready numeric features (array<double> of one length, or ML vectors): (weights, biases)."""
    if dict(x.dtypes)[features] == "vector":
        from pyspark.ml.functions import vector_to_array
        x = x.withColumn(features, vector_to_array(features))
    width = x.agg(F.max(F.size(features))).first()[0] or 0
    rows = x.select(F.sequence(F.lit(0), F.size(features) - 1).alias("idx"), F.col(features).alias("val"), rank)
    model = G.fit(G.pack(rows, rank=rank, val="val"), "coral", width, n_thresholds + 1, [max_iter], reg_param, np.ones(width), tolerance=1e-10)[max_iter]
    return model.weights[:, 0].tolist(), model.biases.tolist()


def foreign_scorer(make_predict_fn, n_classes: int = len(VALID_RATINGS), batch_size: int = 128):
    """A model outside Spark ML as a batch function: ``make_predict_fn()`` is
    called once per Python worker and returns ``f(ndarray[str]) -> ndarray
    (batch, n_classes)`` of class probabilities in domain order. Rows reach it
    in Arrow batches of ``batch_size`` (``predict_batch_udf``)."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType

    return predict_batch_udf(make_predict_fn, return_type=ArrayType(DoubleType()), batch_size=batch_size)
