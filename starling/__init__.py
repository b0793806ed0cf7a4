"""starling: labelled-text rating data preparation, ordinal decoding and
model evaluation, written as Spark DataFrame and Column functions.

Sub-packages:

* ``functions`` - Column builders (text cleanup, decoders, metric aggregates,
  formatting helpers). Pure expressions, no actions.
* ``operators`` - DataFrame -> DataFrame operators (cleaning, splitting,
  metrics boards, confusion, bootstrap, significance, selection, learning).
* ``sources`` - readers and writers (TSV, manifests, splits, training logs,
  fingerprints, results payloads).
* ``plans`` - fixture views over the driver tables and the end-to-end plans
  (prepare, evaluate, train) plus the query catalog.
* ``streaming`` - the stateless decoders applied to a streaming source.
"""

from starling.domain import VALID_RATINGS, ALL_SCALE_VALUES, SEED

__all__ = ["VALID_RATINGS", "ALL_SCALE_VALUES", "SEED"]
