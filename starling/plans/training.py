"""Training plan: fit candidates on train, select on validation, score test.

    python -m starling.plans.training --prepared /shared/run1 --kind ce --out /shared/run1/ce

Candidates are training lengths (L-BFGS steps, the analogue of epochs), all taken as
snapshots of one run. Each is scored on the validation split (never on test), early
stopping with patience 1 cuts the candidate list, and the best validation MAE wins
(the earliest on a tie). The splits are read through their hash tree. The chosen model is saved as
one Parquet row, with the log of its run beside it: a document for each checkpoint, each with all entries so far.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starling.functions import decode as D
from starling.operators import evaluate as E
from starling.operators import learn as L
from starling.operators import select as SL
from starling.session import apply_cluster_defaults
from starling.sources import hashtree as HT
from starling.sources import io as IO

DEFAULT_CANDIDATES = (10, 20, 30)


def _predict(model, kind: str, df: DataFrame) -> DataFrame:
    if kind == "ce":
        return model.probabilities(df).withColumn("prediction", D.decode_argmax("probabilities").cast("double"))
    return model.ranks(df).withColumn("prediction", F.col("coral_rating").cast("double"))


def train(spark: SparkSession, splits: DataFrame, kind: str = "ce",
          candidates: Sequence[int] = DEFAULT_CANDIDATES) -> tuple[object, DataFrame, DataFrame]:
    """Returns (best model, validation history, test metrics)."""
    val = splits.where("split = 'validation'").select("review", F.col("rating").alias("label")).persist()
    test = splits.where("split = 'test'").select("review", F.col("rating").alias("label"))
    lengths = [int(n) for n in candidates]
    found = L.train_snapshots(splits.where("split = 'train'"), "softmax" if kind == "ce" else "coral", lengths)
    models, rows, schema = {}, [], None
    for epoch, n in enumerate(lengths, start=1):
        models[epoch] = found[n]
        p = _predict(models[epoch], kind, val)
        cells = E.cells(p.withColumn("system", F.lit(epoch))).withColumnRenamed("system", "epoch")
        one = SL.candidate_metrics(cells, by=("epoch",)).withColumn("run", F.lit(kind)).withColumnRenamed("mae", "eval_mae")
        schema = one.schema
        rows += one.collect()  # one row
        if len(rows) > 1 and not rows[-1]["eval_mae"] < min(r["eval_mae"] for r in rows[:-1]):
            break  # patience 1: later candidates would be cut anyway
    history = spark.createDataFrame(rows, schema)
    chosen = SL.early_stop(history).first()
    best = models[int(chosen.best_epoch)]
    test_cells = E.cells(_predict(best, kind, test).withColumn("system", F.lit(kind)))
    val.unpersist()
    return best, history, E.board(test_cells)


def write_log(history: DataFrame, path: str) -> None:
    """The validation history (a row for each candidate) as cumulative logs, one document for each checkpoint."""
    rows = sorted((r.asDict() for r in history.collect()), key=lambda r: r["epoch"])  # candidates: a few
    docs, entries, best = [], [], None
    for r in rows:
        entries = [*entries, {"epoch": float(r["epoch"]), "eval_mae": r["eval_mae"], "eval_rmse": r["rmse"],
                              "eval_exact_accuracy": r["exact_accuracy"], "eval_within_one_accuracy": r["within_one_accuracy"]}]
        name = f"checkpoint-{r['epoch']}"
        if best is None or r["eval_mae"] < best[0]:
            best = (r["eval_mae"], name)
        docs.append((r["run"], name, entries, *best))
    IO.write_json(history.sparkSession.createDataFrame(docs, IO.LOG_SCHEMA), path)


SMOKE_TRAIN_ROWS = 2000


def smoke_slice(splits: DataFrame, seed: int = 42, rows: int = SMOKE_TRAIN_ROWS) -> DataFrame:
    """A seeded exact-n sample of the training split (min(n, rows)) for a quick run; validation and
    test stay whole."""
    from starling.operators.clean import sample_n
    keyed = splits.withColumn("row_id", F.md5("review"))
    train = sample_n(keyed.where("split = 'train'"), rows, seed)
    return train.unionByName(keyed.where("split <> 'train'")).drop("row_id")


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--prepared", required=True, help="folder of the preparation plan")
    ap.add_argument("--kind", choices=("ce", "coral"), default="ce")
    ap.add_argument("--out", required=True)
    ap.add_argument("--baselines-only", action="store_true",
                    help="print the constant baselines on the test split and stop")
    ap.add_argument("--smoke-test", action="store_true", help="train on a small seeded slice")
    a = ap.parse_args(argv)
    spark = apply_cluster_defaults(SparkSession.builder.getOrCreate())
    splits = HT.read_verified(spark, f"{a.prepared}/splits", f"{a.prepared}/split_tree")
    if a.baselines_only:
        board = E.board(E.constant_baselines(splits.where("split = 'train'"), splits.where("split = 'test'")))
        print(json.dumps([r.asDict() for r in board.collect()], indent=2))
        return
    if a.smoke_test:
        splits = smoke_slice(splits)
    model, history, board = train(spark, splits, a.kind, candidates=(5,) if a.smoke_test else DEFAULT_CANDIDATES)
    model.save(spark, f"{a.out}/model")
    write_log(history, f"{a.out}/training_log")
    print(json.dumps({"validation_history": [r.asDict() for r in history.collect()],
                      "test_results": [r.asDict() for r in board.collect()]}, default=str, indent=2))


if __name__ == "__main__":
    main()
