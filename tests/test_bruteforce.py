"""Rows-only operators checked against brute force on small fixtures."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from starling.functions import metrics as M
from starling.operators import resample as RS
from starling.sources import io as IO

from conftest import SF


def _numpy_ci(y, p, b=2000, seed=11):
    rng = np.random.default_rng(seed)
    n = len(y)
    vals = np.empty(b)
    for i in range(b):
        idx = rng.integers(0, n, n)
        vals[i] = np.mean(np.abs(p[idx] - y[idx]))
    return np.quantile(vals, [0.025, 0.975])


def test_multinomial_and_hash_bootstrap_agree_with_row_resampling(spark):
    rng = np.random.default_rng(4)
    dom = np.array([1, 2, 4, 5])
    y = rng.choice(dom, 3000, p=[.2, .3, .1, .4])
    p = np.where(rng.random(3000) < 0.6, y, rng.choice(dom, 3000))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "label long, prediction double")
    cells = df.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    lo, hi = _numpy_ci(y.astype(float), p)
    for strategy in ("cells", "hash"):
        r = RS.bootstrap_ci(cells, {"mae": M.mae}, strategy, n_resamples=1000, seed=42).first()
        assert r.point == pytest.approx(np.mean(np.abs(p - y)))
        assert r.ci_low == pytest.approx(lo, abs=0.012)
        assert r.ci_high == pytest.approx(hi, abs=0.012)


def test_file_fingerprint_matches_hashlib(spark):
    got = {r.file: (r.bytes, r.sha256) for r in IO.file_fingerprint(spark, SF, "*.parquet").collect()}
    for name in ("region.parquet", "nation.parquet", "labels.parquet"):
        data = open(os.path.join(SF, name), "rb").read()
        assert got[name] == (len(data), hashlib.sha256(data).hexdigest())


def test_tsv_roundtrip_keeps_awkward_text(spark):
    from starling.session import scratch_path
    rows = [(1, ' lead and trail  '), (2, 'tab\tinside'), (4, 'line\nbreak "quoted"'), (5, 'NA'), (1, '')]
    df = spark.createDataFrame(rows, "rating long, review string")
    path = scratch_path(spark, "tsv_test")
    IO.write_tsv(df, path)
    back = {r.rating * 1000 + i: r.review for i, r in enumerate(IO.read_tsv(spark, path).orderBy("rating", "review").collect())}
    texts = sorted((r for r in back.values()), key=lambda x: (x is None, x or ""))
    assert ' lead and trail  ' in texts and 'tab\tinside' in texts and 'line\nbreak "quoted"' in texts
    assert texts.count(None) == 2  # 'NA' and '' are pandas missing-value tokens


def test_trainer_state_files(spark):
    import json
    import tempfile
    from pyspark.sql import functions as G
    root = tempfile.mkdtemp(prefix="results-")
    states = {900: [{"loss": 0.9, "epoch": 1.0}, {"eval_mae": 0.39, "eval_loss": 0.69, "epoch": 1.0, "step": 900}],
              1000: [{"loss": 0.9, "epoch": 1.0}, {"eval_mae": 0.39, "eval_loss": 0.69, "epoch": 1.0, "step": 900},
                     {"eval_mae": 0.38, "eval_rmse": 0.84, "epoch": 2.0, "step": 1000}]}
    for step, hist in states.items():
        os.makedirs(f"{root}/checkpoint-{step}")
        with open(f"{root}/checkpoint-{step}/trainer_state.json", "w") as f:
            json.dump({"log_history": hist, "best_metric": 0.38, "global_step": step,
                       "best_model_checkpoint": f"{root}/checkpoint-1000"}, f, indent=2)
    logs = IO.read_trainer_states(spark, root, run="ce")
    latest = IO.latest_checkpoint(logs).first()
    assert latest.latest_checkpoint == "checkpoint-1000" and latest.n_checkpoints == 2
    newest = logs.where(G.col("checkpoint") == latest.latest_checkpoint)
    hist = sorted((r.metrics["epoch"], sorted(r.metrics)) for r in IO.validation_history(newest).collect())
    assert hist == [(1.0, ["epoch", "eval_loss", "eval_mae"]), (2.0, ["epoch", "eval_mae", "eval_rmse"])]
