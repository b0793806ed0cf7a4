import bisect
import hashlib
import math
from decimal import Decimal, getcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from starling.functions import metrics as M
from starling.functions import stats
from starling.operators import evaluate as E
from starling.operators import resample as RS
from starling.operators import significance as SG


def _ratings(n, noise, seed):
    """Labels of the scale, and predictions that miss with the given rate."""
    rng = np.random.default_rng(seed)
    y = rng.choice([1, 2, 4, 5], n)
    return y, np.where(rng.random(n) < noise, rng.choice([1, 2, 4, 5], n), y)


def _cells(spark, systems):
    rows = [(name, int(a), float(b)) for name, (y, p) in systems.items() for a, b in zip(y, p)]
    return E.cells(spark.createDataFrame(rows, "system string, label long, prediction double"))


@pytest.mark.parametrize("strategy", ["cells", "hash"])
def test_same_seed_same_interval(spark, strategy):
    c = _cells(spark, {"s": _ratings(150, 0.3, 3)}).drop("system")
    runs = [RS.bootstrap_ci(c, {"mae": M.mae}, strategy, n_resamples=60, seed=11).collect() for _ in range(2)]
    assert runs[0] == runs[1]
    assert runs[0][0].ci_low <= runs[0][0].point <= runs[0][0].ci_high


def test_an_interval_does_not_hang_on_its_company(spark):
    both = _cells(spark, {"a": _ratings(120, 0.2, 1), "b": _ratings(140, 0.4, 2)})
    kw = {"n_resamples": 80, "seed": 5, "by": ["system"]}
    together = {r.system: r for r in RS.bootstrap_cells(both, {"mae": M.mae}, **kw).collect()}
    alone = RS.bootstrap_cells(both.where("system = 'b'"), {"mae": M.mae}, **kw).first()
    assert together["b"] == alone


def test_cells_and_row_draws_agree(spark):
    y, p = _ratings(400, 0.3, 8)
    got = RS.bootstrap_cells(_cells(spark, {"s": (y, p)}).drop("system"), {"mae": M.mae}, n_resamples=1500, seed=2).first()
    rng = np.random.default_rng(0)
    error = np.abs(y - p)
    means = [error[rng.integers(0, 400, 400)].mean() for _ in range(4000)]
    low, high = np.quantile(means, [0.025, 0.975])
    assert got.point == pytest.approx(error.mean())
    assert got.ci_low == pytest.approx(low, abs=0.02) and got.ci_high == pytest.approx(high, abs=0.02)


def test_predictions_that_all_differ(spark):
    """More cells than any table of cells should hold in one place."""
    n = 1_200_000
    cells = spark.range(n).select((F.col("id") % 5 + 1).alias("label"), (F.col("id") / n).alias("prediction"), F.lit(1).cast("long").alias("n"))
    got = RS.bootstrap_cells(cells, {"mae": M.mae}, n_resamples=4, seed=1).first()
    assert got.point == pytest.approx(2.5, abs=0.01)
    assert abs(got.ci_low - got.point) < 0.01 and abs(got.ci_high - got.point) < 0.01


def test_no_spread_no_width(spark):
    y = [4] * 30
    r = RS.bootstrap_ci(_cells(spark, {"s": (y, y)}).drop("system"), {"mae": M.mae}, "cells", n_resamples=40, seed=9).first()
    assert (r.point, r.ci_low, r.ci_high) == (0.0, 0.0, 0.0)


def test_poisson_weights_on_rows(spark):
    df = spark.range(240).select(F.col("id").alias("row_id"), (F.col("id") % 4 + 1).alias("label"), ((F.col("id") * 7) % 4 + 1).cast("double").alias("prediction"))
    r = RS.bootstrap_ci(df, {"mae": M.mae}, "poisson", n_resamples=50, seed=3).first()
    assert r.ci_low <= r.point <= r.ci_high


def _plain_draw(seed, b, j, n):
    return int(hashlib.md5(f"{seed}:{b}:{j}".encode()).hexdigest()[:15], 16) % n


@pytest.mark.parametrize(("seed", "b", "first", "stop", "n"), [
    (42, 0, 0, 12_345, 12_345), (42, 999, 99_990, 100_020, 477_777), (-7, 12, 9_999_999, 10_000_003, 1 << 40), (10 ** 22, 10 ** 12, 10 ** 17, 10 ** 17 + 5, 10 ** 18), (1, 1, 0, 1, 1)])
def test_hashed_draws_are_those_of_sql(seed, b, first, stop, n):
    """Of one block of 64 bytes or two, and where numbers get another digit."""
    got = np.concatenate(list(RS.replicate_draws(seed, b, first, stop, n)))
    assert got.tolist() == [_plain_draw(seed, b, j, n) for j in range(first, stop)]


@pytest.mark.parametrize("n_buckets", [4096, 7, 1])
def test_hash_bootstrap_is_that_of_single_draws(spark, n_buckets):
    """Buckets of one row, of several rows of one cell, and shared by cells give the same counts."""
    systems, b, seed = {"s": _ratings(300, 0.3, 3), "t": _ratings(300, 0.5, 4)}, 40, 11
    got = {r.system: r for r in RS.bootstrap_hash(_cells(spark, systems), {"mae": M.mae}, n_resamples=b, seed=seed, by=["system"], n_buckets=n_buckets).collect()}
    for name, (y, p) in systems.items():
        rows = np.array(sorted(zip(y, p)))
        error = np.abs(rows[:, 0] - rows[:, 1])
        means = [error[[_plain_draw(seed, k, j, 300) for j in range(300)]].mean() for k in range(b)]
        assert (got[name].ci_low, got[name].ci_high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))


def test_draws_inside_a_cell_are_only_counted(spark):
    """Two cells of 30,000 rows: but for the bucket where they meet, a replicate sends a row for each bucket."""
    n, width = 60_000, 1000
    draws = RS.spark_range_draws(spark, 3, n, 5, width, [29])
    got = draws.groupBy("b").agg(F.count("*").alias("rows"), F.sum("w").alias("draws"), F.count_if(F.col("bucket") == 29).alias("single")).collect()
    assert len(got) == 3 and all(r.draws == n and r.rows - r.single <= 59 * spark.sparkContext.defaultParallelism and r.single < 1200 for r in got)


@pytest.mark.parametrize(("seed", "b", "n", "starts"), [
    (42, 1, 12_345, [0, 1, 2, 500, 12_000]), (-7, 3, 1024, list(range(1024))), (10 ** 22, 2, 5000, list(range(0, 5000, 3))), (10 ** 45, 2, 1007, [0, 9, 1006]), (1, 12, 1, [0])])
def test_counted_draws_are_those_of_sql(spark, seed, b, n, starts):
    """Where numbers get another digit, and with several cuts in a slot of the lookup table."""
    got = {(r.b, r.idx): r.w for r in RS.counted_draws(spark, b, n, seed, starts).collect()}
    want = {}
    for k in range(b):
        for j in range(n):
            key = (k, starts[bisect.bisect_right(starts, _plain_draw(seed, k, j, n)) - 1])
            want[key] = want.get(key, 0) + 1
    assert got == want


def test_counted_draws_of_chunks_add_up(spark, monkeypatch):
    monkeypatch.setattr(RS, "_COUNTED_CHUNK_DRAWS", 1000)
    got = RS.counted_draws(spark, 2, 4321, 9, [0, 77]).groupBy("b", "idx").agg(F.sum("w").alias("w"), F.count("*").alias("chunks")).collect()
    want = {(k, s): sum((_plain_draw(9, k, j, 4321) >= 77) == (s == 77) for j in range(4321)) for k in range(2) for s in (0, 77)}
    assert {(r.b, r.idx): r.w for r in got} == want and all(r.chunks == 5 for r in got)


@pytest.mark.parametrize("metric", [M.mae, M.exact, M.qwk])
def test_a_replicate_sends_a_row_a_cell(spark, monkeypatch, metric):
    """And no draw is hashed in Python; hashed in numpy, draws give the same interval."""
    cells, sent, kw = _cells(spark, {"s": _ratings(3000, 0.3, 3)}).drop("system"), [], {"n_resamples": 20, "seed": 11}
    drawn = RS.spark_range_draws
    monkeypatch.setattr(RS, "spark_range_draws", lambda *a, **k: sent.append(drawn(*a, **k)) or sent[-1])
    counted = RS.bootstrap_hash(cells, {"m": metric}, **kw).first()
    assert sent[0].count() <= 20 * cells.count() and sent[0].agg(F.sum("w")).first()[0] == 20 * 3000
    assert "MapInArrow" not in sent[0]._jdf.queryExecution().toString()
    monkeypatch.setattr(RS, "_CUTS", 1)
    one_by_one = RS.bootstrap_hash(cells, {"m": metric}, **kw).first()
    assert "MapInArrow" in sent[1]._jdf.queryExecution().toString()
    assert (counted.point, counted.ci_low, counted.ci_high) == pytest.approx((one_by_one.point, one_by_one.ci_low, one_by_one.ci_high))


def test_hashed_paired_delta_is_that_of_single_draws(spark):
    y, a, b, n = *_ratings(200, 0.4, 4), _ratings(200, 0.7, 4)[1], 200
    cells = _paired(spark, y, a, b)
    r = RS.bootstrap_hash(cells, {"d": RS.paired_delta_metric(M.mae)}, n_resamples=30, seed=6, cell_cols=("label", "pred_a", "pred_b"), pred="pred_a").first()
    rows = np.array(sorted(zip(y, a, b)))
    delta = np.abs(rows[:, 0] - rows[:, 1]) - np.abs(rows[:, 0] - rows[:, 2])
    means = [delta[[_plain_draw(6, k, j, n) for j in range(n)]].mean() for k in range(30)]
    assert (r.ci_low, r.ci_high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))


def test_a_replicate_sends_a_row_a_paired_cell(spark, monkeypatch):
    cells, sent = _paired(spark, *_ratings(2000, 0.4, 4), _ratings(2000, 0.7, 4)[1]), []
    drawn = RS.spark_range_draws
    monkeypatch.setattr(RS, "spark_range_draws", lambda *a, **k: sent.append(drawn(*a, **k)) or sent[-1])
    RS.bootstrap_hash(cells, {"d": RS.paired_delta_metric(RS.snapped(M.mae))}, n_resamples=10, seed=6, cell_cols=("label", "pred_a", "pred_b"), pred="pred_a")
    assert sent[0].count() <= 10 * cells.count() and sent[0].agg(F.sum("w")).first()[0] == 10 * 2000


def test_texts_longer_than_a_block_and_other_sessions(spark):
    cells, seed = _cells(spark, {"s": _ratings(50, 0.3, 3)}).drop("system"), 10 ** 60
    rows = np.array([abs(r.label - r.prediction) for r in sorted(cells.collect()) for _ in range(r.n)])
    for s, session in ((seed, spark), (7, spark.newSession())):
        given = session.createDataFrame([tuple(r) for r in cells.collect()], cells.schema)
        r = RS.bootstrap_hash(given, {"mae": M.mae}, n_resamples=10, seed=s).first()
        means = [rows[[_plain_draw(s, k, j, 50) for j in range(50)]].mean() for k in range(10)]
        assert (r.ci_low, r.ci_high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))


def test_draws_reach_the_last_rows(spark):
    n = 20_000_000_000
    ids = spark.range(0, 2000)
    far = ids.select(F.max(RS.draw_index(1, F.lit(0), F.col("id"), F.lit(n)))).first()[0]
    assert far > 0.99 * n


def _paired(spark, y, a, b):
    df = spark.createDataFrame([(int(u), float(v), float(w)) for u, v, w in zip(y, a, b)], "label long, pred_a double, pred_b double")
    return df.groupBy("label", "pred_a", "pred_b").agg(F.count(F.lit(1)).alias("n"))


@pytest.mark.parametrize("noise,apart", [(0.6, True), (0.0, False)])
def test_paired_delta(spark, noise, apart):
    y, good = _ratings(250, 0.0, 4)
    other = _ratings(250, noise, 4)[1] if noise else good
    r = RS.excludes_zero(RS.bootstrap_ci(_paired(spark, y, good, other), {"d": RS.paired_delta_metric(M.mae)}, "cells", n_resamples=150,
                                         cell_cols=("label", "pred_a", "pred_b"), pred="pred_a")).first()
    assert r.excludes_zero is apart
    assert r.point == pytest.approx(-np.abs(y - other).mean())


def test_mcnemar_counts(spark):
    rows = [(2, 2.0, 4.0)] * 25 + [(5, 4.0, 5.0)] * 4 + [(1, 1.0, 1.0)] * 9
    r = SG.mcnemar(spark.createDataFrame(rows, "label long, pred_a double, pred_b double")).first()
    assert (r.a_right_b_wrong, r.a_wrong_b_right, r.n_discordant) == (25, 4, 29)
    assert r.p_value == pytest.approx(2 * sum(math.comb(29, i) for i in range(5)) / 2**29, rel=1e-12) and r.significant


def test_mcnemar_without_discordant_pairs(spark):
    r = SG.mcnemar(spark.createDataFrame([(4, 4.0, 4.0), (2, 5.0, 1.0)], "label long, pred_a double, pred_b double")).first()
    assert r.p_value == 1.0 and r.significant is False


def test_mcnemar_golden_p_value(spark):
    # published: b = 5242, c = 2290 -> p = 2.84306e-260
    ln_p = SG.exact_ln_p(spark, 5242, 2290).first().ln_p
    assert math.exp(ln_p) == pytest.approx(2.84306e-260, rel=1e-5)


def _ln_factorial(n):
    """To 50 digits, for large n."""
    getcontext().prec = 60
    x, pi = Decimal(n), Decimal("3.14159265358979323846264338327950288419716939937510582097494459")
    return x * x.ln() - x + (2 * pi * x).ln() / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


@pytest.mark.parametrize("n,m", [(10**10, 5 * 10**9 - 70_000), (10**10, 4 * 10**9), (3 * 10**9 + 5, 10**6)])
def test_binomial_terms_at_any_size(n, m):
    want = _ln_factorial(n) - _ln_factorial(m) - _ln_factorial(n - m) - n * Decimal(2).ln()
    assert stats.ln_half_binomial(n, m) == pytest.approx(float(want), rel=1e-13, abs=1e-9)


def test_mcnemar_beyond_32_bits(spark):
    assert SG.exact_ln_p(spark, 3 * 10**9, 5).first().ln_p < -1e9
    n = 10**10
    z = 2.0  # two standard deviations below the middle
    p = math.exp(SG.exact_ln_p(spark, n // 2 + int(z * math.sqrt(n) / 2), n - (n // 2 + int(z * math.sqrt(n) / 2))).first().ln_p)
    assert p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-4)


@pytest.mark.parametrize("b,c", [(0, 1), (1, 9), (16, 17), (40, 3), (7, 7)])
def test_mcnemar_small_counts(spark, b, c):
    n, m = b + c, min(b, c)
    want = 1.0 if b == c else min(1.0, 2 * sum(math.comb(n, i) for i in range(m + 1)) / 2**n)
    assert math.exp(SG.exact_ln_p(spark, b, c).first().ln_p) == pytest.approx(want, rel=1e-12)


def test_parts_of_a_replicate_add_up():
    totals = np.array([5, 0, 17, 40, 1, 0, 9])
    rows = np.stack([RS.rows_of_part(totals, k, 300, [4, 2]) for k in range(len(totals))])
    assert (rows.sum(axis=0) == totals.sum()).all() and (rows[[1, 5]] == 0).all()
    assert rows.mean(axis=1) == pytest.approx(totals, abs=1.0)


def test_sums_and_cells_give_like_intervals(spark):
    c = _cells(spark, {"s": _ratings(500, 0.3, 6)}).drop("system")
    metrics = {"mae": M.mae, "qwk": M.qwk, "rmse": M.rmse}
    by_sums = {r.metric: r for r in RS.bootstrap_cells(c, metrics, n_resamples=800, seed=3).collect()}
    plain = {k: (lambda y, p, w, f=f: f(y, p, w)) for k, f in metrics.items()}  # not known as sums: cells travel
    by_cells = {r.metric: r for r in RS.bootstrap_cells(c, plain, n_resamples=800, seed=3).collect()}
    for k in metrics:
        assert by_sums[k].point == pytest.approx(by_cells[k].point)
        assert by_sums[k].ci_low == pytest.approx(by_cells[k].ci_low, rel=1e-9) and by_sums[k].ci_high == pytest.approx(by_cells[k].ci_high, rel=1e-9)


def test_little_bootstraps_cover_a_known_median(spark):
    """60 tables of exponential errors, whose median is ln 2."""
    rng = np.random.default_rng(12)
    rows = [(t, t * 10_000 + i, 0.0, float(e)) for t in range(60) for i, e in enumerate(rng.exponential(size=900))]
    df = spark.createDataFrame(rows, "t int, row_id long, label double, prediction double")
    got = RS.bootstrap_ci(df, {"median_error": RS.median_error}, "little", n_resamples=60, seed=1, by=["t"]).collect()
    assert len(got) == 60
    covered = sum(r.ci_low <= math.log(2) <= r.ci_high for r in got)
    assert covered >= 52  # of nominally 57
    widths = [r.ci_high - r.ci_low for r in got]
    assert np.mean(widths) == pytest.approx(2 * 1.96 / math.sqrt(900), rel=0.2)  # 1 / (2 f(median) sqrt(n)), f = 1/2


def test_little_bootstraps_agree_with_sums_on_a_mean(spark):
    y, p = _ratings(3000, 0.3, 8)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "row_id long, label long, prediction double")
    mean = lambda a, b, w: float((np.abs(a - b) * w).sum() / w.sum())
    little = RS.bootstrap_little(df, {"mae": mean}, n_resamples=100, seed=2).first()
    whole = RS.bootstrap_cells(E.cells(df.withColumn("system", F.lit("s"))).drop("system"), {"mae": M.mae}, n_resamples=800, seed=2).first()
    assert little.ci_high - little.ci_low == pytest.approx(whole.ci_high - whole.ci_low, rel=0.2)
    assert RS.bootstrap_little(df.limit(0), {"mae": mean}, n_resamples=5).collect() == []
