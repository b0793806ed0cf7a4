import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F


def _early_stop_reference(maes):
    """Patience 1: stop after the first epoch that does not beat the best so far."""
    best, best_e = None, None
    for e, m in enumerate(maes, start=1):
        if best is not None and m >= best:
            return e, True, best_e, best
        if best is None or m < best:
            best, best_e = m, e
    return len(maes), False, best_e, best


def test_early_stop_matches_loop(spark):
    from starling.operators.select import early_stop
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for run in range(40):
        n = int(rng.integers(1, 12))
        if run % 3 == 0:
            maes = sorted(rng.integers(0, 50, n).tolist(), reverse=True)  # may never stall
            maes = [float(x) + 1 - i * 1e-3 for i, x in enumerate(maes)]
        else:
            maes = [float(x) for x in rng.integers(0, 6, n)]  # many ties
        want[run] = _early_stop_reference(maes)
        rows += [(run, e, m) for e, m in enumerate(maes, start=1)]
    df = spark.createDataFrame(rows, "run long, epoch long, eval_mae double")
    got = {r.run: (r.stop_epoch, r.stopped_early, r.best_epoch, r.best_eval_mae)
           for r in early_stop(df, partitions=5).collect()}
    assert got == want


def _runs_with_outlier(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", int(t), int(i), float(v)) for i, (t, v) in enumerate(zip(rng.integers(0, 400, 9_000), rng.integers(0, 9, 9_000)))]
    rows += [("hot", 10**15, 9_000, 2.0)]  # one far outlier in time
    rows += [(f"r{int(g)}" if g else None, int(t), 10_000 + i, float(v)) for i, (g, t, v) in
             enumerate(zip(rng.integers(0, 6, 900), rng.integers(0, 50, 900), rng.integers(0, 9, 900)))]
    return spark.createDataFrame(rows, "run string, ts long, event_id long, v double").repartition(7)


def test_running_equals_windows_and_spreads_one_hot_run(spark):
    from starling.operators.ordered import running
    df = _runs_with_outlier(spark)
    got = running(df, ["run"], ["ts", "event_id"], "epoch", "v", partitions=16)
    w = Window.partitionBy("run").orderBy("ts", "event_id")
    want = df.withColumn("epoch", F.row_number().over(w))
    want = want.withColumn("prior", F.min(F.struct(F.col("v").alias("value"), F.col("epoch").cast("long").alias("epoch")))
                           .over(w.rowsBetween(Window.unboundedPreceding, -1)))
    key = lambda r: r["event_id"]
    assert sorted(got.select("event_id", "epoch", "prior").collect(), key=key) == sorted(want.select("event_id", "epoch", "prior").collect(), key=key)
    # sampled ranges: the hot run lies in many partitions of like size, the outlier notwithstanding
    dealt = df.repartitionByRange(16, "run", "ts", "event_id").where("run = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) >= 8 and max(r["count"] for r in dealt) < 2_000


def test_running_on_no_rows_and_one_row(spark):
    from starling.operators.ordered import running
    df = spark.createDataFrame([("a", 1, 0.5)], "run string, e long, v double")
    assert [tuple(r) for r in running(df, ["run"], ["e"], value="v").collect()] == [("a", 1, 0.5, 1, None)]
    assert running(df.limit(0), ["run"], ["e"], value="v").collect() == []


def test_selection_finds_the_keys_at_ranks(spark):
    import hashlib

    from starling.operators.selection import select_keys
    rows = [(g, hashlib.md5(f"{g}:{i}".encode()).hexdigest()) for g, n in ((0, 3_000), (1, 1), (None, 40)) for i in range(n)]
    rows += [(2, "ab" * 8 + f"{i:016x}") for i in range(50)]  # the first half of the key decides nothing
    df = spark.createDataFrame(rows, "g long, k string")
    goals = {0: (0, 1, 1_500, 3_000), 1: (1,), 2: (7, 50), None: (13, 26)}
    bounds = select_keys(df, "g", "k", goals, digits=2)
    for g, ranks in goals.items():
        assert [sum(k < b for h, k in rows if h == g) for b in bounds[g]] == list(ranks)
