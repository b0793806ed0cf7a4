import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starling.operators import gradient as G
from starling.operators import learn as L

from conftest import SF


def test_coral_reduction_recovers_planted_weights(spark):
    rng = np.random.default_rng(5)
    n = 6000
    x = rng.normal(size=(n, 2))
    w, b = np.array([1.5, -1.0]), np.array([1.0, 0.0, -1.2])
    s = 1 / (1 + np.exp(-(x @ w)[:, None] - b[None, :]))
    u = rng.random(n)
    rank = (u[:, None] < s).sum(axis=1)
    df = spark.createDataFrame([(Vectors.dense(r), int(k)) for r, k in zip(x.tolist(), rank.tolist())],
                               T.StructType([T.StructField("features", VectorUDT()),
                                             T.StructField("rank", T.LongType())]))
    w_hat, b_hat = L.fit_coral_features(df)
    assert w_hat == pytest.approx(w.tolist(), abs=0.12)
    assert b_hat == pytest.approx(b.tolist(), abs=0.12)
    # a penalty on the weights leaves the biases where they are, but for what the weights take along
    assert L.fit_coral_features(df, reg_param=0.01)[1] == pytest.approx(b.tolist(), abs=0.2)


def _texts(spark, n=400):
    rng = np.random.default_rng(2)
    good, bad = [f"good{i}" for i in range(30)], [f"bad{i}" for i in range(30)]
    rows = []
    for _ in range(n):
        k = int(rng.integers(0, 4))
        rows.append((" ".join(rng.choice(good if rng.random() < k / 3 else bad) for _ in range(12)), [1, 2, 4, 5][k]))
    rows += [(None, 5), ("", 1)]
    return spark.createDataFrame(rows, "review string, rating long").repartition(3)


@pytest.mark.parametrize("loss", ["softmax", "coral"])
def test_one_run_leaves_the_snapshots_of_shorter_runs(spark, loss):
    df = _texts(spark)
    together = L.train_snapshots(df, loss, [3, 6], num_features=512)
    for n in (3, 6):
        alone = L.train_snapshots(df, loss, [n], num_features=512)[n]
        assert np.allclose(alone.linear.weights, together[n].linear.weights, atol=1e-9)
        assert np.allclose(alone.linear.biases, together[n].linear.biases, atol=1e-9)
    assert not np.allclose(together[3].linear.weights, together[6].linear.weights)


def test_losses_and_gradients_match_differences(spark):
    from starling.operators import gradient as G
    rng = np.random.default_rng(4)
    rows = [([int(i) for i in rng.integers(0, 5, int(rng.integers(0, 6)))], int(rng.integers(0, 4))) for _ in range(40)]
    blocks = G.pack(spark.createDataFrame(rows, "idx array<int>, rank long").repartition(3), entries=20)
    scales = np.linspace(0.5, 1.5, 5)
    for loss, m, k in (("coral", 1, 3), ("softmax", 4, 4)):
        theta = rng.normal(size=5 * m + k)
        at = lambda t: G.evaluate(blocks, G.Linear(loss, t[: 5 * m].reshape(5, m), t[5 * m :]), scales, 0.1)
        value, grad = at(theta)
        for i in (0, 5 * m - 1, 5 * m, len(theta) - 1):
            step = np.zeros(len(theta))
            step[i] = 1e-5
            assert (at(theta + step)[0] - at(theta - step)[0]) / 2e-5 == pytest.approx(grad[i], abs=1e-6)


def test_models_learn_save_and_load(spark):
    df = _texts(spark)
    ce, coral = L.train_ce(df, num_features=1024), L.train_coral(df, num_features=1024)
    path = f"{spark.sparkContext.getCheckpointDir()}-model-{id(ce)}"
    ce.save(spark, path)
    scored = coral.ranks(L.TextModel.load(spark, path).probabilities(df.withColumn("rank0", F.lit(0))))
    rows = scored.select("review", "rating", "probabilities", "cumulative_logits", "rank", "coral_rating").collect()
    assert all(sum(r.probabilities) == pytest.approx(1) for r in rows)
    told = [r for r in rows if r.review]
    assert np.corrcoef([r.rank for r in told], [r.rating for r in told])[0, 1] > 0.6
    assert all(r.rank == sum(x > 0 for x in r.cumulative_logits) for r in rows)


def test_training_on_no_rows(spark):
    model = L.train_coral(_texts(spark).limit(0), num_features=64)
    assert not model.linear.weights.any() and model.biases == [0.0, 0.0, 0.0]


def test_training_sees_whole_texts(spark):
    text = " ".join(f"word{i}" for i in range(1000))
    df = spark.createDataFrame([(text,)], "review string")
    assert L.tokenize(df).selectExpr("size(tokens)").first()[0] == 1000
    assert L.tokenize(df, max_length=L.MAX_LENGTH).selectExpr("size(tokens)", "n_tokens").first() == (L.MAX_LENGTH, 1000)


def test_entry_runs(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() >= 1
    assert "mae" in df.columns


def test_every_oracle_key_is_a_query():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["rating_metrics", "clean_summary", "split_allocation", "per_class",
                                  "mcnemar_exact", "early_stop", "decode_all", "align_predictions", "tokens_seen",
                                  "bootstrap_mae", "comparison_report"])
def test_selected_queries_match_duckdb_at_sf0001(spark, name):
    import duckdb
    import __spark_entry__ as entry
    con = duckdb.connect()
    for t in ("documents", "lineitem", "orders", "embeddings", "events", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = sorted(tuple(str(v) for v in r) for r in entry.queries()[name](spark, SF).select(
        *sorted(entry.queries()[name](spark, SF).columns)).collect())
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    want = sorted(tuple(str(r[i]) for i in order) for r in res.fetchall())
    assert len(got) == len(want)
    assert got == want


def test_blocks_are_bounded_whatever_a_batch_holds(spark):
    """A task unfolds some rows at a time: blocks of one large batch hold about as many entries as asked for, and the same sums."""
    rng = np.random.default_rng(4)
    rows = [(rng.integers(0, 50, 100).tolist(), int(k % 4)) for k in range(200)] + [([], 1), (list(range(40)) * 60, 2)]
    df = spark.createDataFrame(rows, "idx array<int>, rank long").coalesce(1)
    whole, cut = G.pack(df, entries=1 << 20), G.pack(df, entries=500)
    sizes = [r.e for r in cut.select((F.length("idx") / 4).alias("e")).collect()]
    assert whole.count() == 1 and len(sizes) > 10 and max(sizes) <= 1000
    model = G.Linear("softmax", rng.normal(size=(50, 4)), rng.normal(size=4))
    (a, x), (b, y) = (G.evaluate(blocks, model, np.ones(50), 0.1) for blocks in (whole, cut))
    assert a == pytest.approx(b) and np.allclose(x, y)


def test_row_runs_cover_every_row():
    lists = pa.array([[1, 2], None, [], [3, 4, 5, 6], [7], [8]]).slice(1)
    assert [r.to_pylist() for r in G.row_runs(lists, 3)] == [[None, []], [[3, 4, 5, 6]], [[7], [8]]]
    assert list(G.row_runs(pa.array([], pa.list_(pa.int32())), 3)) == []
