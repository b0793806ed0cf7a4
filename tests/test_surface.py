import numpy as np
import pytest

from starling.functions import metrics as M
from starling.functions.text import batch_tokenizer
from starling.operators.learn import foreign_scorer


def _sk_qwk(a, b):
    """Weighted kappa on observed labels, brute force (confusion + weights)."""
    labels = sorted(set(a) | set(b))
    idx = {v: i for i, v in enumerate(labels)}
    k = len(labels)
    o = np.zeros((k, k))
    for x, y in zip(a, b):
        o[idx[x], idx[y]] += 1
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    w = np.array([[(i - j) ** 2 for j in range(k)] for i in range(k)], dtype=float)
    return 1 - (w * o).sum() / (w * e).sum()


def test_qwk_observed_only_compresses_absent_ranks(spark):
    y = [1, 1, 4, 5, 5, 4, 1, 5]
    p = [1, 4, 4, 5, 4, 5, 1, 1]
    df = spark.createDataFrame([(a, float(b)) for a, b in zip(y, p)], "label long, prediction double")
    rank = {1: 0, 2: 1, 4: 2, 5: 3}
    want = _sk_qwk([rank[v] for v in y], [rank[v] for v in p])
    assert M.qwk_observed(df).first().qwk == pytest.approx(want, abs=1e-12)
    fixed = df.agg(M.qwk("label", "prediction")).first()[0]
    assert fixed != pytest.approx(want)  # rank 1 (rating 2) absent: scales differ


def test_observed_kappa_of_each_system(spark):
    from starling.operators import evaluate as E
    rng = np.random.default_rng(6)
    systems = {"a": ([1, 2, 4, 5], [1, 2, 4, 5]), "b": ([1, 5], [1, 5]), "c": ([2, 4, 5], [1, 2])}
    rows = [(s, int(rng.choice(y)), float(rng.choice(p))) for s, (y, p) in systems.items() for _ in range(80)]
    df = spark.createDataFrame(rows, "system string, label long, prediction double")
    rank = {1: 0, 2: 1, 4: 2, 5: 3}
    for r in E.observed_kappa(df).collect():
        mine = [(rank[y], rank[int(p)]) for s, y, p in rows if s == r.system]
        assert r.n == 80 and r.qwk_observed == pytest.approx(_sk_qwk(*zip(*mine)), abs=1e-12)
    cells = E.cells(df)
    assert sorted(E.observed_kappa(cells, n="n").collect()) == sorted(E.observed_kappa(df).collect())


def test_another_domain_throughout(spark):
    from pyspark.sql import functions as F

    from starling.domain import rank_to_rating, rating_to_rank
    from starling.functions import decode as D
    from starling.operators import confusion as CF
    from starling.operators import evaluate as E
    domain = (0, 10, 30)
    rows = [(0, [0.7, 0.2, 0.1]), (10, [0.2, 0.5, 0.3]), (30, [0.1, 0.3, 0.6]), (30, [0.4, 0.4, 0.2]), (0, [0.1, 0.1, 0.8])]
    df = spark.createDataFrame(rows, "label long, probabilities array<double>")
    got = df.select(D.decode_argmax("probabilities", domain).alias("a"), D.decode_expected("probabilities", domain).alias("e"),
                    D.decode_rounded("probabilities", domain).alias("r"), D.decode_median("probabilities", domain).alias("m"),
                    rating_to_rank("label", domain).alias("k"), rank_to_rating(rating_to_rank("label", domain), domain).alias("back"), "label").collect()
    assert [r.a for r in got] == [0, 10, 30, 0, 30] and [r.m for r in got] == [0, 10, 30, 10, 30]
    assert [r.e for r in got] == pytest.approx([5.0, 14.0, 21.0, 10.0, 25.0]) and [r.r for r in got] == [0, 10, 30, 10, 30]
    assert [r.k for r in got] == [0, 1, 2, 2, 0] and all(r.back == r.label for r in got)
    scored = df.withColumn("prediction", D.decode_argmax("probabilities", domain).cast("double")).withColumn("system", F.lit("s"))
    y, p = [0, 1, 2, 2, 0], [0, 1, 2, 0, 2]
    assert scored.agg(M.qwk_over(domain)("label", "prediction")).first()[0] == pytest.approx(_sk_qwk(y, p))
    assert {(r.label, r.prediction): r.n for r in CF.confusion_long(E.cells(scored), domain).collect()} == {
        (a, b): sum(domain[i] == a and domain[j] == b for i, j in zip(y, p)) for a in domain for b in domain}


def test_batch_tokenizer_udf(spark):
    tok = batch_tokenizer(lambda texts: [t.split() for t in texts], max_length=2)
    df = spark.createDataFrame([("a b c",), (None,)], "text string")
    assert [r[0] for r in df.select(tok("text")).collect()] == [["a", "b"], []]


def test_foreign_scorer_batches(spark):
    def make():
        def predict(texts):
            n = np.array([len(t) for t in texts], dtype=float)
            logits = np.stack([n, -n, np.zeros_like(n), np.ones_like(n)], axis=1)
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)
        return predict
    score = foreign_scorer(make, batch_size=2)
    df = spark.createDataFrame([("aaaa",), ("",), ("aa",)], "text string")
    out = [r[0] for r in df.select(score("text")).collect()]
    assert all(abs(sum(p) - 1) < 1e-9 and len(p) == 4 for p in out)
