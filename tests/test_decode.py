import numpy as np
import pytest

from starling.domain import rank_to_rating, rating_to_rank
from starling.functions import decode as D
from starling.operators import ordinal as O


def _run(spark, probs, fn):
    df = spark.createDataFrame([(list(map(float, p)),) for p in probs], "p array<double>")
    return [r[0] for r in df.select(fn("p")).collect()]


def test_argmax(spark):
    assert _run(spark, [[.1, .2, .6, .1], [.05, .55, .2, .2]], D.decode_argmax) == [4, 2]
    assert _run(spark, [[.1, .3, .3, .3]], D.decode_argmax) == [2]  # first index on a tie


def test_expected_value(spark):
    assert _run(spark, [[0, .5, 0, .5], [.25, .25, .25, .25]], D.decode_expected) == [3.5, 3.0]


def test_rounded_snaps_with_lower_tie(spark):
    assert _run(spark, [[0, 0, .5, .5], [.5, 0, 0, .5], [0, .25, .75, 0]], D.decode_rounded) == [4, 2, 4]


def test_median(spark):
    assert _run(spark, [[0, 0, 0, 1], [.5, .25, .25, 0], [.25, .125, .25, .375]], D.decode_median) == [5, 1, 4]
    assert _run(spark, [[.125, .125, .125, 0]], D.decode_median) == [1]  # no prefix reaches 0.5


def test_median_differs_from_argmax_when_skewed(spark):
    p = [[.375, .25, .25, .125]]
    assert _run(spark, p, D.decode_argmax) == [1]
    assert _run(spark, p, D.decode_median) == [2]


def test_decoders_stay_in_domain(spark):
    rng = np.random.default_rng(0)
    raw = rng.random((80, 4)) ** 3
    probs = raw / raw.sum(axis=1, keepdims=True)
    for fn in (D.decode_rounded, D.decode_median, D.decode_argmax):
        assert set(_run(spark, probs.tolist(), fn)) <= {1, 2, 4, 5}


def test_rank_mapping_and_clipping(spark):
    df = spark.createDataFrame([(r,) for r in [5, 4, 4, 1, 2]], "r long")
    ranks = [x[0] for x in df.select(rating_to_rank("r")).collect()]
    assert ranks == [3, 2, 2, 0, 1]
    k = spark.createDataFrame([(v,) for v in [-3, 0, 3, 9]], "k long")
    assert [x[0] for x in k.select(rank_to_rating("k")).collect()] == [1, 1, 5, 5]


def test_unknown_rating_raises(spark):
    df = spark.createDataFrame([(3,)], "r long")
    with pytest.raises(Exception):
        df.select(rating_to_rank("r")).collect()


def test_coral_decode(spark):
    got = _run(spark, [[3, 2, 1], [-1, -2, -9], [4, -1, -1], [0, 0, 0], [-1, 2, 2]], lambda c: D.coral_decode(c, 3))
    assert got == [3, 0, 1, 0, 2]


def test_bias_monotonicity(spark):
    got = _run(spark, [[3, 1, -2], [0, -1, 2], [2, 2, 2], [0, 1, -1]], lambda c: O.is_monotone(c, 3))
    assert got == [True, False, True, False]


def test_softmax_sums_to_one(spark):
    out = _run(spark, [[1000.0, 0.0, -1000.0, 3.0]], lambda c: D.softmax(c, 4))
    assert sum(out[0]) == pytest.approx(1.0) and out[0][0] == pytest.approx(1.0)


def test_masked_mean_pool_all_masked_is_zero(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0.0), (1, [3.0, 4.0], 0.0), (2, [1.0, 3.0], 1.0)],
                               "g long, v array<double>, m double")
    got = {(r.g, r.dim): r.pooled for r in O.masked_mean_pool(df, "g", "v", "m").collect()}
    assert got[(1, 0)] == 0.0 and got[(2, 1)] == 3.0
