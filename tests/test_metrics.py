import pytest
from pyspark.sql import functions as F

from starling.functions import metrics as M
from starling.operators import evaluate as E


def _metrics(spark, y, p):
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "label long, prediction double")
    return df.agg(*M.rating_metrics("label", "prediction", with_qwk=True, with_polarity=True)).first()


def test_nothing_wrong(spark):
    r = _metrics(spark, [5, 4, 4, 1, 2], [5, 4, 4, 1, 2])
    assert (r.mae, r.rmse, r.exact_accuracy, r.within_one_accuracy) == (0.0, 0.0, 1.0, 1.0)


def test_errors_counted_by_hand(spark):
    r = _metrics(spark, [5, 1, 2, 4, 5], [1, 1, 4, 5, 4])  # errors 4, 0, 2, 1, 1
    assert r.mae == pytest.approx(8 / 5)
    assert r.rmse == pytest.approx((22 / 5) ** 0.5)
    assert r.exact_accuracy == pytest.approx(1 / 5)
    assert r.within_one_accuracy == pytest.approx(3 / 5)


def test_within_one_is_the_same_side_of_the_gap(spark):
    """Every pair of the scale: 1 and 2, or 4 and 5, are within one of each other and no others."""
    pairs = [(a, float(b)) for a in (1, 2, 4, 5) for b in (1, 2, 4, 5)]
    df = spark.createDataFrame(pairs, "label long, prediction double")
    near = F.abs(F.col("prediction") - F.col("label")) <= 1
    assert df.where(near != ((F.col("prediction") >= 4) == (F.col("label") >= 4))).count() == 0


def test_exact_uses_isclose_tolerance(spark):
    # numpy.isclose(p, y): |p - y| <= 1e-8 + 1e-5 * |y|
    r = _metrics(spark, [5, 5], [5.0 + 4e-5, 5.0 + 6e-5])
    assert r.exact_accuracy == pytest.approx(0.5)


def test_qwk_constant_prediction_is_zero_and_degenerate_is_null(spark):
    assert _metrics(spark, [1, 2, 4, 5], [4, 4, 4, 4]).qwk == pytest.approx(0.0)
    assert _metrics(spark, [4, 4], [4, 4]).qwk is None


# Published confusion matrices (rows true 1,2,4,5; columns predicted 1,2,4,5).
CE = [[1482, 1964, 10, 141], [916, 5039, 106, 330], [3, 222, 254, 1398], [15, 281, 276, 7545]]
CORAL = [[3396, 27, 0, 174], [5728, 87, 6, 570], [149, 35, 1, 1692], [178, 52, 3, 7884]]
EXPECTED = {
    "ce": (0.3856470823741367, 0.8363788475439566, 0.7166449804824342, 0.944550095085577, 0.8370073088138243),
    "coral": (0.5631568411570413, 1.0050667357090801, 0.5689120208187368, 0.941747572815534, 0.810216595701096),
}


def test_golden_confusion_matrices_reproduce_published_metrics(spark):
    dom = [1, 2, 4, 5]
    rows = []
    for name, mat in (("ce", CE), ("coral", CORAL)):
        for i, yv in enumerate(dom):
            for j, pv in enumerate(dom):
                rows.append((name, yv, float(pv), mat[i][j]))
    cells = spark.createDataFrame(rows, "system string, label long, prediction double, n long")
    got = {r.system: r for r in E.board(cells).collect()}
    for name, (mae, rmse, exact, within, qwk) in EXPECTED.items():
        r = got[name]
        assert r.n == 19982
        assert r.mae == pytest.approx(mae, abs=1e-12)
        assert r.rmse == pytest.approx(rmse, abs=1e-12)
        assert r.exact_accuracy == pytest.approx(exact, abs=1e-12)
        assert r.within_one_accuracy == pytest.approx(within, abs=1e-12)
        assert r.qwk == pytest.approx(qwk, abs=1e-9)


def test_constant_baselines_use_train_statistics(spark):
    train = spark.createDataFrame([(v,) for v in [1, 2, 2, 4, 5, 5]], "rating long")
    test = spark.createDataFrame([(v,) for v in [1, 5, 5, 4]], "rating long")
    cells = E.constant_baselines(train, test)
    preds = {r.system: r.prediction for r in cells.select("system", "prediction").distinct().collect()}
    assert preds["Constant: training median"] == 3.0
    assert preds["Constant: training mean"] == pytest.approx(19 / 6)
    assert preds["Majority rating class"] == 2.0  # tie 2 vs 5 -> smallest
    board = {r.system: r for r in E.board(cells).collect()}
    assert board["Majority rating class"].mae == pytest.approx((1 + 3 + 3 + 2) / 4)


def test_target_distribution_zero_fills_the_scale(spark):
    df = spark.createDataFrame([(1,), (1,), (5,)], "rating long")
    got = {r.rating: r for r in E.target_distribution(df).collect()}
    assert got[3].n == 0 and got[3].is_missing
    assert got[1].share == pytest.approx(2 / 3)


def test_alignment_refuses_wrong_keys(spark):
    labels = spark.createDataFrame([(1, 4), (2, 5)], "row_id long, label long")
    def of(*keys):
        return spark.createDataFrame([("s", k, 4.0) for k in keys], "system string, row_id long, prediction double")
    assert [tuple(r) for r in E.align_predictions(labels, of(1, 2))[1].collect()] == [("s", 2)]
    for keys in ((1, 1), (1,), (1, 2, 3), (1, 3)):
        with pytest.raises(Exception):
            E.align_predictions(labels, of(*keys))[1].count()
