import numpy as np
import pytest
from pyspark.sql import functions as F

from starling.operators import clean as C
from starling.operators import confusion as CF
from starling.operators import report as RP
from starling.operators import split as S


def _cells(spark, y, p):
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "label long, prediction double")
    return df.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def test_per_class_equals_a_count_by_hand(spark):
    rng = np.random.default_rng(21)
    y, p = rng.choice([1, 4, 5], 90), rng.choice([1, 2, 5, 9], 90)  # 2 never stands, 4 is never said, 9 is no class
    got = {r["class"]: r for r in CF.per_class(_cells(spark, y.tolist(), p.tolist()), [1, 2, 4, 5]).collect()}
    for c in (1, 2, 4, 5):
        hits, said, true = int(((y == c) & (p == c)).sum()), int((p == c).sum()), int((y == c).sum())
        assert (got[c].tp, got[c].fp, got[c].fn, got[c].support) == (hits, said - hits, true - hits, true)
        assert got[c].precision == pytest.approx(hits / said if said else 0.0) and got[c].recall == pytest.approx(hits / true if true else 0.0)


def test_confusion_report_header(spark):
    wide = CF.confusion_wide(_cells(spark, [1, 2, 1, 2], [1, 1, 2, 2]), [1, 2])
    lines = [r.line for r in RP.confusion_report(wide, [1, 2]).orderBy("line_no").collect()]
    assert lines[0] == "| True \\ Pred | 1 | 2 |"
    assert lines[2] == "| 1 | 1 | 1 |"


def test_confusion_skips_out_of_class_values(spark):
    long = CF.confusion_long(_cells(spark, [1, 3, 2], [1, 1, 9]), [1, 2])
    got = {(r.label, r.prediction): r.n for r in long.collect()}
    assert got == {(1, 1): 1, (1, 2): 0, (2, 1): 0, (2, 2): 0}


def test_per_class_report_formatting(spark):
    cells = spark.createDataFrame([(1, 1.0, 1482), (1, 2.0, 2115), (2, 1.0, 934), (2, 2.0, 5457)],
                                  "label long, prediction double, n long")
    lines = [r.line for r in RP.per_class_report(CF.per_class(cells, [1, 2])).orderBy("line_no").collect()]
    assert lines[0] == "| Class | Precision | Recall | F1 | Support |"
    assert lines[2] == "| 1 | 61.34% | 41.20% | 49.29% | 3,597 |"


def test_split_allocation_golden(spark):
    counts = spark.createDataFrame([(1, 35970), (2, 63903), (4, 18776), (5, 81167)], "rating long, n long")
    got = {r.rating: r for r in S.split_allocation(counts).collect()}
    # Fixed values that must equal the published split.
    assert [got[k].n_train for k in (1, 2, 4, 5)] == [28776, 51122, 15021, 64933]
    assert [got[k].n_test for k in (1, 2, 4, 5)] == [3597, 6391, 1877, 8117]
    assert [got[k].n_validation for k in (1, 2, 4, 5)] == [3597, 6390, 1878, 8117]


def test_sizes_at_hand_equal_the_allocation_table(spark):
    for counts in ({1: 7, 2: 13, 4: 1, 5: 29}, {1: 5, 2: 5, 4: 5, 5: 5}, {1: 35970, 2: 63903, 4: 18776, 5: 81167}, {3: 0, 4: 2}):
        table = S.split_allocation(spark.createDataFrame(list(counts.items()), "rating long, n long")).collect()
        assert S.holdout_sizes(counts) == {r.rating: (r.n_test, r.n_holdout) for r in table}


def test_split_of_copies_and_null_classes(spark):
    """Exact sizes where one text holds most rows, and where labels are null."""
    rows = [(i, "same", 1) for i in range(300)] + [(1000 + i, f"t{i}", None) for i in range(50)]
    sp = S.stratified_split(spark.createDataFrame(rows, "row_id long, review string, rating long"))
    got = {(r.split, r.rating): r.n for r in sp.groupBy("split", "rating").agg(F.count("*").alias("n")).collect()}
    assert got == {("test", 1): 30, ("validation", 1): 30, ("train", 1): 240, ("test", None): 5, ("validation", None): 5, ("train", None): 40}
    assert S.stratified_split(sp.drop("split").limit(0)).collect() == []


def test_stratified_split_sizes_and_disjointness(spark):
    rows = [(i, f"text {i}", [1, 2, 4, 5][i % 4]) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, review string, rating long")
    sp = S.stratified_split(df, bucket_digits=1)
    sizes = {(r.split, r.rating): r.n for r in sp.groupBy("split", "rating").agg(F.count("*").alias("n")).collect()}
    assert sizes[("test", 1)] == 10 and sizes[("validation", 1)] == 10 and sizes[("train", 1)] == 80
    assert S.leakage_report(sp).first().disjoint
    again = S.stratified_split(df, bucket_digits=1)
    assert sorted(map(str, sp.collect())) == sorted(map(str, again.collect()))


def test_leakage_cases(spark):
    def rep(sets):
        rows = [(t, s) for s, texts in sets.items() for t in texts]
        if not rows:
            df = spark.createDataFrame([], "review string, split string")
        else:
            df = spark.createDataFrame(rows, "review string, split string")
        return S.leakage_report(df).first().disjoint
    assert rep({"train": ["a", "b"], "validation": ["c", "d"], "test": ["e"]})
    assert not rep({"train": ["a", "b"], "validation": ["b", "c"], "test": ["d"]})
    assert not rep({"train": ["a"], "validation": ["b"], "test": ["a", "c"]})
    assert rep({})


def test_clean_trims_unicode_and_handles_conflicts(spark):
    rows = [(1, "　good ", 5), (2, "good", 5), (3, "bad", 1), (4, " bad ", 2),
            (5, "\t  ", 4), (6, "ok", 4), (7, "ok", 4)]
    raw = spark.createDataFrame(rows, "row_id long, review string, rating long")
    clean = {r.review: (r.row_id, r.rating) for r in C.clean_reviews(raw).collect()}
    assert clean == {"good": (1, 5), "ok": (6, 4)}
    s = C.clean_summary(raw).first()
    assert (s.raw_rows, s.blank_rows, s.conflicting_rows, s.conflicting_texts, s.duplicate_rows, s.kept_rows) == \
        (7, 1, 2, 1, 2, 2)


def test_gate_report_domain_checks(spark):
    df = spark.createDataFrame([(1, "a", "source_file"), (2, "b", "source_file"), (4, "c", "source_file")],
                               "rating long, review string, target_origin string")
    g = C.gate_report(df, expected_rows=3).first()
    assert g.rows_ok and g.domain_subset and not g.domain_equal and g.ratings_present == "1,2,4"


def test_split_reader_gates(spark):
    import pytest
    from starling.session import scratch_path
    from starling.sources import io as IO
    good = spark.createDataFrame([("a", 1, "source_file", "train"), ("b", 5, "source_file", "test")],
                                 "review string, rating long, target_origin string, split string")
    path = scratch_path(spark, "gate_ok")
    IO.write_splits(good, path)
    assert IO.read_splits(spark, path).count() == 2
    bad = spark.createDataFrame([("c", 3, "source_file", "train")],
                                "review string, rating long, target_origin string, split string")
    path = scratch_path(spark, "gate_bad")
    IO.write_splits(bad, path)
    with pytest.raises(Exception):
        IO.read_splits(spark, path).collect()  # rating 3 is outside the domain
    forged = spark.createDataFrame([("d", 4, "generated", "test")],
                                   "review string, rating long, target_origin string, split string")
    path = scratch_path(spark, "gate_forged")
    IO.write_splits(forged, path)
    with pytest.raises(Exception):
        IO.read_splits(spark, path).collect()  # target not from the source file
    extra = scratch_path(spark, "gate_schema")
    good.withColumn("x", F.lit(1)).write.partitionBy("split").parquet(extra)
    with pytest.raises(RuntimeError):
        IO.read_splits(spark, extra)


def test_enforce_raises_on_failed_gate(spark):
    import pytest
    df = spark.createDataFrame([(1, "a", "source_file"), (3, "b", "source_file")],
                               "rating long, review string, target_origin string")
    report = C.gate_report(df, expected_rows=2)
    with pytest.raises(Exception, match="domain_subset"):
        C.enforce(report, ["rows_ok", "domain_subset"]).collect()
    assert C.enforce(report, ["rows_ok", "origin_ok"]).count() == 1
