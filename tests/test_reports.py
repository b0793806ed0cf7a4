import pytest

from starling.operators import report as RP


def test_board_lines_are_as_wide_as_their_cells(spark):
    rows = [("always the middle", 1, 0.58594, 0.81823, 938, 9991, 19982, None),
            ("a system with a rather long name, indeed", 2, 12.38564708, 0.83637885, 14320, 18874, 19982, 0.83701)]
    board = spark.createDataFrame(rows, "system string, ord long, mae double, rmse double, exact_hits long, within_hits long, n long, qwk double")
    got = [r.line for r in RP.comparison_report(board).orderBy("line_no").collect()]
    cells = [RP.BOARD_TITLES, *[(name, f"{n:,}", f"{mae:.4f}", f"{rmse:.4f}", f"{hit / n:.2%}", f"{near / n:.2%}", "-" if k is None else f"{k:.4f}")
                                for name, _, mae, rmse, hit, near, n, k in rows]]
    widths = [max(map(len, column)) for column in zip(*cells)]
    want = ["  ".join([c[0].ljust(widths[0]), *(x.rjust(w) for x, w in zip(c[1:], widths[1:]))]) for c in cells]
    assert got == [want[0], "  ".join("-" * w for w in widths), *want[1:]]


def test_headers_stand_over_every_group_and_over_nothing(spark):
    per_class = spark.createDataFrame([("a", 1, 1, 0, 0, 1), ("b", 1, 0, 0, 2, 2)], "system string, class long, tp long, fp long, fn long, support long")
    lines = RP.per_class_report(per_class, ["system"]).collect()
    assert sum(r.line == RP.PER_CLASS_HEADER[0] for r in lines) == 2 and len(lines) == 6
    assert [r.line for r in RP.per_class_report(per_class.drop("system").limit(0)).orderBy("line_no").collect()] == RP.PER_CLASS_HEADER


@pytest.mark.parametrize("num,den", [(1482, 2416), (0, 0), (5039, 7508), (1, 3), (2, 3), (19981, 19982)])
def test_percent_text_matches_python(spark, num, den):
    df = spark.createDataFrame([(num, den)], "a long, b long")
    got = df.select(RP.percent_text("a", "b")).first()[0]
    assert got == (f"{num / den:.2%}" if den else "0.00%")


def test_thousands_separator(spark):
    df = spark.createDataFrame([(3597,), (1234567,), (0,)], "n long")
    assert [r[0] for r in df.select(RP.thousands("n")).collect()] == ["3,597", "1,234,567", "0"]


def test_release_gate_first_failing_reason(spark):
    rows = [("m1", "base", "abc", "1,2,4,5"), ("m2", "other", "zzz", "1,2"), ("m3", "base", "zzz", "1,2")]
    df = spark.createDataFrame(rows, "system string, base_checkpoint string, source_sha256 string, ratings string")
    got = {r.system: (r.release_ok, r.reason) for r in RP.release_gate(df, "base", "abc").collect()}
    assert got == {"m1": (True, None), "m2": (False, "unexpected base checkpoint"),
                   "m3": (False, "unverified rating source")}
