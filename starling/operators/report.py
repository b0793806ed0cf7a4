"""Report lines and the release gate.

Percentages are built from integer hundredths of a percent,
``(20000 * num + den) div (2 * den)`` (half-up), so no float formatting
rounding is involved and every engine renders the same text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starling.domain import VALID_RATINGS


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def hundredths_exact(num: Column, den: Column) -> Column:
    """round_half_up(10000 * num / den) as a long; 0 when den = 0."""
    n, d = num.cast("bigint"), den.cast("bigint")
    return F.when(d == 0, F.lit(0).cast("bigint")).otherwise(
        _int_div(F.lit(20000) * n + d, F.lit(2) * d))


def _int_div(a: Column, b: Column) -> Column:
    # exact integer floor division for non-negative longs
    return ((a - (a % b)) / b).cast("bigint")


def percent_text(num: Column | str, den: Column | str) -> Column:
    """``num/den`` as ``12.34%`` (two decimals, half-up, 0/0 -> 0.00%)."""
    h = hundredths_exact(_c(num), _c(den))
    return F.concat(_int_div(h, F.lit(100)).cast("string"), F.lit("."),
                    F.lpad((h % 100).cast("string"), 2, "0"), F.lit("%"))


def fixed_text(x: Column | str, decimals: int) -> Column:
    """A double as text with ``decimals`` places (rounded half-up first)."""
    scale = 10 ** decimals
    v = F.round(_c(x).cast("double") * F.lit(float(scale))).cast("bigint")
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
    a = F.abs(v)
    return F.concat(sign, _int_div(a, F.lit(scale)).cast("string"), F.lit("."),
                    F.lpad((a % scale).cast("string"), decimals, "0"))


def thousands(x: Column | str) -> Column:
    return F.format_number(_c(x).cast("bigint"), 0)


# Fixed values that must equal the reference: the first two lines of the per-class and of the confusion table.
PER_CLASS_HEADER = ["| Class | Precision | Recall | F1 | Support |", "|---|---:|---:|---:|---:|"]
CONFUSION_CORNER, CONFUSION_RULE = "| True \\ Pred | ", "|---|"
# End of fixed values.


def _under(body: DataFrame, by: Sequence[str], lines: Sequence[str]) -> DataFrame:
    """The lines of each group with header lines before them, numbered up to -1; one pass over ``body``."""
    head = F.array(*[F.struct(F.lit(i - len(lines)).cast("bigint").alias("line_no"), F.lit(t).alias("line"))
                     for i, t in enumerate(lines)])
    held = body.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_lines"))  # a line for each class
    return held.select(*by, F.inline(F.concat(head, "_lines")))


def per_class_report(per_class: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Markdown lines ``(by.., line_no, line)`` from a per-class table."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    line = F.concat_ws(" | ", F.concat(F.lit("| "), F.col("class").cast("string")),
                       percent_text(tp, tp + fp), percent_text(tp, tp + fn),
                       percent_text(F.lit(2) * tp, F.lit(2) * tp + fp + fn),
                       F.concat(thousands("support"), F.lit(" |")))
    body = per_class.select(*by, (F.col("class") + 2).cast("bigint").alias("line_no"), line.alias("line"))
    return _under(body, by, PER_CLASS_HEADER)


def confusion_report(wide: DataFrame, classes: Sequence[int] = VALID_RATINGS,
                     by: Sequence[str] = ()) -> DataFrame:
    """Markdown lines of a wide confusion table (``pred_<v>`` columns)."""
    header = CONFUSION_CORNER + " | ".join(str(v) for v in classes) + " |"
    sep = CONFUSION_RULE + "---:|" * len(classes)
    cells = [thousands(f"pred_{int(v)}") for v in classes]
    line = F.concat(F.lit("| "), F.col("label").cast("string"), F.lit(" | "),
                    F.concat_ws(" | ", *cells), F.lit(" |"))
    body = wide.select(*by, F.col("label").cast("bigint").alias("line_no"), line.alias("line"))
    return _under(body, by, [header, sep])


#: Titles of the board's columns; the first is set left, the others right. Widths follow from the cells.
BOARD_TITLES = ("rated by", "test rows", "mean miss", "root mean square", "hit", "hit or next", "kappa")


def comparison_report(board: DataFrame, order: str = "ord") -> DataFrame:
    """Aligned board lines ``(line_no, line)``: titles, a rule, then a line for each system by ``order``.

    The board is small (a row for each system); it is gathered into one row, so that widths and lines need one pass."""
    kappa = F.when(F.col("qwk").isNull(), F.lit("-")).otherwise(fixed_text("qwk", 4))
    cells = [F.col("system"), thousands("n"), fixed_text("mae", 4), fixed_text("rmse", 4), percent_text(F.col("exact_hits"), F.col("n")),
             percent_text(F.col("within_hits"), F.col("n")), kappa]
    rows = board.select(F.struct(F.col(order).cast("bigint").alias("no"), F.array(*cells).alias("cells")).alias("row"))
    held = rows.agg(F.array_sort(F.collect_list("row")).alias("rows"))
    texts = F.concat(F.array(F.array(*map(F.lit, BOARD_TITLES))), F.transform("rows", lambda r: r["cells"]))
    held = held.withColumn("texts", texts)
    held = held.withColumn("widths", F.array(*[F.array_max(F.transform("texts", _length_of(k))) for k in range(len(BOARD_TITLES))]))

    def line(texts: Column) -> Column:
        padded = [F.rpad(F.get(texts, F.lit(0)), F.get("widths", F.lit(0)), F.lit(" "))]
        padded += [F.lpad(F.get(texts, F.lit(k)), F.get("widths", F.lit(k)), F.lit(" ")) for k in range(1, len(BOARD_TITLES))]
        return F.concat_ws("  ", *padded)

    rule = F.concat_ws("  ", F.transform("widths", lambda w: F.repeat(F.lit("-"), w)))
    head = F.array(F.struct(F.lit(-2).cast("bigint").alias("line_no"), line(F.get("texts", F.lit(0))).alias("line")),
                   F.struct(F.lit(-1).cast("bigint").alias("line_no"), rule.alias("line")))
    body = F.transform("rows", lambda r: F.struct(r["no"].alias("line_no"), line(r["cells"]).alias("line")))
    return held.select(F.inline(F.concat(head, body)))


def _length_of(k: int):
    return lambda t: F.length(F.get(t, F.lit(k)))


def release_gate(results: DataFrame, expected_base: Column | str, expected_sha: Column | str,
                 expected_ratings: Sequence[int] = VALID_RATINGS) -> DataFrame:
    """Reject a result with the first failing reason (base, source hash, ratings)."""
    eb = F.lit(expected_base) if isinstance(expected_base, str) else expected_base
    es = F.lit(expected_sha) if isinstance(expected_sha, str) else expected_sha
    er = ",".join(str(v) for v in expected_ratings)
    reason = (F.when(F.col("base_checkpoint").isNull() | (F.col("base_checkpoint") != eb),
                     F.lit("unexpected base checkpoint"))
              .when(F.col("source_sha256").isNull() | (F.col("source_sha256") != es),
                    F.lit("unverified rating source"))
              .when(F.col("ratings").isNull() | (F.col("ratings") != F.lit(er)),
                    F.lit("unexpected rating classes")))
    return results.select("*", reason.isNull().alias("release_ok"), reason.alias("reason"))
