"""Long-form predictions, cell pre-aggregation and the metrics board.

Plan shape: every evaluation first reduces rows to cells
``(system, label, prediction, n)`` with one partial + final aggregation. For
discrete systems a cell table has at most K^2 rows per system whatever the
row count, so the board, confusion tables, per-class tables, bootstrap and
McNemar all run on a tiny table after one pass over the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starling.domain import ALL_SCALE_VALUES, VALID_RATINGS, domain_array, rating_to_rank
from starling.functions import metrics as M
from starling.functions.decode import nearest_rating


def long_predictions(df: DataFrame, systems: Mapping[str, Column | str], label: str = "label",
                     row_id: str | None = "row_id") -> DataFrame:
    """Wide (one column per system) -> long ``(system, [row_id,] label, prediction)``.

    The system expressions are computed in a projection (codegen, shared
    subexpressions) and only the resulting columns go through ``inline``, a
    narrow Generate; no shuffle. Predictions are widened to double so
    discrete and continuous systems share one column.
    """
    keep = [row_id] if row_id else []
    cols = {f"_s{i}": (F.col(e) if isinstance(e, str) else e).cast("double")
            for i, e in enumerate(systems.values())}
    wide = df.select(*keep, F.col(label).alias("label"), *[c.alias(k) for k, c in cols.items()])
    entries = [F.struct(F.lit(name).alias("system"), F.col(k).alias("prediction"))
               for name, k in zip(systems, cols)]
    return wide.select(*keep, "label", F.inline(F.array(*entries)))


def cells(long_df: DataFrame, by: Sequence[str] = ("system",)) -> DataFrame:
    """``(system, label, prediction, n)``: rows compressed to distinct cells."""
    return long_df.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def board(cell_df: DataFrame, by: Sequence[str] = ("system",), with_qwk: bool = True,
          with_polarity: bool = True, domain: Sequence[int] = VALID_RATINGS) -> DataFrame:
    """Per system: n, MAE, RMSE, exact (isclose), within-one, polarity, QWK."""
    aggs = [F.sum("n").alias("n")]
    aggs += M.rating_metrics("label", "prediction", "n", with_qwk=False, with_polarity=with_polarity)
    if with_qwk:
        aggs.append(M.qwk_over(domain)("label", "prediction", "n").alias("qwk"))
    return cell_df.groupBy(*by).agg(*aggs)


def leaderboard(long_dfs: Sequence[DataFrame], **kwargs) -> DataFrame:
    """Union the systems that exist (missing ones are simply absent) and rank them.

    Each input is either long predictions or cells. Metrics are sums, so every task sends one row
    of sums for each system, also where predictions are continuous and nearly all cells differ.
    """
    parts = []
    for df in long_dfs:
        if df is None:
            continue
        if "n" not in df.columns:
            df = df.select("system", "label", F.col("prediction").cast("double").alias("prediction"), F.lit(1).cast("bigint").alias("n"))
        parts.append(df)
    if not parts:
        raise ValueError("no system to evaluate")
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return board(union, **kwargs)


def align_predictions(labels: DataFrame, predictions: DataFrame,
                      key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Positional alignment re-expressed as an inner equi-join on a row key.

    ``labels``: (key, label); ``predictions``: (system, key, prediction).
    Every system must predict each label's row exactly once: its number of rows, and
    the sum of its keys' hashes, must be those of the labels. The check is a filter's
    predicate, so no plan can prune it. Returns the aligned long table and the aligned counts
    per system.
    """
    mark = F.sum(F.xxhash64(key).cast("decimal(38,0)"))
    want = labels.select(F.struct(F.count(F.lit(1)).alias("n"), mark.alias("mark"))).scalar()
    joined = predictions.join(labels, key, "inner")
    good = ((F.col("aligned") == want.getField("n")) & (F.col("given") == want.getField("n"))
            & F.col("mark").eqNullSafe(want.getField("mark")))
    given = predictions.groupBy("system").agg(F.count(F.lit(1)).alias("given"), mark.alias("mark"))
    aligned = joined.groupBy("system").agg(F.count(F.lit(1)).alias("aligned"))
    checked = (given.join(aligned, "system", "left").withColumn("aligned", F.coalesce("aligned", F.lit(0)))
               .where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("rows predicted don't match the labels: "), F.col("system"))).cast("boolean")))
               .select("system", "aligned"))
    return joined, checked


def constant_baselines(train: DataFrame, test: DataFrame, label: str = "rating") -> DataFrame:
    """Median, mean and majority of the train labels as constant test systems.

    Returned as cells ``(system, label, prediction, n)``: a constant system's
    cells are just the test label histogram, so no per-row constant column is
    materialised. The three train statistics come from one scalar subquery
    (computed once, inlined as literals), not from joins. ``mode(.., true)`` takes the
    smallest value on a tie, as pandas' ``mode().iloc[0]`` does.
    """
    stats = train.select(F.struct(  # one scalar subquery, one pass over train
        F.median(label).cast("double").alias("median"), F.avg(label).cast("double").alias("mean"),
        F.mode(label, True).cast("double").alias("mode"))).scalar()
    median, mean, majority = stats.getField("median"), stats.getField("mean"), stats.getField("mode")
    hist = test.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    systems = F.array(
        F.struct(F.lit("Constant: training median").alias("system"), median.alias("prediction")),
        F.struct(F.lit("Constant: training mean").alias("system"), mean.alias("prediction")),
        F.struct(F.lit("Majority rating class").alias("system"), majority.alias("prediction")),
    )
    return hist.select("label", "n", F.inline(systems)).select(
        "system", F.col("label").cast("bigint").alias("label"), "prediction", "n")


def target_distribution(df: DataFrame, label: str = "rating", by: Sequence[str] = (),
                        scale: Sequence[int] = ALL_SCALE_VALUES) -> DataFrame:
    """Count and share of every scale value, zero-filled, with an is_missing flag.

    One aggregation of per-value conditional counts per group (absent ratings
    count 0), then a narrow ``inline`` to one row per scale value. Share
    denominator: all rows of the (group of the) table; empty -> NULL.
    """
    lab = F.col(label)
    aggs = [F.count_if(lab == F.lit(int(v))).alias(f"_n{i}") for i, v in enumerate(scale)]
    aggs.append(F.count(F.lit(1)).alias("_all"))
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    entries = [F.struct(F.lit(int(v)).cast("bigint").alias("rating"), F.col(f"_n{i}").cast("bigint").alias("n"))
               for i, v in enumerate(scale)]
    out = wide.select(*by, "_all", F.inline(F.array(*entries)))
    return out.select(
        *by, "rating", "n",
        F.try_divide(F.col("n").cast("double"), F.nullif(F.col("_all"), F.lit(0)).cast("double")).alias("share"),
        (F.col("n") == 0).alias("is_missing"),
    )


def polarity_balance(named: Mapping[str, DataFrame], label: str = "rating") -> DataFrame:
    """Rows with rating >= 4 vs <= 2 for each named table (e.g. raw, clean)."""
    parts = []
    for stage, df in named.items():
        parts.append(df.agg(
            F.count_if(F.col(label) >= 4).alias("positive"),
            F.count_if(F.col(label) <= 2).alias("negative"),
            F.count(F.lit(1)).alias("n"),
        ).select(F.lit(stage).alias("stage"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def observed_kappa(df: DataFrame, by: Sequence[str] = ("system",), label: str = "label", prediction: str = "prediction", n: str | None = None,
                   domain: Sequence[int] = VALID_RATINGS) -> DataFrame:
    """(by.., n, qwk_observed): per group, the kappa whose weights come from the positions of the ranks that occur in the group.

    One aggregation to K x K counts a group; which ranks occur, their positions and the kappa are read off these columns."""
    k = len(domain)
    i, j = rating_to_rank(label, domain), rating_to_rank(nearest_rating(F.col(prediction), domain), domain)
    weight = F.col(n).cast("double") if n else F.lit(1.0)
    rows = df.select(*by, i.alias("_i"), j.alias("_j"), weight.alias("_w"))
    cells = [(a, b) for a in range(k) for b in range(k)]
    counts = rows.groupBy(*by).agg(F.sum("_w").cast("bigint").alias("n"), *[
        F.coalesce(F.sum(F.when((F.col("_i") == a) & (F.col("_j") == b), F.col("_w"))), F.lit(0.0)).alias(f"_n{a}{b}") for a, b in cells])
    seen = counts.withColumns({f"_s{a}": F.when(sum((F.col(f"_n{a}{b}") + F.col(f"_n{b}{a}") for b in range(k)), F.lit(0.0)) > 0, 1.0).otherwise(0.0) for a in range(k)})
    placed = seen.withColumns({f"_p{a}": sum((F.col(f"_s{b}") for b in range(a)), F.lit(0.0)) for a in range(k)})

    def total(term) -> Column:
        return sum((F.col(f"_n{a}{b}") * term(F.col(f"_p{a}"), F.col(f"_p{b}")) for a, b in cells), F.lit(0.0))

    sums = placed.select(*by, "n", total(lambda x, y: F.lit(1.0)).alias("_all"), total(lambda x, y: (x - y) * (x - y)).alias("_d"), total(lambda x, y: x).alias("_x"),
                         total(lambda x, y: y).alias("_y"), total(lambda x, y: x * x).alias("_xx"), total(lambda x, y: y * y).alias("_yy"))
    return sums.select(*by, "n", M.qwk_from_parts(*[F.col(c) for c in ("_all", "_d", "_x", "_y", "_xx", "_yy")]).alias("qwk_observed"))
