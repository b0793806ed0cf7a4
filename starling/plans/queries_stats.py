"""Registered queries: confusion, per-class, reports, gate, significance, bootstrap (M*, F*, R*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from starling.domain import SEED, VALID_RATINGS
from starling.functions import metrics as M
from starling.operators import confusion as CF
from starling.operators import evaluate as E
from starling.operators import report as RP
from starling.operators import resample as RS
from starling.operators import significance as SG
from starling.plans import fixtures as X
from starling.plans.catalog import query, r, rounded
from starling.plans.oracle import add_view, with_views
from starling.plans.queries_eval import SCORED_SYSTEMS, _LONG_SCORED_SQL, _metric_sql, sql_nearest, sql_qwk
from starling.session import written
from starling.sources import io as IO

DISCRETE = {"pred_a": "pred_a", "pred_b": "pred_b"}
CLS = ", ".join(str(v) for v in VALID_RATINGS)

add_view("long", ("scored",), _LONG_SCORED_SQL)
add_view("cells", ("long",), "SELECT system, label, prediction, COUNT(*) AS n FROM long GROUP BY system, label, prediction")
add_view("grid", (), f"""
    SELECT s.system, CAST(l.v AS BIGINT) AS label, CAST(p.v AS BIGINT) AS prediction
    FROM (SELECT unnest(['pred_a', 'pred_b']) AS system) s,
         (SELECT unnest([{CLS}]) AS v) l, (SELECT unnest([{CLS}]) AS v) p""")
add_view("conf", ("cells", "grid"), f"""
    SELECT g.system, g.label, g.prediction, CAST(coalesce(c.n, 0) AS BIGINT) AS n
    FROM grid g LEFT JOIN (SELECT system, CAST(label AS BIGINT) AS label, CAST(prediction AS BIGINT) AS prediction,
                                  sum(n) AS n FROM cells
                           WHERE label IN ({CLS}) AND prediction IN ({CLS}) GROUP BY ALL) c
      ON g.system = c.system AND g.label = c.label AND g.prediction = c.prediction""")
add_view("pc_sums", ("cells",), f"""
    SELECT system, cls, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(support) AS support FROM (
        SELECT system, CAST(label AS DOUBLE) AS cls, CASE WHEN label = prediction THEN n ELSE 0 END AS tp, 0 AS fp,
               CASE WHEN label = prediction THEN 0 ELSE n END AS fn, n AS support FROM cells
        UNION ALL
        SELECT system, prediction, 0, CASE WHEN label = prediction THEN 0 ELSE n END, 0, 0 FROM cells)
    WHERE cls IN ({CLS}) GROUP BY system, cls""")
add_view("per_class", ("pc_sums",), f"""
    SELECT s.system, CAST(k.v AS BIGINT) AS class,
           CAST(coalesce(p.tp, 0) AS BIGINT) AS tp, CAST(coalesce(p.fp, 0) AS BIGINT) AS fp,
           CAST(coalesce(p.fn, 0) AS BIGINT) AS fn, CAST(coalesce(p.support, 0) AS BIGINT) AS support
    FROM (SELECT unnest(['pred_a', 'pred_b']) AS system) s CROSS JOIN (SELECT unnest([{CLS}]) AS v) k
    LEFT JOIN pc_sums p ON p.system = s.system AND p.cls = k.v""")


def _cells(spark, sf_dir, systems=DISCRETE):
    s = X.scored(spark, sf_dir)
    return E.cells(E.long_predictions(s, systems, row_id=None))


# ------------------------------------------------------------------ M1
@query("confusion_long", sql=with_views("conf") + "SELECT system, label, prediction, n FROM conf")
def q_confusion_long(spark, sf_dir):
    return CF.confusion_long(_cells(spark, sf_dir), by=["system"])


# ------------------------------------------------------------------ M2
@query("confusion_wide", sql=with_views("conf") + f"""
SELECT system, label, {', '.join(f'CAST(sum(n) FILTER (WHERE prediction = {v}) AS BIGINT) AS pred_{v}' for v in VALID_RATINGS)}
FROM conf GROUP BY system, label""")
def q_confusion_wide(spark, sf_dir):
    return CF.confusion_wide(_cells(spark, sf_dir), by=["system"])


# ------------------------------------------------------------------ M3
def _pc_sql(where: str) -> str:
    prec = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END"
    rec = "CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END"
    f1 = f"CASE WHEN ({prec}) + ({rec}) = 0 THEN 0.0 ELSE 2.0 * ({prec}) * ({rec}) / (({prec}) + ({rec})) END"
    return f"""SELECT system, class, tp, fp, fn, support, {r(prec)} AS precision, {r(rec)} AS recall, {r(f1)} AS f1
FROM per_class {where}"""


@query("per_class", sql=with_views("per_class") + _pc_sql("WHERE system = 'pred_a'"))
def q_per_class(spark, sf_dir):
    return rounded(CF.per_class(_cells(spark, sf_dir, {"pred_a": "pred_a"}), by=["system"]))


# ------------------------------------------------------------------ M4
@query("per_class_by_system", sql=with_views("per_class") + _pc_sql(""))
def q_per_class_by_system(spark, sf_dir):
    return rounded(CF.per_class(_cells(spark, sf_dir), by=["system"]))


# ------------------------------------------------------------------ F1
def _pct_sql(num: str, den: str) -> str:
    h = f"(CASE WHEN ({den}) = 0 THEN 0 ELSE (20000 * ({num}) + ({den})) // (2 * ({den})) END)"
    return f"(CAST({h} // 100 AS VARCHAR) || '.' || lpad(CAST({h} % 100 AS VARCHAR), 2, '0') || '%')"


@query("per_class_report", sql=with_views("per_class") + f"""
SELECT system, CAST(line_no AS BIGINT) AS line_no, line FROM (
  SELECT system, -2 AS line_no, '{RP.PER_CLASS_HEADER[0]}' AS line FROM (SELECT DISTINCT system FROM per_class)
  UNION ALL SELECT system, -1, '{RP.PER_CLASS_HEADER[1]}' FROM (SELECT DISTINCT system FROM per_class)
  UNION ALL SELECT system, class + 2,
      '| ' || CAST(class AS VARCHAR) || ' | ' || {_pct_sql('tp', 'tp + fp')} || ' | ' || {_pct_sql('tp', 'tp + fn')}
      || ' | ' || {_pct_sql('2 * tp', '2 * tp + fp + fn')} || ' | ' || format('{{:,}}', support) || ' |'
  FROM per_class)""")
def q_per_class_report(spark, sf_dir):
    return RP.per_class_report(CF.per_class(_cells(spark, sf_dir), by=["system"]), by=["system"])


# ------------------------------------------------------------------ F2
@query("confusion_report", sql=with_views("conf") + f"""
, wide AS (SELECT system, label, {', '.join(f'sum(n) FILTER (WHERE prediction = {v}) AS p{v}' for v in VALID_RATINGS)}
           FROM conf GROUP BY system, label)
SELECT system, CAST(line_no AS BIGINT) AS line_no, line FROM (
  SELECT DISTINCT system, -2 AS line_no, '| True \\ Pred | {' | '.join(map(str, VALID_RATINGS))} |' AS line FROM wide
  UNION ALL SELECT DISTINCT system, -1, '|---|{'---:|' * len(VALID_RATINGS)}' FROM wide
  UNION ALL SELECT system, label, '| ' || CAST(label AS VARCHAR) || ' | ' ||
      {" || ' | ' || ".join(f"format('{{:,}}', p{v})" for v in VALID_RATINGS)} || ' |' FROM wide)""".replace(
    "\n, wide AS", ",\nwide AS"))
def q_confusion_report(spark, sf_dir):
    return RP.confusion_report(CF.confusion_wide(_cells(spark, sf_dir), by=["system"]), by=["system"])


# ------------------------------------------------------------------ F3
def _fixed_sql(x: str, d: int) -> str:
    s = 10 ** d
    v = f"CAST(round({x} * {float(s)}) AS BIGINT)"
    return f"(CASE WHEN {v} < 0 THEN '-' ELSE '' END || CAST(abs({v}) // {s} AS VARCHAR) || '.' || lpad(CAST(abs({v}) % {s} AS VARCHAR), {d}, '0'))"


_BOARD_ORDER = {"pred_a": 1, "pred_b": 2, "pred_c": 3}


_CELLS_SQL = ["system", "format('{:,}', n)", _fixed_sql("mae", 4), _fixed_sql("rmse", 4), _pct_sql("exact_hits", "n"), _pct_sql("within_hits", "n"),
              f"CASE WHEN qwk IS NULL THEN '-' ELSE {_fixed_sql('qwk', 4)} END"]


@query("comparison_report", sql=with_views("long", extra={"b": f"""
    SELECT system, COUNT(*) AS n, {_metric_sql('label', 'prediction')['mae']} AS mae,
           {_metric_sql('label', 'prediction')['rmse']} AS rmse,
           COUNT(*) FILTER (WHERE abs(prediction - label) <= 1e-8 + 1e-5 * abs(CAST(label AS DOUBLE))) AS exact_hits,
           COUNT(*) FILTER (WHERE abs(prediction - label) <= 1.0) AS within_hits, {sql_qwk('label', 'prediction')} AS qwk,
           CASE system {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _BOARD_ORDER.items())} END AS ord
    FROM long GROUP BY system""",
    "c": f"""SELECT -2 AS line_no, {', '.join(f"'{t}' AS c{k}" for k, t in enumerate(RP.BOARD_TITLES))}
    UNION ALL SELECT ord, {', '.join(_CELLS_SQL)} FROM b""",
    "w": f"SELECT {', '.join(f'CAST(max(length(c{k})) AS INTEGER) AS w{k}' for k in range(len(RP.BOARD_TITLES)))} FROM c"}) + f"""
SELECT CAST(line_no AS BIGINT) AS line_no, concat_ws('  ', rpad(c0, w0, ' '), {', '.join(f"lpad(c{k}, w{k}, ' ')" for k in range(1, len(RP.BOARD_TITLES)))}) AS line FROM c, w
UNION ALL SELECT -1, concat_ws('  ', {', '.join(f"repeat('-', w{k})" for k in range(len(RP.BOARD_TITLES)))}) FROM w""")
def q_comparison_report(spark, sf_dir):
    cells = _cells(spark, sf_dir, SCORED_SYSTEMS)
    y, p, n = F.col("label"), F.col("prediction"), F.col("n")
    b = cells.groupBy("system").agg(
        F.sum(n).alias("n"), M.mae(y, p, n).alias("mae"), M.rmse(y, p, n).alias("rmse"),
        F.sum(F.when(M.is_exact(y, p), n).otherwise(0)).alias("exact_hits"),
        F.sum(F.when(F.abs(p - y) <= 1.0, n).otherwise(0)).alias("within_hits"), M.qwk(y, p, n).alias("qwk"))
    order = None
    for k, v in _BOARD_ORDER.items():
        order = F.when(F.col("system") == k, F.lit(v)) if order is None else order.when(F.col("system") == k, F.lit(v))
    return RP.comparison_report(b.withColumn("ord", order))


# ------------------------------------------------------------------ F4
_RESULTS_SQL = f"""
    SELECT system, 'starling-' || system AS base_checkpoint,
           (SELECT fp FROM label_fp) AS source_sha256,
           concat_ws(',', {', '.join(f"CASE WHEN COUNT(*) FILTER (WHERE prediction = {v}) > 0 THEN '{v}' END" for v in VALID_RATINGS)},
                     CASE WHEN COUNT(*) FILTER (WHERE prediction NOT IN ({CLS})) > 0 THEN 'other' END) AS ratings
    FROM long GROUP BY system"""
_LABEL_FP_SQL = """
    SELECT sha256(concat_ws(':', CAST(COUNT(*) AS VARCHAR),
                            CAST(CAST(sum(CAST(('0x' || substr(sha256(CAST(label AS VARCHAR)), 1, 15)) AS BIGINT)) AS DECIMAL(38, 0)) AS VARCHAR),
                            CAST(bit_xor(CAST(('0x' || substr(sha256(CAST(label AS VARCHAR)), 16, 15)) AS BIGINT)) AS VARCHAR))) AS fp
    FROM scored"""


@query("release_gate", sql=with_views("long", extra={"label_fp": _LABEL_FP_SQL, "results": _RESULTS_SQL}) + """
SELECT system, base_checkpoint, source_sha256, ratings,
       CASE WHEN base_checkpoint <> 'starling-' || system THEN false
            WHEN source_sha256 <> (SELECT fp FROM label_fp) THEN false
            WHEN ratings <> '1,2,4,5' THEN false ELSE true END AS release_ok,
       CASE WHEN base_checkpoint <> 'starling-' || system THEN 'unexpected base checkpoint'
            WHEN source_sha256 <> (SELECT fp FROM label_fp) THEN 'unverified rating source'
            WHEN ratings <> '1,2,4,5' THEN 'unexpected rating classes' END AS reason
FROM results""")
def q_release_gate(spark, sf_dir):
    """Results table: one row per system with its base, the label source
    fingerprint and the ratings it emits; the gate rejects continuous output."""
    s = X.scored(spark, sf_dir)
    fp = IO.table_fingerprint(s, ["label"]).select("fingerprint").scalar()
    long = E.long_predictions(s, SCORED_SYSTEMS, row_id=None)
    p = F.col("prediction")
    present = [F.when(F.count_if(p == v) > 0, F.lit(str(v))) for v in VALID_RATINGS]
    outside = F.when(F.count_if(~p.isin([float(v) for v in VALID_RATINGS])) > 0, F.lit("other"))
    results = long.groupBy("system").agg(F.concat_ws(",", *present, outside).alias("ratings")).select(
        "system", F.concat(F.lit("starling-"), F.col("system")).alias("base_checkpoint"),
        fp.alias("source_sha256"), "ratings")
    return RP.release_gate(results, F.concat(F.lit("starling-"), F.col("system")), fp)


# ------------------------------------------------------------------ R3
@query("mcnemar_counts", sql=with_views("scored") + """
SELECT CAST(COUNT(*) FILTER (WHERE pred_a = label AND pred_b <> label) AS BIGINT) AS a_right_b_wrong,
       CAST(COUNT(*) FILTER (WHERE pred_a <> label AND pred_b = label) AS BIGINT) AS a_wrong_b_right
FROM scored""")
def q_mcnemar_counts(spark, sf_dir):
    return SG.discordant_counts(X.scored(spark, sf_dir))


# ------------------------------------------------------------------ R4
@query("mcnemar_exact", sql=with_views("scored", extra={"bc": """
    SELECT COUNT(*) FILTER (WHERE pred_a = label AND pred_b <> label) AS b,
           COUNT(*) FILTER (WHERE pred_a <> label AND pred_b = label) AS c FROM scored""",
    "terms": """
    SELECT lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2) AS t,
           lgamma(b + c + 1) - lgamma(least(b, c) + 1) - lgamma(b + c - least(b, c) + 1) - (b + c) * ln(2) AS top
    FROM bc, (SELECT unnest(range(CAST((SELECT least(b, c) FROM bc) AS BIGINT) + 1)) AS i)""",
    "lp": """
    SELECT CASE WHEN (SELECT b + c FROM bc) = 0 THEN 0.0
                ELSE least(0.0, ln(2) + max(top) + ln(sum(exp(t - top)))) END AS ln_p FROM terms"""}) + f"""
SELECT CAST(b AS BIGINT) AS a_right_b_wrong, CAST(c AS BIGINT) AS a_wrong_b_right, CAST(b + c AS BIGINT) AS n_discordant,
       {r('ln_p')} AS ln_p, {r('exp(ln_p)')} AS p_value, exp(ln_p) < 0.05 AS significant
FROM bc, lp""")
def q_mcnemar_exact(spark, sf_dir):
    out = SG.mcnemar(X.scored(spark, sf_dir))
    return rounded(out)


# ------------------------------------------------------------------ R1 (hash draws, oracle-checked)
N_RESAMPLES = 1000


def _hash_ci_sql(metric_name: str, metric_expr: str, point_src: str, system: str = "pred_a") -> str:
    """DuckDB twin of ``bootstrap_hash`` for one metric of one system."""
    views = {
        "c1": f"SELECT label, CAST({system} AS DOUBLE) AS prediction, COUNT(*) AS n FROM scored GROUP BY 1, 2",
        "iv": """SELECT *, coalesce(sum(n) OVER (ORDER BY label, prediction ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo
                 FROM c1""",
        "tot": "SELECT sum(n) AS n FROM c1",
        "draws": f"""SELECT b, CAST(('0x' || substr(md5('{SEED}:' || CAST(b AS VARCHAR) || ':' || CAST(j AS VARCHAR)), 1, 15)) AS BIGINT)
                            % (SELECT n FROM tot) AS idx
                     FROM range({N_RESAMPLES}) t(b), (SELECT unnest(range(CAST((SELECT n FROM tot) AS BIGINT))) AS j)""",
        "hit": "SELECT d.b, i.label, i.prediction FROM draws d JOIN iv i ON d.idx >= i.lo AND d.idx < i.lo + i.n",
        "w": "SELECT b, label, prediction, COUNT(*) AS w FROM hit GROUP BY ALL",
        "reps": f"SELECT b, {metric_expr.replace('__W__', 'w')} AS v FROM w GROUP BY b",
    }
    return with_views("scored", extra=views) + f"""
SELECT '{metric_name}' AS metric, {r(f"(SELECT {metric_expr.replace('__W__', 'n')} FROM {point_src})")} AS point,
       {r('quantile_cont(v, 0.025)')} AS ci_low, {r('quantile_cont(v, 0.975)')} AS ci_high,
       CAST({N_RESAMPLES} AS BIGINT) AS n_resamples
FROM reps"""


def _hash_ci(spark, sf_dir, metrics, system="pred_a"):
    return rounded(RS.bootstrap_hash(_cells(spark, sf_dir, {system: system}).drop("system"),
                                     metrics, n_resamples=N_RESAMPLES, seed=SEED))


@query("bootstrap_mae", sql=_hash_ci_sql("mae", _metric_sql("label", "prediction", "__W__")["mae"], "c1"))
def q_bootstrap_mae(spark, sf_dir):
    return _hash_ci(spark, sf_dir, {"mae": M.mae})


@query("bootstrap_exact", sql=_hash_ci_sql("exact_accuracy", _metric_sql("label", "prediction", "__W__")["exact_accuracy"], "c1"))
def q_bootstrap_exact(spark, sf_dir):
    return _hash_ci(spark, sf_dir, {"exact_accuracy": M.exact})


@query("bootstrap_qwk", sql=_hash_ci_sql("qwk", sql_qwk("label", "prediction", "__W__"), "c1"))
def q_bootstrap_qwk(spark, sf_dir):
    return _hash_ci(spark, sf_dir, {"qwk": lambda y, p, w: M.qwk(y, p, w)})


# ------------------------------------------------------------------ R2 (hash draws, paired cells)
def _paired_sql() -> str:
    mae_a = _metric_sql("label", sql_nearest("pred_a"), "__W__")["mae"]
    mae_b = _metric_sql("label", sql_nearest("pred_b"), "__W__")["mae"]
    views = {
        "c1": "SELECT label, CAST(pred_a AS DOUBLE) AS pred_a, CAST(pred_b AS DOUBLE) AS pred_b, COUNT(*) AS n FROM scored GROUP BY 1, 2, 3",
        "iv": """SELECT *, coalesce(sum(n) OVER (ORDER BY label, pred_a, pred_b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo
                 FROM c1""",
        "tot": "SELECT sum(n) AS n FROM c1",
        "draws": f"""SELECT b, CAST(('0x' || substr(md5('{SEED}:' || CAST(b AS VARCHAR) || ':' || CAST(j AS VARCHAR)), 1, 15)) AS BIGINT)
                            % (SELECT n FROM tot) AS idx
                     FROM range({N_RESAMPLES}) t(b), (SELECT unnest(range(CAST((SELECT n FROM tot) AS BIGINT))) AS j)""",
        "hit": "SELECT d.b, i.label, i.pred_a, i.pred_b FROM draws d JOIN iv i ON d.idx >= i.lo AND d.idx < i.lo + i.n",
        "w": "SELECT b, label, pred_a, pred_b, COUNT(*) AS w FROM hit GROUP BY ALL",
        "reps": f"SELECT b, ({mae_a.replace('__W__', 'w')}) - ({mae_b.replace('__W__', 'w')}) AS v FROM w GROUP BY b",
        "pt": f"SELECT ({mae_a.replace('__W__', 'n')}) - ({mae_b.replace('__W__', 'n')}) AS point FROM c1",
    }
    return with_views("scored", extra=views) + f"""
SELECT 'mae_delta' AS metric, {r('(SELECT point FROM pt)')} AS point,
       {r('quantile_cont(v, 0.025)')} AS ci_low, {r('quantile_cont(v, 0.975)')} AS ci_high,
       CAST({N_RESAMPLES} AS BIGINT) AS n_resamples,
       quantile_cont(v, 0.025) > 0 OR quantile_cont(v, 0.975) < 0 AS excludes_zero
FROM reps"""


def paired_cells(spark, sf_dir):
    s = X.scored(spark, sf_dir)
    return s.groupBy("label", F.col("pred_a").cast("double").alias("pred_a"),
                     F.col("pred_b").cast("double").alias("pred_b")).agg(F.count(F.lit(1)).alias("n"))


@query("paired_delta", sql=_paired_sql())
def q_paired_delta(spark, sf_dir):
    metric = RS.paired_delta_metric(RS.snapped(M.mae), "pred_a", "pred_b")
    ci = RS.bootstrap_hash(paired_cells(spark, sf_dir), {"mae_delta": metric}, n_resamples=N_RESAMPLES,
                           seed=SEED, cell_cols=("label", "pred_a", "pred_b"), pred="pred_a")
    return RS.excludes_zero(rounded(ci))


# ------------------------------------------------------------------ R5 (scalable multinomial draws)
@query("leaderboard_ci")
def q_leaderboard_ci(spark, sf_dir):
    """MAE and exact on raw predictions, QWK on snapped ones, all three from
    one set of multinomial draws per system (cell strategy, B = 1000)."""
    cells = _cells(spark, sf_dir, SCORED_SYSTEMS)
    metrics = {"mae": M.mae, "exact_accuracy": M.exact, "qwk": M.qwk}
    return rounded(RS.bootstrap_cells(cells, metrics, n_resamples=N_RESAMPLES, seed=SEED, by=["system"]))


# ------------------------------------------------------------------ R6
@query("system_comparison")
def q_system_comparison(spark, sf_dir):
    """pred_a vs pred_b: paired MAE delta on snapped ratings (multinomial
    draws over paired cells), then the exact McNemar test."""
    pc = written(paired_cells(spark, sf_dir), "paired")
    metric = RS.paired_delta_metric(RS.snapped(M.mae), "pred_a", "pred_b")
    ci = RS.excludes_zero(RS.bootstrap_cells(pc, {"mae_delta": metric}, n_resamples=N_RESAMPLES, seed=SEED,
                                             cell_cols=("label", "pred_a", "pred_b"), pred="pred_a"))
    mc = SG.mcnemar(pc, weight="n")
    test = mc.select(F.struct("a_right_b_wrong", "a_wrong_b_right", "p_value", "significant")).scalar()
    return rounded(ci.select(
        F.col("point").alias("point_delta"), "ci_low", "ci_high", "excludes_zero", "n_resamples",
        *[test.getField(k).alias(k) for k in ("a_right_b_wrong", "a_wrong_b_right", "p_value", "significant")]))


# ------------------------------------------------------------------ R5 / R6 against the normal approximation
# Quantiles of B = 1000 replicates stray by some 0.09 standard errors of the metric; 0.4 is over four times that.
_NEAR = 0.4
_Z = 1.959964  # fixed value: the normal quantile at 0.975


@query("leaderboard_ci_near_normal", sql=with_views("long", extra={"e": """
    SELECT system, 'mae' AS metric, abs(prediction - label) AS x FROM long
    UNION ALL SELECT system, 'exact_accuracy', CASE WHEN abs(prediction - label) <= 1e-8 + 1e-5 * abs(label) THEN 1.0 ELSE 0.0 END FROM long"""}) + f"""
SELECT system, metric, CAST(COUNT(*) AS BIGINT) AS n, {r('avg(x)')} AS point, {r('stddev_pop(x) / sqrt(COUNT(*))')} AS standard_error,
       true AS low_is_near, true AS high_is_near
FROM e GROUP BY system, metric""")
def q_leaderboard_ci_near_normal(spark, sf_dir):
    """The drawn intervals of two means beside point +- 1.96 standard errors of the rows themselves."""
    s = X.scored(spark, sf_dir)
    long = E.long_predictions(s, SCORED_SYSTEMS, row_id=None)
    ci = RS.bootstrap_cells(E.cells(long), {"mae": M.mae, "exact_accuracy": M.exact}, n_resamples=1000, seed=SEED, by=["system"])
    y, p = F.col("label"), F.col("prediction")
    terms = [("mae", M.mae), ("exact_accuracy", M.exact)]
    rows = long.select("system", F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), m.terms(y, p)[0].alias("x")) for k, m in terms])))
    own = rows.groupBy("system", "metric").agg(F.count(F.lit(1)).alias("n"), (F.stddev_pop("x") / F.sqrt(F.count(F.lit(1)))).alias("standard_error"))
    se = F.col("standard_error")
    near = lambda bound, sign: F.abs(F.col(bound) - (F.col("point") + sign * _Z * se)) <= _NEAR * se
    return rounded(ci.join(own, ["system", "metric"]).select("system", "metric", "n", "point", "standard_error",
                                                             near("ci_low", -1).alias("low_is_near"), near("ci_high", 1).alias("high_is_near")))


@query("system_comparison_near_normal", sql=with_views("scored", extra={
    "d": f"""SELECT abs({sql_nearest('pred_a')} - label) - abs({sql_nearest('pred_b')} - label) AS x FROM scored"""}) + f"""
SELECT CAST(COUNT(*) AS BIGINT) AS n, {r('avg(x)')} AS point, {r('stddev_pop(x) / sqrt(COUNT(*))')} AS standard_error,
       true AS low_is_near, true AS high_is_near,
       abs(avg(x)) > {_Z} * stddev_pop(x) / sqrt(COUNT(*)) AS excludes_zero,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM scored WHERE pred_a = label AND pred_b <> label) AS a_right_b_wrong,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM scored WHERE pred_a <> label AND pred_b = label) AS a_wrong_b_right
FROM d""")
def q_system_comparison_near_normal(spark, sf_dir):
    """The paired delta and the discordant counts from paired cells, the interval beside its normal approximation."""
    pc = paired_cells(spark, sf_dir)
    delta = RS.paired_delta_metric(RS.snapped(M.mae), "pred_a", "pred_b")
    ci = RS.excludes_zero(RS.bootstrap_cells(pc, {"mae_delta": delta}, n_resamples=1000, seed=SEED,
                                             cell_cols=("label", "pred_a", "pred_b"), pred="pred_a"))
    a, b = delta.terms(F.col("label"), None)
    x, n = a - b, F.col("n")
    mean = F.sum(n * x) / F.sum(n)
    own = pc.agg(F.sum(n).alias("n"), F.sqrt(F.sum(n * x * x) / F.sum(n) - mean * mean).alias("sd")).select(
        "n", (F.col("sd") / F.sqrt("n")).alias("standard_error"))
    both = own.join(SG.mcnemar(pc, weight="n").select("a_right_b_wrong", "a_wrong_b_right"), how="cross").join(ci, how="cross")  # one row each
    se = F.col("standard_error")
    near = lambda bound, sign: F.abs(F.col(bound) - (F.col("point") + sign * _Z * se)) <= _NEAR * se
    return rounded(both.select("n", "point", "standard_error", near("ci_low", -1).alias("low_is_near"), near("ci_high", 1).alias("high_is_near"),
                               "excludes_zero", "a_right_b_wrong", "a_wrong_b_right"))


# ------------------------------------------------------------------ U1 / R1: any metric, by little bootstraps
@query("median_error_ci", sql=with_views("long") + f"""
SELECT system, CAST(COUNT(*) AS BIGINT) AS n, {r('quantile_disc(abs(prediction - label), 0.5)')} AS median_error, true AS covered, true AS ordered
FROM long GROUP BY system""")
def q_median_error_ci(spark, sf_dir):
    """An interval of the median absolute error, which no sums give, beside the exact median of all rows. The
    interval is of subsets' medians; it must reach the median, up to one step between neighbouring error values."""
    s = X.scored(spark, sf_dir).select("row_id", "label", "pred_a", "pred_b", "pred_c")
    long = E.long_predictions(s, SCORED_SYSTEMS, row_id="row_id")
    ci = RS.bootstrap_little(long, {"median_error": RS.median_error}, n_resamples=40, seed=SEED, by=["system"])
    error = F.abs(F.col("prediction") - F.col("label"))
    exact = long.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY abs(prediction - label))").alias("median_error"))
    step = 0.01
    return rounded(ci.join(exact, "system").select(
        "system", "n", "median_error", (F.col("median_error").between(F.col("ci_low") - step, F.col("ci_high") + step)).alias("covered"),
        (F.col("ci_low") <= F.col("ci_high")).alias("ordered")))


# ------------------------------------------------------------------ F4 with results that must not pass
_TAMPERED = {"as it was": ("base", "sha", "1,2,4,5"), "other base": ("other", "sha", "1,2,4,5"), "other source": ("base", "x", "1,2,4,5"),
             "no source": ("base", None, "1,2,4,5"), "other ratings": ("base", "sha", "1,2,3,4,5"), "all wrong": ("other", "x", "1")}


@query("release_gate_tampered", sql=with_views("scored", extra={"label_fp": _LABEL_FP_SQL}) + """
SELECT v.name, v.ok AS release_ok, v.reason FROM label_fp, (VALUES
  ('as it was', true, CAST(NULL AS VARCHAR)), ('other base', false, 'unexpected base checkpoint'), ('other source', false, 'unverified rating source'),
  ('no source', false, 'unverified rating source'), ('other ratings', false, 'unexpected rating classes'), ('all wrong', false, 'unexpected base checkpoint')) v(name, ok, reason)""")
def q_release_gate_tampered(spark, sf_dir):
    """The gate over results that differ in base, source and ratings from what the label table's fingerprint demands."""
    fp = IO.table_fingerprint(X.scored(spark, sf_dir), ["label"]).select("fingerprint")
    rows = [F.struct(F.lit(k).alias("name"), F.lit(base).alias("base_checkpoint"), (F.col("fingerprint") if sha == "sha" else F.lit(sha)).cast("string").alias("source_sha256"),
                     F.lit(ratings).alias("ratings")) for k, (base, sha, ratings) in _TAMPERED.items()]
    results = fp.select("fingerprint", F.inline(F.array(*rows)))
    return RP.release_gate(results, "base", F.col("fingerprint")).select("name", "release_ok", "reason")
