"""Registered queries: decoders and ordinal functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from starling.domain import VALID_RATINGS, rank_to_rating, rating_to_rank
from starling.functions import decode as D
from starling.operators import ordinal as O
from starling.plans import fixtures as X
from starling.plans.catalog import query, r, rounded
from starling.plans.oracle import add_view, rating_case, with_views
from starling.plans.queries_eval import sql_nearest
from starling.functions.text import unicode_trim, whitespace_class

O_WS = whitespace_class()

P = ["p1", "p2", "p3", "p4"]
KEYS = "l_orderkey, l_linenumber"


def sql_argmax(p=P) -> str:
    top = f"greatest({', '.join(p)})"
    whens = " ".join(f"WHEN {x} = {top} THEN {v}" for x, v in zip(p, VALID_RATINGS))
    return f"CAST(CASE {whens} END AS BIGINT)"


def sql_expected(p=P) -> str:
    return " + ".join(f"{x} * {float(v)}" for x, v in zip(p, VALID_RATINGS))


def sql_median(p=P) -> str:
    whens, acc = [], None
    for x, v in zip(p, VALID_RATINGS):
        acc = x if acc is None else f"{acc} + {x}"
        whens.append(f"WHEN {acc} >= 0.5 THEN {v}")
    return f"CAST(CASE {' '.join(whens)} ELSE {VALID_RATINGS[0]} END AS BIGINT)"


def _probs(spark, sf_dir):
    return X.probs(spark, sf_dir)


# ---------------------------------------------------------------- D1
@query("decode_argmax", sql=with_views("probs") + f"SELECT {KEYS}, {sql_argmax()} AS rating FROM probs")
def q_decode_argmax(spark, sf_dir):
    p = _probs(spark, sf_dir)
    return p.select("l_orderkey", "l_linenumber", D.decode_argmax("probabilities").alias("rating"))


# ---------------------------------------------------------------- D2
@query("decode_expected", sql=with_views("probs") + f"SELECT {KEYS}, {r(sql_expected())} AS expected FROM probs")
def q_decode_expected(spark, sf_dir):
    p = _probs(spark, sf_dir)
    return rounded(p.select("l_orderkey", "l_linenumber", D.decode_expected("probabilities").alias("expected")))


# ---------------------------------------------------------------- D3
@query("decode_rounded", sql=with_views("probs") + f"SELECT {KEYS}, {sql_nearest(sql_expected())} AS rating FROM probs")
def q_decode_rounded(spark, sf_dir):
    p = _probs(spark, sf_dir)
    return p.select("l_orderkey", "l_linenumber", D.decode_rounded("probabilities").alias("rating"))


# ---------------------------------------------------------------- D4
@query("decode_median", sql=with_views("probs") + f"SELECT {KEYS}, {sql_median()} AS rating FROM probs")
def q_decode_median(spark, sf_dir):
    p = _probs(spark, sf_dir)
    return p.select("l_orderkey", "l_linenumber", D.decode_median("probabilities").alias("rating"))


# ---------------------------------------------------------------- D5
_DECODE_ALL_SQL = with_views("probs") + f"""
SELECT {KEYS}, 'argmax' AS decoder, CAST({sql_argmax()} AS DOUBLE) AS prediction FROM probs
UNION ALL SELECT {KEYS}, 'expected', {r(sql_expected())} FROM probs
UNION ALL SELECT {KEYS}, 'expected_rounded', CAST({sql_nearest(sql_expected())} AS DOUBLE) FROM probs
UNION ALL SELECT {KEYS}, 'median', CAST({sql_median()} AS DOUBLE) FROM probs"""


def decode_all(df, probabilities="probabilities", keep=("l_orderkey", "l_linenumber")):
    """All four decoders from one pass, in long form ``(.., decoder, prediction)``.

    The decoders are computed in a projection first and only the computed
    columns are unpivoted: expressions placed inside the generator itself are
    evaluated outside whole-stage codegen and cost about 8x more.
    """
    wide = df.select(*keep, *[fn(probabilities).cast("double").alias(f"_d_{name}")
                              for name, fn in D.DECODERS.items()])
    entries = [F.struct(F.lit(name).alias("decoder"), F.col(f"_d_{name}").alias("prediction"))
               for name in D.DECODERS]
    return wide.select(*keep, F.inline(F.array(*entries)))


@query("decode_all", sql=_DECODE_ALL_SQL)
def q_decode_all(spark, sf_dir):
    return rounded(decode_all(_probs(spark, sf_dir)))


# ---------------------------------------------------------------- D6
@query("nearest_rating", sql=with_views("scored") + f"""
SELECT {KEYS}, pred_c, {sql_nearest('pred_c')} AS nearest,
       {sql_nearest('l_quantity / 10.0')} AS nearest_qty
FROM scored""")
def q_nearest(spark, sf_dir):
    s = X.scored(spark, sf_dir)
    return rounded(s.select("l_orderkey", "l_linenumber", "pred_c",
                            D.nearest_rating("pred_c").alias("nearest"),
                            D.nearest_rating(F.col("l_quantity") / 10.0).alias("nearest_qty")))


# ---------------------------------------------------------------- D7
def _sql_rank_of(expr):
    whens = " ".join(f"WHEN {v} THEN {i}" for i, v in enumerate(VALID_RATINGS))
    return f"CAST(CASE {expr} {whens} END AS BIGINT)"


@query("rating_to_rank", sql=with_views("scored") + f"""
SELECT {KEYS}, label, {_sql_rank_of('label')} AS rank, {_sql_rank_of('pred_a')} AS rank_a FROM scored""")
def q_rating_to_rank(spark, sf_dir):
    s = X.scored(spark, sf_dir)
    return s.select("l_orderkey", "l_linenumber", "label",
                    rating_to_rank("label").alias("rank"), rating_to_rank("pred_a").alias("rank_a"))


# ---------------------------------------------------------------- D8
@query("rank_to_rating", sql=with_views() + f"""
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(label - 3 AS BIGINT) AS rank,
       {rating_case('least(greatest(label - 3, 0), 3)')} AS rating
FROM embeddings""")
def q_rank_to_rating(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings")
    k = (F.col("label") - 3).cast("bigint")
    return e.select(F.col("vec_id").cast("bigint").alias("vec_id"), k.alias("rank"),
                    rank_to_rating(k).alias("rating"))


# ---------------------------------------------------------------- D9
@query("coral_decode", sql=with_views("logits") + """
SELECT vec_id, CAST((CASE WHEN l1 > 0 THEN 1 ELSE 0 END) + (CASE WHEN l2 > 0 THEN 1 ELSE 0 END)
                  + (CASE WHEN l3 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS rank,
       """ + rating_case("(CASE WHEN l1 > 0 THEN 1 ELSE 0 END) + (CASE WHEN l2 > 0 THEN 1 ELSE 0 END) + (CASE WHEN l3 > 0 THEN 1 ELSE 0 END)") + """ AS rating
FROM logits""")
def q_coral_decode(spark, sf_dir):
    lg = X.logits(spark, sf_dir)
    rank = D.coral_decode("cumulative_logits", 3)
    return lg.select("vec_id", rank.alias("rank"), rank_to_rating(rank).alias("rating"))


# ---------------------------------------------------------------- D10
# A fixed CORAL head for the check: weight of dimension i is ((i mod 5) - 2) / 10
# and three decreasing biases.
HEAD_DIM = 64
HEAD_WEIGHTS = [((i % 5) - 2) / 10.0 for i in range(HEAD_DIM)]
HEAD_BIASES = [0.5, 0.0, -0.5]


def _sql_dot(arr: str) -> str:
    return " + ".join(f"CAST({arr}[{i + 1}] AS DOUBLE) * {w!r}" for i, w in enumerate(HEAD_WEIGHTS))


@query("coral_logits", sql=with_views() + f"""
SELECT CAST(vec_id AS BIGINT) AS vec_id,
       {', '.join(f"{r(f'({_sql_dot('embedding')}) + {b!r}')} AS l{k + 1}" for k, b in enumerate(HEAD_BIASES))}
FROM embeddings""")
def q_coral_logits(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings")
    lg = O.coral_logits("embedding", HEAD_WEIGHTS, HEAD_BIASES)
    return rounded(e.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                            *[lg.getItem(k).alias(f"l{k + 1}") for k in range(3)]))


# ---------------------------------------------------------------- D11
@query("coral_targets", sql=with_views("logits") + """
SELECT vec_id, rank, CAST(rank > 0 AS BIGINT) AS t1, CAST(rank > 1 AS BIGINT) AS t2,
       CAST(rank > 2 AS BIGINT) AS t3
FROM logits""")
def q_coral_targets(spark, sf_dir):
    lg = X.logits(spark, sf_dir)
    t = O.coral_targets("rank", 3)
    return lg.select("vec_id", "rank", *[t.getItem(k).alias(f"t{k + 1}") for k in range(3)])


def _sql_bce(x, t):
    return f"(greatest({x}, 0.0) - {x} * CAST({t} AS DOUBLE) + ln(1 + exp(-abs({x}))))"


@query("coral_loss", sql=with_views("logits") + f"""
SELECT {r(f"SUM({_sql_bce('l1', 'rank > 0')} + {_sql_bce('l2', 'rank > 1')} + {_sql_bce('l3', 'rank > 2')}) / (COUNT(*) * 3)")} AS loss,
       CAST(COUNT(*) AS BIGINT) AS n
FROM logits""")
def q_coral_loss(spark, sf_dir):
    return rounded(O.coral_loss(X.logits(spark, sf_dir)))


# ---------------------------------------------------------------- D12
_MODELS_SQL = """SELECT model_id, avg(l1) AS b1, avg(l2) AS b2, avg(l3) AS b3,
           CAST(COUNT(*) AS BIGINT) AS n_rows,
           CAST(COUNT(*) FILTER (WHERE NOT (l2 - l1 <= 1e-6 AND l3 - l2 <= 1e-6)) AS BIGINT) AS n_rows_not_monotone
    FROM logits GROUP BY model_id"""


@query("bias_audit", sql=with_views("logits", extra={"models": _MODELS_SQL}) + f"""
SELECT model_id, {r('b1')} AS b1, {r('b2')} AS b2, {r('b3')} AS b3, n_rows, n_rows_not_monotone,
       (b2 - b1 <= 1e-6 AND b3 - b2 <= 1e-6) AS monotone_decreasing,
       CASE WHEN (b2 - b1 <= 1e-6 AND b3 - b2 <= 1e-6) THEN '{O.MONOTONE_NOTE}' ELSE '{O.NOT_MONOTONE_NOTE}' END AS note
FROM models""")
def q_bias_audit(spark, sf_dir):
    """Models = one fitted bias vector per embedding label (mean logits of its rows)."""
    rows = X.logits(spark, sf_dir)
    row_ok = O.is_monotone("cumulative_logits", 3)
    models = rows.groupBy("model_id").agg(
        F.avg(F.col("cumulative_logits").getItem(0)).alias("b1"),
        F.avg(F.col("cumulative_logits").getItem(1)).alias("b2"),
        F.avg(F.col("cumulative_logits").getItem(2)).alias("b3"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~row_ok).alias("n_rows_not_monotone"),
    ).withColumn("biases", F.array("b1", "b2", "b3"))
    return rounded(O.bias_audit(models).drop("biases"))


# ---------------------------------------------------------------- D13
_EX_SQL = """SELECT group_id, mask, CAST(unnest(generate_series(0, len(embedding) - 1)) AS BIGINT) AS dim,
           unnest(CAST(embedding AS DOUBLE[])) AS v FROM vectors"""


@query("masked_mean_pool", sql=with_views("vectors", extra={"ex": _EX_SQL}) + f"""
SELECT group_id, dim, {r('SUM(v * mask) / greatest(SUM(mask), 1e-6)')} AS pooled
FROM ex GROUP BY group_id, dim""")
def q_masked_mean_pool(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    return rounded(O.masked_mean_pool(v, "group_id", "embedding", "mask").select(
        "group_id", F.col("dim").cast("bigint").alias("dim"), "pooled"))


# ---------------------------------------------------------------- D14
@query("softmax", sql=with_views("probs") + f"""
SELECT {KEYS}, {r('p1')} AS p1, {r('p2')} AS p2, {r('p3')} AS p3, {r('p4')} AS p4 FROM probs""")
def q_softmax(spark, sf_dir):
    p = _probs(spark, sf_dir)
    return rounded(p.select("l_orderkey", "l_linenumber",
                            *[F.col("probabilities").getItem(i).alias(f"p{i + 1}") for i in range(4)]))


# ---------------------------------------------------------------- D17
def _sql_true_prob():
    whens = " ".join(f"WHEN {v} THEN p{i + 1}" for i, v in enumerate(VALID_RATINGS))
    return f"CASE label {whens} END"


@query("ce_loss", sql=with_views("probs") + f"""
SELECT {r(f'avg(-ln(greatest({_sql_true_prob()}, 1e-300)))')} AS ce_loss, CAST(COUNT(*) AS BIGINT) AS n
FROM probs""")
def q_ce_loss(spark, sf_dir):
    p = _probs(spark, sf_dir)
    return rounded(p.agg(F.avg(D.ce_term("probabilities", rating_to_rank("label"))).alias("ce_loss"),
                         F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- D15
def prediction_record(df, decoder: str, probabilities="probabilities"):
    """Batch form of the single-text prediction record: rating, decoder,
    confidence (probability of the chosen rating) and the probability map."""
    return prediction_records(df, [decoder], probabilities)


def prediction_records(df, decoders, probabilities="probabilities"):
    """The records of several decoders, a row for each, from one pass over the rows."""

    def rating(decoder):
        if decoder == "expected":
            return D.decode_rounded(probabilities)
        if decoder in ("argmax", "median"):
            return D.decode(probabilities, decoder)
        raise ValueError(f"no decoder is named {decoder!r}")

    pmap = D.probability_map(probabilities)
    each = F.array(*[F.struct(rating(d).alias("rating"), F.lit(d).alias("decoder")) for d in decoders])
    return df.select("*", F.inline(each)).withColumn("confidence", F.element_at(pmap, F.col("rating"))).withColumn("probability_map", pmap)


def _sql_prob_of(expr):
    whens = " ".join(f"WHEN {v} THEN p{i + 1}" for i, v in enumerate(VALID_RATINGS))
    return f"CASE {expr} {whens} END"


_RECORD_SQL = with_views("probs") + " UNION ALL ".join(
    f"SELECT {KEYS}, '{d}' AS decoder, {expr} AS rating, {r(_sql_prob_of(expr))} AS confidence FROM probs"
    for d, expr in (("argmax", sql_argmax()), ("expected", sql_nearest(sql_expected())), ("median", sql_median())))


@query("prediction_record", sql=_RECORD_SQL)
def q_prediction_record(spark, sf_dir):
    """The records of all three decoders from one scan."""
    p = _probs(spark, sf_dir)
    return rounded(prediction_records(p, ("argmax", "expected", "median")).select("l_orderkey", "l_linenumber", "decoder", "rating", "confidence"))


# ---------------------------------------------------------------- D16
# Probabilities for each document, for the label-map check.
add_view("doc_probs_raw", (), """
    SELECT CAST(doc_id AS BIGINT) AS doc_id, text,
           n_chars / 5000.0 AS x1, (doc_id % 7) / 3.0 AS x2,
           length(lang) / 2.0 AS x3, (doc_id % 3) / 2.0 AS x4
    FROM documents""")
add_view("doc_probs", ("doc_probs_raw",), """
    SELECT doc_id, text,
           exp(x1 - greatest(x1, x2, x3, x4)) / (exp(x1 - greatest(x1, x2, x3, x4)) + exp(x2 - greatest(x1, x2, x3, x4)) + exp(x3 - greatest(x1, x2, x3, x4)) + exp(x4 - greatest(x1, x2, x3, x4))) AS p1,
           exp(x2 - greatest(x1, x2, x3, x4)) / (exp(x1 - greatest(x1, x2, x3, x4)) + exp(x2 - greatest(x1, x2, x3, x4)) + exp(x3 - greatest(x1, x2, x3, x4)) + exp(x4 - greatest(x1, x2, x3, x4))) AS p2,
           exp(x3 - greatest(x1, x2, x3, x4)) / (exp(x1 - greatest(x1, x2, x3, x4)) + exp(x2 - greatest(x1, x2, x3, x4)) + exp(x3 - greatest(x1, x2, x3, x4)) + exp(x4 - greatest(x1, x2, x3, x4))) AS p3,
           exp(x4 - greatest(x1, x2, x3, x4)) / (exp(x1 - greatest(x1, x2, x3, x4)) + exp(x2 - greatest(x1, x2, x3, x4)) + exp(x3 - greatest(x1, x2, x3, x4)) + exp(x4 - greatest(x1, x2, x3, x4))) AS p4
    FROM doc_probs_raw""")


def doc_probs(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    logits = F.array(F.col("n_chars") / 5000.0, (F.col("doc_id") % 7) / 3.0,
                     F.length("lang") / 2.0, (F.col("doc_id") % 3) / 2.0)
    return d.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text",
                    D.softmax(logits, 4).alias("probabilities"))


PREDICTED_SUFFIX = " (predicted)"


def label_map(df, decoder: str, text="text", probabilities="probabilities"):
    """Display map ``{"1": p, ...}``; under the expected decoder the decoded key
    gets a " (predicted)" suffix; a null or blank text gives an empty map."""
    keys = F.array(*[F.lit(str(v)) for v in VALID_RATINGS])
    m = F.map_from_arrays(keys, F.col(probabilities).cast("array<double>"))
    if decoder == "expected value (nearest valid rating)":
        predicted = D.decode_rounded(probabilities).cast("string")
        m = F.transform_keys(m, lambda k, v: F.when(k == predicted, F.concat(k, F.lit(PREDICTED_SUFFIX))).otherwise(k))
    blank = F.col(text).isNull() | (F.length(unicode_trim(F.col(text))) == 0)
    empty = F.create_map().cast("map<string,double>")
    return F.when(blank, empty).otherwise(m)



def _label_map_sql() -> str:
    pred = sql_nearest(sql_expected())
    rows = []
    for i, v in enumerate(VALID_RATINGS):
        key = f"CASE WHEN {pred} = {v} THEN '{v}{PREDICTED_SUFFIX}' ELSE '{v}' END"
        ws = O_WS.replace("'", "''")
        rows.append(f"SELECT doc_id, {key} AS label_key, {r(f'p{i + 1}')} AS prob FROM doc_probs "
                    f"WHERE text IS NOT NULL AND length(regexp_replace(text, '{ws}', '', 'g')) > 0")
    return with_views("doc_probs") + " UNION ALL ".join(rows)


@query("label_map", sql=_label_map_sql())
def q_label_map(spark, sf_dir):
    dp = doc_probs(spark, sf_dir)
    m = label_map(dp, "expected value (nearest valid rating)")
    return rounded(dp.select("doc_id", F.explode(m).alias("label_key", "prob")))
