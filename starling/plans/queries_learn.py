"""Registered queries: tokens, training, scoring.

Training results depend on the path of L-BFGS, so apart from the tokenizer
these are checked by rows (and by the unit tests on planted weights and
snapshots), not against an SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from starling.functions import decode as D
from starling.operators import clean as C
from starling.operators import evaluate as E
from starling.operators import learn as L
from starling.operators import ordinal as O
from starling.operators import split as S
from starling.plans import fixtures as X
from starling.plans.catalog import query, rounded
from starling.plans.oracle import with_views

WORDS = r"[\pL\pN_]+"


# ------------------------------------------------------------------ L1
@query("tokenize_truncate", sql=with_views() + f"""
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(len(regexp_extract_all(text, '{WORDS}')) AS BIGINT) AS n_tokens,
       CAST(len(regexp_extract_all(text, '{WORDS}')[1:{L.MAX_LENGTH}]) AS BIGINT) AS n_kept,
       md5(array_to_string(regexp_extract_all(text, '{WORDS}')[1:{L.MAX_LENGTH}], ' ')) AS digest,
       md5(array_to_string(regexp_extract_all(text, '{WORDS}'), ' ')) AS digest_all
FROM documents""")
def q_tokenize_truncate(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"),
                                                   F.col("text").alias("review"))
    t = L.tokenize(d, max_length=L.MAX_LENGTH, lowercase=False).withColumn("_all", L.word_tokens(F.col("review")))
    return t.select("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens"),
                    F.size("tokens").cast("bigint").alias("n_kept"),
                    F.md5(F.array_join("tokens", " ")).alias("digest"),
                    F.md5(F.array_join("_all", " ")).alias("digest_all"))


# ------------------------------------------------------------------ tokens that training and scoring see
@query("tokens_seen", sql=with_views() + f"""
SELECT CAST(sum(len(regexp_extract_all(text, '{WORDS}'))) AS BIGINT) AS tokens_present,
       CAST(sum(len(regexp_extract_all(text, '{WORDS}'))) AS BIGINT) AS tokens_seen
FROM documents""")
def q_tokens_seen(spark, sf_dir):
    """What the default tokenisation hands to the models, against what the texts hold."""
    docs = X.table(spark, sf_dir, "documents").select(F.col("text").alias("review"))
    seen = L.tokenize(docs).withColumn("present", F.size(L.word_tokens(F.col("review"))))
    return seen.agg(F.sum("present").cast("bigint").alias("tokens_present"), F.sum(F.size("tokens")).cast("bigint").alias("tokens_seen"))


def _splits(spark, sf_dir):
    """The split table; it rests on rows written once, so it needs no cache."""
    return S.stratified_split(C.clean_reviews(X.train_text(spark, sf_dir)))


# ------------------------------------------------------------------ L2 + L4 + D5 + J5
@query("train_ce")
def q_train_ce(spark, sf_dir):
    """Fit on train, decode test probabilities four ways, board them together
    with the constant baselines."""
    sp = _splits(spark, sf_dir)
    train, test = sp.where("split = 'train'"), sp.where("split = 'test'")
    model = L.train_ce(train)
    probs = model.probabilities(test.select("row_id", "review", F.col("rating").alias("label")))
    systems = {f"ce_{k}": fn("probabilities") for k, fn in D.DECODERS.items()}
    long = E.long_predictions(probs, systems)
    return rounded(E.leaderboard([long, E.constant_baselines(train, test)]))


# ------------------------------------------------------------------ L3 + D12
@query("train_coral")
def q_train_coral(spark, sf_dir):
    """Fit the K-1 thresholds, decode test ranks, board + bias audit."""
    sp = _splits(spark, sf_dir)
    train, test = sp.where("split = 'train'"), sp.where("split = 'test'")
    model = L.train_coral(train)
    ranks = model.ranks(test.select("row_id", "review", F.col("rating").alias("label")))
    long = E.long_predictions(ranks, {"coral": "coral_rating"})
    board = E.leaderboard([long])
    b = model.biases
    audit = O.bias_audit(spark.range(1).select(F.array(*[F.lit(x) for x in b]).alias("biases")))
    return rounded(board.select(
        "*", audit.select("monotone_decreasing").scalar().alias("monotone_decreasing"),
        *[F.lit(x).alias(f"bias_{i + 1}") for i, x in enumerate(b)]))


# ------------------------------------------------------------------ L4
@query("score_probabilities")
def q_score_probabilities(spark, sf_dir):
    sp = _splits(spark, sf_dir)
    model = L.train_ce(sp.where("split = 'train'"))
    probs = model.probabilities(sp.where("split <> 'train'").select("row_id", "split", "review"))
    return rounded(probs.select("row_id", "split", *[F.col("probabilities").getItem(i).alias(f"p{i + 1}")
                                                     for i in range(4)]))


# ------------------------------------------------------------------ L5
@query("score_ranks")
def q_score_ranks(spark, sf_dir):
    """CE argmax rating and CORAL rank/rating for every held-out row, both
    models applied in one pass over the same rows (no key, no join)."""
    sp = _splits(spark, sf_dir)
    train, rest = sp.where("split = 'train'"), sp.where("split <> 'train'").select("row_id", "split", "review")
    ce, coral = L.train_ce(train), L.train_coral(train)
    both = coral.ranks(ce.probabilities(rest))
    return both.select("row_id", "split", "rank", "coral_rating",
                       D.decode_argmax("probabilities").alias("ce_rating"))


# ------------------------------------------------------------------ L4 at corpus scale
def corpus_scores(model, spark, sf_dir):
    """Every document of the corpus scored by a trained CE model: rating
    (argmax), confidence and the four class probabilities."""
    docs = X.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"),
                                                      F.col("text").alias("review"))
    p = model.probabilities(docs)
    rating = D.decode_argmax("probabilities")
    return p.select("doc_id", rating.alias("rating"),
                    F.element_at(D.probability_map("probabilities"), rating).alias("confidence"),
                    *[F.col("probabilities").getItem(i).alias(f"p{i + 1}") for i in range(4)])


@query("score_documents")
def q_score_documents(spark, sf_dir):
    """Train on the labelled split, batch-score the whole documents table."""
    model = L.train_ce(_splits(spark, sf_dir).where("split = 'train'"))
    return rounded(corpus_scores(model, spark, sf_dir))
