import pytest
from pyspark.sql import functions as F

from starling.operators import report as RP
from starling.plans import evaluation, prepare, training
from starling.plans import fixtures as X
from starling.plans import registry  # noqa: F401  (the queries need one another)
from starling.plans import queries_select as QS
from starling.session import scratch_path
from starling.sources import hashtree as HT
from starling.sources import io as IO



def test_prepare_train_evaluate_end_to_end(spark):
    # the fixture reviews, written as the reference's headerless TSV source
    src = scratch_path(spark, "tsv_source")
    docs = X.train_text(spark, "/root/testdata/sf0.01").select("rating", "review")
    IO.write_tsv(docs.coalesce(1), src)
    raw = IO.read_tsv(spark, src)
    out = scratch_path(spark, "prepared")
    with pytest.raises(RuntimeError, match="no source manifest"):
        prepare.prepare(spark, raw, out)
    other = scratch_path(spark, "other_manifest")
    IO.write_json(IO.source_manifest(raw.limit(50), "part"), other)
    with pytest.raises(RuntimeError, match="fingerprint does not match"):
        prepare.prepare(spark, raw, out, manifest=IO.read_json(spark, other, IO.SOURCE_MANIFEST_SCHEMA))
    res = prepare.prepare(spark, raw, out, new_source=True)
    m = res["manifest"]
    assert m["text_disjoint"] and m["train_rows"] > m["test_rows"] > 0
    splits = HT.read_verified(spark, res["splits"], res["tree"])
    ce, history, board = training.train(spark, splits, "ce", candidates=(5, 10))
    assert history.count() >= 1 and board.count() == 1
    coral, _, _ = training.train(spark, splits, "coral", candidates=(5,))
    results = evaluation.evaluate(spark, splits, ce, coral, n_resamples=50)
    systems = {r.system for r in results["board"].collect()}
    assert "CE (median)" in systems and evaluation.CORAL_SYSTEM in systems
    assert results["ce_vs_coral_mcnemar"].count() == 1
    assert results["ci"].where(F.col("ci_low") > F.col("ci_high")).count() == 0
    # the results document passes the gate for its own source, and only for that
    log = scratch_path(spark, "log")
    training.write_log(history, log)
    origin = evaluation.provenance(IO.read_json(spark, f"{out}/split_manifest", IO.SPLIT_MANIFEST_SCHEMA), [IO.read_json(spark, log, IO.LOG_SCHEMA)], ce)
    doc = evaluation.results_document(results, origin)
    best = history.orderBy("eval_mae", "epoch").first()
    assert doc["training"]["ce"]["best_model_checkpoint"] == f"checkpoint-{best.epoch}" and len(doc["training"]["ce"]["history"]) == history.count()
    records = evaluation.release_records(spark, doc)
    assert RP.release_gate(records, "hashed-words-65536", m["source_sha256"]).first().release_ok
    assert RP.release_gate(records, "hashed-words-65536", "0" * 64).first().reason == "unverified rating source"


def test_training_records_of_cumulative_logs(spark):
    entry = lambda e, mae: {"epoch": float(e), "eval_mae": mae, "loss": 1.0}
    rows = [("a", "checkpoint-900", [{"epoch": 1.0, "loss": 2.0}, entry(1, 0.5)], 0.5, "checkpoint-900"),
            ("a", "checkpoint-1800", [{"epoch": 1.0, "loss": 2.0}, entry(1, 0.5), entry(2, 0.6)], 0.5, "checkpoint-900"), ("b", "checkpoint-7", None, None, None)]
    logs = spark.createDataFrame(rows, IO.LOG_SCHEMA)
    got = {r.run: r for r in IO.training_metadata(logs, ["a", "b", "c"]).collect()}
    assert got["a"].latest_checkpoint == "checkpoint-1800" and got["a"].best_model_checkpoint == "checkpoint-900"
    assert got["a"].history == [{"epoch": 1.0, "eval_mae": 0.5}, {"epoch": 2.0, "eval_mae": 0.6}]
    assert got["b"].latest_step == 7 and got["b"].history is None
    assert tuple(got["c"]) == ("c", None, None, None, None, None)


def test_training_records_of_logs_in_segments(spark):
    """A log in several documents gives the record of the same log in one; left in its segments, no row holds it whole."""
    entry = lambda e: {"epoch": float(e), "eval_mae": e / 10, "loss": 1.0}
    log = [x for e in range(1, 8) for x in ({"epoch": float(e), "loss": 2.0}, entry(e))]
    heads = [("a", "checkpoint-300", log[:6]), ("a", "checkpoint-700", log), ("b", "checkpoint-100", []), ("b", "checkpoint-90", log)]
    one = spark.createDataFrame([(r, c, h, 0.1, "checkpoint-100") for r, c, h in heads], IO.LOG_SCHEMA)
    cut = [(r, c, h[k : k + 4], 0.1, "checkpoint-100", k // 4) for r, c, h in heads for k in range(0, max(len(h), 1), 4)]
    many = spark.createDataFrame(cut, IO.SEGMENTED_LOG_SCHEMA).repartition(3)
    records = [sorted(IO.training_metadata(x, ["a", "b", "c"]).collect()) for x in (one, many)]
    assert records[0] == records[1] and [len(r.history or ()) for r in records[0]] == [7, 0, 0] and records[0][2].history is None
    left = IO.training_metadata(many, ["a", "b", "c"], whole=False).collect()
    assert sorted((r.run, r.segment, len(r.history or ())) for r in left if r.run != "c") == [("a", 0, 2), ("a", 1, 2), ("a", 2, 2), ("a", 3, 1), ("b", 0, 0)]
    assert [r.segment for r in left if r.run == "c"] == [None]


def test_no_log_document_grows_with_its_run(spark, tmp_path):
    n = 2500
    spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.lit("r").alias("event_type"), (F.col("id") % 7).alias("value")).write.parquet(str(tmp_path / "events.parquet"))
    logs = QS._cumulative_logs(spark, str(tmp_path))
    sizes = {(r.checkpoint, r.segment): r.n for r in logs.select("checkpoint", "segment", F.size("log_history").alias("n")).collect()}
    assert max(sizes.values()) == 2 * QS.SEGMENT_EPOCHS and sum(sizes.values()) == 2 * (625 + 1250 + 1875 + 2500)
    got = {r.run: r for r in QS.q_training_metadata(spark, str(tmp_path)).collect()}
    assert (got["r"].latest_checkpoint, got["r"].n_entries, got["r"].best_model_checkpoint, got["r"].n_keys) == ("checkpoint-250000", n, "checkpoint-100", 2)
    assert got["r"].weighted == pytest.approx(sum((e - 1) % 7 * e for e in range(1, n + 1)) / 1e6) and got["never trained"].n_entries is None


def test_smoke_slice_sizes(spark):
    from starling.operators import clean as C
    from starling.operators import split as S
    sp = S.stratified_split(C.clean_reviews(X.reviews(spark, "/root/testdata/sf0.01")))
    got = {r.split: r.n for r in training.smoke_slice(sp).groupBy("split").agg(F.count("*").alias("n")).collect()}
    full = {r.split: r.n for r in sp.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == full  # fewer training rows than the bound here
    small = {r.split: r.n for r in training.smoke_slice(sp, rows=50).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert small == {**full, "train": 50}
