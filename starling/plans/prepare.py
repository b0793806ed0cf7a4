"""Data preparation plan: verify, gate, clean, split, write, manifest.

    python -m starling.plans.prepare --source reviews.tsv --out /shared/run1 \
        [--expected-rows 200000] [--manifest source_manifest.json]

Plan: scan -> one aggregate pass for the gates -> one shuffle by text for
cleaning -> K-row allocation -> bucketed rank shuffle -> partitioned write.
The split dataset is re-read (partition-pruned), checked for leakage in one
shuffle by text, and summarised in a one-row JSON manifest.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starling.domain import SEED, TARGET_ORIGIN
from starling.operators import clean as C
from starling.operators import split as S
from starling.session import apply_cluster_defaults
from starling.sources import hashtree as HT
from starling.sources import io as IO


def with_row_ids(raw: DataFrame) -> DataFrame:
    """File-order row ids for 'keep first' (monotone within each input file)."""
    return raw.withColumn("row_id", F.monotonically_increasing_id())


def prepare(spark: SparkSession, raw: DataFrame, out_dir: str, expected_rows: int | None = None,
            manifest: DataFrame | None = None, seed: int = SEED, test_size: float = 0.20, new_source: bool = False) -> dict:
    """Run the preparation plan on ``raw`` (columns rating, review[, row_id]).

    The source must be that of ``manifest`` (B7). Only ``new_source`` does without: it records the source's manifest beside the splits."""
    if manifest is None and not new_source:
        raise RuntimeError("no source manifest: give one, or record this source as a new one")
    out_dir = out_dir.rstrip("/")
    if "row_id" not in raw.columns:
        raw = with_row_ids(raw)
    raw = raw.withColumn("target_origin", F.lit(TARGET_ORIGIN)).persist()
    if manifest is None:
        IO.write_json(IO.source_manifest(raw, "source"), f"{out_dir}/source_manifest")
        manifest = IO.read_json(spark, f"{out_dir}/source_manifest", IO.SOURCE_MANIFEST_SCHEMA)
    gate = IO.manifest_gate(IO.table_fingerprint(raw, ["rating", "review"]), manifest).first()  # B7
    if not gate.manifest_ok:
        raise RuntimeError(f"source verification failed: {gate.reason}")
    report = C.gate_report(raw, expected_rows=expected_rows).first()  # B1-B4
    for check, message in (("rows_ok", "unexpected row count"), ("text_ok", "missing review text"),
                           ("domain_equal", "unexpected ratings"), ("origin_ok", "targets not from the source")):
        if not report[check]:
            raise RuntimeError(f"{message}: {report.asDict()}")
    summary = C.clean_summary(raw).first().asDict()
    split = S.stratified_split(C.clean_reviews(raw), seed=seed, test_size=test_size)
    splits_path, tree_path = f"{out_dir}/splits", f"{out_dir}/split_tree"
    IO.write_splits(split, splits_path)
    HT.write_tree(spark, splits_path, tree_path)
    written = HT.read_verified(spark, splits_path, tree_path)
    leak = S.leakage_report(written).first()
    if not leak.disjoint:
        raise AssertionError("a text stands in more than one split")
    m = IO.split_manifest(written, F.lit(gate.observed_sha256), seed, F.lit(bool(leak.disjoint)))
    IO.write_json(m, f"{out_dir}/split_manifest")
    raw.unpersist()
    return {"cleaning": summary, "manifest": m.first().asDict(), "splits": splits_path, "tree": tree_path}


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--source", required=True, help="headerless TSV: rating<TAB>review")
    ap.add_argument("--out", required=True)
    ap.add_argument("--expected-rows", type=int)
    source = ap.add_mutually_exclusive_group(required=True)
    source.add_argument("--manifest", help="source manifest JSON written by starling")
    source.add_argument("--new-source", action="store_true", help="record this source's manifest")
    ap.add_argument("--seed", type=int, default=SEED)
    a = ap.parse_args(argv)
    spark = apply_cluster_defaults(SparkSession.builder.getOrCreate())
    raw = IO.read_tsv(spark, a.source)
    man = IO.read_json(spark, a.manifest, IO.SOURCE_MANIFEST_SCHEMA) if a.manifest else None
    print(json.dumps(prepare(spark, raw, a.out, a.expected_rows, man, a.seed, new_source=a.new_source), default=str, indent=2))


if __name__ == "__main__":
    main()
