"""Summarise the physical plans of the headline queries (after execution, so
the adaptive final plan is shown): shuffles, broadcasts, scans and the
columns each scan reads. Writes markdown to stdout.

Usage: python scripts/plan_summary.py [--sf DIR] > PLANS.md
"""

from __future__ import annotations

import argparse
import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

HEADLINE = ["clean_reviews", "clean_summary", "stratified_split", "leaderboard", "decode_all",
            "confusion_long", "per_class_by_system", "qwk", "mcnemar_counts", "early_stop",
            "table_fingerprint", "masked_mean_pool"]


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    args = ap.parse_args()
    from starling.plans import registry
    from starling.session import local_session

    spark = local_session(8)
    q = registry.queries()
    print("# Physical plans of the headline queries\n")
    print(f"Generated by `scripts/plan_summary.py` at `{args.sf}` (final adaptive plans, after execution).\n")
    print("| query | shuffles | reused | broadcasts | sorts | scans: columns read (pushed filters) |")
    print("|---|---:|---:|---:|---:|---|")
    for name in HEADLINE:
        df = q[name](spark, args.sf)
        df.write.format("noop").mode("overwrite").save()
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        txt = buf.getvalue()
        tree = txt.split("\n\n")[0]
        shuffles = len(re.findall(r"(?<![A-Za-z])Exchange\b", tree))
        reused = len(re.findall(r"ReusedExchange", tree))
        bcast = len(re.findall(r"BroadcastExchange", tree))
        sorts = len(re.findall(r"(?<![A-Za-z])Sort\b", tree))
        scans = []
        for block in txt.split("\n\n")[1:]:
            first = block.strip().splitlines()[0] if block.strip() else ""
            if re.match(r"\(\d+\) Scan (parquet|ExistingRDD)", first):
                rs = re.search(r"ReadSchema: struct<(.*)>", block)
                pf = re.search(r"PushedFilters: \[(.*)\]", block)
                cols = ",".join(c.split(":")[0] for c in rs.group(1).split(",")) if rs else "checkpoint"
                scans.append(f"{cols}" + (f" ({pf.group(1)})" if pf and pf.group(1) else ""))
        print(f"| `{name}` | {shuffles} | {reused} | {bcast} | {sorts} | {'; '.join(scans)} |")
    spark.stop()


if __name__ == "__main__":
    main()
