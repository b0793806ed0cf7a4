"""Bloom filters and disjointness, positions in files, hash trees, streamed digests."""

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from starling.operators import bloom as BL
from starling.operators import clean as C
from starling.operators import position as P
from starling.operators import split as S
from starling.session import scratch_path
from starling.sources import hashtree as HT
from starling.sources import io as IO


def _folder(spark, name):
    path = scratch_path(spark, name).removeprefix("file:")
    os.makedirs(path)
    return path


def test_filters_keep_members_and_turn_strangers_away(spark):
    members = spark.range(0, 5_000, numPartitions=5).select(F.xxhash64("id").alias("h"))
    bloom = BL.build(members, 5_000)
    held = members.where(BL.passes(spark, bloom, F.col("h"))).count()
    strangers = spark.range(10_000, 30_000).select(F.xxhash64("id").alias("h"))
    assert held == 5_000 and strangers.where(BL.passes(spark, bloom, F.col("h"))).count() < 600
    full = BL.build(members, 5_000, most_bytes=64)  # far too small: lets strangers through, still no member lost
    assert members.where(BL.passes(spark, full, F.col("h"))).count() == 5_000
    assert not BL.build(members.limit(0), 0).bits.any()


def test_only_shared_keys_and_few_others_survive(spark):
    rng = np.random.default_rng(1)
    rows = [(f"t{int(k)}", s) for s, n in (("train", 3_000), ("validation", 300), ("test", 200)) for k in rng.integers(0, 20_000, n)]
    rows += [(None, "train"), (None, "test")]
    df = spark.createDataFrame(rows, "key string, split string").repartition(4)
    sets = {}
    for k, s in rows:
        sets.setdefault(k, set()).add(s)
    want = {(k, s) for k, s in rows if k is not None and len(sets[k]) > 1}
    for most in (BL.MOST_BYTES, 128):
        got = {tuple(r) for r in BL.shared_rows(df, "key", "split", most_bytes=most).select("key", "split").collect()}
        assert want <= got
        if most > 128:
            assert len(got) < len(want) + 150
    flags = S.leakage_report(df.withColumnRenamed("key", "review")).first()
    assert flags.leaking_texts == sum(len(s) > 1 for k, s in sets.items() if k is not None)
    assert flags.shared_train_test == sum({"train", "test"} <= s for k, s in sets.items() if k is not None)


def test_shared_rows_of_no_set_and_one_set(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "train")], "key string, split string")
    assert BL.shared_rows(df, "key", "split").collect() == [] and BL.shared_rows(df.limit(0), "key", "split").collect() == []


def test_conflicts_with_null_ratings_and_hot_texts(spark):
    rows = [(i, "hot", 5) for i in range(400)] + [(400, " hot ", 5), (401, "mixed", 1), (402, "mixed", 2), (403, "half", None), (404, "half", 4),
                                                  (405, "none", None), (406, "  ", 1), (407, None, 2)]
    df = spark.createDataFrame(rows, "row_id long, review string, rating long")
    got = {r.row_id for r in C.conflict_removal(df).collect()}
    assert got == {*range(401), 403, 404}


@pytest.mark.parametrize("sizes", [[5, 1, 7], [13], [1] * 6, [0, 4, 0, 9]])
def test_positions_over_odd_files(spark, sizes):
    path, at = _folder(spark, "odd"), 0
    for k, n in enumerate(sizes):
        pq.write_table(pa.table({"x": pa.array(range(at, at + n), pa.int64())}), f"{path}/part-{k:03}.parquet", row_group_size=2)
        at += n
    got = P.with_position(spark.read.parquet(path)).collect()
    assert sorted((r.x, r.position) for r in got) == [(i, i) for i in range(at)]


def test_positions_across_splits_of_one_file(spark):
    path = _folder(spark, "splits_of_one")
    pq.write_table(pa.table({"x": pa.array(range(4_000), pa.int64()), "y": ["z" * 50] * 4_000}), f"{path}/one.parquet", row_group_size=100, compression="none",
                   use_dictionary=False)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() > 3
        assert {(r.x, r.position) for r in P.with_position(df).select("x", "position").collect()} == {(i, i) for i in range(4_000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_tables_of_unequal_length_do_not_align(spark):
    a, b = _folder(spark, "a"), _folder(spark, "b")
    pq.write_table(pa.table({"x": [1, 2, 3]}), f"{a}/0.parquet")
    pq.write_table(pa.table({"y": [4, 5]}), f"{b}/0.parquet")
    left, right = spark.read.parquet(a), spark.read.parquet(b)
    for one, two in ((left, right), (right, left)):
        with pytest.raises(Exception, match="no partner for the row at 2"):
            P.align_by_position(one, two).select("x").collect()
    pq.write_table(pa.table({"y": [6]}), f"{b}/1.parquet")
    assert sorted(map(tuple, P.align_by_position(left, spark.read.parquet(b)).collect())) == [(0, 1, 4), (1, 2, 5), (2, 3, 6)]


def _splits(spark):
    path = scratch_path(spark, "tree_splits")
    rows = [(f"text {i}", [1, 2, 4, 5][i % 4], "source_file", s) for i in range(600) for s in [["train", "validation", "test"][min(i % 10 // 7 + i % 10 // 9, 2)]]]
    IO.write_splits(spark.createDataFrame(rows, "review string, rating long, target_origin string, split string").repartition(20), path)
    return path.removeprefix("file:")


def test_a_changed_row_is_named_and_refused(spark):
    path, kept = _splits(spark), scratch_path(spark, "tree")
    HT.write_tree(spark, path, kept)
    assert HT.differences(spark, path, kept).collect() == []
    assert HT.read_verified(spark, path, kept).count() == 600
    nodes = spark.read.parquet(kept)
    assert nodes.where("split = 'train'").agg(F.max("level")).first()[0] == 2  # 20 files: 2 nodes, 1 root
    file = sorted(f for f in os.listdir(f"{path}/split=test") if f.endswith(".parquet"))[3]
    t = pq.read_table(f"{path}/split=test/{file}").to_pydict()
    t["rating"][0] = 5 if t["rating"][0] != 5 else 4
    pq.write_table(pa.table(t), f"{path}/split=test/{file}")
    os.remove(f"{path}/split=test/.{file}.crc")  # someone who changes a row does not leave the local file system's own checksum
    spark.catalog.refreshByPath(path)
    named = {(r.split, r.name) for r in HT.differences(spark, path, kept).where("level = 0").collect()}
    assert named == {("test", file)}
    with pytest.raises(RuntimeError, match=f"test/{file} changed"):
        HT.read_verified(spark, path, kept)
    with pytest.raises(RuntimeError, match=file):
        HT.read_verified(spark, path, kept, ["test"])
    assert HT.read_verified(spark, path, kept, ["train"]).where("split <> 'train'").count() == 0  # the others still read
    with pytest.raises(RuntimeError, match="no such split"):
        HT.read_verified(spark, path, kept, ["elsewhere"])


def test_a_lost_file_is_named(spark):
    path, kept = _splits(spark), scratch_path(spark, "tree")
    HT.write_tree(spark, path, kept)
    file = sorted(f for f in os.listdir(f"{path}/split=validation") if f.endswith(".parquet"))[-1]
    os.remove(f"{path}/split=validation/{file}")
    spark.catalog.refreshByPath(path)
    bad = {(r.split, r.name, r.reason) for r in HT.differences(spark, path, kept).where("level = 0").collect()}
    assert ("validation", file, "missing") in bad


def test_nulls_and_neighbours_have_digests_of_their_own(spark):
    rows = [("ab", "c"), ("a", "bc"), (None, "abc"), ("", "abc"), ("abc", None)]
    digests = set()
    for k, (a, b) in enumerate(rows):
        path = scratch_path(spark, f"digest{k}")
        spark.createDataFrame([(a, b, "s")], "a string, b string, split string").write.partitionBy("split").parquet(path)
        digests.add(HT.leaves(spark, path).first().digest)
    assert len(digests) == len(rows)


def test_files_are_hashed_in_chunks(spark):
    path = _folder(spark, "chunks")
    files = {"a.bin": os.urandom(3_000_001), "b.bin": b"1", "c d.bin": b"x" * 4096}
    for name, content in files.items():
        with open(f"{path}/{name}", "wb") as f:
            f.write(content)
    for chunk in (1 << 20, 4096, 1000):
        got = {r.file.replace("%20", " "): (r.bytes, r.sha256) for r in IO.file_fingerprint(spark, path, "*.bin", chunk).collect()}
        assert got == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items()}
