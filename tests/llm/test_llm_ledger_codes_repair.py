"""Conversation repair, vector codes and the blob ledger against plain versions."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute_codes as B
from starling.llm import blob_ledger as LG
from starling.llm import conversations as CV
from starling.llm import vector_codes as VC
from starling.session import scratch_path

TURNS = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<double>, label int"


# ------------------------------------------------------------ conversations
def _repaired(spark, rows, partitions=4, **options):
    df = spark.createDataFrame(rows, TURNS).repartition(partitions)
    return {r[0]: tuple(r)[1:] for r in CV.repaired_conversations(df, **options).collect()}


def _conversation(rng, conv, n, roles):
    texts = ["Yes.", "No", "", " \t", "So it is!", "Why?", "dots...", "two\nlines.", "naïve…", "."]
    return [(conv, rng.choice([t, t, None]), rng.choice(roles), rng.choice(texts) + rng.choice(["", "", f" {t}."])) for t in range(n)]


def test_repairs_equal_whole_searches(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(150):
        rows += _conversation(rng, conv, rng.randint(1, 9), ["user", "assistant", "system", "user", "assistant", "tool", "", "sys", None])
    rows += [(None, 0, "user", "Hi."), (None, None, None, None), (200, None, "user", None), (201, 7, "user", "x" * 300_000 + ".")]
    rows += [(202, 3, "user", "Same."), (202, 3, "user", "Same."), (202, 3, "assistant", "Other.")]
    assert _repaired(spark, rows) == B.conversation_results(rows)


@pytest.mark.parametrize("fixups", [0, 1, 3])
def test_chunks_of_long_conversations_stitch(spark, fixups):
    """Conversations over many chunks and partitions, among them turns whose cost vectors never forget."""
    rng = random.Random(fixups)
    rows = _conversation(rng, 1, 300, ["user", "assistant", "system"]) + _conversation(rng, 2, 120, ["user", "assistant"])
    rows += [(3, t, "system", f"Note {t}.") for t in range(90)] + [(4, t, "user", "") for t in range(70)] + [(5, t, "tool", f"{t}.") for t in range(61)]
    rows += [(6, t, ["user", "assistant"][t % 2], f"All well {t}.") for t in range(100)] + [(7, 1, "user", "Same.")] * 80
    assert _repaired(spark, rows, 6, chunk_turns=5, fixups=fixups) == B.conversation_results(rows)


def test_conversations_without_turns_left_and_no_rows(spark):
    import zlib
    gone = [(c, t, "user", "Lost.") for c in range(400) for t in (0,) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    got = _repaired(spark, gone)
    assert gone and got == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in gone}
    assert _repaired(spark, []) == {}


def test_columns_of_other_names_change_nothing(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"Turn {t}") for c in range(5) for t in range(4)]
    df = spark.createDataFrame(rows, TURNS)
    extra = df.withColumns({c: F.lit("x") for c in ("conv", "gone", "byte", "g", "said", "part", "cost")})
    assert sorted(CV.repaired_conversations(extra).collect()) == sorted(CV.repaired_conversations(df).collect())


def test_vectors_of_small_chunks_follow_from_their_matrices():
    turns = [CV.level(v) for v in itertools.product(range(0, 8, 3), repeat=4)]
    for chunk in itertools.product([0, 1, 2, 3, 0 | 4, 1 | 4, 2 | 8], repeat=3):
        m = CV.matrix(bytes(chunk))
        for behind in turns[::7]:
            settled = CV.before_nothing(behind)
            want = settled
            for t in reversed(chunk):
                want = CV.before(t, want)
            assert tuple(min(m[4 * s + b] + settled[b] for b in range(4)) for s in range(4)) == want


def test_a_fix_up_ends_where_vectors_differ_by_a_constant():
    turns = bytes([1, 2] * 50)
    vector, run = CV.fix_up(turns, CV.END, (5, 9, 1, 4))
    assert vector is None and run < 10
    never = bytes([3] * 20)
    assert CV.fix_up(never, (0, 0, 0, 0), (0, 3, 3, 0))[1] == 20


# ------------------------------------------------------------ vector codes
def _coded(spark, rows, **options):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    return sorted((tuple(r) for r in VC.compress(df, **options).collect()), key=str)


def test_codes_equal_plain_rounds(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    rows = [(int(i), (centres[i % 6] + 0.05 * rng.normal(size=12)).tolist(), int(i) % 3) for i in rng.permutation(400)]
    rows += [(i, rows[0][1], None) for i in range(500, 760)]  # one vector held by very many rows
    rows += [(900, None, 1), (901, [1.0, None] * 6, 1), (902, [float("nan")] * 12, 2), (903, [float("inf")] + [0.0] * 11, 2), (None, [0.5] * 12, 1)]
    rows += [(5, [0.1] * 12, 0), (5, [0.1] * 12, 0)]  # repeated rows, and an id with two vectors
    for entries in (4, 64):
        assert _coded(spark, rows, entries=entries) == sorted(B.vector_codes(rows, entries), key=str)


def test_codes_of_large_components_and_odd_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * 40_000).tolist(), 0) for i in range(60)]
    assert _coded(spark, rows, entries=5) == sorted(B.vector_codes(rows, 5), key=str)
    odd = [(i, rng.normal(size=n).tolist(), i % 2) for i, n in enumerate([7, 7, 3, 0, 6, 7])]
    assert _coded(spark, odd, entries=2) == sorted(B.vector_codes(odd, 2), key=str)
    with pytest.raises(ValueError, match="don't fit"):
        _coded(spark, [(1, [1e30] * 4, 0)])


def test_no_vectors_no_codes(spark):
    assert _coded(spark, []) == [] and _coded(spark, [(1, None, 2)]) == []


def test_hilbert_neighbours_touch():
    for d, bits in ((2, 3), (3, 2), (4, 1)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=d)), np.uint8)
        order = sorted(range(len(cells)), key=lambda i: VC.hilbert_keys(cells[i : i + 1], bits)[0].tobytes())
        path = cells[order].astype(int)
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_short_lists_hold_every_nearest_entry():
    rng = np.random.default_rng(6)
    book = rng.integers(-50, 50, (40, 3))
    pruned = 0
    for _ in range(50):
        points = rng.integers(-50, 50, 3) + rng.integers(-6, 6, (20, 3))
        listed = np.flatnonzero(VC.short_lists(points.min(axis=0)[None], points.max(axis=0)[None], book)[0])
        pruned += len(listed) < 40
        distance = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        assert (listed[VC.nearest(points, book[listed])[0]] == distance.argmin(axis=1)).all()
    assert pruned == 50


# ------------------------------------------------------------ blob ledger
AWKWARD = [
    "", None, "nothing here", "password = hunter2", 'API_KEY: "abcdef" token=xyz', "token=token:abcdefgh", "secret=secret=secret==", "passwd  :  'a.b/c+d=e-f_g'",
    "AKIA" + "A1" * 8, "AKIA" + "A" * 15, "xAKIA" + "Z" * 40 + " AKIAAKIA" + "9" * 20, "0123456789abcdef" * 2, "f" * 23, "f" * 24 + "g" + "0" * 30,
    "héllo wörld 𝄞 token=ünï abc password=𝄞𝄞 secret=abc123_x", "PassWord='x' pAsSwD=\"longenough\"", "api_key=" + "k" * 200_000, "token = " * 2_000 + "value",
    "ghp_" + "Z" * 36, "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJ9.eyJzdWIiOiIx.abc-_", "xoxb-1234567890", "token" + " " * 50_000, "ſecret=abcdefgh toKen=abcdefgh",
]


def _base(r):
    return (r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256)


def _expected(rows):
    out = []
    for i, text in rows:
        found = B.base_secrets(text)
        said = ",".join(f"{k}:{a}:{b}" for a, k, b in found)
        out.append((i, *[sum(k == kind for _, k, _ in found) for kind in ("assign", "access", "hex")], hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def test_secrets_equal_plain_patterns(spark):
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(None, AWKWARD[3]), (3, AWKWARD[3]), (3, AWKWARD[4]), (100, " ".join(t or "" for t in AWKWARD))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = LG.secrets(df).collect()
    assert sorted(map(_base, got), key=str) == _expected(rows)
    for r in got:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert spans == sorted(spans, key=lambda s: (int(s[1]), LG.kinds(LG.RULES).index(s[0])))
        assert len(spans) == r.n_assign + r.n_access + r.n_hex + r.n_added
    added = {r.doc_id: r.spans for r in got if r.n_added}
    assert added[18] == "forge:0:40" and added[19] == "private_key:0:31" and "jwt:" in added[20] and "chat:" in added[21]


def test_the_ledger_scans_only_what_it_has_not_seen(spark):
    folder = scratch_path(spark, "ledger")
    one = {1: LG.BASE}
    first = spark.createDataFrame([(1, "password=abcdefg"), (2, "password=abcdefg"), (3, "clean")], "doc_id long, text string")
    LG.update(first, folder, one)
    ledger = LG.known(spark, folder)
    assert ledger.count() == 2  # copies are one blob
    again = LG.unseen(LG.versions(first), ledger, one)
    assert again.count() == 0
    later = first.unionByName(spark.createDataFrame([(1, "token: 12345678"), (4, "clean")], "doc_id long, text string"))
    fresh = LG.unseen(LG.versions(later), ledger, one).collect()
    assert [r.blob for r in fresh] == [hashlib.sha256(b"token: 12345678").digest()]
    assert all(r.missing == [1, 2] or r.missing == [2] for r in LG.unseen(LG.versions(later), ledger, LG.RULES).collect())
    got = LG.secrets(later, folder, one).collect()
    assert sorted(map(_base, got), key=str) == _expected([tuple(r) for r in later.collect()])
    assert LG.known(spark, folder).count() == 3
    LG.secrets(later, folder, LG.RULES)  # a new rule version: each blob once more, for it alone
    counts = {r["rule"]: r["count"] for r in LG.known(spark, folder).groupBy("rule").count().collect()}
    assert counts == {1: 3, 2: 3}


def test_secrets_plans_hold_no_python(spark):
    df = spark.createDataFrame([(1, "password=abcdefg")], "doc_id long, text string")
    plan = LG.scan(LG.versions(df), LG.unseen(LG.versions(df), None, LG.RULES), LG.RULES)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_secrets_of_no_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "password=abcdefg"), (2, None)], "doc_id long, text string")
    assert LG.secrets(df.limit(0)).collect() == []
    extra = df.withColumns({c: F.lit("x") for c in ("path", "key", "blob", "kind", "rule", "found", "missing", "spans")})
    assert sorted(LG.secrets(extra).collect()) == sorted(LG.secrets(df).collect())
