"""Secrets in texts, by an incremental ledger of blobs.

Every version of every path is a blob named by the SHA-256 of its text. The ledger, a
Parquet folder, holds one row for each pair of blob and rule version that has been scanned, with
what was found. A scan

1. names the blobs of all versions and takes the pairs the ledger doesn't hold (anti-join on
   names only; no text moves);
2. fetches one text for each such blob, whatever the number of its copies, and runs the rules
   of the missing versions over it;
3. appends the pairs, found or not, in one write; a run that dies before leaves the ledger as it was;
4. joins findings back to all paths that hold the blob.

Only DataFrame functions are used. A match's place follows from what stands between the matches
(``split``) and the matches themselves (``regexp_extract_all``): a running sum of their lengths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starling.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """`pattern` is matched leftmost and without overlaps; a match counts if its `group` has `least` characters.
    `hint` is a cheaper pattern found in every text that can have a match that counts."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str


# The base patterns, in the order of their kinds.
_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ASSIGN_HINT = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
BASE = (
    Rule("assign", _ASSIGN, 2, 6, _ASSIGN_HINT),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),  # runs are maximal: shorter ones never count
)
#: Shapes of well-known credentials beyond the base patterns.
SHAPES = (
    Rule("forge", r"gh[opsru]_[A-Za-z0-9]{36,}", 0, 40, r"gh[opsru]_[A-Za-z0-9]{36}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, r"xox[abprs]-[A-Za-z0-9-]{10}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 20, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
#: Rules by version. A version's rules never change: new rules are a new version.
RULES: dict[int, tuple[Rule, ...]] = {1: BASE, 2: SHAPES}

LEDGER = "blob binary, rule int, found array<struct<kind:int,start:long,end:long>>"


def kinds(rules: dict[int, tuple[Rule, ...]]) -> list[str]:
    return [r.kind for version in sorted(rules) for r in rules[version]]


def versions(docs: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, key, text, blob) of every row: each row is a version of its path. `key` is the path, never null."""
    text, key = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.concat(F.lit("/"), F.col(path_col).cast("string")), F.lit(""))
    return docs.select(F.col(path_col).alias("path"), key.alias("key"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))


def known(spark: SparkSession, folder: str) -> DataFrame | None:
    """The ledger, or none before its first scan."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def unseen(history: DataFrame, ledger: DataFrame | None, rules: dict[int, tuple[Rule, ...]]) -> DataFrame:
    """(blob, key, missing): the blobs with rule versions that the ledger lacks, and the least path key of each."""
    blobs = history.groupBy("blob").agg(F.min("key").alias("key"))
    wanted = sorted(rules)
    if ledger is None:
        return blobs.withColumn("missing", F.array(*map(F.lit, wanted)))
    had = ledger.where(F.col("rule").isin(wanted)).groupBy("blob").agg(F.collect_set("rule").alias("had"))
    missing = F.array_except(F.array(*map(F.lit, wanted)), F.coalesce("had", F.array().cast("array<int>")))
    return blobs.join(had, "blob", "left").select("blob", "key", missing.alias("missing")).where(F.size("missing") > 0)


def _matches(text: Column, version: int, kind: int, rule: Rule) -> Column:
    """The rule's matches as (rule, kind, i, gap, size, value): characters since the match before, of the match, of its group."""
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    values = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length) if rule.group else sizes
    zipped = F.transform(F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), values.alias("value")),
                         lambda m, i: F.struct(F.lit(version).alias("rule"), F.lit(kind).alias("kind"), i.alias("i"),
                                               m["gap"].alias("gap"), m["size"].alias("size"), m["value"].alias("value")))
    found = F.filter(zipped, lambda m: m["size"].isNotNull())  # after the last match there is only a gap
    return F.when(F.array_contains("missing", version) & text.rlike(rule.hint), found).otherwise(F.array().cast(_MATCH))


_MATCH = "array<struct<rule:int,kind:int,i:int,gap:int,size:int,value:int>>"


def scan(history: DataFrame, pairs: DataFrame, rules: dict[int, tuple[Rule, ...]]) -> DataFrame:
    """Ledger rows of `pairs`: what the rules of the missing versions find in one text of each blob."""
    # copies on other paths fall out in the join; those of the path itself in the grouping, which needs no further shuffle
    texts = history.select("key", "blob", "text").join(pairs, ["key", "blob"]).groupBy("key", "blob", "missing", "text").count()
    least, lists, kind = {}, [], 0
    for version in sorted(rules):
        for rule in rules[version]:
            lists.append(_matches(F.col("text"), version, kind, rule))
            least[kind], kind = rule.least, kind + 1
    scanned = F.transform("missing", lambda v: F.struct(v.alias("rule"), F.lit(None).cast("int").alias("kind"), F.lit(0).alias("i"),
                                                        F.lit(0).alias("gap"), F.lit(0).alias("size"), F.lit(0).alias("value")))
    each = texts.select("blob", F.inline(F.concat(scanned.cast(_MATCH), *lists))).repartition("blob")
    before = Window.partitionBy("blob", "rule", "kind").orderBy("i")
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(before)
    enough = F.coalesce(*[F.when(F.col("kind") == k, F.col("value") >= n) for k, n in least.items()])
    placed = each.withColumn("end", end).withColumn("hit", F.when(enough, F.struct("kind", (F.col("end") - F.col("size")).alias("start"), "end")))
    return placed.groupBy("blob", "rule").agg(F.collect_list("hit").alias("found"))


def update(docs: DataFrame, folder: str, rules: dict[int, tuple[Rule, ...]] | None = None, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan what the ledger in `folder` lacks for these versions, append it, and return the ledger."""
    rules = rules or RULES
    spark, history = docs.sparkSession, versions(docs, path_col, text_col)
    found = scan(history, unseen(history, known(spark, folder), rules), rules)
    found.write.mode("append").option("compression", "zstd").parquet(folder)
    return spark.read.schema(LEDGER).parquet(folder)


def _said(spans: Column, names: list[str]) -> Column:
    name = F.array(*map(F.lit, names))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def secrets(docs: DataFrame, folder: str | None = None, rules: dict[int, tuple[Rule, ...]] | None = None,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_added, blob) of each row. Counts and digest are of
    the base patterns; `spans` has all rules' matches as kind:start:end in code points, end exclusive, by start, then
    kind. `folder` holds the ledger that is read and appended to; by default a new one.

    Null and empty texts are the empty blob and have no spans; a null id stays null; repeated rows are
    answered each; rows of one id with different texts are versions of a path, scanned and answered each; an empty table gives
    an empty result. Only the two columns named are read."""
    rules = rules or RULES
    folder = folder or scratch_path(docs.sparkSession, "ledger")
    ledger, names = update(docs, folder, rules, id_col, text_col), kinds(rules)
    by_start = F.array_sort(F.transform(F.flatten(F.collect_list("found")), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    found = (ledger.where(F.col("rule").isin(*rules) & (F.size("found") > 0)).groupBy("blob").agg(by_start.alias("all"))
             .withColumn("base", F.filter("all", lambda s: s["kind"] < len(BASE))))
    number = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(number) - F.size(F.array_remove(number, k))).cast("long").alias(f"n_{rule.kind}") for k, rule in enumerate(BASE)]
    report = found.select("blob", *counts, F.sha2(_said(F.col("base"), names), 256).alias("base_sha256"),
                          _said(F.col("all"), names).alias("spans"), (F.size("all") - F.size("base")).cast("long").alias("n_added"))
    none = {"base_sha256": F.sha2(F.lit(""), 256), "spans": F.lit("")}
    paths = versions(docs, id_col, text_col).select("path", "blob").join(report, "blob", "left")
    return paths.select(F.col("path").alias(id_col), *[F.coalesce(c, none.get(c, F.lit(0).cast("long"))).alias(c) for c in report.columns if c != "blob"],
                        F.lower(F.hex("blob")).alias("blob"))
