"""Plain Python versions of the operators, and a table of awkward documents."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward(spark):
    """Documents with nulls, empty and long texts, repeats and ties, and columns that clash."""
    some = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("doc_id", "text", "lang", "source", "n_chars")
    base = "the quick brown fox jumps over the lazy dog while seven wizards make toxic brew near an old stone bridge tonight"
    rows = [(1000, None), (1001, ""), (1002, " \n\t  "), (1003, "one"), (1004, base), (1004, base), (1005, base), (1005, base + " again"),
            (None, base), (None, "nothing like it"), (None, None), (1006, base + "\n" + base + "\n\n" + base.replace("quick", "quack")),
            (1007, "x" * 30000), (1008, "word " * 5000 + "end"), (1009, "a  b c <|endoftext|> <|startoftext|> déjà́ \U0001f600"),
            (1010, "mail me: a.b+c@d-e.fg.hi, +1 (858) 555-7280 or 4111 1111 1111 1111 at 10.0.0.1 and 999.1.1.1"), (1011, "é" * 70 + " " + "ß" * 70)]
    odd = spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows],
                                "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["id", "row", "mark", "gone", "kept", "bucket", "key", "n_tokens", "component_id", "score", "line", "node", "spans", "line_no", "item_id"]
    return some.unionByName(odd).withColumns({c: F.lit(f"own {c}") for c in clash})


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def tokens(name, text, end=()):
    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids + list(end)


def encode_all(name, texts, end=()):
    got = Tokenizer.from_file(public_tokenizers.path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [g.ids + list(end) for g in got]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def spans_removed(rows, window=13):
    """(id, n_words, n_removed, digest) of each row, sorted."""
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - window + 1):
                g = tuple(w[i : i + window])
                first[g] = min(d, first.get(g, d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def lines_kept(rows, threshold=2, least=20, within=None, exact=None):
    """{(id, text): kept text}: rows that repeat id and text are one document."""
    last = 1 << 62
    docs = sorted({(last if d is None else d, signed(xxhash.xxh64_intdigest((t or "").encode(), 42)), t) for d, t in rows if t is not None})
    places = [((d, m, k), line) for d, m, t in docs for k, line in enumerate(t.split("\n")) if len(line) >= (least if exact is None else exact)]
    first = {}
    for p, line in places:
        first[line] = min(p, first.get(line, p))
    joined, distinct = Union(), sorted(first, key=len)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if len(a) < least or len(b) - len(a) > threshold:
                break
            if (within or (lambda x, y: distance(x, y) <= threshold))(a, b):
                joined.join(a, b)
    least_of = {}
    for line in distinct:
        c = joined.find(line)
        least_of[c] = min(first[line], least_of.get(c, first[line]))
    out = {(d, t): t for d, t in rows}
    gone = defaultdict(set)
    for (d, m, k), line in places:
        if least_of[joined.find(line)] != (d, m, k):
            gone[d, m].add(k)
    for d, m, t in docs:
        out[None if d == last else d, t] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d, m])
    return out


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def simhash(text, words=3):
    w = [x for x in WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))]
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(v >> b & 1 for v in h) > len(h))


def simhash_components(rows, limit=3):
    """{fingerprint: smallest id reachable}."""
    prints = defaultdict(list)
    for d, t in rows:
        prints[simhash(t)].append(d)
    joined, keys = Union(), list(prints)
    for i, a in enumerate(keys):
        joined.find(a)
        for b in keys[:i]:
            if bin(a ^ b).count("1") <= limit:
                joined.join(a, b)
    least = {}
    for k in keys:
        known = [d for d in prints[k] if d is not None]
        c = joined.find(k)
        least[c] = min([*known, *([least[c]] if least.get(c) is not None else [])], default=None)
    return {k: least[joined.find(k)] for k in keys}


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return sum(d[0::2] + [x * 2 - 9 if x > 4 else x * 2 for x in d[1::2]]) % 10 == 0


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15)]


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p, good in BASE for m in re.finditer(p, text or "") if good(m.group())]
