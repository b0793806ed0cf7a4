"""Personal data by patterns and a skip-chain conditional random field.

Four base patterns (email, ip, card, phone) give spans that always stay. The field works on
the text's tokens (runs without white space) that hold a digit or an @; all other
tokens are outside by definition, so they need no variables. Variables are joined by

* the chain: tokens with one white-space character between them;
* skip edges: tokens of a document that repeat each other, or hold the same four or more
  digits in another dress, each with one of them: the first that a base pattern names, or else the first.

Tokens that a base pattern names are observed. The potentials are fitted piece by piece on a bounded sample of the corpus and on
views of it: a softmax over token features, and log ratios of how often two labels
meet on an edge to how often they would by chance. Base patterns alone would teach nothing beyond themselves, so a view
adds to a text what the patterns can't see: mentions of its phones, cards and addresses in another dress, which keep their
label, phones with another number right behind them, which the pattern drops, and numbers of the look of these
mentions that nothing in the text supports, some of them repeated, which are outside. So the look of a bare
number says little, and what it repeats says much. Loopy belief propagation passes
messages along all edges of a batch of texts at once until they settle; tokens whose best label is sure enough
become added spans."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.llm import common

KINDS = ("email", "ip", "card", "phone")
#: Texts that the potentials are fitted on, at most: those of least hash.
SAMPLE_TEXTS = 4_000
#: Longer texts take no part in the fit.
SAMPLE_CHARS = 100_000
FEATURE_BITS, STEPS, RATE = 15, 150, 0.1
#: Messages have settled when none changes by more; loops that never do end after so many sweeps.
SETTLED, MOST_SWEEPS = 1e-4, 200
SURE = 0.9
#: Unsupported numbers beside each mention in another dress; half of them stand twice.
STRANGERS = 4
_CLAMP = 30.0
_OUTSIDE = 0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MAYBE = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_NO_DIGIT = re.compile(r"[^0-9]")
_EDGE = ".,;:!?()[]{}<>\"'|"


# ----------------------------------------------------------- base patterns

def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the longest local part before it, back to the match before."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Four parts at a time of each dotted run of numbers."""
    out = []
    for run in _DOTTED.finditer(text):
        parts, at = run.group().split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for run in _DIGITS.finditer(text):
        if run.end() - run.start() >= 13:
            digits = _NO_DIGIT.sub("", run.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(run.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    if not _MAYBE.search(text):
        return []
    return [(k, s, e) for k, find in enumerate((emails, ips, cards, phones)) for s, e in find(text)]


# ------------------------------------------------------------------ field

_RUN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)


def _shape(token: str) -> str:
    """The token's look: runs of digits by length, runs of letters, all else as it is."""
    return "".join(f"9{len(x)}." if "0" <= x[0] <= "9" else "a" if x[0].isalpha() else x for x in _RUN.findall(token))


class Graph:
    """The variables of some texts: tokens with their features, base labels and edges."""

    def __init__(self, texts: list[str], spans: list[list[tuple[int, int, int]]]):
        self.doc, self.start, self.end, self.label = [], [], [], []
        rows, cols, chain, skip = [], [], [], []
        for d, (text, found) in enumerate(zip(texts, spans)):
            before, at, by_key = None, 0, {}  # by_key: the variables of each key
            order = sorted((s, e, k) for k, s, e in found)
            tokens = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)] if _MAYBE.search(text) else []
            shapes = [_shape(t) for t, _, _ in tokens]
            for i, (token, start, end) in enumerate(tokens):
                n = len(self.doc)
                while at < len(order) and order[at][1] <= start:
                    at += 1
                # patterns of different kinds may overlap: the first one that reaches into the token names it
                label = order[at][2] + 1 if at < len(order) and order[at][0] < end else _OUTSIDE
                joined = before is not None and tokens[i - 1][2] + 1 == start
                follows = i + 1 < len(tokens) and tokens[i + 1][1] == end + 1
                left, right = (shapes[i - 1] if joined else "-"), (shapes[i + 1] if follows else "-")
                digits = _NO_DIGIT.sub("", token)
                core = token.strip(_EDGE)
                marks = "".join(sorted(set(re.sub(r"[^\W_]", "", core))))
                named = [f"s{shapes[i]}", f"l{left}|{shapes[i]}", f"r{shapes[i]}|{right}", f"n{len(digits)}|{marks}", f"c{core[:1] == '+'}{'@' in core}",
                         f"u{13 <= len(digits) <= 19 and luhn(digits)}{len(digits)}", f"i{bool(ips(core))}", f"e{bool(emails(core))}", "b"]
                rows += [n] * len(named)
                cols += [zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << FEATURE_BITS) - 1) for x in named]
                if joined:
                    chain.append((n - 1, n))
                key = digits if len(digits) >= 4 else core.lower()
                by_key.setdefault(key, []).append((n, label))
                self.doc.append(d)
                self.start.append(start)
                self.end.append(end)
                self.label.append(label)
                before = n
            for members in by_key.values():
                hub = next((n for n, label in members if label != _OUTSIDE), members[0][0])
                skip += [(hub, n) for n, _ in members if n != hub]
        self.rows, self.cols = np.array(rows, np.int64), np.array(cols, np.int64)
        self.chain, self.skip = (np.array(x, np.int64).reshape(-1, 2) for x in (chain, skip))

    def __len__(self) -> int:
        return len(self.doc)


@dataclass
class Field:
    """Fitted potentials: features by label, and one table for each kind of edge."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def logits(self, g: Graph) -> np.ndarray:
        return np.stack([np.bincount(g.rows, self.unary[g.cols, k], len(g)) for k in range(self.unary.shape[1])], axis=1)

    def marginals(self, g: Graph) -> np.ndarray:
        """Beliefs of all variables when the messages of loopy belief propagation have settled. What a base pattern names is observed."""
        unary = self.logits(g)
        labels = unary.shape[1]
        known = np.array(g.label, np.int64) != _OUTSIDE
        unary[known] = -_CLAMP
        unary[known, np.array(g.label, np.int64)[known]] = _CLAMP
        edges = np.concatenate([g.chain, g.skip])
        table = np.concatenate([np.broadcast_to(self.chain, (len(g.chain), labels, labels)), np.broadcast_to(self.skip, (len(g.skip), labels, labels))])
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), labels))
        belief = unary.copy()
        for _ in range(MOST_SWEEPS if len(source) else 0):
            out = (belief[source] - message[back])[:, :, None] + table
            top = out.max(axis=1, keepdims=True)
            new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - message).max()
            message = 0.5 * message + 0.5 * new
            belief = unary + np.stack([np.bincount(target, message[:, k], len(g)) for k in range(labels)], axis=1)
            if change < SETTLED:
                break
        e = np.exp(belief - belief.max(axis=1, keepdims=True)) if len(g) else belief
        return e / e.sum(axis=1, keepdims=True) if len(g) else e


def fit(g: Graph) -> Field:
    """Piecewise training: softmax regression on the features; smoothed log ratios on the edges."""
    labels, n = len(KINDS) + 1, len(g)
    unary = np.zeros((1 << FEATURE_BITS, labels))
    if not n:
        unary[:, _OUTSIDE] = 1.0
        return Field(unary, np.zeros((labels, labels)), np.zeros((labels, labels)))
    label = np.array(g.label)
    want = np.zeros((n, labels))
    want[np.arange(n), label] = 1
    used, cols = np.unique(g.cols, return_inverse=True)
    w, seen = np.zeros((len(used), labels)), np.full((len(used), labels), 1e-6)
    for _ in range(STEPS):
        z = np.stack([np.bincount(g.rows, w[cols, k], n) for k in range(labels)], axis=1)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = p - want
        grad = np.stack([np.bincount(cols, d[g.rows, k], len(used)) for k in range(labels)], axis=1) + 1e-2 * w
        seen += grad**2
        w -= 4 * RATE * grad / np.sqrt(seen)
    unary[used] = w

    def ratios(edges: np.ndarray, most: float) -> np.ndarray:
        if not len(edges):
            return np.zeros((labels, labels))
        count = np.full((labels, labels), 0.5)
        np.add.at(count, (label[edges[:, 0]], label[edges[:, 1]]), 1)
        count = count + count.T
        share = count / count.sum()
        chance = share.sum(axis=1)[:, None] * share.sum(axis=0)[None, :]
        return np.clip(np.log(share / chance), -most, most)

    return Field(unary, ratios(g.chain, 1.0), ratios(g.skip, 5.0))


def _dresses(kind: str, text: str) -> list[str]:
    """A span's text in forms that the base patterns don't see."""
    digits = _NO_DIGIT.sub("", text)
    if kind == "phone":
        return [digits, "-".join(digits[i : i + 3] for i in range(0, len(digits), 3))]
    if kind == "card":
        return [".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), "_".join(digits[i : i + 4] for i in range(0, len(digits), 4))]
    return [text.replace(".", "-"), text.replace(".", "_")] if kind == "ip" else []


def _card(rng: random.Random) -> str:
    """A number of 16 digits that passes the check."""
    body = str(rng.randrange(1, 10)) + "".join(rng.choice("0123456789") for _ in range(14))
    return next(body + d for d in "0123456789" if luhn(body + d))


def views(texts: list[str], spans: list[list[tuple[int, int, int]]]) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """The texts and, of those with base spans, a view each with mentions in another dress and unsupported numbers of their look added."""
    out, said = list(texts), [list(s) for s in spans]
    for text, found in zip(texts, spans):
        more, labelled, rng = [text], list(found), random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
        size = len(text)

        def add(word: str, kind: int | None, more=more, labelled=labelled) -> None:
            nonlocal size
            more.append(word)
            if kind is not None:
                labelled.append((kind, size + 1, size + 1 + len(word)))
            size += 1 + len(word)

        for kind, start, end in found:
            if KINDS[kind] == "phone":  # a number right behind a phone makes the pattern's match too long, and it is dropped
                add(text[start:end], kind)
                if rng.random() < 0.5:
                    add(_card(rng), KINDS.index("card"))
                else:
                    add(".".join(str(rng.randrange(256)) for _ in range(4)), KINDS.index("ip"))
            for form in _dresses(KINDS[kind], text[start:end]):
                add(form, kind)
                for k in range(STRANGERS):
                    stranger = re.sub("[0-9]", lambda m: rng.choice("0123456789"), form)
                    for _ in range(1 + k % 2):
                        if not base_spans(stranger):
                            add(stranger, None)
        if len(more) > 1:
            out.append(" ".join(more))
            said.append(labelled)
    return out, said


def added_spans(g: Graph, belief: np.ndarray, texts: list[str], spans: list) -> list[list[tuple[int, int, int]]]:
    """Tokens that are surely of a kind and touch no base span; neighbours of one kind are one span."""
    out: list = [[] for _ in texts]
    if not len(g):
        return out
    best = belief.argmax(axis=1)
    sure = np.flatnonzero((best != _OUTSIDE) & (belief.max(axis=1) >= SURE) & (np.array(g.label) == _OUTSIDE))
    for n in sure.tolist():
        d, kind, token = g.doc[n], int(best[n]) - 1, texts[g.doc[n]][g.start[n] : g.end[n]]
        core = token.strip(_EDGE)
        start = g.start[n] + len(token) - len(token.lstrip(_EDGE))
        end = start + len(core)
        if not core or kind == 0 and "@" not in core or kind and sum("0" <= c <= "9" for c in core) < 4:
            continue
        if out[d] and out[d][-1][0] == kind and out[d][-1][2] + 1 == start:
            out[d][-1] = (kind, out[d][-1][1], end)
        else:
            out[d].append((kind, start, end))
    return out


# -------------------------------------------------------------- operators

def train(docs: DataFrame, text_col: str = "text", sample_texts: int = SAMPLE_TEXTS) -> Field:
    """Fit the potentials on at most `sample_texts` texts that hold a digit or an @, those
    of least hash and at most SAMPLE_CHARS characters, in one task. Without any, everything is outside."""
    slim = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    some = slim.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS)).select("mark").distinct().orderBy(F.xxhash64("mark"), "mark").limit(sample_texts)
    chosen = common.cut(some, "sample")  # at most `sample_texts` numbers
    texts = slim.join(F.broadcast(chosen), "mark", "left_semi").dropDuplicates(["mark"])

    def fit_all(frames):
        parts = list(frames)
        if not parts:
            return
        some = pd.concat(parts).sort_values("mark")["text"].tolist()  # the same sample gives the same field
        field = fit(Graph(*views(some, [base_spans(t) for t in some])))
        yield pd.DataFrame({k: [getattr(field, k).astype("<f4").tobytes()] for k in ("unary", "chain", "skip")})

    # one task: what it gets is bounded by `sample_texts`
    found = texts.repartition(1).mapInPandas(fit_all, "unary binary, chain binary, skip binary").first()
    if found is None:
        return fit(Graph([], []))
    labels = len(KINDS) + 1
    return Field(*(np.frombuffer(found[k], "<f4").reshape(-1, labels).astype(float) for k in ("unary", "chain", "skip")))


def _said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def personal_data(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of each row. The counts and
    the digest are of the base patterns; `spans` has these and what the field adds, as
    kind:start:end in code points, end exclusive, by kind (email, ip, card, phone), then start.

    Null and empty texts have no spans; a null id stays null; repeated rows are read each;
    an empty table gives an empty result. `field` is fitted on `docs` where it isn't given."""
    field = field or train(docs, text_col)
    held = docs.sparkSession.sparkContext.broadcast(field)  # as large as 2 ** FEATURE_BITS features
    schema = pa.schema([("id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()),
                        ("n_added", pa.int64())])

    def find(batches):
        for rows in common.slices(batches, "text"):
            texts = [t or "" for t in rows.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            g = Graph(texts, base)
            more = added_spans(g, held.value.marginals(g), texts, base)
            counts = [[sum(k == kind for k, _, _ in b) for b in base] for kind in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(_said(b).encode()).hexdigest() for b in base]),
                 pa.array([_said([*b, *m]) for b, m in zip(base, more)]), pa.array([len(m) for m in more], pa.int64())], schema=schema)

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ddl = "id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return slim.mapInArrow(find, ddl).withColumnRenamed("id", id_col)
