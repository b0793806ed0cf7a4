"""Plain versions of the conversation, vector code and secret operators."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

SPACE = " \t\n\x0b\x0c\r"


def conversation_results(rows: list[tuple]) -> dict:
    """(conv, turn, role, text) rows -> conv: result, by a forward search over whole strings."""
    said = lambda x: " " if x is None else str(x)
    kept = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if kind == 4:
            role = "user"
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        kept[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {conv: _repair(turns) for conv, turns in kept.items()}


def _repair(turns: list[tuple]) -> tuple:
    def key(t):
        return (t[0] is not None, t[0] or 0, hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest())

    turns = sorted(turns, key=key)
    faults, seen = [], set()
    for _, role, text in turns:
        body = text.strip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    numbers = {t for t, _, _ in turns if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    initials = [r[:1] for _, r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

    def insert(paths):  # role string so far decides what fits next
        for _ in range(3):
            for state, (cost, audit, lines) in list(paths.items()):
                role = "assistant" if state == "u" else "user"
                new = (cost + 3, audit + "I", (*lines, f"{role}:"))
                paths[role[0]] = min(paths.get(role[0], new), new)
        return paths

    paths = insert({"": (0, "", ())})
    for (_, role, text), fault in zip(turns, faults):
        after = {}

        def put(state, new):
            after[state] = min(after.get(state, new), new)

        for state, (cost, audit, lines) in paths.items():
            put(state, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            cost += 3 * (fault == "truncated")
            fits = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
            if role[:1] and role[:1] in fits:
                put(role[:1], (cost, audit + "K", (*lines, f"{role}:{text}")))
            name = "assistant" if state == "u" else "user"
            put(name[0], (cost + 3, audit + "R", (*lines, f"{name}:{text}")))
        paths = insert(after)
    cost, audit, lines = min(paths[s] for s in ("", "a") if s in paths)
    count = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def vector_codes(rows: list[tuple], entries: int = 256, rounds: int = 4) -> list[tuple]:
    """(id, vector, label) rows -> sorted (id, code, error, label_error, digest)."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // 4)
    kept = [(i, v + [0] * (4 * width - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(4)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            members = defaultdict(list)
            for _, v, _ in kept:
                members[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            for k, m in members.items():
                books[p][k] = [sum(c) // len(m) for c in zip(*m)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    coded, totals = [], defaultdict(int)
    for i, v, label in kept:
        best = [nearest(cut(v, p), books[p]) for p in range(4)]
        error = sum(e for e, _ in best)
        totals[label] += error
        coded.append((i, "".join(f"{k:02x}" for _, k in best), error, label))
    return [(i, code, error, totals[label], digest) for i, code, error, label in coded]


_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, by start, then kind as listed."""
    text = text or ""
    found = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda f: (f[0], ("assign", "access", "hex").index(f[1])))
