"""Conversation structure: damage, faults and cheapest repair.

A repair keeps, reroles or deletes each turn and inserts empty ones, so that the roles read system (if any, once,
first), then user and assistant in alternation, ended by the assistant. Its least cost is a shortest path through four states
(nothing yet, after system, after user, after assistant); of several cheapest ones the one whose
edit letters come first in ASCII is taken.

Turns are sorted once over the cluster, by conversation and turn; the sorted partitions are cut into chunks, and a long
conversation spans many. Costs run backwards: the vector of a place holds the cost still to pay from each state.

* A conversation within one chunk is finished where it lies.
* Chunks of a longer one start from a speculative vector behind them, the end's. Fix-up passes hand each
  chunk its successor's vector; a chunk whose vector differs from the one it had by more than a constant is run again, from
  its end until the new vectors differ from the old by constants only. After ``fixups`` passes,
  chunks that still move (turns whose vectors never forget) are solved by products of their cost matrices, whose reach doubles.
* The stitched costs drive the trace: each chunk says where it leaves from each state it could be entered
  in; these maps are composed along the conversation, then each chunk traces its own piece of the audit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starling.llm import common

#: Turns and bytes of text in a chunk, at most (one turn at least).
CHUNK_TURNS, CHUNK_BYTES = 4096, 4 << 20
#: Fix-up passes before chunks that still move are solved by doubling.
FIXUPS = 3

# The edits' costs.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant turn that fits next.
_NEXT = (USER, USER, ASSISTANT, USER)
#: Cost still to pay behind the last turn.
END = (0, 2 * INSERT, INSERT, 0)
_FAR = 1 << 40
# A turn as a byte: 0 system, 1 user, 2 assistant, 3 other role, plus its fault.
_TRUNCATED, _BLANK, _DUPLICATE = 4, 8, 16
_NAMES = ("user", "assistant")
_LEGAL = frozenset(("su", "ua", "au"))
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


# ------------------------------------------------------------------ costs

def _turn_costs(turn: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before the turn (without insertions there) from the costs behind it."""
    if turn & (_BLANK | _DUPLICATE):
        return tuple(DELETE + c for c in after)
    extra = CUT_OFF if turn & _TRUNCATED else 0
    return tuple(min(DELETE + after[s], REROLE + extra + after[_NEXT[s]], extra + after[k] if (k := _kept(turn, s)) >= 0 else _FAR) for s in range(4))


def _kept(turn: int, state: int) -> int:
    """The state after keeping the turn; -1 where it doesn't fit."""
    role = turn & 3
    if role == 0:
        return SYSTEM if state == NOTHING else -1
    if role == 3 or (state == USER) != (role == 2):
        return -1
    return ASSISTANT if role == 2 else USER


def before(turn: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The cost vector before a turn, insertions there included."""
    n, s, u, a = _turn_costs(turn, after)
    u = min(u, INSERT + a)
    return min(n, INSERT + u), min(s, INSERT + u), u, min(a, INSERT + u)


def level(vector: Iterable[int]) -> tuple[int, ...]:
    """The vector less its least cost: equal for vectors that differ by a constant."""
    vector = tuple(vector)
    least = min(vector)
    return tuple(c - least for c in vector)


@lru_cache(maxsize=1 << 14)
def _level_before(turn: int, after: tuple[int, ...]) -> tuple[int, ...]:
    return level(before(turn, after))


def backward(turns: bytes, behind: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The levelled vectors at each place of a chunk, the last one behind it."""
    out = [level(behind)]
    for turn in reversed(turns):
        out.append(_level_before(turn, out[-1]))
    out.reverse()
    return out


def fix_up(turns: bytes, old: tuple[int, ...], new: tuple[int, ...]) -> tuple[tuple[int, ...] | None, int]:
    """Run a chunk again from another vector behind it, until it differs from the old run's by a constant: the new
    vector before the chunk (none: as it was), and the turns run."""
    old, new = level(old), level(new)
    for n, turn in enumerate(reversed(turns)):
        if old == new:
            return None, n
        old, new = _level_before(turn, old), _level_before(turn, new)
    return (None if old == new else new), len(turns)


def matrix(turns: bytes) -> list[int]:
    """Cost from each state before the chunk to each behind it, row by row."""
    columns = []
    for behind in range(4):
        vector = tuple(0 if s == behind else _FAR for s in range(4))
        vector = before_nothing(vector)
        for turn in reversed(turns):
            vector = before(turn, vector)
        columns.append(vector)
    return [min(columns[b][s], _FAR) for s in range(4) for b in range(4)]


def before_nothing(vector: tuple[int, ...]) -> tuple[int, ...]:
    """Insertions only."""
    n, s, u, a = vector
    u, a = min(u, INSERT + a), min(a, INSERT + u)
    return min(n, INSERT + u), min(s, INSERT + u), u, a


@lru_cache(maxsize=1 << 16)
def _edits(turn: int, after: tuple[int, ...], state: int) -> tuple[str, int]:
    """The ASCII-least cheapest letters from a state up to and with the turn, and the state then."""
    here, letters = before(turn, after), ""
    extra = CUT_OFF if turn & _TRUNCATED else 0
    while True:
        if DELETE + after[state] == here[state]:
            return letters + "D", state
        if INSERT + here[_NEXT[state]] == here[state]:
            letters, state = letters + "I", _NEXT[state]
        elif (k := _kept(turn, state)) >= 0 and extra + after[k] == here[state]:
            return letters + "K", k
        else:
            return letters + "R", _NEXT[state]


def trace(turns: bytes, vectors: list[tuple[int, ...]], state: int) -> tuple[list[str], int]:
    """Letters up to and with each turn, from the state the chunk is entered in, and the state it is left in."""
    out = []
    for turn, after in zip(turns, vectors[1:]):
        letters, state = _edits(turn, after, state)
        out.append(letters)
    return out, state


# ----------------------------------------------------------- conversations

def damage(table: DataFrame) -> DataFrame:
    """(conv, turn, role, text, gone) of a conversations table after damage by crc32 of `conv_id:turn`; null
    cells are one space. Turns it drops stay as rows that are `gone`, so that no conversation gets lost."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    role, text = F.when(kind == 4, "user").otherwise(or_space("role")), or_space("text")
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = table.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                        (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv", "turn", "role", "text", "gone", F.explode(F.array_repeat(F.lit(True), F.col("times"))).alias("_")).drop("_")


def _described(rows: DataFrame) -> DataFrame:
    """With each turn's byte (duplicates not known yet), its role's initial and the digest of role and text."""
    end = F.right(F.rtrim(F.col("text"), F.lit(_SPACES)), F.lit(1))
    initial = F.substring("role", 1, 1)
    fault = F.when(end == "", _BLANK).when(~end.isin(".", "!", "?"), _TRUNCATED).otherwise(0)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    said = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    return rows.select("conv", "turn", "role", "text", "gone", (fault + role).alias("byte"), initial.alias("initial"), said.alias("said"))


#: What is counted of a chunk: its turn numbers and initials, to be joined with those of the chunk before.
_FACTS = [("low", "long"), ("high", "long"), ("distinct", "long"), ("first", "string"), ("last", "string"), ("illegal", "long")]
_RESULT = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"),
           ("audit", "string"), ("repaired_sha256", "string")]
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_()}


class Chunk:
    """Consecutive turns of one conversation."""

    def __init__(self, conv: int | None, most: int = CHUNK_TURNS):
        self.conv, self.most, self.turns, self.roles, self.texts, self.said, self.size = conv, most, bytearray(), [], [], {}, 0
        self.low = self.high = self.first = self.last = None
        self.distinct = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, byte: int, initial: str, said: bytes) -> None:
        if not byte & _BLANK and self.said.setdefault(said, len(self.turns)) < len(self.turns):
            byte = byte & 3 | _DUPLICATE
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = (turn if self.low is None else self.low), turn
        if self.turns:
            self.illegal += self.last + initial not in _LEGAL
        else:
            self.first = initial
        self.last = initial
        self.turns.append(byte)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)

    @property
    def full(self) -> bool:
        return len(self.turns) >= self.most or self.size >= CHUNK_BYTES

    def facts(self) -> dict:
        return {name: getattr(self, name) for name, _ in _FACTS}


def piece(turns: bytes, roles: list[str], texts: list[str], letters: list[str], state: int) -> tuple[str, str, int]:
    """(audit, repaired lines each ended by a newline, cost) of a chunk's turns, entered in `state`."""
    lines, cost = [], 0
    for turn, role, text, edits in zip(turns, roles, texts, letters):
        cost += INSERT * (len(edits) - 1)
        for _ in edits[:-1]:
            state = _NEXT[state]
            lines.append(f"{_NAMES[state == ASSISTANT]}:\n")
        last = edits[-1]
        if last == "D":
            cost += DELETE
            continue
        cost += (REROLE if last == "R" else 0) + (CUT_OFF if turn & _TRUNCATED else 0)
        state = _NEXT[state] if last == "R" else _kept(turn, state)
        lines.append(f"{role if last == 'K' else _NAMES[state == ASSISTANT]}:{text}\n")
    return "".join(letters), "".join(lines), cost


class Repaired:
    """A conversation's result, put together from its chunks in order; texts are hashed as they pass."""

    def __init__(self):
        self.low = self.high = self.last = None
        self.distinct = self.illegal = self.blank = self.duplicate = self.truncated = self.cost = 0
        self.audit, self.digest, self.held = [], hashlib.sha256(), ""

    def add(self, facts: dict, turns: bytes, audit: str, repaired: str, cost: int) -> None:
        if facts["low"] is not None:
            self.distinct += facts["distinct"] - (facts["low"] == self.high)
            self.low, self.high = (facts["low"] if self.low is None else self.low), facts["high"]
        if facts["first"] is not None:
            self.illegal += facts["illegal"] + (self.last is not None and self.last + facts["first"] not in _LEGAL)
            self.last = facts["last"]
        self.blank += sum(1 for t in turns if t & _BLANK)
        self.duplicate += sum(1 for t in turns if t & _DUPLICATE)
        self.truncated += sum(1 for t in turns if t & _TRUNCATED)
        self.cost += cost
        self.audit.append(audit)
        self._hash(repaired)

    def _hash(self, lines: str) -> None:
        if lines:  # the last newline is no part of the result
            self.digest.update((self.held + lines[:-1]).encode("utf-8", "surrogatepass"))
            self.held = "\n"

    def end(self, state: int) -> tuple:
        while state in (SYSTEM, USER):
            state = _NEXT[state]
            self.cost += INSERT
            self.audit.append("I")
            self._hash(f"{_NAMES[state == ASSISTANT]}:\n")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def _finished(chunk: Chunk) -> tuple:
    """The result of a conversation that is one chunk."""
    turns = bytes(chunk.turns)
    letters, state = trace(turns, backward(turns, END), NOTHING)
    out = Repaired()
    out.add(chunk.facts(), turns, *piece(turns, chunk.roles, chunk.texts, letters, NOTHING))
    return out.end(state)


_OPEN = [("part", "int"), ("seq", "long"), *_FACTS, ("turns", "binary")]
_LISTS = [("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("said", pa.list_(pa.struct([("pos", pa.int32()), ("said", pa.binary())])))]
_PIECES = pa.schema([("conv", pa.int64()), ("open", pa.bool_()), *((f"r_{n}", _ARROW[k]) for n, k in _RESULT), *((n, _ARROW[k]) for n, k in _OPEN), *_LISTS])
_PIECES_DDL = ", ".join(["conv long", "open boolean", *(f"r_{n} {k}" for n, k in _RESULT), *(f"{n} {k}" for n, k in _OPEN),
                         "roles array<string>", "texts array<string>", "said array<struct<pos:int,said:binary>>"])


def pieces(sorted_rows: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """Results of the conversations that lie whole in a chunk inside a partition, and the open chunks of all others."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out, size = TaskContext.get().partitionId(), 0, [], 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, schema=_PIECES)

        def opened(chunk: Chunk) -> dict:
            said = [{"pos": pos, "said": digest} for digest, pos in chunk.said.items()]
            return {"conv": chunk.conv, "open": True, "part": part, "seq": seq, **chunk.facts(), "turns": bytes(chunk.turns), "roles": chunk.roles,
                    "texts": chunk.texts, "said": said}

        now, inside = None, False  # the chunk being filled; whether its conversation begins with it, after another one
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "gone", "byte", "initial", "said")]
            for conv, turn, role, text, gone, byte, initial, said in zip(*columns):
                if now is None:
                    now = Chunk(conv, chunk_turns)
                elif conv != now.conv:
                    if inside:
                        out.append({"conv": now.conv, "open": False} | {f"r_{n}": v for (n, _), v in zip(_RESULT, _finished(now))})
                    else:
                        out.append(opened(now))
                        seq += 1
                    size += now.size + 100
                    now, inside = Chunk(conv, chunk_turns), True
                elif now.full:
                    out.append(opened(now))
                    seq, size = seq + 1, size + now.size
                    now, inside = Chunk(conv, chunk_turns), False
                if not gone:
                    now.add(turn, role, text, byte, initial, said)
                if size >= CHUNK_BYTES:
                    yield sent()
                    out, size = [], 0
        if now is not None:
            out.append(opened(now))
        yield sent()

    return sorted_rows.mapInArrow(cut_up, _PIECES_DDL)


# --------------------------------------------------------- open chunks

def _numbered(chunks: DataFrame) -> DataFrame:
    """Open chunks with their place `g` in the order of all, without gaps, and whether the one before or after is of the same conversation."""
    spark = chunks.sparkSession
    counts = sorted((r["part"], r["count"]) for r in chunks.groupBy("part").count().collect())  # a row for each partition
    first, at = [], 0
    for part, n in counts:
        first.append((part, at))
        at += n
    offsets = spark.createDataFrame(first or [(-1, 0)], "part int, offset long")
    placed = chunks.join(F.broadcast(offsets), "part").withColumn("g", F.col("offset") + F.col("seq"))
    names = placed.select("g", "conv")
    for name, step in (("follows", 1), ("goes_on", -1)):
        beside = names.select((F.col("g") + step).alias("g"), F.col("conv").alias("_c"), F.lit(True).alias("_there"))
        placed = placed.join(beside, "g", "left").withColumn(name, F.col("conv").eqNullSafe(F.col("_c")) & F.coalesce("_there", F.lit(False))).drop("_c", "_there")
    return placed


def _late(chunks: DataFrame) -> DataFrame:
    """(g, late): turns of open chunks that repeat what an earlier chunk of the conversation said."""
    said = chunks.select("g", "conv", F.inline("said"))
    firsts = said.groupBy("conv", "said").agg(F.min("g").alias("g0"), F.count("*").alias("n")).where("n > 1")
    again = said.alias("s").join(firsts.alias("f"), F.expr("s.conv <=> f.conv AND s.said = f.said AND s.g > f.g0"))
    return again.groupBy("g").agg(F.collect_list("pos").alias("late"))  # a chunk's turns at most


_STATE = "g long, follows boolean, goes_on boolean, turns binary, given array<int>, vector array<int>, moved boolean"


def _by_rows(df: DataFrame, ddl: str, step) -> DataFrame:
    """`step` on each row as a dict; what it returns is added to the row's columns that `ddl` names."""
    schema = df.sparkSession.createDataFrame([], ddl).schema
    names = schema.names

    def each(batches):
        arrow = _arrow_schema(schema)
        for batch in batches:
            rows = [r | step(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema=arrow)

    return df.mapInArrow(each, ddl)


def _arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _patched(turns: bytes, late: list[int] | None) -> bytes:
    out = bytearray(turns)
    for pos in late or ():
        out[pos] = out[pos] & 3 | _DUPLICATE
    return bytes(out)


def stitched(chunks: DataFrame, fixups: int = FIXUPS) -> DataFrame:
    """(g, follows, turns, given): the true vector, but for a constant, behind each open chunk."""

    def speculate(r: dict) -> dict:
        turns = _patched(r["turns"], r["late"])
        return {"turns": turns, "given": list(END), "vector": list(backward(turns, END)[0]), "moved": True}

    state = common.cut(_by_rows(chunks.select("g", "follows", "goes_on", "turns", "late"), _STATE, speculate), "spec")

    def rerun(r: dict) -> dict:
        if r["next"] is None or r["next"] == r["given"]:
            return {"moved": False}
        vector, _ = fix_up(r["turns"], tuple(r["given"]), tuple(r["next"]))
        return {"given": r["next"], "vector": r["vector"] if vector is None else list(vector), "moved": vector is not None}

    def handed(state: DataFrame) -> DataFrame:
        after = state.select((F.col("g") - 1).alias("g"), F.col("vector").alias("next"))
        return state.join(after, "g", "left").withColumn("next", F.when(F.col("goes_on"), F.col("next")))

    for _ in range(fixups):
        state = common.cut(_by_rows(handed(state), _STATE, rerun), "fixup")
        if not state.where("moved").limit(1).count():
            return state
    return common.cut(_solved(state), "solved")


def _solved(state: DataFrame) -> DataFrame:
    """Exact vectors behind all chunks by products of cost matrices, each step twice as far: as many steps as
    the logarithm of the longest conversation's chunks."""
    ddl = "g long, goes_on boolean, m array<long>"

    def start(r: dict) -> dict:
        return {"m": matrix(r["turns"])}

    def joined(r: dict) -> dict:
        if not r["goes_on"]:
            return {}
        a, b = r["m"], r["m2"]
        m = [min(min(a[4 * s + t] + b[4 * t + u] for t in range(4)), _FAR) for s in range(4) for u in range(4)]
        least = min(m)
        return {"m": [min(x - least, _FAR) if x < _FAR else _FAR for x in m], "goes_on": r["on2"]}

    reach, far = 1, common.cut(_by_rows(state.select("g", "goes_on", "turns"), ddl, start), "matrix")
    while far.where("goes_on").limit(1).count():
        beyond = far.select((F.col("g") - reach).alias("g"), F.col("m").alias("m2"), F.col("goes_on").alias("on2"))
        far, reach = common.cut(_by_rows(far.join(beyond, "g", "left"), ddl, joined), "matrix"), 2 * reach
    to_end = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.array_min(F.array(*[F.get("m", s * 4 + t) + END[t] for t in range(4)])))
    behind = far.select((F.col("g") - 1).alias("g"), F.transform(to_end, lambda x: (x - F.array_min(to_end)).cast("int")).alias("next"))
    return (state.join(behind, "g", "left").withColumn("given", F.when(F.col("goes_on"), F.col("next")).otherwise(F.array(*map(F.lit, END)))).drop("next"))


def entered(state: DataFrame) -> DataFrame:
    """(g, entry): the state in which the trace enters each open chunk, from the chunks' maps composed along the conversation."""
    ddl = "g long, follows boolean, exits array<int>"

    def leave(r: dict) -> dict:
        vectors = backward(r["turns"], tuple(r["given"]))
        return {"exits": [trace(r["turns"], vectors, s)[1] for s in range(4)]}

    maps, reach = common.cut(_by_rows(state.select("g", "follows", "turns", "given"), ddl, leave), "exits"), 1
    # a map is settled if it begins with the conversation or leaves in one state wherever it is entered
    unsettled = F.col("follows") & (F.size(F.array_distinct("exits")) > 1)
    while maps.where(unsettled).limit(1).count():
        beyond = maps.select((F.col("g") + reach).alias("g"), F.col("exits").alias("to"), F.col("follows").alias("on"))
        both = maps.join(beyond, "g", "left")
        composed = F.transform("to", lambda s: F.get("exits", s))
        maps = common.cut(both.select("g", F.when(unsettled, F.col("on")).otherwise(F.col("follows")).alias("follows"),
                                      F.when(unsettled, composed).otherwise(F.col("exits")).alias("exits")), "exits")
        reach *= 2
    return maps.select((F.col("g") + 1).alias("g"), F.get("exits", F.lit(NOTHING)).alias("entry"))


def _repaired(chunks: DataFrame, fixups: int) -> DataFrame:
    """Results of the conversations of the open chunks: their texts pass in order, one chunk at a time."""
    state = stitched(chunks.select("g", "conv", "follows", "goes_on", "turns", "late"), fixups)
    entry = entered(state)
    known = (state.select("g", "turns", "given").join(entry, "g", "left"))
    whole = chunks.drop("turns", "said", "late").join(known, "g").withColumn("entry", F.when(F.col("follows"), F.col("entry")).otherwise(NOTHING))
    whole = whole.select("conv", "g", *[n for n, _ in _FACTS], "turns", "roles", "texts", "given", "entry")
    schema = pa.schema([("conv", pa.int64()), *((n, _ARROW[k]) for n, k in _RESULT)])

    def put_together(batches):
        out, now, begun, state = None, None, False, NOTHING
        for batch in batches:
            done = []
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                if begun and r["conv"] != now:
                    done.append((now, *out.end(state)))
                if not begun or r["conv"] != now:
                    out, now, begun = Repaired(), r["conv"], True
                letters, state = trace(r["turns"], backward(r["turns"], tuple(r["given"])), r["entry"])
                out.add(r, r["turns"], *piece(r["turns"], r["roles"], r["texts"], letters, r["entry"]))
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d)) for d in done], schema=schema)
        if begun:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (now, *out.end(state))))], schema=schema)

    dealt = whole.repartition("conv").sortWithinPartitions("conv", "g")
    return dealt.mapInArrow(put_together, "conv long, " + ", ".join(f"{n} {k}" for n, k in _RESULT))


# -------------------------------------------------------------- operators

def repair(rows: DataFrame, chunk_turns: int = CHUNK_TURNS, fixups: int = FIXUPS) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation among
    `rows` (conv, turn, role, text, gone). Turns stand by number, nulls first; turns of one number by the digest of role and text.

    A conversation whose turns are all gone has zeros, an empty audit and the digest of the empty text. A null conv is one conversation."""
    described = _described(rows).withColumn("_at", F.monotonically_increasing_id())
    order: list[Column] = [F.asc_nulls_first(c) for c in ("conv", "turn", "said", "_at")]  # turns are told apart, so that equal ones can be dealt out too
    dealt = described.repartitionByRange(common.parallelism(rows.sparkSession), *order).sortWithinPartitions(*order)
    found = common.cut(pieces(dealt.drop("_at"), chunk_turns), "pieces")
    whole = found.where("NOT open").select("conv", *[F.col(f"r_{n}").alias(n) for n, _ in _RESULT])
    chunks = common.cut(_numbered(found.where("open").drop(*(f"r_{n}" for n, _ in _RESULT))), "open")
    chunks = chunks.join(_late(chunks), "g", "left")
    return whole.unionByName(_repaired(chunks, fixups))


def repaired_conversations(table: DataFrame, chunk_turns: int = CHUNK_TURNS, fixups: int = FIXUPS) -> DataFrame:
    """The damaged table's conversations (``damage``), repaired: one row for each conv_id, also where no turn is left.

    Nulls in any column count as one space (a null turn is left out of `gaps` and stands first); an empty or blank text is a blank
    turn; repeated rows are duplicates after the first; an empty table gives an empty result. Further columns aren't read. A text
    is never cut; a chunk holds one turn at least, however long. The digest of a conversation is sequential by
    nature: its chunks pass one task in order, one at a time."""
    return repair(damage(table), chunk_turns, fixups).withColumnRenamed("conv", "conv_id")
