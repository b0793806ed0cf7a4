"""Encoding whole texts with a public tokenizer, faster than text by text.

A text is cut at safe boundaries only: a single space between two characters that are
letters, digits or printable ASCII. The tokenizers used here never let a token
span such a place, and the character before or after it doesn't change what is on
the other side. What lies between two boundaries (mostly a word) is cut further where
the vocabularies always keep apart: into runs of Latin letters, of ASCII digits and of ASCII marks, and
single line ends. What holds anything else (other scripts, apostrophes, `<`, more white space) is left whole.

Cutting is numpy over a batch's bytes, and Arrow finds the distinct pieces. The library
encodes each once per worker; its ids are looked up afterwards and gathered for all texts at once."""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Zero-width: before a space that may be cut at.
BOUNDARY = re.compile(r"(?<=[\w!-~])(?= [\w!-~])")
#: Pieces that are letters only, after a space or not: all Latin ones but İ, which lower case makes two characters of.
_WORD = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-įı-ſ]+)")
#: Pieces that a worker's memory holds (results don't depend on it).
REMEMBERED = 400_000
#: Pieces of more bytes than this aren't remembered.
_LONG = 64

#: Between texts: a byte that UTF-8 doesn't have.
_END = b"\xff"
# Classes of bytes. The first two keep what is between two boundaries whole; all but _OTHER may stand beside a boundary, up to _DIGIT.
_OTHER, _MARKED, _LETTER, _MARK, _DIGIT, _LINE, _SPACE, _STOP = range(8)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x21:0x7F] = _MARK
_CLASS[[ord("'"), ord("<")]] = _MARKED  # these may begin a contraction or an added token
_CLASS[[b for b in range(128) if chr(b).isalpha()]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[0x0A, 0x20, _END[0]]] = _LINE, _SPACE, _STOP


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs pool[start : start + size], one after the other."""
    end = np.cumsum(size)
    return pool[np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)]


class Memory:
    """The ids of pieces a worker has met, end to end in one array. When it is full, the half that was used most stays."""

    def __init__(self, width: np.dtype):
        self.pieces = pa.array([], pa.binary())
        self.ids = np.empty(0, width)  # those of the last batch's long pieces at the end
        self.start, self.size, self.uses = (np.empty(0, np.int64) for _ in range(3))

    def age(self) -> None:
        n = len(self.pieces)
        if n <= REMEMBERED:
            return
        most = np.sort(np.argpartition(-self.uses[:n], REMEMBERED // 2)[: REMEMBERED // 2])
        self.pieces = self.pieces.take(pa.array(most))
        self.ids, self.size = _gather(self.ids, self.start[most], self.size[most]), self.size[most]
        self.start, self.uses = np.cumsum(self.size) - self.size, self.uses[most] // 2

    def rows(self, pieces: pa.Array, learn) -> np.ndarray:
        """Where the ids of each of these different pieces are, until the next call; `learn` gives unknown pieces' ids and their numbers."""
        n = len(self.pieces)
        self.ids = self.ids[: self.start[n]] if len(self.start) > n else self.ids
        self.start, self.size, self.uses = self.start[:n], self.size[:n], self.uses[:n]
        rows = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy().astype(np.int64)
        unknown = np.flatnonzero(rows < 0)
        if len(unknown):
            long = pc.binary_length(pieces).to_numpy()[unknown] > _LONG
            unknown = np.concatenate([unknown[~long], unknown[long]])
            rows[unknown] = n + np.arange(len(unknown))
            new = pieces.take(pa.array(unknown))
            ids, size = learn(new.to_numpy(zero_copy_only=False).tolist())
            self.pieces = pa.concat_arrays([self.pieces, new[: len(new) - int(long.sum())]])
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, np.array(ids, self.ids.dtype)])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        return rows


class Encoder:
    """Token ids or counts of texts by a tokenizers file.

    `leading_space`: the space before a word belongs to its first token (byte-level
    vocabularies); otherwise spaces are dropped and letters lower-cased."""

    _open: dict = {}

    def __init__(self, path: str, leading_space: bool, counts_only: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.leading_space, self.counts_only = leading_space, counts_only
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.level = {i: level.pre_tokenize_str(chr(i))[0][0] for i in (0x20, *range(0xC0, 0x180))}  # the vocabulary's names of bytes
        self.memory = Memory(self.width)

    @classmethod
    def of(cls, path: str, leading_space: bool, counts_only: bool = False) -> Encoder:
        """The worker's own instance: its memory outlives a task."""
        key = (path, leading_space, counts_only)
        if key not in cls._open:
            cls._open[key] = cls(path, leading_space, counts_only)
        return cls._open[key]

    def _learn(self, pieces: list[bytes]) -> tuple[list[int], np.ndarray]:
        """Ids of all pieces, and how many each has. Letters are one word to the vocabulary's model; the rest goes
        through the whole tokenizer."""
        texts = ["" if p == _END else p.decode() for p in pieces]
        words = list(map(_WORD.fullmatch, texts))
        whole = iter(self.tokenizer.encode_batch_fast([t for t, w in zip(texts, words) if not w], add_special_tokens=False))
        ids, size, tokenize = [], np.empty(len(pieces), np.int64), self.model.tokenize
        for i, found in enumerate(words):
            if found:
                space, word = found.groups()
                if not self.leading_space:
                    space, word = "", word.lower()
                if not word.isascii():
                    word = word.translate(self.level)
                more = [t.id for t in tokenize(self.level[0x20] + word if space else word)]
            else:
                more = next(whole).ids
            ids += more
            size[i] = len(more)
        return ids, size

    @staticmethod
    def _cut(joined: bytes, forced: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Starts of the pieces of texts that `_END` surrounds, the places of `_END`, and whether any piece isn't a mere run.
        At `forced` are spaces of boundaries whose left side isn't here. A boundary's space belongs to the piece after it."""
        buf = np.frombuffer(joined, np.uint8)
        kind = _CLASS[buf]
        lead = np.flatnonzero((buf >= 0xC3) & (buf <= 0xC5))  # two bytes each: U+00C0 to U+017F
        if len(lead):
            code = buf[lead].astype(np.int32) << 8 | buf[lead + 1]
            lead = lead[(code != 0xC397) & (code != 0xC3B7) & (code != 0xC4B0)]  # ×, ÷, İ
            kind[lead] = kind[lead + 1] = _LETTER
        ends, spaces, lines = (np.flatnonzero(buf == b) for b in (_END[0], 0x20, 0x0A))
        safe = (kind >= _MARKED) & (kind <= _DIGIT)
        sure = safe[spaces - 1] & safe[spaces + 1]
        if len(forced):
            sure |= np.isin(spaces, forced)
        kind[spaces[~sure]] = _OTHER
        kind[lines[~(safe[lines - 1] & safe[lines + 1])]] = _OTHER
        cuts = spaces[sure]
        start = np.ones(len(buf), bool)
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start[cuts + 1] = False
        start[ends] = start[ends[:-1] + 1] = start[cuts] = True
        odd = np.flatnonzero(kind <= _MARKED)
        if len(odd):
            begin = np.unique(np.concatenate([cuts, ends, ends[:-1] + 1]))
            whole = np.unique(np.searchsorted(begin, odd, "right") - 1)
            for a, b in zip(begin[whole].tolist(), begin[whole + 1].tolist()):
                start[a + 1 : b] = False
        return np.flatnonzero(start), ends, len(odd) > 0

    def values(self, texts: list[str], continued: list[bool] | None = None) -> list:
        """Counts, or ids as little-endian bytes. `continued`: the text follows a safe
        boundary, whose space has been left off."""
        self.memory.age()
        raw = [t.encode() for t in texts]
        follows = np.array([bool(c and t) for c, t in zip(continued or repeat(False), raw)], bool)
        joined = b"".join(chain([_END], *((b" " if c else b"", t, _END) for c, t in zip(follows.tolist(), raw))))
        before = np.cumsum([0, *map(len, raw)])[:-1] + np.cumsum(follows) - follows + np.arange(len(raw)) + 1
        at, ends, odd = self._cut(joined, before[follows])
        cut = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(joined)).astype(np.int32)), pa.py_buffer(joined)])
        cut = cut.dictionary_encode()
        pieces, order = cut.dictionary, cut.indices.to_numpy()
        last = np.searchsorted(at, ends[1:])  # the piece at which each text ends
        if odd:  # what was left whole may have boundaries beside other scripts
            first, number, n, parts = np.arange(len(pieces)), np.ones(len(pieces), np.int64), len(pieces), []
            for i, piece in enumerate(pieces.to_numpy(zero_copy_only=False).tolist()):
                if piece.rfind(b" ") > 0:
                    found = BOUNDARY.split(piece.decode())
                    first[i], number[i] = n + len(parts), len(found)
                    parts += found
            if parts:
                last = np.cumsum(number[order])[last] - 1
                order = _gather(np.arange(n + len(parts)), first[order], number[order])
                kept = pa.concat_arrays([pieces, pa.array(parts, pa.binary())]).take(pa.array(order)).dictionary_encode()
                pieces, order = kept.dictionary, kept.indices.to_numpy()
        memory = self.memory
        rows = memory.rows(pieces, self._learn)
        memory.uses[rows] += np.bincount(order, minlength=len(rows))
        rows = rows[order]
        size = memory.size[rows]
        stops = np.cumsum(size)[last]
        if self.counts_only:
            return np.diff(stops, prepend=0).tolist()
        ids, stops = _gather(memory.ids, memory.start[rows], size).tobytes(), (stops * self.width.itemsize).tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]
