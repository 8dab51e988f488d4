"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

A sequence of pieces is the merge encoding of its text exactly if every two adjacent
pieces survive being merged again from their characters: the merges inside a window
happen in the same order in the window alone as in the whole text, up to the first merge
that crosses a boundary, and that one would show up in the pair as well. So the encoder
walks over the text with the longest piece that an Aho-Corasick automaton finds at each
position, keeps it if it is compatible with its neighbour, else tries the next shorter
one, and steps back when none is left. Exactly one encoding of a prefix ends at any
position; a position that failed once therefore never succeeds, and a bitfield holds these.
The first walk, without steps back, takes the automaton's matches of the whole chunk; the
steps go on from the first of them that isn't compatible, and look up only places they reach.

Pieces that hold a space mark do so at their start only (checked when the model is
loaded; otherwise a text is one chunk), so no merge crosses from a character into the
following space mark: chunks between such places are encoded on their own and memoised.

Defined results: a null text counts as empty; an empty text is the begin and end id; a
repeated row gives the same result twice; ids are of any type; extra columns are ignored;
very long texts and chunks take time and memory in proportion to their length, and what a
worker remembers is bounded in bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import only, remember, rest

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Bytes of each memo table of one Python worker, by an estimate from above; a full table is emptied. Longer chunks aren't remembered.
MEMO_BYTES, MEMO_CHUNK = 128_000_000, 400
_REPLACEMENT = "�"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if byte < 0x80:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            if key & 7 == 2:
                length, at = varint(at)
            else:
                length = {1: 8, 5: 4}[key & 7]
            value, at = data[at : at + length], at + length
        yield key >> 3, value


@dataclass(frozen=True)
class PieceModel:
    """What encoding needs of a model file."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    dummy_prefix: bool
    bos: int
    eos: int

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        pieces, scores, kinds, trainer, normalizer = [], [], [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        problems = {
            "a merge-type (BPE) model": trainer.get(3, 1) == 2,
            "byte fallback": bool(trainer.get(35, 0)),
            "white space as prefix": not trainer.get(24, 0),
            "the identity normalizer": not normalizer.get(2),
            "kept white space": not normalizer.get(4, 1),
            "escaped white space": bool(normalizer.get(5, 1)),
            "no user-defined or unused pieces": not {USER_DEFINED, UNUSED} & set(kinds),
        }
        if missing := [k for k, fine in problems.items() if not fine]:
            raise ValueError(f"the tokenizer needs: {', '.join(missing)}")
        control = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == CONTROL}
        return cls(tuple(pieces), tuple(scores), tuple(kinds), bool(normalizer.get(3, 1)), control["<s>"], control["</s>"])


class _Memo(dict):
    """A dictionary that computes what it lacks and is emptied when full; what has more characters than ``longest`` is computed anew."""

    def __init__(self, compute, size, longest: int = MEMO_CHUNK, limit: int = MEMO_BYTES):
        self.compute, self.size, self.longest, self.limit, self.used = compute, size, longest, limit, 0

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) > self.longest:
            return value
        self.used += self.size(key, value)
        if self.used > self.limit:
            self.forget()
            self.used = self.size(key, value)
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.used = 0


def _word_size(word: str, packed: bytes | None) -> int:
    """Bytes of a remembered word: both objects, rounded up, and its place in the table, also while that grows."""
    return 120 + sys.getsizeof(word) + sys.getsizeof(packed)


def _chunk_size(chunk: str, both: tuple[bytes, str]) -> int:
    return 330 + 4 * len(chunk) + len(both[0]) + 4 * len(both[1])


class _Row(dict):
    """Of one piece: the row of each piece that may follow it, None for one that may not."""

    __slots__ = ("pairs", "left")

    def __init__(self, pairs: _Pairs, left: str):
        self.pairs, self.left = pairs, left

    def __missing__(self, right: str) -> _Row | None:
        return self.pairs.find(self, right)


class _Pairs:
    """Which pieces may follow which, in rows that are computed as needed and emptied when full."""

    def __init__(self, fits, limit: int = MEMO_BYTES):
        self.fits, self.limit, self.used, self.rows = fits, limit, 0, {}

    def row(self, left: str) -> _Row:
        found = self.rows.get(left)
        if found is None:
            self._count(550 + 4 * len(left))  # a dictionary with its first places, its own place, a string
            found = self.rows[left] = _Row(self, left)
        return found

    def find(self, row: _Row, right: str) -> _Row | None:
        after = self.row(right) if self.fits((row.left, right)) else None
        self._count(180 + 4 * len(right))
        row[right] = after
        return after

    def __getitem__(self, pair: tuple[str, str]) -> bool:
        return self.row(pair[0])[pair[1]] is not None

    def _count(self, size: int) -> None:
        if self.used + size > self.limit:
            self.forget()
        self.used += size

    def forget(self) -> None:
        for row in self.rows.values():
            row.clear()  # rows hold each other
        self.rows.clear()
        self.used = 0


class Codec:
    """Encoder and decoder for one model; holds its memo tables."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == NORMAL}
        self.score = {p: model.scores[i] for p, i in self.ids.items()}
        self.byte_ids = [model.pieces.index(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.chunked = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.longest = max(map(len, self.ids), default=1)
        #: Of each beginning of a piece, the longest piece that it begins with, if any; of each piece, the next shorter one at its place.
        self.deepest: dict[str, str | None] = {}
        for piece in self.ids:
            found = None
            for n in range(1, len(piece) + 1):
                begun = piece[:n]
                self.deepest[begun] = found = begun if begun in self.ids else found
        self.shorter = {p: self.deepest[p[:-1]] or p[0] for p in self.ids if len(p) > 1}  # a character that isn't a piece is a symbol too
        #: The text of each id that has one of its own.
        self.shown = [None if k in (UNKNOWN, CONTROL, BYTE) else p.replace(MARK, " ") for p, k in zip(model.pieces, model.kinds)]
        self.compatible = _Pairs(self._compatible)
        #: Of a chunk: (ids packed little-endian, the text that they decode to).
        self.chunks = _Memo(lambda chunk: self._both(self.encode_chunk(chunk)), _chunk_size)
        #: Of a word that follows one space: its packed ids if they decode to the space and the word, else None.
        self.words = _Memo(self._word, _word_size)

    def forget(self) -> None:
        for memo in (self.chunks, self.words, self.compatible):
            memo.forget()

    def merge(self, text: str) -> list[str]:
        """The merge rule itself: the best-scored adjacent pair that is a piece, the leftmost of equals, again and again."""
        symbols, score = list(text), self.score
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _compatible(self, pair: tuple[str, str]) -> bool:
        left, right = pair
        return self.merge(left + right) == ([left, right] if left else [right])

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a text without dummy prefix, begin and end."""
        first = [piece for _, piece in self.automaton.iter_long(chunk)]
        if sum(map(len, first)) != len(chunk):
            return self._backtrack(chunk)
        row = self.compatible.row("")
        for n, piece in enumerate(first):
            row = row[piece]
            if row is None:
                path = self._steps(chunk, first[:n], self.shorter.get(piece))
                return self._ids(path) if path else self._backtrack(chunk)
        return [self.ids[piece] for piece in first]  # no step back was needed

    def _backtrack(self, chunk: str) -> list[int]:
        return self._ids(self._steps(chunk, [], self._longest(chunk, 0))) if chunk else []

    def _longest(self, chunk: str, at: int) -> str:
        """The longest piece that starts at a place, or its character."""
        ahead = chunk[at : at + self.longest]
        return self.deepest.get(ahead[: self.automaton.longest_prefix(ahead)]) or chunk[at]

    def _steps(self, chunk: str, path: list[str], piece: str | None) -> list[str]:
        """The pieces of a chunk, from a path of compatible ones and the longest piece to try after it; none if no way goes on from there."""
        size, longest, shorter, deepest, walk = len(chunk), self.longest, self.shorter, self.deepest, self.automaton.longest_prefix
        failed = bytearray((size >> 3) + 1)
        at, row = sum(map(len, path)), self.compatible.row(path[-1] if path else "")
        while True:
            while piece is not None:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (after := row[piece]) is not None:
                    break
                piece = shorter.get(piece)
            if piece is not None:
                path.append(piece)
                if end == size:
                    return path
                at, row = end, after
                ahead = chunk[at : at + longest]
                piece = deepest.get(ahead[: walk(ahead)]) or chunk[at]
            elif path:
                failed[at >> 3] |= 1 << (at & 7)
                piece = path.pop()
                at -= len(piece)
                row, piece = self.compatible.row(path[-1] if path else ""), shorter.get(piece)
            else:
                return path

    def _ids(self, path: list[str]) -> list[int]:
        try:
            return [self.ids[piece] for piece in path]
        except KeyError:  # a character that isn't a piece is its bytes
            return [i for piece in path for i in ([self.ids[piece]] if piece in self.ids else [self.byte_ids[b] for b in piece.encode()])]

    def _text(self, ids: list[int]) -> str:
        """What ids decode to, the dummy prefix included."""
        try:
            return "".join([self.shown[i] for i in ids])
        except TypeError:  # byte pieces
            return self.decode(ids, False)

    def _both(self, ids: list[int]) -> tuple[bytes, str]:
        return struct.pack(f"<{len(ids)}I", *ids), self._text(ids)

    def _word(self, word: str) -> bytes | None:
        packed, decoded = self._both(self.encode_chunk(MARK + word))
        return packed if decoded == " " + word else None

    def _whole(self, text: str) -> tuple[bytes, str]:
        """The packed ids of a text, without begin and end, and what they decode to.

        No run of byte pieces crosses from one chunk into the next, which starts with a
        space mark; so the chunks' decoded texts joined are the text that all ids decode to.
        """
        if not text:
            return b"", ""
        if self.chunked and self.model.dummy_prefix and MARK not in text:
            words = text.split(" ")
            if "" not in words:
                memo = self.words
                try:
                    return b"".join([memo[w] for w in words]), text
                except TypeError:  # a word doesn't decode to itself
                    pass
        text = (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)
        chunks = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", text) if self.chunked else [text]
        both = [self.chunks[c] for c in chunks]
        decoded = "".join([d for _, d in both])
        if self.model.dummy_prefix and decoded[:1] == " ":
            decoded = decoded[1:]
        return b"".join([p for p, _ in both]), decoded

    def encode_decode(self, text: str) -> tuple[bytes, str]:
        """All ids of a text with begin and end, packed, and the text that they decode to."""
        packed, decoded = self._whole(text)
        return struct.pack("<I", self.model.bos) + packed + struct.pack("<I", self.model.eos), decoded

    def encode(self, text: str) -> list[int]:
        """All ids of a text with begin and end."""
        packed, _ = self._whole(text)
        return [self.model.bos, *struct.unpack(f"<{len(packed) // 4}I", packed), self.model.eos]

    def decode(self, ids, strip: bool = True) -> str:
        """The text of ids: pieces joined, runs of byte pieces read as UTF-8, the dummy prefix dropped."""
        out: list[str] = []
        run = bytearray()
        strip = strip and self.model.dummy_prefix
        for i in [*ids, None]:
            if i is not None and (byte := self.bytes_of.get(i)) is not None:
                run.append(byte)
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run = bytearray()
            if i is None or self.model.kinds[i] == CONTROL:
                continue
            piece = " ⁇ " if self.model.kinds[i] == UNKNOWN else self.model.pieces[i].replace(MARK, " ")
            out.append(piece[1:] if strip and not out and self.model.pieces[i].startswith(MARK) else piece)
        return "".join(out)


def _utf8(data: bytes) -> str:
    """Each byte that starts no valid character becomes one replacement character."""
    out, at = [], 0
    while at < len(data):
        size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        try:
            out.append(data[at : at + size].decode())
            at += size
        except UnicodeDecodeError:
            out.append(_REPLACEMENT)
            at += 1
    return "".join(out)


_CODECS: dict[bytes, Codec] = {}


def codec(model: bytes) -> Codec:
    """The worker's codec for a model file's bytes; built once a process."""
    key = hashlib.sha256(model).digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(PieceModel.parse(model))
        remember("sentencepiece", lambda: [c.forget() for c in _CODECS.values()])
    return _CODECS[key]


def encode_decode(docs: DataFrame, model_path: str, *, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Encodes and decodes every text.

    Returns ``key``, n_tokens, and ids (int array) and decoded, or with ``digests`` their
    SHA-256 digests, ids as little-endian unsigned 32-bit integers. A narrow step: no
    shuffle, memory bounded by a batch of rows and the memo tables. ``model_path`` is
    read on the driver and its bytes broadcast (half a megabyte for 32,000 pieces).
    """
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    PieceModel.parse(model.value)
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    names = ["k", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["k", "n_tokens", "ids", "decoded"]

    def run(batches):
        own = codec(model.value)
        only("sentencepiece")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                both = [own.encode_decode(value or "") for value in part.column(1).to_pylist()]
                packed_ids, texts = [p for p, _ in both], [t for _, t in both]
                n = [len(p) // 4 for p in packed_ids]
                if digests:
                    ids = pa.array([hashlib.sha256(p).hexdigest() for p in packed_ids], pa.string())
                    texts = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
                else:
                    flat = np.frombuffer(b"".join(packed_ids), "<i4")
                    ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), ids, pa.array(texts, pa.string())], names=names)
        rest("sentencepiece")

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, n_tokens bigint, {tail}").withColumnRenamed("k", key)
