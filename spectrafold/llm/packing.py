"""Packing by bounded-space online best fit.

Every partition keeps a fixed number of open windows. A document's full windows leave at
once; its rest goes into the open window with the least room that still holds it, else
into a new one, else the fullest window is topped up by a cut and emitted. What is still
open at the end of a partition is merged there, and the one unfinished window of every
partition is merged with those of up to MERGE other partitions; the last rest of such a
group is cut into lengths that are powers of two, which need no padding.

Nulls: a null text is an empty one, which is the closing id alone; a null document id stays
null. Repeated rows are packed as often as they occur. Very long texts span many windows.
An empty table gives no rows. Other columns are not read, so their names cannot clash.
Memory: the open windows and one Arrow batch per task.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MERGE = 256
CACHED = 200_000
#: of byte-level pre-tokenizers
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECE = "start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ENCODERS: dict = {}


class _Odd(Exception):
    """A space before white space or at the end: the text can't be cut at its spaces."""


class _Known(dict):
    """ids of what follows a single space, with that space; bounded."""

    def __init__(self, encode, piece):
        self.encode, self.piece = encode, piece
        self.marks = {c: piece(c) for c in ",.;:!?"}

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace():
            raise _Odd
        if word[-1] in self.marks and word[:-1].isalpha():
            return self[word[:-1]] + self.marks[word[-1]]  # a mark after letters is a part of its own
        if len(self) > CACHED:
            self.clear()
        self[word] = ids = self.piece(" " + word) if word.isalpha() else self.encode(" " + word)
        return ids


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes.

    The pre-tokenizer never joins what stands before a single space and the non-space
    after it, so a text may be encoded word by word, and frequent words come from a
    bounded cache. Words that aren't there are cut by the pre-tokenizer's own pattern, and
    those parts are cached too. tests/llm compare all this with the tokenizer itself."""

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken

        model = json.loads(Path(path).read_text(encoding="utf-8"))
        points = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(p): p for p in points} | {chr(256 + k): p for k, p in enumerate(p for p in range(256) if p not in points)}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(chars[c] for c in w): i for w, i in model["model"]["vocab"].items() if w not in self.special}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.cut, self.parts, self.known = regex.compile(PATTERN).findall, {}, _Known(self.word, self.piece)

    def word(self, text: str) -> bytes:
        if any(t in text for t in self.special):
            return self.whole(text)
        if len(self.parts) > CACHED:
            self.parts.clear()
        got = []
        for p in self.cut(text):
            ids = self.parts.get(p)
            if ids is None:
                ids = self.parts[p] = self.piece(p)
            got.append(ids)
        return b"".join(got)

    def piece(self, part: str) -> bytes:
        return self._ids(self.bpe._encode_single_piece(part))

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return b"".join([x.to_bytes(4, "little") for x in ids])

    def whole(self, text: str) -> bytes:
        return self._ids(self.bpe.encode(text, allowed_special="all"))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for t in texts:
            try:
                first, *rest = (t or "").split(" ")
                out.append(self.word(first) + b"".join(map(self.known.__getitem__, rest)))
            except _Odd:
                out.append(self.whole(t))
        return out


def encoder(path: str) -> Encoder:
    return _ENCODERS.setdefault(path, None) or _ENCODERS.__setitem__(path, Encoder(path)) or _ENCODERS[path]


class Packer:
    """Bounded-space best fit over byte strings of 4-byte ids."""

    def __init__(self, window: int, open_windows: int, first_id: int):
        self.window, self.most, self.next, self.done = window, open_windows, first_id, []
        self.free: list[tuple[int, int]] = []  # room and key of the open windows, in order
        self.open: dict[int, list] = {}
        self.key = 0

    def emit(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids) // 4, ids, total, self.next, at))
            at += len(ids) // 4
        self.next += 1

    def add(self, doc, ids: bytes, start: int = 0, total: int | None = None) -> None:
        size, n = self.window, len(ids) // 4
        total, at = n if total is None else total, 0
        while n - at >= size:
            self.emit([(doc, start + at, ids[4 * at : 4 * (at + size)], total)])
            at += size
        while at < n:
            rest = n - at
            i = bisect.bisect_left(self.free, (rest, -1))
            if i < len(self.free):
                room, key = self.free.pop(i)
            elif len(self.open) < self.most:
                self.key += 1
                room, key = size, self.key
                self.open[key] = []
            else:
                room, key = self.free.pop(0)
            take = min(rest, room)
            self.open[key].append((doc, start + at, ids[4 * at : 4 * (at + take)], total))
            at += take
            if take == room:
                self.emit(self.open.pop(key))
            else:
                bisect.insort(self.free, (room - take, key))

    def merge(self) -> list:
        """Close all windows: fill them from one another; the pieces of the rest."""
        pieces = [p for k in sorted(self.open, key=lambda k: sum(len(p[2]) for p in self.open[k]), reverse=True) for p in self.open[k]]
        self.open, self.free = {}, []
        now, room = [], self.window
        for doc, start, ids, total in pieces:
            at, n = 0, len(ids) // 4
            while at < n:
                take = min(room, n - at)
                now.append((doc, start + at, ids[4 * at : 4 * (at + take)], total))
                at, room = at + take, room - take
                if not room:
                    self.emit(now)
                    now, room = [], self.window
        return now

    def powers(self, pieces: list) -> None:
        """Emit a rest of less than a window as windows whose lengths are powers of two."""
        left = sum(len(p[2]) for p in pieces) // 4
        sizes = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
        now, room = [], sizes.pop(0) if sizes else 0
        for doc, start, ids, total in pieces:
            at, n = 0, len(ids) // 4
            while at < n:
                take = min(room, n - at)
                now.append((doc, start + at, ids[4 * at : 4 * (at + take)], total))
                at, room = at + take, room - take
                if not room:
                    self.emit(now)
                    now, room = [], sizes.pop(0) if sizes else 0


def _rows(done: list, kind: pa.DataType, with_ids: bool, rest: int, more: pa.Schema) -> pa.RecordBatch:
    """rest: the partition whose unfinished window these are, -1 for finished ones."""
    cols = list(zip(*done)) if done else [[]] * 7
    keep = with_ids or rest >= 0
    arrays = [
        pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
        pa.array(cols[3] if keep else [None] * len(done), pa.binary()), pa.array([zlib.crc32(x) for x in cols[3]], pa.int64()),
        pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.int64()), pa.array([rest] * len(done), pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=more)


def _schema(name: str, kind: pa.DataType, rest: bool = True) -> pa.Schema:
    i = pa.int64()
    cols = [(name, kind), ("start", i), ("length", i), ("ids", pa.binary()), ("ids_crc32", i), ("doc_tokens", i), ("sequence_id", i), ("offset", i), ("rest", i)]
    return pa.schema(cols if rest else cols[:-1])


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, open_windows: int = 64, eos: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces of the packed documents: id_col, start, length, ids (little-endian unsigned
    32-bit, null without with_ids), ids_crc32, doc_tokens, sequence_id, offset. window is a
    power of two, so every sequence is full or has a power of two as its length."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    slim = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    spark_kind = slim.schema[0].dataType.simpleString()
    close = eos.to_bytes(4, "little")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        packer, kind = Packer(window, open_windows, part << 36), None
        for batch in batches:
            kind = batch.column(0).type
            for a in range(0, batch.num_rows, 512):
                some = batch.slice(a, 512)
                for doc, ids in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist())):
                    packer.add(doc, ids + close)
                if packer.done:
                    yield _rows(packer.done, kind, with_ids, -1, _schema(id_col, kind))
                    packer.done = []
        if kind is not None:
            rest = packer.merge()
            yield _rows(packer.done, kind, with_ids, -1, _schema(id_col, kind))
            yield _rows([(d, s, len(x) // 4, x, t, 0, k) for k, (d, s, x, t) in enumerate(rest)], kind, True, part, _schema(id_col, kind))

    def last(t: pa.Table) -> pa.Table:
        t = t.sort_by([("rest", "ascending"), ("offset", "ascending")])
        kind, group = t.column(0).type, t.column("rest")[0].as_py() // MERGE
        packer = Packer(window, 1, (1 << 62) | group << 20)
        packer.open[0] = list(zip(*(t.column(c).to_pylist() for c in (id_col, "start", "ids", "doc_tokens"))))
        packer.powers(packer.merge())
        return pa.Table.from_batches([_rows(packer.done, kind, with_ids, -1, _schema(id_col, kind))]).drop_columns(["rest"])

    made = materialize(slim.mapInArrow(first, f"`{id_col}` {spark_kind}, {_PIECE}, rest long"), "pack")
    merged = made.filter("rest >= 0").groupBy(F.floor(F.col("rest") / MERGE)).applyInArrow(last, f"`{id_col}` {spark_kind}, {_PIECE}")
    return made.filter("rest < 0").drop("rest").unionByName(merged)
