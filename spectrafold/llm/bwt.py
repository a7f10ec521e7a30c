"""Burrows-Wheeler transforms of string collections and their merge.

A shard is a list of byte strings. Its rotations (each string with its own end mark) are
sorted to a depth, which gives the shard's transform: the symbol before each rotation. Shards
are merged by refining their interleave: sorting the current interleave stably by the symbols
of the transforms in it gives the interleave that is right to one more symbol, so after
`depth` rounds it is right to that depth, without comparing any suffix again. The block
borders that appear in round h are where the common prefix is h - 1, which is the LCP array,
and runs without borders are the repeated intervals. With a step of 2 a symbol is the two bytes
before a rotation: half the rounds, and common prefixes are known to a multiple of 2.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

END = 0xFF


@dataclass
class Shard:
    """order: rotations by content to a depth, as positions in the concatenation with end
    marks; bwt: the symbol before each."""

    order: np.ndarray
    bwt: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray


def build(strings: list[bytes], depth: int, step: int = 1) -> Shard:
    lengths = np.array([len(s) + 1 for s in strings], np.int64)
    text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    begin, size = np.repeat(starts, lengths), np.repeat(lengths, lengths)
    off = np.arange(len(text)) - begin

    def ahead(k: int) -> np.ndarray:
        return begin + (off + k) % size

    known = min(8, depth)
    rank = text.astype(np.uint64)
    for k in range(1, known):
        rank = rank << np.uint64(8) | text[ahead(k)]
    rank = np.unique(rank, return_inverse=True)[1]
    while known < depth:
        by = min(known, depth - known)
        _, rank = np.unique(rank * (int(rank.max()) + 1 if len(rank) else 1) + rank[ahead(by)], return_inverse=True)
        known += by
    order = np.argsort(rank, kind="stable")
    before = text[begin + (off - 1) % size]
    if step == 2:
        before = text[begin + (off - 2) % size].astype(np.uint16) << np.uint16(8) | before
    return Shard(order, before[order], starts, lengths)


def merge(shards: list[Shard], depth: int, step: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, position in its concatenation, LCP with the one before, at most depth) of all
    rotations in merged order. depth is a multiple of step, the step of the shards."""
    sizes = [len(s.order) for s in shards]
    z = np.repeat(np.arange(len(shards)), sizes).astype(np.uint8 if len(shards) < 256 else np.uint16)
    symbols = np.concatenate([s.bwt for s in shards])
    block = np.zeros(len(z), np.int32)
    lcp = np.full(len(z), depth, np.int16)
    ch = np.empty(len(z), symbols.dtype)
    border = np.empty(len(z), bool)
    for h in range(step, depth + 1, step):
        ch[np.argsort(z, kind="stable")] = symbols
        to = np.argsort(ch, kind="stable")
        z, c, b = z[to], ch[to], block[to]
        border[:1] = True
        np.not_equal(c[1:], c[:-1], out=border[1:])
        border[1:] |= b[1:] != b[:-1]
        lcp[border & (lcp == depth)] = h - step
        block = np.cumsum(border, dtype=np.int32)
    at = np.empty(len(z), np.int64)
    at[np.argsort(z, kind="stable")] = np.concatenate([s.order for s in shards])
    return z, at, lcp
