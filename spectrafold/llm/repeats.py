"""Exact repeats of WIDTH bytes across documents, by merged Burrows-Wheeler transforms.

Every byte covered by a WIDTH-byte string that also starts in a document with a smaller id
goes. A single transform of a corpus would be one task's work, so what can't repeat and what
repeats as a whole is set aside first, both exactly, and only the rest is transformed:

1. Anchors. Of every WIDTH-byte window the GRAM-byte string with the smallest hash is an
   anchor, so equal windows have equal anchors at equal places. A text has one in 17 bytes.
2. Each anchor goes, in packed blocks, to a bucket by its hash with a hash of its context,
   the bytes of all windows around it. Equal contexts of a block are sent once, with the
   smallest id (the others are known to repeat), so a passage in a third of all documents is
   sent once a block. A bucket answers: the context as a whole also stands in a smaller
   document; or this text owns the first of a context that goes on like another for NEAR bytes to
   the left or to the right, as a match of WIDTH bytes must. An anchor that FREQUENT documents of
   a block hold goes by its contexts instead, to buckets of their own, which answer if a context
   repeats as a whole and have both sides of its first one sent; its bucket learns so by a
   notice and passes on what other blocks sent there, so it holds less than FREQUENT documents of
   each block. Answers go back in one row for each bucket and range of documents, and ranges
   gather them.
3. Owned contexts are cut out once for each such side: the bytes of the windows that reach NEAR
   bytes or more to it. They meet in buckets by their key, the anchor and the NEAR bytes of the
   side, which all of these windows hold, so an anchor with many contexts is in many buckets. A
   bucket is worked through in parts of whole keys. Equal strings, compared byte by byte, count
   once; the different ones of a key are dealt to shards with a transform each, the shards are merged by
   interleave refinement, and the intervals with a common prefix of WIDTH bytes give the
   smallest id of each window.
4. The spans of a document are united and cut from its bytes.

Only spans are kept between the steps; texts are shuffled where contexts are cut out and where
spans are, and scratch tables go when they are read. Hashes of contexts have 48 bits besides the 32 and more of their anchor's; only if both agree
for different contexts would there be a false repeat. Other hashes only group.

Nulls: a null text is empty; a document with a null id is left whole and makes no other one
shorter. Repeated rows get the same result each; rows of one id with different texts are
separate texts that don't shorten one another. Texts shorter than WIDTH bytes stay. Very long
texts are read in segments. Empty tables give no rows. Other columns are not read by report() and
pass through remove() as they are, whatever their names. Memory: an Arrow batch and its anchors,
or a bucket, or a part of PART_BYTES of the strings that are merged; buckets are as many as the
input asks for. A key of 34 bytes that very many documents go on from differently is one part of
step 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt
from .common import drop, materialize, packed, small_batches, trim, unpacked

WIDTH, GRAM = 50, 18
SIDE = WIDTH - GRAM
NEAR = SIDE // 2
BUCKET_BYTES, BLOCK_BYTES, PART_BYTES = 3_000_000, 5_000_000, 1_500_000
FREQUENT = 64
SEGMENT = 1 << 18
_TABLE = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = [np.uint64(int(x) * 2 + 1) for x in np.random.default_rng(12).integers(2**60, 2**62, 8)]


def _slide(x: np.ndarray, n: int, best) -> np.ndarray:
    """best over each n values in a row, by doubling."""
    k = 1
    while 2 * k <= n:
        x = best(x[:-k], x[k:])
        k *= 2
    return best(x[: len(x) - (n - k)], x[n - k :]) if n > k else x


def anchors(text: bytes) -> tuple[np.ndarray, ...]:
    """Positions, hashes, context hashes and hashes of the 16 bytes to the left and to the right
    (0 where there are fewer) of a text's anchors."""
    parts = [_segment(text, s, min(s + SEGMENT, len(text) - WIDTH + 1)) for s in range(0, len(text) - WIDTH + 1, SEGMENT)]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint16), np.empty(0, np.uint16)
    cols = [np.concatenate(x) for x in zip(*parts)]
    if len(parts) > 1:
        first = np.unique(cols[0], return_index=True)[1]
        cols = [c[first] for c in cols]
    return tuple(cols)


def _segment(text: bytes, start: int, stop: int) -> tuple[np.ndarray, ...]:
    """Anchors of the windows that start in [start, stop)."""
    left = max(0, start - SIDE)
    b = np.frombuffer(text, np.uint8)[left : stop + WIDTH + SIDE]
    h1 = _TABLE[b]
    h2 = h1[:-1] * _P[0] + h1[1:]
    h4 = h2[:-2] * _P[1] + h2[2:]
    h8 = h4[:-4] * _P[2] + h4[4:]
    h16 = h8[:-8] * _P[3] + h8[8:]
    a, z = start - left, stop - left
    g = h16[a : z + SIDE] * _P[4] + h2[a + 16 : z + SIDE + 16]  # the grams of the windows
    low = _slide(g, SIDE + 1, np.minimum)
    pad = np.zeros(SIDE, np.uint64)
    top = _slide(np.concatenate([pad, low, pad]), SIDE + 1, np.maximum)
    at = np.flatnonzero(g == top)
    pos = at + a
    ctx = np.empty(len(at), np.uint64)
    whole = (pos >= SIDE) & (pos + GRAM + SIDE <= len(b)) & (pos + left >= SIDE)
    p = pos[whole] - SIDE
    acc = h16[p]
    for k in (16, 32, 48, 64):
        acc = acc * _P[5] + h16[p + k]
    acc = acc * _P[6] + h2[p + 80]
    ctx[whole] = acc ^ (acc >> np.uint64(29))
    for i in np.flatnonzero(~whole):
        s = int(pos[i]) + left
        before = min(s, SIDE)
        ctx[i] = xxhash.xxh64_intdigest(text[s - before : s + GRAM + SIDE], seed=before + 1)
    sides = []
    for p in (pos - 16, pos + GRAM):
        there = (p >= 0) & (p + 16 <= len(b))
        side = np.zeros(len(pos), np.uint16)
        x = h16[p[there]]
        side[there] = (x ^ (x >> np.uint64(32))) % np.uint64(65535) + np.uint64(1)
        sides.append(side)
    return pos + left, g[at], ctx, *sides


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


_SENT = "bucket int, a binary, ctx binary, sides binary, doc binary, pos binary, ids binary, ts binary"
_REPLY = "id long, t long, marks binary"


def _sent(rows: list[tuple]) -> pa.Table:
    names = [c.split()[0] for c in _SENT.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 8, (pa.int32(), *[pa.binary()] * 7))], names=names)


def _places(bucket: np.ndarray, h: np.ndarray, ctx: np.ndarray, sides: list[np.ndarray], doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, ts: np.ndarray) -> Iterator[tuple]:
    """Rows of _SENT with the places of anchors by bucket; doc counts in ids and ts."""
    # places beyond 64 KiB go apart, so that the others need two bytes each
    group = bucket.astype(np.int64) * 2 + (pos >= 1 << 16)
    order = np.argsort(group, kind="stable")
    group = group[order]
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.empty(0, np.int64)
    for i, j in zip(start.tolist(), [*start[1:].tolist(), len(group)]):
        for k in range(i, j, 60_000):
            at = order[k : min(j, k + 60_000)]
            own = doc[at]
            new = np.concatenate([[True], own[1:] != own[:-1]])
            used, idx = own[new], np.cumsum(new) - 1  # documents by run
            wide = "<u2" if group[i] % 2 == 0 else "<u4" if pos[at].max() < 2**32 else "<u8"
            both = b"".join(x[at].astype("<u2").tobytes() for x in sides)
            yield int(group[i]) // 2, h[at].astype("<u4").tobytes(), _six(ctx[at]), both, idx.astype("<u2").tobytes(), pos[at].astype(wide).tobytes(), ids[used].astype("<i8").tobytes(), ts[used].astype("<i8").tobytes()


def _read(t: pa.Table) -> tuple:
    """What _places() wrote: anchors, contexts, sides, documents, positions, ids, texts."""
    cols = {n: t.column(n).to_pylist() for n in ("a", "ctx", "sides", "doc", "pos", "ids", "ts")}
    ids, ts = (np.frombuffer(b"".join(cols[c]), "<i8") for c in ("ids", "ts"))
    a, ctx = np.frombuffer(b"".join(cols["a"]), "<u4").astype(np.uint64), _unsix(b"".join(cols["ctx"]))
    sides = [np.concatenate([np.frombuffer(x, "<u2").reshape(2, -1)[k] for x in cols["sides"]]).astype(np.uint64) for k in (0, 1)]
    base = np.concatenate([[0], np.cumsum([len(x) // 8 for x in cols["ids"]])])
    doc = np.concatenate([np.frombuffer(x, "<u2").astype(np.int64) + base[k] for k, x in enumerate(cols["doc"])])
    pos = np.concatenate([np.frombuffer(x, f"<u{2 * len(x) // len(cols['doc'][k])}").astype(np.int64) for k, x in enumerate(cols["pos"])])
    return a, ctx, sides, doc, pos, ids, ts


def _spread(bucket: np.ndarray, h: np.ndarray, ctx: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket, from `buckets` on, of a context whose anchor is frequent."""
    x = ((bucket.astype(np.uint64) << np.uint64(32) | h & np.uint64(2**32 - 1)) * _P[2] ^ ctx & np.uint64(2**48 - 1)) * _P[3]
    x = (x ^ (x >> np.uint64(29))) * _P[1]
    return (np.uint64(buckets) + (((x >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32))).astype(np.int64)


def _frequent(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which places have an anchor that FREQUENT documents or more of the block send."""
    cell = (h & np.uint64((1 << 20) - 1)).astype(np.int64)
    at = np.flatnonzero(np.bincount(cell, minlength=1)[cell] >= FREQUENT)  # few; counted exactly below
    _, each = np.unique(h[at], return_inverse=True)
    pair = np.unique(each.astype(np.int64) << 32 | doc[at])
    out = np.zeros(len(h), bool)
    out[at] = (np.bincount(pair >> 32, minlength=1) >= FREQUENT)[each]
    return out


def _ranges(ids: np.ndarray, ts: np.ndarray, n: int) -> np.ndarray:
    """The range of documents, of n, that each belongs to."""
    h = (ids.astype(np.uint64) * _P[0] ^ ts.astype(np.uint64)) * _P[1]
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _by_document(ids: np.ndarray, ts: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, ...]:
    """ids, ts, first marks of the documents, and all marks in order, each once."""
    order = np.lexsort((marks, ts, ids))
    ids, ts, marks = ids[order], ts[order], marks[order]
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (ts[1:] != ts[:-1])])[: len(ids)]
    keep = new.copy()
    keep[1:] |= marks[1:] != marks[:-1]
    first = np.flatnonzero(new[keep])
    return ids[new], ts[new], first, marks[keep]


def _marks(ids: np.ndarray, ts: np.ndarray, pos: np.ndarray, kind: np.ndarray, ranges: int) -> pa.Table:
    """Answers as rows of _SENT, with the bucket -1 - range of documents: documents, the number
    of their marks in doc, and marks in a, each a position times four plus kind (0: the whole
    context repeats, 1: send its left side, 2: its right one, 3: both)."""
    ids, ts, first, marks = _by_document(ids, ts, pos.astype("<u8") * np.uint64(4) + kind.astype("<u8"))
    size = np.diff(np.append(first, len(marks)))
    r = _ranges(ids, ts, ranges)
    order = np.argsort(r, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], r[order][1:] != r[order][:-1]])) if len(r) else np.empty(0, np.int64)
    rows = []
    for i, j in zip(at.tolist(), [*at[1:].tolist(), len(r)]):
        own = order[i:j]
        blob = b"".join(marks[first[k] : first[k] + size[k]].tobytes() for k in own.tolist())
        rows.append((-1 - int(r[own[0]]), blob, b"", b"", size[own].astype("<u4").tobytes(), b"", ids[own].astype("<i8").tobytes(), ts[own].astype("<i8").tobytes()))
    return _sent(rows)


def _gather(t: pa.Table) -> pa.Table:
    """A row for each document of a range, with all its marks."""
    ids, ts, size, marks = (np.frombuffer(b"".join(t.column(c).to_pylist()), k) for c, k in (("ids", "<i8"), ("ts", "<i8"), ("doc", "<u4"), ("a", "<u8")))
    ids, ts, first, marks = _by_document(np.repeat(ids, size), np.repeat(ts, size), marks)
    ends = [*first[1:].tolist(), len(marks)]
    return pa.table([pa.array(ids, pa.int64()), pa.array(ts, pa.int64()), pa.array([marks[i:j].tobytes() for i, j in zip(first.tolist(), ends)], pa.binary())], names=["id", "t", "marks"])


def _send(texts: DataFrame, buckets: int) -> DataFrame:
    """Blocks of anchors by bucket. Buckets below 0 hold ready answers. An anchor that is frequent
    in a block goes by its contexts to buckets from `buckets` on, and its own bucket gets a notice,
    a row without contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                end = int(np.searchsorted(size, BLOCK_BYTES + (size[lo - 1] if lo else 0), "right"))
                end = min(max(end, lo + 1), lo + 30_000)
                yield from block(batch.slice(lo, end - lo))
                lo = end
                trim()

    def block(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, ts = b.column(0).to_numpy(), b.column(1).to_numpy()
        got, seen = [], set()
        for k, x in enumerate(b.column(2)):
            if (who := (ids[k], ts[k])) in seen:
                continue  # a repeated row
            seen.add(who)
            own = anchors(x.as_py())
            if len(own[0]):
                got.append((np.full(len(own[0]), k, np.uint16), *own))
        if not got:
            return
        doc, pos, h, ctx, left, right = map(np.concatenate, zip(*got))
        del got
        h ^= h >> np.uint64(31)
        h *= _P[7]  # the smallest of many hashes is small, and its upper bits choose the bucket
        h ^= h >> np.uint64(31)
        bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        both = (h * _P[6]) ^ ctx
        order = np.lexsort((ids[doc], both))
        same = np.concatenate([[False], both[order][1:] == both[order][:-1]])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        least = ids[doc][order][first]
        known = np.zeros(len(doc), bool)
        known[order] = least < ids[doc][order]
        yield from _marks(ids[doc[known]], ts[doc[known]], pos[known], np.zeros(int(known.sum()), np.uint8), buckets).to_batches()
        # contexts that repeat within one document are sent for each place, for their replies
        h, ctx, doc, pos, left, right, bucket = (x[~known] for x in (h, ctx, doc, pos, left, right, bucket.astype(np.int64)))
        frequent = _frequent(h, doc)
        told = np.unique(h[frequent])
        own = (((told >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        bucket[frequent] = _spread(bucket[frequent], h[frequent], ctx[frequent], buckets)
        rows = [(k, told[own == k].astype("<u4").tobytes(), *[b""] * 6) for k in np.unique(own).tolist()]
        yield from _sent([*rows, *_places(bucket, h, ctx, [left, right], doc, pos, ids, ts)]).to_batches()

    return texts.mapInArrow(run, _SENT)


def _answer(buckets: int):
    """What a bucket's anchors learn, as answers. Places of an anchor that is frequent in any
    block go on to the buckets of its contexts, where those of such blocks already are."""

    def run(t: pa.Table) -> pa.Table:
        trim()
        if (bucket := t.column("bucket")[0].as_py()) >= buckets:
            return t
        if bucket < 0:
            ids, ts, size, marks = (b"".join(t.column(c).to_pylist()) for c in ("ids", "ts", "doc", "a"))
            return _sent([(bucket, marks, b"", b"", size, b"", ids, ts)])
        told = pc.equal(pc.binary_length(t.column("ctx")), 0)
        frequent = np.frombuffer(b"".join(t.filter(told).column("a").to_pylist()), "<u4")
        if not len(t := t.filter(pc.invert(told))):
            return _sent([])
        a, ctx, sides, doc, pos, ids, ts = _read(t)
        late = np.isin(a, np.unique(frequent).astype(np.uint64))
        to = _spread(np.full(int(late.sum()), bucket), a[late], ctx[late], buckets)
        rows = list(_places(to, a[late], ctx[late], [x[late] for x in sides], doc[late], pos[late], ids, ts))
        a, ctx, doc, pos, sides = a[~late], ctx[~late], doc[~late], pos[~late], [x[~late] for x in sides]
        answers = first_places(a, ctx, sides, doc, pos, ids, ts) if len(a) else _sent([])
        return pa.concat_tables([answers, _sent(rows)])

    def first_places(a: np.ndarray, ctx: np.ndarray, sides: list[np.ndarray], doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, ts: np.ndarray) -> pa.Table:
        own = ids[doc]
        # anchors of one id only can't repeat across documents
        order = np.argsort(a, kind="stable")
        new = np.concatenate([[True], a[order][1:] != a[order][:-1]])
        group = np.flatnonzero(new)
        lo, hi = np.minimum.reduceat(own[order], group), np.maximum.reduceat(own[order], group)
        many = np.repeat(lo != hi, np.diff(np.append(group, len(order))))
        keep = order[many]
        a, ctx, doc, pos, own = a[keep], ctx[keep], doc[keep], pos[keep], own[keep]
        sides = [x[keep] for x in sides]
        if not len(a):
            return _marks(own, own, pos, np.zeros(0, np.uint8), buckets)
        order = np.lexsort((pos, own, ctx, a))
        a, ctx, doc, pos, own = a[order], ctx[order], doc[order], pos[order], own[order]
        sides = [x[order] for x in sides]
        cnew = np.concatenate([[True], (a[1:] != a[:-1]) | (ctx[1:] != ctx[:-1])])
        first = np.maximum.accumulate(np.where(cnew, np.arange(len(a)), 0))
        # on which sides does the context go on like another one of a different document?
        kind = np.zeros(len(a), np.uint8)
        for bit, side in enumerate(sides):
            by = np.argsort((a << np.uint64(16)) | side, kind="stable")
            key = (a[by] << np.uint64(16)) | side[by]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            apart = (np.minimum.reduceat(ctx[by], start) != np.maximum.reduceat(ctx[by], start)) & (np.minimum.reduceat(own[by], start) != np.maximum.reduceat(own[by], start)) & (side[by][start] > 0)
            kind[by] |= np.repeat(apart.astype(np.uint8) << bit, np.diff(np.append(start, len(by))))
        repeats = own > own[first]
        kind[repeats] = 0
        at = np.flatnonzero(repeats | (kind > 0))  # every place of the smallest document with this context
        return _marks(ids[doc[at]], ts[doc[at]], pos[at], kind[at], buckets)

    return run


def _answer_frequent(buckets: int):
    """Answers of the contexts whose anchors are frequent: which repeat as a whole. The sides of
    the first of each are sent without being compared."""

    def run(t: pa.Table) -> pa.Table:
        trim()
        a, ctx, sides, doc, pos, ids, ts = _read(t)
        own = ids[doc]
        order = np.lexsort((pos, own, ctx, a))
        a, ctx, doc, pos, own = a[order], ctx[order], doc[order], pos[order], own[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (ctx[1:] != ctx[:-1])])
        first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
        repeats = own > own[first]
        kind = np.where(repeats, 0, (sides[0][order] > 0) + 2 * (sides[1][order] > 0)).astype(np.uint8)
        at = np.flatnonzero(repeats | (kind > 0))
        return _marks(ids[doc[at]], ts[doc[at]], pos[at], kind[at], buckets)

    return run


_CUT = "bucket int, id long, t long, marks binary, parts binary, sizes binary, keys binary"


def _contexts(active: DataFrame, buckets: int) -> DataFrame:
    """From id, t, text, marks: a row with the spans of each document, and rows with the sides
    of contexts that it sends to each bucket: id, t and place of each, its bytes, their number and
    a hash of the key. Equal strings of a block are sent for its smallest id only; the others are
    spans at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                yield from block(b.slice(lo, 1000))
                trim()

    def block(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, out = [], {}
        for i, t, text, marks in zip(*(c.to_pylist() for c in b.columns)):
            m = np.frombuffer(marks, "<u8")
            pos, kind = (m >> np.uint64(2)).astype(np.int64), (m & np.uint64(3)).astype(np.uint8)
            whole = pos[kind == 0]
            spans = np.stack([np.maximum(whole - SIDE, 0), np.minimum(whole + GRAM + SIDE, len(text))], 1)
            if len(spans):
                rows.append((-1, i, t, spans.astype("<i8").tobytes(), None, None, None))
            for bit, before, after, left in ((1, SIDE, NEAR, NEAR), (2, NEAR, SIDE, 0)):
                for p in pos[kind & bit > 0].tolist():
                    start = max(0, p - before)
                    part = text[start : p + GRAM + after]
                    if len(part) >= WIDTH:
                        h = xxhash.xxh64_intdigest(text[p - left : p - left + GRAM + NEAR], seed=bit)
                        out.setdefault(h % buckets, []).append((i, t, start, part, h >> 32))
        whole = {}
        for k, got in out.items():
            least: dict[bytes, int] = {}
            for g in got:
                least[g[3]] = min(g[0], least.get(g[3], g[0]))
            for g in got:
                if g[0] > least[g[3]]:
                    whole.setdefault(g[:2], []).append((g[2], g[2] + len(g[3])))
            got = [g for g in got if g[0] == least[g[3]]]
            head = np.array([g[:3] for g in got], "<i8").tobytes()
            sizes, keys = np.array([len(g[3]) for g in got], "<u2").tobytes(), np.array([g[4] for g in got], "<u4").tobytes()
            rows.append((k, None, None, head, b"".join(g[3] for g in got), sizes, keys))
        rows += [(-1, i, t, union([np.array(x, "<i8").tobytes()]).astype("<i8").tobytes(), None, None, None) for (i, t), x in whole.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4))], names=["bucket", "id", "t", "marks", "parts", "sizes", "keys"])

    return active.mapInArrow(run, _CUT)


def _whole_keys(keys: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Rows in parts of at most `most` bytes, or of one key; rows of a key stay together."""
    order = np.argsort(keys, kind="stable")
    stop = np.append(np.flatnonzero(keys[order][1:] != keys[order][:-1]) + 1, len(order))
    total = np.cumsum(sizes[order])
    lo = k = 0
    while lo < len(order):
        end = int(np.searchsorted(total[stop - 1], (total[lo - 1] if lo else 0) + most, "right"))
        k = max(end, k + 1)
        yield order[lo : stop[k - 1]]
        lo = int(stop[k - 1])


def _common(strings: list[bytes], ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, stop) of the runs of windows that a string of a smaller id, with the same key,
    also has, from the merged transforms of the different strings. Strings without a different
    one under a key of theirs have nothing to compare."""
    at: dict[bytes, int] = {}
    same = np.fromiter((at.setdefault(s, len(at)) for s in strings), np.int64, len(strings))
    each = list(at)
    least = np.full(len(each), np.iinfo(np.int64).max)
    np.minimum.at(least, same, ids)
    whole = np.flatnonzero(ids > least[same])
    found = [(whole, np.zeros(len(whole), np.int64), np.array([len(strings[k]) for k in whole.tolist()], np.int64))]
    pair = np.unique(keys.astype(np.int64) << 32 | same)
    _, of_key, n = np.unique(pair >> 32, return_inverse=True, return_counts=True)
    busy = np.unique(pair[n[of_key] > 1] & (2**32 - 1))
    if len(busy):
        each, low_id = [each[k] for k in busy.tolist()], least[busy]
        want = -(-len(each) // 8)
        shards = [bwt.build(each[k : k + want], WIDTH, 2) for k in range(0, len(each), want)]
        z, place, lcp = bwt.merge(shards, WIDTH, 2)
        string, off, ok = np.empty(len(z), np.int32), np.empty(len(z), np.int32), np.empty(len(z), bool)
        for k, s in enumerate(shards):
            mine = np.flatnonzero(z == k)
            own = np.searchsorted(s.starts, place[mine], "right") - 1
            string[mine], off[mine] = own + k * want, place[mine] - s.starts[own]
            ok[mine] = off[mine] + WIDTH <= s.lengths[own] - 1
        # the intervals, of rotations that begin a window
        interval = np.cumsum(lcp < WIDTH, dtype=np.int32)[ok]
        string, off = string[ok], off[ok]
        start = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]])[: len(interval)])
        low = np.repeat(np.minimum.reduceat(low_id[string], start), np.diff(np.append(start, len(string)))) if len(string) else low_id[string]
        hit = low_id[string] > low
        string, off = string[hit], off[hit]
        order = np.lexsort((off, string))
        string, off = string[order].astype(np.int64), off[order].astype(np.int64)
        new = np.concatenate([[True], (string[1:] != string[:-1]) | (off[1:] > off[:-1] + WIDTH)])[: len(string)]
        first = np.flatnonzero(new)
        of, a, b = busy[string[first]], off[first], off[np.append(first[1:], len(off))[: len(first)] - 1] + WIDTH
        # to all rows of the smallest id that hold the string
        rows = np.flatnonzero(ids == least[same])
        rows = rows[np.argsort(same[rows], kind="stable")]
        lo = np.searchsorted(same[rows], of)
        n = np.searchsorted(same[rows], of, "right") - lo
        to = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        found.append((rows[to], np.repeat(a, n), np.repeat(b, n)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _merge(t: pa.Table) -> pa.Table:
    """The spans that a bucket's strings show, by document."""
    trim()
    heads, strings, keys = [], [], []
    for head, parts, sizes, key in zip(*(t.column(c).to_pylist() for c in ("marks", "parts", "sizes", "keys"))):
        heads.append(np.frombuffer(head, "<i8").reshape(-1, 3))
        keys.append(np.frombuffer(key, "<u4"))
        end = np.cumsum(np.frombuffer(sizes, "<u2"), dtype=np.int64).tolist()
        strings += [parts[i:j] for i, j in zip([0, *end[:-1]], end)]
    head = np.concatenate(heads)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    found = []
    keys = np.concatenate(keys)
    for rows in _whole_keys(keys, sizes, PART_BYTES):
        row, a, z = _common([strings[k] for k in rows.tolist()], head[rows, 0], keys[rows])
        row = rows[row]
        found.append(np.stack([head[row, 0], head[row, 1], head[row, 2] + a, head[row, 2] + z], 1))
    spans = np.concatenate(found)
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    first = np.flatnonzero(np.concatenate([[True], (spans[1:, :2] != spans[:-1, :2]).any(axis=1)])[: len(spans)])
    blobs = [union([spans[i:j, 2:].astype("<i8").tobytes()]).astype("<i8").tobytes() for i, j in zip(first.tolist(), [*first[1:].tolist(), len(spans)])]
    return pa.table([pa.array(spans[first, 0], pa.int64()), pa.array(spans[first, 1], pa.int64()), pa.array(blobs, pa.binary())], names=["id", "t", "marks"])


def union(blobs: list[bytes]) -> np.ndarray:
    """Maximal runs [start, stop) covered by spans."""
    s = np.frombuffer(b"".join(blobs), "<i8").reshape(-1, 2)
    if not len(s):
        return s
    s = s[np.argsort(s[:, 0], kind="stable")]
    stop = np.maximum.accumulate(s[:, 1])
    new = np.concatenate([[True], s[1:, 0] > stop[:-1]])
    first = np.flatnonzero(new)
    return np.stack([s[first, 0], stop[np.append(first[1:], len(s)) - 1]], 1)


def cut(text: bytes, runs: np.ndarray) -> bytes:
    out, at = [], 0
    for a, z in runs.tolist():
        out.append(text[at:a])
        at = z
    return b"".join([*out, text[at:]])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("t"), F.col(text_col).cast("string").cast("binary").alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, t (xxhash64 of the text), spans (array of blobs of little-endian 64-bit pairs
    [start, stop) in bytes): documents in which something repeats."""
    texts = _texts(docs, id_col, text_col)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = int(min(1_000_000_000, max(8, -(-size // BUCKET_BYTES))))
    with small_batches(docs.sparkSession):
        replies = materialize(_send(texts, buckets).groupBy("bucket").applyInArrow(_answer(buckets), _SENT), "anchors")
        late = replies.filter("bucket >= 0").groupBy("bucket").applyInArrow(_answer_frequent(buckets), _SENT)
        marks = replies.filter("bucket < 0").unionAll(late).groupBy("bucket").applyInArrow(_gather, _REPLY)
        cuts = materialize(_contexts(texts.join(marks.hint("merge"), ["id", "t"]).select("id", "t", "text", "marks"), buckets), "contexts")
        drop(replies)
        found = cuts.filter("bucket >= 0").groupBy("bucket").applyInArrow(_merge, _REPLY)
        every = found.unionByName(cuts.filter("bucket < 0").select("id", "t", "marks"))
        spans = materialize(every.groupBy("id", "t").agg(F.collect_list("marks").alias("spans")), "spans")
        drop(cuts)
    return spans


def _applied(docs: DataFrame, id_col: str, text_col: str, act, kind: str) -> DataFrame:
    """id, t and act(text, runs to remove) for each document in which something repeats."""
    columns = [x.split()[0] for x in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [act(text.as_py(), union(blobs.as_py())) for text, blobs in zip(b.column(2), b.column(3))]
            kinds = [pa.string() if x.endswith("string") else pa.int64() for x in kind.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(kinds), kinds))], names=["id", "t", *columns])

    both = _texts(docs, id_col, text_col).join(repeated_spans(docs, id_col, text_col).hint("merge"), ["id", "t"])
    return both.dropDuplicates(["id", "t"]).select("id", "t", "text", "spans").mapInArrow(run, f"id long, t long, {kind}")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    act = lambda text, runs: (int((runs[:, 1] - runs[:, 0]).sum()), len(runs), hashlib.sha256(cut(text, runs)).hexdigest())
    found = _applied(docs, id_col, text_col, act, "n_removed long, n_spans long, kept string")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), F.xxhash64(F.col(text_col).cast("string")).alias("own_t"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("own_sha"))
    got = rows.join(found, (rows[id_col] == found.id) & (F.col("own_t") == found.t), "left")
    return got.select(rows[id_col], "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept", "own_sha").alias("kept_sha256"))


def whole_characters(text: bytes, runs: np.ndarray) -> np.ndarray:
    """runs without the parts of characters at their ends."""
    runs = runs.copy()
    for k, (a, z) in enumerate(runs.tolist()):
        while a < z and text[a] & 0xC0 == 0x80:
            a += 1
        while z > a and z < len(text) and text[z] & 0xC0 == 0x80:
            z -= 1
        runs[k] = a, z
    return runs


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated bytes cut from text_col. Where a run would split a character, the
    run is shortened to whole characters, so the text stays valid. A text of which nothing is
    left stays as an empty one."""
    act = lambda text, runs: (cut(text, whole_characters(text, runs)).decode("utf-8", "replace"),)
    found = _applied(docs, id_col, text_col, act, "kept string")
    rows = packed(docs, own_id=F.col(id_col).cast("long"), own_t=F.xxhash64(F.col(text_col).cast("string")))
    got = rows.join(found, (F.col("own_id") == F.col("id")) & (F.col("own_t") == F.col("t")), "left")
    return unpacked(got, docs.columns, {text_col: F.coalesce("kept", F.col("row").getField(text_col))})
