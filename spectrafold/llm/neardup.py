"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

1. A document's shingles are hashed to 64 bits. Documents with equal sets form a class, and
   only classes go on. A class's signature is CHUNKS * WIDTH values of BITS bits.
2. The signature is split into CHUNKS chunks of WIDTH values. By the pigeonhole principle two
   signatures that differ in at most 2 * CHUNKS - 1 values have a chunk with at most one
   difference. Each chunk is entered once for each value that may differ, without that value,
   so two such classes share an entry: every pair under that distance is found. At the
   similarity of 0.8 the distance of two classes is at most 23 of 60 with probability 0.9997,
   and beyond it a pair still is found unless every chunk has two differences: 1e-7.
3. Entries with equal members count once. Each member of an entry is paired with its centre,
   the smallest of them, which an aggregation finds, so no entry is ever gathered; members of
   a group of copies share their centre in most entries, and pairs count once. Pairs are
   confirmed on the full sets.
4. Entries whose members are still in several components are looked at again: members outside
   the largest component there, in blocks, are compared with all members of other components,
   in slices, by sketches that are whole sets up to SKETCH shingles, and a link or two with each
   component are confirmed. Pairs whose sizes or bins rule the similarity out are dropped: a
   class also has the smallest shingle of each of BINS bins, and of the bins in use the share
   that agree is a sample without replacement of the union, so the bound, six deviations wide,
   is near exact for short texts. So no link between components is lost, while a group of mutual
   copies costs one pair a member, not the square of the group, and near misses aren't sent.
5. Links become components, and components go back to all documents.

Memberships are pairs of numbers; a class's set is made from its text, which is shuffled once,
and sketches are added to it. Sides of joins that grow with the corpus are merged by sort at any
size, so that small inputs have the plan of large ones, and scratch tables go when they are read.

Nulls and empty texts have an empty set and are linked with nothing; texts with fewer words
than a shingle have their whole word sequence as one. A null id is a document of its own and
is linked with nothing. Rows that repeat an id count as one document; where their texts
differ, the text with the smallest hash is the one that links are confirmed on. Very long texts
are hashed whole. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, small_batches, trim
from .components import components

CHUNKS, WIDTH, BITS = 12, 5, 16
VALUES = CHUNKS * WIDTH
BINS, BLOCK, SLICE = 256, 2000, 20_000
#: Shingles up to which a sketch is the whole set; size of the flag table; links of a member with
#: one other component that a slice gives.
SKETCH, PER_ROOT = 1024, 2
_FLAGS = np.zeros(1 << 20, bool)
_TOP = np.uint64(2**64 - 1)
CACHED = 200_000
_ODD = np.random.default_rng(20240229).integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = np.random.default_rng(7).integers(1, 2**63, VALUES, dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """64-bit hashes of words, kept for those seen of late."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, n: int, known: Words) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct n-word shingles of an ASCII-lower-cased text."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    count = max(1, len(ws) - n + 1)
    acc = np.full(count, np.uint64(min(len(ws), n)), np.uint64)
    for k in range(min(n, len(ws))):
        acc = (acc ^ h[k : k + count]) * _M1
        acc ^= acc >> np.uint64(29)
    return np.unique(mix(acc))


def signature(s: np.ndarray) -> np.ndarray:
    """The low bits of the minimum of each hash function over the set."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 2048):
        low = np.minimum(low, np.multiply.outer(_ODD, s[a : a + 2048]).min(axis=1))
    return ((low >> np.uint64(40)) & np.uint64(0xFFFF)).astype("<u2")


def bins(s: np.ndarray) -> np.ndarray:
    """A byte of the smallest element of each bin, 0 where there is none."""
    out = np.zeros(BINS, np.uint8)
    at, first = np.unique(s & np.uint64(BINS - 1), return_index=True)
    out[at] = 1 + (s[first] >> np.uint64(8)) % np.uint64(255)
    return out


def _bins_pass(n1, bins1, n2, bins2, percent: int) -> np.ndarray:
    p = percent / 100
    used = ((bins1 | bins2) > 0).sum(axis=-1)
    both = ((bins1 == bins2) & (bins1 > 0)).sum(axis=-1)
    left = np.maximum(0, 1 - used * (1 + p) / (n1 + n2))
    return (both >= p * used - 6 * np.sqrt(p * (1 - p) * used * left) - 1)


def _features(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            size, one, two, sig = [], [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py(), n, known)
                size.append(len(s))
                one.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                two.append(int(np.bitwise_xor.reduce(s * _M2 ^ (s >> np.uint64(31)), dtype=np.uint64).view(np.int64)) if len(s) else 0)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sig, pa.binary())], names=["id", "n", "f1", "f2", "sig"])
        known.clear()
        trim()

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "id long, n long, f1 long, f2 long, sig binary")


def _entries(classes: DataFrame) -> DataFrame:
    """key, rep: for each chunk and each value in it that may differ, the other values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 2000):
                part = b.slice(a, 2000)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
                keys = np.empty((len(sig), CHUNKS, WIDTH), np.uint64)
                for w in range(WIDTH):
                    acc = np.zeros(sig.shape[:2], np.uint64)
                    for k in [k for k in range(WIDTH) if k != w]:
                        acc = (acc << np.uint64(BITS)) | sig[:, :, k]
                    keys[:, :, w] = mix(acc ^ _SALT[w * CHUNKS : (w + 1) * CHUNKS])
                ids = np.repeat(part.column(0).to_numpy(), VALUES)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], names=["key", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "key long, rep long")


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])


def _runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    new = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(np.concatenate([[True], new])).tolist()
    return zip(at, [*at[1:], len(keys[0])])


def sketch(s: np.ndarray) -> bytes:
    """The upper halves of a set's hashes; of a set of over SKETCH those below a power of two
    that leaves about SKETCH, so that two sketches are samples by one rule."""
    return (s[s < (_TOP >> np.uint64(_level(len(s))))] >> np.uint64(32)).astype("<u4").tobytes() if _level(len(s)) else (s >> np.uint64(32)).astype("<u4").tobytes()


def _level(n: int) -> int:
    return max(0, (-(-n // SKETCH) - 1).bit_length())


def _sets(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """id, s (the full set) of the documents with these ids. Texts are shuffled here, once, and
    nowhere else."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    one = texts.join(ids.hint("merge"), "id", "left_semi").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t.as_py(), n, known).tobytes() for t in b.column(1)], pa.binary())], names=["id", "s"])
        known.clear()
        trim()

    return one.mapInArrow(run, "id long, s binary")


def _sketches(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """rep, n, bins, sketch of the documents with these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in own], pa.int64()), pa.array([bins(s).tobytes() for s in own], pa.binary()), pa.array([sketch(s) for s in own], pa.binary())], names=["rep", "n", "bins", "sketch"])

    return sets.join(ids.select(F.col("rep").alias("id")), "id", "left_semi").mapInArrow(run, "rep long, n long, bins binary, sketch binary")


class Slice:
    """Rows that stream past, with their sketches as one array."""

    def __init__(self, x: dict[str, np.ndarray], blobs: list[bytes]):
        self.x, self.blobs = x, blobs
        self.size = np.array([len(b) // 4 for b in blobs])
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.flat = np.frombuffer(b"".join(blobs), "<u4") & np.uint32(len(_FLAGS) - 1)
        self.level = np.array([_level(n) for n in x["n"].tolist()])

    def linked(self, some: np.ndarray, n: int, blob: bytes, percent: int) -> np.ndarray:
        """Those of the rows `some` that a set of n shingles with this sketch is linked with by
        the sketches: whole sets and never too few up to SKETCH shingles, beyond it all but
        certain ones."""
        own, p = np.frombuffer(blob, "<u4"), percent / 100
        flags = own & np.uint32(len(_FLAGS) - 1)
        _FLAGS[flags] = True
        if 2 * len(some) > len(self.size):
            both = np.add.reduceat(_FLAGS[self.flat], self.at, dtype=np.int64)[some]
        else:
            both = np.array([np.count_nonzero(_FLAGS[self.flat[a : a + k]]) for a, k in zip(self.at[some].tolist(), self.size[some].tolist())], np.int64)
        _FLAGS[flags] = False
        ok = 100 * both >= percent * (self.x["n"][some] + n - both)
        for k in np.flatnonzero((self.level[some] > 0) | (_level(n) > 0)).tolist():
            top = 1 << (32 - max(int(self.level[some[k]]), _level(n)))
            one, two = own[own < top], np.frombuffer(self.blobs[some[k]], "<u4")
            two = two[two < top]
            same = int(np.isin(one, two).sum())
            union = len(one) + len(two) - same
            ok[k] = same >= p * union - 6 * (p * (1 - p) * max(1, union)) ** 0.5
        for k in np.flatnonzero(ok & (self.level[some] == 0)).tolist() if not _level(n) else ():
            same = int(np.isin(own, np.frombuffer(self.blobs[some[k]], "<u4")).sum())
            ok[k] = 100 * same >= percent * (int(self.x["n"][some[k]]) + n - same)
        return some[ok]


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of a block of members outside the largest component with members of others. rows:
    key, block, slice, side (0: the block, 1: the members of the slice), rep, root, n, bins,
    sketch, in this order, so a block is held and the slice streams past it. Of the links of a member with one other
    component in a slice, PER_ROOT of those where both sketches are whole sets are enough; of
    the others, which may be refuted on full sets, all go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, blobs = None, None, []
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = {c: part.column(c).to_numpy() for c in ("key", "block", "slice", "side", "minor", "rep", "root", "n")}
                x["bins"] = np.frombuffer(b"".join(part.column("bins").to_pylist()), np.uint8).reshape(-1, BINS)
                all_blobs = part.column("sketch").to_pylist()
                a, b = [], []
                for i, j in _runs(x["key"], x["block"], x["slice"], x["side"]):
                    now = {k: v[i:j] for k, v in x.items()}
                    name = (int(now["key"][0]), int(now["block"][0]), int(now["slice"][0]))
                    if now["side"][0] == 0:
                        if at == name:
                            held, blobs = {k: np.concatenate([held[k], v]) for k, v in now.items()}, blobs + all_blobs[i:j]
                        else:
                            at, held, blobs = name, now, all_blobs[i:j]
                        continue
                    if at != name:
                        continue  # no member fell into this block
                    passing = Slice(now, all_blobs[i:j])
                    for k in range(len(held["rep"])):
                        rep, n = held["rep"][k], int(held["n"][k])
                        # two members outside the largest component meet twice; the lower takes it
                        twin = (now["minor"] == 1) & (now["rep"] < rep)
                        some = np.flatnonzero((now["root"] != held["root"][k]) & ~twin & (100 * np.minimum(now["n"], n) >= percent * np.maximum(now["n"], n)))
                        some = some[_bins_pass(now["n"][some], now["bins"][some], n, held["bins"][k], percent)]
                        if len(some):
                            some = passing.linked(some, n, blobs[k], percent)
                            if not _level(n):
                                whole = some[passing.level[some] == 0]  # only these are sure to be links
                                whole = whole[np.argsort(now["root"][whole], kind="stable")]
                                root = now["root"][whole]
                                rank = np.arange(len(root)) - np.searchsorted(root, root)
                                some = np.concatenate([whole[rank < PER_ROOT], some[passing.level[some] > 0]])
                            a.append(now["rep"][some])
                            b.append(np.full(len(some), rep))
                if a:
                    yield _pairs(np.concatenate(a), np.concatenate(b))

    return rows.select("key", "block", "slice", "side", "minor", "rep", "root", "n", "bins", "sketch").mapInArrow(run, "a long, b long").distinct()


def _confirm(pairs: DataFrame, made: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links on their full sets, as edges (u, v)."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(made.select(F.col("id").alias("b"), F.col("s").alias("s_b")), "b").join(made.select(F.col("id").alias("a"), F.col("s").alias("s_a")), "a")
    return both.select("a", "b", "s_a", "s_b").mapInArrow(test, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """id_col, n_shingles, component_id, kept for every row of docs. Arrow batches are small
    ones, since rows hold whole sets."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, id_col, text_col, shingle, percent)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    feats = materialize(_features(docs, id_col, text_col, shingle), "features")
    same = ["n", "f1", "f2"]
    classes = materialize(feats.filter("n > 0 and id is not null").groupBy(*same).agg(F.min("id").alias("rep"), F.first("sig").alias("sig")), "classes")
    entries = _entries(classes)
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("rep")).alias("who"), F.min("rep").alias("centre")).filter("members > 1")
    once = shared.groupBy("members", "who").agg(F.min("key").alias("key"), F.min("centre").alias("centre"))
    members = materialize(entries.join(once.drop("who").hint("merge"), "key"), "members")

    sets = materialize(_sets(members.select(F.col("rep").alias("id")).distinct(), docs, id_col, text_col, shingle), "sets")
    tried = materialize(members.filter("rep != centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), "tried")
    links = materialize(_confirm(tried, sets, percent), "links")
    first = components(links)

    named = members.filter("members > 2").join(first.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    sizes = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("c", "root")).alias("major"), F.max("c").alias("most"), F.sum("c").alias("all")).filter("roots > 1")
    mixed = mixed.select("key", "major", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("all") / SLICE).cast("int").alias("slices"))
    again = materialize(named.join(mixed, "key").withColumn("minor", (F.col("root") != F.col("major")).cast("int")).drop("major"), "again")
    drawn = again.join(_sketches(again.select("rep").distinct(), sets), "rep")
    at = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = drawn.filter("minor = 1").withColumn("block", at("blocks")).withColumn("slice", every("slices")).withColumn("side", F.lit(0))
    passing = drawn.withColumn("slice", at("slices")).withColumn("block", every("blocks")).withColumn("side", F.lit(1))
    rows = held.unionByName(passing).repartition("key", "block", "slice").sortWithinPartitions("key", "block", "slice", "side")
    more = materialize(_across(rows, percent).join(tried, ["a", "b"], "left_anti"), "more")
    found = materialize(links.unionAll(_confirm(more, sets, percent)), "links")
    drop(members, sets, tried, links, first, again, more)
    roots = components(found)

    named = classes.select(*[F.col(c).alias(f"own_{c}") for c in same], "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    by = (feats.n == F.col("own_n")) & (feats.f1 == F.col("own_f1")) & (feats.f2 == F.col("own_f2")) & feats.id.isNotNull()
    got = feats.join(named, by, "left")
    root = F.coalesce("root", "rep", "id")
    return got.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(root == F.col("id"), F.lit(True)).alias("kept"))
