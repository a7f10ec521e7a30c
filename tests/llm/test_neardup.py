import random

from pyspark.sql import functions as F

from spectrafold.llm import neardup
from spectrafold.llm import queries as Q

from . import brute

SF = "/root/testdata/sf0.001"


def same(got, docs, n):
    want = brute.near(docs, n)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return want


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = same(Q.op3_near_duplicates(spark, SF).collect(), docs, 2)
    assert any(i != c for i, (_, c) in want.items())


def test_chains_borders_and_odd_rows(spark):
    """Edited copies at and around the border, chains of edits, null, empty and short texts."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "One  two")]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice((12, 40, 120)))]
        for _ in range(7):
            docs.append((len(docs), " ".join(base)))
            for _ in range(rng.choice((0, 1, 2, 4, 6))):
                base[rng.randrange(len(base))] = rng.choice(vocab)
    frame = spark.createDataFrame([(i, t, "x", 1.0) for i, t in docs], "doc_id long, text string, sig string, n double")
    for n in (2, 5):
        same(neardup.near_duplicates(frame, shingle=n).collect(), docs, n)


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_signatures_find_close_pairs():
    """Every pair at most 2 * CHUNKS - 1 apart shares an entry."""
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, neardup.VALUES)
        b = a.copy()
        b[rng.choice(neardup.VALUES, 2 * neardup.CHUNKS - 1, replace=False)] += 1
        apart = (a != b).reshape(neardup.CHUNKS, neardup.WIDTH).sum(axis=1)
        assert apart.min() <= 1


def test_sizes_around_the_sketch_limit(spark):
    """Families of edited copies whose sets are whole sketches or samples, of similarities on
    both sides of the border."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(5000)]
    docs = []
    for _ in range(3):
        base = [rng.choice(vocab) for _ in range(1020)]
        for _ in range(25):
            text = list(base)
            for _ in range(rng.randrange(35, 75)):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            k = rng.randrange(-70, 131)
            text = text[:k] if k < 0 else text + [rng.choice(vocab) for _ in range(k)]
            docs.append((len(docs), " ".join(text)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    same(neardup.near_duplicates(frame, shingle=2).collect(), docs, 2)


def test_samples_do_not_use_up_the_links_of_whole_sets(spark):
    """Rows that pass as samples only stand before a true link with the same component."""
    import numpy as np

    rng = np.random.default_rng(2)
    own = np.unique(rng.integers(0, 2**64, 1000, dtype=np.uint64))

    def edited(both, n):
        return np.unique(np.concatenate([rng.permutation(own)[:both], rng.integers(0, 2**64, n - both, dtype=np.uint64)]))

    def row(side, rep, root, s):
        return (0, 0, 0, side, 1 - side, rep, root, len(s), neardup.bins(s).tobytes(), neardup.sketch(s))

    loose = [edited(907, 1100) for _ in range(2)]  # similarity 0.76
    rows = [row(0, 1, 1, own), *(row(1, 11 + k, 9, s) for k, s in enumerate(loose)), row(1, 13, 9, edited(950, 1000))]
    frame = spark.createDataFrame(rows, "key long, block int, slice int, side int, minor int, rep long, root long, n long, bins binary, sketch binary").coalesce(1)
    assert sorted(map(tuple, neardup._across(frame, 80).collect())) == [(1, 11), (1, 12), (1, 13)]


def test_blocks_and_slices_of_a_mixed_entry(spark, monkeypatch):
    """Many blocks and slices give the links of one."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    base, docs = [rng.choice(vocab) for _ in range(60)], []
    for _ in range(60):
        text = list(base)
        for _ in range(rng.randrange(1, 12)):
            text[rng.randrange(len(text))] = rng.choice(vocab)
        docs.append((len(docs), " ".join(text)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(neardup, "BLOCK", 5)
    monkeypatch.setattr(neardup, "SLICE", 7)
    same(neardup.near_duplicates(frame, shingle=2).collect(), docs, 2)


def test_repeated_ids_very_long_texts_and_clashes(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " more"), (3, "a b c d e f"), (3, "g h i j k l"), (3, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("key", F.lit("k")).withColumn("a.b", F.lit(2))
    got = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(frame, shingle=2).collect()]
    assert len(got) == len(rows) and {(1, 1, True), (2, 1, False), (4, 3, False), (None, None, True)} <= set(got)
    assert [c for i, c, _ in got if i == 3] == [3] * 3


def test_every_link_of_a_larger_table(spark):
    """Sizes and components of the 10,000 documents of sf0.1, by brute force over an inverted
    index of shingles: recall 1."""
    from collections import Counter, defaultdict

    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()]
    sets, by, up = {i: brute.shingles(t, 2) for i, t in docs}, defaultdict(list), {i: i for i, _ in docs}
    for i, s in sets.items():
        for x in s:
            by[x].append(i)

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, s in sets.items():
        # two sets of that similarity share one of any fifth of a set's shingles and one more
        rare = sorted(s, key=lambda x: (len(by[x]), x))[: len(s) // 5 + 1]
        for j in {j for x in rare for j in by[x] if j < i}:
            if find(i) != find(j) and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                u, v = sorted((find(i), find(j)))
                up[v] = u
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op3_near_duplicates(spark, "/root/testdata/sf0.1").collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert sum(n > 1 for n in Counter(c for _, c in got.values()).values()) > 100
