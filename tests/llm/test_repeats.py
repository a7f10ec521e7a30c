import random

import numpy as np

from spectrafold.llm import bwt, repeats

from . import brute

SF = "/root/testdata/sf0.001"


def test_merged_transform_sorts_and_counts_prefixes():
    rng = random.Random(3)
    shards = [[bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 30))) for _ in range(9)] for _ in range(3)]
    depth = 12
    z, at, lcp = bwt.merge([bwt.build(s, depth) for s in shards], depth)
    flat = []
    for k, p in zip(z.tolist(), at.tolist()):
        for s in shards[k]:
            if p <= len(s):
                r = s + b"\xff"
                r = (r[p:] + r[:p]) * depth
                flat.append(r[:depth])
                break
            p -= len(s) + 1
    assert flat == sorted(flat) and len(flat) == sum(len(s) + 1 for x in shards for s in x)
    for i in range(1, len(flat)):
        same = next((k for k in range(depth) if flat[i][k] != flat[i - 1][k]), depth)
        assert lcp[i] == same


def test_steps_of_two_give_the_same_order():
    rng = random.Random(4)
    shards = [[bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 30))) for _ in range(9)] for _ in range(4)]
    one, two = (bwt.merge([bwt.build(s, 12, k) for s in shards], 12, k) for k in (1, 2))
    border = np.flatnonzero(one[2] < 12)
    assert np.array_equal(two[2][1:], one[2][1:] // 2 * 2) and np.array_equal(border, np.flatnonzero(two[2] < 12))
    for i, j in zip(border, [*border[1:], len(one[0])]):
        assert sorted(zip(one[0][i:j], one[1][i:j])) == sorted(zip(two[0][i:j], two[1][i:j]))


def test_anchors_agree_with_a_plain_scan():
    rng = random.Random(1)
    text = bytes(rng.choice(b"abc ") for _ in range(700))
    pos, h, *_ = repeats.anchors(text)
    gram = dict(zip(pos.tolist(), h.tolist()))
    for s in range(len(text) - repeats.WIDTH + 1):
        assert any(p in gram for p in range(s, s + repeats.SIDE + 1))
    whole = pos
    repeats.SEGMENT, old = 100, repeats.SEGMENT
    try:
        assert np.array_equal(repeats.anchors(text)[0], whole)
    finally:
        repeats.SEGMENT = old


def check(spark, docs):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, t string, id int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.report(frame).collect()}
    want = brute.repeats(docs)
    assert got == want
    return frame, want


def test_passages_copies_and_odd_rows(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 7)))
    some = [" ".join(word() for _ in range(30)) for _ in range(4)]
    docs = [(0, None), (1, ""), (2, "short"), (3, "é" * 60), (4, "x" + "é" * 70), (5, "a" * 500), (6, "a" * 49), (7, "b" + "a" * 50)]
    for k in range(40):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 40)))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(some)
            a = rng.randrange(0, 60)
            parts += [p[a : a + rng.choice((48, 49, 50, 51, 80, 200))], word()]
        docs.append((100 - k, " ".join(parts)))
    docs.append((200, docs[-1][1]))
    base = docs[20][1] + " ".join(word() for _ in range(60))
    for k in range(6):
        words = base.split(" ")
        words[rng.randrange(len(words))] = word()
        docs.append((300 - k, " ".join(words)))
    frame, want = check(spark, docs)
    assert sum(v[1] > 0 for v in want.values()) > 10
    kept = {r.doc_id: r.text for r in repeats.remove(frame).collect()}
    for i, t in docs:
        if t and t.isascii():
            assert len(kept[i]) == want[i][0] - want[i][1]


def test_null_and_repeated_ids(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, long), (5, long), (5, long), (5, long + " and more"), (6, long)]
    got = sorted((r.doc_id or -1, r.n_removed) for r in repeats.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 0), (5, 0), (5, 0), (5, 0), (6, len(long))]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.report(none).collect() == [] and repeats.remove(none).collect() == []
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as __t", "'x' as t", "2 as id", "3 as kept", "4 as `a.b`", "map('k', 1) as row")
    got = repeats.remove(frame)
    assert got.columns == frame.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got.collect()) == sorted((i or -1, "" if i == 6 else t) for i, t in rows)


def test_very_long_texts(spark):
    rng = random.Random(2)
    base = " ".join(str(rng.randrange(10**9)) for _ in range(60_000))
    docs = [(1, base), (2, base[1000:300_000] + "x" + base[300_000:]), (3, base[::-1])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (len(base), 0, 0), 2: (len(docs[1][1]), len(base) - 1000, 2), 3: (len(base), 0, 0)}


def test_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = check(spark, docs)[1]
    assert any(v[1] for v in want.values())


def test_common_windows_agree_with_a_plain_search():
    rng = random.Random(8)
    word = [bytes(rng.choice(b"abcdefgh") for _ in range(25)) for _ in range(4)]
    strings = [b"".join(rng.choice(word) for _ in range(3))[rng.randrange(0, 9) :] for _ in range(60)]
    ids = np.array([rng.randrange(0, 12) for _ in strings])
    n = repeats.WIDTH
    least = {}
    for s, i in zip(strings, ids.tolist()):
        for k in range(len(s) - n + 1):
            least[s[k : k + n]] = min(i, least.get(s[k : k + n], i))
    want = [{b for k in range(len(s) - n + 1) if least[s[k : k + n]] < i for b in range(k, k + n)} for s, i in zip(strings, ids.tolist())]
    got = [set() for _ in strings]
    for row, a, z in zip(*(x.tolist() for x in repeats._common(strings, ids, np.zeros(len(ids), "<u4")))):
        got[row] |= set(range(a, z))
    assert got == want and any(want)
    assert repeats._common([b"x" * n] * 3, np.array([4, 4, 4]), np.zeros(3, "<u4"))[0].size == 0
    # a string is compared under any of its keys; one alone under its own is not
    some = [b"p" * 9 + b"q" * n, b"q" * n + b"r" * 9, b"q" * n + b"r" * 9, b"s" + b"q" * n]
    rows = repeats._common(some, np.array([1, 2, 3, 0]), np.array([5, 5, 6, 7], "<u4"))
    assert sorted(zip(*(c.tolist() for c in rows))) == [(1, 0, n), (2, 0, n + 9)]


def test_keys_stay_whole_in_bounded_parts():
    rng = random.Random(9)
    keys = np.array([rng.choice([7, rng.randrange(50)]) for _ in range(400)], "<u4")
    sizes = np.array([rng.randrange(50, 67) for _ in keys])
    parts = list(repeats._whole_keys(keys, sizes, 1000))
    assert sorted(np.concatenate(parts).tolist()) == list(range(400))
    of = [set(keys[p].tolist()) for p in parts]
    assert sum(map(len, of)) == len(set(keys.tolist()))
    assert all(len(k) == 1 or sizes[p].sum() <= 1000 for k, p in zip(of, parts))
    assert list(repeats._whole_keys(keys[:0], sizes[:0], 1000)) == []


def test_an_anchor_with_many_contexts(spark):
    rng = random.Random(10)
    line = "a line that all of them hold"
    odd = lambda n: "".join(rng.choice("bcdfghjklm ") for _ in range(n))
    lead, trail = odd(30), odd(30)
    docs = [(i, odd(60) + (lead if i % 3 else odd(30)) + line + (trail if i % 4 else odd(30)) + odd(60)) for i in range(120)]
    docs += [(200, line + trail), (201, lead + line), (202, line), (203, (lead + line) * 2)]
    check(spark, docs)


def test_anchors_frequent_in_some_blocks_only(spark):
    """Contexts of an anchor meet, whether their blocks found it frequent or not."""
    rng = random.Random(12)
    odd = lambda n: "".join(rng.choice("bcdfghjklm ") for _ in range(n))
    line, lead, trail = "a line that all of them hold", odd(40), odd(40)
    docs = [(1400 - i, odd(60) + (lead if i % 3 == 0 else odd(40)) + line + (trail if i % 4 == 0 else odd(40)) + odd(60)) for i in range(400)]
    docs += [(3000 - i, odd(300) if i % 20 else lead[-20:] + line + trail + odd(9)) for i in range(200)]
    docs += [(i, docs[i][1][40:170]) for i in range(0, 150, 7)] + [(1500 + i, docs[i][1]) for i in range(0, 150, 11)]
    schema = "doc_id long, text string"
    frame = spark.createDataFrame(docs[:400], schema).coalesce(1).unionAll(spark.createDataFrame(docs[400:], schema).repartition(9))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.report(frame).collect()}
    want = brute.repeats(docs)
    assert got == want and sum(v[1] > 0 for v in want.values()) > 30
    sent = repeats._send(repeats._texts(frame, "doc_id", "text"), 8).select("bucket", "ctx").collect()
    assert any(r.bucket >= 8 for r in sent) and any(0 <= r.bucket < 8 and not r.ctx for r in sent)


def test_buckets_are_even(spark):
    """Anchors have small hashes, which may not decide the bucket as they are."""
    rng = random.Random(13)
    docs = [(i, "".join(rng.choice("abcdefgh ") for _ in range(2000))) for i in range(60)]
    sent = repeats._send(repeats._texts(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text"), 8)
    n = dict.fromkeys(range(8), 0)
    for r in sent.filter("bucket >= 0").select("bucket", "a").collect():
        n[r.bucket] += len(r.a) // 4
    assert min(n.values()) > 0.8 * max(n.values())
