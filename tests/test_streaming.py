"""Streams give what the batch operators give, for any cut into chunks and micro-batches."""

import numpy as np

from spectrafold.functions import kernels
from spectrafold.streaming import processors

SCHEMA = "source string, number long, continuity int, data array<double>"


def run(spark, tmp_path, batches, make):
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(f"{tmp_path}/t{k}")
        part = next((tmp_path / f"t{k}").glob("part-*.json"))
        part.rename(tmp_path / "in" / f"{k}.json")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    processors.to_table(make(stream), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    return spark.read.parquet(f"{tmp_path}/out").collect()


def cut(x, seed, gap=None):
    rng = np.random.default_rng(seed)
    ends = [0, *sorted(rng.integers(1, len(x), 7).tolist()), len(x)]
    rows = [("s", n, 10 if n else 1, x[a:z].tolist()) for n, (a, z) in enumerate(zip(ends, ends[1:]))]
    return rows, ends


def test_filter(spark, tmp_path):
    x, h = np.random.default_rng(1).normal(size=400), kernels.kaiser_lowpass(20, 5)
    rows, _ = cut(x, 2)
    late = ("s", 0, 10, [1.0] * 50)
    got = run(spark, tmp_path, [rows[:3][::-1], [*rows[3:], late]], lambda s: processors.filter_stream(s, h, 5))
    want = np.convolve(x, h, "valid")[::5]
    assert {r.segment for r in got} == {1} and np.allclose([r.value for r in sorted(got, key=lambda r: r.frame)], want)


def test_blocks_across_a_gap(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=400)
    rows, ends = cut(x, 4)
    got = run(spark, tmp_path, [rows[:2], rows[2:4], rows[5:]], lambda s: processors.block_stream(s, 16))
    want = {}
    for seg, (a, z) in enumerate(((0, ends[4]), (ends[5], 400)), 1):
        for b in range((z - a) // 16):
            want[seg, b] = (x[a + 16 * b : a + 16 * b + 16] ** 2).mean()
    have = {(r.segment, r.block): r.energy for r in got}
    assert have.keys() == want.keys() and all(np.isclose(have[k], v) for k, v in want.items())


def test_rechunk(spark, tmp_path):
    x = np.arange(100.0)
    rows, _ = cut(x, 5)
    got = run(spark, tmp_path, [rows[:4], rows[4:]], lambda s: processors.rechunk_stream(s, 30))
    assert [r.data for r in sorted(got, key=lambda r: r.number)] == [x[30 * k : 30 * k + 30].tolist() for k in range(3)]
