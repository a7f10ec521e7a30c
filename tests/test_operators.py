"""Operators against plain loops and known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.functions import kernels, scalars
from spectrafold.operators import calibration, chunks, filters, patches, planes
from spectrafold.sources import sinks, synthetic, wav


def cells(spark, grid, column="value", first=0):
    rows = [("x", 1, s, first + f, v.item()) for (s, f), v in np.ndenumerate(np.asarray(grid))]
    kind = "long" if column == "level" else "double"
    return spark.createDataFrame([(*r[:4], int(r[4]) if column == "level" else float(r[4])) for r in rows], f"source string, segment long, scale long, frame long, {column} {kind}")


def grid_of(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.scale, r.frame] = r[column]
    return out


def components(grid):
    out, n = np.full(grid.shape, -1), 0
    for at in np.ndindex(grid.shape):
        if out[at] < 0:
            todo = [at]
            out[at] = n
            while todo:
                s, f = todo.pop()
                for x in ((s + 1, f), (s - 1, f), (s, f + 1), (s, f - 1)):
                    if 0 <= x[0] < grid.shape[0] and 0 <= x[1] < grid.shape[1] and out[x] < 0 and grid[x] == grid[at]:
                        out[x] = n
                        todo.append(x)
            n += 1
    return out


def test_stripes():
    rows, cols = np.indices((10, 20))
    assert (patches.label_grid(rows + 1) == rows).all()
    assert (patches.label_grid(cols - 12) == cols).all()
    assert (patches.label_grid(np.where(rows < 5, cols + 11, cols + 31)) == np.where(rows < 5, cols, cols + 20)).all()


def test_random_grids():
    rng = np.random.default_rng(1)
    for _ in range(60):
        g = rng.integers(0, 3, (rng.integers(1, 12), rng.integers(1, 17)))
        assert (patches.label_grid(g) == components(g)).all()


@pytest.mark.parametrize("tile", [3, 7, 64])
def test_tiles_never_show(spark, tile):
    g = np.random.default_rng(tile).integers(0, 2, (9, 30))
    got = patches.label_patches(cells(spark, g, "level"), tile)
    assert (grid_of(got, "patch", g.shape) == components(g)).all()


def test_seams():
    same = [0, 1, 0, 1, 0, 1, 0]
    assert patches.seam_labels([1, 2, 1, 3, 4, 3, 1], [8, 9, 10, 11, 10, 9, 8], same, same) == {1: 1, 2: 2, 3: 2, 4: 1, 8: 1, 9: 2, 10: 1, 11: 2}
    assert patches.seam_labels([1, 2, 3, 2, 1, 4, 1], [11, 12, 13, 14, 13, 12, 11], same, same) == {1: 1, 2: 2, 3: 1, 4: 2, 11: 1, 12: 2, 13: 1, 14: 2}
    assert patches.seam_labels([5], [6], [0], [1]) == {5: -1, 6: -1}


def test_numbering_ignores_partitions(spark):
    df = spark.range(1000).select(F.col("id").alias("at"), (F.col("id") % 3).alias("k")).repartition(7)
    got = chunks.numbered(df, "k", "at", block=64).collect()
    assert all(r.frame == r["at"] // 3 for r in got) and len(got) == 1000


def test_segments_of_a_gap(spark):
    flags = [(0, 0), (1, 10), (2, 10), (4, 10), (5, 10), (6, 11), (7, 1), (9, 11)]
    df = spark.createDataFrame([("a", n, c) for n, c in flags], "source string, number long, continuity int")
    got = {r.number: (r.corrected, r.segment) for r in chunks.segments(df).collect()}
    assert got == {0: (0, 1), 1: (10, 1), 2: (10, 1), 4: (0, 2), 5: (10, 2), 6: (11, 2), 7: (1, 3), 9: (0, 4)}


def test_alignment_algebra():
    a, b = chunks.Alignment(15, 37, 1, 2, 100.0), chunks.Alignment(5, 52, 3, 0, 100.0)
    assert a.merge(b) == chunks.Alignment(15, 52, 3, 2, 100.0)
    assert a.then(chunks.Alignment(1, 2, 1, 1, 50.0)) == chunks.Alignment(8, 20, 2, 3, 50.0)
    with pytest.raises(ValueError):
        a.merge(chunks.Alignment(rate=50.0))
    with pytest.raises(ValueError):
        a.merge(chunks.Alignment(rate=100.0, alignable=False))


def test_required_columns(spark):
    df = spark.range(1)
    assert chunks.require_columns(df, ["id"]) is df
    with pytest.raises(ValueError):
        chunks.require_columns(df, ["sound"])
    with pytest.raises(ValueError):
        chunks.require_columns(df, [], exact=True)


def test_inputs_that_disagree(spark):
    a = spark.createDataFrame([("s", 1, 10, 1.0)], "source string, number long, continuity int, start_time double")
    ok = chunks.compose({"a": a, "b": a})
    assert chunks.consistent(ok, ["a", "b"], ("start_time",)).count() == 1
    bad = chunks.compose({"a": a, "b": a.withColumn("start_time", F.lit(2.0))})
    with pytest.raises(Exception, match="inputs differ in start_time"):
        chunks.consistent(bad, ["a", "b"], ("start_time",)).collect()


def test_filter_bank_blocks(spark):
    rng = np.random.default_rng(2)
    x, h = rng.normal(size=500), rng.normal(size=(3, 41))
    df = spark.createDataFrame([("x", 1, k, float(v)) for k, v in enumerate(x)], "source string, segment long, frame long, value double")
    got = filters.filter_bank(df, h, every=2, block=64)
    want = np.stack([np.convolve(x, k, "valid") for k in h])[:, ::2]
    assert np.allclose(grid_of(got, "value", want.shape), want)


def test_lowpass_and_bank():
    h = kernels.kaiser_lowpass(60, 5, 5.0)
    assert np.isclose(h.sum(), 1) and np.allclose(h, h[::-1])
    with pytest.raises(ValueError):
        kernels.kaiser_lowpass(61, 5)
    f, bank = kernels.gammachirp_bank(bands=10)
    assert np.isclose(f[0], 60) and np.isclose(f[-1], 4000) and bank.shape == (10, 804)
    tone = np.sin(2 * np.pi * f[5] * np.arange(4000) / 8000)
    energy = (np.abs(kernels.valid_filter(tone, bank)) ** 2).mean(axis=1)
    assert energy.argmax() in (4, 5, 6)


def test_pattern_and_tract(spark):
    rng = np.random.default_rng(3)
    e = rng.normal(size=(8, 40))
    taps = spark.createDataFrame([(s, s + d, k, w, 4) for s in range(1, 7) for d, k, w in ((1, 2, 0.3), (-1, -2, 0.3), (0, 1, 0.2), (0, -1, 0.2))], "scale long, tap_scale long, tap_frame int, weight double, n_taps int")
    p = np.full(e.shape, np.nan)
    for s in range(1, 7):
        for t in range(2, 38):
            p[s, t] = e[s, t] - 0.3 * (e[s + 1, t + 2] + e[s - 1, t - 2]) - 0.2 * (e[s, t + 1] + e[s, t - 1])
    assert np.allclose(grid_of(planes.pattern(cells(spark, e), taps), "value", e.shape), p, equal_nan=True)
    areas = spark.createDataFrame([(s, r, a, z) for s in range(2, 6) for r, a, z in ((s - 1, -1, 2), (s, -3, 3), (s + 1, 0, 1))], "scale long, runscale long, start_frame int, end_frame int")
    b = np.full(e.shape, np.nan)
    for s in range(2, 6):
        for t in range(3, 37):
            b[s, t] = sum((e[r, t + a : t + z + 1] ** 2).sum() for r, a, z in ((s - 1, -1, 2), (s, -3, 3), (s + 1, 0, 1))) / 13
    got = grid_of(planes.tract(cells(spark, e), areas, 3, block=8), "value", e.shape)
    assert np.allclose(got, b, equal_nan=True)


def test_correlation_properties(spark):
    x = np.random.default_rng(4).normal(size=(5, 600))
    x[2], x[4] = x[1] - x[3], -x[3]
    got = {(r.scale, r.xscale, r.delay): r.correlation for r in planes.lag_correlation(cells(spark, x), [-2, 0, 2], None).collect()}
    assert np.isclose(got[1, 1, 0], 1) and np.isclose(got[3, 4, 0], -1) and abs(got[1, 2, 0] - 0.5**0.5) < 0.1
    assert all(np.isclose(v, got[b, a, -d]) for (a, b, d), v in got.items())


def test_ray_reports_one_step_beyond():
    c = kernels.Correlator(np.random.default_rng(0).normal(size=(1, 50)))
    c.at = lambda d, s, x: {1: 0.5, 2: 0.1}.get(d, 0.0)
    x = c.ray(0, 0, 1)
    assert (x.super_frame, x.sub_frame) == (2, 3) and np.isclose(x.delta, 0.75)


def test_white_noise_calibrates(spark, tmp_path):
    model, areas = calibration.calibrate(synthetic.noise_plane(spark, 40, 3000, seed=5))
    sizes = {(r.texture, r.area) for r in calibration.area_stats(areas).collect()}
    assert sizes == {("f", 45), ("s", 45), ("u", 75), ("d", 75)}
    calibration.save(model, f"{tmp_path}/m")
    calibration.save(areas, f"{tmp_path}/a")
    plane = synthetic.noise_plane(spark, 40, 60, seed=6)
    one = calibration.structure(plane, model, areas, ("f",))
    two = calibration.structure(plane, calibration.load(spark, f"{tmp_path}/m"), calibration.load(spark, f"{tmp_path}/a"), ("f",))
    key = lambda df: sorted((r.feature, r.scale, r.frame, round(r.value, 9)) for r in df.collect())
    assert key(one) == key(two) and {r[0] for r in key(one)} == {"f_pattern", "f_tract"}
    with pytest.raises(ValueError):
        calibration.noise_plane(plane, most_cells=10)
    with pytest.raises(ValueError):
        calibration.noise_plane(plane.filter("frame <> 5"))


def test_quantizers(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (20.0,), (20.1,), (60.0,), (61.0,), (-5.0,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(scalars.quantize_texture(F.col("x"))).collect()] == [-1, 0, 0, 1, 1, 2, -1, -1, -1]
    got = df.filter("x > 0 and x < 100").select(scalars.quantize_log(F.col("x")), scalars.quantize_floor(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [(-3, -30), (2, -10), (3, -10), (4, 30), (4, 30)]


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_wav(spark, tmp_path, bits):
    x = np.array([0, 1, -1, 100, -100, 2 ** (bits - 1) - 1, -(2 ** (bits - 1))])
    (tmp_path / "a b.wav").write_bytes(wav.encode(x, 8000, bits))
    got = wav.read(spark, str(tmp_path), 3, rate=8000).orderBy("number").collect()
    assert [v for r in got for v in r.data] == x.tolist() and [r.continuity for r in got] == [1, 10, 10]
    assert [r.start_time for r in got] == [0.0, 3 / 8000, 6 / 8000]
    with pytest.raises(Exception, match="has the rate 8000"):
        wav.read(spark, str(tmp_path), 3, rate=44100).collect()


def test_stereo_keeps_the_first_channel():
    import struct

    data = struct.pack("<6h", 1, 9, 2, 9, 3, 9)
    raw = b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", len(data)) + data
    assert wav.parse(raw)[1].tolist() == [1, 2, 3]
    with pytest.raises(ValueError):
        wav.parse(b"OggS")


def test_sinks(spark, tmp_path):
    rows = [("/x/a b.wav", 1, 0, 10, 0.7), ("/x/a b.wav", 1, 1, 10, 1.2), ("/x/a b.wav", 2, 2, 11, 9.9)]
    df = spark.createDataFrame(rows, "identifier string, segment long, number long, continuity int, value double")
    sinks.append(sinks.located(df, day="2024-02-03"), f"{tmp_path}/out", kinds={"value": "short"})
    got = sinks.read(spark, f"{tmp_path}/out").orderBy("number").collect()
    assert [(r.location, str(r.date), r.segment, r.value) for r in got] == [("a_b.wav", "2024-02-03", 1, 0), ("a_b.wav", "2024-02-03", 1, 1)]
    marks = sinks.chunk_marks(spark.range(250).select(F.lit("s").alias("source"), F.col("id").alias("number"), (F.col("id") / 2).alias("start_time"))).first()
    assert marks.marks == [0, 100, 200] and marks.last_time == 124.5
    kv = lambda *r: spark.createDataFrame(r, "source string, key string, value string")
    meta = {r.key: (r.value, r.mismatch) for r in sinks.client_metadata(kv(("s", "a", "1"), ("s", "b", "1")), kv(("s", "a", "2"), ("s", "c", "3"))).collect()}
    assert meta == {"a": ("1", True), "b": ("1", False), "c": ("3", False)}


def test_synthetic_round_trip(spark):
    s = synthetic.sine(spark, 1000)
    c = synthetic.chunked(s, 128, 8000.0)
    back = synthetic.samples_of(c, 128)
    assert back.join(s.withColumnRenamed("value", "v"), ["source", "segment", "frame"]).filter("value = v").count() == 1000
    assert synthetic.dither(s, 4, integral=True).filter("value is null").count() == 0
