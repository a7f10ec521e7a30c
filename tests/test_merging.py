"""Margins, merged patches, flags of composites and grids, on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.functions import kernels, scalars
from spectrafold.operators import calibration, chunks, patches, planes
from spectrafold.sources import synthetic
from spectrafold.streaming import processors


def test_margins_of_white_noise(spark):
    """Areas of 45 cells for f and s and of 75 for u and d; margins of 4 and of 7 or 8 frames."""
    model, areas = calibration.calibrate(synthetic.noise_plane(spark, 64, 2000))
    got = {t: calibration.texture_margins(model, areas, t) for t in "fsud"}
    sizes = {(r.texture, r.area) for r in calibration.area_stats(areas).collect()}
    assert sizes == {("f", 45), ("s", 45), ("u", 75), ("d", 75)}
    ends = {x for p, b in got.values() for m in (p, b) for x in (m.first_frame, m.last_frame, m.first_scale, m.last_scale)}
    assert max(ends) <= 8 and got["f"][1].first_frame >= got["f"][0].first_frame and got["f"][1].first_scale >= got["f"][0].first_scale


def test_margins_stack_on_those_of_the_input():
    reach = {s: (2, 1, 3, 4) for s in range(1, 9)}
    assert kernels.margins(reach, 10) == kernels.Margin(3, 4, 2, 1)
    assert kernels.margins(reach, 10, kernels.Margin(5, 6, 1, 2)) == kernels.Margin(8, 10, 3, 3)
    assert kernels.margins(reach, 3) is None and kernels.margins({}, 10) is None
    assert kernels.area_reach([(4, 3, -2, 5), (4, 6, -1, 7)]) == {4: (1, 2, 2, 7)}


def test_distributions_of_parts_with_a_gap(spark):
    rows = [("s", 1, 1, 10, 2, 5, 9, 1.0), ("s", 1, 1, 11, 1, 6, 6, 4.0), ("s", 1, 2, 11, 3, 0, 8, 2.0), ("s", 1, 2, 14, 4, 1, 2, 3.0)]
    parts = spark.createDataFrame(rows, "source string, segment long, patch long, scale long, n long, lower long, upper long, mean double")
    into = spark.createDataFrame([("s", 1, 1, 1), ("s", 1, 2, 1)], "source string, segment long, patch long, final long")
    got = [tuple(r)[3:] for r in patches.merged_rows(parts, into, "scale").orderBy("scale").collect()]
    assert got == [(10, 2, 5, 9, 1.0), (11, 4, 0, 8, 2.5), (12, 0, None, None, 0.0), (13, 0, None, None, 0.0), (14, 4, 1, 2, 3.0)]


def test_merged_descriptors_keep_the_smallest_serial_and_the_newest_name(spark):
    rows = [("s", 1, k, 3, *r) for k, r in enumerate([(0, 9, 2, 4, 7, 5, "old"), (10, 15, 1, 3, 8, 9, "new"), (10, 12, 6, 6, 1, 7, "short")])]
    parts = spark.createDataFrame(rows, "source string, segment long, patch int, level int, t_low int, t_high int, s_low int, s_high int, size int, serial int, identifier string")
    got = patches.merged(parts, spark.createDataFrame([("s", 1, k, 0) for k in range(3)], "source string, segment long, patch int, final int")).first()
    assert (got.level, got.t_low, got.t_high, got.s_low, got.s_high, got["size"], got.parts, got.serial, got.identifier) == (3, 0, 15, 1, 6, 16, 3, 5, "new")


@pytest.mark.parametrize("flags", [(10, 10), (10, 11), (11, 10), (0, 10), (1, 0), (11, 2)])
def test_streams_and_tables_fuse_flags_alike(spark, tmp_path, flags):
    schema = "source string, number long, continuity int, event_time timestamp, data array<double>"
    inputs = []
    for k, flag in enumerate(flags):
        spark.createDataFrame([("s", 1, flag)], "source string, number long, continuity int").selectExpr("*", "timestamp '2024-01-01 00:00:00' as event_time", "array(1.0D) as data").write.json(f"{tmp_path}/{k}")
        inputs.append(spark.readStream.schema(schema).json(f"{tmp_path}/{k}"))
    made = processors.compose_stream(*inputs).writeStream.format("memory").queryName(f"fused{flags[0]}_{flags[1]}").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    made.awaitTermination(120)
    one, two = (spark.createDataFrame([("s", 1, f)], "source string, number long, continuity int") for f in flags)
    want = chunks.compose({"a": one, "b": two}).first().continuity
    assert [r.continuity for r in spark.table(f"fused{flags[0]}_{flags[1]}").collect()] == [want]


def test_blocks_of_a_grid_never_show(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(6, 70))
    there = rng.random(v.shape) > 0.03
    cells = spark.createDataFrame([("s", 1, int(s), int(t), float(v[s, t])) for s, t in zip(*np.nonzero(there))], "source string, segment long, scale int, frame long, value double")
    taps = spark.createDataFrame([(s, s + 1, 3, 0.25) for s in range(5)] + [(s, s - 1, -2, 0.5) for s in range(1, 6)], "scale int, tap_scale int, tap_frame int, weight double")
    areas = spark.createDataFrame([(s, r, -4, 2) for s in range(1, 5) for r in (s - 1, s + 1)], "scale int, runscale int, start_frame int, end_frame int")
    for f in (lambda n: planes.pattern(cells, taps, block=n), lambda n: planes.tract(cells, areas, block=n), lambda n: planes.lag_correlation(cells, [-3, 0, 2], reach=1, block=n).select("scale", "xscale", "delay", F.round("correlation", 9))):
        one, two = (sorted(tuple(x if not isinstance(x, float) else round(x, 9) for x in r) for r in f(n).collect()) for n in (7, 4096))
        assert one == two and one


def test_strict_lengths_and_scales(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, [])], "number long, data array<double>")
    with pytest.raises(Exception, match="no length"):
        chunks.not_empty(rows, "data").collect()
    f, _ = kernels.gammachirp_bank(bands=7, erb=True)
    e = np.log(kernels.ERB_SLOPE * f + kernels.ERB_OFFSET)
    assert np.allclose(np.diff(e), np.diff(e)[0]) and np.isclose(f[0], 60) and np.isclose(f[-1], 4000)
    one, two = (spark.range(1).select(scalars.fingerprint(c)).first()[0] for c in ({"a": F.lit(1), "b": F.lit(2)}, {"b": F.lit(2), "a": F.lit(1)}))
    assert one == two
