"""The board, and streams of patches and calibrations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.operators import calibration, chunks, patches
from spectrafold.streaming import board
from spectrafold.streaming.patches import patch_stream

SCHEMA = "source string, number long, continuity int, scales int, data array<double>"


def stream(spark, folder, batches):
    (folder / "in").mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(f"{folder}/t{k}")
        next((folder / f"t{k}").glob("part-*.json")).rename(folder / "in" / f"{k}.json")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{folder}/in")


def test_streamed_patches_are_those_of_the_whole_plane(spark, tmp_path):
    rng = np.random.default_rng(8)
    v = rng.choice([-5.0, 10.0, 70.0], size=(7, 60), p=[0.4, 0.35, 0.25])
    ends = [0, 9, 9, 10, 31, 60]  # one chunk is empty, one has a single frame
    rows = [("s", k, 10 if k else 1, 7, v[:, a:z].reshape(-1).tolist()) for k, (a, z) in enumerate(zip(ends, ends[1:]))]
    late = ("s", 1, 10, 7, [70.0] * 7)
    gap = ("s", 9, 10, 7, v[:, :20].reshape(-1).tolist())
    end = ("s", 10, 11, 7, [0.0] * 7)
    b = board.Board()
    b.start("planes", lambda: stream(spark, tmp_path, [rows[:2], rows[2:4], [late, *rows[4:]], [gap, end]]))
    b.start("patches", patch_stream, board.Order("planes", "chunks"), required=("chunks",), scales=7)
    b.run("patches", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(240)
    assert b.healthy()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    for segment, plane in ((1, v), (2, v[:, :20])):
        levels = np.searchsorted([0, 20, 60], plane, "left") - 1
        cells = [("s", 1, s, t, int(levels[s, t])) for s in range(7) for t in range(plane.shape[1])]
        want = patches.descriptors(patches.label_patches(spark.createDataFrame(cells, "source string, segment long, scale int, frame long, level int"))).collect()
        shape = lambda r: (r.level, r.t_low, r.t_high, r.s_low, r.s_high, r["size"])
        assert sorted(map(shape, want)) == sorted(shape(r) for r in got if r.segment == segment)
    assert len({(r.segment, r.serial) for r in got}) == len(got)


def test_only_calibration_chunks_calibrate(spark, tmp_path):
    noise = np.random.default_rng(5).normal(size=(24, 900))
    rows = [("s", 0, 1, 24, noise[:, :10].reshape(-1).tolist()), ("s", 1, 2, 24, noise.reshape(-1).tolist()), ("s", 2, 10, 24, noise[:, :10].reshape(-1).tolist())]
    board.calibrate_stream(stream(spark, tmp_path, [rows]), f"{tmp_path}/models", f"{tmp_path}/check").awaitTermination(240)
    assert [p.name for p in (tmp_path / "models" / "s").iterdir()] == ["1"]
    cells = spark.createDataFrame([(s, t, float(noise[s, t])) for s in range(24) for t in range(900)], "scale int, frame int, value double")
    want = calibration.calibrate(cells)
    for name, df in zip(("pattern", "areas"), want):
        assert sorted(map(tuple, calibration.load(spark, f"{tmp_path}/models/s/1/{name}").collect())) == sorted(map(tuple, df.collect()))


def test_names_orders_and_pauses(spark, tmp_path):
    b = board.Board(board.log_to(f"{tmp_path}/log"))
    rows = spark.createDataFrame([("s", 0, 1, 2.0), ("s", 1, 10, 3.0)], "source string, number long, continuity int, sound double")
    b.start("sound", lambda: rows)
    b.start("relay", lambda sound: sound, board.Order("sound", "sound", (("heard", "sound"), ("tick", "*"))))
    assert [tuple(r) for r in b.subscribe("relay").orderBy("number").collect()] == [("s", 0, 1, 2.0, None), ("s", 1, 10, 3.0, None)]
    b.start("both", lambda a, b: chunks.compose({"a": a, "b": b}), board.Order("sound", "a"), board.Order("relay", "b"), required=("a", "b"))
    assert b.subscribe("both").agg(F.sum("b.heard")).first()[0] == 5.0
    for wrong in (("sound", lambda: rows, ()), ("x", lambda y: y, (board.Order("none", "y"),)), ("x", lambda y: y, (board.Order("sound", "y"), board.Order("relay", "y")))):
        with pytest.raises(ValueError):
            b.start(wrong[0], wrong[1], *wrong[2])
    with pytest.raises(ValueError):
        b.subscribe("none")
    assert "started both" in (tmp_path / "log").read_text()
    assert board.pause(0) == 0.025 and board.pause(100) == 15.0 and board.pause(2) == pytest.approx(0.04225)
    tries, waits = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("not yet")
        return rows

    assert board.connected(flaky, wait=waits.append) is rows and waits == [board.pause(0), board.pause(1)]
    assert set(board.provenance("/nowhere")) == set()


def test_a_failed_query_stops_the_others(spark, tmp_path):
    b = board.Board()
    rate = lambda: spark.readStream.format("rate").option("rowsPerSecond", 5).load()
    b.start("ticks", rate)
    b.start("good", lambda x: x.select("value"), board.Order("ticks", "x"))
    b.start("bad", lambda x: x.select(F.raise_error(F.lit("broken")).cast("string").alias("value")), board.Order("ticks", "x"))
    b.run("good", f"{tmp_path}/g", f"{tmp_path}/gc", processingTime="1 second")
    bad = b.run("bad", f"{tmp_path}/b", f"{tmp_path}/bc", processingTime="1 second")
    with pytest.raises(Exception, match="broken"):
        bad.awaitTermination(120)
    assert not b.healthy() and not b.running["good"].isActive
