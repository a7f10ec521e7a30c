"""Time-frequency planes in long form: source, segment, scale, frame, value.

A segment may be arbitrarily long, so nothing is partitioned by segment alone: windows run
over blocks of frames, and what a block needs of its neighbours is copied to it (haloed).
Models have a row or a few for each scale; Spark broadcasts them by their size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, MOST_MODEL_ROWS = 4096, 1_000_000
CELL = ("source", "segment", "scale", "frame")


def haloed(cells: DataFrame, back: int, ahead: int, block: int = BLOCK) -> DataFrame:
    """cells with block; a cell also goes to each block that has it within `back` frames before
    its first or `ahead` after its last frame. own tells a block's own cells."""
    lo, hi = F.floor((F.col("frame") - ahead) / block), F.floor((F.col("frame") + back) / block)
    return cells.withColumn("block", F.explode(F.sequence(lo, hi))).withColumn("own", F.col("block") == F.floor(F.col("frame") / block))


def lagged_sum(cells: DataFrame, weights: list[float], block: int = BLOCK) -> DataFrame:
    """A short filter: value is the sum of weights[j] times the value j frames before. Frames
    without a whole past have none."""
    n = len(weights) - 1
    w = Window.partitionBy(*CELL[:3], "block").orderBy("frame")
    total = sum((F.lit(float(h)) * (F.lag("value", j).over(w) if j else F.col("value")) for j, h in enumerate(weights)), F.lit(0.0))
    whole = F.col("frame") - F.lag("frame", n).over(w) == n if n else F.lit(True)
    return haloed(cells, n, 0, block).withColumns({"__y": total, "__whole": whole}).filter("own and __whole").select(*CELL, F.col("__y").alias("value"))


def valid_region(cells: DataFrame, extent: DataFrame, first_frame: int, last_frame: int, first_scale: int, last_scale: int) -> DataFrame:
    """Without margins. extent: source, segment, n_frames, n_scales."""
    e = extent.select("source", "segment", "n_frames", "n_scales")
    got = cells.join(e, ["source", "segment"])
    keep = F.col("frame").between(first_frame, F.col("n_frames") - last_frame - 1) & F.col("scale").between(first_scale, F.col("n_scales") - last_scale - 1)
    return got.filter(keep).drop("n_frames", "n_scales")


def scale_moments(cells: DataFrame) -> DataFrame:
    """Mean and sample deviation of each scale; a variance within rounding of 0 is 0."""
    got = cells.groupBy("source", "segment", "scale").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("__v"), F.count(F.lit(1)).alias("n"))
    return got.withColumn("std", F.when(F.col("__v") <= F.col("n") * 2.220446049250313e-16, 0.0).otherwise(F.sqrt("__v"))).drop("__v")


class Grid:
    """A block of a plane [scales x frames]: values (0 where there is none) and which are there,
    from the first scale s0 and frame f0 on."""

    def __init__(self, t: pa.Table):
        s, f, v, self.own = (t.column(c).to_numpy() for c in ("scale", "frame", "value", "own"))
        self.s0, self.f0 = int(s.min()), int(f.min())
        shape = (int(s.max()) - self.s0 + 1, int(f.max()) - self.f0 + 1)
        self.value, self.there = np.zeros(shape), np.zeros(shape, bool)
        self.value[s - self.s0, f - self.f0], self.there[s - self.s0, f - self.f0] = v, True
        self.last = int(f[self.own].max()) - self.f0 + 1 if self.own.any() else 0
        self.first = int(f[self.own].min()) - self.f0 if self.own.any() else 0

    def moved(self, x: np.ndarray, scale: int, frames: int) -> np.ndarray:
        """Row `scale` of x at the block's own frames plus `frames`; 0 or False outside."""
        out = np.zeros(self.last - self.first, x.dtype)
        row = scale - self.s0
        if 0 <= row < len(x):
            a, z = max(0, self.first + frames), min(x.shape[1], self.last + frames)
            if a < z:
                out[a - frames - self.first : z - frames - self.first] = x[row, a:z]
        return out


def _blocks(cells: DataFrame, back: int, ahead: int, block: int, columns: str, run) -> DataFrame:
    """run(grid) gives the named columns for each haloed block of each segment: one shuffle of
    the plane, and a task holds a block."""
    kinds = [cells.schema[c].dataType.simpleString() for c in ("source", "segment")]

    def apply(t: pa.Table) -> pa.Table:
        got = run(Grid(t))
        n = len(next(iter(got.values())))
        return pa.table({"source": pa.repeat(t.column("source")[0], n), "segment": pa.repeat(t.column("segment")[0], n)} | {k: pa.array(v) for k, v in got.items()})

    slim = cells.select("source", "segment", F.col("scale").cast("long").alias("scale"), F.col("frame").cast("long").alias("frame"), F.col("value").cast("double").alias("value"))
    return haloed(slim, back, ahead, block).groupBy("source", "segment", "block").applyInArrow(apply, f"source {kinds[0]}, segment {kinds[1]}, {columns}")


def _model_rows(model: DataFrame, names: list[str]) -> list[tuple]:
    """Rows of a model, which has a few for each scale; a larger table is refused."""
    rows = model.select(*names).limit(MOST_MODEL_ROWS + 1).collect()
    if len(rows) > MOST_MODEL_ROWS:
        raise ValueError(f"a model has at most {MOST_MODEL_ROWS} rows")
    return [tuple(r) for r in rows]


def _cells(g: Grid, planes: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """Cell columns of a value and a mask over the own frames for each scale."""
    frames = np.arange(g.first, g.last) + g.f0
    scale, frame, value = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    for s, (v, ok) in planes.items():
        scale.append(np.full(int(ok.sum()), s))
        frame.append(frames[ok])
        value.append(v[ok])
    return {"scale": np.concatenate(scale).astype(np.int64), "frame": np.concatenate(frame).astype(np.int64), "value": np.concatenate(value)}


def lag_correlation(cells: DataFrame, delays: list[int], reach: int | None = 0, block: int = BLOCK) -> DataFrame:
    """Correlation of each scale with scales at most `reach` away (None: all) at each delay,
    with global moments and the divisor of pairs less one; no row for fewer than two pairs. A
    scale without deviation gives null. Products are summed up within blocks of frames, so
    what is aggregated is a row for each pair, delay and block."""
    m = scale_moments(cells).select("source", "segment", "scale", "mean", "std")
    c = cells.join(m, ["source", "segment", "scale"]).select(*CELL, (F.col("value") - F.col("mean")).alias("value"))

    def run(g: Grid) -> dict[str, np.ndarray]:
        out = {k: [np.empty(0, t)] for k, t in (("scale", np.int64), ("xscale", np.int64), ("delay", np.int32), ("s", float), ("n", np.int64))}
        own, there = g.value[:, g.first : g.last], g.there[:, g.first : g.last]
        rows = range(len(g.value))
        for d in delays if g.last > g.first else ():  # else a block of what is copied to it only
            x = np.array([g.moved(g.value, g.s0 + r, d) for r in rows]).reshape(len(rows), -1)
            y = np.array([g.moved(g.there, g.s0 + r, d) for r in rows]).reshape(len(rows), -1)
            if reach == 0:
                i = j = np.arange(len(own))
                s, n = (own * x).sum(1), (there & y).sum(1)
            else:
                i, j = np.indices((len(own), len(own))).reshape(2, -1)
                near = np.abs(i - j) <= (len(own) if reach is None else reach)
                i, j = i[near], j[near]
                s, n = (own @ x.T)[i, j], (there.astype(float) @ y.T.astype(float))[i, j].round().astype(np.int64)
            for k, v in (("scale", i + g.s0), ("xscale", j + g.s0), ("delay", np.full(len(i), d, np.int32)), ("s", s), ("n", n)):
                out[k].append(v)
        return {k: np.concatenate(v).astype(v[0].dtype) for k, v in out.items()}

    far = max((abs(d) for d in delays), default=0)
    parts = _blocks(c, far, far, block, "scale long, xscale long, delay int, s double, n long", run)
    got = parts.groupBy("source", "segment", "scale", "xscale", "delay").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).filter("n > 1")
    one, two = (m.select("source", "segment", F.col("scale").cast("long").alias(k), F.col("std").alias(v)) for k, v in (("scale", "std"), ("xscale", "xstd")))
    got = got.join(one, ["source", "segment", "scale"]).join(two, ["source", "segment", "xscale"])
    scale = F.col("std") * F.col("xstd")
    return got.select("source", "segment", "scale", "xscale", "delay", (F.col("s") / ((F.col("n") - 1) * F.when(scale > 0, scale))).alias("correlation"))


def pattern(cells: DataFrame, taps: DataFrame, block: int = BLOCK) -> DataFrame:
    """value less weighted neighbours. taps: scale, tap_scale, tap_frame, weight, one row for
    each neighbour. Each block of frames is one pass over its grid; cells that lack a neighbour,
    or whose scale has no taps, have no row."""
    model: dict[int, list[tuple]] = {}
    for s, *tap in _model_rows(taps, ["scale", "tap_scale", "tap_frame", "weight"]):
        model.setdefault(int(s), []).append(tuple(tap))
    offsets = [f for own in model.values() for _, f, _ in own] + [0]

    def run(g: Grid) -> dict[str, np.ndarray]:
        planes = {}
        for s, own in model.items():
            v, ok = g.moved(g.value, s, 0), g.moved(g.there, s, 0)
            for scale, frame, weight in own:
                v = v - weight * g.moved(g.value, scale, frame)
                ok = ok & g.moved(g.there, scale, frame)
            planes[s] = (v, ok)
        return _cells(g, planes)

    return _blocks(cells, max(0, -min(offsets)), max(0, max(offsets)), block, "scale long, frame long, value double", run)


def taps_of(crossings: list, spark) -> DataFrame:
    """A model for pattern() from a pair of calibrated crossings for each scale: half of each
    crossing's value, interpolated between its points. At most four rows for a scale."""
    rows = []
    for s, pair in enumerate(crossings):
        if all(x.found for x in pair):
            for x in pair:
                rows += [(s, s + x.super_scale, x.super_frame, 0.5 * (1 - x.delta), 4), (s, s + x.sub_scale, x.sub_frame, 0.5 * x.delta, 4)]
    return spark.createDataFrame(rows, "scale int, tap_scale int, tap_frame int, weight double, n_taps int")


def tract(cells: DataFrame, areas: DataFrame, reach: int | None = None, block: int = BLOCK) -> DataFrame:
    """Mean square over each scale's context area. areas: scale, runscale, start_frame,
    end_frame; reach: the largest absolute frame there, if it is known. Squares are summed up
    within each haloed block, so an area costs two look-ups a run scale. Cells whose area leaves
    the plane have no row."""
    model: dict[int, list[tuple]] = {}
    for s, *row in _model_rows(areas, ["scale", "runscale", "start_frame", "end_frame"]):
        model.setdefault(int(s), []).append(tuple(row))
    far = max((max(abs(a), abs(z)) for own in model.values() for _, a, z in own), default=0)

    def run(g: Grid) -> dict[str, np.ndarray]:
        sums = np.cumsum(np.pad(g.value**2, ((0, 0), (1, 0))), axis=1)
        counts = np.cumsum(np.pad(g.there.astype(np.int64), ((0, 0), (1, 0))), axis=1)
        top, n = g.value.shape[1], g.last - g.first
        at, planes = np.arange(g.first, g.last), {}
        for s, own in model.items():
            v, k = np.zeros(n), np.zeros(n, np.int64)
            for scale, a, z in own:
                row = scale - g.s0
                if 0 <= row < len(g.value):
                    lo, hi = np.clip(at + a, 0, top), np.clip(at + z + 1, 0, top)
                    v += sums[row, hi] - sums[row, lo]
                    k += counts[row, hi] - counts[row, lo]
            size = sum(z - a + 1 for _, a, z in own)
            planes[s] = (v / max(1, size), (k == size) & bool(n))
        return _cells(g, planes)

    far = max(far, reach or 0)
    return _blocks(cells, far, far, block, "scale long, frame long, value double", run)


def band_of(scale: Column, edges: list[int]) -> Column:
    """The band [edges[i], edges[i + 1]) that a scale lies in, else null."""
    if len(edges) < 2:
        raise ValueError("two edges at least")
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1, 0, -1):
        out = F.when((scale >= edges[i - 1]) & (scale < edges[i]), i - 1).otherwise(out)
    return out


def banded(cells: DataFrame, edges: list[int], width: int) -> DataFrame:
    """cells with band and the number of the block of `width` frames; others go."""
    return cells.withColumn("band", band_of(F.col("scale"), edges)).filter("band is not null").withColumn("block", F.floor(F.col("frame") / width))


def blocks(cells: DataFrame, edges: list[int], width: int, aggregates: dict[str, Column], complete: bool = True) -> DataFrame:
    """One row for each band and each block, by default complete ones only."""
    got = banded(cells, edges, width).groupBy("source", "segment", "block", "band").agg(*[c.alias(n) for n, c in aggregates.items()], F.count(F.lit(1)).alias("__n"))
    if complete:
        size = F.lit(0)
        for i in range(len(edges) - 1):
            size = F.when(F.col("band") == i, (edges[i + 1] - edges[i]) * width).otherwise(size)
        got = got.filter(F.col("__n") == size)
    return got.drop("__n")


def band_means(cells: DataFrame, edges: list[int], keep_time: bool = False, normalization: float | None = None, decibels: bool = False) -> DataFrame:
    """Mean of each band, of each frame with keep_time, else of the whole segment; divided by
    the normalization and compressed to decibels where asked for."""
    by = ["source", "segment", *(["frame"] if keep_time else []), "band"]
    got = cells.withColumn("band", band_of(F.col("scale"), edges)).filter("band is not null").groupBy(*by).agg(F.avg("value").alias("value"))
    value = F.col("value") if normalization is None else F.col("value") / normalization
    return got.withColumn("value", 10 * F.log10(F.when(value > 0, value)) if decibels else value)


#: name -> aggregate over columns e, g_f and g_s: energy and the gates of the two tracts.
PTN = {
    "energy": lambda: F.avg("e"),
    "pulse": lambda: F.avg(F.col("e") * F.col("g_f")),
    "tone": lambda: F.avg(F.col("e") * F.col("g_s")),
    "noise": lambda: F.avg(F.col("e") * (1 - F.col("g_f")) * (1 - F.col("g_s"))),
    "tfmax": lambda: F.max("f_tract"), "tsmax": lambda: F.max("s_tract"), "tfmin": lambda: F.min("f_tract"), "tsmin": lambda: F.min("s_tract"),
}


def ptn(cells: DataFrame, edges: list[int], width: int, names: tuple[str, ...] = ("energy", "pulse", "tone", "noise"), threshold: float = 0.0, slope: float = 1.0, normalized: bool = False, decibels: bool = False, reference: float = 0.0) -> DataFrame:
    """Pulse, tone, noise and energy of bands and blocks, and extremes of the tracts, from
    columns e, f_tract and s_tract; only what names asks for is computed. normalized: shares of
    the energy. decibels: of all but extremes, the energy less the reference."""
    from spectrafold.functions.scalars import gate, power_db

    gated = cells.withColumns({"g_f": gate(F.col("f_tract"), threshold, slope), "g_s": gate(F.col("s_tract"), threshold, slope)}) if {"pulse", "tone", "noise"} & set(names) else cells
    asked = {n: PTN[n]() for n in names} | ({"__e": F.avg("e")} if normalized else {})
    got = blocks(gated, edges, width, asked)
    for n in names:
        if n in ("pulse", "tone", "noise") and normalized:
            got = got.withColumn(n, F.col(n) / F.when(F.col("__e") != 0, F.col("__e")))
        if decibels and n in ("energy", "pulse", "tone", "noise"):
            got = got.withColumn(n, power_db(F.col(n)) - (reference if n == "energy" else 0.0))
    return got.drop("__e")
