"""Calibration on a noise plane, model tables, and the features that a model gives.

A calibration plane is small by nature (a hundred scales, some thousand frames). It is the only
data that reaches the driver, its size is counted first, and a larger one is refused. Models are
tables of a few rows for each scale, which Spark broadcasts by their size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafold.functions import kernels
from spectrafold.operators import planes

MOST_CELLS = 4_000_000
PATTERN_MODEL = "texture string, axis string, scale int, side int, found boolean, super_scale int, super_frame int, sub_scale int, sub_frame int, delta double"
AREA_MODEL = "texture string, scale int, runscale int, start_frame int, end_frame int"


def noise_plane(noise: DataFrame, most_cells: int = MOST_CELLS) -> np.ndarray:
    """[scales x frames] of a noise plane (scale, frame, value) without gaps."""
    n, scales, frames = noise.agg(F.count(F.lit(1)), F.max("scale") + 1, F.max("frame") + 1).first()
    if not n or n > most_cells or n != scales * frames:
        raise ValueError(f"a calibration plane needs 1 to {most_cells} cells and no gaps; this has {n} of {scales} x {frames}")
    t = noise.select(F.col("scale").cast("int"), F.col("frame").cast("int"), F.col("value").cast("double")).toArrow()
    plane = np.empty((scales, frames))
    plane[t.column(0).to_numpy(), t.column(1).to_numpy()] = t.column(2).to_numpy()
    return plane


def calibrate(noise: DataFrame, most_cells: int = MOST_CELLS) -> tuple[DataFrame, DataFrame]:
    """(pattern model, area model) of a noise plane."""
    spark, plane = noise.sparkSession, noise_plane(noise, most_cells)
    found = kernels.calibrate(plane)
    crossings = [
        (t, axis, s, side, x.found, x.super_scale, x.super_frame, x.sub_scale, x.sub_frame, float(x.delta))
        for t, axes in found.items() for axis, pairs in axes.items() for s, pair in enumerate(pairs) for side, x in enumerate(pair)
    ]
    areas = [
        (t, s, run, a, z)
        for t, axes in found.items() for s in range(len(plane))
        for run, a, z in kernels.context_area(s, axes["principal"][s], axes["orthogonal"][s], len(plane))
    ]
    return spark.createDataFrame(crossings, PATTERN_MODEL), spark.createDataFrame(areas, AREA_MODEL)


def save(model: DataFrame, path: str) -> None:
    model.coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def taps(model: DataFrame, texture: str) -> DataFrame:
    """Weighted neighbours of each scale with both crossings, for planes.pattern."""
    own = model.filter((F.col("texture") == texture) & (F.col("axis") == "principal"))
    both = own.filter("found").groupBy("scale").agg(F.count(F.lit(1)).alias("sides")).filter("sides = 2").select("scale")
    points = F.array(
        F.struct((F.col("scale") + F.col("super_scale")).alias("tap_scale"), F.col("super_frame").alias("tap_frame"), (0.5 * (1 - F.col("delta"))).alias("weight")),
        F.struct((F.col("scale") + F.col("sub_scale")).alias("tap_scale"), F.col("sub_frame").alias("tap_frame"), (0.5 * F.col("delta")).alias("weight")),
    )
    return own.join(both, "scale").select("scale", F.explode(points).alias("p")).select("scale", "p.*", F.lit(4).alias("n_taps"))


def texture_margins(model: DataFrame, areas: DataFrame, texture: str) -> tuple[kernels.Margin | None, kernels.Margin | None]:
    """Margins of a texture's pattern and tract, from the few rows that a model has."""
    rows = planes._model_rows(model.filter((F.col("texture") == texture) & (F.col("axis") == "principal")), ["scale", "side", "found", "super_scale", "super_frame", "sub_scale", "sub_frame", "delta"])
    pairs = [[kernels.Crossing(False)] * 2 for _ in range(max((r[0] for r in rows), default=-1) + 1)]
    for s, side, *rest in rows:
        pairs[s] = [kernels.Crossing(*rest) if k == side else x for k, x in enumerate(pairs[s])]
    first = kernels.margins(kernels.pattern_reach([tuple(p) for p in pairs]), len(pairs))
    own = planes._model_rows(areas.filter(F.col("texture") == texture), ["scale", "runscale", "start_frame", "end_frame"])
    return first, kernels.margins(kernels.area_reach(own), len(pairs), first) if first else None


def features(cells: DataFrame, model: DataFrame, areas: DataFrame, texture: str) -> tuple[DataFrame, DataFrame]:
    """(pattern, tract) planes of a texture; cells without all their neighbours have no row."""
    pattern = planes.pattern(cells, taps(model, texture))
    return pattern, planes.tract(pattern, areas.filter(F.col("texture") == texture).drop("texture"))


def structure(cells: DataFrame, model: DataFrame, areas: DataFrame, textures: tuple[str, ...] = kernels.TEXTURES, crop: bool = True) -> DataFrame:
    """Rows of all features: feature (f_pattern, f_tract and so on) with the columns of a cell,
    by default cropped to the margins of the tract, so both have the same cells; a texture
    without valid scales has none."""
    out = None
    extent = cells.groupBy("source", "segment").agg((F.max("frame") + 1).alias("n_frames"), (F.max("scale") + 1).alias("n_scales"))
    for t in textures:
        margin = texture_margins(model, areas, t)[1]
        for kind, df in zip(("pattern", "tract"), features(cells, model, areas, t)):
            if crop and margin:
                df = planes.valid_region(df, extent, margin.first_frame, margin.last_frame, margin.first_scale, margin.last_scale)
            elif crop:
                df = df.filter(F.lit(False))
            named = df.withColumn("feature", F.lit(f"{t}_{kind}"))
            out = named if out is None else out.unionByName(named)
    return out


def pattern_moments(pattern: DataFrame, white: bool = False) -> DataFrame:
    """Mean (0 for white noise) and root mean square of a pattern by scale."""
    mean = F.lit(0.0) if white else F.avg("value")
    return pattern.groupBy("source", "segment", "scale").agg(mean.alias("mean"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))


def tract_moments(tract: DataFrame) -> DataFrame:
    return tract.groupBy("source", "segment", "scale").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def normalized(cells: DataFrame, moments: DataFrame, spread: str) -> DataFrame:
    """(value - mean) / spread by scale; null where there is no spread."""
    m = moments.select("source", "segment", "scale", "mean", F.col(spread).alias("__s"))
    got = cells.join(m, ["source", "segment", "scale"])
    return got.withColumn("value", (F.col("value") - F.col("mean")) / F.when(F.col("__s") != 0, F.col("__s"))).drop("mean", "__s")


def area_stats(areas: DataFrame) -> DataFrame:
    """Cells and horizons of each context area."""
    return areas.groupBy("texture", "scale").agg(
        F.sum(F.col("end_frame") - F.col("start_frame") + 1).cast("long").alias("area"),
        F.min("start_frame").alias("first_frame"), F.max("end_frame").alias("last_frame"), F.min("runscale").alias("first_scale"), F.max("runscale").alias("last_scale"),
    )
