"""Filters over long signals, by blocks of frames with the overlap that a filter needs.

Blocks are independent, so a segment of any length spreads over the cluster and a task holds
one block. Kernels are small and travel with the task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.functions import kernels

BLOCK = 16_384


def filter_bank(samples: DataFrame, bank: np.ndarray, every: int = 1, block: int = BLOCK) -> DataFrame:
    """Outputs of each kernel of a bank [bands x taps] that have a whole past, as source,
    segment, scale, frame, value; frames are numbered from the first output and every `every`-th
    is kept. A complex kernel gives magnitudes. samples: source, segment, frame from 0 without
    gaps, value."""
    bank = np.atleast_2d(bank)
    past = bank.shape[1] - 1

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("frame")
        frame, x = t.column("frame").to_numpy(), t.column("value").to_numpy().astype(float)
        number = t.column("block")[0].as_py()
        y = kernels.valid_filter(x, bank)
        at = frame[past:] - past
        keep = np.flatnonzero((at % every == 0) & (frame[past:] // block == number)) if len(frame) > past else np.empty(0, np.int64)
        y = np.abs(y[:, keep]) if np.iscomplexobj(y) else y[:, keep]
        n = len(bank) * len(keep)
        return pa.table({
            "source": pa.repeat(t.column("source")[0], n), "segment": pa.repeat(t.column("segment")[0], n),
            "scale": pa.array(np.repeat(np.arange(len(bank), dtype=np.int32), len(keep))), "frame": pa.array(np.tile(at[keep] // every, len(bank)).astype(np.int64)), "value": pa.array(y.reshape(-1)),
        })

    spread = samples.select("source", "segment", F.col("frame").cast("long").alias("frame"), F.col("value").cast("double").alias("value"))
    spread = spread.withColumn("block", F.explode(F.sequence(F.floor(F.col("frame") / block), F.floor((F.col("frame") + past) / block))))
    kinds = ", ".join(f"{c} {samples.schema[c].dataType.simpleString()}" for c in ("source", "segment"))
    return spread.groupBy("source", "segment", "block").applyInArrow(run, f"{kinds}, scale int, frame long, value double")


def resample(samples: DataFrame, factor: int = 5, taps: int = 60, beta: float = 5.0) -> DataFrame:
    """Lowpass and every factor-th sample."""
    return filter_bank(samples, kernels.kaiser_lowpass(taps, factor, beta), factor).drop("scale")


def gammachirp_energy(samples: DataFrame, rate: float = 8000.0, bands: int = 100, every: int = 5, **bank) -> DataFrame:
    """Energy of a gammachirp filterbank, in ascending frequency, every few samples."""
    _, h = kernels.gammachirp_bank(rate, bands=bands, every=every, **bank)
    return filter_bank(samples, h, every).withColumn("value", F.col("value") * F.col("value"))


def gammachirp_db(samples: DataFrame, rate: float = 8000.0, bands: int = 100, every: int = 5, **bank) -> DataFrame:
    """The same in decibels, null where there is no energy."""
    return gammachirp_energy(samples, rate, bands, every, **bank).withColumn("value", 10 * F.log10(F.when(F.col("value") > 0, F.col("value"))))
