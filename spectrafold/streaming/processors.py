"""Chunk streams in Structured Streaming, with the results of the batch operators.

State is kept by source: what a filter or a block needs of the past, and the last chunk number.
Chunks of a micro-batch are taken in the order of their numbers; a chunk that isn't newer than
the last one is late and dropped; a gap, or a flag below WITH_PREVIOUS, starts a new segment.
State is bounded by the filter or block, whatever the length of the stream. Checkpoints make
restarts lossless.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spectrafold.functions import kernels
from spectrafold.operators.chunks import fused_flag

GOES_ON = 10
_STATE = "number long, segment long, frame long, tail array<double>"


def _stateful(chunks: DataFrame, output: str, step: Callable) -> DataFrame:
    """step(source, segment, frame of the tail's start, tail, new samples) gives (rows, new tail,
    frames dropped from its start)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, segment, at, tail = state.get if state.exists else (None, 0, 0, [])
        tail = np.asarray(tail, float)
        for r in pd.concat(list(frames)).sort_values(["number"], kind="stable").itertuples():
            if number is not None and r.number <= number:
                continue
            if number is None or r.number != number + 1 or r.continuity < GOES_ON:
                segment, at, tail = segment + 1, 0, np.empty(0)
            number = int(r.number)
            rows, left, gone = step(key[0], segment, at, np.concatenate([tail, np.asarray(r.data, float)]))
            tail, at = left, at + gone
            if len(rows):
                yield rows
        if number is not None:
            state.update((number, segment, at, tail.tolist()))

    slim = chunks.select("source", "number", "continuity", "data")
    got = slim.groupBy("source").applyInPandasWithState(run, output, _STATE, "append", GroupStateTimeout.NoTimeout)
    # what Python returns is columnar, and a partitioned writer sorts rows: a projection makes them
    return got.withColumn("segment", F.abs("segment"))


def filter_stream(chunks: DataFrame, kernel: np.ndarray, every: int = 1) -> DataFrame:
    """source, segment, frame, value: as filters.filter_bank on the whole segment."""
    h = np.asarray(kernel)
    past = len(h) - 1

    def step(source, segment, at, x):
        if len(x) <= past:
            return (), x, 0
        y = kernels.valid_filter(x, h)[0]
        frame = at + np.arange(len(y))
        keep = frame % every == 0
        rows = pd.DataFrame({"source": source, "segment": segment, "frame": frame[keep] // every, "value": np.abs(y[keep]) if np.iscomplexobj(y) else y[keep]})
        return rows, x[len(x) - past :], len(y)

    return _stateful(chunks, "source string, segment long, frame long, value double", step)


def block_stream(chunks: DataFrame, width: int) -> DataFrame:
    """source, segment, block, energy, n: complete blocks of `width` samples."""

    def step(source, segment, at, x):
        n = len(x) // width
        if not n:
            return (), x, 0
        e = (x[: n * width] ** 2).reshape(n, width).mean(axis=1)
        rows = pd.DataFrame({"source": source, "segment": segment, "block": at // width + np.arange(n), "energy": e, "n": width})
        return rows, x[n * width :], n * width

    return _stateful(chunks, "source string, segment long, block long, energy double, n long", step)


def rechunk_stream(chunks: DataFrame, size: int) -> DataFrame:
    """source, segment, number, data: chunks of exactly `size` samples."""

    def step(source, segment, at, x):
        n = len(x) // size
        rows = pd.DataFrame({"source": [source] * n, "segment": segment, "number": at // size + np.arange(n), "data": list(x[: n * size].reshape(n, size))})
        return rows, x[n * size :], n * size

    return _stateful(chunks, "source string, segment long, number long, data array<double>", step)


def compose_stream(left: DataFrame, right: DataFrame, delay: str = "1 minute", time: str = "event_time") -> DataFrame:
    """Composites of two streams by source and number. What is later than the delay is dropped,
    so the state of the join is bounded."""
    a = left.withWatermark(time, delay).alias("a")
    b = right.withWatermark(time, delay).alias("b")
    same = (F.col("a.source") == F.col("b.source")) & (F.col("a.number") == F.col("b.number"))
    near = F.col(f"a.{time}").between(F.col(f"b.{time}") - F.expr(f"interval {delay}"), F.col(f"b.{time}") + F.expr(f"interval {delay}"))
    return a.join(b, same & near).select("a.source", "a.number", fused_flag([F.col("a.continuity"), F.col("b.continuity")]).alias("continuity"), F.col("a.data").alias("left"), F.col("b.data").alias("right"))


def to_table(stream: DataFrame, path: str, checkpoint: str, by: tuple[str, ...] = ("segment",)):
    """A query that appends to a Parquet folder until all that is there now is read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*by).trigger(availableNow=True).start()
