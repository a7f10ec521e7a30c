"""Patches of a plane that arrives in chunks, with their identity across chunks.

State is kept by source: the labels and levels of the last frame, and the descriptors of the
patches that reach it, so it is bounded by the scales. A patch is given out once, when no later
chunk can go on with it; what was given out is never changed. A gap, or a flag below
WITH_PREVIOUS, closes all open patches and starts a new segment; a LAST chunk closes them and its
mock data are not looked at. Empty chunks only count. Late chunks are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spectrafold.functions.scalars import Continuity
from spectrafold.operators.patches import label_grid

COLUMNS = ("serial", "level", "t_low", "t_high", "s_low", "s_high", "size")
_STATE = "number long, segment long, frame long, serial long, levels array<long>, labels array<long>, held array<long>"


class Seam:
    """Open patches and the last frame of a segment."""

    def __init__(self, frame: int = 0, serial: int = 1, levels=(), labels=(), held=()):
        self.frame, self.serial = frame, serial
        self.levels, self.labels = list(levels), list(labels)
        self.held = {int(r[0]): [int(v) for v in r[1:]] for r in np.array(held, np.int64).reshape(-1, len(COLUMNS))}

    def close(self) -> list[tuple]:
        done, self.held, self.levels, self.labels = [(k, *v) for k, v in self.held.items()], {}, [], []
        return done

    def add(self, levels: np.ndarray) -> list[tuple]:
        """Patches that are finished once a chunk of levels [scales x frames] has come."""
        own = label_grid(levels) + self.serial
        s, t = np.indices(levels.shape)
        n = int(own.max()) - self.serial + 1
        at = own.reshape(-1) - self.serial
        ends = [np.full(n, 1 << 60), np.full(n, -1), np.full(n, 1 << 60), np.full(n, -1)]
        for k, (x, f) in enumerate(((t, np.minimum), (t, np.maximum), (s, np.minimum), (s, np.maximum))):
            f.at(ends[k], at, x.reshape(-1))
        level = np.zeros(n, np.int64)
        level[at] = levels.reshape(-1)
        size = np.bincount(at, minlength=n)
        for k in range(n):
            self.held[self.serial + k] = [int(level[k]), int(ends[0][k]) + self.frame, int(ends[1][k]) + self.frame, int(ends[2][k]), int(ends[3][k]), int(size[k])]
        up = {k: k for k in self.held}

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for before, old, new, now in zip(self.levels, self.labels, own[:, 0].tolist(), levels[:, 0].tolist()):
            if before == now:
                a, b = sorted((find(old), find(new)))
                up[b] = a
        whole: dict[int, list[int]] = {}
        for k, v in self.held.items():
            w = whole.get(find(k))
            whole[find(k)] = v if w is None else [w[0], min(w[1], v[1]), max(w[2], v[2]), min(w[3], v[3]), max(w[4], v[4]), w[5] + v[5]]
        self.levels, self.labels = levels[:, -1].tolist(), [find(k) for k in own[:, -1].tolist()]
        going = set(self.labels)
        self.held = {k: v for k, v in whole.items() if k in going}
        self.serial += n
        self.frame += levels.shape[1]
        return [(k, *v) for k, v in whole.items() if k not in going]


def patch_stream(chunks: DataFrame, scales: int, edges: tuple[float, ...] = (0.0, 20.0, 60.0)) -> DataFrame:
    """source, segment and COLUMNS of finished patches. chunks: source, number, continuity and
    data, the plane of a chunk scale by scale. A cell's level is the number of edges below it
    less one."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, segment, *rest = state.get if state.exists else (None, 0)
        seam, done = Seam(*rest), []
        for r in pd.concat(list(frames)).sort_values(["number"], kind="stable").itertuples():
            if number is not None and r.number <= number:
                continue
            if number is None or r.number != number + 1 or r.continuity < Continuity.WITH_PREVIOUS:
                done += [(segment, *x) for x in seam.close()]
                segment, seam = segment + 1, Seam()
            number = int(r.number)
            plane = np.asarray(r.data, float).reshape(scales, -1)
            if r.continuity == Continuity.LAST:
                done += [(segment, *x) for x in seam.close()]
            elif plane.shape[1]:
                levels = sum(((plane > e).astype(np.int64) for e in edges), np.full(plane.shape, -1))
                done += [(segment, *x) for x in seam.add(levels)]
        held = [v for k, x in seam.held.items() for v in (k, *x)]
        state.update((number, segment, seam.frame, seam.serial, seam.levels, seam.labels, held))
        if done:
            yield pd.DataFrame(done, columns=["segment", *COLUMNS]).assign(source=key[0])[["source", "segment", *COLUMNS]]

    slim = chunks.select("source", "number", "continuity", "data")
    kinds = ", ".join(f"{c} long" for c in ("segment", *COLUMNS))
    got = slim.groupBy("source").applyInPandasWithState(run, f"source string, {kinds}", _STATE, "append", GroupStateTimeout.NoTimeout)
    return got.withColumn("segment", F.abs("segment"))  # rows for the writer
