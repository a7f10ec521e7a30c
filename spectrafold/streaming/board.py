"""A board of named operators: what is wired to what, which streams run, and how they end.

Operators are functions from DataFrames to a DataFrame. A name is given once and inputs must
exist when an operator is started, so the graph has no cycle. Spark owns transport, state and
recovery: starting an operator only extends a plan, and run() starts a streaming query that goes
on from its checkpoint after a failure.
"""

from __future__ import annotations

import logging
import subprocess
import time
from collections.abc import Callable
from dataclasses import dataclass
from logging.handlers import RotatingFileHandler

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spectrafold.functions.scalars import Continuity
from spectrafold.operators import calibration, chunks


@dataclass(frozen=True)
class Order:
    """An input: the operator that it comes from, the name under which it is received, and the
    features asked for (receiver: sender; None: all as they are)."""

    source: str
    receiver: str
    features: tuple[tuple[str, str], ...] | None = None


def pause(attempt: int) -> float:
    """Seconds before a further attempt to connect."""
    return min(0.025 * 1.3**attempt, 15.0)


def connected(open_source: Callable[[], DataFrame], attempts: int = 10, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """A source that may not be there yet, tried again with growing pauses."""
    for k in range(attempts):
        try:
            return open_source()
        except Exception:
            if k == attempts - 1:
                raise
            wait(pause(k))
    raise ValueError("at least one attempt is needed")


def log_to(path: str, name: str = "spectrafold") -> logging.Logger:
    """A log of ten files of a megabyte at most."""
    log = logging.getLogger(name)
    log.addHandler(RotatingFileHandler(path, maxBytes=1_000_000, backupCount=10))
    log.setLevel(logging.INFO)
    return log


def provenance(folder: str = ".") -> dict[str, str]:
    """Revision, branch and whether there are changes, of a working copy; empty where there is none."""

    def git(*args: str) -> str:
        return subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=True).stdout.strip()

    try:
        return {"revision": git("rev-parse", "HEAD"), "branch": git("rev-parse", "--abbrev-ref", "HEAD"), "changed": str(bool(git("status", "--porcelain"))).lower()}
    except (OSError, subprocess.CalledProcessError):
        return {}


class Board:
    def __init__(self, log: logging.Logger | None = None):
        self.made: dict[str, DataFrame] = {}
        self.inputs: dict[str, tuple[str, ...]] = {}
        self.running: dict[str, StreamingQuery] = {}
        self.log = log or logging.getLogger("spectrafold")

    def start(self, name: str, operator: Callable[..., DataFrame], *orders: Order, required: tuple[str, ...] = (), **config) -> DataFrame:
        """The result of operator(receiver=input, ..., **config), known by name from now on."""
        if name in self.made:
            raise ValueError(f"{name} is taken")
        if missing := [o.source for o in orders if o.source not in self.made]:
            raise ValueError(f"{name} needs {missing}, which aren't there")
        received = [o.receiver for o in orders]
        if len(set(received)) < len(received) or required and set(received) != set(required):
            raise ValueError(f"{name} got inputs {received}, and needs {list(required) or 'each once'}")
        self.made[name] = operator(**{o.receiver: self.subscribe(o.source, o.features) for o in orders}, **config)
        self.inputs[name] = tuple(o.source for o in orders)
        self.log.info("started %s on %s", name, self.inputs[name])
        return self.made[name]

    def subscribe(self, name: str, features: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
        """What an operator gives: for another operator, or to look at."""
        if name not in self.made:
            raise ValueError(f"{name} isn't there")
        return self.made[name] if features is None else chunks.project(self.made[name], dict(features))

    def run(self, name: str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
        """A streaming query that appends what the operator gives to a Parquet folder."""
        if name in self.running and self.running[name].isActive:
            raise ValueError(f"{name} is running")
        writer = self.subscribe(name).writeStream.queryName(name).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        self.running[name] = writer.trigger(**(trigger or {"availableNow": True})).start()
        return self.running[name]

    def healthy(self) -> bool:
        """Whether no query has failed. If one has, those that run are stopped, as what hangs
        together ends together."""
        failed = [n for n, q in self.running.items() if q.exception() is not None]
        if failed:
            self.log.error("failed: %s", failed)
            self.stop_all()
        return not failed

    def stop(self, name: str) -> None:
        """Stop the query of an operator and of all that reads it."""
        for other, sources in self.inputs.items():
            if name in sources:
                self.stop(other)
        if name in self.running and self.running[name].isActive:
            self.running[name].stop()
            self.log.info("stopped %s", name)

    def stop_all(self) -> None:
        for name in self.running:
            self.stop(name)


def calibrate_stream(planes: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """A query that calibrates on chunks flagged CALIBRATION, and on no others, and saves the
    models under path/<source>/<number>. planes: source, number, continuity, scales, data (the
    plane scale by scale)."""

    def act(batch: DataFrame, _: int) -> None:
        # calibration chunks are rare, and each is a model's worth of noise
        for r in batch.filter(F.col("continuity") == int(Continuity.CALIBRATION)).select("source", "number", "scales").distinct().collect():
            one = batch.filter((F.col("source") == r.source) & (F.col("number") == r.number) & (F.col("continuity") == int(Continuity.CALIBRATION)))
            width = F.size("data") / F.lit(r.scales)
            cells = one.select(F.posexplode("data").alias("at", "value"), width.cast("int").alias("w")).select(F.floor(F.col("at") / F.col("w")).cast("int").alias("scale"), F.pmod("at", "w").alias("frame"), "value")
            for name, model in zip(("pattern", "areas"), calibration.calibrate(cells)):
                calibration.save(model, f"{path}/{r.source}/{r.number}/{name}")

    return planes.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
