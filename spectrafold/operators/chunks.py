"""Chunk streams: segments, composition, alignment and re-chunking.

A chunk is a row with a source, a number and a continuity flag. Windows are partitioned by
source; chunk tables have one row for thousands of samples, so a source's chunks are few even
where its samples are not. Nothing here depends on the order of partitions.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrafold.functions.scalars import Continuity

GOES_ON = int(Continuity.WITH_PREVIOUS)


@dataclass(frozen=True)
class Alignment:
    """What an operator's output lacks and lags, in frames of its rate and in scales."""

    included_past: int = 0
    dropped: int = 0
    small_scales: int = 0
    large_scales: int = 0
    rate: float | None = None
    alignable: bool = True
    event_like: bool = False

    def merge(self, other: Alignment) -> Alignment:
        """Of two inputs together: the larger of each. Rates must be equal."""
        if not (self.alignable and other.alignable) or self.rate != other.rate:
            raise ValueError("inputs must be alignable and of one rate")
        names = ("included_past", "dropped", "small_scales", "large_scales")
        return replace(self, alignable=True, **{n: max(getattr(self, n), getattr(other, n)) for n in names})

    def then(self, step: Alignment) -> Alignment:
        """After a further operator, whose frame counts are at its own rate."""
        if self.rate is None or step.rate is None:
            raise ValueError("rates are needed")
        to = lambda n: int(n * step.rate / self.rate) if step.rate != self.rate else n
        return Alignment(to(self.included_past) + step.included_past, to(self.dropped) + step.dropped, self.small_scales + step.small_scales, self.large_scales + step.large_scales, step.rate, self.alignable and step.alignable, step.event_like)


def require_columns(df: DataFrame, names: list[str], exact: bool = False) -> DataFrame:
    """df, or a ValueError at plan time if columns are missing, or unexpected with exact."""
    missing, extra = [n for n in names if n not in df.columns], [c for c in df.columns if c not in names]
    if missing or exact and extra:
        raise ValueError(f"missing columns {missing}, unexpected ones {extra if exact else []}")
    return df


def project(features: DataFrame, orders: dict[str, str], by: tuple[str, ...] = ("source", "number", "continuity")) -> DataFrame:
    """The features that a subscriber asks for, under its own names (receiver: sender). A sender
    '*' gives a tick: a row without a payload."""
    return features.select(*by, *[(F.lit(None).cast("double") if sender == "*" else F.col(sender)).alias(name) for name, sender in orders.items()])


def with_results(features: DataFrame, column: str) -> DataFrame:
    """Without rows in which an operator had no result."""
    return features.filter(F.col(column).isNotNull())


def not_empty(features: DataFrame, column: str, strict: bool = True) -> DataFrame:
    """A result of no length is an error at run time; without strict such rows go."""
    size = F.size(column) > 0
    if not strict:
        return features.filter(size)
    return features.filter(F.coalesce(F.assert_true(size, f"{column} has no length").isNull(), F.lit(True)))


def with_end(chunks: DataFrame, by: str = "source") -> DataFrame:
    """chunks with one more for each source: zeros as long as the last chunk, flagged LAST, so
    that what waits for more is flushed. Its data are mock data, which sinks leave out."""
    last = chunks.groupBy(by).agg(F.max_by(F.struct("*"), "number").alias("x")).select("x.*")
    gone = {"number": F.col("number") + 1, "continuity": F.lit(int(Continuity.LAST)).cast("int"), "data": F.transform("data", lambda v: v * 0)}
    if {"start_time", "fs"} <= set(chunks.columns):
        gone["start_time"] = F.col("start_time") + F.size("data") / F.col("fs")
    return chunks.withColumn("continuity", F.col("continuity").cast("int")).unionByName(last.withColumns(gone))


def numbered(rows: DataFrame, by: str, order: str, name: str = "frame", block: int = 1 << 16) -> DataFrame:
    """rows with a number from 0 within `by`, in the order of a whole-numbered column without
    ties. Ranges of the order are numbered apart, and what stands before each is a sum over
    their counts, so a source of any size is never one task's work."""
    cut = rows.withColumn("__range", F.floor(F.col(order) / block))
    counts = cut.groupBy(by, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    rank = F.row_number().over(Window.partitionBy(by, "__range").orderBy(order)) - 1
    return cut.withColumn("__rank", rank).join(counts, [by, "__range"]).withColumn(name, F.col("__before") + F.col("__rank")).drop("__range", "__rank", "__before")


def segments(chunks: DataFrame, by: str = "source") -> DataFrame:
    """chunks with corrected (the flag, 0 where a continuing chunk has no direct predecessor)
    and segment (counted from 1 by source)."""
    w = Window.partitionBy(by).orderBy("number")
    lost = F.coalesce(F.lag("number").over(w) != F.col("number") - 1, F.lit(True))
    flagged = chunks.withColumn("corrected", F.when((F.col("continuity") >= GOES_ON) & lost, int(Continuity.DISCONTINUOUS)).otherwise(F.col("continuity")).cast("int"))
    return flagged.withColumn("segment", F.sum((F.col("corrected") < GOES_ON).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def fused_flag(flags: list[Column]) -> Column:
    """The flag of a composite: the lowest of those that don't continue, else continuing."""
    stops = F.array_min(F.filter(F.array(*flags), lambda f: f != GOES_ON))
    return F.coalesce(stops, F.lit(GOES_ON)).cast("int")


def compose(inputs: dict[str, DataFrame], by: tuple[str, ...] = ("source", "number")) -> DataFrame:
    """Rows present in all inputs, each input as a struct named by its key, with the fused
    continuity. Inputs have the columns of `by`, continuity and others."""
    parts = [df.select(*by, F.struct(*[F.col(c) for c in df.columns if c not in by]).alias(key)) for key, df in inputs.items()]
    joined = reduce(lambda a, b: a.join(b, list(by)), parts)
    return joined.withColumn("continuity", fused_flag([F.col(f"{k}.continuity") for k in inputs]))


def in_completion_order(composites: DataFrame, completed: str = "completed", by: str = "source") -> DataFrame:
    """Without composites that a later chunk's completion overtook."""
    w = Window.partitionBy(by).orderBy(completed, "number").rowsBetween(Window.unboundedPreceding, -1)
    return composites.withColumn("__top", F.max("number").over(w)).filter(F.col("__top").isNull() | (F.col("number") > F.col("__top"))).drop("__top")


def initial_sample_time(start: Column, corrected: Column, a: Alignment) -> Column:
    """Time of the first aligned sample of a chunk."""
    return F.when(corrected >= GOES_ON, start - a.included_past / a.rate).otherwise(start + a.dropped / a.rate)


def coverage(number: Column, corrected: Column, width: int, a: Alignment) -> tuple[Column, Column]:
    """[first, past the last) absolute frames that a chunk of nominal width holds."""
    first = number * width + F.when(corrected >= GOES_ON, -a.included_past).otherwise(a.dropped)
    return first, (number + 1) * width - a.included_past


def align(features: dict[str, DataFrame], on: tuple[str, ...] = ("source", "segment", "frame")) -> DataFrame:
    """Cells of several features that share an absolute frame; value columns by feature."""
    parts = [df.select(*on, F.col("value").alias(k)) for k, df in features.items()]
    return reduce(lambda a, b: a.join(b, list(on)), parts)


def provenance(composites: DataFrame, keys: list[str]) -> DataFrame:
    """composites with sources (the sorted union) and metadata (earlier keys win)."""
    merged = reduce(lambda a, b: F.map_concat(a, F.map_filter(b, lambda k, _: ~F.map_contains_key(a, k))), [F.coalesce(F.col(f"{k}.metadata"), F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))")) for k in keys])
    return composites.withColumn("sources", F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{k}.sources") for k in keys]))))).withColumn("metadata", merged)


def consistent(composites: DataFrame, keys: list[str], columns: tuple[str, ...] = ("start_time", "identifier")) -> DataFrame:
    """composites; an error at run time if the inputs disagree in one of the columns."""
    for c in columns:
        for k in keys[1:]:
            same = F.col(f"{keys[0]}.{c}").eqNullSafe(F.col(f"{k}.{c}"))
            composites = composites.filter(F.coalesce(F.assert_true(same, f"inputs differ in {c}").isNull(), F.lit(True)))
    return composites


def rechunk(samples: DataFrame, size: int, by: tuple[str, ...] = ("source", "segment")) -> DataFrame:
    """samples (by, frame from 0 in the segment, value) with chunk and position; chunks that
    aren't full are dropped, as they wait for more. Frames number the samples, so no global
    order is needed."""
    placed = samples.withColumn("chunk", F.floor(F.col("frame") / size)).withColumn("position", F.pmod("frame", F.lit(size)))
    full = placed.groupBy(*by, "chunk").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == size).drop("__n")
    return placed.join(full, [*by, "chunk"])


def decimate(samples: DataFrame, factor: int, phase: Column | int = 0) -> DataFrame:
    """Every factor-th sample of a segment, renumbered. phase: samples that an earlier segment
    left over, to carry it across segments."""
    at = F.col("frame") + (F.lit(phase) if isinstance(phase, int) else phase)
    return samples.filter(F.pmod(at, F.lit(factor)) == 0).withColumn("frame", F.floor(at / factor))


def drifted(chunks: DataFrame, tolerance: float, by: str = "source") -> DataFrame:
    """chunks with drift: whether a start differs by more than the tolerance, in seconds, from
    what the chunks before it in the segment say."""
    w = Window.partitionBy(by, "segment").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("start_time").over(Window.partitionBy(by, "segment").orderBy("number").rowsBetween(Window.unboundedPreceding, 0))
    due = first + F.coalesce(F.sum(F.col("n_samples") / F.col("fs")).over(w), F.lit(0.0))
    return chunks.withColumn("drift", F.abs(F.col("start_time") - due) > tolerance)
