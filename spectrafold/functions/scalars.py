"""Scalar column functions of the time-frequency operators."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Continuity(IntEnum):
    """How a chunk relates to the one before it; from WITH_PREVIOUS on it continues it."""

    INVALID = -1
    DISCONTINUOUS = 0
    NEW_FILE = 1
    CALIBRATION = 2
    WITH_PREVIOUS = 10
    LAST = 11


def gate(x: Column, threshold: float, slope: float) -> Column:
    """A soft step from 0 to 1 around the threshold."""
    return (1 + F.tanh((x - threshold) * slope)) / 2


def power_db(energy: Column) -> Column:
    """Decibels of an energy; null where there is none."""
    return 10 * F.log10(F.when(energy > 0, energy))


def amplitude_db(x: Column) -> Column:
    return 20 * F.log10(F.when(F.abs(x) > 0, F.abs(x)))


def quantize_log(x: Column) -> Column:
    """The integer part of the natural logarithm, null where there is none."""
    return F.floor(F.log(F.when(x > 0, x))).cast("int")


def quantize_floor(x: Column, step: float = 20.0, shift: float = -30.0) -> Column:
    return (step * F.floor(x / step) + shift).cast("int")


def quantize_texture(x: Column, edges: tuple[float, ...] = (0.0, 20.0, 60.0)) -> Column:
    """-1, and one more for every edge that x is above; a null or NaN is at -1."""
    level = F.lit(-1)
    for e in edges:
        level = level + F.when((x > e) & ~F.isnan(x), 1).otherwise(0)
    return level.cast("int")


def round_away(x: Column) -> Column:
    return (F.signum(x) * F.ceil(F.abs(x))).cast("int")


def erb_rate(f: Column, b: float, c: float) -> Column:
    """Place on the ERB scale of a frequency."""
    return F.log(b * f + c)


def erb_frequency(e: Column, b: float, c: float) -> Column:
    return (F.exp(e) - c) / b


def fingerprint(config: dict[str, Column]) -> Column:
    """SHA-1 of the JSON of a configuration, its keys sorted, so their order doesn't matter."""
    return F.sha1(F.to_json(F.struct(*[config[k].alias(k) for k in sorted(config)])).cast("binary"))


def identifier(source: Column, serial: Column) -> Column:
    """A name for what a source numbers, the same in every run."""
    return F.sha2(F.concat_ws("/", source.cast("string"), serial.cast("string")), 256)


def location(identifier: Column) -> Column:
    """The base name of a path, spaces replaced."""
    return F.regexp_replace(F.element_at(F.split(identifier, "/"), -1), " ", "_")
