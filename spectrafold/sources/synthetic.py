"""Synthetic signals as tables: source, segment, frame, value. Made where they are read."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _samples(spark: SparkSession, n: int, source: str) -> DataFrame:
    return spark.range(n).select(F.lit(source).alias("source"), F.lit(1).cast("long").alias("segment"), F.col("id").alias("frame"))


def sine(spark: SparkSession, n: int, rate: float = 8000.0, frequency: float = 1000.0, amplitude: float = 2000.0, source: str = "sine") -> DataFrame:
    return _samples(spark, n, source).withColumn("value", amplitude * F.sin(2 * math.pi * frequency / rate * F.col("frame")))


def noise(spark: SparkSession, n: int, seed: int = 1, source: str = "noise") -> DataFrame:
    return _samples(spark, n, source).withColumn("value", F.randn(seed))


def noise_chunks(spark: SparkSession, size: int, count: int = 1, calibration: bool = False, rate: float = 8000.0, seed: int = 1, source: str = "noise") -> DataFrame:
    """`count` chunks of normal noise, the last one flagged LAST; for a calibration a single one
    flagged so."""
    n = 1 if calibration else count
    flag = F.lit(2) if calibration else F.when(F.col("number") == n - 1, 11).otherwise(F.col("continuity"))
    return chunked(noise(spark, n * size, seed, source), size, rate).withColumn("continuity", flag.cast("int"))


def noise_plane(spark: SparkSession, scales: int, frames: int, seed: int = 1, source: str = "noise") -> DataFrame:
    """A calibration plane of independent cells."""
    got = spark.range(scales * frames).select(F.lit(source).alias("source"), F.lit(1).cast("long").alias("segment"), F.floor(F.col("id") / frames).cast("int").alias("scale"), F.pmod("id", F.lit(frames)).alias("frame"))
    return got.withColumn("value", F.randn(seed))


def dither(samples: DataFrame, amount: float, integral: bool = False, seed: int = 1) -> DataFrame:
    """Additive noise: uniform within half of amount, or the sum of `amount` fair coins less
    their mean for integral samples."""
    if integral:
        coins = sum((F.floor(F.rand(seed + k) * 2) for k in range(int(amount))), F.lit(0)) - amount / 2
        return samples.withColumn("value", F.col("value") + coins)
    return samples.withColumn("value", F.col("value") + (F.rand(seed) - 0.5) * amount)


def chunked(samples: DataFrame, size: int, rate: float) -> DataFrame:
    """Chunk rows (source, number, continuity, start_time, fs, data) of samples; the last may
    be short. A chunk's samples are gathered, never a source's."""
    at = samples.withColumn("number", F.floor(F.col("frame") / size))
    got = at.groupBy("source", "number").agg(F.array_sort(F.collect_list(F.struct("frame", "value"))).alias("x"))
    return got.select("source", "number", F.when(F.col("number") == 0, 1).otherwise(10).alias("continuity"), (F.col("number") * size / rate).alias("start_time"), F.lit(float(rate)).alias("fs"), F.transform("x", lambda v: v["value"]).alias("data"))


def samples_of(chunks: DataFrame, size: int) -> DataFrame:
    """Samples again from chunks of a nominal size."""
    x = chunks.select("source", "number", F.posexplode("data").alias("at", "value"))
    return x.select("source", F.lit(1).cast("long").alias("segment"), (F.col("number") * size + F.col("at")).alias("frame"), F.col("value").cast("double").alias("value"))
