"""Writing features and reading them again.

Parquet folders partitioned by date, location and segment take the place of appended array
files: Spark names and rolls the files, a new segment is a new partition, and a re-run of a
batch overwrites its own partitions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafold.functions.scalars import location


def located(features: DataFrame, identifier: str = "identifier", day: str | None = None) -> DataFrame:
    """features with date and location columns; the day of writing unless one is given."""
    when = F.current_date() if day is None else F.to_date(F.lit(day))
    return features.withColumn("date", when).withColumn("location", location(F.col(identifier)))


def append(features: DataFrame, path: str, by: tuple[str, ...] = ("date", "location", "segment"), kinds: dict[str, str] | None = None, most_records: int = 10_000_000) -> None:
    """Append; kinds casts columns on the way. Mock data of end chunks (continuity 11) and
    chunks of no length stay out."""
    out = features.filter("continuity is null or continuity <> 11") if "continuity" in features.columns else features
    if dict(out.dtypes).get("data", "").startswith("array"):
        out = out.filter(F.size("data") > 0)
    for name, kind in (kinds or {}).items():
        out = out.withColumn(name, F.col(name).cast(kind))
    out.write.mode("append").option("maxRecordsPerFile", most_records).partitionBy(*[c for c in by if c in out.columns]).parquet(path)


def as_json(features: DataFrame) -> DataFrame:
    return features.select(F.to_json(F.struct("*")).alias("value"))


def chunk_marks(chunks: DataFrame, every: int = 100) -> DataFrame:
    """First and last time of each source and the numbers of every hundredth chunk."""
    return chunks.groupBy("source").agg(F.min("start_time").alias("first_time"), F.max("start_time").alias("last_time"), F.array_sort(F.collect_list(F.when(F.col("number") % every == 0, F.col("number")))).alias("marks"))


def client_metadata(known: DataFrame, new: DataFrame) -> DataFrame:
    """source, key, value, and whether new values differ from known ones, which are kept."""
    old = known.select("source", "key", F.col("value").alias("__old"))
    got = old.join(new.select("source", "key", F.col("value").alias("__new")), ["source", "key"], "full")
    return got.select("source", "key", F.coalesce("__old", "__new").alias("value"), F.coalesce(F.col("__old") != F.col("__new"), F.lit(False)).alias("mismatch"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
