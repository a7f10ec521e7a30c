"""Helpers shared by the corpus operators: scratch tables, words, tables of a folder."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE_SPLIT = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: spark.checkpoint.dir of the session.
    Only where that is unset and the master is local, as in tests, one of this machine is made;
    on a cluster a missing setting is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spectrafold-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts the lineage
    and survives lost executors, which no cache on the executors does."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/spectrafold/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Remove what materialize() wrote for these tables, when all that reads them is done."""
    for t in tables:
        folders = {f.rsplit("/", 1)[0] for f in t.inputFiles()}
        for folder in folders:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            if "/spectrafold/" in folder:
                path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """row (a struct of all columns) and the named columns, which thus clash with none."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def unpacked(df: DataFrame, columns: list[str], new: dict[str, Column] | None = None) -> DataFrame:
    """The columns of packed() again, some of them replaced."""
    return df.select(*[((new or {}).get(c, F.col("row").getField(c))).alias(c) for c in columns])


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Array of the runs of characters other than \\x20 and \\x09-\\x0D; null: empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_SPLIT), lambda w: w != "")


def trim() -> None:
    """Give freed memory of this Python worker back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m"):
    """Arrow batches of few rows for the actions within, so that long rows stay within memory."""
    ours = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in ours}
    try:
        for k, v in ours.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
