"""Sharding by fixed virtual slots.

Records are hashed into SLOTS virtual slots, whose number never changes. The bytes of each
slot are summed, and a slot-to-shard map places the slots on shards, largest first, each on
the shard with the fewest bytes. The map is a small versioned table; rebalancing edits it by
moving as few slots as it can and records that move no slot are untouched.

Everything is DataFrame expressions: the map is made by one aggregation over the SLOTS rows
of the slot table, a fixed number whatever the input, which is also why it is broadcast.

Nulls: a null text has no bytes and counts 1; a null id is hashed like any value. Repeated
rows share a slot and a shard. Empty tables give no rows and an empty map. Other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """id_col, size, text_crc32, virtual_slot."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return slim.withColumn("virtual_slot", F.pmod(F.xxhash64(F.col(id_col), "text_crc32", "size"), F.lit(slots)).cast("int"))


def slot_table(recs: DataFrame) -> DataFrame:
    """virtual_slot, bytes, rows: at most one row for each slot."""
    return recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _place(slots: Column, loads: Column) -> Column:
    """Each of the sorted slots goes to the shard with the least load so far."""

    def step(acc, s):
        shard = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        return F.struct(
            F.transform(acc["loads"], lambda x, i: F.when(i == shard, x + s["bytes"]).otherwise(x)).alias("loads"),
            F.concat(acc["map"], F.array(F.struct(s["virtual_slot"].alias("virtual_slot"), shard.alias("shard"), s["bytes"].alias("bytes"), s["rows"].alias("rows")))).alias("map"),
        )

    empty = F.expr("cast(array() as array<struct<virtual_slot:int,shard:int,bytes:bigint,rows:bigint>>)")
    return F.aggregate(slots, F.struct(loads.alias("loads"), empty.alias("map")), step, lambda acc: acc["map"])


def build_map(table: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """virtual_slot, shard, bytes, rows, version from a slot table."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "bytes", "rows")))
    placed = table.agg(order.alias("s")).select(F.explode(_place(F.col("s"), F.array_repeat(F.lit(0).cast("long"), shards))).alias("m"))
    return placed.select("m.*", F.lit(version).alias("version"))


def rebalance(slot_map: DataFrame, table: DataFrame, shards: int) -> DataFrame:
    """The next version of slot_map for new sums and shards from 0 to shards - 1.

    A shard keeps its slots, largest first, as long as they fit into an equal share of the
    bytes; slots beyond that, new slots and those of shards that are gone are placed anew on
    the shard with the least load. With one more shard and unchanged sums, slots move only to
    the new shard as long as no shard was over its share."""
    now = table.join(F.broadcast(slot_map.select("virtual_slot", "shard", "version")), "virtual_slot", "left")
    share = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards)
    run = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    now = now.withColumn("share", share).withColumn("kept", (F.col("shard") < shards) & (F.sum("bytes").over(run) <= F.col("share")))
    s = F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "bytes", "rows")
    one = now.agg(
        F.array_sort(F.collect_list(F.when(~F.coalesce("kept", F.lit(False)), s))).alias("moving"),
        F.array_agg(F.when(F.col("kept"), F.struct("virtual_slot", "shard", "bytes", "rows"))).alias("staying"),
        F.coalesce(F.max("version"), F.lit(0)).alias("version"),
    )
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.aggregate("staying", F.lit(0).cast("long"), lambda a, x: a + F.when(x["shard"] == i, x["bytes"]).otherwise(0)))
    return one.select(F.explode(F.concat("staying", _place(F.col("moving"), loads))).alias("m"), (F.col("version") + 1).alias("version")).select("m.*", "version")


def save_map(slot_map: DataFrame, path: str) -> None:
    """Store a version of a map in a folder of its own; earlier versions stay, and of two writers
    of one version the second fails. An empty map is not stored."""
    versions = [r[0] for r in slot_map.select("version").distinct().collect()]  # one
    for v in versions:
        slot_map.filter(F.col("version") == v).drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={v}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The given version of a stored map, else the newest."""
    got = spark.read.option("basePath", path).parquet(path)
    newest = version if version is not None else got.agg(F.max("version")).first()[0]
    return got.filter(F.col("version") == newest)


def assign(recs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """recs with shard and place, a number from 0 without gaps within the shard.

    Each slot numbers its own rows, and the slots of a shard follow one another, so no task
    ever holds a shard."""
    slots = F.broadcast(slot_map.select("virtual_slot", "shard", (F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__before")))
    w = Window.partitionBy("virtual_slot").orderBy(recs[recs.columns[0]], "text_crc32", "size")
    return recs.withColumn("__rank", F.row_number().over(w)).join(slots, "virtual_slot").withColumn("place", F.col("__before") + F.col("__rank") - 1).drop("__before", "__rank")
