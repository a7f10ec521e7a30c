"""Connected patches of a quantised plane, and their descriptors.

Planes are labelled in tiles of frames, in parallel and within bounded memory; only cells on
the seams between tiles become edges of a graph, whose components join the tiles' labels. A
patch's label is the rank of its smallest cell in row-major order, as if the plane had been
scanned as a whole, so tiling never shows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TILE = 2048


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder of the session and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spectrafold/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder of its own only where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")

        base = tempfile.mkdtemp(prefix="spectrafold-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def label_grid(levels: np.ndarray) -> np.ndarray:
    """Labels of the 4-neighbour components of equal cells of a small grid, in row-major order
    of first appearance, by union of roots with vectorised passes."""
    rows, cols = levels.shape
    root = np.arange(rows * cols).reshape(rows, cols)
    right, down = levels[:, 1:] == levels[:, :-1], levels[1:] == levels[:-1]
    while True:
        low = root.copy()
        np.minimum(low[:, 1:], root[:, :-1], out=low[:, 1:], where=right)
        np.minimum(low[:, :-1], root[:, 1:], out=low[:, :-1], where=right)
        np.minimum(low[1:], root[:-1], out=low[1:], where=down)
        np.minimum(low[:-1], root[1:], out=low[:-1], where=down)
        flat, old = root.reshape(-1).copy(), root.reshape(-1)
        np.minimum.at(flat, old, low.reshape(-1))
        while True:
            hop = flat[flat]
            if np.array_equal(hop, flat):
                break
            flat = hop
        if np.array_equal(flat, old):
            return np.unique(flat, return_inverse=True)[1].reshape(rows, cols)
        root = flat.reshape(rows, cols)


def _local(cells: DataFrame, tile: int) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        s, f, v = (t.column(c).to_numpy() for c in ("scale", "frame", "level"))
        s0, f0 = s.min(), f.min()
        grid = np.full((s.max() - s0 + 1, f.max() - f0 + 1), np.iinfo(np.int64).min)
        grid[s - s0, f - f0] = v
        own = label_grid(grid)[s - s0, f - f0]
        return t.append_column("local", pa.array(own.astype(np.int64)))

    kinds = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in ("source", "segment"))
    slim = cells.select("source", "segment", F.col("scale").cast("long").alias("scale"), F.col("frame").cast("long").alias("frame"), F.col("level").cast("long").alias("level")).withColumn("tile", F.floor(F.col("frame") / tile))
    return slim.groupBy("source", "segment", "tile").applyInArrow(run, f"{kinds}, scale long, frame long, level long, tile long, local long")


def seam_edges(labelled: DataFrame, tile: int = TILE) -> DataFrame:
    """Pairs of local labels of equal level that touch across a seam: source, segment, tile,
    local, next_local, where next_local is of the tile after."""
    left = labelled.filter(F.pmod(F.col("frame") + 1, F.lit(tile)) == 0).select("source", "segment", "tile", "scale", "level", "local")
    right = labelled.filter(F.pmod("frame", F.lit(tile)) == 0).select("source", "segment", (F.col("tile") - 1).alias("tile"), "scale", "level", F.col("local").alias("next_local"))
    return left.join(right, ["source", "segment", "tile", "scale", "level"]).select("source", "segment", "tile", "local", "next_local").distinct()


def chunk_patches(cells: DataFrame, width: int) -> DataFrame:
    """label_patches() with what each chunk of `width` frames says on its own: chunk, local (its
    label there), serial (local plus one and the patches of all chunks before)."""
    lab = shared_table(label_patches(cells, width, parts=True), "parts")
    counts = lab.groupBy("source", "segment", "tile").agg((F.max("local") + 1).alias("n"))
    before = Window.partitionBy("source", "segment").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source", "segment", "tile", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    got = lab.join(counts, ["source", "segment", "tile"])
    return got.select("source", "segment", "scale", "frame", "level", "patch", F.col("tile").alias("chunk"), "local", (F.col("before") + F.col("local") + 1).alias("serial"))


def label_patches(cells: DataFrame, tile: int = TILE, parts: bool = False) -> DataFrame:
    """source, segment, scale, frame, level, patch for cells with an integer level; parts: tile
    and local, the label within the tile, too."""
    labelled = shared_table(_local(cells, tile), "tiles")
    n_frames = labelled.groupBy("source", "segment").agg(F.max("frame").alias("__last"))
    key = ["source", "segment", "tile", "local"]
    first = labelled.join(n_frames, ["source", "segment"]).groupBy(*key).agg(F.min(F.col("scale") * (F.col("__last") + 1) + F.col("frame")).alias("first"))
    first = shared_table(first, "firsts")
    e = seam_edges(labelled, tile)
    a = first.select("source", "segment", "tile", "local", F.col("first").alias("a"))
    b = first.select("source", "segment", (F.col("tile") - 1).alias("tile"), F.col("local").alias("next_local"), F.col("first").alias("b"))
    edges = e.join(a, key).join(b, ["source", "segment", "tile", "next_local"]).select("source", "segment", "a", "b")
    roots = _components(edges)
    named = first.join(roots.withColumnRenamed("node", "first"), ["source", "segment", "first"], "left").withColumn("root", F.coalesce("root", "first"))
    # ranks within a segment: patches of a range of cells are counted apart, ranges are few
    distinct = named.select("source", "segment", "root").distinct().withColumn("range", F.floor(F.col("root") / 1_000_000))
    before = Window.partitionBy("source", "segment").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = distinct.groupBy("source", "segment", "range").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranks = distinct.withColumn("rank", F.row_number().over(Window.partitionBy("source", "segment", "range").orderBy("root"))).join(ranges, ["source", "segment", "range"]).select("source", "segment", "root", (F.col("before") + F.col("rank") - 1).alias("patch"))
    return labelled.join(named.join(ranks, ["source", "segment", "root"]).select(*key, "patch"), key).select("source", "segment", "scale", "frame", "level", "patch", *(["tile", "local"] if parts else []))


def _components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest that can be reached) by segment. Labels spread along edges
    and jump to their label's label, so rounds are few; each round is a table of its own."""
    on = ["source", "segment"]
    both = edges.filter("a != b").select(*on, F.col("a").alias("node"), F.col("b").alias("other"))
    both = shared_table(both.unionAll(both.select(*on, F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "seams")
    now = shared_table(both.groupBy(*on, "node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "roots")
    while True:
        near = both.join(now.select(*on, F.col("node").alias("other"), "root"), [*on, "other"]).groupBy(*on, "node").agg(F.min("root").alias("low"))
        low = now.join(near, [*on, "node"], "left").select(*on, "node", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        hop = now.select(*on, F.col("node").alias("root"), F.col("root").alias("further"))
        new = shared_table(low.join(hop, [*on, "root"], "left").select(*on, "node", "was", F.least("root", "further").alias("root")), "roots")
        if new.filter("was != root").isEmpty():
            return new.select(*on, "node", "root")
        now = new.drop("was")


def descriptors(patches: DataFrame) -> DataFrame:
    """level, t_low, t_high, s_low, s_high and size of each patch."""
    return patches.groupBy("source", "segment", "patch").agg(F.min("level").alias("level"), F.min("frame").alias("t_low"), F.max("frame").alias("t_high"), F.min("scale").alias("s_low"), F.max("scale").alias("s_high"), F.count(F.lit(1)).alias("size"))


def timed(described: DataFrame, rate: float, offset: float = 0.0) -> DataFrame:
    """Descriptors with times, height and fill ratio (size over seconds times scales)."""
    got = described.withColumns({"t_start": F.col("t_low") / rate + offset, "t_end": (F.col("t_high") + 1) / rate + offset, "height": F.col("s_high") - F.col("s_low") + 1})
    got = got.withColumn("duration", F.col("t_end") - F.col("t_start"))
    return got.withColumn("fill_ratio", F.col("size") / (F.col("duration") * F.col("height")))


def in_scale(patches: DataFrame) -> DataFrame:
    """Cells and first and last frame of each patch at each of its scales."""
    return patches.groupBy("source", "segment", "patch", "scale").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("lower"), F.max("frame").alias("upper"))


def in_frame(patches: DataFrame) -> DataFrame:
    """Cells and lowest and highest scale of each patch at each of its frames."""
    return patches.groupBy("source", "segment", "patch", "frame").agg(F.count(F.lit(1)).alias("n"), F.min("scale").alias("lower"), F.max("scale").alias("upper"))


def means(patches: DataFrame, observed: DataFrame, along: str = "scale") -> DataFrame:
    """Mean of an observable within each patch by scale or by frame."""
    got = patches.join(observed.select("source", "segment", "scale", "frame", "value"), ["source", "segment", "scale", "frame"])
    return got.groupBy("source", "segment", "patch", along).agg(F.avg("value").alias("mean"))


def mask(patches: DataFrame, number: int) -> DataFrame:
    return patches.select("source", "segment", "scale", "frame", (F.col("patch") == number).cast("int").alias("mask"))


def touching(described: DataFrame, extent: DataFrame) -> DataFrame:
    """Patches that reach the last frame of their segment, which a later chunk may go on with."""
    last = extent.select("source", "segment", (F.col("n_frames") - 1).alias("t_high"))
    return described.join(last, ["source", "segment", "t_high"], "left_semi")


def finished(described: DataFrame, extent: DataFrame) -> DataFrame:
    last = extent.select("source", "segment", (F.col("n_frames") - 1).alias("t_high"))
    return described.join(last, ["source", "segment", "t_high"], "left_anti")


def merged(parts: DataFrame, into: DataFrame) -> DataFrame:
    """Descriptors of parts joined by a map (source, segment, patch, final): ranges are united
    and sizes summed. Of parts with a serial the smallest stays, of those with an identifier
    that of the last to end, and of these the one with the largest serial."""
    got = parts.join(into, ["source", "segment", "patch"])
    more = [F.min("serial").alias("serial")] if "serial" in parts.columns else []
    more += [F.max_by("identifier", F.struct("t_high", *(["serial"] if more else ["identifier"]))).alias("identifier")] if "identifier" in parts.columns else []
    return got.groupBy("source", "segment", "final").agg(F.min("level").alias("level"), F.min("t_low").alias("t_low"), F.max("t_high").alias("t_high"), F.min("s_low").alias("s_low"), F.max("s_high").alias("s_high"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts"), *more)


def merged_rows(parts: DataFrame, into: DataFrame, along: str) -> DataFrame:
    """What parts say for each of their scales or frames, merged: counts n are summed, means
    weighted by them, lower and upper ends united. parts: source, segment, patch, the column
    `along`, n, lower, upper, mean. A place between the first and the last of the whole that no
    part has gets the count and mean 0 and no ends."""
    got = parts.join(into, ["source", "segment", "patch"])
    key = ["source", "segment", "final"]
    rows = got.groupBy(*key, along).agg(F.sum("n").alias("n"), F.min("lower").alias("lower"), F.max("upper").alias("upper"), F.sum(F.col("mean") * F.col("n")).alias("total"))
    every = rows.groupBy(*key).agg(F.min(along).alias("a"), F.max(along).alias("z")).select(*key, F.explode(F.sequence("a", "z")).alias(along))
    return every.join(rows, [*key, along], "left").select(*key, along, F.coalesce("n", F.lit(0)).alias("n"), "lower", "upper", F.coalesce(F.col("total") / F.col("n"), F.lit(0.0)).alias("mean"))


def seam_labels(before: list[int], after: list[int], level_before: list[int], level_after: list[int]) -> dict[int, int]:
    """New label of every label on a seam of two columns: the smallest that it is linked to, and
    -1 for labels that aren't linked."""
    up = {x: x for x in (*before, *after)}

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    linked = set()
    for a, b, p, q in zip(before, after, level_before, level_after, strict=True):
        if p == q:
            linked |= {a, b}
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {x: find(x) if x in linked else -1 for x in up}
