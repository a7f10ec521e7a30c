"""The queries of the time-frequency operators on the driver's tables, and their SQL.

Stand-ins: a plane from `embeddings` (frame = vec_id, scale = position), signals from `events`
(one for each event_type, in the order of event_id), and chunk streams from `events` by user,
where the rows of type error are chunks that were lost. Every query covers its whole table.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafold.functions import kernels, scalars
from spectrafold.operators import calibration, chunks, filters, patches, planes
from spectrafold.sources import sinks, synthetic, wav

EDGES, WIDTH = [0, 8, 24, 64], 50
SLOPE = 3.0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("scale", "v"))
    return e.select(F.lit("plane").alias("source"), F.lit(1).cast("long").alias("segment"), F.col("scale").cast("long").alias("scale"), "frame", F.col("v").cast("double").alias("value"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), "event_id", "value")
    return chunks.numbered(e, "source", "event_id").select("source", F.lit(1).cast("long").alias("segment"), "frame", "value")


def sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of each user's stream, the lost ones included."""
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), "event_id", "event_type", "value")
    flag = F.when(F.col("number") == 0, 1).when(F.col("event_type") == "signup", 0).otherwise(10)
    return chunks.numbered(e, "source", "event_id", "number").withColumn("continuity", flag)


def received(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.segments(sent(spark, sf_dir).filter("event_type <> 'error'"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plane(spark, sf_dir).withColumn("level", scalars.quantize_texture(F.col("value") * 100))


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


PLANE = "p as (select vec_id as frame, unnest(range(len(embedding))) as scale, cast(unnest(embedding) as double) as v from embeddings)"
SIGNALS = "s as (select event_type as source, row_number() over (partition by event_type order by event_id) - 1 as frame, value as v from events)"
SENT = """c0 as (select user_id as source, row_number() over (partition by user_id order by event_id) - 1 as number, event_id, event_type, value from events),
c as (select *, case when number = 0 then 1 when event_type = 'signup' then 0 else 10 end as continuity from c0)"""
RECEIVED = f"""{SENT}, g0 as (select *, lag(number) over (partition by source order by number) as before from c where event_type <> 'error'),
g as (select *, case when continuity >= 10 and (before is null or before <> number - 1) then 0 else continuity end as corrected from g0),
h as (select *, sum(case when corrected < 10 then 1 else 0 end) over (partition by source order by number) as segment from g)"""
LEVELS = f"{PLANE}, l as (select frame, scale, v, case when v * 100 > 60 then 2 when v * 100 > 20 then 1 when v * 100 > 0 then 0 else -1 end as level, scale * (select max(frame) + 1 from p) + frame as k from p)"
LABELS = f"""{LEVELS}, e as (select a.k as a, b.k as b from l a join l b on a.level = b.level and ((a.frame = b.frame and abs(a.scale - b.scale) = 1) or (a.scale = b.scale and abs(a.frame - b.frame) = 1))),
t(k, root) using key (k) as (select k, k from l union select e.b, min(t.root) from t join e on e.a = t.k join recurring.t r on r.k = e.b where t.root < r.root group by e.b),
lab as (select l.frame, l.scale, l.v, l.level, l.k, t.root, dense_rank() over (order by t.root) - 1 as patch from l join t using (k))"""
_BAND = "case " + " ".join(f"when scale >= {a} and scale < {b} then {i}" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:]))) + " end"
_SIZE = "case band " + " ".join(f"when {i} then {(b - a) * WIDTH}" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:]))) + " end"
_CELLS = f"{PLANE}, q as (select a.frame, a.scale, a.v * a.v as e, a.v * 10 as f, b.v * 10 as s from p a join p b on b.frame = a.frame and b.scale = (a.scale + 1) % 64), b as (select *, {_BAND} as band, frame // {WIDTH} as block from q)"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"with {PLANE} select frame, scale, round(v * v, 6) as energy from p")
def tf_energy(spark, sf_dir):
    return plane(spark, sf_dir).withColumn("energy", F.col("value") * F.col("value")).select("frame", "scale", r6("energy"))


@query(f"with {PLANE} select frame, scale, round(case when abs(v) > 0 then 20 * log10(abs(v)) end, 6) as db from p")
def tf_energy_db(spark, sf_dir):
    return plane(spark, sf_dir).select("frame", "scale", F.round(scalars.amplitude_db(F.col("value")), 6).alias("db"))


@query(f"with {RECEIVED} select source, number, continuity, corrected, cast(segment as bigint) as segment from h")
def chunk_segments(spark, sf_dir):
    return received(spark, sf_dir).select("source", "number", "continuity", "corrected", "segment")


@query(f"with {RECEIVED} select source, cast(max(segment) as bigint) as segments, count(*) as n, cast(sum(case when corrected <> continuity then 1 else 0 end) as bigint) as gaps from h group by source")
def chunk_continuity(spark, sf_dir):
    return received(spark, sf_dir).groupBy("source").agg(F.max("segment").alias("segments"), F.count(F.lit(1)).alias("n"), F.sum((F.col("corrected") != F.col("continuity")).cast("long")).alias("gaps"))


def _streams(spark, sf_dir) -> dict[str, DataFrame]:
    """Three inputs of chunks of 20 samples: of two event types, and of one that loses chunks."""
    s = signals(spark, sf_dir).withColumn("number", F.floor(F.col("frame") / 20))
    got = s.groupBy("source", "number").agg(F.max("frame").alias("last"), F.sum("value").alias("total"))
    flag = F.when(F.col("number") == 0, 1).when(F.col("total") > 1000, 0).otherwise(10)
    got = got.withColumn("continuity", flag).select("source", "number", "continuity", "total")
    return {k: got.filter(F.col("source") == k).withColumn("source", F.lit("board")) for k in ("view", "click")} | {"purchase": got.filter("source = 'purchase' and total < 1500").withColumn("source", F.lit("board"))}


_STREAMS = f"""{SIGNALS}, w as (select source, frame // 20 as number, sum(v) as total from s group by all),
x as (select *, case when number = 0 then 1 when total > 1000 then 0 else 10 end as continuity from w)"""


@query(f"""with {_STREAMS} select a.number, least(case when a.continuity <> 10 then a.continuity else 99 end, case when b.continuity <> 10 then b.continuity else 99 end, case when d.continuity <> 10 then d.continuity else 99 end, 10) as continuity,
round(a.total, 6) as view_total, round(b.total, 6) as click_total, round(d.total, 6) as purchase_total
from x a join x b on a.source = 'view' and b.source = 'click' and a.number = b.number join x d on d.source = 'purchase' and d.total < 1500 and d.number = a.number""")
def composite_inner_join(spark, sf_dir):
    return chunks.compose(_streams(spark, sf_dir)).select("number", "continuity", *[F.round(f"{k}.total", 6).alias(f"{k}_total") for k in ("view", "click", "purchase")])


@query(f"""with {SENT}, o as (select source, number, event_id + cast(floor(value * 20) as bigint) as completed from c),
m as (select *, max(number) over (partition by source order by completed, number rows between unbounded preceding and 1 preceding) as top from o)
select source, number, completed from m where top is null or number > top""")
def composite_completion_order(spark, sf_dir):
    o = sent(spark, sf_dir).withColumn("completed", F.col("event_id") + F.floor(F.col("value") * 20))
    return chunks.in_completion_order(o.select("source", "number", "completed"))


@query(f"with {SIGNALS} select a.frame + 15 as frame, round(a.v, 6) as view, round(b.v, 6) as click, round(d.v, 6) as purchase from s a join s b on a.source = 'view' and b.source = 'click' and b.frame = a.frame + 15 join s d on d.source = 'purchase' and d.frame = b.frame and d.frame >= 37")
def aligned_streams(spark, sf_dir):
    """One stream lags by 15 frames, one lacks its first 37."""
    s = signals(spark, sf_dir)
    of = lambda k: s.filter(F.col("source") == k).withColumn("source", F.lit("board"))
    got = chunks.align({"view": of("view").withColumn("frame", F.col("frame") + 15), "click": of("click"), "purchase": of("purchase").filter("frame >= 37")})
    return got.select("frame", r6("view"), r6("click"), r6("purchase"))


@query(f"with {RECEIVED} select source, number, round(number * 0.5::double + case when corrected >= 10 then -0.15::double else 0.37::double end, 6) as initial_sample_time from h")
def initial_sample_time(spark, sf_dir):
    a = chunks.Alignment(included_past=15, dropped=37, rate=100.0)
    return received(spark, sf_dir).select("source", "number", F.round(chunks.initial_sample_time(F.col("number") * 0.5, F.col("corrected"), a), 6).alias("initial_sample_time"))


@query(f"with {RECEIVED} select source, number, number * 2000 + case when corrected >= 10 then -15 else 37 end as first_frame, (number + 1) * 2000 - 15 as end_frame from h")
def chunk_coverage(spark, sf_dir):
    first, end = chunks.coverage(F.col("number"), F.col("corrected"), 2000, chunks.Alignment(included_past=15, dropped=37, rate=100.0))
    return received(spark, sf_dir).select("source", "number", first.cast("long").alias("first_frame"), end.cast("long").alias("end_frame"))


@query(f"""with {SENT}, a as (select * from c where event_type <> 'error') select source, number,
array_to_string(list_sort(list_distinct([event_type, 'board', case when number % 2 = 0 then 'even' else 'board' end])), ',') as sources, event_type as origin from a""")
def provenance_union(spark, sf_dir):
    s = sent(spark, sf_dir).filter("event_type <> 'error'")
    one = s.select("source", "number", "continuity", F.array("event_type", F.lit("board")).alias("sources"), F.create_map(F.lit("origin"), F.col("event_type")).alias("metadata"))
    two = s.select("source", "number", "continuity", F.array(F.lit("board"), F.when(F.col("number") % 2 == 0, "even").otherwise("board")).alias("sources"), F.create_map(F.lit("origin"), F.lit("other")).alias("metadata"))
    got = chunks.provenance(chunks.compose({"a": one, "b": two}), ["a", "b"])
    return got.select("source", "number", F.array_join("sources", ",").alias("sources"), F.col("metadata")["origin"].alias("origin"))


@query(f"""with {SIGNALS}, w as (select *, frame // 64 as chunk, frame % 64 as position, count(*) over (partition by source, frame // 64) as n from s)
select source, chunk, position, round(v, 6) as value from w where n = 64""")
def rechunk(spark, sf_dir):
    return chunks.rechunk(signals(spark, sf_dir), 64).select("source", "chunk", F.col("position").cast("long").alias("position"), r6("value"))


@query(f"with {SIGNALS} select source, (frame + 2) // 5 as frame, round(v, 6) as value from s where (frame + 2) % 5 = 0")
def decimate_phase(spark, sf_dir):
    return chunks.decimate(signals(spark, sf_dir), 5, 2).select("source", "frame", r6("value"))


@query(f"""with {RECEIVED}, d as (select source, number, segment, number * 0.5 + case when value > 300 then 0.2 else 0 end as start_time from h)
select source, number, abs(start_time - (first_value(start_time) over w + coalesce(sum(0.5) over (partition by source, segment order by number rows between unbounded preceding and 1 preceding), 0))) > 0.1 as drift
from d window w as (partition by source, segment order by number)""")
def clock_drift(spark, sf_dir):
    c = received(spark, sf_dir).withColumns({"start_time": F.col("number") * 0.5 + F.when(F.col("value") > 300, 0.2).otherwise(0.0), "n_samples": F.lit(50), "fs": F.lit(100.0)})
    return chunks.drifted(c, 0.1).select("source", "number", "drift")


@query(f"""with {SIGNALS}, y as (select source, frame, 0.5 * v + 0.3 * lag(v, 1) over w + 0.2 * lag(v, 2) over w as value from s window w as (partition by source order by frame))
select source, frame, round(value, 6) as value from y where frame >= 2""")
def fir_moving(spark, sf_dir):
    s = signals(spark, sf_dir).withColumn("scale", F.lit(0))
    return planes.lagged_sum(s, [0.5, 0.3, 0.2]).select("source", "frame", r6("value"))


_TAPS = kernels.kaiser_lowpass(60, 5, 5.0)


@query(f"""with {SIGNALS}, y as (select source, frame - 59 as frame, {' + '.join(f'{h!r} * lag(v, {j}) over w' for j, h in enumerate(_TAPS.tolist()))} as value from s window w as (partition by source order by frame))
select source, frame // 5 as frame, round(value, 6) as value from y where frame >= 0 and frame % 5 = 0""")
def resample_fir(spark, sf_dir):
    return filters.resample(signals(spark, sf_dir), 5, 60, 5.0).select("source", "frame", r6("value"))


@query()
def gammachirp_bank(spark, sf_dir):
    got = filters.gammachirp_energy(signals(spark, sf_dir))
    return got.select("source", F.col("scale").cast("long").alias("scale"), "frame", r6("value"))


def _bands(spark, sf_dir, agg) -> DataFrame:
    e = plane(spark, sf_dir).withColumn("e", F.col("value") * F.col("value"))
    return planes.blocks(e, EDGES, WIDTH, {"value": agg}).select("block", "band", r6("value"))


def _bands_sql(agg: str) -> str:
    return f"with {PLANE}, b as (select v * v as e, {_BAND} as band, frame // {WIDTH} as block from p) select block, band, round({agg}(e), 6) as value from b where band is not null group by block, band having count(*) = {_SIZE}"


@query(_bands_sql("avg"))
def band_mean(spark, sf_dir):
    return _bands(spark, sf_dir, F.avg("e"))


@query(_bands_sql("max"))
def band_max(spark, sf_dir):
    return _bands(spark, sf_dir, F.max("e"))


@query(_bands_sql("min"))
def band_min(spark, sf_dir):
    return _bands(spark, sf_dir, F.min("e"))


def ptn_cells(spark, sf_dir) -> DataFrame:
    """Energy and two tracts, joined by cell."""
    p = plane(spark, sf_dir)
    e = p.select("source", "segment", "scale", "frame", (F.col("value") * F.col("value")).alias("value"))
    f = p.withColumn("value", F.col("value") * 10)
    s = f.withColumn("scale", F.pmod(F.col("scale") - 1, F.lit(64)))
    return chunks.align({"e": e, "f_tract": f, "s_tract": s}, planes.CELL)


_GATES = f"(1 + tanh((f - 0.5) * {SLOPE})) / 2 as gf, (1 + tanh((s - 0.5) * {SLOPE})) / 2 as gs"
_PTN = f"with {_CELLS}, g as (select *, {_GATES} from b where band is not null), r as (select block, band, avg(e) as energy, avg(e * gf) as pulse, avg(e * gs) as tone, avg(e * (1 - gf) * (1 - gs)) as noise, max(f) as tfmax, max(s) as tsmax, min(f) as tfmin, min(s) as tsmin from g group by block, band having count(*) = {_SIZE})"
_EXTREMES = ("tfmax", "tsmax", "tfmin", "tsmin")


@query(_PTN + " select block, band, round(energy, 6) as energy, round(pulse, 6) as pulse, round(tone, 6) as tone, round(noise, 6) as noise from r")
def ptn_gated(spark, sf_dir):
    got = planes.ptn(ptn_cells(spark, sf_dir), EDGES, WIDTH, threshold=0.5, slope=SLOPE)
    return got.select("block", "band", *[r6(n) for n in ("energy", "pulse", "tone", "noise")])


@query(_PTN + " select block, band, round(10 * log10(energy) - 3, 6) as energy, round(10 * log10(pulse / energy), 6) as pulse, round(10 * log10(tone / energy), 6) as tone, round(10 * log10(noise / energy), 6) as noise from r")
def ptn_normalized(spark, sf_dir):
    got = planes.ptn(ptn_cells(spark, sf_dir), EDGES, WIDTH, threshold=0.5, slope=SLOPE, normalized=True, decibels=True, reference=3.0)
    return got.select("block", "band", *[r6(n) for n in ("energy", "pulse", "tone", "noise")])


@query(_PTN + " select block, band, round(energy, 6) as energy from r")
def ptn_energy(spark, sf_dir):
    """Only the energy is asked for, so the tracts are neither read nor joined."""
    e = plane(spark, sf_dir).withColumn("e", F.col("value") * F.col("value"))
    return planes.ptn(e, EDGES, WIDTH, names=("energy",)).select("block", "band", r6("energy"))


@query(_PTN + f" select block, band, {', '.join(f'round({n}, 6) as {n}' for n in _EXTREMES)} from r")
def ptn_extremes(spark, sf_dir):
    return planes.ptn(ptn_cells(spark, sf_dir), EDGES, WIDTH, names=_EXTREMES).select("block", "band", *[r6(n) for n in _EXTREMES])


@query(f"with {PLANE}, b as (select v, {_BAND} as band, frame // 70 as block from p) select block, band, count(*) as n, count(*) = (case band when 0 then 560 when 1 then 1120 else 2800 end) as complete from b where band is not null group by block, band")
def block_complete_only(spark, sf_dir):
    """All blocks of 70 frames with their sizes, and whether blocks() keeps them."""
    p = plane(spark, sf_dir)
    every = planes.blocks(p, EDGES, 70, {"n": F.count(F.lit(1))}, complete=False)
    whole = planes.blocks(p, EDGES, 70, {"n": F.count(F.lit(1))}).select("block", "band", F.lit(True).alias("__w"))
    return every.join(whole, ["block", "band"], "left").select("block", "band", "n", F.coalesce("__w", F.lit(False)).alias("complete"))


@query(f"with {PLANE} select scale, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std, count(*) as n from p group by scale")
def scale_moments(spark, sf_dir):
    return planes.scale_moments(plane(spark, sf_dir)).select("scale", r6("mean"), r6("std"), "n")


_MOMENTS = f"{PLANE}, m as (select scale, avg(v) as mean, stddev_samp(v) as std from p group by scale), z as (select p.frame, p.scale, p.v - m.mean as v, m.std from p join m using (scale))"


@query(f"with {_MOMENTS} select a.scale, cast(d.delay as integer) as delay, round(sum(a.v * b.v) / ((count(*) - 1) * max(a.std) * max(b.std)), 6) as correlation from z a cross join (select unnest(range(-3, 4)) as delay) d join z b on b.scale = a.scale and b.frame = a.frame + d.delay group by a.scale, d.delay having count(*) > 1")
def lag_correlation(spark, sf_dir):
    return planes.lag_correlation(plane(spark, sf_dir), list(range(-3, 4))).select("scale", "delay", r6("correlation"))


@query(f"with {_MOMENTS} select a.scale, b.scale as xscale, cast(d.delay as integer) as delay, round(sum(a.v * b.v) / ((count(*) - 1) * max(a.std) * max(b.std)), 6) as correlation from z a cross join (select unnest(range(-1, 2)) as delay) d join z b on b.frame = a.frame + d.delay group by a.scale, b.scale, d.delay having count(*) > 1")
def correlation_cube(spark, sf_dir):
    return planes.lag_correlation(plane(spark, sf_dir), [-1, 0, 1], reach=None).select("scale", "xscale", "delay", r6("correlation"))


def _model(spark: SparkSession) -> DataFrame:
    rows = [(s, s + d, k, w, 4) for s in range(2, 62) for d, k, w in ((1, 1, 0.35), (-1, -1, 0.35), (2, 2, 0.15), (-2, -2, 0.15))]
    return spark.createDataFrame(rows, "scale long, tap_scale long, tap_frame int, weight double, n_taps int")


@query(f"""with {PLANE}, n as (select max(frame) as last from p) select a.frame, a.scale, round(a.v - 0.35 * b.v - 0.35 * c.v - 0.15 * d.v - 0.15 * e.v, 6) as value from p a
join p b on b.scale = a.scale + 1 and b.frame = a.frame + 1 join p c on c.scale = a.scale - 1 and c.frame = a.frame - 1
join p d on d.scale = a.scale + 2 and d.frame = a.frame + 2 join p e on e.scale = a.scale - 2 and e.frame = a.frame - 2""")
def pattern_stencil(spark, sf_dir):
    return planes.pattern(plane(spark, sf_dir), _model(spark)).select("frame", "scale", r6("value"))


@query(f"""with {PLANE}, x as (select frame, scale, sum(v * v) over w as v, count(*) over w as n from p window w as (partition by scale order by frame rows between 3 preceding and 4 following))
select a.frame, a.scale, round(sum(b.v) / 24, 6) as value from x a join x b on b.frame = a.frame and b.scale between a.scale - 1 and a.scale + 1 where b.n = 8 group by a.frame, a.scale having count(*) = 3""")
def tract_prefix(spark, sf_dir):
    areas = spark.createDataFrame([(s, r, -3, 4) for s in range(1, 63) for r in (s - 1, s, s + 1)], "scale long, runscale long, start_frame int, end_frame int")
    return planes.tract(plane(spark, sf_dir), areas, 4).select("frame", "scale", r6("value"))


@query(f"with {PLANE} select frame, scale, round(v, 6) as value from p where frame between 4 and (select max(frame) from p) - 7 and scale between 3 and 58")
def valid_region(spark, sf_dir):
    p = plane(spark, sf_dir)
    extent = p.groupBy("source", "segment").agg((F.max("frame") + 1).alias("n_frames"), (F.max("scale") + 1).alias("n_scales"))
    return planes.valid_region(p, extent, 4, 7, 3, 5).select("frame", "scale", r6("value"))


@query(f"with {PLANE} select frame, scale, cast(case when v * v > 0 then floor(ln(v * v)) end as integer) as level from p")
def quantize_log(spark, sf_dir):
    return plane(spark, sf_dir).select("frame", "scale", scalars.quantize_log(F.col("value") * F.col("value")).alias("level"))


@query(f"with {PLANE} select frame, scale, cast(20 * floor(v * 300 / 20) - 30 as integer) as level from p")
def quantize_floor(spark, sf_dir):
    return plane(spark, sf_dir).select("frame", "scale", scalars.quantize_floor(F.col("value") * 300).alias("level"))


@query(f"with {LEVELS} select frame, scale, level from l")
def quantize_texture(spark, sf_dir):
    return levels(spark, sf_dir).select("frame", "scale", "level")


def _labelled(spark, sf_dir) -> DataFrame:
    return patches.label_patches(levels(spark, sf_dir))


@query(f"with recursive {LABELS} select frame, scale, level, patch from lab")
def patch_labels(spark, sf_dir):
    return _labelled(spark, sf_dir).select("frame", "scale", F.col("level").cast("int").alias("level"), "patch")


@query(f"with recursive {LABELS} select patch, min(level) as level, min(frame) as t_low, max(frame) as t_high, min(scale) as s_low, max(scale) as s_high, count(*) as size, round(count(*) / ((max(frame) + 1 - min(frame)) / 100.0 * (max(scale) - min(scale) + 1)), 6) as fill_ratio from lab group by patch")
def patch_descriptors(spark, sf_dir):
    got = patches.timed(patches.descriptors(_labelled(spark, sf_dir)), 100.0)
    return got.select("patch", F.col("level").cast("int").alias("level"), "t_low", "t_high", "s_low", "s_high", "size", r6("fill_ratio"))


@query(f"with recursive {LABELS} select patch, scale, count(*) as n, min(frame) as lower, max(frame) as upper from lab group by patch, scale")
def patch_row_counts(spark, sf_dir):
    return patches.in_scale(_labelled(spark, sf_dir)).select("patch", "scale", "n", "lower", "upper")


@query(f"with recursive {LABELS} select patch, frame, count(*) as n, min(scale) as lower, max(scale) as upper from lab group by patch, frame")
def patch_col_extrema(spark, sf_dir):
    return patches.in_frame(_labelled(spark, sf_dir)).select("patch", "frame", "n", "lower", "upper")


@query(f"with recursive {LABELS} select patch, scale, round(avg(v), 6) as mean from lab group by patch, scale")
def patch_means(spark, sf_dir):
    return patches.means(_labelled(spark, sf_dir), plane(spark, sf_dir)).select("patch", "scale", r6("mean"))


@query(f"with recursive {LABELS} select frame, scale, cast(patch = 0 as integer) as mask from lab")
def patch_mask(spark, sf_dir):
    return patches.mask(_labelled(spark, sf_dir), 0).select("frame", "scale", "mask")


_DESC = "d as (select patch, min(level) as level, max(frame) as t_high, count(*) as size from lab group by patch)"


@query(f"with recursive {LABELS}, {_DESC} select patch, level, size, t_high = (select max(frame) from p) as open from d")
def boundary_patches(spark, sf_dir):
    """Patches that end with the plane and those that are finished, apart and together again."""
    lab = patches.shared_table(_labelled(spark, sf_dir), "labelled")
    extent = lab.groupBy("source", "segment").agg((F.max("frame") + 1).alias("n_frames"))
    d = patches.descriptors(lab)
    got = patches.touching(d, extent).withColumn("open", F.lit(True)).unionByName(patches.finished(d, extent).withColumn("open", F.lit(False)))
    return got.select("patch", F.col("level").cast("int").alias("level"), "size", "open")


@query(f"with {LEVELS}, n as (select count(*) as links from l a join l b on b.scale = a.scale and b.frame = a.frame + 1 and b.level = a.level and b.frame % 100 = 0) select a.frame as frame, a.scale, a.level from l a join l b on b.scale = a.scale and b.frame = a.frame + 1 and b.level = a.level and b.frame % 100 = 0")
def seam_edges(spark, sf_dir):
    """Cells that a seam between chunks of 100 frames joins to the next chunk."""
    x = levels(spark, sf_dir).withColumn("tile", F.floor(F.col("frame") / 100))
    left = x.filter(F.pmod(F.col("frame") + 1, F.lit(100)) == 0)
    right = x.filter(F.pmod("frame", F.lit(100)) == 0).select("source", "segment", "scale", "level", (F.col("tile") - 1).alias("tile"))
    return left.join(right, ["source", "segment", "tile", "scale", "level"]).select("frame", "scale", "level")


@query(f"with recursive {LABELS} select patch, min(level) as level, min(frame) as t_low, max(frame) as t_high, count(*) as size from lab group by patch")
def patch_merge(spark, sf_dir):
    """Descriptors of the parts in chunks of 100 frames, merged over the seams."""
    lab = patches.label_patches(levels(spark, sf_dir), tile=100).withColumn("part", F.floor(F.col("frame") / 100))
    parts = patches.descriptors(lab.withColumn("patch", F.struct("patch", "part")))
    into = parts.select("source", "segment", "patch", F.col("patch.patch").alias("final")).distinct()
    return patches.merged(parts, into).select(F.col("final").alias("patch"), F.col("level").cast("int").alias("level"), "t_low", "t_high", "size")


@query(f"""with {SIGNALS} select distinct source, sha1('{{"rate":8000.0,"source":"' || source || '"}}') as fingerprint from s""")
def config_fingerprint(spark, sf_dir):
    s = signals(spark, sf_dir).select("source").distinct()
    return s.select("source", scalars.fingerprint({"source": F.col("source"), "rate": F.lit(8000.0)}).alias("fingerprint"))


@query()
def calibration_model(spark, sf_dir):
    """Context areas from a noise plane of 40 scales and 2,000 frames."""
    _, areas = calibration.calibrate(synthetic.noise_plane(spark, 40, 2000))
    return calibration.area_stats(areas)


@query()
def structure_features(spark, sf_dir):
    """Pattern and tract of all textures of the plane, by a model of noise with as many scales."""
    model, areas = calibration.calibrate(synthetic.noise_plane(spark, 64, 2000))
    return calibration.structure(plane(spark, sf_dir), model, areas).select("feature", "scale", "frame", r6("value"))


@query("select range as frame, round(2000 * sin(2 * pi() * 1000 / 8000 * range), 6) + 0.0::double as value from range(16000)")
def sine_source(spark, sf_dir):
    got = synthetic.sine(spark, 16_000)
    return got.select("frame", (F.round("value", 6) + F.lit(0.0)).alias("value"))


_BANK = "(select s, 60 * pow(4000.0 / 60, s / 99.0) as f from (select unnest(range(100)) as s))"
_B, _C = "(2.02 * 0.35 * 0.1039 * 0.75)::double", "(2.02 * 0.35 * 24.7)::double"
_KERNEL = f"""k as (select s, j, a * cos(2 * pi() * f * t - 3.7 * ln(t)) as re, a * sin(2 * pi() * f * t - 3.7 * ln(t)) as im from
(select s, f, j, t, pow(t, 3) * exp(-2 * pi() * w * t) * sqrt(pow(4 * pi() * w, 7) / 720) * f / 8000 as a from
(select s, f, j, j / 8000.0::double as t, {_B} * f + {_C} as w from {_BANK}, (select unnest(range(1, 805)) as j))))"""


@query(f"""with {SIGNALS}, {_KERNEL}, o as (select source, frame as last, (frame - 803) // 5 as frame from s where frame >= 803 and (frame - 803) % 5 = 0),
y as (select o.source, k.s as scale, o.frame, sum(s.v * k.re) as re, sum(s.v * k.im) as im from o join s on s.source = o.source and s.frame between o.last - 803 and o.last join k on k.j = o.last - s.frame + 1 group by all)
select source, scale, frame, round(10 * log10(re * re + im * im), 4) as db from y""")
def gammachirp_db(spark, sf_dir):
    """All 100 bands in decibels; the SQL states the kernels by their formula."""
    got = filters.gammachirp_db(signals(spark, sf_dir))
    return got.select("source", F.col("scale").cast("long").alias("scale"), "frame", F.round("value", 4).alias("db"))


def _sent_chunks(spark, sf_dir) -> DataFrame:
    """The signals in chunks of 500 samples, some without a result, some of no length."""
    return synthetic.chunked(signals(spark, sf_dir), 500, 100.0)


_CHUNKED = f"{SIGNALS}, c as (select source, frame // 500 as number, count(*) as n, sum(v) as total from s group by all)"


@query(f"with {_CHUNKED} select source, number, cast(case when number = 0 then 1 else 10 end as integer) as continuity, n as samples, cast(null as double) as tick from c")
def feature_ticks(spark, sf_dir):
    """One feature under a subscriber's name, another as a tick only."""
    got = chunks.project(_sent_chunks(spark, sf_dir), {"sound": "data", "tick": "*"})
    return got.select("source", "number", F.col("continuity").cast("int").alias("continuity"), F.size("sound").cast("long").alias("samples"), "tick")


@query(f"with {_CHUNKED} select source, number, n from c where total / n <= 250 and number % 3 <> 0")
def nulls_and_empties_suppressed(spark, sf_dir):
    c = _sent_chunks(spark, sf_dir).withColumn("mean", F.aggregate("data", F.lit(0.0), lambda a, x: a + x) / F.size("data"))
    made = c.withColumn("result", F.when(F.col("mean") <= 250, F.when(F.col("number") % 3 == 0, F.slice("data", 1, 0)).otherwise(F.col("data"))))
    got = chunks.not_empty(chunks.with_results(made, "result"), "result", strict=False)
    return chunks.not_empty(got, "result").select("source", "number", F.size("result").cast("long").alias("n"))


@query(f"""with {_CHUNKED}, m as (select source, max(number) as number from c group by source)
select source, number, cast(case when number = 0 then 1 else 10 end as integer) as continuity, n, round(total, 6) as total, number * 5.0::double as start_time from c
union all select c.source, c.number + 1, 11, n, 0.0::double, c.number * 5.0::double + n / 100.0::double from c join m using (source, number)""")
def end_sentinel(spark, sf_dir):
    got = chunks.with_end(_sent_chunks(spark, sf_dir))
    return got.select("source", "number", "continuity", F.size("data").cast("long").alias("n"), F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), "start_time")


@query("select range as number, cast(case when range = 6 then 11 when range = 0 then 1 else 10 end as integer) as continuity, 300::bigint as n, false as calibration from range(7) union all select 0, 2, 300, true")
def noise_source(spark, sf_dir):
    one, two = synthetic.noise_chunks(spark, 300, 7), synthetic.noise_chunks(spark, 300, 7, calibration=True)
    both = one.withColumn("calibration", F.lit(False)).unionByName(two.withColumn("calibration", F.lit(True)))
    return both.select("number", "continuity", F.size("data").cast("long").alias("n"), "calibration")


@query(f"with {SIGNALS}, w as (select source, frame // 700 as number, cast(floor(v) as integer) % 3000 as x from s) select source, number, cast(case when number = 0 then 1 else 10 end as integer) as continuity, round(number * 0.0875::double, 6) as start_time, count(*) as n, cast(sum(x) as double) as total from w group by source, number")
def wav_roundtrip(spark, sf_dir):
    """Signals written as sound files, a file each, and read as chunks of 700 samples."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("frame")
        x = np.floor(t.column("value").to_numpy()).astype(np.int64) % 3000
        return pa.table({"path": [f"/in/{t.column('source')[0]}.wav"], "content": [wav.encode(x, 8000)], "source": [t.column("source")[0].as_py()]})

    files = signals(spark, sf_dir).select("source", "frame", "value").groupBy("source").applyInArrow(run, "path string, content binary, source string")
    got = wav.chunks_of(files, 700, 8000.0)
    return got.select("source", "number", "continuity", F.round("start_time", 6).alias("start_time"), F.size("data").cast("long").alias("n"), F.aggregate("data", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"with {RECEIVED} select cast(source as varchar) as source, cast(segment as bigint) as segment, number, cast(floor(value) as smallint) as value from h where number % 7 <> 0")
def sink_roundtrip(spark, sf_dir):
    """Chunks appended to folders by location and segment and read again; end chunks stay out."""
    path = f"{patches.shared_folder(spark)}/spectrafold/sink-{uuid.uuid4().hex}"
    c = received(spark, sf_dir).select(F.col("source").cast("string").alias("source"), "number", "segment", F.floor("value").alias("value"), F.when(F.col("number") % 7 == 0, 11).otherwise(10).alias("continuity"))
    sinks.append(c.withColumn("bin", F.pmod(F.xxhash64("source"), F.lit(4))), path, by=("bin",), kinds={"value": "smallint"})
    return sinks.read(spark, path).select("source", "segment", "number", "value")


@query(f"with {RECEIVED} select source, min(number * 0.5)::double as first_time, max(number * 0.5)::double as last_time, array_to_string(list_sort(list(number) filter (number % 25 = 0)), ',') as marks from h group by source")
def chunk_marks(spark, sf_dir):
    got = sinks.chunk_marks(received(spark, sf_dir).withColumn("start_time", F.col("number") * 0.5), every=25)
    return got.select("source", "first_time", "last_time", F.nullif(F.array_join("marks", ","), F.lit("")).alias("marks"))


@query(f"with {SIGNALS} select distinct source, 'my_' || source || '.wav' as location, date '2024-05-06' as date, '{{\"source\":\"' || source || '\",\"rate\":100}}' as json from s")
def located_rows(spark, sf_dir):
    s = signals(spark, sf_dir).select("source").distinct()
    js = sinks.as_json(s.withColumn("rate", F.lit(100))).select(F.from_json("value", "source string, rate int")["source"].alias("source"), F.col("value").alias("json"))
    got = sinks.located(s.withColumn("identifier", F.concat(F.lit("/data/in put/my "), "source", F.lit(".wav"))), day="2024-05-06")
    return got.join(js, "source").select("source", "location", "date", "json")


@query(f"with {PLANE}, b as (select frame, v * v as e, {_BAND} as band from p) select frame, band, round(10 * log10(avg(e) / 2), 6) as value from b where band is not null group by frame, band")
def band_mean_time(spark, sf_dir):
    """Band means of every frame, normalised and in decibels."""
    e = plane(spark, sf_dir).withColumn("value", F.col("value") * F.col("value"))
    return planes.band_means(e, EDGES, keep_time=True, normalization=2.0, decibels=True).select("frame", "band", r6("value"))


_PATTERN = f"""{PLANE}, x as (select a.frame, a.scale, a.v - 0.35 * b.v - 0.35 * c.v - 0.15 * d.v - 0.15 * e.v as value from p a
join p b on b.scale = a.scale + 1 and b.frame = a.frame + 1 join p c on c.scale = a.scale - 1 and c.frame = a.frame - 1
join p d on d.scale = a.scale + 2 and d.frame = a.frame + 2 join p e on e.scale = a.scale - 2 and e.frame = a.frame - 2)"""


@query(f"with {_PATTERN} select scale, round(avg(value), 6) as mean, round(sqrt(avg(value * value)), 6) as rms, round(stddev_pop(value), 6) as std from x group by scale")
def feature_moments(spark, sf_dir):
    """Moments of a pattern, as calibration has them of patterns and of tracts."""
    x = planes.pattern(plane(spark, sf_dir), _model(spark))
    one = calibration.pattern_moments(x).join(calibration.tract_moments(x).drop("mean"), ["source", "segment", "scale"])
    return one.select("scale", r6("mean"), r6("rms"), r6("std"))


@query(f"with {_PATTERN}, m as (select scale, sqrt(avg(value * value)) as rms from x group by scale) select frame, scale, round(value / rms, 6) as value from x join m using (scale)")
def normalized_pattern(spark, sf_dir):
    x = planes.pattern(plane(spark, sf_dir), _model(spark))
    return calibration.normalized(x, calibration.pattern_moments(x, white=True), "rms").select("frame", "scale", r6("value"))


@query("select texture, s as scale, (3 * 8 + s % 5)::bigint as area, -3 as first_frame, cast(4 + s % 5 as integer) as last_frame, cast(s - 1 as integer) as first_scale, cast(s + 1 as integer) as last_scale from (select cast(unnest(range(1, 63)) as integer) as s), (select unnest(['f', 's']) as texture)")
def area_sizes(spark, sf_dir):
    """Cells and horizons of context areas from a literal model."""
    rows = [(t, s, r, -3, 4 + (s % 5 if r == s else 0)) for t in "fs" for s in range(1, 63) for r in (s - 1, s, s + 1)]
    return calibration.area_stats(spark.createDataFrame(rows, calibration.AREA_MODEL)).select("texture", "scale", "area", "first_frame", "last_frame", "first_scale", "last_scale")


@query("select scale, scale + d as tap_scale, cast(d as integer) as tap_frame, case abs(d) when 1 then 0.35::double else 0.15::double end as weight from (select unnest(range(2, 62)) as scale), (select unnest([1, -1, 2, -2]) as d)")
def model_roundtrip(spark, sf_dir):
    """A model saved and loaded again."""
    path = f"{patches.shared_folder(spark)}/spectrafold/model-{uuid.uuid4().hex}"
    calibration.save(_model(spark), path)
    return calibration.load(spark, path).select("scale", "tap_scale", "tap_frame", "weight")


CHUNK = 100
PARTS = f"""{LABELS}, ec as (select e.a, e.b from e join l x on x.k = e.a join l y on y.k = e.b where x.frame // {CHUNK} = y.frame // {CHUNK}),
u(k, root) using key (k) as (select k, k from l union select ec.b, min(u.root) from u join ec on ec.a = u.k join recurring.u r on r.k = ec.b where u.root < r.root group by ec.b),
part as (select lab.frame, lab.scale, lab.v, lab.level, lab.patch, lab.frame // {CHUNK} as chunk, u.root as own, dense_rank() over (order by lab.frame // {CHUNK}, u.root) as serial, dense_rank() over (partition by lab.frame // {CHUNK} order by u.root) - 1 as local from lab join u using (k))"""


def _parts(spark, sf_dir) -> DataFrame:
    return patches.shared_table(patches.chunk_patches(levels(spark, sf_dir), CHUNK), "chunks")


@query(f"with recursive {PARTS} select distinct chunk, local, serial, patch from part")
def patch_serials(spark, sf_dir):
    """Labels of patches within their chunk, serial numbers over all chunks, and whole patches."""
    return _parts(spark, sf_dir).select("chunk", "local", F.col("serial").cast("long").alias("serial"), "patch").distinct()


@query(f"with recursive {PARTS} select distinct a.chunk as tile, a.local, b.local as next_local from part a join part b on b.scale = a.scale and b.frame = a.frame + 1 and b.level = a.level and b.chunk = a.chunk + 1")
def seam_links(spark, sf_dir):
    """Local labels that touch across a seam."""
    lab = _parts(spark, sf_dir).withColumnRenamed("chunk", "tile")
    return patches.seam_edges(lab, CHUNK).select("tile", "local", "next_local")


@query(f"with recursive {PARTS} select patch, min(level) as level, min(frame) as t_low, max(frame) as t_high, min(scale) as s_low, max(scale) as s_high, count(*) as size, count(distinct serial) as parts, min(serial) as serial, 'part-' || max(serial) filter (chunk = last) as identifier from (select *, max(chunk) over (partition by patch) as last from part) where true group by patch")
def patch_merge_descriptors(spark, sf_dir):
    """Descriptors of the parts of each patch, merged, with the smallest serial number and the
    name of a part that ends last."""
    lab = _parts(spark, sf_dir)
    parts = patches.descriptors(lab.withColumn("patch", F.col("serial"))).withColumn("serial", F.col("patch"))
    # all parts of the last chunk end with it for this purpose, so that the newest serial names the whole
    parts = parts.withColumn("identifier", F.concat(F.lit("part-"), F.col("serial").cast("string")))
    into = lab.select("source", "segment", F.col("serial").alias("patch"), F.col("patch").alias("final")).distinct()
    by_chunk = parts.withColumn("true_high", F.col("t_high")).withColumn("t_high", F.floor(F.col("t_high") / CHUNK))
    names = patches.merged(by_chunk, into).select("source", "segment", "final", "identifier")
    got = patches.merged(parts.drop("identifier"), into).join(names, ["source", "segment", "final"])
    return got.select(F.col("final").alias("patch"), F.col("level").cast("int").alias("level"), "t_low", "t_high", "s_low", "s_high", "size", "parts", F.col("serial").cast("long").alias("serial"), "identifier")


def _merged_rows(spark, sf_dir, along: str) -> DataFrame:
    lab = _parts(spark, sf_dir)
    one = lab.withColumn("patch", F.col("serial"))
    rows = (patches.in_scale if along == "scale" else patches.in_frame)(one).join(patches.means(one, plane(spark, sf_dir), along), ["source", "segment", "patch", along])
    into = lab.select("source", "segment", F.col("serial").alias("patch"), F.col("patch").alias("final")).distinct()
    return patches.merged_rows(rows, into, along).select(F.col("final").alias("patch"), along, "n", "lower", "upper", r6("mean"))


@query(f"with recursive {LABELS} select patch, scale, count(*) as n, min(frame) as lower, max(frame) as upper, round(avg(v), 6) as mean from lab group by patch, scale")
def patch_merge_scales(spark, sf_dir):
    """Counts, extrema and means by scale of the parts of each patch, merged over the chunks."""
    return _merged_rows(spark, sf_dir, "scale")


@query(f"with recursive {LABELS} select patch, frame, count(*) as n, min(scale) as lower, max(scale) as upper, round(avg(v), 6) as mean from lab group by patch, frame")
def patch_merge_frames(spark, sf_dir):
    return _merged_rows(spark, sf_dir, "frame")


@query("select round(ln(2.02::double * 0.35 * 0.1039 * 0.75 * x + 2.02::double * 0.35 * 24.7), 6) as rate, x as frequency from (select unnest(range(60, 4001, 20))::double as x)")
def erb_scale(spark, sf_dir):
    """Places on the ERB scale, and their frequencies again."""
    b, c = kernels.ERB_SLOPE, kernels.ERB_OFFSET
    x = spark.range(60, 4001, 20).select(F.col("id").cast("double").alias("x")).withColumn("e", scalars.erb_rate(F.col("x"), b, c))
    return x.select(r6("e").alias("rate"), F.round(scalars.erb_frequency(F.col("e"), b, c), 6).alias("frequency"))
