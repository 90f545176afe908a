"""Queries over sampled detections: camera timeline and crop path; and the retention plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from camwatch.operators import croppath as K
from camwatch.operators import filters as P
from camwatch.operators import joins as J
from camwatch.operators import timeline as L
from camwatch.plans import feed as D
from camwatch.plans.event_queries import NOW
from camwatch.plans.registry import query

C = F.col

ENTRIES = "entries as (select incident_id, camera, t, sum(case when label = 'person' then area else 0 end) as area from sidecar group by 1, 2, 3)"
GRID = f"""{ENTRIES}, ends as (select incident_id, max(t)::double as end_sec from sidecar group by 1),
    grid as (select e.incident_id, camera, unnest(range(0, least(cast(floor(end_sec / 2) as integer), 44) + 1))::integer as idx from ends e join (select distinct incident_id, camera from sidecar) using (incident_id) where end_sec > 0),
    gt as (select *, idx * 2.0::double as t from grid),
    gb as (select g.*, r.t as bt, r.area as ba from gt g asof left join entries r on g.incident_id = r.incident_id and g.camera = r.camera and g.t >= r.t),
    ga as (select g.*, r.t as nt, r.area as na from gb g asof left join entries r on g.incident_id = r.incident_id and g.camera = r.camera and g.t <= r.t),
    curves as (select incident_id, camera, idx, t, case when bt is null then na when nt is null or t - bt <= nt - t then ba else na end as area from ga)"""
# the same recursion and order of operations as the fold, so that comparisons behind it see the same numbers
SCORES = f"""{GRID}, scores as (select incident_id, camera, idx, t, (0.4::double * area + (1 - 0.4::double) * 0.0::double) as score from curves where idx = 0
    union all select c.incident_id, c.camera, c.idx, c.t, 0.4::double * c.area + (1 - 0.4::double) * s.score from scores s join curves c on c.incident_id = s.incident_id and c.camera = s.camera and c.idx = s.idx + 1)"""
BEST = f"""{SCORES}, biased as (select incident_id, camera, idx, t, case when camera = 'cam_0' then score * 1.2::double else score end as score from scores),
    best as (select incident_id, idx, t, camera as best, score from (select *, row_number() over (partition by incident_id, idx order by score desc, camera) as n from biased) where n = 1)"""
HELD = f"""{BEST}, held as (select incident_id, idx, t, best as camera from best where idx = 0
    union all select b.incident_id, b.idx, b.t, case when b.score < o.score * 1.15::double then h.camera else b.best end
    from held h join best b on b.incident_id = h.incident_id and b.idx = h.idx + 1 join biased o on o.incident_id = b.incident_id and o.idx = b.idx and o.camera = h.camera)"""
MERGED = f"""{HELD}, r1 as (select *, case when lag(camera) over (partition by incident_id order by idx) = camera then 0 else 1 end as c from held),
    r2 as (select *, sum(c) over (partition by incident_id order by idx rows unbounded preceding) as run from r1),
    r3 as (select incident_id, run, any_value(camera) as own, count(*) as n from r2 group by 1, 2),
    r4 as (select incident_id, run, case when n >= 5 then own else coalesce(lag(own) over (partition by incident_id order by run), lead(own) over (partition by incident_id order by run), own) end as merged from r3),
    merged as (select r2.incident_id, idx, t, r4.merged as camera from r2 join r4 using (incident_id, run))"""
SLICES = f"""{MERGED}, slices as (select m.incident_id, idx, camera, t as start_sec, coalesce(lead(t) over (partition by m.incident_id order by idx), end_sec) as end_sec from merged m join ends using (incident_id)),
    win as (select incident_id, coalesce(greatest(0.0::double, min(t) filter (area > 0) - 3), 0.0::double) as a, coalesce(least(any_value(end_sec), max(t) filter (area > 0) + 3), any_value(end_sec)) as b from entries join ends using (incident_id) group by 1),
    plan as (select s.incident_id, idx, camera, greatest(start_sec, a) as start_sec, least(end_sec, b) as end_sec from slices s join win using (incident_id) where end_sec > a and start_sec < b)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.person_area(L.by_incident(D.sidecar(spark, sf_dir)))


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.content_duration(L.by_incident(D.sidecar(spark, sf_dir))).withColumn("end_sec", C("end_sec").cast("double"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.hysteresis(L.best_camera(L.ema(L.area_curves(entries(spark, sf_dir))), F.lit("cam_0")))


@query("a12_person_area", f"{D.with_('sidecar')}, {ENTRIES} select incident_id, camera, t, cast(area as bigint) as area from entries")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir)


@query("a13_weighted_center", f"{D.with_('sidecar')} select incident_id, camera, t, cast(floor(sum((x1 + x2) * greatest(area, 1)) / (2.0::double * sum(greatest(area, 1))) * 1000 + 0.5) as bigint) as cx, cast(floor(sum((y1 + y2) * greatest(area, 1)) / (2.0::double * sum(greatest(area, 1))) * 1000 + 0.5) as bigint) as cy from sidecar group by 1, 2, 3")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = K.entry_boxes(D.sidecar(spark, sf_dir))
    return e.select("incident_id", "camera", "t", F.floor(C("cx") * 1000 + 0.5).alias("cx"), F.floor(C("cy") * 1000 + 0.5).alias("cy"))


@query("a14_content_box", f"""{D.with_('sidecar')}, u as (select incident_id, camera, t, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2 from sidecar group by 1, 2, 3),
    p as (select *, greatest(0.0::double, x1 - greatest((x2 - x1) * 0.1::double, 1)) as a, greatest(0.0::double, y1 - greatest((y2 - y1) * 0.1::double, 1)) as b, least(1280.0::double, x2 + greatest((x2 - x1) * 0.1::double, 1)) as c, least(720.0::double, y2 + greatest((y2 - y1) * 0.1::double, 1)) as d from u)
    select incident_id, camera, t, cast(floor(case when c > a and d > b then (c - a) * (d - b) else 0 end + 0.5) as bigint) as area from p""")  # fmt: skip
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = K.entry_boxes(D.sidecar(spark, sf_dir))
    return e.select("incident_id", "camera", "t", F.floor(K.content_box(C("x1"), C("y1"), C("x2"), C("y2"), F.lit(1280), F.lit(720))["area"] + 0.5).alias("area"))


@query("a15_action_window", f"{D.with_('sidecar', recursive=True)}, {SLICES} select incident_id, a as from_sec, b as to_sec from win")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.action_window(entries(spark, sf_dir), ends(spark, sf_dir))


@query("a16_content_duration", f"{D.with_('sidecar')} select incident_id, max(t) as end_sec from sidecar group by 1")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.content_duration(D.sidecar(spark, sf_dir))


@query("j5_asof_hold", f"""{D.with_('sidecar')}, {ENTRIES}, p as (select distinct incident_id, camera, (t // 10) * 10 + 4 as t from sidecar), f as (select * from entries where area > 0),
    b as (select p.*, r.t as bt, r.area as ba from p asof left join entries r on p.incident_id = r.incident_id and p.camera = r.camera and p.t >= r.t), n as (select b.*, r.t as nt, r.area as na from b asof left join entries r on b.incident_id = r.incident_id and b.camera = r.camera and b.t <= r.t),
    x as (select *, case when bt is null then nt when nt is null or t - bt <= nt - t then bt else nt end as near, case when bt is null then na when nt is null or t - bt <= nt - t then ba else na end as area from n),
    fb as (select x.*, r.t as ft from x asof left join f r on x.incident_id = r.incident_id and x.camera = r.camera and x.t >= r.t), fa as (select fb.*, r.t as gt from fb asof left join f r on fb.incident_id = r.incident_id and fb.camera = r.camera and fb.t <= r.t),
    y as (select *, case when ft is null then gt when gt is null or t - ft <= gt - t then ft else gt end as held from fa)
    select incident_id, camera, t, case when area = 0 and held is not null and abs(held - t) <= 5 then held else near end as entry_t from y""")  # fmt: skip
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    p = e.select("incident_id", "camera", (F.expr("t div 10") * 10 + 4).cast("int").alias("t")).distinct()
    return J.asof_hold(p, e, ["incident_id", "camera"], "t", C("area") > 0, cell=None).select("incident_id", "camera", "t", C("entry.rt").alias("entry_t"))


@query("w2_dense_grid", f"{D.with_('sidecar')}, {GRID} select distinct incident_id, idx, t from gt")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dense_grid(ends(spark, sf_dir)).select("incident_id", "idx", "t")


@query("w3_area_curves", f"{D.with_('sidecar')}, {GRID} select incident_id, camera, idx, t, cast(area as bigint) as area from curves")
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.area_curves(entries(spark, sf_dir))


SIZES = "sizes as (select distinct incident_id, camera, case when camera = 'cam_1' and incident_id % 3 = 0 then 2560 when camera = 'cam_2' and incident_id % 4 = 0 then 0 else 1280 end as nw, 720 as nh from sidecar)"


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.sidecar(spark, sf_dir).select("incident_id", "camera").distinct()
    wide = F.when((C("camera") == "cam_1") & (C("incident_id") % 3 == 0), 2560).when((C("camera") == "cam_2") & (C("incident_id") % 4 == 0), 0).otherwise(1280)
    return s.withColumns({"native_width": wide, "native_height": F.lit(720)})


@query("w3_share_of_frame", f"""{D.with_('sidecar')}, {GRID}, {SIZES}, mix as (select incident_id, count(distinct nw) > 1 as mixed from sizes group by 1)
    select c.incident_id, c.camera, idx, cast(floor(case when mixed and nw > 0 then area / (nw * nh)::double else area end * 1000000 + 0.5) as bigint) as area from curves c join sizes s on s.incident_id = c.incident_id and s.camera = c.camera join mix on mix.incident_id = c.incident_id""")  # fmt: skip
def w3_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = L.share_of_frame(L.area_curves(entries(spark, sf_dir)), sizes(spark, sf_dir))
    return c.select("incident_id", "camera", "idx", F.floor(C("area") * 1000000 + 0.5).alias("area"))


@query("a13_center_points", f"""{D.with_('sidecar')}, d as (select incident_id, camera, t, case when l_partkey % 3 > 0 then x1 + x2 when l_partkey % 3 = 0 and l_suppkey % 2 = 0 then 2.0::double * (x1 + 5) end as sx, case when l_partkey % 3 > 0 then y1 + y2 when l_partkey % 3 = 0 and l_suppkey % 2 = 0 then 2.0::double * (y1 + 7) end as sy, greatest(area, 1) as a from sidecar)
    select incident_id, camera, t, cast(floor(sum(sx * a) / (2.0::double * sum(case when sx is not null then a end)) * 1000 + 0.5) as bigint) as cx, cast(floor(sum(sy * a) / (2.0::double * sum(case when sx is not null then a end)) * 1000 + 0.5) as bigint) as cy from d group by 1, 2, 3""")  # fmt: skip
def a13_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the detections has no box, half of these a center point."""
    s = D.sidecar(spark, sf_dir)
    boxed, pointed = C("l_partkey") % 3 > 0, C("l_suppkey") % 2 == 0
    s = s.withColumns({"px": F.when(~boxed & pointed, C("x1") + 5.0), "py": F.when(~boxed & pointed, C("y1") + 7.0)}).withColumns({c: F.when(boxed, C(c)) for c in ("x1", "y1", "x2", "y2")})
    return K.entry_boxes(s).select("incident_id", "camera", "t", F.floor(C("cx") * 1000 + 0.5).alias("cx"), F.floor(C("cy") * 1000 + 0.5).alias("cy"))


@query("w4_ema", f"{D.with_('sidecar')}, {GRID} select a.incident_id, a.camera, a.idx, round(sum(0.4::double * b.area * power(0.6::double, a.idx - b.idx)), 3) as score from curves a join curves b on a.incident_id = b.incident_id and a.camera = b.camera and b.idx <= a.idx group by 1, 2, 3")
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ema(L.area_curves(entries(spark, sf_dir))).select("incident_id", "camera", "idx", F.round("score", 3).alias("score"))


@query("w5_best_camera", f"{D.with_('sidecar', recursive=True)}, {BEST} select incident_id, idx, best from best")
def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.best_camera(L.ema(L.area_curves(entries(spark, sf_dir))), F.lit("cam_0")).select("incident_id", "idx", "best")


@query("w6_hysteresis", f"{D.with_('sidecar', recursive=True)}, {HELD} select incident_id, idx, camera from held")
def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("incident_id", "idx", "camera")


@query("w7_merge_short_runs", f"{D.with_('sidecar', recursive=True)}, {MERGED} select incident_id, idx, camera from merged")
def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.merge_short_runs(points(spark, sf_dir)).select("incident_id", "idx", "camera")


@query("w8_points_to_segments", f"""{D.with_('sidecar', recursive=True)}, {HELD}, r1 as (select *, case when lag(camera) over (partition by incident_id order by idx) = camera then 0 else 1 end as c from held),
    r2 as (select *, sum(c) over (partition by incident_id order by idx rows unbounded preceding) as seg from r1), s as (select incident_id, cast(seg as bigint) as seg, any_value(camera) as camera, min(t) as start_sec from r2 group by 1, 2)
    select incident_id, seg, camera, start_sec, coalesce(lead(start_sec) over (partition by incident_id order by seg), end_sec) as end_sec from s join ends using (incident_id)""")  # fmt: skip
def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.points_to_segments(points(spark, sf_dir), ends(spark, sf_dir))


@query("w9_points_to_slices", f"{D.with_('sidecar', recursive=True)}, {SLICES} select incident_id, idx, camera, start_sec, end_sec from slices")
def w9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.points_to_slices(L.merge_short_runs(points(spark, sf_dir)), ends(spark, sf_dir))


@query("q5_camera_timeline", f"{D.with_('sidecar', recursive=True)}, {SLICES} select incident_id, idx, camera, start_sec, end_sec from plan")
def q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.camera_timeline(D.sidecar(spark, sf_dir)).select("incident_id", "idx", "camera", "start_sec", "end_sec")


@udtf(returnType="t double, area bigint")
class NearestArea:
    """The built-in curve as a user's table function: at each point of the grid the area of the nearest entry, the earlier on ties."""

    def eval(self, incident_id: int, camera: str, end_sec: float, entries: list):
        at, i = [(e["t"], e["area"]) for e in entries], 0  # by time: the nearest only moves on
        for k in range(min(int(end_sec / 2.0), 44) + 1 if end_sec > 0 else 0):
            while i + 1 < len(at) and at[i + 1][0] - k * 2.0 < abs(at[i][0] - k * 2.0):
                i += 1
            yield k * 2.0, at[i][1]


@query("u2_area_hook", f"{D.with_('sidecar', recursive=True)}, {SLICES} select incident_id, idx, camera, start_sec, end_sec from plan")
def u2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The camera timeline with its areas from a hook: it gives what the built-in ones give."""
    spark.udtf.register("nearest_area", NearestArea)
    return L.camera_timeline(D.sidecar(spark, sf_dir), area_fn="nearest_area").select("incident_id", "idx", "camera", "start_sec", "end_sec")


# nearest entry of each slice's end (every entry has a detection, so the nearest is held), then its crop
CROPS = f"""{SLICES}, box as (select incident_id, camera, t::double as t, sum((x1 + x2) * greatest(area, 1)) / (2.0::double * sum(greatest(area, 1))) as cx, sum((y1 + y2) * greatest(area, 1)) / (2.0::double * sum(greatest(area, 1))) as cy, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2 from sidecar group by 1, 2, 3),
    ask as (select incident_id, idx, camera, start_sec, end_sec, unnest([false, true]) as e, unnest([start_sec, end_sec]) as at_t from plan),
    near as (select a.incident_id, a.idx, a.camera, a.start_sec, a.end_sec, a.e, min_by(struct_pack(cx := b.cx, cy := b.cy, x1 := least(b.x1, 1920), y1 := least(b.y1, 1080), x2 := greatest(b.x2, 0), y2 := greatest(b.y2, 0)), [abs(b.t - a.at_t), b.t]) as b from ask a left join box b on b.incident_id = a.incident_id and b.camera = a.camera group by 1, 2, 3, 4, 5, 6),
    pad as (select *, least(1920.0::double, b.x2 + greatest((b.x2 - b.x1) * 0.1::double, 1)) - greatest(0.0::double, b.x1 - greatest((b.x2 - b.x1) * 0.1::double, 1)) as pw, least(1080.0::double, b.y2 + greatest((b.y2 - b.y1) * 0.1::double, 1)) - greatest(0.0::double, b.y1 - greatest((b.y2 - b.y1) * 0.1::double, 1)) as ph from near),
    zoomed as (select *, coalesce(b.x1 < b.x2 and b.y1 < b.y2 and pw > 0 and ph > 0, false) as z from pad),
    sized as (select *, case when z then greatest(768, least(1920, cast(trunc(sqrt(pw * ph / 0.4::double * (960 / 540::double))) as integer))) & ~1 else 960 end as w, case when z then greatest(432, least(1080, cast(trunc(sqrt(pw * ph / 0.4::double * (540 / 960::double))) as integer))) & ~1 else 540 end as h from zoomed),
    crop as (select incident_id, idx, camera, start_sec, end_sec, e, greatest(0, least(cast(trunc(coalesce(b.cx, 960.0::double) - w / 2.0::double) as integer), 1920 - w)) as x, greatest(0, least(cast(trunc(coalesce(b.cy, 540.0::double) - h / 2.0::double) as integer), 1080 - h)) as y, w, h from sized),
    crops as (select s.incident_id, s.idx, s.camera, s.start_sec, s.end_sec, s.x as start_x, s.y as start_y, s.w as start_w, s.h as start_h, c.x as end_x, c.y as end_y, c.w as end_w, c.h as end_h from crop s join crop c on c.incident_id = s.incident_id and c.idx = s.idx and c.e where not s.e)"""


@query("w11_crop_at", f"{D.with_('sidecar', recursive=True)}, {CROPS} select * exclude (start_sec, end_sec) from crops")
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends of each slice."""
    s = D.sidecar(spark, sf_dir)
    return K.crop_ends(L.camera_timeline(s), s).drop("start_sec", "end_sec")


STRIP = "s as (select incident_id, row_number() over (partition by incident_id order by t, l_partkey, l_suppkey, camera, x2, label) - 1 as idx, camera, t::double as start_sec, t + 1.5::double as end_sec, x1 as start_x, y1 as start_y, x2 as end_x, y2 as end_y, 200 + l_partkey % 5 * 100 as w, 100 + l_suppkey % 4 * 100 as h from sidecar)"


def strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detections of each incident in order, as slices with crops."""
    from pyspark.sql import Window as W

    w = W.partitionBy("incident_id").orderBy("t", "l_partkey", "l_suppkey", "camera", "x2", "label")
    return D.sidecar(spark, sf_dir).select(
        "incident_id", (F.row_number().over(w) - 1).alias("idx"), "camera", C("t").cast("double").alias("start_sec"), (C("t") + 1.5).alias("end_sec"), C("x1").alias("start_x"), C("y1").alias("start_y"), C("x2").alias("end_x"), C("y2").alias("end_y"),
        (F.lit(200) + C("l_partkey") % 5 * 100).alias("w"), (F.lit(100) + C("l_suppkey") % 4 * 100).alias("h"),
    )


@query("w12_hold_last_of_run", f"{D.with_('sidecar')}, {STRIP} select incident_id, idx, case when lead(camera) over w <> camera then start_x else end_x end as end_x from s window w as (partition by incident_id order by idx)")
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.hold_last_of_run(strip(spark, sf_dir)).select("incident_id", "idx", "end_x")


RUNS = "r1 as (select *, case when lag(camera) over (partition by incident_id order by idx) = camera then 0 else 1 end as c from s), r2 as (select *, sum(c) over (partition by incident_id order by idx rows unbounded preceding) as run from r1), r as (select *, row_number() over (partition by incident_id, run order by idx) as n from r2)"


@query("w13_smooth_zoom", f"""{D.with_('sidecar', recursive=True)}, {STRIP}, {RUNS}, v as (select *, greatest(0.4::double, least(1.0::double, sqrt(w * h / (1000 * 600.0::double)))) as raw from r),
    z as (select incident_id, run, n, idx, raw as zoom from v where n = 1 union all select v.incident_id, v.run, v.n, v.idx, 0.25::double * v.raw + 0.75::double * z.zoom from z join v on v.incident_id = z.incident_id and v.run = z.run and v.n = z.n + 1)
    select incident_id, idx, round(zoom, 6) as zoom from z""")  # fmt: skip
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = strip(spark, sf_dir).withColumns({"frame_w": F.lit(1000), "frame_h": F.lit(600)})
    return K.smooth_zoom(s).select("incident_id", "idx", F.round("zoom", 6).alias("zoom"))


@query("w14_smooth_centers", f"""{D.with_('sidecar', recursive=True)}, {STRIP}, {RUNS}, v as (select *, start_x + w / 2.0::double as cx, w / 2.0::double as hw from r),
    z as (select incident_id, run, n, idx, greatest(hw, least(1920.0::double - hw, cx)) as sx from v where n = 1 union all select v.incident_id, v.run, v.n, v.idx, greatest(v.hw, least(1920.0::double - v.hw, 0.3::double * v.cx + 0.7::double * z.sx)) from z join v on v.incident_id = z.incident_id and v.run = z.run and v.n = z.n + 1)
    select incident_id, idx, cast(floor(sx * 100 + 0.123456789) as bigint) as sx from z""")  # fmt: skip
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.smooth_centers(strip(spark, sf_dir).withColumns({"x": C("start_x"), "y": C("start_y")})).select("incident_id", "idx", F.floor(C("sx") * 100 + 0.123456789).alias("sx"))


@query("w15_continuity", f"{D.with_('sidecar')}, {STRIP} select incident_id, idx, case when lag(camera) over w = camera then lag(end_x) over w else start_x end as start_x from s window w as (partition by incident_id order by idx)")
def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.continuity(strip(spark, sf_dir)).select("incident_id", "idx", "start_x")


@query("w16_resample_path", f"{D.with_('sidecar')}, {STRIP}, n as (select *, greatest(1, cast(round_even((end_sec - start_sec) * 4, 0) as integer)) as n from s), e as (select *, unnest(range(0, n)) as sample from n) select incident_id, idx, cast(sample as integer) as sample, cast(trunc(start_x + (end_x - start_x) * case when n > 1 then sample / (n - 1)::double else 0 end) as integer) & ~1 as x from e")
def w16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.resample_path(strip(spark, sf_dir), 4).select("incident_id", "idx", "sample", "x")


@query("w17_min_gap_sample", f"""{D.with_('sidecar', recursive=True)}, u as (select distinct incident_id, t::double as t from sidecar), k as (select incident_id, min(t) as t, 1 as n from u group by 1
    union all select k.incident_id, (select min(u.t) from u where u.incident_id = k.incident_id and u.t >= k.t + 5) as t, n + 1 from k where n < 4 and exists (select 1 from u where u.incident_id = k.incident_id and u.t >= k.t + 5)) select incident_id, t from k""")  # fmt: skip
def w17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.min_gap_sample(D.sidecar(spark, sf_dir), "incident_id", "t", 5.0, 4)


@query("l5_frame_manifest", f"{D.with_('sidecar')}, {ENTRIES}, n as (select *, row_number() over (partition by incident_id order by t, camera) as seq, count(*) over (partition by incident_id) as total from (select * from (select *, row_number() over (partition by incident_id order by t, camera) as r from entries) where r <= 20)) select incident_id, t, camera, cast(seq as integer) as seq, total, printf('frame_%03d_%s.jpg', seq, camera) as file from n where area > 0")
def l5(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = L.cap_frames(entries(spark, sf_dir), 20).withColumn("has_image", C("area") > 0)
    return L.frame_manifest(f).select("incident_id", "t", "camera", "seq", "total", "file")


@query("drop_no_person", f"{D.with_('sidecar')}, {ENTRIES} select incident_id, camera, t from entries where area > 0")
def no_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.drop_no_person(entries(spark, sf_dir), "area").select("incident_id", "camera", "t")


@query("f28_framing_mode", f"{D.with_('sidecar')} select incident_id, camera, t, case when max(area) filter (label = 'person') is null then 'center' when max(area) filter (label = 'person') >= 30000 * 0.4::double then 'full' else 'person' end as mode, coalesce(max(area) filter (label = 'person'), 0) as largest from sidecar group by 1, 2, 3")
def f28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.framing_mode(D.sidecar(spark, sf_dir).withColumn("frame_area", F.lit(30_000)))


@query("a22_coverage_report", f"{D.with_('sidecar')}, {STRIP}, b as (select *, w > 400 and h > 300 as bad from s) select camera, count(*) filter (bad) as n_bad, arg_min(start_sec, incident_id * 100000 + idx) filter (bad) as first_start, arg_max(end_sec, incident_id * 100000 + idx) filter (bad) as last_end from b group by 1")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.coverage_report(strip(spark, sf_dir).withColumn("bad", (C("w") > 400) & (C("h") > 300)))


@query("sidecars_with_fallback", f"{D.with_('sidecar')}, w as (select o_orderkey as incident_id, 'cam_' || (o_orderkey % 4) as camera from orders), n as (select incident_id, camera, max(case when camera = 'cam_1' then 0 else 1280 end) as nw from sidecar group by 1, 2) select w.incident_id, w.camera, coalesce(nullif(nw, 0), 1920) as native_width, nw is null as missing from w left join n using (incident_id, camera)")
def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    from camwatch.sources.files import sidecars_with_fallback

    want = D.read(spark, sf_dir, "orders").select(C("o_orderkey").alias("incident_id"), F.concat(F.lit("cam_"), (C("o_orderkey") % 4).cast("string")).alias("camera"))
    have = D.sidecar(spark, sf_dir).groupBy("incident_id", "camera").agg(F.max(F.when(C("camera") == "cam_1", 0).otherwise(1280)).alias("native_width"), F.lit(720).alias("native_height"))
    return sidecars_with_fallback(want, have).select("incident_id", "camera", "native_width", "missing")


# the fold: zoom and center of each end go from one slice of a run to the next
FOLD = f"""{CROPS}, o as (select *, row_number() over w as n, coalesce(lead(camera) over w <> camera, false) as holds, coalesce(lag(camera) over w = camera, false) as same from crops window w as (partition by incident_id order by idx)),
    o2 as (select incident_id, idx, camera, start_sec, end_sec, n, same, unnest([0, 1]) as e, unnest([start_x, if(holds, start_x, end_x)]) as x, unnest([start_y, if(holds, start_y, end_y)]) as y, unnest([start_w, if(holds, start_w, end_w)]) as w, unnest([start_h, if(holds, start_h, end_h)]) as h from o),
    v as (select *, greatest(0.4::double, least(1.0::double, sqrt(w * h / 2073600.0::double))) as raw from o2),
    zo as (select incident_id, n, e, raw as zoom from v where n = 1 union all select v.incident_id, v.n, v.e, case when v.same then 0.25::double * v.raw + 0.75::double * zo.zoom else v.raw end from zo join v on v.incident_id = zo.incident_id and v.e = zo.e and v.n = zo.n + 1),
    ne as (select v.*, greatest(1, least(1920, cast(trunc(sqrt(zoom * zoom * 2073600.0::double * (960 / 540::double))) as integer))) & ~1 as nw, greatest(1, least(1080, cast(trunc(sqrt(zoom * zoom * 2073600.0::double / (960 / 540::double))) as integer))) & ~1 as nh from v join zo using (incident_id, n, e)),
    ce as (select *, greatest(0, least(cast(trunc(x + w / 2.0::double - nw / 2.0::double) as integer), 1920 - nw)) + nw / 2.0::double as cx, greatest(0, least(cast(trunc(y + h / 2.0::double - nh / 2.0::double) as integer), 1080 - nh)) + nh / 2.0::double as cy from ne),
    sm as (select incident_id, n, e, greatest(nw / 2.0::double, least(1920 - nw / 2.0::double, cx)) as sx, greatest(nh / 2.0::double, least(1080 - nh / 2.0::double, cy)) as sy from ce where n = 1
    union all select c.incident_id, c.n, c.e, greatest(nw / 2.0::double, least(1920 - nw / 2.0::double, case when same then 0.3::double * cx + 0.7::double * sx else cx end)), greatest(nh / 2.0::double, least(1080 - nh / 2.0::double, case when same then 0.3::double * cy + 0.7::double * sy else cy end)) from sm join ce c on c.incident_id = sm.incident_id and c.e = sm.e and c.n = sm.n + 1),
    done as (select c.incident_id, idx, camera, start_sec, end_sec, n, same, e, cast(trunc(sx - nw / 2.0::double) as integer) as x, cast(trunc(sy - nh / 2.0::double) as integer) as y, nw as w, nh as h from ce c join sm using (incident_id, n, e)),
    path as (select d.incident_id, d.idx, d.camera, d.start_sec, d.end_sec, s.x as sx, s.y as sy, s.w as sw, s.h as sh, d.x as ex, d.y as ey, d.w as ew, d.h as eh from done d join done s on s.incident_id = d.incident_id and case when d.same then s.e = 1 and s.n = d.n - 1 else s.e = 0 and s.n = d.n end where d.e = 1),
    m as (select *, greatest(1, cast(round_even((end_sec - start_sec) * 20, 0) as integer)) as n from path), r as (select *, unnest(range(0, n)) as sample from m), q as (select *, case when n > 1 then sample / (n - 1)::double else 0 end as part from r)"""


@query("q6_crop_path", f"""{D.with_('sidecar', recursive=True)}, {FOLD} select incident_id, idx, camera, cast(sample as integer) as sample, cast(trunc(sx + (ex - sx) * part) as integer) & ~1 as x, cast(trunc(sy + (ey - sy) * part) as integer) & ~1 as y,
    greatest(2, cast(trunc(sw + (ew - sw) * part) as integer) & ~1) as w, greatest(2, cast(trunc(sh + (eh - sh) * part) as integer) & ~1) as h from q""")  # fmt: skip
def q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 crops a second."""
    s = D.sidecar(spark, sf_dir)
    return K.resample_path(K.crop_plan(L.camera_timeline(s), s), 20)


@query("q9_retention_plan", f"{D.with_('feed')} select start_us // 1000000 || '_' || event_id as name from feed where start_us // 1000000 < {NOW} - 3 * 86400 and ended")
def q9(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.feed(spark, sf_dir)
    inv = f.select(F.concat(F.expr("start_us div 1000000").cast("string"), F.lit("_"), C("event_id").cast("string")).alias("name"), F.lit(0).alias("mtime"))
    return P.retention_candidates(inv, f.filter("not ended").select(C("event_id").cast("string")), NOW, 3).select("name")
