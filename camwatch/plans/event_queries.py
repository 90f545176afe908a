"""Queries over the event feed: routing, joins, incidents, counts, windows, notification planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from camwatch.functions.scalars import sanitize_camera
from camwatch.operators import filters as P
from camwatch.operators import incidents as I
from camwatch.operators import joins as J
from camwatch.operators import notify as N
from camwatch.operators import reports as R
from camwatch.operators import store as T
from camwatch.operators.closing import exact_incidents, short_long
from camwatch.operators.late import review_targets as to_targets
from camwatch.operators.late import split_late
from camwatch.plans import feed as D
from camwatch.plans.registry import query

C = F.col
NOW = 1_705_000_000

INCIDENTS = """
    g as (select *, case when start_us - lag(start_us) over (partition by site_id order by start_us, event_id) >= {gap} * 1000000 or lag(start_us) over (partition by site_id order by start_us, event_id) is null then 1 else 0 end as fresh from {src}),
    q as (select *, sum(fresh) over (partition by site_id order by start_us, event_id rows unbounded preceding) as incident_seq from g),
    inc as (select *, site_id || '_' || min(start_us) over (partition by site_id, incident_seq) as incident_id from q)"""
KIND = "case when end_us - start_us < 5000000 then 'discarded' when end_us - start_us >= 120000000 then 'canceled' else 'kept' end"


def incidents(spark: SparkSession, sf_dir: str, gap: int = 900) -> DataFrame:
    return I.assign_incidents(D.feed(spark, sf_dir), gap)


def members(spark: SparkSession, sf_dir: str, gap: int = 900) -> DataFrame:
    return incidents(spark, sf_dir, gap).withColumn("kind", P.classify_duration(C("start_us"), C("end_us")))


@query("route_messages", f"{D.with_('feed')} select event_id, case k % 4 when 0 then 'events' when 1 then 'reviews' when 2 then 'updates' else 'rejected' end as route from feed")
def route(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = F.when(C("k") % 4 == 0, "events").when(C("k") % 4 == 1, "reviews").when(C("k") % 4 == 2, F.concat(C("camera"), F.lit("/tracked_object_update"))).otherwise("stats")
    return P.route_messages(D.feed(spark, sf_dir).withColumn("topic", topic)).select("event_id", "route")


@query("filter_camera_label", f"{D.with_('feed', 'camera_config')} select event_id, feed.camera, label from feed join camera_config c on c.camera = feed.camera where len(c.labels) = 0 or list_contains(c.labels, label)")
def camera_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.filter_camera_label(D.feed(spark, sf_dir), D.camera_config(spark, sf_dir)).select("event_id", "camera", "label")


STARTS = "c.camera is null or list_contains(list_transform(c.exceptions, lambda x: lower(trim(x))), label) or len(c.tracked_zones) = 0 or len(list_intersect(list_transform(c.tracked_zones, lambda x: lower(trim(x))), zones)) > 0"


@query("should_start_event", f"{D.with_('feed', 'camera_config')} select event_id, {STARTS} as starts from feed left join camera_config c on c.camera = feed.camera")
def should_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.should_start_event(D.feed(spark, sf_dir), D.camera_config(spark, sf_dir)).select("event_id", "starts")


@query("starts_from_messages", f"{D.with_('feed', 'camera_config')}, s as (select user_k, event_id, start_us, row_number() over (partition by user_k order by start_us, event_id) as n from (select *, event_id // 3 as user_k from feed) f left join camera_config c on c.camera = f.camera where {STARTS}) select user_k as track_id, event_id, start_us from s where n = 1")
def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.should_start_event(D.feed(spark, sf_dir), D.camera_config(spark, sf_dir)).filter("starts").withColumn("track_id", F.expr("event_id div 3"))
    return J.first_per_key(rows, ["track_id"], C("start_us"), C("event_id")).select("track_id", "event_id", "start_us")


@query("filter_review_state", f"{D.with_('feed')} select event_id from feed where not viewed and k % 13 <> 0 and k % 17 <> 0")
def review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.filter_review_state(D.feed(spark, sf_dir).withColumns({"saved": C("k") % 13 == 0, "test_run": C("k") % 17 == 0})).select("event_id")


@query("description_updates", f"{D.with_('feed')} select event_id from feed where k % 3 <> 2 and k % 5 <> 0")
def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.feed(spark, sf_dir).withColumns({"type": F.when(C("k") % 3 == 0, "description").when(C("k") % 3 == 2, "face"), "description": F.when(C("k") % 5 != 0, C("label")).otherwise("")})
    return P.description_updates(rows, "frames").select("event_id")


@query("review_updates", f"{D.with_('feed')} select event_id from feed where k % 4 <> 3 and (k % 3 = 0 or k % 5 = 0)")
def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.feed(spark, sf_dir).withColumns({"type": F.element_at(F.array(F.lit("update"), F.lit("end"), F.lit("genai"), F.lit("new")), C("k") % 4 + 1), "title": F.when(C("k") % 3 == 0, "t"), "description": F.when(C("k") % 5 == 0, "d").otherwise("")})
    return P.review_updates(rows, "frames").select("event_id")


@query("retention_candidates", f"{D.with_('feed')}, f as (select *, start_us // 1000000 as ts from feed) select case when k % 10 = 1 then 'test' || k else ts || '_' || event_id || case when k % 4 = 0 then '-canceled' else '' end end as name, case when k % 10 = 1 then ts - 7 else ts end as ts from f where k % 10 <> 2 and k % 10 <> 3 and case when k % 10 = 1 then ts - 7 else ts end < {NOW} - 3 * 86400 and not (k % 10 <> 1 and event_id % 6 = 0)")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.expr("start_us div 1000000")
    name = F.when(C("k") % 10 == 1, F.concat(F.lit("test"), C("k").cast("string"))).when(C("k") % 10 == 2, "saved").when(C("k") % 10 == 3, "no-number_x").otherwise(F.concat(ts.cast("string"), F.lit("_"), C("event_id").cast("string"), F.when(C("k") % 4 == 0, "-canceled").otherwise("")))
    f = D.feed(spark, sf_dir)
    return P.retention_candidates(f.select(name.alias("name"), (ts - 7).alias("mtime")), f.filter("event_id % 6 = 0").select(C("event_id").cast("string")), NOW, 3)


@query("sample_frames", f"{D.with_('sidecar')} select incident_id, camera, t, l_partkey, l_suppkey, round(t / case when l_suppkey % 4 > 0 then (l_suppkey % 4)::double else 30.0 end, 6) as ts from sidecar where t % 5 = 0")
def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sample_frames(D.sidecar(spark, sf_dir).withColumn("frame_number", C("t")), 5, C("l_suppkey") % 4).select("incident_id", "camera", "t", "l_partkey", "l_suppkey", F.round("timestamp_sec", 6).alias("ts"))


@query("j1_events_with_incident", f"{D.with_('feed')} select event_id, case when event_id % 3 <> 0 then 'incident/' || event_id // 5 else 'event/' || event_id end as timeline_target from feed")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.feed(spark, sf_dir)
    return J.events_with_incident(f, f.filter("event_id % 3 <> 0").select("event_id", F.expr("event_id div 5").alias("incident_id"))).select("event_id", "timeline_target")


@query("j2_apply_reviews", f"{D.with_('feed')}, r as (select o_orderkey as review_id, o_orderpriority as title, unnest([o_orderkey % 700, o_orderkey % 1000 + 5000000, o_orderkey * 7 % 900]) as event_id from orders) select review_id, r.event_id, title, camera from r join feed using (event_id)")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.read(spark, sf_dir, "orders")
    r = o.select(C("o_orderkey").alias("review_id"), C("o_orderpriority").alias("title"), F.array(C("o_orderkey") % 700, C("o_orderkey") % 1000 + 5_000_000, C("o_orderkey") * 7 % 900).alias("detections"))
    return J.apply_reviews(D.feed(spark, sf_dir).select("event_id", "camera"), r).select("review_id", "event_id", "title", "camera")


@query("j3_frames_of_known_events", "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_orderkey in (select event_id * 3 from events)")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = D.read(spark, sf_dir, "events").select((C("event_id") * 3).alias("l_orderkey"))
    return J.of_known(D.read(spark, sf_dir, "lineitem"), known, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("j4_asof_nearest", f"""{D.with_('feed')}, l as (select event_id, site_id, start_us as t from feed where label = 'error'), r as (select site_id, start_us as rt, min(event_id) as rid from feed where label = 'signup' group by 1, 2),
    b as (select l.*, r.rt as bt, r.rid as bid from l asof left join r on l.site_id = r.site_id and l.t >= r.rt), a as (select b.*, r.rt as aft, r.rid as aid from b asof left join r on b.site_id = r.site_id and b.t <= r.rt)
    select event_id, case when bt is null then aid when aft is null or t - bt <= aft - t then bid else aid end as nearest from a""")  # fmt: skip
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.feed(spark, sf_dir)
    left = f.filter("label = 'error'").select("site_id", "event_id", C("start_us").alias("t"))
    right = f.filter("label = 'signup'").select("site_id", C("start_us").alias("t"), C("event_id").alias("rid"))
    return J.asof_nearest(left, right, ["site_id"], "t", cell=J.CELL * 1_000_000).select("event_id", C("entry.rid").alias("nearest"))


@query("j6_detections_in_interval", f"{D.with_('feed')}, s as (select event_id as seg, site_id, start_us as a, end_us as b from feed where label = 'error') select seg, event_id from feed join s on feed.site_id = s.site_id and start_us >= a and start_us < b")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.feed(spark, sf_dir)
    seg = f.filter("label = 'error'").select("site_id", C("event_id").alias("seg"), C("start_us").alias("a"), C("end_us").alias("b"))
    return J.in_interval(f.select("site_id", "event_id", "start_us"), seg, ["site_id"], "start_us", "a", "b", 600_000_000).select("seg", "event_id")


@query("j7_unviewed", f"{D.with_('feed')} select event_id from feed where not viewed")
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.feed(spark, sf_dir).select("event_id", "viewed")
    return J.without(f, f.filter("viewed"), "event_id").select("event_id")


@query("j8_protect_active", f"{D.with_('feed')} select event_id from feed where end_us - start_us >= 5000000 and ended")
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.feed(spark, sf_dir).select("event_id", "ended", "start_us", "end_us")
    return J.without(J.without(f, f.filter("not ended"), "event_id"), f.filter("end_us - start_us < 5000000"), "event_id").select("event_id")


@query("j9_exports_with_clip", f"{D.with_('feed')}, e as (select event_id as entry_id, event_id // 3 as export_id, start_us as ts from feed where k % 2 = 0 and k % 3 <> 0 and k % 5 <> 0), n as (select *, row_number() over (partition by export_id order by ts, entry_id) as n from e where export_id % 4 <> 0) select export_id, entry_id from n where n = 1")
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.feed(spark, sf_dir)
    t = f.select(C("event_id").alias("entry_id"), F.when(C("k") % 2 == 0, "api").otherwise("mqtt").alias("source"), F.when(C("k") % 3 != 0, "in").otherwise("out").alias("direction"), F.when(C("k") % 5 != 0, "Clip export response for x").otherwise("other").alias("label"), F.expr("event_id div 3").alias("export_id"), C("start_us").alias("ts")).withColumn("clip", F.concat(F.lit("c"), C("export_id").cast("string")))
    files = f.select(F.concat(F.lit("c"), C("event_id").cast("string")).alias("path")).filter("cast(substring(path, 2) as bigint) % 4 <> 0")
    return J.exports_with_clip(t, files, "Clip export response").select("export_id", "entry_id")


@query("j10_suppress_snoozed", f"""{D.with_('feed', 'snoozes')}, s as (select camera, set_us, max(struct_pack(expiration_us := expiration_us, n := snooze_notifications)) as s from snoozes group by 1, 2),
    t as (select event_id, start_us, unnest(list_distinct([camera, 'cam_' || (k % 8)])) as camera from feed), h as (select t.*, s.s from t asof left join s on t.camera = s.camera and t.start_us >= s.set_us)
    select event_id, bool_and(coalesce(s.expiration_us > start_us and s.n, false)) as suppressed from h group by event_id""")  # fmt: skip
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.feed(spark, sf_dir)
    targets = f.select(C("event_id").alias("target_id"), C("start_us").alias("ts_us"), F.array(C("camera"), F.concat(F.lit("cam_"), (C("k") % 8).cast("string"))).alias("cameras"))
    return J.suppress_snoozed(targets, D.snoozes(spark, sf_dir), "snooze_notifications").select(C("target_id").alias("event_id"), "suppressed")


@query("j11_canonical_camera", "with c as (select min(c_name) as name, lower(replace(regexp_replace(c_name, '#', '', 'g'), ' ', '_')) as folder from customer where c_custkey % 3 = 0 group by 2), f as (select distinct lower(replace(regexp_replace(c_name, '#', '', 'g'), ' ', '_')) as folder from customer) select f.folder, coalesce(name, f.folder) as canonical from f left join c using (folder)")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.read(spark, sf_dir, "customer")
    return J.canonical_camera(c.select(sanitize_camera(C("c_name")).alias("folder")).distinct(), c.filter("c_custkey % 3 = 0").select(C("c_name").alias("camera")), sanitize_camera).select("folder", "canonical")


@query("j12_match_exports", f"""{D.with_('feed')}, r as (select event_id as request_id, case when k % 3 = 0 then event_id + 1 end as wanted, case when k % 3 = 1 then 'f' || (event_id + 2) else 'none' end as file_name, case when k % 5 = 2 then 'f' || (event_id + 3) else 'nothing' end as asked from feed),
    e as (select event_id as export_id, 'f' || event_id as name, start_us as created from feed where k % 4 <> 0),
    m as (select request_id, export_id, created, 1 as p from r join e on wanted = export_id union all select request_id, export_id, created, 2 from r join e on file_name = name union all select request_id, export_id, created, 3 from r join e on asked = name union all
          select request_id, export_id, created, 4 from r, (select * from e order by created desc, export_id desc limit 1) where wanted is null),
    n as (select *, row_number() over (partition by request_id order by p, created desc, export_id desc) as n from m) select request_id, export_id, p as priority from n where n = 1""")  # fmt: skip
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.feed(spark, sf_dir)
    r = f.select(C("event_id").alias("request_id"), F.when(C("k") % 3 == 0, C("event_id") + 1).alias("export_id"), F.when(C("k") % 3 == 1, F.concat(F.lit("f"), (C("event_id") + 2).cast("string"))).otherwise("none").alias("file_name"), F.when(C("k") % 5 == 2, F.concat(F.lit("f"), (C("event_id") + 3).cast("string"))).otherwise("nothing").alias("requested_name"))
    e = f.select(C("event_id").alias("export_id"), F.concat(F.lit("f"), C("event_id").cast("string")).alias("name"), C("start_us").alias("created"), (C("k") % 4 == 0).alias("in_progress"))
    return J.match_exports(r, e).select("request_id", "export_id", "priority")


@query("j13_metadata_fallback", f"{D.with_('feed')}, i as (select event_id // 4 as incident_id, max(case when event_id % 8 < 2 then label else '' end) as own, min(case when k % 3 = 0 then camera || '|' || label end) as alt from feed group by 1) select incident_id, case when own <> '' then own else nullif(split_part(alt, '|', 2), '') end as meta from i")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.feed(spark, sf_dir).withColumn("incident_id", F.expr("event_id div 4"))
    own = f.groupBy("incident_id").agg(F.max(F.when(C("event_id") % 8 < 2, C("label")).otherwise("")).alias("meta"))
    cams = f.filter("k % 3 = 0").groupBy("incident_id", "camera").agg(F.min("label").alias("meta"))
    return J.metadata_fallback(own, cams).select("incident_id", "meta")


@query("j14_representative_event", f"{D.with_('feed')}, {INCIDENTS.format(gap=900, src='feed')}, n as (select incident_id, camera, event_id, row_number() over (partition by incident_id, camera order by end_us - start_us desc, start_us, event_id) as n from inc) select incident_id, camera, event_id from n where n = 1")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.representative_event(incidents(spark, sf_dir)).select("incident_id", "camera", "event_id")


for _gap in (120, 900):

    @query(f"w1_assign_incidents_{_gap}", f"{D.with_('feed')}, {INCIDENTS.format(gap=_gap, src='feed')} select event_id, cast(incident_seq as bigint) as incident_seq, incident_id from inc")
    def w1(spark: SparkSession, sf_dir: str, gap: int = _gap) -> DataFrame:
        return incidents(spark, sf_dir, gap).select("event_id", "incident_seq", "incident_id")

    @query(f"w1_assign_incidents_by_day_{_gap}", f"{D.with_('feed')}, {INCIDENTS.format(gap=_gap, src='feed')} select event_id, incident_id from inc")
    def w1_day(spark: SparkSession, sf_dir: str, gap: int = _gap) -> DataFrame:
        return I.assign_incidents_by_day(D.feed(spark, sf_dir), gap).select("event_id", "incident_id")

    @query(f"a6_rollup_incidents_{_gap}", f"""{D.with_('feed')}, {INCIDENTS.format(gap=_gap, src='feed')}, m as (select *, {KIND} as kind from inc),
        c as (select incident_id, string_agg(camera, ',' order by s, e) as cameras, count(*) as n_cameras from (select incident_id, camera, min(start_us) as s, arg_min(event_id, start_us::hugeint * 100000000 + event_id) as e from m group by 1, 2) group by 1)
        select incident_id, min(start_us) as start_us, max(start_us) as last_activity_us, max(case when kind <> 'discarded' then end_us end) as end_max_us, string_agg(distinct label, ', ' order by label) as label, max(threat) as threat,
               count(*) filter (kind <> 'discarded') as n_events, arg_min(event_id, start_us::hugeint * 100000000 + event_id) filter (kind <> 'discarded') as primary_event, bool_or(kind = 'canceled') as canceled, any_value(cameras) as cameras, any_value(n_cameras) as n_cameras,
               arg_max('T ' || k, start_us::hugeint * 100000000 + event_id) filter (k % 4 = 1) as title, arg_max('D ' || k, start_us::hugeint * 100000000 + event_id) filter (k % 3 = 1) as description
        from m join c using (incident_id) group by incident_id having count(*) filter (kind <> 'discarded') > 0""")  # fmt: skip
    def a6(spark: SparkSession, sf_dir: str, gap: int = _gap) -> DataFrame:
        texts = {"title": F.when(C("k") % 4 == 1, F.concat(F.lit("T "), C("k").cast("string"))), "description": F.when(C("k") % 3 == 1, F.concat(F.lit("D "), C("k").cast("string")))}
        return I.rollup_incidents(members(spark, sf_dir, gap).withColumns(texts))


@query("q1_incident_feed", f"""{D.with_('feed', 'camera_config')}, ok as (select feed.* from feed join camera_config c on c.camera = feed.camera where (len(c.labels) = 0 or list_contains(c.labels, label)) and ({STARTS})),
    {INCIDENTS.format(gap=900, src='ok')}, m as (select *, {KIND} as kind from inc)
    select incident_id, min(start_us) as start_us, count(*) filter (kind <> 'discarded') as n_events, count(distinct camera) as n_cameras, string_agg(distinct label, ', ' order by label) as label, max(threat) as threat, bool_or(kind = 'canceled') as canceled
    from m group by incident_id having count(*) filter (kind <> 'discarded') > 0""")  # fmt: skip
def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All incidents of what passes the camera, label and zone filters, newest first."""
    config = D.camera_config(spark, sf_dir)
    ok = P.should_start_event(P.filter_camera_label(D.feed(spark, sf_dir), config), config).filter("starts")
    m = I.assign_incidents(ok, 900).withColumn("kind", P.classify_duration(C("start_us"), C("end_us")))
    return I.rollup_incidents(m).select("incident_id", "start_us", "n_events", "n_cameras", "label", "threat", "canceled").orderBy(F.desc("start_us"), "incident_id")


@query("classify_incident_canceled", f"{D.with_('feed')}, {INCIDENTS.format(gap=900, src='feed')} select incident_id, bool_or(case when ended then end_us else start_us + 30000000 end - start_us >= 120000000) as canceled from inc group by 1")
def canceled(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(C("ended"), C("end_us")).otherwise(C("start_us") + 30_000_000)
    return incidents(spark, sf_dir).groupBy("incident_id").agg(F.bool_or(end - C("start_us") >= 120_000_000).alias("canceled"))


@query("a7_incident_span", f"{D.with_('feed')}, {INCIDENTS.format(gap=900, src='feed')}, s as (select incident_id, min(start_us) as start_us, max(case when ended then end_us else start_us + 30000000 end) as end_us from inc group by 1) select *, start_us // 1000000 - 5 as export_from, end_us // 1000000 + 30 as export_to, start_us // 1000000 - 15 as summary_from, end_us // 1000000 + 15 as summary_to from s")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.incident_span(incidents(spark, sf_dir).withColumn("end_us", F.when(C("ended"), C("end_us"))))


PHASED = "select *, case when k % 5 = 0 then 'NEW' when k % 5 < 3 then 'DESCRIBED' else 'FINALIZED' end as phase from feed"


@query("a1_active_event_stats", f"{D.with_('feed')}, e as ({PHASED}) select 'total' as kind, '' as name, count(*) as n from e union all select 'camera', camera, count(*) from e group by camera union all select 'phase', p, count(e.phase) from (select unnest(['NEW','DESCRIBED','FINALIZED','SUMMARIZED']) as p) left join e on e.phase = p group by p")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.active_event_stats(D.feed(spark, sf_dir).withColumn("phase", F.when(C("k") % 5 == 0, "NEW").when(C("k") % 5 < 3, "DESCRIBED").otherwise("FINALIZED")))


@query("a2_event_period_counts", f"{D.with_('feed')}, e as (select *, start_us // 1000000 as ts from feed where k % 9 <> 0) select count(*) filter (ts >= {NOW} - 86400) as last_day, count(*) filter (ts >= {NOW} - 7 * 86400) as last_week, count(*) filter (ts >= {NOW} - 30 * 86400) as last_month, count(*) filter (viewed) as reviewed, count(*) filter (not viewed) as unreviewed from e")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.event_period_counts(D.feed(spark, sf_dir).withColumn("ts", F.when(C("k") % 9 != 0, F.expr("start_us div 1000000"))), NOW)


@query("a3_events_by_camera", f"{D.with_('feed')}, {INCIDENTS.format(gap=900, src='feed')} select camera, count(distinct incident_id) as n from inc group by 1")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.events_by_camera(incidents(spark, sf_dir).groupBy("incident_id").agg(F.collect_set("camera").alias("cameras")))


@query("a4_most_recent_event", f"{D.with_('feed')} select event_id, camera, start_us from feed order by start_us desc, camera, event_id limit 1")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.most_recent_event(D.feed(spark, sf_dir))


@query("a5_storage_stats", f"""{D.with_('file_inventory')}, r as (select *, row_number() over (partition by folder, camera, case when lower(file) like '%.mp4' then 'clip' else file end order by mtime desc, file desc) as n from file_inventory),
    v as (select camera, case when lower(file) like '%.mp4' and n = 1 and camera is not null then size else 0 end as clips, case when file = 'snapshot.jpg' and camera is not null then size else 0 end as snapshots,
                 case when camera is not null and file in ('summary.txt', 'metadata.json', 'review_summary.md') or camera is null and file in ('notification.gif', 'review_summary.md') then size else 0 end as descriptions from r)
    select camera, cast(sum(clips) as bigint) as clips, cast(sum(snapshots) as bigint) as snapshots, cast(sum(descriptions) as bigint) as descriptions from v where camera is not null group by camera
    union all select null, cast(sum(clips) as bigint), cast(sum(snapshots) as bigint), cast(sum(descriptions) as bigint) + (select sum(n_chars) from documents where doc_id % 9 = 0) from v""")  # fmt: skip
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = D.read(spark, sf_dir, "documents").filter("doc_id % 9 = 0").select(C("n_chars").alias("size"))
    return T.storage_stats(D.file_inventory(spark, sf_dir), reports)


@query("resolve_latest_file", f"{D.with_('file_inventory')}, r as (select *, row_number() over (partition by folder, camera order by mtime desc, file desc, size desc) as n from file_inventory where lower(file) like '%.mp4') select folder, camera, file, size from r where n = 1")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.resolve_latest_file(D.file_inventory(spark, sf_dir))


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of four events each: event_id, pos, source, label, type, data, ts_us."""
    f = D.feed(spark, sf_dir)
    s = F.expr("start_us div 1000000").cast("string")
    data = (
        F.when(C("k") % 9 == 4, F.concat(F.lit('{"start_time":'), s, F.lit(',"end_time":'), s, F.lit(".25}")))
        .when(C("k") % 4 == 0, F.concat(F.lit('{"payload":{"type":"end","after":{"end_time":'), s, F.lit(".5}}}")))
        .when(C("k") % 4 == 1, F.lit('{"payload":{"type":"new","after":{"end_time":"soon"}}}'))
        .when(C("k") % 8 == 2, F.concat(F.lit('{"payload":{"before":{"created_at":'), s, F.lit('},"after":{"created_at":0,"start_time":5}}}')))
        .when(C("k") % 4 == 2, F.concat(F.lit('{"payload":{"after":{"start_time":'), s, F.lit("}}}")))
        .otherwise("{}")
    )
    return f.select(
        F.expr("event_id div 4").alias("event_id"), C("event_id").alias("pos"), F.when(C("k") % 9 == 4, "test_ai_prompt").otherwise("mqtt").alias("source"), F.when(C("k") % 6 == 5, "Event end seen").otherwise(C("label")).alias("label"),
        data.alias("data"), C("start_us").alias("ts_us"), "k", "camera", "zones", (C("start_us") + 1).alias("mt"),
    )


@query("a8_end_timestamp", f"{D.with_('feed')} select event_id // 4 as event_id, max(case when k % 9 = 4 then start_us // 1000000 + 0.25::double when k % 4 = 0 then start_us // 1000000 + 0.5::double end) as end_time from feed group by 1")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.end_timestamp(timeline(spark, sf_dir))


@query("a9_event_ended", f"{D.with_('feed')} select event_id // 4 as event_id, bool_or(k % 9 <> 4 and k % 4 < 2 or k % 6 = 5) as ended from feed group by 1")
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.event_ended(timeline(spark, sf_dir))


@query("a10_camera_zones", f"{D.with_('feed')} select camera, string_agg(distinct z, ',' order by z) as zones from (select camera, unnest(zones) as z from feed) group by 1")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.camera_zones(D.feed(spark, sf_dir))


@query("a11_genai_entries", f"{D.with_('feed')}, g as (select event_id // 10 as event_id, event_id as pos, case when k % 3 = 0 then '' else 'T ' || k % 2 end as title, case when k % 3 = 0 then 'No concerns' else label end as summary from feed where k % 4 <> 0), n as (select *, row_number() over (partition by event_id, trim(title), summary order by pos) as n from g where title <> '') select event_id, pos from n where n = 1")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.feed(spark, sf_dir)
    e = f.select(F.expr("event_id div 10").alias("event_id"), C("event_id").alias("pos"), F.when(C("k") % 4 != 0, "genai").otherwise("update").alias("type"), F.when(C("k") % 3 == 0, "").otherwise(F.concat(F.lit("T "), (C("k") % 2).cast("string"))).alias("title"), F.when(C("k") % 3 == 0, "No concerns").otherwise(F.concat(C("label"), F.lit(" "))).alias("summary"), F.lit(None).cast("string").alias("scene"))
    return T.genai_entries(e).select("event_id", "pos")


@query("a17_daily_events", f"{D.with_('feed')} select event_id from feed where cast(make_timestamp(start_us) as date) = date '2024-01-05'")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.daily_events(D.feed(spark, sf_dir).withColumn("ts", F.expr("start_us div 1000000")), F.lit("2024-01-05").cast("date")).select("event_id")


@query("a18_report_lines", f"{D.with_('feed')}, l as (select cast(make_timestamp(start_us) as date) as report_date, start_us // 1000000 as ts, '[' || strftime(make_timestamp(start_us), '%I:%M %p') || '] ' || label || ': ' || camera || ' (Threat: ' || threat || ')' as line from feed) select cast(report_date as varchar) as report_date, ts, line, row_number() over (partition by report_date order by ts, line) as place from l")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.report_lines(D.feed(spark, sf_dir).select(F.expr("start_us div 1000000").alias("ts"), C("label").alias("title"), C("camera").alias("summary"), "threat")).withColumn("report_date", C("report_date").cast("string"))


@query("a18_report_json", f"""{D.with_('feed')}, e as (select strftime(make_timestamp(start_us), '%Y-%m-%d %I:%M:%S %p') as time, cast(cast(make_timestamp(start_us) as date) as varchar) as report_date, * from feed)
    select report_date, time, '{{"title":"' || label || '","scene":"' || case when k % 2 = 0 then 'S' else '' end || '","confidence":0.5,"threat_level":' || case when k % 5 = 0 then 0 else threat end || ',"camera":"' || camera || '","time":"' || time || '","context":[' || case when k % 3 = 0 then '"c"' else '' end || ']}}' as entry from e""")  # fmt: skip
def a18_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.feed(spark, sf_dir)
    rows = f.select(F.expr("start_us div 1000000").alias("ts"), C("label").alias("title"), F.when(C("k") % 2 == 0, "S").alias("scene"), F.lit(0.5).alias("confidence"), F.when(C("k") % 5 == 0, "bad").otherwise(C("threat").cast("string")).alias("threat"), "camera", F.when(C("k") % 3 == 0, F.array(F.lit("c"))).alias("context"))
    return R.report_json(rows).withColumn("report_date", C("report_date").cast("string"))


@query("a19_export_turnaround", f"{D.with_('feed')} select event_id // 20 as event_id, max(case when label = 'purchase' then start_us end) - min(case when label = 'signup' then start_us end) as turnaround_us from feed group by 1")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.export_turnaround(D.feed(spark, sf_dir).select(F.expr("event_id div 20").alias("event_id"), "label", C("start_us").alias("ts_us")), "signup", "purchase")


@query("a20_unread_count", f"{D.with_('feed')} select count(*) as unread from feed where not viewed and k % 17 <> 0")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.feed(spark, sf_dir).filter("k % 17 <> 0").select("event_id", "viewed")
    return J.without(f, f.filter("viewed"), "event_id").agg(F.count("*").alias("unread"))


@query("a21_outcome_summary", f"{D.with_('feed')} select case when k % 5 < 2 then 'success' when k % 5 < 4 then 'already_gone' else 'failure' end as outcome, count(*) as n, cast(null as varchar) as reason from feed group by 1")
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.feed(spark, sf_dir)
    return R.outcome_summary(f.select(F.element_at(F.array(*[F.lit(x) for x in (200, 204, 404, 422, 500)]), C("k") % 5 + 1).alias("code")), f.select(C("k").alias("n_entries")))


@query("a23_timeline_time_range", f"{D.with_('feed')}, g as (select event_id // 4 as event_id, min(case when k % 9 = 4 or k % 4 = 2 then start_us // 1000000 end)::double as a, max(case when k % 9 = 4 then start_us // 1000000 + 0.25::double when k % 4 = 0 then start_us // 1000000 + 0.5::double end) as b, max(start_us + 1) as m from feed group by 1) select event_id, case when a is not null and b is not null then a else m - 60 end as start_s, case when a is not null and b is not null then b else m end as end_s from g")
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.timeline_time_range(timeline(spark, sf_dir), C("mt"))


@query("a25_request_rate", "select epoch_us(time_bucket(interval '5 minutes', ts)) as window_us, count(*) as n from events group by 1")
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.request_rate(D.read(spark, sf_dir, "events").select(C("ts").cast("timestamp").alias("ts")))


@query("a26_list_cameras", f"{D.with_('feed', 'camera_config')} select camera from feed union select camera from camera_config")
def a26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.list_cameras(D.feed(spark, sf_dir), D.camera_config(spark, sf_dir))


@query("w18_last_n_frames", f"{D.with_('sidecar')}, n as (select *, row_number() over (partition by incident_id order by t desc, l_partkey desc, l_suppkey desc, camera desc, x2 desc, label desc) as n from sidecar) select incident_id, t, l_partkey, l_suppkey from n where n <= 5")
def w18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.last_n_frames(D.sidecar(spark, sf_dir), 5, "incident_id", "t", "l_partkey", "l_suppkey", "camera", "x2", "label").select("incident_id", "t", "l_partkey", "l_suppkey")


@query("w19_clear_previous_tag", f"{D.with_('feed')}, s as (select *, case when k % 10 > 0 then 'tag_' || (k % 2) end as tag, k % 3 > 0 as ok from feed), e as (select *, sum(case when tag is null then 1 else 0 end) over (partition by site_id order by start_us, event_id rows unbounded preceding) as ends from s), p as (select *, lag(tag) over w as pt, lag(ends) over w as pe from e where tag is not null and ok window w as (partition by site_id order by start_us, event_id)) select event_id, case when pt = tag and pe = ends then pt end as clear_tag from p")
def w19(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.feed(spark, sf_dir).select("site_id", C("start_us").alias("ts_us"), C("event_id").alias("id"), F.when(C("k") % 10 > 0, F.concat(F.lit("tag_"), (C("k") % 2).cast("string"))).alias("tag"), (C("k") % 3 > 0).alias("ok"))
    return N.clear_previous_tag(s).select(C("id").alias("event_id"), "clear_tag")


# the state of a site goes from one request to the next, as a list of what was admitted, or of what waits
@query("w20_rolling_frame_cap", f"""{D.with_('feed', recursive=True)}, r as (select site_id, start_us as ts, event_id, k, row_number() over (partition by site_id order by start_us, event_id) as n from feed),
    f as (select distinct site_id, 0::bigint as n, null::bigint as event_id, null::boolean as admitted, []::struct(t bigint, k bigint)[] as held from r
    union all select site_id, n, event_id, ok, case when ok then list_append(now, struct_pack(t := ts, k := k::bigint)) else now end
    from (select *, coalesce(list_sum(list_transform(now, lambda x: x.k)), 0) + k <= 200 as ok from (select r.*, list_filter(f.held, lambda x: x.t >= r.ts - 3600000000) as now from f join r on r.site_id = f.site_id and r.n = f.n + 1)))
    select event_id as request_id, admitted from f where n > 0""")  # fmt: skip
def w20(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.feed(spark, sf_dir).select("site_id", C("start_us").alias("ts_us"), C("event_id").alias("request_id"), C("k").cast("long").alias("frames"))
    return N.rolling_frame_cap(r, 200, 3600).select("request_id", "admitted")


# over r (site_id, ts, event_id, n): a step is a second of the queue's clock or the next request, whichever comes first
LIMITED = """f as (select distinct site_id, 0::bigint as n, []::bigint[] as sent, []::bigint[] as waiting, false as told, 0::bigint as clock, []::struct(id bigint, what varchar, sent bigint)[] as e from r
    union all select site_id, if(tick, n, n + 1), if(goes, list_append(near, now), near),
        if(tick, if(goes, waiting[2:], waiting), if(goes, waiting, if(waits, list_append(waiting, event_id), []))),
        if(tick, told and (not goes or len(waiting) > 10), told or not (goes or waits)), if(tick or (not goes and len(waiting) = 0), now, clock),
        if(goes, [struct_pack(id := if(tick, waiting[1], event_id), what := if(tick, 'queued', 'sent'), sent := now)],
            if(tick or waits, [], list_append(list_transform(waiting, lambda x: struct_pack(id := x, what := 'dropped', sent := null::bigint)), struct_pack(id := event_id, what := 'overflow', sent := now))))
    from (select *, len(near) < 2 as goes, told or len(waiting) < 10 as waits from (select *, list_filter(sent, lambda x: x > now - 5000000) as near
    from (select f.*, r.event_id, len(waiting) > 0 and (r.ts is null or clock + 1000000 <= r.ts) as tick, if(tick, clock + 1000000, r.ts) as now from f left join r on r.site_id = f.site_id and r.n = f.n + 1) where now is not null))),
    lim as (select x.id as request_id, x.what as outcome, x.sent as sent_us from (select unnest(e) as x from f))"""


@query("w21_rate_limit", f"""{D.with_('feed', recursive=True)}, r as (select site_id, start_us // 400 as ts, event_id, row_number() over (partition by site_id order by start_us // 400, event_id) as n from feed),
    {LIMITED} select * from lim""")  # fmt: skip
def w21(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.feed(spark, sf_dir).select("site_id", F.expr("start_us div 400").alias("ts_us"), C("event_id").alias("request_id"))
    return N.rate_limit(r).select("request_id", "outcome", "sent_us")


@query("w22_recent_errors", f"{D.with_('feed')} select start_us as ts_us, event_id as log_id, case when label = 'error' then 'ERROR' else 'WARNING' end as level, repeat(label, 100)[1:500] as message from feed where label in ('error', 'click') order by start_us desc, event_id desc limit 10")
def w22(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = D.feed(spark, sf_dir).select(C("start_us").alias("ts_us"), C("event_id").alias("log_id"), F.when(C("label") == "error", "ERROR").when(C("label") == "click", "WARNING").otherwise("INFO").alias("level"), F.repeat("label", F.lit(100)).alias("message"))
    return T.recent_errors(log)


@query("w23_first_per_key", f"{D.with_('feed')}, n as (select event_id // 3 as track, event_id, row_number() over (partition by event_id // 3, label order by start_us, event_id) as n from feed) select track, event_id from n where n = 1")
def w23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.first_per_key(D.feed(spark, sf_dir).withColumn("track", F.expr("event_id div 3")), ["track", "label"], C("start_us"), C("event_id")).select("track", "event_id")


@query("w24_event_phase", f"{D.with_('feed')}, x as (select event_id // 6 as id, * from feed), d as (select id, arg_max(camera, start_us) as d from x where k % 2 = 0 group by 1), r as (select id, arg_max(label, start_us) as r from x where k % 7 = 1 group by 1) select e.id as event_id, case when r is not null then 'FINALIZED' when d is not null then 'DESCRIBED' else 'NEW' end as phase, d as ai_description, r as description from (select distinct id from x) e left join d using (id) left join r using (id)")
def w24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal times the event with the least id counts, which is the SQL's first row."""
    x = D.feed(spark, sf_dir).withColumn("seq", C("event_id")).withColumn("event_id", F.expr("event_id div 6"))
    d = x.filter("k % 2 = 0").select("event_id", C("start_us").alias("ts"), "seq", C("camera").alias("text"))
    r = x.filter("k % 7 = 1").select("event_id", C("start_us").alias("ts"), "seq", C("label").alias("text"))
    return I.event_phase(d, r, x.select("event_id").distinct())


@query("w25_apply_review_flags", f"{D.with_('feed')}, c as (select event_id // 5 as id, event_id, start_us, k % 3 = 0 as v, k % 2 = 0 as isv from feed) select e.id as event_id, coalesce((select arg_max(v, start_us) from c where c.id = e.id and isv), false) as viewed, coalesce((select arg_max(v, start_us) from c where c.id = e.id and not isv), false) as kept from (select distinct id from c) e")
def w25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal times the event with the least id counts, which is the SQL's first row: changes are numbered downwards."""
    f = D.feed(spark, sf_dir).withColumn("id", F.expr("event_id div 5"))
    flags = f.select(C("id").alias("event_id"), (-C("event_id")).alias("change_id"), C("start_us").alias("ts_us"), F.when(C("k") % 2 == 0, "viewed").otherwise("kept").alias("flag"), (C("k") % 3 == 0).alias("value"))
    return T.apply_review_flags(f.select(C("id").alias("event_id")).distinct(), flags)


@query("l1_list_events", f"{D.with_('feed')} select event_id, start_us as ts from feed")
def l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered by a range sort; a test compares the order."""
    return T.list_events(D.feed(spark, sf_dir).select("event_id", C("start_us").alias("ts")))


@query("l2_timeline_newest_first", f"{D.with_('feed')} select event_id as pos, case when k % 4 > 0 then cast(start_us as varchar) end as ts from feed")
def l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered by a range sort; a test compares the order."""
    return T.timeline_newest_first(D.feed(spark, sf_dir).select(C("event_id").alias("pos"), F.when(C("k") % 4 > 0, C("start_us").cast("string")).alias("ts")))


@query("l6_link_check_plan", f"{D.with_('file_inventory')}, f as (select distinct folder from file_inventory order by folder limit 20) select folder, camera, file from file_inventory join f using (folder) order by folder, coalesce(camera, ''), file, mtime limit 120")
def l6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.link_check_plan(D.file_inventory(spark, sf_dir)).select("folder", "camera", "file")


@query("l7_event_files", f"{D.with_('file_inventory')}, r as (select *, row_number() over (partition by folder, camera, lower(file) like '%.mp4' order by mtime desc, file desc) as n from file_inventory) select distinct folder, camera, file from r where camera is null or (lower(file) like '%.mp4' and n = 1) or file in ('snapshot.jpg', 'summary.txt')")
def l7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.event_files(D.file_inventory(spark, sf_dir), ("snapshot.jpg", "summary.txt"))


@query("s1_union_event_layouts", f"{D.with_('feed')} select event_id, camera, null as cameras from feed where k % 2 = 0 union all select event_id, 'events', camera from feed where k % 2 = 1")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.feed(spark, sf_dir)
    return T.union_event_layouts(f.filter("k % 2 = 0").select("event_id", "camera"), f.filter("k % 2 = 1").select("event_id", F.lit("events").alias("camera"), C("camera").alias("cameras")))


@query("s3_union_timeline_parts", f"{D.with_('feed')} select event_id, label, 0 as part from feed where k % 3 = 0 union all select event_id, label, 1 from feed where k % 2 = 0")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.feed(spark, sf_dir).select("event_id", "label", "k")
    return T.union_timeline_parts(f.filter("k % 3 = 0"), f.filter("k % 2 = 0")).select("event_id", "label", "part")


@query("list_report_dates", "select distinct cast(cast(ts as date) as varchar) as report_date from events where event_id % 3 = 0")
def report_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.read(spark, sf_dir, "events")
    name = F.when(C("event_id") % 3 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("_report.md"))).when(C("event_id") % 3 == 1, "2024-13-99_report.md").otherwise("notes.md")
    return R.list_report_dates(e.select(name.alias("file"))).select(C("report_date").cast("string"))


@query("report_retention", "select distinct cast(cast(ts as date) as varchar) as report_date from events where cast(ts as date) < date '2024-01-25' - 7")
def report_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.read(spark, sf_dir, "events").select(F.to_date("ts").alias("report_date")).distinct()
    return R.report_retention(d, F.lit("2024-01-25").cast("date"), 7).select(C("report_date").cast("string"))


RESULTS = """res as (select event_id as notification_id, 'hub' as provider, 'sent' as status, label as message from feed union all select event_id, 'push', case when k % 2 = 0 then 'sent' else 'skipped' end, camera from feed
    union all select event_id, 'mail', case when k % 5 = 1 then 'failure' else 'success' end, case when k % 5 = 1 then 'no address for ' || camera end from feed where k % 3 <> 0)"""


def mail(n: dict) -> dict | None:
    """A sender that skips some notifications and fails for others."""
    if n["k"] % 3 == 0:
        return None
    if n["k"] % 5 == 1:
        raise ValueError(f"no address for {n['camera']}")
    return {"status": "success"}


def results(notifications: DataFrame) -> DataFrame:
    hub = lambda d: d.select("notification_id", F.lit("sent").alias("status"), C("label").alias("message"))
    push = lambda d: d.select("notification_id", F.when(C("k") % 2 == 0, "sent").otherwise("skipped").alias("status"), C("camera").alias("message"))
    return N.fan_out(notifications, {"hub": hub, "push": push}, {"mail": mail})


@query("u1_fan_out", f"{D.with_('feed')}, {RESULTS} select * from res")
def u1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(D.feed(spark, sf_dir).select(C("event_id").alias("notification_id"), "label", "camera", "k"))


@query("dispatch_log", f"""{D.with_('feed')}, {RESULTS}, g as (select notification_id, string_agg(provider || ': ' || status, '; ' order by provider) as parts, count(*) as n from res where provider = 'mail' or notification_id % 2 = 0 group by 1)
    select event_id as notification_id, camera as folder, 'notification_dispatch' as source, 'Notification: ' || label || coalesce(' — ' || parts, '') as label, label as event_phase, coalesce(n, 0) as n_results from feed left join g on g.notification_id = event_id where k % 7 <> 0""")  # fmt: skip
def dispatch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = D.feed(spark, sf_dir).select(C("event_id").alias("notification_id"), "label", "camera", "k")
    some = results(n).filter("provider = 'mail' or notification_id % 2 = 0")
    log = N.dispatch_log(n.select("notification_id", F.when(C("k") % 7 != 0, C("camera")).alias("folder"), C("label").alias("status")), some)
    return log.select("notification_id", "folder", "source", "label", "event_phase", F.size("results").cast("long").alias("n_results"))


@query("u3_describe", f"""{D.with_('feed', 'snoozes')}, {INCIDENTS.format(gap=900, src='feed')}, t as (select incident_id, max(start_us) + 1 as ready_us, list(distinct camera) as cameras, count(*) as n from inc group by 1),
    s as (select camera, set_us, max(struct_pack(expiration_us := expiration_us, n := snooze_ai)) as s from snoozes group by 1, 2), a as (select incident_id, ready_us, unnest(cameras) as camera from t),
    h as (select a.incident_id, a.ready_us, s.s from a asof left join s on s.camera = a.camera and s.set_us <= a.ready_us), st as (select incident_id, bool_and(coalesce(s.expiration_us > ready_us and s.n, false)) as off from h group by 1)
    select incident_id, n || ' events on ' || array_to_string(list_sort(cameras), ', ') as title from t join st using (incident_id) where not off""")  # fmt: skip
def u3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A description of each incident that isn't snoozed for analysis on all its cameras."""
    ready = incidents(spark, sf_dir).groupBy("incident_id").agg((F.max("start_us") + 1).alias("ready_us"), F.array_sort(F.collect_set("camera")).alias("cameras"), F.count("*").alias("n"))

    def titles(parts):
        for part in parts:
            yield part.assign(title=[f"{n} events on {', '.join(c)}" for n, c in zip(part["n"], part["cameras"], strict=True)])[["incident_id", "title"]]

    return N.describe(ready, titles, "incident_id string, title string", D.snoozes(spark, sf_dir))


BATCHED = "b as (select event_id, start_us as ts_us, (start_us + (k % 20) * 61000000) // 600000000 as batch from feed)"


@query("split_late", f"""{D.with_('feed')}, {BATCHED}, m as (select batch, max(max(ts_us)) over (order by batch rows between unbounded preceding and 1 preceding) as most from b group by batch)
    select event_id, batch, (most // 1000 - 300000) * 1000 as watermark_us, coalesce(ts_us <= (most // 1000 - 300000) * 1000, false) as late from b join m using (batch)""")  # fmt: skip
def late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that arrive up to 20 minutes after their time, in batches of ten minutes, against a watermark of five."""
    rows = D.feed(spark, sf_dir).select("event_id", C("start_us").alias("ts_us"), F.expr("(start_us + (k % 20) * 61000000L) div 600000000").alias("batch"))
    return split_late(rows, delay_s=300).select("event_id", "batch", "watermark_us", "late")


@query("late_review_targets", f"""{D.with_('feed')}, {INCIDENTS.format(gap=900, src='feed')}, i as (select incident_id, min(start_us) as s, max(case when ended then end_us end) as e, arg_min(camera, event_id) as camera, arg_min(label, event_id) as label from inc group by 1),
    r as (select event_id as review_id, case when k % 9 = 0 then -1 else event_id end as event_id, start_us + k * 7000000 as ts_us, 'T' || k as title, threat from feed),
    j as (select r.*, inc.incident_id, inc.camera as ec, inc.label as el, inc.start_us as es, case when ended then end_us end as ee, i.*exclude (incident_id), r.ts_us >= i.s and (i.e is null or r.ts_us < i.e + 120000000) as op from r join inc on inc.event_id = r.event_id join i on i.incident_id = inc.incident_id),
    k as (select *, row_number() over (partition by incident_id, op order by ts_us, review_id, event_id) as n from j)
    select review_id, event_id, case when op then 'incident' else 'stand_in' end as kind, case when op then incident_id else cast(event_id as varchar) end as target_id, case when op then 'incident_' || incident_id else 'event_' || event_id end as tag, not op or n = 1 as sent,
        case when op then camera else ec end as camera, case when op then label else el end as label, case when op then 'events/' || incident_id else '' end as folder, case when op then s else es end as created_us, case when op then coalesce(e, s) else coalesce(ee, es) end as end_us,
        title, null::varchar as description, threat, 'detection' as severity from k""")  # fmt: skip
def review_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews up to minutes after their event; an incident closes two minutes after its last end."""
    e = incidents(spark, sf_dir).select("event_id", "incident_id", "camera", "label", "start_us", F.when(C("ended"), C("end_us")).alias("end_us"), F.lit(None).cast("string").alias("folder"), F.lit(None).cast("string").alias("severity"))
    i = e.groupBy("incident_id").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.min_by("camera", "event_id").alias("camera"), F.min_by("label", "event_id").alias("label"))
    i = i.withColumns({"closed_us": C("end_us") + 120_000_000, "folder": F.concat(F.lit("events/"), C("incident_id"))})
    f = D.feed(spark, sf_dir)
    r = f.select(C("event_id").alias("review_id"), F.when(C("k") % 9 == 0, -1).otherwise(C("event_id")).alias("event_id"), (C("start_us") + C("k") * 7_000_000).alias("ts_us"), F.concat(F.lit("T"), C("k").cast("string")).alias("title"), F.lit(None).cast("string").alias("description"), "threat")
    return to_targets(r, e, i)


MESSAGES = """m as (select *, row_number() over (partition by site_id order by ts, late, e) as n from (
        select site_id, start_us as ts, 0 as late, cast(event_id as varchar) as e, camera as cam, label as lab from feed union all select site_id, end_us, 1, cast(event_id as varchar), camera, label from feed where ended))"""
INCIDENT = "struct(no bigint, s bigint, l bigint, d bigint, ids varchar[], cams varchar[], labs varchar[], p varchar, pc varchar, x boolean)"

# a step is a message: what is due closes, then a start joins the active incident or opens one, or an end changes its event's
CLOSING = f"""{D.with_('feed', recursive=True)}, {MESSAGES},
    f as (select distinct site_id, 0::bigint as n, null::bigint as act, []::{INCIDENT}[] as inc, []::struct(e varchar, no bigint, s bigint)[] as op, []::{INCIDENT}[] as closed, null::varchar as ended, null::bigint as upto, null::varchar as what, null::{INCIDENT} as mine from m
    union all select site_id, n + 1, if(begins, coalesce(joins, n + 1), if(list_contains(list_transform(rest, lambda i: i.no), act), act, null)), if(begins and joins is null,
            list_append(rest, struct_pack(no := n + 1, s := ts, l := ts, d := null::bigint, ids := [e], cams := [cam], labs := if(lab is null, []::varchar[], [lab]), p := e, pc := cam, x := false)), rest),
        if(begins, list_append(op, struct_pack(e := e, no := coalesce(joins, n + 1), s := ts)), list_filter(op, lambda y: y.e <> e)), fired,
        if(o is not null, e, null), ts, if(o is null, null, if(short, 'discarded', if(long, 'canceled', 'kept'))), if(o is null, null, list_filter(changed, lambda i: i.no = o.no)[1])
    from (select *, list_filter(changed, lambda i: len(i.ids) > 0) as rest from (select *, list_transform(keep, lambda i: if(i.no is distinct from if(begins, joins, o.no), i, struct_pack(no := i.no, s := i.s, l := if(short, i.l, ts),
            d := if(begins or short, i.d, ts + 120000000), ids := if(begins, list_append(i.ids, e), if(short, list_filter(i.ids, lambda z: z <> e), i.ids)), cams := if(begins and not list_contains(i.cams, cam), list_append(i.cams, cam), i.cams),
            labs := if(begins and lab is not null and not list_contains(i.labs, lab), list_append(i.labs, lab), i.labs), p := if(short and i.p = e, list_filter(i.ids, lambda z: z <> e)[1], i.p), pc := if(short and i.p = e, i.cams[1], i.pc), x := i.x or long))) as changed
    from (select *, late = 0 and not known as begins, if(ts - list_filter(keep, lambda i: i.no = act)[1].l < 120000000, act, null) as joins, late = 1 and o is not null and ts - o.s < 5000000 as short, late = 1 and o is not null and ts - o.s >= 120000000 as long
    from (select * exclude (late), coalesce(late, 2) as late, list_contains(list_transform(op, lambda y: y.e), e) or len(list_filter(keep, lambda i: list_contains(i.ids, e))) > 0 as known, if(late = 1, list_filter(op, lambda y: y.e = e)[1], null) as o
    from (select * exclude (op, act), list_filter(op, lambda y: list_contains(list_transform(keep, lambda i: i.no), y.no)) as op, if(list_contains(list_transform(keep, lambda i: i.no), act), act, null) as act
    from (select *, list_filter(inc, lambda i: i.d is not null and (ts is null or i.d <= ts)) as fired, list_filter(inc, lambda i: i.d is null or i.d > ts) as keep
    from (select f.site_id, f.n, f.act, f.inc, f.op, m.ts, m.late, m.e, m.cam, m.lab from f left join m on m.site_id = f.site_id and m.n = f.n + 1 where m.n is not null or exists (select 1 from m x where x.site_id = f.site_id and x.n = f.n)))))))))"""
JOINED = "array_to_string(i.cams, ',') as cameras, array_to_string(i.labs, ',') as labels"


def exact_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.feed(spark, sf_dir)
    row = lambda kind, us: f.select("site_id", C(us).alias("ts_us"), F.lit(kind).alias("kind"), C("event_id").cast("string").alias("event_id"), "camera", "label", "ended")
    return row("new", "start_us").union(row("end", "end_us").filter("ended")).drop("ended")


@query("t4_incidents_exact", f"""{CLOSING} select site_id, i.s as start_us, i.d as close_us, len(i.ids) as n_events, i.p as primary_event, i.pc as primary_camera, {JOINED}, i.x as canceled from (select site_id, unnest(closed) as i from f)""")
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_incidents(exact_messages(spark, sf_dir))


@query("t5_short_long", f"""{CLOSING} select site_id, ended as event_id, upto as ts_us, what as outcome, i.s as start_us, len(i.ids) as n_events, i.p as primary_event, i.pc as primary_camera, {JOINED} from (select *, mine as i from f where what is not null)""")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short_long(exact_messages(spark, sf_dir))
