"""Queries over the event store and the composite entry points: listing, statistics, status, key frames, report, audit, notifications, timeline page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from camwatch.functions import scalars as S
from camwatch.operators import croppath as K
from camwatch.operators import filters as P
from camwatch.operators import joins as J
from camwatch.operators import notify as N
from camwatch.operators import reports as R
from camwatch.operators import store as T
from camwatch.operators import timeline as L
from camwatch.operators.lineage import cut
from camwatch.plans import feed as D
from camwatch.plans.event_queries import LIMITED
from camwatch.plans.event_queries import INCIDENTS, NOW, members
from camwatch.plans.registry import query
from camwatch.plans.video_queries import SLICES, points

C = F.col
INC = INCIDENTS.format(gap=900, src="feed")


def text(template: str, **columns: Column) -> Column:
    """The template with ``{name}`` replaced by columns; null if one is null."""
    parts, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(head)] * bool(head) + [columns[name].cast("string")]
    return F.concat(*parts, *[F.lit(rest)] * bool(rest))


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder an incident: every second without metadata of its own, every third with a summary video; some saved, some test runs."""
    m = members(spark, sf_dir)
    g = m.groupBy("incident_id").agg(F.expr("min(start_us) div 1000000").alias("ts"), F.bool_and("viewed").alias("viewed"), F.min("event_id").alias("e"), F.max("threat").alias("threat"))
    own = F.to_json(F.struct(F.when(C("e") % 4 == 1, text("Own {e}", e=C("e"))).otherwise("").alias("genai_title"), C("threat").alias("threat_level"), (C("ts") + 7).alias("end_time")))
    return g.select(
        "incident_id", "ts", "viewed", text("Title: Parsed {e}\nDescription: \nAI Description: seen at {e}\nLabel: box", e=C("e")).alias("summary"), F.when(C("e") % 2 == 0, "").otherwise(own).alias("meta"),
        (C("e") % 3 == 0).alias("video"), (C("e") % 19 == 0).alias("saved"), (C("e") % 23 == 0).alias("test_run"), "e",
    )


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = members(spark, sf_dir).groupBy("incident_id", "camera").agg(F.max("event_id").alias("e"), F.min("label").alias("label"), F.max("threat").alias("threat"))
    meta = F.to_json(F.struct(C("label"), text("Of {c}", c=C("camera")).alias("genai_description"), C("threat").alias("threat_level")))
    return m.select("incident_id", "camera", F.when(C("e") % 3 > 0, text("clip_{e}.mp4", e=C("e"))).alias("clip"), (C("e") % 5 == 0).alias("snapshot"), F.when(C("e") % 7 < 5, meta).otherwise("").alias("meta"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = members(spark, sf_dir)
    end = F.expr("end_us div 1000000")
    payload = F.to_json(F.struct(F.struct(F.when(C("ended"), "end").otherwise("update").alias("type"), F.struct(F.when(C("ended"), end).alias("end_time")).alias("after")).alias("payload")))
    data = F.when(C("k") % 13 == 0, F.to_json(F.struct(end.alias("end_time")))).otherwise(payload)
    return m.select(
        "incident_id", "camera", C("event_id").alias("pos"), F.when(C("k") % 13 == 0, "test_ai_prompt").otherwise("mqtt").alias("source"), F.lit("update").alias("label"), data.alias("data"), "zones",
        F.when(C("k") % 4 == 1, "genai").otherwise("update").alias("type"), F.when(C("k") % 3 == 0, "").otherwise(text("T {k}", k=C("k") % 2)).alias("title"), F.when(C("k") % 3 == 0, "No concerns").otherwise(C("label")).alias("summary"), F.lit(None).cast("string").alias("scene"),
    )


STORE = f"""{INC}, fo as (select incident_id, min(start_us) // 1000000 as ts, bool_and(viewed) as viewed, min(event_id) as e, max(threat) as threat from inc group by 1),
    ca as (select incident_id, camera, max(event_id) as e, min(label) as label, max(threat) as threat from inc group by 1, 2),
    cm as (select incident_id, arg_min(label, camera) as label, arg_min(camera, camera) as cam, arg_min(threat, camera) as threat from ca where e % 7 < 5 group by 1),
    cg as (select incident_id, string_agg(camera, ',' order by camera) as cameras, arg_min(camera, camera) as first, arg_min(camera, camera) filter (e % 5 = 0) as shot, arg_min(e, camera) filter (e % 3 > 0) as clip, arg_min(camera, camera) filter (e % 3 > 0) as clip_cam,
              string_agg(camera || '=/files/events/' || incident_id || '/' || camera || '/clip_' || e || '.mp4', ';' order by camera) filter (e % 3 > 0) as clips from ca group by 1),
    zo as (select incident_id, string_agg(camera || ':' || zones, ';' order by camera || ':' || zones) as zones from (select incident_id, camera, coalesce(string_agg(distinct z, ',' order by z), '') as zones from (select incident_id, camera, unnest(case when len(zones) = 0 then [null] else zones end) as z from inc) group by 1, 2) group by 1),
    en as (select incident_id, max(case when k % 13 = 0 or ended then end_us // 1000000 end)::double as end_time, bool_or(ended and k % 13 > 0) as ended from inc group by 1),
    ge as (select incident_id, count(distinct case when k % 3 > 0 then k % 2 || label end) as n from inc where k % 4 = 1 group by 1),
    listing as (select fo.incident_id as event_id, ts, case when e % 2 = 1 and e % 4 = 1 then 'Own ' || e else 'Parsed ' || e end as title,
        case when e % 2 = 0 and cm.cam is not null then 'Of ' || cm.cam else 'seen at ' || e end as description, case when e % 2 = 0 and cm.cam is not null then cm.label else 'box' end as label,
        case when e % 2 = 0 then coalesce(cm.threat, 0) else fo.threat end as threat, viewed, e % 3 = 0 or clip is not null as has_clip,
        case when e % 3 = 0 then '/files/events/' || fo.incident_id || '/' || fo.incident_id || '_summary.mp4' when clip is not null then '/files/events/' || fo.incident_id || '/' || clip_cam || '/clip_' || clip || '.mp4' end as hosted_clip,
        '/files/events/' || fo.incident_id || '/' || coalesce(shot, first) || '/snapshot.jpg' as hosted_snapshot,
        concat_ws(';', clips, case when e % 3 = 0 then 'Summary video=/files/events/' || fo.incident_id || '/' || fo.incident_id || '_summary.mp4' end) as hosted_clips, cameras, zones,
        coalesce(end_time, case when e % 2 = 1 then (ts + 7)::double end) as end_time, not (e % 3 = 0 or clip is not null) and not ended and {NOW} - ts < 5400 as ongoing, coalesce(ge.n, 0) as n_texts, e
        from fo join cg using (incident_id) join zo using (incident_id) join en using (incident_id) left join cm using (incident_id) left join ge using (incident_id))"""


@query("q2_event_listing", f"{D.with_('feed')}, {STORE} select * exclude (e) from listing where not viewed and e % 19 <> 0 and e % 23 <> 0")
def q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.event_listing(folders(spark, sf_dir), cameras(spark, sf_dir), entries(spark, sf_dir), NOW)


@query("l4_saved_events", f"{D.with_('feed')}, {INC} select event_id, camera, start_us // 1000000 as ts from inc where event_id % 19 = 0 and camera = 'cam_3'")
def l4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = members(spark, sf_dir).select("event_id", "camera", F.expr("start_us div 1000000").alias("ts"), (C("event_id") % 19 == 0).alias("saved"))
    return T.saved_events(rows, "cam_3").drop("saved")


RUNS = "runs as (select case when doc_id // 40 % 3 = 0 then 'test' || doc_id // 40 else doc_id // 40 || '_ev' end as folder, case when doc_id % 40 > 0 and doc_id // 40 % 6 = 0 then 'cam_' || (doc_id % 3) end as camera, 1700000000 + (doc_id * 7919) % 1000003 as mtime from documents)"


@query("l3_list_test_runs", f"with {RUNS} select folder, cast(max(mtime) as varchar) as ts, string_agg(distinct camera, ',' order by camera) as cameras, max(mtime) filter (camera is null) as own from runs where folder like 'test%' group by 1 having count(camera) > 0")
def l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.read(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 40").alias("g"))
    rows = d.select(
        F.when(C("g") % 3 == 0, text("test{g}", g=C("g"))).otherwise(text("{g}_ev", g=C("g"))).alias("folder"), F.when((C("doc_id") % 40 > 0) & (C("g") % 6 == 0), text("cam_{c}", c=C("doc_id") % 3)).alias("camera"),
        (F.lit(1_700_000_000) + (C("doc_id") * 7919) % 1_000_003).alias("mtime"),
    )
    return T.list_test_runs(rows).withColumn("cameras", F.array_join("cameras", ","))


QUALITY = f"{SLICES}, part_ as (select * from sidecar where incident_id % 5 > 0 or camera <> 'cam_1'), en as (select incident_id, camera, t::double as t, count(*) filter (t % 3 > 0) as n from part_ group by 1, 2, 3)"


def near(at: str) -> str:
    """SQL: the entry nearest to a slice's time, the earlier on ties, as its number of detections."""
    return f"""(select case when b.t is null then a.n when a.t is null or {at} - b.t <= a.t - {at} then b.n else a.n end
        from (select max(t) as t, arg_max(n, t) as n from en where en.incident_id = s.incident_id and en.camera = s.camera and en.t <= {at}) b, (select min(t) as t, arg_min(n, t) as n from en where en.incident_id = s.incident_id and en.camera = s.camera and en.t >= {at}) a)"""


@query("j15_quality_join", f"{D.with_('sidecar', recursive=True)}, {QUALITY}, q as (select s.*, {near('s.start_sec')} as n0, {near('s.end_sec')} as n1 from slices s) select incident_id, idx, camera, case when n0 is null then 'no entries' when n0 = 0 or n1 = 0 then 'no detections' else 'ok' end as quality from q")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices against sidecars of which some cameras are missing, and whose frames at every third second are empty."""
    from camwatch.plans.video_queries import ends

    slices = L.points_to_slices(L.merge_short_runs(points(spark, sf_dir)), ends(spark, sf_dir))
    some = D.sidecar(spark, sf_dir).filter((C("incident_id") % 5 > 0) | (C("camera") != "cam_1")).withColumn("label", F.when(C("t") % 3 > 0, C("label")))
    return K.quality_join(slices, some).select("incident_id", "idx", "camera", "quality")


SEGMENTS = "seg as (select distinct incident_id, t // 10 as seg, camera, (t // 10 * 10)::double as start_sec, (t // 10 * 10 + case when incident_id % 3 = 0 then 2 else 8 end)::double as end_sec from sidecar)"


@query("f30_segment_crop", f"""{D.with_('sidecar')}, {SEGMENTS}, c as (select s.incident_id, s.seg, s.camera, coalesce(sum((x1 + x2) * greatest(area, 1)) / (2.0::double * sum(greatest(area, 1))), 640.0::double) as cx, coalesce(sum((y1 + y2) * greatest(area, 1)) / (2.0::double * sum(greatest(area, 1))), 360.0::double) as cy
    from seg s left join sidecar d on d.incident_id = s.incident_id and d.camera = s.camera and d.t >= s.start_sec and d.t < s.end_sec group by 1, 2, 3)
    select incident_id, seg, camera, greatest(0, least(1280 - 960, cast(trunc(cx - 480) as integer))) as x, greatest(0, least(720 - 720, cast(trunc(cy - 360) as integer))) as y, 960 as w, 720 as h from c""")  # fmt: skip
def f30(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.sidecar(spark, sf_dir)
    g = F.expr("t div 10").cast("int")
    seg = s.select("incident_id", g.alias("seg"), "camera").distinct().select("incident_id", F.concat(C("camera"), F.lit("/"), C("seg").cast("string")).alias("seg"), "camera", (C("seg") * 10.0).alias("start_sec"), (C("seg") * 10.0 + F.when(C("incident_id") % 3 == 0, 2).otherwise(8)).alias("end_sec"))
    return K.segment_crop(seg, s, 1280, 720).select("incident_id", F.substring_index("seg", "/", -1).cast("int").alias("seg"), "camera", "x", "y", "w", "h")


@query("q3_statistics", f"""{D.with_('feed', 'file_inventory')}, {INC},
    cams as (select camera, count(distinct incident_id) as n from inc group by 1), p as (select start_us // 1000000 as ts, viewed from feed),
    r as (select *, row_number() over (partition by folder, camera, case when lower(file) like '%.mp4' then 'clip' else file end order by mtime desc, file desc) as n from file_inventory),
    b as (select camera, case when camera is not null and ((lower(file) like '%.mp4' and n = 1) or file in ('snapshot.jpg', 'summary.txt', 'review_summary.md', 'metadata.json')) or camera is null and file in ('notification.gif', 'review_summary.md') then size else 0 end as bytes from r),
    kinds as (select sum(bytes) as total, (select sum(size) from r where camera is not null and lower(file) like '%.mp4' and n = 1) as clips from b), z as (select camera, sum(bytes) as bytes from b where camera is not null group by 1 union all select 'total', total from kinds union all select 'clips', clips from kinds)
    select 'events' as kind, camera as name, cast(n as varchar) as value from cams union all select 'storage', camera, case when bytes <= 0 then '0 KB' when bytes < 1048576 then printf('%.2f', bytes / 1024.0::double) || ' KB' else printf('%.2f', bytes / 1048576.0::double) || ' MB' end from z
    union all select 'period', name, cast(n as varchar) from (select count(*) filter (ts >= {NOW} - 86400) as last_day, count(*) filter (ts >= {NOW} - 604800) as last_week, count(*) filter (ts >= {NOW} - 2592000) as last_month, count(*) filter (viewed) as reviewed, count(*) filter (not viewed) as unreviewed from p) unpivot (n for name in (last_day, last_week, last_month, reviewed, unreviewed))
    union all (select 'most_recent', camera, cast(event_id as varchar) from feed order by start_us desc, camera, event_id limit 1)
    union all (select 'error', cast(event_id as varchar), case when label = 'error' then 'ERROR ' else 'WARNING ' end || label from feed where label in ('error', 'click') order by start_us desc, event_id desc limit 10)""")  # fmt: skip
def q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, name, value: incidents by camera, counts by period, bytes as shown, the most recent event and the recent errors."""
    f = D.feed(spark, sf_dir)
    rows = lambda df, kind, name, value: df.select(F.lit(kind).alias("kind"), name.alias("name"), value.cast("string").alias("value"))
    by = T.events_by_camera(members(spark, sf_dir).groupBy("incident_id").agg(F.collect_set("camera").alias("cameras")))
    periods = T.event_period_counts(f.withColumn("ts", F.expr("start_us div 1000000")), NOW)
    periods = periods.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), C(c).alias("n")) for c in periods.columns))).alias("p"))
    size = T.storage_stats(D.file_inventory(spark, sf_dir))
    total = C("clips") + C("snapshots") + C("descriptions")
    shown = size.select(F.explode(F.when(C("camera").isNotNull(), F.array(F.struct(C("camera").alias("name"), total.alias("bytes")))).otherwise(F.array(F.struct(F.lit("total").alias("name"), total.alias("bytes")), F.struct(F.lit("clips").alias("name"), C("clips").alias("bytes"))))).alias("s"))
    log = f.select(C("start_us").alias("ts_us"), C("event_id").alias("log_id"), F.when(C("label") == "error", "ERROR").when(C("label") == "click", "WARNING").otherwise("INFO").alias("level"), C("label").alias("message"))
    parts = (
        rows(by, "events", C("camera"), C("n")), rows(periods, "period", C("p.name"), C("p.n")), rows(shown, "storage", C("s.name"), S.format_size(C("s.bytes"))), rows(T.most_recent_event(f), "most_recent", C("camera"), C("event_id")),
        rows(T.recent_errors(log), "error", C("log_id").cast("string"), F.concat_ws(" ", "level", "message")),
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


PHASED = "select *, case when k % 5 = 0 then 'NEW' when k % 5 < 3 then 'DESCRIBED' else 'FINALIZED' end as phase from feed"


@query("q4_status", f"""{D.with_('feed')}, {INC}, s as (select incident_id, max(start_us) // 1000000 as last from inc group by 1), e as ({PHASED})
    select 'incident' as kind, case when last >= {NOW} - 120 then 'active' when last >= {NOW} - 3600 then 'closing' else 'closed' end as name, count(*) as n from s where last < {NOW} group by 2
    union all select 'total', '', count(*) from e union all select 'camera', camera, count(*) from e group by camera union all select 'phase', p, count(e.phase) from (select unnest(['NEW','DESCRIBED','FINALIZED','SUMMARIZED']) as p) left join e on e.phase = p group by p""")  # fmt: skip
def q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, name, n: the events' total, phases and cameras, and the incidents by state."""
    s = members(spark, sf_dir).groupBy("incident_id").agg(F.expr("max(start_us) div 1000000").alias("last")).filter(C("last") < NOW)
    states = s.groupBy(F.when(C("last") >= NOW - 120, "active").when(C("last") >= NOW - 3600, "closing").otherwise("closed").alias("name")).agg(F.count("*").alias("n")).select(F.lit("incident").alias("kind"), "name", "n")
    phased = D.feed(spark, sf_dir).withColumn("phase", F.when(C("k") % 5 == 0, "NEW").when(C("k") % 5 < 3, "DESCRIBED").otherwise("FINALIZED"))
    return states.unionByName(T.active_event_stats(phased))


@query("q7_key_frames", f"""{D.with_('sidecar', recursive=True)}, {SLICES},
    m as (select incident_id, camera, t, max(area) filter (label = 'person') as largest from sidecar group by 1, 2, 3),
    f as (select p.incident_id, p.camera, p.start_sec as t, case when m.largest >= 30000 * 0.4::double then 'full' else 'person' end as mode from plan p join m on m.incident_id = p.incident_id and m.camera = p.camera and m.t = cast(floor(p.start_sec) as integer) where m.largest > 0),
    c as (select * from (select *, row_number() over (partition by incident_id order by t, camera) as r from f) where r <= 45)
    select incident_id, camera, t, mode, cast(row_number() over (partition by incident_id order by t, camera) as integer) as seq, count(*) over (partition by incident_id) as total, printf('frame_%03d_%s.jpg', row_number() over (partition by incident_id order by t, camera), camera) as file from c""")  # fmt: skip
def q7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames at the starts of the plan's slices that show a person, with their framing; a frame is the sample of its second."""
    s = D.sidecar(spark, sf_dir)
    frames = L.camera_timeline(s).select("incident_id", "camera", C("start_sec").alias("at"), F.floor("start_sec").cast("int").alias("t"))
    framed = frames.join(K.framing_mode(s.withColumn("frame_area", F.lit(30_000))), ["incident_id", "camera", "t"])
    kept = L.cap_frames(P.drop_no_person(framed, "largest").select("incident_id", "camera", C("at").alias("t"), "mode"), 45)
    return L.frame_manifest(kept.withColumn("has_image", F.lit(True))).select("incident_id", "camera", "t", "mode", "seq", "total", "file")


@query("q8_daily_report", f"""{D.with_('feed')}, l as (select start_us // 1000000 as ts, '[' || strftime(make_timestamp(start_us), '%I:%M %p') || '] ' || label || ': ' || camera || ' (Threat: ' || threat || ')' as line from feed where cast(make_timestamp(start_us) as date) = date '2024-01-05')
    select '2024-01-05' as report_date, '# Report 2024-01-05 (' || count(*) || ')' || chr(10) || coalesce(string_agg(line, chr(10) order by ts, line), '') as report from l""")  # fmt: skip
def q8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of one day's report, over all of its events. The date is the feature."""
    date = F.lit("2024-01-05").cast("date")
    events = D.feed(spark, sf_dir).select(F.expr("start_us div 1000000").alias("ts"), C("label").alias("title"), C("camera").alias("summary"), "threat")
    day = R.render_lines(R.report_lines(R.daily_events(events, date)), date)
    return day.select(F.lit("2024-01-05").alias("report_date"), S.fill_template(F.lit("# Report {date} ({n})\n{list}"), date=date, n=C("n"), list=C("lines")).alias("report"))


@query("q10_export_audit", f"""{D.with_('feed', 'file_inventory')}, e as (select event_id // 3 as export_id, k, row_number() over (partition by event_id // 3 order by start_us, event_id) as n from feed where k % 2 = 0),
    x as (select distinct folder from file_inventory where lower(file) like '%.mp4' order by folder limit 20)
    select 'outcome' as kind, case when k % 5 < 2 then 'success' when k % 5 < 4 then 'already_gone' else 'failure' end as name, count(*) as n from e where n = 1 group by 2
    union all select 'link', url, 1 from (select '/files/' || folder || '/' || coalesce(camera || '/', '') || file as url from file_inventory join x using (folder) order by folder, coalesce(camera, ''), file, mtime limit 120)""")  # fmt: skip
def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, name, n: exports with a clip by outcome, and the links to check in folders with a clip."""
    f = D.feed(spark, sf_dir)
    t = f.select(C("event_id").alias("entry_id"), F.when(C("k") % 2 == 0, "api").otherwise("x").alias("source"), F.lit("in").alias("direction"), F.lit("Clip export response").alias("label"), F.expr("event_id div 3").alias("export_id"), C("start_us").alias("ts"), "k").withColumn("clip", C("export_id").cast("string"))
    first = J.exports_with_clip(t, f.select(C("event_id").cast("string").alias("path")), "Clip export response")
    outcomes = R.outcome_summary(first.select(F.element_at(F.array(*[F.lit(x) for x in (200, 204, 404, 422, 500)]), C("k") % 5 + 1).alias("code")), t.groupBy("export_id").agg(F.count_if(C("source") == "api").alias("n_entries")))
    files = D.file_inventory(spark, sf_dir)
    with_clip = files.join(files.filter(F.lower("file").endswith(".mp4")).select("folder").distinct(), "folder", "left_semi")
    url = F.concat(F.lit("/files/"), C("folder"), F.lit("/"), F.coalesce(F.concat(C("camera"), F.lit("/")), F.lit("")), C("file"))
    links = R.link_check_plan(with_clip).select(F.lit("link").alias("kind"), url.alias("name"), F.lit(1).cast("bigint").alias("n"))
    return outcomes.select(F.lit("outcome").alias("kind"), C("outcome").alias("name"), "n").unionByName(links)


STATUSES = "['" + "', '".join(x for x, *_ in P.GATE) + "']"
ALLOWED = "('" + "', '".join(x for x, external, _ in P.GATE if external) + "')"


@query("q11_notification_plan", f"""{D.with_('feed', 'snoozes', recursive=True)}, g as (select *, {STATUSES}[k % 9 + 1] as status from feed), sn as (select camera, set_us, max(struct_pack(expiration_us := expiration_us, n := snooze_notifications)) as s from snoozes group by 1, 2),
    h as (select g.*, event_id // 3 as track, sn.s from g asof left join sn on sn.camera = g.camera and sn.set_us <= g.start_us where status in {ALLOWED}),
    once as (select *, row_number() over (partition by track, status order by start_us, event_id) as m from h where not coalesce(s.expiration_us > start_us and s.n, false)),
    r as (select site_id, start_us as ts, event_id, status, track, row_number() over (partition by site_id order by start_us, event_id) as n from once where m = 1), {LIMITED},
    t as (select request_id, 'tag_' || track as tag, lag('tag_' || track) over (partition by site_id order by sent_us, request_id) as before from lim join r on r.event_id = request_id where outcome in ('sent', 'queued')),
    p as (select request_id, unnest(['hub', 'push']) as provider, unnest(['sent', case when status in ('snapshot_ready', 'clip_ready', 'finalized') then 'sent' else 'skipped' end]) as result from lim join r on r.event_id = request_id where outcome in ('sent', 'queued'))
    select lim.request_id, status, outcome, sent_us, case when before = tag then tag end as clear_tag, provider, result from lim join r on r.event_id = lim.request_id left join t on t.request_id = lim.request_id left join p on p.request_id = lim.request_id""")  # fmt: skip
def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, status, outcome, sent_us, provider, result, clear_tag of what passes the gate, the snoozes and the first-of-its-kind rule.

    Only what goes out reaches the providers; a tag is cleared if the same one went out just before.
    """
    f = D.feed(spark, sf_dir).withColumn("status", F.element_at(F.array(*[F.lit(s) for s, *_ in P.GATE]), C("k") % 9 + 1))
    ok = f.filter(P.notification_gate(C("status"), True))
    targets = ok.select(C("event_id").alias("target_id"), C("start_us").alias("ts_us"), F.array("camera").alias("cameras"), "site_id", "status", "camera", "threat", F.expr("event_id div 3").alias("track"))
    kept = J.suppress_snoozed(targets, D.snoozes(spark, sf_dir), "snooze_notifications").filter("not suppressed")
    once = J.first_per_key(kept, ["track", "status"], C("ts_us"), C("target_id"))
    # each is read several times below: computed once
    asked = cut(once.select("site_id", "ts_us", C("target_id").alias("request_id"), "status", "track"))
    limited = cut(N.rate_limit(asked))
    goes, rest = F.col("outcome").isin("sent", "queued"), ["request_id", "status", "outcome", "sent_us"]
    out = limited.filter(goes).select("site_id", *rest, C("sent_us").alias("ts_us"), C("request_id").alias("id"), text("tag_{t}", t=C("track")).alias("tag"), F.lit(True).alias("ok"))
    told = N.with_results(N.clear_previous_tag(out), {"hub": (F.lit("sent"), C("status")), "push": (P.provider_phase(C("status")), C("status"))})
    none = [F.lit(None).cast("string").alias(c) for c in ("clear_tag", "provider", "result")]
    return told.select(*rest, "clear_tag", "provider", "result").unionByName(limited.filter(~goes).select(*rest, *none))


@query("q12_event_timeline_page", f"""{D.with_('feed', 'file_inventory')}, t as (select event_id // 4 as incident, event_id, label, start_us, case when k % 4 > 0 then cast(start_us as varchar) end as ts, case when k % 3 = 0 then 0 else 1 end as part from feed),
    u as (select incident, max(case when label = 'purchase' then start_us end) - min(case when label = 'signup' then start_us end) as took from t group by 1),
    r as (select *, row_number() over (partition by folder, camera, lower(file) like '%.mp4' order by mtime desc, file desc) as n from file_inventory), x as (select distinct folder, camera, file from r where camera is null or (lower(file) like '%.mp4' and n = 1) or file in ('snapshot.jpg', 'metadata.json', 'summary.txt', 'review_summary.md', 'ai_analysis_debug.zip')),
    fs as (select cast(split_part(folder, '_ev', 2) as bigint) as incident, string_agg(coalesce(camera || '/', '') || file, ',' order by coalesce(camera || '/', '') || file) as files from x group by 1)
    select incident, event_id, cast(row_number() over (partition by incident order by coalesce(ts, '') desc, part, event_id) as integer) as place, took as export_us, files from t join u using (incident) left join fs using (incident)""")  # fmt: skip
def q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged timeline of each incident, newest first, with its files and how long its export took."""
    f = D.feed(spark, sf_dir).select(F.expr("event_id div 4").alias("incident"), "event_id", "label", C("start_us").alias("ts_us"), F.when(C("k") % 4 > 0, C("start_us").cast("string")).alias("ts"), "k")
    both = T.union_timeline_parts(f.filter("k % 3 = 0"), f.filter("k % 3 > 0"))
    place = F.row_number().over(W.partitionBy("incident").orderBy(F.desc(F.coalesce("ts", F.lit(""))), "part", "event_id"))
    took = R.export_turnaround(f, "signup", "purchase", "incident").withColumnRenamed("turnaround_us", "export_us")
    files = R.event_files(D.file_inventory(spark, sf_dir), R.PAGE_FILES).select(F.substring_index("folder", "_ev", -1).cast("bigint").alias("incident"), F.concat(F.coalesce(F.concat(C("camera"), F.lit("/")), F.lit("")), C("file")).alias("file"))
    files = files.groupBy("incident").agg(F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files"))
    return both.select("incident", "event_id", place.alias("place")).join(took, "incident").join(files, "incident", "left")
