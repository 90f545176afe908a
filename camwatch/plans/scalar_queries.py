"""Queries that apply one scalar function or predicate to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from camwatch.functions import scalars as S
from camwatch.operators import filters as P
from camwatch.operators import notify as N
from camwatch.operators import reports as R
from camwatch.plans import feed as D
from camwatch.plans.registry import query

C = F.col


def over_feed(name: str, columns: Callable[[], dict[str, Column]], sql: str) -> None:
    """``sql``: the select list behind event_id."""

    @query(name, f"{D.with_('feed')} select event_id, {sql} from feed")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return D.feed(spark, sf_dir).select("event_id", *(c.alias(a) for a, c in columns().items()))


def over(name: str, table: str, key: str, columns: Callable[[], dict[str, Column]], sql: str) -> None:
    @query(name, f"select {key}, {sql} from {table}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return D.read(spark, sf_dir, table).select(key, *(c.alias(a) for a, c in columns().items()))


folder = lambda: F.concat(C("start_us").cast("string"), F.lit("_ev_"), C("event_id").cast("string"), F.when(C("k") % 4 == 0, "-canceled").otherwise(""))
FOLDER = "(start_us || '_ev_' || event_id || case when k % 4 = 0 then '-canceled' else '' end)"
status = lambda: F.element_at(F.array(*[F.lit(s) for s, *_ in P.GATE]), C("k") % 9 + 1)
STATUS = "(['new','snapshot_ready','described','discarded','canceled','finalized','clip_ready','summarized','overflow'][k % 9 + 1])"
TITLE = "(upper(label[1]) || label[2:] || ' detected at Cam ' || camera[5:])"

over("f1_sanitize_camera", "documents", "doc_id", lambda: {"camera": S.sanitize_camera(F.concat_ws(" ", C("source"), F.lit("Ü-"), C("lang"), C("text")))},
     "coalesce(nullif(regexp_replace(replace(lower(source || ' Ü- ' || lang || ' ' || text), ' ', '_'), '[^a-z0-9_]', '', 'g'), ''), 'unknown') as camera")
over_feed("f2_normalize_sub_label", lambda: {"sub_label": S.normalize_sub_label(F.when(C("k") % 4 == 0, F.concat(F.lit('"  Name_'), C("k").cast("string"), F.lit(' "'))).when(C("k") % 4 == 1, F.lit('["cat", 0.9]')).when(C("k") % 4 == 2, F.lit('""')))},
     "case when k % 4 = 0 then 'Name_' || k when k % 4 = 1 then 'cat' end as sub_label")


@query("f3_normalize_box", """
    with b as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 1600 as x1, l_suppkey % 900 as y1, l_partkey % 1600 - 300 + l_quantity * 20 as x2, l_suppkey % 900 + l_quantity * 4 - 20 as y2,
                      case when l_linenumber % 3 = 0 then 1000 else 0 end as w, case when l_linenumber % 3 = 0 then 800 else 0 end as h from lineitem),
         s as (select *, case when w > 0 then 1000.0::double when greatest(x1, y1, x2, y2) > 1 then 1920.0 else 1.0 end as sw, case when w > 0 then 800.0::double when greatest(x1, y1, x2, y2) > 1 then 1080.0 else 1.0 end as sh from b),
         n as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0, least(1, least(y1, y2) / sh)) as ymin, greatest(0, least(1, least(x1, x2) / sw)) as xmin, greatest(0, least(1, greatest(y1, y2) / sh)) as ymax, greatest(0, least(1, greatest(x1, x2) / sw)) as xmax from s)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when ymax > ymin and xmax > xmin then cast(floor(ymin * 1000000 + 0.5) as bigint) end as ymin, case when ymax > ymin and xmax > xmin then cast(floor(xmin * 1000000 + 0.5) as bigint) end as xmin,
           case when ymax > ymin and xmax > xmin then cast(floor(ymax * 1000000 + 0.5) as bigint) end as ymax, case when ymax > ymin and xmax > xmin then cast(floor(xmax * 1000000 + 0.5) as bigint) end as xmax from n""")  # fmt: skip
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = C("l_linenumber") % 3 == 0
    x1, y1 = C("l_partkey") % 1600, C("l_suppkey") % 900
    box = S.normalize_box(x1, y1, x1 - 300 + C("l_quantity") * 20, y1 + C("l_quantity") * 4 - 20, F.when(sized, 1000).otherwise(0), F.when(sized, 800).otherwise(0))
    return D.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", box.alias("b")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(F.floor(C(f"b.{c}") * 1_000_000 + 0.5).alias(c) for c in ("ymin", "xmin", "ymax", "xmax")))


over_feed("f4_parse_folder_name", lambda: {"ts": S.folder_ts(F.when(C("k") % 5 == 0, F.concat(F.lit("x"), folder())).otherwise(folder())), "id": S.folder_id(folder())},
     f"case when k % 5 <> 0 then start_us end as ts, {FOLDER}[strlen(cast(start_us as varchar)) + 2:] as id")
over_feed("f5_cancel_names", lambda: {"plain": S.strip_canceled(folder()), "canceled": S.cancel_name(folder())}, "start_us || '_ev_' || event_id as plain, start_us || '_ev_' || event_id || '-canceled' as canceled")
summary = lambda: F.concat(F.lit("Title: one\nNote without value\nDescription: a: b "), C("label"), F.lit("\nTitle:  two "), C("k").cast("string"), F.lit(" \n"))
over_feed("f6_parse_summary", lambda: {"title": S.summary_field(summary(), "Title"), "description": S.parse_summary(summary())["Description"], "none": S.summary_field(summary(), "Scene")},
     "'two ' || k as title, 'a: b ' || label as description, cast(null as varchar) as none")
META = lambda: F.when(C("k") % 3 == 0, F.to_json(F.struct(F.when(C("k") % 2 == 0, "M").otherwise("").alias("genai_title"), F.lit("MD").alias("genai_description"), C("label")))).when(C("k") % 3 == 1, "")
PARSED = lambda: S.parse_summary(F.concat(F.lit("Title: P\nDescription:\nAI Description: A"), F.when(C("k") % 5 == 0, "\nLabel: L").otherwise("")))
over_feed("f7_event_title", lambda: {"title": S.event_title(META(), PARSED()), "description": S.event_description(META(), PARSED()), "named": S.event_label(META(), PARSED())},
     "case when k % 6 = 0 then 'M' else 'P' end as title, case when k % 3 = 0 then 'MD' else 'A' end as description, case when k % 3 = 0 then label when k % 5 = 0 then 'L' else 'unknown' end as named")
over_feed("f7_first_truthy", lambda: {"title": S.first_truthy(F.when(C("k") % 3 == 0, "").when(C("k") % 3 == 1, C("label")), C("camera"), F.lit("x"))}, "case when k % 3 = 1 then label else camera end as title")
over("f8_format_size", "documents", "doc_id", lambda: {"size": S.format_size(C("n_chars") * C("doc_id") * 1024 - 1)},
     "case when n_chars * doc_id * 1024 - 1 <= 0 then '0 KB' when n_chars * doc_id * 1024 - 1 < 1048576 then printf('%.2f', (n_chars * doc_id * 1024 - 1) / 1024.0::double) || ' KB' when n_chars * doc_id * 1024 - 1 < 1073741824 then printf('%.2f', (n_chars * doc_id * 1024 - 1) / 1048576.0::double) || ' MB' else printf('%.2f', (n_chars * doc_id * 1024 - 1) / 1073741824.0::double) || ' GB' end as size")
over_feed("f9_default_title", lambda: {"name": S.display_name(C("camera")), "title": S.default_title(C("label"), C("camera"))}, f"'Cam ' || camera[5:] as name, {TITLE} as title")
over_feed("f10_notification_message", lambda: {"message": S.notification_message(status(), S.default_title(C("label"), C("camera")), F.when(C("k") % 2 == 0, "Ai text"), F.when(C("k") % 4 == 1, "Best").otherwise(""), F.when(C("k") % 3 == 1, F.concat(F.lit("# head\n\n  "), F.repeat(F.lit("ab "), C("k")))).otherwise(""), C("viewed"))},
     f"""case when k % 9 = 7 and k % 3 = 1 then (rtrim(repeat('ab ', k))[1:200] || case when strlen(rtrim(repeat('ab ', k))) > 200 then '...' else '' end)
         when k % 9 = 6 then (case when viewed then 'Video available. ' else 'Video unavailable. ' end) || (case when k % 4 = 1 then 'Best' else {TITLE} end)
         when k % 9 = 5 then (case when k % 4 = 1 then 'Best' else 'Event complete: ' || {TITLE} end)
         when k % 9 = 2 then (case when k % 2 = 0 then 'Ai text' else {TITLE} || ' (details updating)' end)
         else (case when k % 4 = 1 then 'Best' else {TITLE} end) end as message""")  # fmt: skip
over("f11_strip_code_fence", "conversations", "conv_id, turn".split(",")[0], lambda: {"turn": C("turn"), "text": S.strip_code_fence(F.when(C("turn") % 2 == 0, F.concat(F.lit(" ```json\n"), C("role"), F.lit("\n{} \n```\n"))).otherwise(F.concat(F.lit("\n"), C("role"), F.lit(" ``` "))))},
     "turn, case when turn % 2 = 0 then role || chr(10) || '{}' else role || ' ```' end as text")
body = lambda: F.when(C("turn") % 3 == 0, F.concat(F.lit('{"candidates":[{"content":{"parts":[{"text":"c_'), C("role"), F.lit('"}]}}]}'))).when(C("turn") % 3 == 1, F.concat(F.lit('{"choices":[{"message":{"content":"'), C("role"), F.lit('"}}]}'))).otherwise('{"choices":[{"message":{"content":"  "}}]}')
over("f12_response_text", "conversations", "conv_id", lambda: {"turn": C("turn"), "text": S.response_text(body())}, "turn, case when turn % 3 = 0 then 'c_' || role when turn % 3 = 1 then role end as text")
reply = lambda: F.when(C("turn") % 3 == 0, F.concat(F.lit('```json\n{"title":"'), C("role"), F.lit('","description":"d","confidence":"0.'), (C("conv_id") % 9 + 1).cast("string"), F.lit('","potential_threat_level":'), (C("conv_id") % 3).cast("string"), F.lit("}\n```"))).when(C("turn") % 3 == 1, F.lit('{"title":"t","shortSummary":"s","potential_threat_level":"high"}')).otherwise("{broken")
over("f13_parse_analysis", "conversations", "conv_id", lambda: {"turn": C("turn")} | {k: S.parse_analysis(reply())[k] for k in ("title", "summary", "confidence", "threat")},
     "turn, case when turn % 3 = 0 then role when turn % 3 = 1 then 't' end as title, case when turn % 3 = 0 then 'd' when turn % 3 = 1 then 's' end as summary, case when turn % 3 = 0 then cast('0.' || (conv_id % 9 + 1) as double) end as confidence, case when turn % 3 = 0 then cast(conv_id % 3 as integer) when turn % 3 = 1 then 0 end as threat")
over("f14_quick_title", "conversations", "conv_id", lambda: {"turn": C("turn"), "title": S.quick_title(F.when(C("turn") > 0, C("text")).otherwise("  "), C("text"))["title"]}, "turn, case when turn > 0 and trim(text) <> '' then trim(text)[1:500] end as title")
over_feed("f15_display_datetime", lambda: {"dt": S.display_datetime(F.expr("start_us div 1000000")), "tm": S.display_time(F.expr("start_us div 1000000"))}, "strftime(make_timestamp(start_us), '%Y-%m-%d %I:%M:%S %p') as dt, strftime(make_timestamp(start_us), '%I:%M %p') as tm")
over_feed("f16_format_duration", lambda: {"d": S.format_duration(F.when(C("k") % 10 == 0, -1.0).when(C("k") % 10 != 1, C("value") * C("k")))},
     "case when k % 10 = 0 or k % 10 = 1 then '—' when floor(value * k) >= 3600 then cast(floor(value * k) as bigint) // 3600 || 'h ' || cast(floor(value * k) as bigint) % 3600 // 60 || 'm ' || cast(floor(value * k) as bigint) % 60 || 's' when floor(value * k) >= 60 then cast(floor(value * k) as bigint) // 60 || 'm ' || cast(floor(value * k) as bigint) % 60 || 's' else cast(floor(value * k) as bigint) || 's' end as d")
over_feed("f17_threat_name", lambda: {"name": S.threat_name(C("k") % 4), "critical": S.is_critical(C("k") % 4)}, "['Normal','Suspicious','Critical','Unknown'][k % 4 + 1] as name, k % 4 >= 2 as critical")
over_feed("f18_push_priority", lambda: {"priority": S.push_priority(status(), C("threat"))}, f"case when {STATUS} = 'snapshot_ready' then case when threat >= 2 then 1 else 0 end else -1 end as priority")
SHOTS = lambda: F.array(F.struct(F.lit("cam_b").alias("camera"), F.when(C("k") % 2 == 0, "b.mp4").alias("clip"), (C("k") % 3 == 0).alias("snapshot")), F.struct(F.lit("cam_a").alias("camera"), F.when(C("k") % 4 < 2, "a.mp4").alias("clip"), (C("k") % 9 == 0).alias("snapshot")))
MEDIA = lambda: S.media_urls(C("event_id").cast("string"), SHOTS(), C("viewed"))
over_feed("f19_media_urls", lambda: {"clip": MEDIA()["hosted_clip"], "snapshot": MEDIA()["hosted_snapshot"], "clips": F.array_join(F.transform(MEDIA()["hosted_clips"], lambda c: F.concat_ws("=", c["camera"], c["url"])), ";"), "has_clip": MEDIA()["has_clip"], "has_snapshot": MEDIA()["has_snapshot"]},
     """case when viewed then '/files/events/' || event_id || '/' || event_id || '_summary.mp4' when k % 4 < 2 then '/files/events/' || event_id || '/cam_a/a.mp4' when k % 2 = 0 then '/files/events/' || event_id || '/cam_b/b.mp4' end as clip,
        '/files/events/' || event_id || case when k % 9 > 0 and k % 3 = 0 then '/cam_b' else '/cam_a' end || '/snapshot.jpg' as snapshot,
        concat_ws(';', case when k % 4 < 2 then 'cam_a=/files/events/' || event_id || '/cam_a/a.mp4' end, case when k % 2 = 0 then 'cam_b=/files/events/' || event_id || '/cam_b/b.mp4' end, case when viewed then 'Summary video=/files/events/' || event_id || '/' || event_id || '_summary.mp4' end) as clips,
        viewed or k % 4 < 2 or k % 2 = 0 as has_clip, k % 3 = 0 as has_snapshot""")  # fmt: skip
over_feed("f19_clip_url", lambda: {"url": S.clip_url(folder(), C("camera"), F.when(C("ended"), "clip.mp4"))}, f"case when ended then '/files/events/' || {FOLDER} || '/' || camera || '/clip.mp4' end as url")
over_feed("f20_player_url", lambda: {"url": S.player_url("http://h/", F.when(C("k") % 2 == 0, folder()), C("camera"), F.when(C("k") % 3 == 0, C("event_id").cast("string"))), "link": S.deep_link(S.incident_id_from_tag(F.concat(F.lit("incident_"), C("event_id").cast("string"))))},
     f"case when k % 2 = 0 then 'http://h/player?camera=events&subdir=' || {FOLDER} when k % 3 = 0 then 'http://h/player?camera=' || camera || '&subdir=' || event_id else 'http://h/player?camera=' || camera end as url, 'buffer://event_detail/' || event_id as link")
def notice() -> dict[str, Column]:
    """A notification's fields."""
    none, when = F.lit(None).cast("string"), lambda n, v: F.when(C("k") % n == 0, v)
    return {
        "status": status(), "incident_id": C("event_id").cast("string"), "event_id": C("event_id"), "camera": C("camera"), "label": C("label"), "threat": C("threat"), "message": when(2, F.lit(" Hello ")), "description": when(3, F.lit("D")), "folder": when(5, F.lit("events/x")),
        "live_frame": none, "snapshot": none, "gif": when(4, F.lit("g.gif")), "clip": when(6, F.lit("c.mp4")), "phase": none, "image": F.lit("i"), "video": when(7, F.lit("v")), "player": F.lit("p"), "tag": F.lit("t"), "clear_tag": when(8, F.lit("old")), "created_s": F.expr("start_us div 1000000"),
    }


over_feed("f21_provider_payloads", lambda: {"mobile": N.mobile_payload(notice()), "hub": N.hub_payload(notice()), "push": N.push_payload(notice())},
     f"""'{{"ce_id":"' || event_id || '","phase":"' || upper({STATUS}) || '","clear_notification":"' || case when k % 9 = 3 then 'true' else 'false' end || '","threat_level":"' || threat || '","camera":"' || camera || '","live_frame_proxy":"' || case when k % 9 = 0 then '/api/cameras/' || camera || '/latest.jpg' else '' end
            || '","hosted_snapshot":"' || case when k % 5 = 0 and k % 9 in (1, 5, 6, 7) then '/files/events/x/snapshot_cropped.jpg' else '' end || '","notification_gif":"' || case when k % 4 = 0 then 'g.gif' else '' end || '","title":"' || {TITLE} || '","description":"' || case when k % 3 = 0 then 'D' when k % 2 = 0 then 'Hello' else {TITLE} end
            || '","message":"' || case when k % 2 = 0 then 'Hello' else {TITLE} end || '","hosted_clip":"' || case when k % 6 = 0 then 'c.mp4' else '' end || '","deep_link":"buffer://event_detail/' || event_id || '"}}' as mobile,
        '{{"event_id":' || event_id || ',"status":"' || {STATUS} || '","phase":"NEW","camera":"' || camera || '","label":"' || label || '","title":"' || {TITLE} || '"' || case when k % 2 = 0 then ',"message":" Hello "' else '' end || ',"image_url":"i"' || case when k % 7 = 0 then ',"video_url":"v"' else '' end || ',"player_url":"p","tag":"t","timestamp":' || start_us // 1000000
            || ',"threat_level":' || threat || ',"critical":' || case when threat >= 2 then 'true' else 'false' end || case when k % 8 = 0 then ',"clear_tag":"old"' else '' end || '}}' as hub,
        '{{"title":"' || {TITLE} || '"' || case when k % 2 = 0 then ',"message":" Hello "' else '' end || ',"url":"' || case when k % 5 = 0 then '/player?camera=events&subdir=events/x' else '/player?camera=' || camera || '&subdir=' || event_id end || '","url_title":"View in Event Viewer","html":1,"priority":' || case when k % 9 = 1 then case when threat >= 2 then 1 else 0 end else -1 end || ',"timestamp":' || start_us // 1000000 || '}}' as push""")  # fmt: skip
over_feed("f22_fill_template", lambda: {"text": S.fill_template(F.lit("{a} on {b}: {a}"), a=C("label"), b=C("camera"))}, "label || ' on ' || camera || ': ' || label as text")
over("f23_redact_url", "pages", "page_id", lambda: {"safe": S.redact_url(F.concat(F.lit("https://user:se"), C("page_id").cast("string"), F.lit("@"), F.split("url", "://")[1])), "plain": S.redact_url(C("url"))}, "'https://user:***@' || split_part(url, '://', 2) as safe, url as plain")


def over_boxes(name: str, columns: Callable[[], dict[str, Column]], sql: str) -> None:
    @query(name, f"{D.with_('sidecar')} select incident_id, camera, t, l_partkey, l_suppkey, {sql} from sidecar")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return D.sidecar(spark, sf_dir).select("incident_id", "camera", "t", "l_partkey", "l_suppkey", *(c.alias(a) for a, c in columns().items()))


over_boxes("f24_detection_geometry", lambda: {k: S.detection_geometry(C("x1"), C("y1"), C("x2"), C("y2"))[k] for k in ("cx", "cy", "area")}, "(x1 + x2) / 2.0::double as cx, (y1 + y2) / 2.0::double as cy, cast((x2 - x1) * (y2 - y1) as bigint) as area")
SCALED = lambda: S.scale_detections(C("x1"), C("y1"), C("x2"), C("y2"), (C("x1") + C("x2")) / 2.0, (C("y1") + C("y2")) / 2.0, C("area"), (F.lit(1280), F.lit(640)), (C("t") % 4 * 640, F.lit(1600)))
over_boxes("f25_scale_detections", lambda: {k: SCALED()[k] if k == "area" else F.round(SCALED()[k], 6) for k in ("x1", "y1", "x2", "y2", "cx", "cy", "area")},
     "round(x1 * fx, 6) as x1, round(y1 * fy, 6) as y1, round(x2 * fx, 6) as x2, round(y2 * fy, 6) as y2, round((x1 + x2) / 2.0::double * fx, 6) as cx, round((y1 + y2) / 2.0::double * fy, 6) as cy, cast(trunc(area * (fx * fy)) as bigint) as area from (select *, case when t % 4 > 0 then t % 4 * 640 / 1280.0::double else 1.0::double end as fx, case when t % 4 > 0 then 2.5::double else 1.0::double end as fy from sidecar) --")
over_boxes("f26_crop_rect", lambda: {k: S.crop_rect_around((C("x1") + C("x2")) / 2.0, (C("y1") + C("y2")) / 2.0, F.lit(1920), F.lit(1080), F.lit(960), F.lit(540))[k] for k in ("x", "y", "w", "h")},
     "greatest(0, least(cast(trunc((x1 + x2) / 2.0::double - 480) as integer), 960)) as x, greatest(0, least(cast(trunc((y1 + y2) / 2.0::double - 270) as integer), 540)) as y, 960 as w, 540 as h")
over_boxes("f27_padded_rect", lambda: {k: S.padded_rect(C("x1"), C("y1"), C("x2"), C("y2"), F.lit(1280), F.lit(720))[k] for k in ("x1", "y1", "x2", "y2")},
     """case when ok then a else 0 end as x1, case when ok then b else 0 end as y1, case when ok then c else 1280 end as x2, case when ok then d else 720 end as y2 from (
        select *, c > a and d > b as ok from (select * exclude (x1, y1, x2, y2), cast(trunc(greatest(0.0, x1 - greatest((x2 - x1) * 0.1::double, 1))) as integer) as a, cast(trunc(greatest(0.0, y1 - greatest((y2 - y1) * 0.1::double, 1))) as integer) as b,
               cast(trunc(least(1280.0, x2 + greatest((x2 - x1) * 0.1::double, 1))) as integer) as c, cast(trunc(least(720.0, y2 + greatest((y2 - y1) * 0.1::double, 1))) as integer) as d from sidecar)) --""")  # fmt: skip
over("f29_safe_relative_path", "documents", "doc_id", lambda: {"safe": S.safe_relative_path(F.element_at(F.array(*[F.lit(p) for p in ("a/b", "../x", "a/../..", "a/./b/..", "/abs", "", "a/../b", "a/..")]), (C("doc_id") % 8 + 1).cast("int")))}, "[true, false, false, true, false, false, true, false][doc_id % 8 + 1] as safe")
over("f31_coerce_bool", "documents", "doc_id", lambda: {"value": S.coerce_bool(F.element_at(F.array(*[F.lit(p) for p in (" Yes", "off", "1", "0", "maybe", "TRUE")]), (C("doc_id") % 6 + 1).cast("int")))}, "[true, false, true, false, false, true][doc_id % 6 + 1] as value")

over("p_is_no_concerns", "documents", "doc_id", lambda: {"ok": S.is_no_concerns(F.when(C("doc_id") % 3 == 0, F.concat(F.lit(" There were No Concerns "), C("lang"))).otherwise(C("text")))}, "doc_id % 3 = 0 or lower(text) like '%no concerns%' as ok")
over("p_is_boilerplate", "documents", "doc_id", lambda: {"b": S.is_boilerplate(F.when(C("doc_id") % 2 == 0, "").otherwise("t"), F.lit("No activity here"), F.lit(None).cast("string"))}, "doc_id % 2 = 0 as b")
over_feed("p_is_preferred_label", lambda: {"person": S.is_preferred_label(F.when(C("k") % 3 == 0, "Person").otherwise(C("label")))}, "k % 3 = 0 as person")
over_feed("p_folder_kinds", lambda: {"incident": S.is_incident_folder(F.when(C("k") % 3 == 0, F.concat(F.lit("test"), C("k").cast("string"))).otherwise(folder())), "test": S.is_test_run(F.when(C("k") % 3 == 0, F.concat(F.lit("test"), C("k").cast("string"))).otherwise(folder())), "camera": S.is_camera_dir(F.when(C("k") % 3 == 0, "saved").when(C("k") % 3 == 1, C("camera")).otherwise(folder()))},
     "k % 3 <> 0 as incident, k % 3 = 0 as test, k % 3 = 1 as camera")
over_feed("p_classify_duration", lambda: {"kind": P.classify_duration(C("start_us"), F.when(C("ended"), C("end_us")))}, "case when not ended or end_us - start_us < 5000000 then 'discarded' when end_us - start_us >= 120000000 then 'canceled' else 'kept' end as kind")
over_feed("p_classify_message_type", lambda: {"kind": P.classify_message_type(F.element_at(F.array(F.lit("new"), F.lit("update"), F.lit("end"), F.lit("other")), C("k") % 4 + 1))}, "['start','start','end','dropped'][k % 4 + 1] as kind")
over_feed("p_has_frame_data", lambda: {"has": P.has_frame_data(F.when(C("k") % 2 == 0, C("value")), F.when(C("k") % 3 == 0, C("k")))}, "k % 2 = 0 or k % 3 = 0 as has")
over_feed("p_is_ongoing", lambda: {"ongoing": P.is_ongoing(F.when(C("k") % 9 != 0, F.expr("start_us div 1000000")), C("k") % 2 == 0, C("ended"), 1_705_000_000)}, "k % 2 <> 0 and not ended and (k % 9 = 0 or 1705000000 - start_us // 1000000 < 5400) as ongoing")
over_feed("p_provider_phase", lambda: {"result": P.provider_phase(status())}, f"case when {STATUS} in ('snapshot_ready', 'clip_ready', 'finalized') then 'sent' else 'skipped' end as result")
over_feed("p_notification_gate", lambda: {"external": P.notification_gate(status(), True), "own": P.notification_gate(status(), False)}, "k % 9 not in (2, 7) as external, k % 9 <> 1 as own")
over_feed("p_attach_thumbnail", lambda: {"thumb": P.attach_thumbnail(status(), F.repeat(F.lit("x"), C("k") % 9 * 2 + C("k") % 5), 4)}, "case when k % 9 = 0 and k % 5 between 1 and 4 then repeat('x', k % 5) end as thumb")
over_feed("a24_dispatch_label", lambda: {"label": N.dispatch_label(status(), F.when(C("k") % 2 == 0, F.array(F.struct(F.lit("HUB").alias("provider"), F.lit("success").alias("status")), F.struct(F.lit("PUSH").alias("provider"), C("label").alias("status")))).otherwise(F.array().cast("array<struct<provider:string,status:string>>")))},
     f"'Notification: ' || {STATUS} || case when k % 2 = 0 then ' — HUB: success; PUSH: ' || label else '' end as label")


def summary_fields() -> dict[str, Column]:
    return {"event_id": C("event_id"), "camera": C("camera"), "label": C("label"), "phase": F.lit("NEW"), "title": F.when(C("k") % 2 == 0, "T").otherwise(""), "description": F.lit(None).cast("string"), "scene": F.when(C("k") % 3 == 0, "S"), "ai_description": F.lit("ai")}


over_feed("s_event_summary", lambda: {"text": R.event_summary(summary_fields(), F.expr("start_us div 1000000"), C("threat"))},
     "concat_ws(chr(10), 'Event ID: ' || event_id, 'Camera: ' || camera, 'Label: ' || label, 'Timestamp: ' || strftime(make_timestamp(start_us), '%Y-%m-%d %I:%M:%S %p'), 'Phase: NEW', '', case when k % 2 = 0 then 'Title: T' end, case when k % 3 = 0 then 'Scene: S' else 'AI Description: ai' end, case when threat > 0 then 'Threat Level: ' || threat || ' (' || ['Suspicious', 'Critical'][threat] || ')' end) as text")
over_feed("s_incident_summary", lambda: {"text": R.incident_summary(C("event_id").cast("string"), C("label"), F.expr("start_us div 1000000"), F.lit("T"), C("threat"))},
     "concat_ws(chr(10), 'Event ID: ' || event_id, 'Camera: events (consolidated)', 'Label: ' || label, 'Timestamp: ' || strftime(make_timestamp(start_us), '%Y-%m-%d %I:%M:%S %p'), 'Phase: finalized', '', 'Title: T', case when threat > 0 then 'Threat Level: ' || threat || ' (' || ['Suspicious', 'Critical'][threat] || ')' end, '', 'Review Summary: See review_summary.md') as text")
over_feed("s_canceled_summary", lambda: {"text": F.when(P.classify_duration(C("start_us"), C("end_us")) == "canceled", R.canceled_summary())},
     "case when end_us - start_us >= 120000000 then 'Title: Canceled event: max event length exceeded' || chr(10) || 'Description: Event exceeded max_event_length_seconds; AI analysis skipped.' end as text")
def metadata_fields() -> dict[str, Column]:
    return {"event_id": C("event_id"), "camera": C("camera"), "label": C("label"), "created_at": C("start_us"), "end_time": F.when(C("ended"), C("end_us")), "threat_level": C("threat"), "severity": F.lit("alert"), "genai_title": F.lit("T"), "genai_scene": F.when(C("k") % 2 == 0, "S"), "phase": F.lit("NEW")}


over_feed("s_metadata_rows", lambda: {"meta": R.metadata_row(metadata_fields()), "incident": R.incident_metadata_row({"event_id": C("event_id"), "genai_title": F.lit("T"), "genai_description": F.lit("D"), "threat_level": C("threat")})},
     """'{"event_id":' || event_id || ',"camera":"' || camera || '","label":"' || label || '","created_at":' || start_us || ',"end_time":' || case when ended then cast(end_us as varchar) else 'null' end || ',"threat_level":' || threat || ',"severity":"alert","genai_title":"T","genai_description":null,"genai_scene":' || case when k % 2 = 0 then '"S"' else 'null' end || ',"phase":"NEW"}' as meta,
        '{"event_id":' || event_id || ',"camera":"events","label":"unknown","created_at":0,"end_time":null,"threat_level":' || threat || ',"severity":"detection","genai_title":"T","genai_description":"D","genai_scene":"","phase":"finalized"}' as incident""")  # fmt: skip
