"""Queries over the stored events: listing, counts, storage, timelines, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from camwatch.functions.scalars import event_description, event_label, event_title, is_boilerplate, is_test_run, media_urls, parse_summary
from camwatch.operators.filters import filter_review_state, is_ongoing
from camwatch.operators.joins import first_per_key, metadata_fallback

#: Files whose bytes count as descriptions. Fixed values.
DESCRIPTION_FILES = ("summary.txt", "review_summary.md", "metadata.json", "notification_timeline.json", "analysis_result.json")
#: Those of an incident's root. Fixed values.
ROOT_FILES = ("notification.gif", "review_summary.md")
PHASES = ("NEW", "DESCRIBED", "FINALIZED", "SUMMARIZED")


def resolve_latest_file(inventory: DataFrame, suffix: str = ".mp4") -> DataFrame:
    """folder, camera, file, size of the newest file with that suffix (any case); ties go to the later name."""
    hit = inventory.filter(F.lower("file").endswith(suffix))
    return hit.groupBy("folder", "camera").agg(F.max(F.struct("mtime", "file", "size")).alias("m")).select("folder", "camera", F.col("m.file").alias("file"), F.col("m.size").alias("size"))


def storage_stats(inventory: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """camera (null: all), clips, snapshots, descriptions in bytes, from one grouping with a grand total.

    Of clips only the newest of each folder and camera counts. Two files of an
    incident's root count for the total, not for a camera; so does all that
    ``reports`` (size) lists.
    """
    if reports is not None:
        rest = reports.select(F.lit("").alias("folder"), F.lit(None).cast("string").alias("camera"), F.lit(ROOT_FILES[-1]).alias("file"), "size", F.lit(0).alias("mtime"))
        inventory = inventory.select("folder", "camera", "file", "size", "mtime").unionByName(rest)
    name = F.lower("file")
    w = W.partitionBy("folder", "camera", F.when(name.endswith(".mp4"), "clip").otherwise(F.col("file"))).orderBy(F.desc("mtime"), F.desc("file"))
    rows = inventory.withColumn("__n", F.row_number().over(w)).withColumn("root", F.col("camera").isNull()).withColumn("camera", F.coalesce("camera", F.lit("")))
    clip = name.endswith(".mp4") & (F.col("__n") == 1) & ~F.col("root")
    snap = (F.col("file") == "snapshot.jpg") & ~F.col("root")
    desc = F.when(F.col("root"), F.col("file").isin(*ROOT_FILES)).otherwise(F.col("file").isin(*DESCRIPTION_FILES))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)).alias
    g = rows.rollup("camera").agg(total(clip)("clips"), total(snap)("snapshots"), total(desc)("descriptions"), F.grouping("camera").alias("g"))
    return g.filter("g = 1 or camera <> ''").select(F.when(F.col("g") == 0, F.col("camera")).alias("camera"), "clips", "snapshots", "descriptions")


def active_event_stats(events: DataFrame) -> DataFrame:
    """kind, name, n: the total, every phase (0 where none) and the cameras."""
    spark = events.sparkSession
    phases = spark.createDataFrame([(p,) for p in PHASES], "name string")
    by_phase = phases.join(events.groupBy(F.col("phase").alias("name")).agg(F.count("*").alias("n")), "name", "left").select(F.lit("phase").alias("kind"), "name", F.coalesce("n", F.lit(0)).alias("n"))
    total = events.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit("").alias("name"), "n")
    cams = events.groupBy("camera").agg(F.count("*").alias("n")).select(F.lit("camera").alias("kind"), F.col("camera").alias("name"), "n")
    return total.union(by_phase).union(cams)


def event_period_counts(events: DataFrame, now: int) -> DataFrame:
    """last_day, last_week, last_month, reviewed, unreviewed of rows with a readable ``ts`` in seconds."""
    day = 86_400
    ok = events.filter("ts is not null")
    return ok.agg(
        F.count_if(F.col("ts") >= now - day).alias("last_day"), F.count_if(F.col("ts") >= now - 7 * day).alias("last_week"), F.count_if(F.col("ts") >= now - 30 * day).alias("last_month"),
        F.count_if("viewed").alias("reviewed"), F.count_if(~F.col("viewed")).alias("unreviewed"),
    )


def events_by_camera(incidents: DataFrame) -> DataFrame:
    """An incident counts once for each of its cameras."""
    return incidents.select(F.explode(F.array_distinct("cameras")).alias("camera")).groupBy("camera").agg(F.count("*").alias("n"))


def most_recent_event(events: DataFrame) -> DataFrame:
    return events.agg(F.min_by(F.struct("event_id", "camera", "start_us"), F.struct(-F.col("start_us"), "camera", "event_id")).alias("m")).select("m.*")


def _time_of(path: str) -> Column:
    return F.get_json_object("data", path).try_cast("double")


def end_timestamp(entries: DataFrame, key: str = "event_id") -> DataFrame:
    """Latest readable end time among the entries' payloads and the test prompts; without any, null."""
    prompt = F.when(F.col("source") == "test_ai_prompt", _time_of("$.end_time"))
    return entries.groupBy(key).agg(F.max(F.greatest(_time_of("$.payload.after.end_time"), prompt)).alias("end_time"))


def end_or_metadata(end_time: Column, meta: Column) -> Column:
    """The timeline's end time, else (also if it is 0) the metadata's."""
    return F.coalesce(F.when(end_time != 0, end_time), F.get_json_object(meta, "$.end_time").try_cast("double"))


def event_ended(entries: DataFrame, key: str = "event_id") -> DataFrame:
    ended = F.lower("label").contains("event end") | (F.get_json_object("data", "$.payload.type") == "end") | F.get_json_object("data", "$.payload.after.end_time").isNotNull()
    return entries.groupBy(key).agg(F.bool_or(F.coalesce(ended, F.lit(False))).alias("ended"))


def camera_zones(entries: DataFrame) -> DataFrame:
    """camera, zones: distinct zones entered or current, sorted and joined; cameras without zones stay."""
    e = entries.select("camera", F.explode_outer("zones").alias("zone"))
    return e.groupBy("camera").agg(F.array_join(F.array_sort(F.collect_set("zone")), ",").alias("zones"))


def genai_entries(entries: DataFrame, key: str = "event_id") -> DataFrame:
    """The first of each different description of an event, without boilerplate; ``pos`` gives the order."""
    t = {c: F.trim(F.coalesce(c, F.lit(""))) for c in ("title", "summary", "scene")}
    rows = entries.filter((F.col("type") == "genai") & ~is_boilerplate(F.col("title"), F.col("summary"), F.col("scene")))
    return first_per_key(rows.withColumns({f"__{c}": x for c, x in t.items()}), [key, "__title", "__summary", "__scene"], F.col("pos")).drop("__title", "__summary", "__scene")


def list_events(rows: DataFrame) -> DataFrame:
    """Newest first by the timestamp's text."""
    return rows.orderBy(F.desc(F.col("ts").cast("string")), "event_id")


def timeline_newest_first(entries: DataFrame) -> DataFrame:
    return entries.orderBy(F.desc(F.coalesce("ts", F.lit(""))), "pos")


def union_event_layouts(flat: DataFrame, incidents: DataFrame) -> DataFrame:
    return flat.unionByName(incidents, allowMissingColumns=True)


def union_timeline_parts(base: DataFrame, appended: DataFrame) -> DataFrame:
    """Base entries, then appended ones, repeats kept; ``part`` and ``pos`` give the order."""
    return base.withColumn("part", F.lit(0)).unionByName(appended.withColumn("part", F.lit(1)), allowMissingColumns=True)


def apply_review_flags(events: DataFrame, flags: DataFrame) -> DataFrame:
    """The latest value of each flag of each event, of equal times that with the greatest ``change_id``; none set is false."""
    last = flags.groupBy("event_id").agg(
        F.max_by("value", F.when(F.col("flag") == "viewed", F.struct("ts_us", "change_id"))).alias("viewed"),
        F.max_by("value", F.when(F.col("flag") == "kept", F.struct("ts_us", "change_id"))).alias("kept"),
    )
    return events.join(last, "event_id", "left").withColumns({"viewed": F.coalesce("viewed", F.lit(False)), "kept": F.coalesce("kept", F.lit(False))})


def recent_errors(log: DataFrame, n: int = 10) -> DataFrame:
    return log.filter(F.col("level").isin("WARNING", "ERROR", "CRITICAL")).select("ts_us", "log_id", "level", F.substring("message", 1, 500).alias("message")).orderBy(F.desc("ts_us"), F.desc("log_id")).limit(n)


def list_cameras(stored: DataFrame, configured: DataFrame) -> DataFrame:
    return stored.select("camera").union(configured.select("camera")).filter("camera is not null").distinct()


def timeline_time_range(entries: DataFrame, mtime: Column, key: str = "event_id") -> DataFrame:
    """start_s, end_s over the entries and the test prompts; if either is missing, the minute before ``mtime``.

    An entry's start is the first of the three known fields that is set at all
    (neither missing nor 0 or empty, but for the last one).
    """
    after, before = (F.get_json_object("data", f"$.payload.{x}.created_at") for x in ("after", "before"))
    set_ = lambda c: F.when(~c.isin("", "0", "0.0", "false"), c)
    first = F.coalesce(set_(after), set_(before), F.get_json_object("data", "$.payload.after.start_time")).try_cast("double")
    prompt = lambda k: F.when(F.col("source") == "test_ai_prompt", _time_of(f"$.{k}"))
    g = entries.groupBy(key).agg(F.min(F.least(first, prompt("start_time"))).alias("a"), F.max(F.greatest(_time_of("$.payload.after.end_time"), prompt("end_time"))).alias("b"), F.max(mtime).alias("m"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return g.select(key, F.when(both, F.col("a")).otherwise(F.col("m") - 60).alias("start_s"), F.when(both, F.col("b")).otherwise(F.col("m")).alias("end_s"))


def list_test_runs(folders: DataFrame) -> DataFrame:
    """folder, ts (seconds, as text): test runs with a camera folder at least, the last changed first.

    ``folders``: folder, camera (null for the run's own row), mtime. A run's time is the
    latest of its own and its cameras'; their order is by its own.
    """
    runs = folders.filter(is_test_run(F.col("folder"))).groupBy("folder").agg(
        F.max(F.when(F.col("camera").isNull(), F.col("mtime"))).alias("own"), F.max("mtime").alias("latest"), F.array_sort(F.collect_set("camera")).alias("cameras")
    )
    return runs.filter(F.size("cameras") > 0).select("folder", F.floor("latest").cast("bigint").cast("string").alias("ts"), "cameras", "own").orderBy(F.desc("own"), "folder")


def saved_events(events: DataFrame, camera: str | None = None) -> DataFrame:
    """Kept events, of one camera if given, newest first by the timestamp's text; ``saved`` is true."""
    rows = events.filter("saved")
    return list_events(rows if camera is None else rows.filter(F.col("camera") == camera))


def event_listing(folders: DataFrame, cameras: DataFrame, entries: DataFrame, now: int, state: str = "unreviewed") -> DataFrame:
    """One row for each listed event, newest first.

    ``folders``: incident_id, ts, summary, meta, viewed, saved, test_run, video.
    ``cameras``: incident_id, camera, clip, snapshot, meta. ``entries``: incident_id,
    camera, pos, source, label, data, zones, type, title, summary, scene.
    """
    own = metadata_fallback(filter_review_state(folders, state), cameras.select("incident_id", "camera", "meta"))
    cams = cameras.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("camera", "clip", "snapshot"))).alias("cams"))
    # one pass over the timeline for what is told of the whole event, one for the zones of each camera, one for the texts
    at = entries.withColumn("event_id", F.col("incident_id"))
    told = event_ended(at).join(end_timestamp(at), "event_id")
    zones = at.select("event_id", "camera", F.explode_outer("zones").alias("zone")).groupBy("event_id", "camera").agg(F.array_join(F.array_sort(F.collect_set("zone")), ",").alias("zones"))
    zones = zones.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "camera", "zones"))), ";").alias("zones"))
    texts = genai_entries(at).groupBy("event_id").agg(F.count("*").alias("n_texts"))
    rows = own.join(cams, "incident_id", "left")
    for more in (told, zones, texts):
        rows = rows.join(more.withColumnRenamed("event_id", "incident_id"), "incident_id", "left")
    parsed, meta = F.col("parsed"), F.col("meta")
    media = media_urls(F.col("incident_id"), F.coalesce("cams", F.array().cast("array<struct<camera:string,clip:string,snapshot:boolean>>")), F.col("video"))
    rows = rows.withColumns({"parsed": parse_summary(F.col("summary")), "media": media})
    return list_events(
        rows.select(
            F.col("incident_id").alias("event_id"), "ts", event_title(meta, parsed).alias("title"), event_description(meta, parsed).alias("description"), event_label(meta, parsed).alias("label"),
            F.coalesce(F.get_json_object(meta, "$.threat_level").try_cast("int"), F.lit(0)).alias("threat"), "viewed", F.col("media.has_clip").alias("has_clip"), F.col("media.hosted_clip").alias("hosted_clip"), F.col("media.hosted_snapshot").alias("hosted_snapshot"),
            F.array_join(F.transform("media.hosted_clips", lambda c: F.concat_ws("=", c["camera"], c["url"])), ";").alias("hosted_clips"), F.array_join(F.transform("cams", lambda c: c["camera"]), ",").alias("cameras"), "zones",
            end_or_metadata(F.col("end_time"), meta).alias("end_time"), is_ongoing(F.col("ts"), F.col("media.has_clip"), F.coalesce("ended", F.lit(False)), now).alias("ongoing"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
        )
    )
