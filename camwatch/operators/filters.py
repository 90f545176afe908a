"""Predicates and routing of messages and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from camwatch.functions.scalars import RESERVED_DIRS, folder_ts, strip_canceled


def route_messages(df: DataFrame, events: str = "events", reviews: str = "reviews", updates: str = "/tracked_object_update") -> DataFrame:
    """``route``: events and reviews by equal topic, updates by a part of the topic, else rejected."""
    return df.withColumn("route", F.when(F.col("topic") == events, "events").when(F.col("topic").contains(updates), "updates").when(F.col("topic") == reviews, "reviews").otherwise("rejected"))


def drop_without_id(df: DataFrame, id_col: str = "event_id") -> DataFrame:
    return df.filter(F.col(id_col).isNotNull() & (F.col(id_col).cast("string") != ""))


def filter_camera_label(df: DataFrame, config: DataFrame) -> DataFrame:
    """Rows of listed cameras with an allowed label. No configuration at all allows everything; a camera without labels all labels.

    The configuration has a row for each camera; Spark broadcasts it by its size. Whether
    there is any is a subquery of the plan.
    """
    own = config.select("camera", F.col("labels").alias("__labels"))
    allowed = F.coalesce((F.size("__labels") == 0) | F.array_contains("__labels", F.col("label")), F.lit(False))
    none = config.agg(F.count("*")).scalar() == 0
    return df.join(own, "camera", "left").filter(none | allowed).select(*df.columns)


def classify_message_type(kind: Column) -> Column:
    return F.when(kind == "end", "end").when(kind.isin("new", "update"), "start").otherwise("dropped")


def should_start_event(df: DataFrame, config: DataFrame) -> DataFrame:
    """``starts``: no row for the camera, or the label is an exception, or no tracked zones, or a tracked zone was touched; trimmed, lower-cased."""
    clean = lambda c: F.transform(c, lambda x: F.lower(F.trim(x)))
    own = config.select("camera", clean(F.col("tracked_zones")).alias("__zones"), clean(F.col("exceptions")).alias("__exceptions"))
    j = df.join(own, "camera", "left")
    hit = F.arrays_overlap("__zones", clean(F.coalesce(F.col("zones"), F.array().cast("array<string>"))))
    starts = F.col("__zones").isNull() | F.array_contains("__exceptions", F.lower(F.trim("label"))) | (F.size("__zones") == 0) | F.coalesce(hit, F.lit(False))
    return j.withColumn("starts", F.coalesce(starts, F.lit(False))).drop("__zones", "__exceptions")


def classify_duration(start_us: Column, end_us: Column, least_s: int = 5, most_s: int = 120) -> Column:
    """discarded below the least, canceled from the most on, else kept; an open event has no duration."""
    d = F.coalesce(end_us, start_us) - start_us
    return F.when(d < least_s * 1_000_000, "discarded").when(d >= most_s * 1_000_000, "canceled").otherwise("kept")


def has_frame_data(*fields: Column) -> Column:
    found = F.lit(False)
    for c in fields:
        found = found | c.isNotNull()
    return found


def description_updates(df: DataFrame, ai_mode: str) -> DataFrame:
    return df.filter((F.col("type").isNull() | (F.col("type") == "description")) & F.lit(ai_mode != "external") & (F.col("event_id").cast("string") != "") & (F.col("description") != ""))


def review_updates(df: DataFrame, ai_mode: str) -> DataFrame:
    return df.filter(F.col("type").isin("update", "end", "genai") & F.lit(ai_mode != "external") & ((F.coalesce("title", F.lit("")) != "") | (F.coalesce("description", F.lit("")) != "")))


def filter_review_state(df: DataFrame, state: str = "unreviewed") -> DataFrame:
    viewed, saved, test = F.col("viewed"), F.col("saved"), F.col("test_run")
    kinds = {"reviewed": viewed & ~saved & ~test, "all": ~saved & ~test, "saved": saved, "test_events": test}
    return df.filter(kinds.get(state, ~viewed & ~saved & ~test))


def is_ongoing(ts: Column, has_clip: Column, ended: Column, now: int, window: int = 5400) -> Column:
    """No clip, not ended and younger than the window; without a readable time the age doesn't count."""
    return ~has_clip & ~ended & F.coalesce(F.lit(now) - ts < window, F.lit(True))


def retention_candidates(inventory: DataFrame, active: DataFrame, now: int, days: int) -> DataFrame:
    """Folders older than ``days`` that aren't active; test runs by mtime; reserved and malformed names are skipped.

    ``inventory``: name, mtime; ``active``: event_id (a canceled folder is active under its plain id).
    """
    cutoff = now - days * 86_400
    test = F.col("name").rlike(r"^test\d+$")
    rows = inventory.filter(~F.col("name").isin(*RESERVED_DIRS)).withColumn("plain", strip_canceled(F.col("name")))
    rows = rows.withColumns({"ts": F.when(test, F.col("mtime")).otherwise(folder_ts(F.col("plain"))), "event_id": F.substring_index("plain", "_", -1)})
    return rows.filter(F.col("ts") < cutoff).join(active.select("event_id"), "event_id", "left_anti").select("name", "ts")


def provider_phase(status: Column) -> Column:
    return F.when(status.isin("snapshot_ready", "clip_ready", "finalized"), "sent").otherwise("skipped")


#: Statuses that exist in the AI modes. Fixed values.
GATE = (
    ("new", True, True), ("snapshot_ready", True, False), ("described", False, True), ("discarded", True, True), ("canceled", True, True),
    ("finalized", True, True), ("clip_ready", True, True), ("summarized", False, True), ("overflow", True, True),
)


def notification_gate(status: Column, external: bool) -> Column:
    allowed = [s for s, ext, own in GATE if (ext if external else own)]
    return status.isin(*allowed)


def sample_frames(df: DataFrame, every: int, fps: Column) -> DataFrame:
    """Every n-th frame with its time; a rate that isn't positive counts as 30."""
    return df.filter(F.col("frame_number") % every == 0).withColumn("timestamp_sec", F.col("frame_number") / F.when(fps > 0, fps).otherwise(30.0))


def drop_no_person(df: DataFrame, area: str = "person_area") -> DataFrame:
    return df.filter(F.col(area) > 0)


def attach_thumbnail(status: Column, thumbnail: Column, most: int = 3000) -> Column:
    return F.when((status == "new") & F.length(thumbnail).between(1, most), thumbnail)


