"""Grouping events into incidents and rolling them up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def assign_incidents(events: DataFrame, gap_s: int = 120, by: str = "site_id", start: str = "start_us", tie: str = "event_id") -> DataFrame:
    """``incident_seq`` (from 1 for each site) and ``incident_id`` (``site_startµs``): a new one when the gap to the last start is at least ``gap_s``.

    Only starts count. Rows are dealt by site and day, so that no site is one task.
    Days are stitched through one row for each site and day: its first and last
    start and its number of breaks. An event's incident begins at the last break at
    or before it: within its day, or on an earlier day through the chain of days
    without a break. Rows without a site or a start have neither.
    """
    gap, day_us = gap_s * 1_000_000, 86_400_000_000
    rows = events.withColumn("__day", F.floor(F.col(start) / day_us))
    w = W.partitionBy(by, "__day").orderBy(start, tie)
    rows = rows.withColumn("__gap", F.col(start) - F.lag(start).over(w))
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    broken = F.when(F.col("__gap") >= gap, F.col(start))
    rows = rows.withColumns({"__break": F.max(broken).over(so_far), "__n": F.count(broken).over(so_far)})
    days = rows.groupBy(by, "__day").agg(F.min(start).alias("first"), F.max(start).alias("last"), F.max("__break").alias("break"), F.max("__n").alias("n"))
    d = W.partitionBy(by).orderBy("__day")
    fresh = F.coalesce(F.col("first") - F.lag("last").over(d) >= gap, F.lit(True))
    days = days.withColumn("__fresh", fresh).withColumns({"own": F.coalesce("break", F.when(F.col("__fresh"), F.col("first"))), "n": F.col("n") + F.col("__fresh").cast("int")})
    earlier = d.rowsBetween(W.unboundedPreceding, -1)
    days = days.select(
        F.col(by).alias("__by"), F.col("__day").alias("__at"), F.when(F.col("__fresh"), F.col("first")).otherwise(F.last("own", ignorenulls=True).over(earlier)).alias("__carried"),
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + F.col("__fresh").cast("int")).alias("__before"),
    )
    both = rows.join(days, (F.col(by) == F.col("__by")) & (F.col("__day") == F.col("__at")), "left")
    ids = F.concat(F.col(by).cast("string"), F.lit("_"), F.coalesce("__break", "__carried").cast("string"))
    return both.withColumns({"incident_seq": F.col("__before") + F.col("__n"), "incident_id": ids}).drop("__day", "__gap", "__break", "__n", "__by", "__at", "__carried", "__before")


def assign_incidents_by_day(events: DataFrame, gap_s: int = 120, by: str = "site_id") -> DataFrame:
    """``incident_id`` alone, as ``assign_incidents`` gives it."""
    return assign_incidents(events, gap_s, by).drop("incident_seq")


def rollup_incidents(members: DataFrame) -> DataFrame:
    """One row for each incident.

    Start, cameras and labels come from all members; ids, primary event and end from
    those that weren't discarded (an incident without such members is left out). A
    canceled member cancels the incident. Cameras are in the order first seen. The
    label is ``person`` if no member has one. Title and description are the last that
    are not null, by start. ``members``: incident_id, event_id, camera, label, start_us,
    end_us, threat, kind; title and description if there are any.
    """
    kept = F.col("kind") != "discarded"
    order = F.struct("start_us", "event_id")
    cams = members.groupBy("incident_id", "camera").agg(F.min(order).alias("o")).groupBy("incident_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "camera"))), lambda x: x["camera"]), ",").alias("cameras"), F.count("*").alias("n_cameras"))
    base = members.groupBy("incident_id").agg(
        F.min("start_us").alias("start_us"), F.max("start_us").alias("last_activity_us"), F.max(F.when(kept, F.col("end_us"))).alias("end_max_us"),
        F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("label"), F.max("threat").alias("threat"), F.count_if(kept).alias("n_events"),
        F.min_by("event_id", F.when(kept, order)).alias("primary_event"), F.bool_or(F.col("kind") == "canceled").alias("canceled"),
    )
    base = base.filter("n_events > 0").join(cams, "incident_id").withColumn("label", F.when(F.col("label") != "", F.col("label")).otherwise("person"))
    texts = [c for c in ("title", "description") if c in members.columns]
    if texts:
        base = base.join(members.groupBy("incident_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in texts)), "incident_id")
    return base


def incident_span(members: DataFrame, open_s: int = 30, before_s: int = 5, after_s: int = 30, summary_s: int = 15) -> DataFrame:
    """Span over the members (an open one ends 30 s after its start), and the windows of the export and of the summary in whole seconds."""
    end = F.coalesce("end_us", F.col("start_us") + open_s * 1_000_000)
    g = members.groupBy("incident_id").agg(F.min("start_us").alias("start_us"), F.max(end).alias("end_us"))
    first, last = F.expr("start_us div 1000000"), F.expr("end_us div 1000000")
    return g.withColumns({"export_from": first - before_s, "export_to": last + after_s, "summary_from": first - summary_s, "summary_to": last + summary_s})


def event_phase(descriptions: DataFrame, reviews: DataFrame, events: DataFrame) -> DataFrame:
    """event_id, phase, ai_description, description: a review finalizes, a description lifts a new event.

    The latest description and the latest review count, each for a text of its own:
    what a later description says stays beside the review's text. Of equal times the
    least ``seq`` counts, in tables that have such a column (a number), else the greatest text.
    """
    latest = lambda df: F.max_by("text", F.struct("ts", -F.col("seq") if "seq" in df.columns else "text"))
    d = descriptions.groupBy("event_id").agg(latest(descriptions).alias("d"), F.lit(True).alias("has_d"))
    r = reviews.groupBy("event_id").agg(latest(reviews).alias("r"), F.lit(True).alias("has_r"))
    j = events.select("event_id").join(d, "event_id", "left").join(r, "event_id", "left")
    return j.select("event_id", F.when(F.col("has_r"), "FINALIZED").when(F.col("has_d"), "DESCRIBED").otherwise("NEW").alias("phase"), F.col("d").alias("ai_description"), F.col("r").alias("description"))


def last_n_frames(frames: DataFrame, n: int = 500, key: str = "event_id", *order: str) -> DataFrame:
    """The last n rows of each key; Spark keeps n rows a task before the shuffle."""
    w = W.partitionBy(key).orderBy(*(F.desc(c) for c in order or ("frame_time",)))
    return frames.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")
