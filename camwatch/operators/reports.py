"""Daily reports and the export audit."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from camwatch.functions.scalars import display_datetime, display_time


#: Files that an event's page lists of each camera, besides its clip. Fixed values.
PAGE_FILES = ("snapshot.jpg", "metadata.json", "summary.txt", "review_summary.md", "ai_analysis_debug.zip")


def daily_events(events: DataFrame, date: Column) -> DataFrame:
    """Events whose time, in seconds, is on that date."""
    return events.filter(F.to_date(F.timestamp_seconds("ts")) == date)


def report_lines(events: DataFrame) -> DataFrame:
    """report_date, ts, line, place (from 1 on each date): ``[time] title: summary (Threat: n)`` in the order of time, then text.

    A date's places are counted by hour: rows before an hour are one number a date and
    hour, so that no date is one task.
    """
    line = F.concat(F.lit("["), display_time(F.col("ts")), F.lit("] "), F.trim(F.coalesce("title", F.lit(""))), F.lit(": "), F.trim(F.coalesce("summary", F.lit(""))), F.lit(" (Threat: "), F.coalesce(F.col("threat"), F.lit(0)).cast("string"), F.lit(")"))
    rows = events.withColumns({"report_date": F.to_date(F.timestamp_seconds("ts")), "line": line, "hour": F.floor(F.col("ts") / 3600)})
    before = rows.groupBy("report_date", "hour").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("report_date").orderBy("hour").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(W.partitionBy("report_date", "hour").orderBy("ts", "line"))
    return rows.withColumn("own", own).join(before, ["report_date", "hour"]).select("report_date", "ts", "line", (F.col("before") + F.col("own")).alias("place"))


def render_lines(lines: DataFrame, date: Column) -> DataFrame:
    """One row: all lines of one date as one text, and their number. It is one report, and its text is one value."""
    rows = F.array_sort(F.collect_list(F.struct("place", "line")))
    return lines.filter(F.col("report_date") == date).agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("lines"), F.count("*").alias("n"))


def report_json(events: DataFrame) -> DataFrame:
    """report_date, time, entry: a JSON object of seven fields for each event.

    A report lists them by the text of ``time``, as the aggregate file's readers do;
    ties by the object's text. ``events``: ts, title, scene, confidence, threat,
    camera, context (an array or null).
    """
    time = display_datetime(F.col("ts"))
    entry = F.struct(
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("scene", F.lit("")).alias("scene"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce(F.col("threat").try_cast("int"), F.lit(0)).alias("threat_level"),
        F.coalesce("camera", F.lit("unknown")).alias("camera"), time.alias("time"), F.coalesce("context", F.array().cast("array<string>")).alias("context"),
    )
    return events.select(F.to_date(F.timestamp_seconds("ts")).alias("report_date"), time.alias("time"), F.to_json(entry).alias("entry"))


def render_json(entries: DataFrame, date: Column) -> DataFrame:
    """One row: the JSON array of one date's entries in their order, and their number."""
    rows = F.array_sort(F.collect_list(F.struct("time", "entry")))
    return entries.filter(F.col("report_date") == date).agg(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda x: x["entry"]), ","), F.lit("]")).alias("entries"), F.count("*").alias("n"))


def list_report_dates(files: DataFrame) -> DataFrame:
    """Dates of files named ``YYYY-MM-DD_report.md``, newest first; impossible dates are skipped."""
    return files.select(F.try_to_date(F.regexp_extract("file", r"^(\d{4}-\d{2}-\d{2})_report\.md$", 1), "yyyy-MM-dd").alias("report_date")).filter("report_date is not null").distinct().orderBy(F.desc("report_date"))


def report_retention(files: DataFrame, today: Column, days: int) -> DataFrame:
    """Reports older than that many days."""
    return files.filter(F.col("report_date") < F.date_sub(today, days))


def export_turnaround(entries: DataFrame, request: str, response: str, key: str = "event_id") -> DataFrame:
    """Microseconds from the first request to the last response; null without both."""
    a, b = F.min(F.when(F.col("label").contains(request), F.col("ts_us"))), F.max(F.when(F.col("label").contains(response), F.col("ts_us")))
    return entries.groupBy(key).agg((b - a).alias("turnaround_us"))


def outcome_summary(results: DataFrame, timelines: DataFrame | None = None) -> DataFrame:
    """outcome, n, reason: success (200 to 299), already_gone (404 or 422) or failure by the status code.

    With ``timelines`` (one row a folder that has a timeline, ``n_entries`` export
    responses in it), a run without results gives one row ``none`` with the reason.
    """
    code = F.col("code")
    none = F.lit(None).cast("string")
    counts = results.groupBy(F.when(code.between(200, 299), "success").when(code.isin(404, 422), "already_gone").otherwise("failure").alias("outcome")).agg(F.count("*").alias("n")).withColumn("reason", none)
    if timelines is None:
        return counts
    seen = timelines.agg(F.count("*").alias("folders"), F.coalesce(F.sum("n_entries"), F.lit(0)).alias("entries"))  # one row
    why = F.when(F.col("folders") == 0, "no folders with timeline").when(F.col("entries") == 0, "no export responses in timelines").otherwise("entries found but all skipped (clip or export id missing)")
    total = results.agg(F.count("*").alias("total")).withColumn("k", F.lit(1))
    skipped = seen.withColumn("k", F.lit(1)).join(F.broadcast(total), "k").filter("total = 0").select(F.lit("none").alias("outcome"), F.lit(0).cast("bigint").alias("n"), why.alias("reason"))
    return counts.unionByName(skipped)


def link_check_plan(files: DataFrame, folders: int = 20, most: int = 120) -> DataFrame:
    """The first ``most`` files of the first ``folders`` folders, by name. Both limits are the feature."""
    first = files.select("folder").distinct().orderBy("folder").limit(folders)
    return files.join(F.broadcast(first), "folder").orderBy("folder", F.coalesce("camera", F.lit("")), "file", "mtime").limit(most)


def event_files(inventory: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """folder, camera, file: files in the root, and of each camera the newest clip and the known names."""
    clip = F.lower("file").endswith(".mp4")
    w = W.partitionBy("folder", "camera", clip).orderBy(F.desc("mtime"), F.desc("file"))
    rows = inventory.withColumn("__n", F.row_number().over(w))
    return rows.filter(F.col("camera").isNull() | (clip & (F.col("__n") == 1)) | F.col("file").isin(*known)).select("folder", "camera", "file").distinct()


def event_summary(fields: dict[str, Column], created_s: Column, threat: Column) -> Column:
    """Text of an event's summary; lines without a value are left out."""
    from camwatch.functions.scalars import display_datetime, threat_name

    line = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}: "), c))
    head = [F.concat(F.lit(f"{n}: "), fields[k].cast("string")) for n, k in (("Event ID", "event_id"), ("Camera", "camera"), ("Label", "label"))]
    return F.concat_ws(
        "\n", *head, F.concat(F.lit("Timestamp: "), display_datetime(created_s)), F.concat(F.lit("Phase: "), fields["phase"]), F.lit(""),
        line("Title", fields["title"]), line("Description", fields["description"]),
        F.when(fields["scene"] != "", F.concat(F.lit("Scene: "), fields["scene"])).otherwise(line("AI Description", fields["ai_description"])),
        F.when(threat > 0, F.concat(F.lit("Threat Level: "), threat.cast("string"), F.lit(" ("), threat_name(threat), F.lit(")"))),
    )


def incident_summary(incident: Column, label: Column, start_s: Column, title: Column, threat: Column) -> Column:
    """Text of an incident's summary; it always ends with the pointer to the review."""
    from camwatch.functions.scalars import display_datetime, threat_name

    return F.concat_ws(
        "\n", F.concat(F.lit("Event ID: "), incident), F.lit("Camera: events (consolidated)"), F.concat(F.lit("Label: "), label), F.concat(F.lit("Timestamp: "), F.coalesce(display_datetime(start_s), F.lit(""))), F.lit("Phase: finalized"), F.lit(""),
        F.when(title != "", F.concat(F.lit("Title: "), title)), F.when(threat > 0, F.concat(F.lit("Threat Level: "), threat.cast("string"), F.lit(" ("), threat_name(threat), F.lit(")"))), F.lit(""), F.lit("Review Summary: See review_summary.md"),
    )


def canceled_summary() -> Column:
    return F.lit("Title: Canceled event: max event length exceeded\nDescription: Event exceeded max_event_length_seconds; AI analysis skipped.")


#: Fields of an event's metadata file. Fixed values.
METADATA = ("event_id", "camera", "label", "created_at", "end_time", "threat_level", "severity", "genai_title", "genai_description", "genai_scene", "phase")


def metadata_row(fields: Mapping[str, Column]) -> Column:
    """An event's metadata as JSON with all eleven fields; missing values are null."""
    return F.to_json(F.struct(*(fields.get(k, F.lit(None).cast("string")).alias(k) for k in METADATA)), {"ignoreNullFields": "false"})


def incident_metadata_row(fields: Mapping[str, Column]) -> Column:
    """The same for an incident: its severity and phase are fixed, absent values have defaults."""
    given = {"camera": F.lit("events"), "label": F.lit("unknown"), "created_at": F.lit(0), "threat_level": F.lit(0), "genai_scene": F.lit("")} | dict(fields)
    return metadata_row(given | {"severity": F.lit("detection"), "phase": F.lit("finalized")})
