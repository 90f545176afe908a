"""Readers and writers of the event store's files, through Spark's own sources."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

#: Size of a frame whose camera has no readable sidecar. Fixed values.
DEFAULT_SIZE = (1920, 1080)


def read_inventory(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), folder, file, size, mtime of all files but empty ones and those whose names begin with a dot or an underscore, which Spark leaves out; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))
    marker = root.rstrip("/").split("/")[-1]
    rel = F.substring_index(F.col("path"), f"/{marker}/", -1)
    return files.select(rel.alias("path"), F.regexp_extract(rel, "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract(rel, "([^/]*)$", 1).alias("file"), "size", "mtime")


def _texts(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("wholetext", "true").text(root).select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder"), "value")


def with_marker(folders: DataFrame, root: str, name: str = ".viewed", col: str = "viewed") -> DataFrame:
    """``col``: whether the folder (below root) holds a file of that name. Spark's listing leaves out names that begin with a dot, so tasks ask the store for it, a batch of folders at once."""
    base = root.rstrip("/") if ":" in root else f"file://{root.rstrip('/')}"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pyarrow.fs.FileSystem.from_uri(base)
        for batch in batches:
            found = fs.get_file_info([f"{top}/{f}/{name}" for f in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.type == pyarrow.fs.FileType.File for x in found], pa.bool_())], names=[*batch.schema.names, col])

    at = folders.columns.index("folder")
    return folders.mapInArrow(ask, StructType([*folders.schema.fields, StructField(col, BooleanType())]))


#: Files of an event folder whose contents are read. Fixed values.
SUMMARY, METADATA, REVIEW, TIMELINE, APPENDED = "summary.txt", "metadata.json", "review_summary.md", "notification_timeline.json", "notification_timeline_append.jsonl"


def read_event_store(spark: SparkSession, root: str) -> DataFrame:
    """A row for each folder that holds a file (not one whose name begins with a dot) or a folder with files: folder, summary, title, metadata, event_id, timeline, review_summary, has_clip, clip, has_snapshot, viewed, cameras, subfolders.

    Missing or bad files give defaults: title ``Analysis pending...``, metadata ``{}``, an
    empty timeline, null texts. ``timeline`` has the entries of the base file in their order,
    then the appended lines; ``event_id`` is the base file's, else what follows the first
    ``_`` of the folder's name. ``clip`` is the newest .mp4. ``subfolders`` maps the names
    of those below that don't begin with a dot to has_clip, clip, has_snapshot and
    metadata; ``cameras`` are these names, sorted.

    The names of all files come from one listing that reads no contents, the contents of
    the few small kinds of files from one more.
    """
    from camwatch.functions.scalars import parse_summary
    from camwatch.operators.store import resolve_latest_file

    inv = read_inventory(spark, root)
    marker = root.rstrip("/").split("/")[-1]
    kinds = [SUMMARY, METADATA, REVIEW, TIMELINE, APPENDED]
    small = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(kinds) + "}").load(root)
    rel = F.substring_index(F.col("path"), f"/{marker}/", -1)
    text = small.select(F.regexp_extract(rel, "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract(rel, "([^/]*)$", 1).alias("file"), F.decode("content", "UTF-8").alias("value"))
    is_a = lambda k: F.max(F.when(F.col("file") == k, F.col("value")))
    texts = text.groupBy("folder").agg(*(is_a(k).alias(f"t{i}") for i, k in enumerate(kinds)))
    clips = resolve_latest_file(inv.withColumn("camera", F.lit(None).cast("string"))).select("folder", F.col("file").alias("clip"))
    has = lambda k: F.bool_or(F.col("file") == k)
    own = inv.groupBy("folder").agg(has("snapshot.jpg").alias("has_snapshot"))
    own = with_marker(own, root).join(clips, "folder", "left").join(texts, "folder", "left")
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), F.col(c))
    own = own.withColumns({"has_clip": F.col("clip").isNotNull(), "metadata": valid("t1")})
    # a folder below counts for the one above it, whether that has files of its own or not
    below = own.withColumns({"over": F.regexp_extract("folder", "^(.*)/[^/]*$", 1), "name": F.regexp_extract("folder", "([^/]*)$", 1)}).filter("folder <> '' and name not like '.%'")
    subs = below.groupBy(F.col("over").alias("folder")).agg(F.array_sort(F.collect_list(F.struct("name", F.struct("has_clip", "clip", "has_snapshot", "metadata").alias("v")))).alias("subs"))
    j = own.join(subs, "folder", "full")
    blank = F.lit(" \t\r\n")
    base = F.when(F.try_parse_json("t3").isNotNull(), F.col("t3"))
    entries = F.coalesce(F.from_json(F.get_json_object(base, "$.entries"), "array<string>"), F.array().cast("array<string>"))
    lines = F.coalesce(F.filter(F.transform(F.split("t4", "\n"), lambda x: F.btrim(x, blank)), lambda x: F.try_parse_json(x).isNotNull()), F.array().cast("array<string>"))
    last = F.regexp_extract("folder", "([^/]*)$", 1)
    name = F.when(last.contains("_"), F.substr(last, F.instr(last, "_") + F.lit(1))).otherwise(last)
    summary = parse_summary(F.col("t0"))
    return j.select(
        "folder", summary.alias("summary"), F.coalesce(F.try_element_at(summary, F.lit("Title")), F.lit("Analysis pending...")).alias("title"), F.coalesce("metadata", F.lit("{}")).alias("metadata"),
        F.coalesce(F.get_json_object(base, "$.event_id"), name).alias("event_id"), F.concat(entries, lines).alias("timeline"), F.btrim("t2", blank).alias("review_summary"),
        *(F.coalesce(c, F.lit(False)).alias(c) for c in ("has_clip", "has_snapshot", "viewed")), "clip",
        F.coalesce(F.transform("subs", lambda x: x["name"]), F.array().cast("array<string>")).alias("cameras"), F.map_from_entries(F.transform("subs", lambda x: F.struct(x["name"], x["v"]))).alias("subfolders"),
    )


def read_timeline(spark: SparkSession, root: str) -> DataFrame:
    """folder, part, pos, entry (JSON): base entries in order, then appended lines; bad lines are skipped."""
    base = _texts(spark, root, "notification_timeline.json").select("folder", F.lit(0).alias("part"), F.posexplode(F.from_json(F.get_json_object("value", "$.entries"), "array<string>")).alias("pos", "entry"))
    more = _texts(spark, root, "notification_timeline_append.jsonl").select("folder", F.lit(1).alias("part"), F.posexplode(F.split("value", "\n")).alias("pos", "entry"))
    return base.unionByName(more).filter(F.try_parse_json("entry").isNotNull() & F.col("entry").startswith("{"))


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """folder, native_width, native_height, frame_number, timestamp_sec, label, x1, y1, x2, y2, px, py (the centerpoint), area; frames without detections keep a row.

    A bare list of entries has size 0 x 0; an object without entries is left out.
    """
    det = "struct<label:string,bbox:array<double>,centerpoint:array<double>,area:bigint>"
    entry = f"array<struct<frame_number:int,timestamp_sec:double,detections:array<{det}>>>"
    t = _texts(spark, root, "detection.json").withColumn("value", F.trim("value"))
    bare = F.col("value").startswith("[")
    rows = t.select(
        "folder", F.when(bare, 0).otherwise(F.get_json_object("value", "$.native_width").try_cast("int")).alias("native_width"), F.when(bare, 0).otherwise(F.get_json_object("value", "$.native_height").try_cast("int")).alias("native_height"),
        F.explode(F.from_json(F.when(bare, F.col("value")).otherwise(F.get_json_object("value", "$.entries")), entry)).alias("e"),
    ).select("folder", "native_width", "native_height", "e.frame_number", "e.timestamp_sec", F.explode_outer("e.detections").alias("d"))
    return rows.select("folder", "native_width", "native_height", "frame_number", "timestamp_sec", "d.label", *(F.get("d.bbox", i).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))), *(F.get("d.centerpoint", i).alias(c) for i, c in enumerate(("px", "py"))), "d.area")


def sidecars_with_fallback(wanted: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every wanted camera with its native size; a missing camera or a size of 0 has the default. ``missing`` tells which had none."""
    j = wanted.join(sizes.withColumn("__has", F.lit(True)), ["incident_id", "camera"], "left")
    size = lambda c, d: F.coalesce(F.when(F.col(c) > 0, F.col(c)), F.lit(d))
    return j.withColumns({"native_width": size("native_width", DEFAULT_SIZE[0]), "native_height": size("native_height", DEFAULT_SIZE[1]), "missing": F.col("__has").isNull()}).drop("__has")


def read_daily_aggregate(spark: SparkSession, path: str, date: str, schema: str = "event_id string, title string, description string, threat int") -> DataFrame | None:
    """The analysis rows of a date; None if there is no file for it, no rows if it is empty.

    ``path`` has a folder of JSON lines for each date (``report_date=2024-01-05``), or a
    file ``aggregate_2024-01-05.jsonl``. Only lines that hold an object count.
    """
    from py4j.protocol import Py4JJavaError

    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for name in (f"{path}/report_date={date}", f"{path}/aggregate_{date}.jsonl"):
        p = hadoop(name)
        try:
            found = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
        except Py4JJavaError:
            found = False
        if found:
            lines = spark.read.text(name).select(F.trim("value").alias("value")).filter(F.try_parse_json("value").isNotNull() & F.col("value").startswith("{"))
            return lines.select(F.from_json("value", schema).alias("r")).select("r.*", F.lit(date).cast("date").alias("report_date"))
    return None


def append_daily_aggregate(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines, by their ``report_date``."""
    df.write.mode("append").partitionBy("report_date").json(path)


#: The four kinds of timeline entries: source, direction (null: the row's own) and label (null: the row's own). Fixed values.
ENTRY_KINDS = {
    "hub": ("hub_notification", "out", "Sent to hub: "),
    "dispatch": ("notification_dispatch", "out", None),
    "message": ("message", "in", None),
    "api": ("api", None, None),
}


def timeline_entries(rows: DataFrame, kind: str) -> DataFrame:
    """folder, ts, source, direction, label, data (JSON) for ``append_timeline``; rows without a folder have no timeline.

    ``hub``: status, payload (JSON). ``dispatch``: what ``dispatch_log`` gives. ``message``:
    topic, payload (JSON), label. ``api``: direction (in or out), label, payload. A ``ts``
    is kept, else it is null and stamped when the entry is appended.
    """
    source, direction, prefix = ENTRY_KINDS[kind]
    parsed = lambda c: F.coalesce(F.try_parse_json(c), F.parse_json(F.lit("null")))
    text = lambda c: F.coalesce(F.to_json(parsed(c)), F.lit("null"))
    if kind == "dispatch":
        data = F.to_json(F.struct("event_phase", "results"))
    elif kind == "message":
        data = F.concat(F.regexp_replace(F.to_json(F.struct("topic")), "[}]$", ""), F.lit(',"payload":'), text("payload"), F.lit("}"))
    else:
        data = text("payload")
    label = F.concat(F.lit(prefix), F.col("status")) if prefix else F.col("label")
    ts = F.col("ts").cast("string") if "ts" in rows.columns else F.lit(None).cast("string")
    kept = rows.filter(F.coalesce(F.col("folder"), F.lit("")) != "")
    return kept.select("folder", ts.alias("ts"), F.lit(source).alias("source"), (F.lit(direction) if direction else F.col("direction")).alias("direction"), label.alias("label"), data.alias("data"))


def append_timeline(df: DataFrame, path: str, now: str) -> None:
    """Append entries; a missing ``ts`` becomes ``now``. Partitioned by the date in the stamp."""
    rows = df.withColumn("ts", F.coalesce("ts", F.lit(now))).withColumn("date", F.substring("ts", 1, 10))
    rows.write.mode("append").partitionBy("date").json(path)


def write_sidecar_table(df: DataFrame, path: str, date_col: str = "incident_date") -> None:
    df.write.mode("overwrite").partitionBy(date_col).parquet(path)


def report_for_date(files: DataFrame, date: str) -> DataFrame:
    return files.filter(F.col("report_date") == F.lit(date).cast("date"))
