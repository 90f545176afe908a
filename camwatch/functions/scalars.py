"""Column functions of the event domain. Nothing here raises on bad input: what can't be parsed is null or a stated default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the threat levels 0 to 2. Fixed values.
THREATS = ("Normal", "Suspicious", "Critical")
#: Texts that say that nothing is the matter. Fixed values.
NO_CONCERNS = ("no concerns were found during this time period", "no concerns were found", "no concerns")
#: Labels that stand for a person. Fixed values.
PERSON_LABELS = ("person", "people", "pedestrian")
CANCELED_SUFFIX = "-canceled"
RESERVED_DIRS = ("events", "daily_reports", "daily_reviews", "saved", "ultralytics")


def first_truthy(*cols: Column) -> Column:
    """The first that is neither null nor an empty string."""
    return F.coalesce(*(F.when(c != "", c) for c in cols))


def sanitize_camera(name: Column) -> Column:
    clean = F.regexp_replace(F.translate(F.lower(name), " ", "_"), "[^a-z0-9_]", "")
    return F.coalesce(F.when(clean != "", clean), F.lit("unknown"))


def normalize_sub_label(value: Column) -> Column:
    """Name from JSON: a string, or the first element of an array; trimmed, empty as null."""
    text = F.when(value.startswith("["), F.get_json_object(value, "$[0]")).when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v"))
    return F.when(F.trim(text) != "", F.trim(text))


def normalize_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Struct ymin, xmin, ymax, xmax in 0 to 1, or null if nothing of the box is left.

    Corners are ordered. With a width and height the box is in their pixels; without,
    coordinates over 1 are pixels of a 1920 x 1080 frame.
    """
    sized = (width > 0) & (height > 0)
    pixels = F.greatest(x1, y1, x2, y2) > 1
    w = F.when(sized, width.cast("double")).when(pixels, 1920.0).otherwise(1.0)
    h = F.when(sized, height.cast("double")).when(pixels, 1080.0).otherwise(1.0)
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    ymin, xmin, ymax, xmax = clamp(F.least(y1, y2) / h), clamp(F.least(x1, x2) / w), clamp(F.greatest(y1, y2) / h), clamp(F.greatest(x1, x2) / w)
    return F.when((ymax > ymin) & (xmax > xmin), F.struct(ymin.alias("ymin"), xmin.alias("xmin"), ymax.alias("ymax"), xmax.alias("xmax")))


def folder_ts(name: Column) -> Column:
    """Epoch seconds before the first underscore, null if that isn't a number."""
    return F.when(name.contains("_"), F.substring_index(name, "_", 1).try_cast("bigint"))


def folder_id(name: Column) -> Column:
    return F.when(name.contains("_"), F.substr(name, F.instr(name, "_") + F.lit(1)))


def strip_canceled(name: Column) -> Column:
    return F.regexp_replace(name, f"{CANCELED_SUFFIX}$", "")


def cancel_name(name: Column) -> Column:
    return F.when(name.endswith(CANCELED_SUFFIX), name).otherwise(F.concat(name, F.lit(CANCELED_SUFFIX)))


def summary_field(text: Column, key: str) -> Column:
    """Value of the last ``key: value`` line with that key."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains(":") & (F.trim(F.substring_index(x, ":", 1)) == key))
    last = F.try_element_at(lines, F.lit(-1))
    return F.trim(F.substr(last, F.instr(last, ":") + F.lit(1)))


def parse_summary(text: Column) -> Column:
    """Map of all ``key: value`` lines; the last value of a key counts."""
    pairs = F.transform(F.filter(F.split(text, "\n"), lambda x: x.contains(":")), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substr(x, F.instr(x, ":") + F.lit(1))).alias("value")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"].alias("value"))))


def format_size(size: Column) -> Column:
    mb, gb = 1 << 20, 1 << 30
    show = lambda d, unit: F.concat(F.format_string("%.2f", size / F.lit(float(d))), F.lit(f" {unit}"))
    return F.when(F.coalesce(size, F.lit(0)) <= 0, F.lit("0 KB")).when(size < mb, show(1024, "KB")).when(size < gb, show(mb, "MB")).otherwise(show(gb, "GB"))


def display_name(name: Column) -> Column:
    return F.initcap(F.translate(name, "_", " "))


def default_title(label: Column, camera: Column) -> Column:
    return F.concat(F.initcap(label), F.lit(" detected at "), display_name(camera))


def notification_message(status: Column, default: Column, ai_title: Column, description: Column, review: Column, clip: Column) -> Column:
    """Body of a notification by status; ``description`` is the best one there is, empty counts as none."""
    lines = F.filter(F.transform(F.split(review, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    excerpt = F.coalesce(F.get(lines, 0), F.lit("Review summary available"))
    cut = F.concat(F.substring(excerpt, 1, 200), F.when(F.length(excerpt) > 200, "...").otherwise(""))
    best = first_truthy(description, default)
    return (
        F.when((status == "summarized") & (review != ""), cut)
        .when(status == "clip_ready", F.concat(F.when(clip, "Video available. ").otherwise("Video unavailable. "), best))
        .when(status == "finalized", first_truthy(description, F.concat(F.lit("Event complete: "), default)))
        .when(status == "described", first_truthy(ai_title, F.concat(default, F.lit(" (details updating)"))))
        .otherwise(best)
    )


def strip_code_fence(text: Column) -> Column:
    """Without a first line that opens a code fence and a last line that closes one, trimmed."""
    t = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    inner = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n", ""), r"\n?[ \t]*```[ \t]*$", "")
    return F.regexp_replace(F.when(t.startswith("```"), inner).otherwise(t), r"^\s+|\s+$", "")


def response_text(body: Column) -> Column:
    """First text part of the candidates, else the first choice's message; blank as null."""
    found = F.coalesce(F.get_json_object(body, "$.candidates[0].content.parts[0].text"), F.get_json_object(body, "$.choices[0].message.content"))
    return F.when(F.trim(found) != "", found)


def parse_analysis(body: Column) -> Column:
    """Struct title, scene, summary, confidence, threat from a JSON object (fences allowed); null if it isn't one."""
    t = strip_code_fence(body)
    get = lambda k: F.get_json_object(t, f"$.{k}")
    ok = t.startswith("{") & F.try_parse_json(t).isNotNull()
    return F.when(
        ok,
        F.struct(
            get("title").alias("title"), get("scene").alias("scene"), first_truthy(get("shortSummary"), get("description")).alias("summary"),
            get("confidence").try_cast("double").alias("confidence"), F.coalesce(get("potential_threat_level").try_cast("int"), F.lit(0)).alias("threat"),
        ),
    )


def quick_title(title: Column, description: Column) -> Column:
    """Struct title (500 characters) and description (1000); null without a title."""
    return F.when(F.trim(title) != "", F.struct(F.substring(F.trim(title), 1, 500).alias("title"), F.substring(F.trim(F.coalesce(description, F.lit(""))), 1, 1000).alias("description")))


def display_datetime(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd hh:mm:ss a")


def display_time(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "hh:mm a")


def format_duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("bigint")
    h, m, r = F.expr("0"), None, None
    h, m, r = F.floor(s / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string"), (s % 60).cast("string")
    return (
        F.when(seconds.isNull() | (seconds < 0), "—")
        .when(s >= 3600, F.concat(h, F.lit("h "), m, F.lit("m "), r, F.lit("s")))
        .when(s >= 60, F.concat(m, F.lit("m "), r, F.lit("s")))
        .otherwise(F.concat(r, F.lit("s")))
    )


def threat_name(level: Column) -> Column:
    return F.when(level == 0, THREATS[0]).when(level == 1, THREATS[1]).when(level == 2, THREATS[2]).otherwise("Unknown")


def event_title(meta: Column, parsed: Column) -> Column:
    """Title from the metadata (JSON), else of the parsed summary (a map). Only the metadata's empty text gives way."""
    return F.coalesce(first_truthy(F.get_json_object(meta, "$.genai_title")), parsed["Title"])


def event_description(meta: Column, parsed: Column) -> Column:
    return F.coalesce(first_truthy(F.get_json_object(meta, "$.genai_description"), parsed["Description"]), parsed["AI Description"])


def event_label(meta: Column, parsed: Column) -> Column:
    return F.coalesce(first_truthy(F.get_json_object(meta, "$.label")), parsed["Label"], F.lit("unknown"))


def is_critical(level: Column) -> Column:
    return F.coalesce(level, F.lit(0)) >= 2


def push_priority(status: Column, threat: Column) -> Column:
    return F.when(status == "snapshot_ready", F.when(threat >= 2, 1).otherwise(0)).otherwise(-1)


def clip_url(folder: Column, camera: Column, file: Column) -> Column:
    return F.when(file.isNotNull(), F.concat(F.lit("/files/events/"), folder, F.lit("/"), camera, F.lit("/"), file))


def media_urls(folder: Column, cameras: Column, video: Column) -> Column:
    """Struct hosted_clip, hosted_snapshot, hosted_clips (array of camera, url), has_clip, has_snapshot.

    ``cameras`` is an array of structs camera, clip (file or null), snapshot (boolean);
    ``video``: the folder holds a summary video, which then comes last and is the
    primary clip. Without any snapshot the first camera's place for one is given.
    """
    base = F.concat(F.lit("/files/events/"), folder, F.lit("/"))
    cams = F.array_sort(cameras)
    clips = F.transform(F.filter(cams, lambda c: c["clip"].isNotNull()), lambda c: F.struct(c["camera"].alias("camera"), F.concat(base, c["camera"], F.lit("/"), c["clip"]).alias("url")))
    summary = F.concat(base, folder, F.lit("_summary.mp4"))
    every = F.when(video, F.concat(clips, F.array(F.struct(F.lit("Summary video").alias("camera"), summary.alias("url"))))).otherwise(clips)
    shot = F.filter(cams, lambda c: c["snapshot"])
    return F.struct(
        F.when(video, summary).otherwise(F.get(clips, 0)["url"]).alias("hosted_clip"), F.concat(base, F.coalesce(F.get(shot, 0)["camera"], F.get(cams, 0)["camera"]), F.lit("/snapshot.jpg")).alias("hosted_snapshot"),
        every.alias("hosted_clips"), (F.size(every) > 0).alias("has_clip"), (F.size(shot) > 0).alias("has_snapshot"),
    )


def player_url(base: str, folder: Column, camera: Column, event_id: Column) -> Column:
    prefix = F.lit(f"{base.rstrip('/')}/player" if base else "/player")
    cam = first_truthy(camera, F.lit("unknown"))
    return (
        F.when(folder != "", F.concat(prefix, F.lit("?camera=events&subdir="), folder))
        .when(event_id != "", F.concat(prefix, F.lit("?camera="), cam, F.lit("&subdir="), event_id))
        .otherwise(F.concat(prefix, F.lit("?camera="), cam))
    )


def incident_id_from_tag(tag: Column, prefix: str = "incident_") -> Column:
    return F.regexp_replace(tag, f"^{prefix}", "")


def deep_link(incident: Column, scheme: str = "buffer") -> Column:
    return F.concat(F.lit(f"{scheme}://event_detail/"), incident)


def fill_template(template: Column, **values: Column) -> Column:
    """Replace ``{name}`` by its value, one name after the other in the given order."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def redact_url(url: Column) -> Column:
    """The password of ``scheme://user:password@host`` as three stars."""
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/@:]*):[^/@]*@", "$1:***@")


def detection_geometry(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Struct cx, cy and the integer area of a box."""
    return F.struct(((x1 + x2) / 2.0).alias("cx"), ((y1 + y2) / 2.0).alias("cy"), ((x2 - x1) * (y2 - y1)).cast("bigint").alias("area"))


def scale_factor(native: Column, read: Column) -> Column:
    """What detections on the read size are multiplied by; 1 if a size isn't positive."""
    return F.when((native > 0) & (read > 0), native / read).otherwise(1.0)


def scale_detections(x1: Column, y1: Column, x2: Column, y2: Column, cx: Column, cy: Column, area: Column, read: tuple[Column, Column], native: tuple[Column, Column]) -> Column:
    """Struct x1, y1, x2, y2, cx, cy and the integer area on the native frame; unchanged if any size isn't positive."""
    ok = (read[0] > 0) & (read[1] > 0) & (native[0] > 0) & (native[1] > 0)
    by = [F.when(ok, n / r).otherwise(F.lit(1.0)) for r, n in zip(read, native, strict=True)]
    sides = {"x1": x1 * by[0], "y1": y1 * by[1], "x2": x2 * by[0], "y2": y2 * by[1], "cx": cx * by[0], "cy": cy * by[1]}
    return F.struct(*(c.alias(k) for k, c in sides.items()), F.coalesce((area * (by[0] * by[1])).cast("bigint"), F.lit(0)).alias("area"))


def crop_rect_around(cx: Column, cy: Column, width: Column, height: Column, target_w: Column, target_h: Column) -> Column:
    """Struct x, y, w, h: the target size around the center, shifted into the frame; no larger than the frame."""
    w, h = F.least(target_w, width).cast("int"), F.least(target_h, height).cast("int")
    x = F.greatest(F.lit(0), F.least((cx - w / 2.0).cast("int"), (width - w).cast("int")))
    y = F.greatest(F.lit(0), F.least((cy - h / 2.0).cast("int"), (height - h).cast("int")))
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def center_rect(width: Column, height: Column, target_w: Column, target_h: Column) -> Column:
    return crop_rect_around(width / 2.0, height / 2.0, width, height, target_w, target_h)


def padded_rect(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, share: float = 0.1) -> Column:
    """Struct x1, y1, x2, y2: the box padded by a share of its side (1 pixel at least), clipped; the frame if nothing is left."""
    px, py = F.greatest((x2 - x1) * share, F.lit(1.0)), F.greatest((y2 - y1) * share, F.lit(1.0))
    a, b = F.greatest(F.lit(0.0), x1 - px).cast("int"), F.greatest(F.lit(0.0), y1 - py).cast("int")
    c, d = F.least(width.cast("double"), x2 + px).cast("int"), F.least(height.cast("double"), y2 + py).cast("int")
    ok = (c > a) & (d > b)
    pick = lambda v, o: F.when(ok, v).otherwise(o.cast("int"))
    return F.struct(pick(a, F.lit(0)).alias("x1"), pick(b, F.lit(0)).alias("y1"), pick(c, width).alias("x2"), pick(d, height).alias("y2"))


def safe_relative_path(path: Column) -> Column:
    """Whether the path stays strictly below its root: depth by segments, never above, and below at the end."""
    step = lambda s, x: F.when((x == "") | (x == "."), s).when(s < 0, s).when(x == "..", s - 1).otherwise(s + 1)
    return F.coalesce((F.aggregate(F.split(path, "/"), F.lit(0), step) > 0) & ~path.startswith("/"), F.lit(False))


def coerce_bool(value: Column, default: bool = False) -> Column:
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("false", "0", "no", "off", ""), False).when(v.isin("true", "1", "yes", "on"), True).otherwise(F.lit(default))


def is_no_concerns(text: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    found = F.lit(False)
    for p in NO_CONCERNS:
        found = found | t.contains(p)
    return found


def is_boilerplate(title: Column, summary: Column, scene: Column) -> Column:
    t, s, c = (F.coalesce(x, F.lit("")) for x in (title, summary, scene))
    all_ = F.lower(F.concat_ws(" ", t, s, c))
    return (all_.contains("no concerns") | all_.contains("no activity")) & (t == "") & (c == "") & (F.length(s) < 80)


def is_preferred_label(label: Column) -> Column:
    return F.coalesce(F.lower(label).isin(*PERSON_LABELS), F.lit(False))


def is_incident_folder(name: Column) -> Column:
    return name.rlike(r"^\d+_.+")


def is_test_run(name: Column) -> Column:
    return name.rlike(r"^test\d+$")


def is_camera_dir(name: Column) -> Column:
    return ~(name.rlike(r"^\d+_") | name.isin(*RESERVED_DIRS))
