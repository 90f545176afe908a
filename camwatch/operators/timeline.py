"""The best-camera timeline of an incident: grid, areas, smoothing, hysteresis, runs, segments.

An incident has at most ``cap`` points (45 by default) for each camera, so folding
over an incident's points in an array is bounded; everything else is joins and windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from camwatch.functions.scalars import is_preferred_label


def dense_grid(ends: DataFrame, step: float = 2.0, cap: int = 45, end: str = "end_sec") -> DataFrame:
    """Points idx, t = 0, step, ... up to ``end``; at most ``cap``, none if the step or the end isn't positive."""
    if step <= 0:
        return ends.withColumns({"idx": F.lit(0), "t": F.lit(0.0)}).filter("false")
    n = F.least(F.floor(F.col(end) / step).cast("int"), F.lit(max(1, cap) - 1))
    return ends.filter(F.col(end) > 0).withColumn("idx", F.explode(F.sequence(F.lit(0), n))).withColumn("t", F.col("idx") * F.lit(float(step)))


def by_incident(rows: DataFrame) -> DataFrame:
    """Whole incidents in each task: what follows by incident, camera and point needs no shuffle."""
    return rows.repartition("incident_id")


def person_area(sidecar: DataFrame) -> DataFrame:
    """incident_id, camera, t, area: the sum over person labels of each sampled frame; frames without any have 0."""
    return sidecar.groupBy("incident_id", "camera", "t").agg(F.sum(F.when(is_preferred_label(F.col("label")), F.col("area")).otherwise(0)).alias("area"))


def content_duration(sidecar: DataFrame) -> DataFrame:
    return sidecar.groupBy("incident_id").agg(F.max("t").alias("end_sec"))


def area_curves(entries: DataFrame, step: float = 2.0, cap: int = 45) -> DataFrame:
    """incident_id, camera, idx, t, area: the nearest entry's area at every grid point of every camera of the incident, the earlier entry's on ties.

    No join: by one sort of the entries each gets the last point that it is nearest to,
    and gives the points from the one after its predecessor's. Where incidents are whole
    in their tasks (``by_incident`` of the sidecar) nothing is shuffled.
    """
    if step <= 0:
        return entries.select("incident_id", "camera", F.lit(0).alias("idx"), F.lit(0.0).alias("t"), "area").filter("false")
    w = W.partitionBy("incident_id", "camera").orderBy("t")
    rows = entries.withColumn("t", F.col("t").cast("double")).filter("incident_id is not null")
    rows = rows.withColumns({"__next": F.lead("t").over(w), "__end": F.max("t").over(W.partitionBy("incident_id"))})
    # the last point k with k * step - t <= next - k * step
    k, point, n = F.floor((F.col("t") + F.col("__next")) / F.lit(2.0 * step)), F.lit(float(step)), F.least(F.floor(F.col("__end") / step), F.lit(max(1, cap) - 1))
    rows = rows.withColumn("__k", k).withColumn("__n", n)
    off = lambda k: k * point - F.col("t") > F.col("__next") - k * point
    upto = F.col("__k") + F.when(off(F.col("__k")), F.lit(-1)).when(off(F.col("__k") + 1), F.lit(0)).otherwise(F.lit(1))
    rows = rows.withColumn("__upto", F.greatest(F.lit(-1), upto))
    # a window between keeps the plan from writing that out wherever it is used
    rows = rows.withColumn("__first", F.coalesce(F.lag("__upto").over(w) + 1, F.lit(0)))
    rows = rows.filter("__end > 0 and (t is not null or __next is null)").withColumn("__upto", F.when(F.col("__next").isNull(), F.col("__n")).otherwise(F.least("__upto", "__n")))
    rows = rows.withColumn("points", F.when(F.col("__first") <= F.col("__upto"), F.sequence(F.col("__first").cast("int"), F.col("__upto").cast("int"))))
    known = F.when(F.col("camera").isNotNull() & F.col("t").isNotNull(), F.col("area"))
    points = rows.select("incident_id", "camera", known.alias("area"), F.explode("points").alias("idx"))
    return points.select("incident_id", "camera", "idx", (F.col("idx") * point).alias("t"), "area")


def share_of_frame(curves: DataFrame, sizes: DataFrame) -> DataFrame:
    """``area`` as a share of its camera's frame in incidents whose cameras have frames of different sizes; elsewhere as it is.

    ``sizes``: incident_id, camera, native_width, native_height. A camera whose size
    isn't known, or not positive, differs from those that have one, and keeps its area in
    pixels.
    """
    w, h = (F.coalesce(F.col(f"native_{c}"), F.lit(0)).cast("bigint") for c in ("width", "height"))
    cams = curves.select("incident_id", "camera").distinct().join(sizes.select("incident_id", "camera", "native_width", "native_height"), ["incident_id", "camera"], "left")
    known = cams.select("incident_id", "camera", F.struct(w, h).alias("__size"), F.when((w > 0) & (h > 0), w * h).alias("__px"))
    mixed = known.groupBy("incident_id").agg((F.min("__size") != F.max("__size")).alias("__mixed"))
    j = curves.join(known.drop("__size"), ["incident_id", "camera"], "left").join(mixed, "incident_id", "left")
    share = F.when(F.col("__mixed") & F.col("__px").isNotNull(), F.col("area") / F.col("__px")).otherwise(F.col("area").cast("double"))
    return j.withColumn("area", share).drop("__px", "__mixed")


def ema_array(values: Column, alpha: float = 0.4) -> Column:
    """Running s = alpha * x + (1 - alpha) * s from s = 0, as an array."""
    fold = F.aggregate(values, F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.lit(alpha) * x + F.lit(1 - alpha) * F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)))))
    return fold


def ema(curves: DataFrame, alpha: float = 0.4) -> DataFrame:
    """``score`` of each point of each camera, smoothed from 0."""
    g = curves.groupBy("incident_id", "camera").agg(F.array_sort(F.collect_list(F.struct("idx", "t", "area"))).alias("p"))  # at most `cap` points
    g = g.withColumn("s", ema_array(F.transform("p", lambda x: x["area"].cast("double")), alpha))
    return g.select("incident_id", "camera", F.explode(F.arrays_zip("p", "s")).alias("z")).select("incident_id", "camera", F.col("z.p.idx").alias("idx"), F.col("z.p.t").alias("t"), F.col("z.s").alias("score"))


def best_camera(scores: DataFrame, primary: Column, bias: float = 1.2) -> DataFrame:
    """incident_id, idx, t, scores (of all cameras, biased), best: the highest, on ties the first name."""
    s = scores.withColumn("score", F.when(primary == F.col("camera"), F.col("score") * bias).otherwise(F.col("score")))
    return s.groupBy("incident_id", "idx", "t").agg(
        F.array_sort(F.collect_list(F.struct("camera", "score"))).alias("scores"), F.min_by("camera", F.struct(-F.col("score"), "camera")).alias("best")
    )


def hysteresis(points: DataFrame, margin: float = 1.15) -> DataFrame:
    """incident_id, idx, t, camera: stays on a camera until another's score is at least ``margin`` times its own."""
    g = points.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("idx", "t", "best", "scores"))).alias("p"))
    entry = "array<struct<idx:int,t:double,camera:string>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))["camera"]
        of = lambda camera: F.get(F.filter(x["scores"], lambda s: s["camera"] == camera), 0)["score"]
        stay = last.isNotNull() & (of(x["best"]) < of(last) * margin)
        return F.concat(acc, F.array(F.struct(x["idx"].alias("idx"), x["t"].alias("t"), F.when(stay, last).otherwise(x["best"]).alias("camera"))))

    return g.select("incident_id", F.explode(F.aggregate("p", F.array().cast(entry), step)).alias("z")).select("incident_id", "z.*")


def runs(points: DataFrame) -> DataFrame:
    """``run``: number of the run of equal cameras, from 1."""
    w = W.partitionBy("incident_id").orderBy("idx")
    change = F.coalesce(F.lag("camera").over(w) != F.col("camera"), F.lit(True)).cast("int")
    return points.withColumn("__c", change).withColumn("run", F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__c")


def merge_short_runs(points: DataFrame, least: int = 5) -> DataFrame:
    """Runs shorter than ``least`` points take the previous run's camera as it was; a short first run the next one's."""
    w = W.partitionBy("incident_id").orderBy("idx")
    r = runs(points.withColumns({"__before": F.lag("camera").over(w), "__after": F.lead("camera").over(w)}))
    # all of a run has its first point's camera, what comes before its first and after its last point
    run = W.partitionBy("incident_id", "run").orderBy("idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    near = F.coalesce(F.first("__before").over(run), F.last("__after").over(run), "camera")
    merged = F.when(F.count("*").over(run) >= least, F.col("camera")).otherwise(near)
    return r.filter("incident_id is not null").select("incident_id", "idx", "t", merged.alias("camera"))


def points_to_segments(points: DataFrame, ends: DataFrame) -> DataFrame:
    """incident_id, seg, camera, start_sec, end_sec: runs up to the next start; the last up to the end, or one step on if that is 0."""
    r = runs(points)
    first = points.groupBy("incident_id").agg(F.min(F.when(F.col("idx") == 1, F.col("t"))).alias("one"), F.min("t").alias("zero"))
    s = r.groupBy("incident_id", F.col("run").alias("seg")).agg(F.first("camera").alias("camera"), F.min("t").alias("start_sec"), F.max("t").alias("last"))
    w = W.partitionBy("incident_id").orderBy("seg")
    s = s.withColumn("nxt", F.lead("start_sec").over(w)).join(ends, "incident_id").join(first, "incident_id")
    tail = F.when(F.col("end_sec") > 0, F.col("end_sec")).otherwise(F.col("last") + F.coalesce(F.col("one") - F.col("zero"), F.lit(1.0)))
    return s.select("incident_id", "seg", "camera", "start_sec", F.coalesce("nxt", tail).alias("end_sec"))


def points_to_slices(points: DataFrame, ends: DataFrame) -> DataFrame:
    """One slice for each point, up to the next point or the end."""
    w = W.partitionBy("incident_id").orderBy("idx")
    return points.join(ends, "incident_id").withColumn("slice_end", F.coalesce(F.lead("t").over(w), "end_sec")).select("incident_id", "idx", "camera", F.col("t").alias("start_sec"), F.col("slice_end").alias("end_sec"))


def action_window(entries: DataFrame, ends: DataFrame, pad: float = 3.0, area: str = "area") -> DataFrame:
    """incident_id, from_sec, to_sec: first to last detection of any camera, padded and clipped; without any, all of it."""
    hit = F.when(F.col(area) > 0, F.col("t"))
    g = entries.groupBy("incident_id").agg(F.min(hit).alias("a"), F.max(hit).alias("b")).join(ends, "incident_id")
    return g.select("incident_id", *_window(pad))


def _window(pad: float) -> list[Column]:
    """``from_sec`` and ``to_sec`` of the first and last detection a and b, and end_sec."""
    a, b = F.greatest(F.lit(0.0), F.col("a") - pad), F.least(F.col("end_sec"), F.col("b") + pad)
    return [F.coalesce(a, F.lit(0.0)).alias("from_sec"), F.coalesce(b, "end_sec").alias("to_sec")]


def slices_in_action(points: DataFrame, entries: DataFrame, pad: float = 3.0) -> DataFrame:
    """``points_to_slices`` trimmed to the ``action_window``, where incidents end with their last entry: one row for each incident holds both, from one reading of the entries."""
    hit = F.when(F.col("area") > 0, F.col("t"))
    spans = entries.groupBy("incident_id").agg(F.min(hit).alias("a"), F.max(hit).alias("b"), F.max("t").cast("double").alias("end_sec")).select("incident_id", "end_sec", *_window(pad))
    w = W.partitionBy("incident_id").orderBy("idx")
    j = points.join(spans, "incident_id").withColumn("slice_end", F.coalesce(F.lead("t").over(w), "end_sec")).filter("slice_end > from_sec and t < to_sec")
    return j.select("incident_id", "idx", "camera", F.greatest("t", "from_sec").alias("start_sec"), F.least("slice_end", "to_sec").alias("end_sec"))


def trim_to_action(slices: DataFrame, windows: DataFrame) -> DataFrame:
    j = slices.join(windows, "incident_id").filter("end_sec > from_sec and start_sec < to_sec")
    return j.withColumns({"start_sec": F.greatest("start_sec", "from_sec"), "end_sec": F.least("end_sec", "to_sec")}).drop("from_sec", "to_sec")


def hooked_curves(entries: DataFrame, area_fn: str, step: float = 2.0, cap: int = 45) -> DataFrame:
    """``area_curves`` by a table function that the user has registered under the name ``area_fn``.

    It is joined laterally, once for each camera of an incident, gets (incident_id,
    camera, end_sec, entries: its sampled frames as array<struct<t: double, area: bigint>>
    by time) and gives rows (t double, area bigint). Areas count at grid points; at one
    without a row the area is 0, of several rows the largest counts.

    What a table function gives has lost its partitioning, so its rows are shuffled once
    more by incident, with one row for each camera that becomes its grid behind the
    shuffle. A point is its number, so no row looks for its time.
    """
    if step <= 0:
        return area_curves(entries, step, cap)
    frame = F.struct(F.col("t").cast("double").alias("t"), F.col("area").cast("bigint").alias("area"))
    cams = entries.filter("incident_id is not null").groupBy("incident_id", "camera").agg(F.array_sort(F.collect_list(frame)).alias("entries"))
    # the end is read from the frames: plans that need no areas would shuffle the detections another time
    cams = cams.withColumn("end_sec", F.max(F.array_max(F.transform("entries", lambda e: e["t"]))).over(W.partitionBy("incident_id")))
    known = cams.sparkSession.sql(f"select c.incident_id, c.camera, f.t, f.area from {{cams}} c, lateral {area_fn}(c.incident_id, c.camera, c.end_sec, c.entries) f", cams=cams)
    k, point = F.round(F.col("t") / F.lit(float(step))), F.lit(float(step))
    known = known.filter((F.col("t") == k * point) & k.between(0, max(1, cap) - 1)).select("incident_id", "camera", k.cast("int").alias("idx"), "area")
    last = F.least(F.floor(F.col("end_sec") / step).cast("int"), F.lit(max(1, cap) - 1))
    grids = cams.filter("end_sec > 0").select("incident_id", "camera", last.alias("last"))
    both = by_incident(known.filter("camera is not null").unionByName(grids, allowMissingColumns=True))
    points = both.withColumn("idx", F.explode(F.when(F.col("last").isNull(), F.array("idx")).otherwise(F.sequence(F.lit(0), "last"))))
    points = points.groupBy("incident_id", "camera", "idx").agg(F.max("area").alias("area"), F.max("last").alias("last")).filter("last is not null")
    return points.select("incident_id", "camera", "idx", (F.col("idx") * point).alias("t"), F.coalesce("area", F.lit(0)).alias("area"))


def camera_timeline(sidecar: DataFrame, primary: str = "cam_0", step: float = 2.0, cap: int = 45, least: int = 5, area_fn: str | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """The whole plan: slices of the best camera, trimmed to the action.

    With ``area_fn``, the name of a table function, areas come from it
    (``hooked_curves``); with ``sizes`` cameras of different sizes are compared by shares
    of their frames (``share_of_frame``).
    """
    # said here, the filter is the same wherever entries are read: then they are shuffled once for all
    entries = person_area(by_incident(sidecar.filter("incident_id is not null")))
    curves = hooked_curves(entries, area_fn, step, cap) if area_fn else area_curves(entries, step, cap)
    scores = ema(curves if sizes is None else share_of_frame(curves, sizes))
    points = merge_short_runs(hysteresis(best_camera(scores, F.lit(primary))), least)
    return slices_in_action(points, entries)


def min_gap_sample(times: DataFrame, by: str, time: str, step: float, most: int) -> DataFrame:
    """Greedy: keeps a time if it is at least ``step`` after the last kept, up to ``most`` for each key.

    A fold over a key's times, which are the frames of one event (a ring of 500).
    """
    fold = F.aggregate(
        F.array_sort(F.collect_set(F.col(time).cast("double"))), F.array().cast("array<double>"),
        lambda acc, x: F.when((F.size(acc) < most) & (F.size(acc).eqNullSafe(0) | (x - F.coalesce(F.try_element_at(acc, F.lit(-1)), x) >= step)), F.concat(acc, F.array(x))).otherwise(acc),
    )
    return times.groupBy(by).agg(fold.alias("kept")).select(by, F.explode("kept").alias(time))


def cap_frames(frames: DataFrame, most: int = 45) -> DataFrame:
    w = W.partitionBy("incident_id").orderBy("t", "camera")
    return frames.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def frame_manifest(frames: DataFrame) -> DataFrame:
    """``seq`` and ``total`` count all frames of the incident; frames without an image are then left out."""
    w = W.partitionBy("incident_id").orderBy("t", "camera")
    f = frames.withColumns({"seq": F.row_number().over(w), "total": F.count("*").over(W.partitionBy("incident_id"))})
    return f.filter("has_image").withColumn("file", F.format_string("frame_%03d_%s.jpg", "seq", "camera"))
