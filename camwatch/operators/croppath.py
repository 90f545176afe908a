"""Crop rectangles along a camera timeline and their smoothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from camwatch.operators.joins import asof_nearest, in_interval
from camwatch.operators.timeline import by_incident

#: Least share of the frame's side that a crop has.
LEAST_ZOOM = 0.4
#: The crops at both ends of a slice.
CROPS = [f"{side}_{c}" for side in ("start", "end") for c in "xywh"]


def entry_boxes(sidecar: DataFrame) -> DataFrame:
    """incident_id, camera, t and per sampled frame: weighted center, union box, number of detections.

    Areas that aren't positive weigh 1. A detection without a whole box counts with its
    center point (px, py) if the sidecar has such columns; with neither it has no weight,
    and a frame without any weight has no center.
    """
    a = F.when(F.col("area") > 0, F.col("area")).otherwise(1).cast("bigint")
    x, y = F.col("x1") + F.col("x2"), F.col("y1") + F.col("y2")
    if "px" in sidecar.columns:
        boxed = x.isNotNull() & y.isNotNull()
        x, y = (F.when(boxed, v).otherwise(F.lit(2.0) * F.col(p)) for v, p in ((x, "px"), (y, "py")))
        a = F.when(x.isNotNull() & y.isNotNull(), a)
    return sidecar.groupBy("incident_id", "camera", "t").agg(
        (F.sum(x * a) / (2.0 * F.sum(a))).alias("cx"), (F.sum(y * a) / (2.0 * F.sum(a))).alias("cy"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("n"),
    )


def content_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, pad: float = 0.1) -> Column:
    """Struct bx1, by1, bx2, by2, area: the box padded on each side (1 pixel at least) and clipped; area 0 if degenerate."""
    px, py = F.greatest((x2 - x1) * pad, F.lit(1.0)), F.greatest((y2 - y1) * pad, F.lit(1.0))
    a, b, c, d = F.greatest(F.lit(0.0), x1 - px), F.greatest(F.lit(0.0), y1 - py), F.least(width.cast("double"), x2 + px), F.least(height.cast("double"), y2 + py)
    return F.struct(a.alias("bx1"), b.alias("by1"), c.alias("bx2"), d.alias("by2"), F.when((c > a) & (d > b), (c - a) * (d - b)).otherwise(0.0).alias("area"))


def entry_crops(sidecar: DataFrame, width: int = 1920, height: int = 1080, target_w: int = 960, target_h: int = 540, percent: int = 40) -> DataFrame:
    """incident_id, camera, t (double) and ``x, y, w, h``: the crop around the weighted center of each sampled frame, as ``crop_at`` holds it."""
    entries = entry_boxes(by_incident(sidecar.filter("incident_id is not null")))
    cx, cy = F.coalesce("cx", F.lit(width / 2.0)), F.coalesce("cy", F.lit(height / 2.0))
    x1, y1, x2, y2 = F.least(F.col("x1"), F.lit(width)), F.least(F.col("y1"), F.lit(height)), F.greatest(F.col("x2"), F.lit(0)), F.greatest(F.col("y2"), F.lit(0))
    area = content_box(x1, y1, x2, y2, F.lit(width), F.lit(height))["area"]
    zoom = F.coalesce((x1 < x2) & (y1 < y2) & (area > 0), F.lit(False)) if percent > 0 else F.lit(False)
    _, _, fixed_w, fixed_h = _fixed_crop(width, height, target_w, target_h)

    def side(fixed: int, full: int, shape: float) -> Column:
        sized = F.greatest(F.lit(max(1, int(full * LEAST_ZOOM))), F.least(F.lit(full), F.sqrt(area / F.lit(percent / 100.0 or 1.0) * F.lit(shape)).cast("int")))
        return F.when(zoom, F.greatest(F.lit(1), sized.bitwiseAND(-2))).otherwise(F.lit(fixed))

    sized = entries.select("incident_id", "camera", F.col("t").cast("double").alias("t"), side(fixed_w, width, target_w / target_h).alias("w"), side(fixed_h, height, target_h / target_w).alias("h"), cx.alias("cx"), cy.alias("cy"))
    return sized.select("incident_id", "camera", "t", into_frame("cx", "w", width).alias("x"), into_frame("cy", "h", height).alias("y"), "w", "h")


def _fixed_crop(width: int, height: int, target_w: int, target_h: int) -> tuple[int, int, int, int]:
    """x, y, w, h of the target size, scaled into smaller frames, in the middle of the frame."""
    scale = min(1.0, width / target_w, height / target_h)
    w, h = int(target_w * scale) // 2 * 2, int(target_h * scale) // 2 * 2
    return max(0, min(int(width / 2.0 - w / 2.0), width - w)), max(0, min(int(height / 2.0 - h / 2.0), height - h)), w, h


def crop_at(slices: DataFrame, sidecar: DataFrame, time: str, width: int = 1920, height: int = 1080, target_w: int = 960, target_h: int = 540, percent: int = 40) -> DataFrame:
    """``x, y, w, h``: the crop around the weighted center of the entry held at ``time``, shifted into the frame, sides even.

    Its size is such that the padded box of all detections fills ``percent`` of it,
    in the target's shape, and from 0.4 to 1 of each side of the frame. It is the
    target size, scaled into smaller frames, if ``percent`` is 0 or the box is empty.
    Without an entry or detections the crop is around the middle of the frame. An
    incident's camera has a bounded number of entries, and is not cut by time.
    """
    entries = entry_crops(sidecar, width, height, target_w, target_h, percent)
    left = slices.withColumn("t", F.col(time).cast("double"))
    held = asof_nearest(left, entries, ["incident_id", "camera"], "t", cell=None)  # an entry's box is made of detections, so none is empty
    fixed = zip("xywh", _fixed_crop(width, height, target_w, target_h), strict=True)
    return held.withColumns({c: F.coalesce(f"entry.{c}", F.lit(v)) for c, v in fixed}).drop("entry", "t")


def _by_incident(slices: DataFrame, sidecar: DataFrame, width: int = 1920, height: int = 1080, target_w: int = 960, target_h: int = 540, percent: int = 40) -> tuple[DataFrame, Column]:
    """Rows by incident, and of these an incident's slices in order as structs of row, s and e, the crops at both ends.

    A crop depends on its entry only, so it is made once for each entry. An incident's
    slices meet its entries, by camera, in one row: an end looks through its camera's,
    of which there are a bounded number, so that no end is a row to be sorted.
    """
    entries = entry_crops(sidecar, width, height, target_w, target_h, percent).filter("camera is not null and t is not null")
    held = entries.groupBy("incident_id", "camera").agg(F.collect_list(F.struct("t", F.struct("x", "y", "w", "h").alias("crop"))).alias("entries"))
    held = held.groupBy("incident_id").agg(F.map_from_entries(F.collect_list(F.struct("camera", "entries"))).alias("held"))
    own = slices.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.struct(*slices.columns).alias("row")))).alias("a"))
    fixed = F.struct(*(F.lit(v).alias(c) for c, v in zip("xywh", _fixed_crop(width, height, target_w, target_h), strict=True)))

    def at(row: Column, time: str) -> Column:
        """The nearest entry's crop, the earlier entry's on ties."""
        t = row[time].cast("double")
        near = F.array_min(F.transform(F.col("held")[row["camera"]], lambda e: F.struct(F.abs(e["t"] - t).alias("away"), e["t"].alias("t"), e["crop"].alias("crop"))))
        return F.coalesce(F.when(t.isNotNull(), near["crop"]), fixed)

    pair = lambda x: F.struct(x["row"].alias("row"), at(x["row"], "start_sec").alias("s"), at(x["row"], "end_sec").alias("e"))
    return own.join(held, "incident_id", "left"), F.transform("a", pair)


def _flat(rows: DataFrame, p: Column) -> DataFrame:
    crops = [F.col(f"z.{k}.{c}").alias(f"{side}_{c}") for k, side in (("s", "start"), ("e", "end")) for c in "xywh"]
    return rows.select(F.explode(p).alias("z")).select("z.row.*", *crops)


def crop_ends(slices: DataFrame, sidecar: DataFrame, **sizes: int) -> DataFrame:
    """Slices (incident_id, idx, camera, start_sec, end_sec, others) with the crop of ``crop_at`` at each end: start_x to end_h. ``idx`` is unique in an incident."""
    return _flat(*_by_incident(slices, sidecar, **sizes))


def quality_join(slices: DataFrame, sidecar: DataFrame) -> DataFrame:
    """``quality`` of each slice: ``no entries`` if its camera has none, ``no detections`` if the entry nearest to its start or end is empty, else ``ok``.

    ``sidecar``: one row a detection, and one with a null label for a sampled frame without any.
    """
    entries = by_incident(sidecar).groupBy("incident_id", "camera", F.col("t").cast("double").alias("t")).agg(F.count("label").alias("n"))
    # start and end ask in one pass
    asks = slices.withColumn("ask", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("start_sec").cast("double").alias("t")), F.struct(F.lit(1).alias("k"), F.col("end_sec").cast("double").alias("t")))))
    asks = asks.select("incident_id", "idx", "camera", "start_sec", "end_sec", F.col("ask.t").alias("t"))
    near = asof_nearest(asks, entries, ["incident_id", "camera"], "t", cell=None)
    state = near.groupBy("incident_id", "idx", "camera", "start_sec", "end_sec").agg(F.bool_and(F.col("entry").isNull()).alias("none"), F.bool_or(F.coalesce(F.col("entry.n") == 0, F.lit(False))).alias("empty"))
    return state.select("incident_id", "idx", "camera", "start_sec", "end_sec", F.when(F.col("none"), "no entries").when(F.col("empty"), "no detections").otherwise("ok").alias("quality"))


def segment_crop(segments: DataFrame, sidecar: DataFrame, width: int, height: int, target_w: int = 1440, target_h: int = 1080) -> DataFrame:
    """``x, y, w, h`` around the weighted center of all detections with ``start_sec <= t < end_sec`` of the segment's camera, else of the frame.

    A target larger than the frame is scaled down with its shape. Detections meet
    segments by key and a cell of time.
    """
    scale = min(width / target_w, height / target_h) if width < target_w or height < target_h else 1.0
    w, h = int(target_w * scale), int(target_h * scale)
    a = F.when(F.col("area") > 0, F.col("area")).otherwise(1).cast("bigint")
    seg = segments.select("incident_id", "seg", "camera", "start_sec", "end_sec")
    # a segment's detections are summed before they meet anything else
    hits = in_interval(sidecar.withColumn("t", F.col("t").cast("double")), seg, ["incident_id", "camera"], "t", "start_sec", "end_sec", 60)
    sums = hits.groupBy("incident_id", "seg").agg((F.sum((F.col("x1") + F.col("x2")) * a) / (2.0 * F.sum(a))).alias("cx"), (F.sum((F.col("y1") + F.col("y2")) * a) / (2.0 * F.sum(a))).alias("cy"))
    rows = segments.join(sums, ["incident_id", "seg"], "left").withColumns({"w": F.lit(w), "h": F.lit(h), "cx": F.coalesce("cx", F.lit(width / 2.0)), "cy": F.coalesce("cy", F.lit(height / 2.0))})
    return rows.withColumns({"x": into_frame("cx", "w", width), "y": into_frame("cy", "h", height)}).drop("cx", "cy")


def into_frame(center: str | Column, size: str, full: int | Column) -> Column:
    """First pixel of a side around its center, shifted into the frame."""
    center, size, full = F.col(center) if isinstance(center, str) else center, F.col(size), full if isinstance(full, Column) else F.lit(full)
    return F.greatest(F.lit(0), F.least((center - size / 2.0).cast("int"), full - size))


def hold_last_of_run(slices: DataFrame) -> DataFrame:
    """The end crop is the start crop on the last slice before a change of camera (not on the final slice)."""
    nxt = F.lead("camera").over(W.partitionBy("incident_id").orderBy("idx"))
    hold = nxt.isNotNull() & (nxt != F.col("camera"))
    return slices.withColumns({f"end_{c}": F.when(hold, F.col(f"start_{c}")).otherwise(F.col(f"end_{c}")) for c in sides(slices)})


def sides(slices: DataFrame) -> list[str]:
    """x, y, and w, h of crops that have a size of their own."""
    return [c for c in "xywh" if f"end_{c}" in slices.columns]


def camera_runs(slices: DataFrame) -> DataFrame:
    w = W.partitionBy("incident_id").orderBy("idx")
    return slices.withColumn("__c", F.coalesce(F.lag("camera").over(w) != F.col("camera"), F.lit(True)).cast("int")).withColumn("run", F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__c")


def smooth_zoom(slices: DataFrame, alpha: float = 0.25, crop: str = "") -> DataFrame:
    """``zoom``: square root of crop over frame area, held to 0.4 to 1, smoothed within each run of a camera from the run's first value.

    ``crop`` is put before the names of w, h and zoom.
    """
    raw = F.greatest(F.lit(LEAST_ZOOM), F.least(F.lit(1.0), F.sqrt(F.col(f"{crop}w") * F.col(f"{crop}h") / (F.col("frame_w") * F.col("frame_h")))))
    g = camera_runs(slices.withColumn("__raw", raw)).groupBy("incident_id", "run").agg(F.array_sort(F.collect_list(F.struct("idx", F.col("__raw").alias("raw"), F.struct(*slices.columns).alias("row")))).alias("p"))
    step = lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x["raw"]).otherwise(F.lit(alpha) * x["raw"] + F.lit(1 - alpha) * F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)))))
    z = g.withColumn("s", F.aggregate("p", F.array().cast("array<double>"), step))
    return z.select(F.explode(F.arrays_zip("p", "s")).alias("z")).select("z.p.row.*", F.col("z.s").alias(f"{crop}zoom"))


def resize(slices: DataFrame, crop: str, target_w: int = 960, target_h: int = 540) -> DataFrame:
    """The crop with the size of its ``zoom``, in the target's shape and with even sides, around the same center."""
    area, shape = F.col(f"{crop}zoom") * F.col(f"{crop}zoom") * (F.col("frame_w") * F.col("frame_h")), target_w / target_h
    size = lambda v, full: F.greatest(F.lit(1), F.greatest(F.lit(1), F.least(F.col(full), F.sqrt(v).cast("int"))).bitwiseAND(-2))
    mid = {f"__{c}": F.col(f"{crop}{c}") + F.col(f"{crop}{d}") / 2.0 for c, d in ("xw", "yh")}
    sized = slices.withColumns(mid).withColumns({f"{crop}w": size(area * F.lit(shape), "frame_w"), f"{crop}h": size(area / F.lit(shape), "frame_h")})
    at = {f"{crop}{c}": into_frame(f"__{c}", f"{crop}{d}", F.col(f"frame_{d}")) for c, d in ("xw", "yh")}
    return sized.withColumns(at).drop("__x", "__y", f"{crop}zoom")


def smooth_centers(slices: DataFrame, alpha: float = 0.3, width: int = 1920, height: int = 1080, crop: str = "") -> DataFrame:
    """``sx, sy``: centers smoothed within each run of a camera, held inside the frame at every step.

    ``crop`` is put before the names of x, y, w, h, sx and sy.
    """
    x, y, w, h = (F.col(f"{crop}{c}") for c in "xywh")
    fields = F.struct("idx", (x + w / 2.0).alias("cx"), (y + h / 2.0).alias("cy"), w.alias("w"), h.alias("h"), F.struct(*slices.columns).alias("row"))
    g = camera_runs(slices).groupBy("incident_id", "run").agg(F.array_sort(F.collect_list(fields)).alias("p"))

    def step(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        mix = lambda new, old: F.when(old.isNull(), new).otherwise(F.lit(alpha) * new + F.lit(1 - alpha) * old)
        hold = lambda v, half, most: F.greatest(half, F.least(F.lit(float(most)) - half, v))
        return F.concat(acc, F.array(F.struct(hold(mix(p["cx"], last["sx"]), p["w"] / 2.0, width).alias("sx"), hold(mix(p["cy"], last["sy"]), p["h"] / 2.0, height).alias("sy"))))

    z = g.withColumn("s", F.aggregate("p", F.array().cast("array<struct<sx:double,sy:double>>"), step))
    return z.select(F.explode(F.arrays_zip("p", "s")).alias("z")).select("z.p.row.*", F.col("z.s.sx").alias(f"{crop}sx"), F.col("z.s.sy").alias(f"{crop}sy"))


def _smoothed(rows: DataFrame, p: Column, width: int, height: int, target_w: int, target_h: int) -> DataFrame:
    """The slices in ``p``, one array for each incident, with their final crops, by one fold in order (``fold_crops``). No crop is null."""
    camera = lambda x: x["row"]["camera"]
    # the end crop is the start crop on the last slice before a change of camera
    held = lambda x, i: F.when(camera(F.get("p", i + 1)) != camera(x), x["s"]).otherwise(x["e"])
    same = lambda x, i: F.coalesce(camera(F.get("p", i - 1)) == camera(x), F.lit(False))
    one = lambda x, i: F.struct(F.struct(x["row"].alias("row"), same(x, i).alias("same")).alias("row"), x["s"].alias("s"), held(x, i).alias("e"))
    flat = _flat(rows.select(p.alias("p")), F.transform("p", one)).select("row.*", "same", *CROPS)
    schema = StructType([f for f in flat.schema.fields if f.name != "same"])
    return flat.mapInArrow(lambda parts: fold_crops(parts, width, height, target_w, target_h), schema)


def fold_crops(parts: Iterator[pa.RecordBatch], width: int, height: int, target_w: int, target_h: int, zoom_alpha: float = 0.25, alpha: float = 0.3) -> Iterator[pa.RecordBatch]:
    """Batches of slices in order with both ends smoothed; ``same``: the slice goes on with the camera of the one before, also over batches.

    What goes on from a slice to the next is, for each end, the zoom and the center. All
    runs of a camera go on at once, a slice of each in a step, and the last slice of a
    batch goes on in the next one.
    """
    area, shape, before = float(width * height), target_w / target_h, None
    for part in parts:
        if not part.num_rows:
            continue
        of = {c: np.stack([part.column(f"{side}_{c}").to_numpy() for side in ("start", "end")]).astype(float) for c in "xywh"}
        same = part.column("same").to_numpy(zero_copy_only=False).astype(bool)
        # a place is that of the slice and 1: at 0 is what the last batch left
        at = np.arange(1, len(same) + 1)
        nth = at - np.maximum.accumulate(np.where(same, 0, at))
        steps = np.split(at[np.argsort(nth, kind="stable")], np.cumsum(np.bincount(nth))[:-1])[1:]

        def going(first: np.ndarray, name: str, step) -> np.ndarray:
            """``first`` where a run begins, elsewhere ``step`` of the places and what the slice before has."""
            v = np.concatenate([before[name] if before else np.zeros((2, 1)), first], axis=1)  # noqa: B023
            for now in steps:  # noqa: B023
                v[:, now] = step(now - 1, v[:, now - 1])
            return v

        raw = np.maximum(LEAST_ZOOM, np.minimum(1.0, np.sqrt(of["w"] * of["h"] / area)))
        kept = {"zoom": going(raw, "zoom", lambda i, old: zoom_alpha * raw[:, i] + (1 - zoom_alpha) * old)}  # noqa: B023
        zoom, out = kept["zoom"][:, 1:], {}
        for x, w, full, v in (("x", "w", width, zoom * zoom * area * shape), ("y", "h", height, zoom * zoom * area / shape)):
            size = np.maximum(1, np.maximum(1, np.minimum(full, np.sqrt(v).astype(int))) & -2)
            half = size / 2.0
            center = np.maximum(0, np.minimum((of[x] + of[w] / 2.0 - half).astype(int), full - size)) + half
            within = lambda c, h, full=full: np.maximum(h, np.minimum(float(full) - h, c))
            kept[x] = going(within(center, half), x, lambda i, old, c=center, h=half, f=within: f(alpha * c[:, i] + (1 - alpha) * old, h[:, i]))
            out[x], out[w] = (kept[x][:, 1:] - half).astype(int), size
        kept = {n: v[:, -1:] for n, v in kept.items()}
        for c, (start, end) in out.items():
            # a slice begins where the one before ended
            last = np.concatenate([before[f"end_{c}"] if before else end[:1], end[:-1]])
            kept[f"end_{c}"] = end[-1:]
            out[c] = np.where(same, last, start), end
        before = kept
        rest = [n for n in part.schema.names if n != "same" and n not in CROPS]
        crops = [pa.array(out[n[-1]][n.startswith("end")], pa.int32()) for n in CROPS]
        yield pa.RecordBatch.from_arrays([*(part.column(n) for n in rest), *crops], names=[*rest, *CROPS])


def crop_path(slices: DataFrame, width: int = 1920, height: int = 1080, target_w: int = 960, target_h: int = 540) -> DataFrame:
    """Slices with start and end crop (start_x to end_h): held at a run's end, zoom and centers smoothed, continuous within a run.

    One fold over an incident's slices in order; ``idx`` is unique in an incident.
    """
    row = F.struct(*(c for c in slices.columns if c not in CROPS))
    crop = lambda side: F.struct(*(F.col(f"{side}_{c}").cast("int").alias(c) for c in "xywh"))
    one = F.struct("idx", F.struct(row.alias("row"), crop("start").alias("s"), crop("end").alias("e")).alias("x"))
    p = slices.groupBy("incident_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda o: o["x"]).alias("p"))
    return _smoothed(p, F.col("p"), width, height, target_w, target_h)


def crop_plan(slices: DataFrame, sidecar: DataFrame, width: int = 1920, height: int = 1080, target_w: int = 960, target_h: int = 540) -> DataFrame:
    """``crop_path`` of ``crop_ends``, with one shuffle by incident for both."""
    sizes = {"width": width, "height": height, "target_w": target_w, "target_h": target_h}
    return _smoothed(*_by_incident(slices, sidecar, **sizes), width, height, target_w, target_h)


def continuity(slices: DataFrame) -> DataFrame:
    """The start crop is the previous slice's end crop if the camera stays."""
    w = W.partitionBy("incident_id").orderBy("idx")
    same = F.coalesce(F.lag("camera").over(w) == F.col("camera"), F.lit(False))
    return slices.withColumns({f"start_{c}": F.when(same, F.lag(f"end_{c}").over(w)).otherwise(F.col(f"start_{c}")) for c in sides(slices)})


def resample_path(slices: DataFrame, fps: int = 20) -> DataFrame:
    """``sample``, ``x``, ``y``: max(1, round half even(duration * fps)) points of each slice, linear from start to end crop; ``w``, ``h`` too if crops have a size (even, 2 at least)."""
    n = F.greatest(F.lit(1), F.bround((F.col("end_sec") - F.col("start_sec")) * fps).cast("int"))
    s = slices.withColumn("n", n).withColumn("sample", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    part = F.when(F.col("n") > 1, F.col("sample") / (F.col("n") - 1)).otherwise(0.0)
    at = lambda c: (F.col(f"start_{c}") + (F.col(f"end_{c}") - F.col(f"start_{c}")) * part).cast("int").bitwiseAND(-2)
    return s.select("incident_id", "idx", "camera", "sample", *(at(c).alias(c) if c in "xy" else F.greatest(F.lit(2), at(c)).alias(c) for c in sides(slices)))


def framing_mode(entries: DataFrame, share: float = 0.4) -> DataFrame:
    """incident_id, camera, t, mode: center without a person, full if the largest fills ``share`` of the frame, else around it.

    ``entries`` has a row for each detection with label, area, frame_area.
    """
    person = F.lower("label").isin("person", "people", "pedestrian")
    g = entries.groupBy("incident_id", "camera", "t").agg(F.max(F.when(person, F.col("area"))).alias("largest"), F.max("frame_area").alias("frame_area"))
    return g.select("incident_id", "camera", "t", F.when(F.col("largest").isNull(), "center").when(F.col("largest") >= F.col("frame_area") * share, "full").otherwise("person").alias("mode"), F.coalesce("largest", F.lit(0)).cast("bigint").alias("largest"))


def coverage_report(slices: DataFrame) -> DataFrame:
    """Per camera: bad slices (``bad``), and the first and last of them."""
    bad = F.col("bad")
    order = F.struct("incident_id", "idx")
    return slices.groupBy("camera").agg(F.count_if(bad).alias("n_bad"), F.min_by("start_sec", F.when(bad, order)).alias("first_start"), F.max_by("end_sec", F.when(bad, order)).alias("last_end"))
