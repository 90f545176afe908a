"""Joins: as-of, interval, temporal suppression, prioritised matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Width of the cells of time that long keys are cut into, in the time column's unit.
CELL = 3600


def nearest_rows(left: DataFrame, right: DataFrame, by: list[str], time: str, kinds: dict[str, Column], cell: float | None = CELL, ahead: bool = True) -> DataFrame:
    """``left`` with a struct (``rt`` and the other columns) for each kind: the nearest right row of that kind, the earlier on ties.

    ``kinds`` maps a result's name to a condition on right rows. One shuffle of the
    union by key and cell of time, so that a long key is no one task: in its cell each
    left row takes the last right row at or before it and the first at or after it, both
    by windows that look back. One row for each key and cell carries the last right row
    of earlier cells, and the first of later ones, into cells that have none. Of right
    rows that tie on key and time the least in the order of their columns counts. Rows
    without a time, or with a null key, match nothing. With ``ahead`` off only rows at or
    before a left row's time count. Without a cell a key is not cut: for keys whose rows
    are bounded, such as an incident's camera. Then each right row brings the one after
    it, and one row for each key the first, so that left rows are sorted once.
    """
    rest = [c for c in right.columns if c not in (*by, time)]
    own = [c for c in left.columns if c not in by]
    names = [f"__r{k}" for k in range(len(kinds))]
    row = F.struct(F.col(time).alias("rt"), *rest)
    known = right.na.drop(subset=[*by, time])
    r = known.groupBy(*by, F.col(time).alias("__t")).agg(*(F.min(F.when(c, row)).alias(n) for n, c in zip(names, kinds.values(), strict=True)))
    asks = left.select(*by, F.col(time).alias("__t"), F.struct(*own).alias("__l"))
    if not cell:
        later = W.partitionBy(*by).orderBy(F.desc("__t")).rowsBetween(W.unboundedPreceding, -1)
        pair = {n: F.struct(F.col(n).alias("b"), F.last(n, ignorenulls=True).over(later).alias("a")) for n in names}
        pairs = r.select(*by, "__t", *(F.when(F.col(n).isNotNull(), p).alias(n) for n, p in pair.items()))
        firsts = r.groupBy(*by).agg(*(F.min(n).alias(n) for n in names))
        firsts = firsts.select(*by, *(F.struct(F.when(F.lit(False), F.col(n)).alias("b"), F.col(n).alias("a")).alias(n) for n in names))
        so_far = W.partitionBy(*by).orderBy("__t", F.col("__l").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
        both = asks.unionByName(pairs, allowMissingColumns=True).unionByName(firsts, allowMissingColumns=True)
        j = both.withColumns({n: F.last(n, ignorenulls=True).over(so_far) for n in names}).filter("__l is not null")
        timed = lambda n, x: F.when(F.col("__t").isNotNull(), F.col(n)[x])
        j = j.withColumns({f"{n}{x}": timed(n, x) for n in names for x in "ba"} | {f"{n}{x}": F.lit(None) for n in names for x in ("_lo", "_hi")})
        return _chosen(j, by, own, names, kinds, ahead)
    both = asks.unionByName(r, allowMissingColumns=True).withColumn("__cell", F.floor(F.col("__t") / cell))
    within = W.partitionBy(*by, "__cell")
    back = {n: F.last(n, ignorenulls=True).over(within.orderBy("__t", F.col("__l").isNotNull()).rowsBetween(W.unboundedPreceding, 0)) for n in names}
    onward = {n: F.last(n, ignorenulls=True).over(within.orderBy(F.desc("__t"), F.col("__l").isNotNull()).rowsBetween(W.unboundedPreceding, 0)) for n in names}
    j = both.withColumns({f"{n}b": c for n, c in back.items()} | {f"{n}a": c for n, c in onward.items() if ahead}).filter("__l is not null")
    at = {n: F.when(F.col(n).isNotNull(), F.col("__t")) for n in names}
    cells = both.groupBy(*by, "__cell").agg(*(f(n, at[n]).alias(f"{n}{x}") for n in names for x, f in (("first", F.min_by), ("last", F.max_by))))
    up, down = (W.partitionBy(*by).orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.col("__cell"), F.desc("__cell")))
    carried = cells.select(*by, "__cell", *(F.last(f"{n}last", ignorenulls=True).over(up).alias(f"{n}_lo") for n in names), *(F.last(f"{n}first", ignorenulls=True).over(down).alias(f"{n}_hi") for n in names if ahead))
    return _chosen(j.join(carried, [*by, "__cell"], "left"), by, own, names, kinds, ahead)


def _chosen(j: DataFrame, by: list[str], own: list[str], names: list[str], kinds: dict[str, Column], ahead: bool) -> DataFrame:
    """The nearer of the row before and the row after, of the cell's or else of what is carried into it."""
    out = {}
    for n, name in zip(names, kinds, strict=True):
        if not ahead:
            out[name] = F.coalesce(f"{n}b", f"{n}_lo")
            continue
        b, a = F.coalesce(f"{n}b", f"{n}_lo"), F.coalesce(f"{n}a", f"{n}_hi")
        earlier = b.isNotNull() & (a.isNull() | (F.col("__t") - b["rt"] <= a["rt"] - F.col("__t")))
        out[name] = F.when(earlier, b).otherwise(a)
    return j.select(*by, *(F.col(f"__l.{c}").alias(c) for c in own), *(c.alias(n) for n, c in out.items()))


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], time: str, payload: str = "entry", cell: float | None = CELL) -> DataFrame:
    """``left`` with ``payload``: a struct of the right row nearest in time (``rt`` and the other columns), the earlier on ties; null without one."""
    return nearest_rows(left, right, by, time, {payload: F.lit(True)}, cell)


def asof_hold(left: DataFrame, right: DataFrame, by: list[str], time: str, filled: Column, most: float = 5.0, cell: float | None = CELL) -> DataFrame:
    """``entry``: the nearest entry; if it isn't ``filled``, the nearest filled one within ``most``; else the empty one. Both are looked for at once."""
    j = nearest_rows(left, right.withColumn("filled", filled), by, time, {"nearest": F.lit(True), "held": filled}, cell)
    use = F.when(~F.col("nearest.filled") & (F.abs(F.col("held.rt") - F.col(time)) <= most), F.col("held")).otherwise(F.col("nearest"))
    return j.withColumn("entry", use).drop("nearest", "held")


def in_interval(points: DataFrame, intervals: DataFrame, by: list[str], time: str, start: str, end: str, cell: int) -> DataFrame:
    """Points with ``start <= time < end``, joined by key and a cell of time, so that a long key isn't met by all its points."""
    p = points.withColumn("__cell", F.floor(F.col(time) / cell))
    i = intervals.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell))))
    return p.join(i, [*by, "__cell"]).filter((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("__cell")


def events_with_incident(events: DataFrame, members: DataFrame) -> DataFrame:
    """``timeline_target``: the incident's root, else the event's own folder. ``members``: event_id, incident_id."""
    return events.join(members, "event_id", "left").withColumn("timeline_target", F.coalesce(F.concat(F.lit("incident/"), F.col("incident_id").cast("string")), F.concat(F.lit("event/"), F.col("event_id").cast("string"))))


def apply_reviews(events: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row for each event a review names; names of unknown events are ignored."""
    return reviews.withColumn("event_id", F.explode("detections")).drop("detections").join(events, "event_id")


def of_known(frames: DataFrame, events: DataFrame, on: str = "event_id") -> DataFrame:
    return frames.join(events.select(on), on, "left_semi")


def without(rows: DataFrame, other: DataFrame, on: str) -> DataFrame:
    return rows.join(other.select(on), on, "left_anti")


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the order given."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def exports_with_clip(timeline: DataFrame, files: DataFrame, label: str) -> DataFrame:
    """The first response for each export whose clip file exists. ``files``: path."""
    rows = timeline.filter((F.col("source") == "api") & (F.col("direction") == "in") & F.col("label").contains(label) & F.col("export_id").isNotNull())
    return first_per_key(rows.join(files.select(F.col("path").alias("clip")).distinct(), "clip", "left_semi"), ["export_id"], F.col("ts"), F.col("entry_id"))


def suppress_snoozed(targets: DataFrame, snoozes: DataFrame, flag: str, cell_s: int = 86_400) -> DataFrame:
    """``suppressed``: every camera of the target is snoozed at its time.

    ``targets``: target_id, ts_us, cameras. A snooze holds from being set until it
    expires (exclusive) or the camera's next one is set. A target without cameras is
    never suppressed. Asking times and snoozes meet by camera and day, so that no
    camera is one task.
    """
    asks = targets.select("target_id", F.col("ts_us").alias("at"), F.explode(F.array_distinct("cameras")).alias("camera"))
    marks = snoozes.groupBy("camera", F.col("set_us").alias("at")).agg(F.max(F.struct("expiration_us", flag)).alias("s"))
    now = nearest_rows(asks, marks, ["camera"], "at", {"held": F.lit(True)}, cell_s * 1_000_000, ahead=False)
    state = now.groupBy("target_id").agg(F.bool_and(F.coalesce((F.col("held.s.expiration_us") > F.col("at")) & F.col(f"held.s.{flag}"), F.lit(False))).alias("suppressed"))
    return targets.join(state, "target_id", "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))


def canonical_camera(folders: DataFrame, config: DataFrame, sanitize) -> DataFrame:
    """``canonical``: the first configured name that sanitizes to the folder's name, else the folder's."""
    names = config.select(sanitize(F.col("camera")).alias("folder"), F.col("camera").alias("__c")).groupBy("folder").agg(F.min("__c").alias("__c"))
    return folders.join(names, "folder", "left").withColumn("canonical", F.coalesce("__c", "folder")).drop("__c")


def match_exports(requests: DataFrame, exports: DataFrame) -> DataFrame:
    """The best finished export for each request: equal id, else equal name or path, else equal requested name, else the newest.

    Equality joins for each kind of match, united with their priority: no pair is
    looked at without a reason, and the newest is one row.
    """
    done = exports.filter(~F.col("in_progress"))
    pick = lambda p, df: df.select("request_id", "export_id", "created", F.lit(p).alias("priority"))
    e = done.select("export_id", "name", "created")
    by_id = pick(1, requests.select("request_id", F.col("export_id").alias("wanted")).join(e, F.col("wanted") == F.col("export_id")))
    by_name = pick(2, requests.select("request_id", F.col("file_name").alias("wanted")).join(e, F.col("wanted") == F.col("name")))
    by_request = pick(3, requests.select("request_id", F.col("requested_name").alias("wanted")).join(e, F.col("wanted") == F.col("name")))
    newest = e.agg(F.max(F.struct("created", "export_id")).alias("m"))
    last = requests.filter("export_id is null").select("request_id", F.lit(1).alias("__k")).join(F.broadcast(newest.filter("m is not null").withColumn("__k", F.lit(1))), "__k")
    by_newest = last.select("request_id", F.col("m.export_id").alias("export_id"), F.col("m.created").alias("created"), F.lit(4).alias("priority"))
    return first_per_key(by_id.union(by_name).union(by_request).union(by_newest), ["request_id"], F.col("priority"), F.desc("created"), F.desc("export_id"))


def metadata_fallback(incidents: DataFrame, cameras: DataFrame) -> DataFrame:
    """``meta``: the incident's own, else that of its first camera (by name) that has one. ``cameras``: incident_id, camera, meta."""
    first = cameras.filter("meta is not null and meta <> ''").groupBy("incident_id").agg(F.min_by("meta", "camera").alias("__m"))
    return incidents.join(first, "incident_id", "left").withColumn("meta", F.coalesce(F.when(F.col("meta") != "", F.col("meta")), "__m")).drop("__m")


def representative_event(members: DataFrame) -> DataFrame:
    """The longest member of each incident and camera; ties go to the first joined."""
    return first_per_key(members, ["incident_id", "camera"], F.desc(F.col("end_us") - F.col("start_us")), F.col("start_us"), F.col("event_id"))
