"""Late rows, reviews after closing, failing providers, the rate limit's segments, and hooks of the user's own."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from camwatch.operators import closing as K
from camwatch.operators import late as L
from camwatch.operators import notify as N
from camwatch.operators import timeline as T
from camwatch.operators.segments import cut_where_idle
from camwatch.streaming.late import late_sink

S = 1_000_000


def test_segments_are_the_busy_times_of_a_fold(spark):
    rng = random.Random(2)
    for cost in (0, 7):
        rows = [(site, rng.randint(0, 3000), i, rng.randint(0, 25)) for i in range(400) for site in [rng.choice([1, 1, 1, 2])]] + [(None, 5, 1000, 1), (1, None, 1001, 1)]
        df = spark.createDataFrame(rows, "site long, at long, id long, hold long")
        got = {r.id: r.segment for r in cut_where_idle(df, "site", "at", ["id"], F.col("at") + F.col("hold"), cost, cell=100).collect()}
        want = {1000: None, 1001: None}
        for site in (1, 2):
            busy, begin = None, None
            for _, at, i, hold in sorted((r for r in rows if r[0] == site and r[1] is not None), key=lambda r: (r[1], r[2])):
                begin = at if busy is None or at >= busy else begin
                busy = at + hold if busy is None else max(busy + cost, at + hold)
                want[i] = begin
        assert got == want and len(set(want.values())) > 20


def test_flags_compose_over_rows_and_days(spark):
    rng = random.Random(4)
    rows = [(g, i, *rng.choice([(False, False), (True, True), (False, True), (False, True), (True, False)])) for g in (1, 2, 3) for i in range(30)]
    got = {(r.g, r.i): (r.before_not, r.before_told) for r in N.composed(spark.createDataFrame(rows, "g int, i int, after_not boolean, after_told boolean"), ["g"], "i").collect()}
    want = {}
    for g in (1, 2, 3):
        now = [False, True]
        for _, i, a, b in (r for r in rows if r[0] == g):
            want[g, i] = tuple(now)
            now = [b if x else a for x in now]
    assert got == want


def test_rate_limit_goes_on_over_segments_and_days(spark):
    """Overflows, long pauses within a day and over days: a told overflow lasts over a pause until a drain, as one fold over the site has it."""
    from tests.test_operators import brute_rate_limit

    rng, sites, i = random.Random(11), {1: [], 2: []}, 0
    for rows in sites.values():
        ts = 0
        for _ in range(60):
            ts += rng.choice([120, 4000, 30_000, 100_000]) * S
            for _ in range(rng.choice([1, 2, 3, 13, 14, 30])):
                ts += rng.choice([0, 1000, 300_000])
                rows.append((ts, i))
                i += 1
    df = spark.createDataFrame([(s, ts, i) for s, rows in sites.items() for ts, i in rows] + [(None, 5, -1), (1, None, -2)], "site_id long, ts_us long, request_id long")
    got = {r.request_id: (r.outcome, r.sent_us) for r in N.rate_limit(df).collect()}
    want = {-1: (None, None), -2: (None, None)}
    for rows in sites.values():
        want |= brute_rate_limit(rows)
    assert got == want
    cost = 3 * S
    pieces = cut_where_idle(df.filter("site_id is not null and ts_us is not null"), "site_id", "ts_us", ["request_id"], F.col("ts_us") + F.lit(20 * S), cost).select("site_id", "segment").distinct().count()
    assert pieces > 40


def test_closing_judges_segments_as_one_fold(spark):
    """Against the rule over each site's messages as a whole, with options, repeated and stray messages."""
    rng = random.Random(8)
    rows, t = [], 0
    for k in range(400):
        t += rng.choice([0, 1, 30, 119, 120, 121, 700]) * S
        site, e = rng.choice([1, 2]), f"e{k:03d}"
        rows.append((site, t, "new", e, rng.choice("abc"), rng.choice(["x", "y", None])))
        if rng.random() < 0.85:
            rows.append((site, t + rng.choice([1, 5, 60, 120, 300]) * S, "end", e, "a", None))
        if rng.random() < 0.1:
            rows.append((site, t + rng.randint(0, 400) * S, rng.choice(["new", "end"]), f"e{rng.randint(0, k):03d}", "d", "z"))
    rows += [(1, 5, "update", "e000", "a", None), (None, 5, "new", "q", "a", None), (1, None, "new", "q", "a", None), (1, 5, "end", "never", "a", None)]
    df = spark.createDataFrame(rows, "site_id long, ts_us long, kind string, event_id string, camera string, label string")
    for options in ({}, {"close_canceled": False, "least_s": 2, "most_s": 200}):
        closed, changes = [], []
        for site in (1, 2):
            rule = K.CloseTimer(120, **options)
            own = sorted((r for r in rows if r[0] == site and r[1] is not None and r[2] in ("new", "end")), key=lambda r: (r[1], r[2] == "end", r[3]))
            for _, now, kind, e, camera, label in own:
                closed += [K.closed_row(site, x) for x in rule.fire(now)]
                end = rule.see(kind, e, camera, label, now)
                changes += [K.membership_row(site, e, now, *end)] if end else []
            closed += [K.closed_row(site, x) for x in rule.fire(None)]
        assert sorted(map(tuple, K.exact_incidents(df, 120, **options).collect())) == sorted(closed) and len(closed) > 50
        assert sorted(map(tuple, K.short_long(df, 120, **options).collect()), key=repr) == sorted(changes, key=repr)


def test_a_discarded_primary_moves_on():
    rule = K.CloseTimer(120)
    for kind, e, camera, t in (("new", "a", "c1", 0), ("new", "b", "c2", 1), ("end", "a", "c1", 3)):
        assert not list(rule.fire(t * S))
        end = rule.see(kind, e, camera, "person", t * S)
    outcome, inc = end
    assert (outcome, inc.ids, inc.primary_event, inc.primary_camera, inc.cameras, inc.start_us) == ("discarded", ["b"], "b", "c1", ["c1", "c2"], 0)
    assert rule.see("end", "b", "c2", None, 3 * S)[0] == "discarded" and not rule.held and rule.active is None


def test_a_failing_provider_leaves_other_rows_alone(spark):
    n = spark.createDataFrame([(i, f"f{i}" if i % 4 else None, "new") for i in range(20)], "notification_id long, folder string, status string").repartition(3)

    def flaky(row):
        if row["notification_id"] % 5 == 0:
            raise RuntimeError("down")
        if row["notification_id"] % 5 == 1:
            return {"nothing": "useful"}
        return None if row["notification_id"] % 5 == 2 else {"status": "success", "message": row["folder"]}

    quiet = lambda d: d.filter("notification_id < 3").select("notification_id", F.lit("sent").alias("status"), F.lit(None).cast("string").alias("message"))
    res = N.fan_out(n, {"quiet": quiet}, {"flaky": flaky})
    got = {(r.notification_id, r.provider): (r.status, r.message) for r in res.collect()}
    want = {(i, "flaky"): ("failure", "down") for i in range(0, 20, 5)} | {(i, "flaky"): ("failure", "'status'") for i in range(1, 20, 5)} | {(i, "flaky"): ("success", f"f{i}" if i % 4 else None) for i in range(20) if i % 5 > 2} | {(i, "quiet"): ("sent", None) for i in range(3)}
    assert got == want
    log = {r.notification_id: r for r in N.dispatch_log(n, res).collect()}
    assert set(log) == {i for i in range(20) if i % 4}  # without a folder there is no timeline
    assert log[7].label == "Notification: new" and log[7].results == [] and log[5].label == "Notification: new — flaky: failure"
    assert N.dispatch_log(n, res.filter("false")).count() == 15


def test_overflows_warn_through_every_provider(spark):
    r = N.rate_limit(spark.createDataFrame([(s, i, 100 * s + i) for s in (1, 2) for i in range(13 + s)], "site_id long, ts_us long, request_id long"))

    def broken():
        raise OSError("no line")

    got = {tuple(x) for x in N.send_overflow(r, {"a": lambda: {"status": "success"}, "b": broken, "c": lambda: None}).collect()}
    assert got == {(k, p, *v) for k in (112, 212) for p, v in (("a", ("success", None)), ("b", ("failure", "no line")))}


def test_late_rows_are_split_as_a_stream_would_drop_them(spark, tmp_path):
    rng = random.Random(3)
    batches = [[(b * 100 + i, 900_000 * S + b * 400 * S - rng.choice([0, 10, 500, 650, 3000]) * S) for i in range(12)] for b in range(6)]
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, "id long, us long").select("id", F.timestamp_micros("us").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    late_sink(read(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {k: {r.id for r in spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / f"out/{k}")).collect()} for k in ("rows", "late")}
    df = spark.createDataFrame([(b, *r) for b, rows in enumerate(batches) for r in rows], "batch long, id long, ts_us long")
    want = {r.id: r.late for r in L.split_late(df).collect()}
    assert got["late"] == {i for i, x in want.items() if x} and got["rows"] == {i for i, x in want.items() if not x} and len(got["late"]) > 5
    # what Spark itself drops is among the late ones: it compares with the watermark of the batch before
    q = read().withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["id"]).writeStream.format("memory").queryName("kept_rows").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    kept = {r.id for r in spark.table("kept_rows").collect()}
    assert got["rows"] <= kept < got["rows"] | got["late"]
    mark = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out/late")).filter("unix_micros(ts) > watermark_us").count()
    assert mark == 0


def test_late_rows_without_time_or_batch(spark):
    df = spark.createDataFrame([(0, 10 * S), (0, None), (1, 5 * S), (1, 9_000 * S), (2, 8_000 * S), (None, 1)], "batch long, ts_us long")
    assert sorted((-1 if r.batch is None else r.batch, r.ts_us or 0, r.late) for r in L.split_late(df, delay_s=600).collect()) == [(-1, 1, False), (0, 0, False), (0, 10 * S, False), (1, 5 * S, False), (1, 9000 * S, False), (2, 8000 * S, True)]


def test_reviews_after_closing_get_a_stand_in(spark):
    e = spark.createDataFrame([("a", "i1", "c1", "person", "fa", 10, 20, None), ("b", "i1", "c2", "car", None, 12, None, "alert"), ("s", None, "c3", "dog", None, 5, None, None)], "event_id string, incident_id string, camera string, label string, folder string, start_us long, end_us long, severity string")
    i = spark.createDataFrame([("i1", "c1", "person, car", "events/i1/c1", 10, 20, 140)], "incident_id string, camera string, label string, folder string, start_us long, end_us long, closed_us long")
    r = spark.createDataFrame([(1, "a", 30, "t1", "d", 2), (2, "b", 31, "t2", "d", None), (3, "b", 140, "t3", None, 1), (4, "a", 500, "t4", "d", 0), (5, "s", 9, "t5", "d", 1), (6, "gone", 9, "t6", "d", 1)], "review_id long, event_id string, ts_us long, title string, description string, threat int")
    got = {x.review_id: x for x in L.review_targets(r, e, i).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert [(got[k].kind, got[k].target_id, got[k].sent, got[k].camera) for k in sorted(got)] == [("incident", "i1", True, "c1"), ("incident", "i1", False, "c1"), ("stand_in", "b", True, "c2"), ("stand_in", "a", True, "c1"), ("stand_in", "s", True, "c3")]
    assert (got[3].folder, got[3].end_us, got[3].severity, got[3].tag, got[2].threat) == ("", 12, "alert", "event_b", 0) and got[4].folder == "fa" and got[5].severity == "detection"


def test_area_hook_may_give_any_points(spark):
    @udtf(returnType="t double, area bigint")
    class Fixed:
        def eval(self, incident_id: int, camera: str, end_sec: float, entries: list):
            yield 2.0, 100 if camera == "b" else len(entries)
            yield 2.0, 1
            yield 3.0, 999

    spark.udtf.register("fixed_area", Fixed)
    entries = spark.createDataFrame([(1, "a", 0, 5), (1, "a", 5, 7), (1, "b", 1, 0)], "incident_id long, camera string, t int, area long")
    got = {(r.camera, r.idx): r.area for r in T.hooked_curves(entries, "fixed_area").collect()}
    assert got == {("a", 0): 0, ("a", 1): 2, ("a", 2): 0, ("b", 0): 0, ("b", 1): 100, ("b", 2): 0}


def test_area_hook_of_many_cameras_is_shuffled_by_incident_only(spark):
    """Against brute force: no rows, points off the grid or beyond the end, repeated ones, cameras and incidents without a name."""

    @udtf(returnType="t double, area bigint")
    class Odd:
        def eval(self, incident_id: int, camera: str, end_sec: float, entries: list):
            for k in range(60 if incident_id % 4 else 0):
                yield k * 1.25, None if k % 7 == 3 else (incident_id * 31 + len(entries) * 17 + k * k) % 101
                yield 100.0 - k * 5.0, k

    spark.udtf.register("odd_area", Odd)
    rng = random.Random(6)
    rows = [(i, c, t, rng.randint(0, 9)) for i in range(24) for c in ["a", "b", None][: rng.randint(1, 3)] for t in rng.sample(range(0, 70), rng.randint(1, 5))] + [(None, "a", 4, 1), (30, "a", 0, 1), (31, "a", None, 1)]
    want = {}
    for i in {r[0] for r in rows if r[0] is not None}:
        end = max((r[2] for r in rows if r[0] == i and r[2] is not None), default=0)
        for c in {r[1] for r in rows if r[0] == i}:
            given = list(Odd.func().eval(i, c, end, [r for r in rows if r[:2] == (i, c)])) if c else []
            for k in range(min(int(end // 2.5), 19) + 1 if end > 0 else 0):
                want[i, c, k] = (k * 2.5, max((a for t, a in given if t == k * 2.5 and a is not None), default=0))
    entries = spark.createDataFrame(rows, "incident_id long, camera string, t int, area long")
    got = T.hooked_curves(entries, "odd_area", 2.5, 20).collect()
    assert {(r.incident_id, r.camera, r.idx): (r.t, r.area) for r in got} == want and len(got) == len(want) and len({a for _, a in want.values()}) > 30
    assert T.hooked_curves(entries, "odd_area", 0).count() == 0
    plan = T.camera_timeline(entries.withColumn("label", F.lit("person")), area_fn="odd_area")._jdf.queryExecution().executedPlan().toString()
    shuffles = [x.split(")")[0] for x in plan.split("hashpartitioning(")[1:]]
    assert len(shuffles) >= 2 and all(x.startswith("incident_id") and "," not in x.rsplit(",", 1)[0] for x in shuffles)


def test_describe_skips_incidents_snoozed_on_all_cameras(spark):
    inc = spark.createDataFrame([(1, 10, ["a", "b"]), (2, 10, ["a"]), (3, 30, ["a"]), (4, 10, [])], "incident_id long, ready_us long, cameras array<string>")
    z = spark.createDataFrame([("a", 0, 20, True)], "camera string, set_us long, expiration_us long, snooze_ai boolean")

    def tell(parts):
        for p in parts:
            yield pd.DataFrame({"incident_id": p["incident_id"], "title": [f"{len(c)} cameras" for c in p["cameras"]]})

    got = {r.incident_id: r.title for r in N.describe(inc, tell, "incident_id long, title string", z).collect()}
    assert got == {1: "2 cameras", 3: "1 cameras", 4: "0 cameras"}
    with pytest.raises(Exception, match="suppressed"):
        N.describe(inc, tell, "incident_id long, title string").collect()


def test_a_site_without_a_pause_is_judged_in_constant_state():
    """Events that start once are counted, not kept; the outcome is that of keeping all ids."""
    rng = random.Random(4)
    messages, t = [], 0
    for k in range(20_000):
        t += rng.choice([0, 1, 2, 3]) * S
        end = t + rng.choice([1, 4, 5, 60, 130]) * S if rng.random() < 0.9 else None
        messages += [(t, 0, "new", f"e{k:05d}", rng.choice("abc"), end)] + [(end, 1, "end", f"e{k:05d}", "a", end)] * (end is not None)
    whole, lean = K.CloseTimer(120), K.CloseTimer(120)
    for now, _, kind, e, camera, end in sorted(messages, key=lambda m: (m[0], m[1], m[3])):
        assert [K.closed_row(1, x) for x in whole.fire(now)] == [K.closed_row(1, x) for x in lean.fire(now)]
        a, b = whole.see(kind, e, camera, "x", now), lean.see(kind, e, camera, "x", now, True, end is not None)
        assert (a and K.membership_row(1, e, now, *a)) == (b and K.membership_row(1, e, now, *b))
    assert sum(len(x.members) for x in lean.held.values()) < 50 and sum(x.n_events for x in lean.held.values()) > 10_000
    assert len(lean.starts) < 200 and not lean.known
    assert [K.closed_row(1, x) for x in whole.fire(None)] == [K.closed_row(1, x) for x in lean.fire(None)]
