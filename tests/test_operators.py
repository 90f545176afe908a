"""Joins, incidents, timeline and limits on small cases."""

import json
import random

import pandas as pd
from pyspark.sql import functions as F

from camwatch.operators import closing as K
from camwatch.operators import filters as P
from camwatch.operators import incidents as I
from camwatch.operators import joins as J
from camwatch.operators import notify as N
from camwatch.operators import reports as R
from camwatch.operators import store as S
from camwatch.operators import timeline as L


def test_asof_ties_go_to_the_earlier(spark):
    left = spark.createDataFrame([("a", 10.0), ("a", 99.0), ("b", 1.0)], "k string, t double")
    right = spark.createDataFrame([("a", 8.0, 1), ("a", 12.0, 2)], "k string, t double, v int")
    got = {(r.k, r.t): r.entry and r.entry.v for r in J.asof_nearest(left, right, ["k"], "t").collect()}
    assert got == {("a", 10.0): 1, ("a", 99.0): 2, ("b", 1.0): None}


def test_asof_over_cells_of_time(spark):
    rng = random.Random(5)
    left = [(k, float(rng.randint(0, 100_000)), i) for i, k in enumerate("ab" * 200)] + [("a", None, 900), (None, 5.0, 901)]
    right = [(k, float(rng.choice([rng.randint(0, 9000), rng.randint(60_000, 61_000)])), i) for i, k in enumerate("aab" * 30)] + [("b", None, 950), (None, 5.0, 951)]
    lf, rf = spark.createDataFrame(left, "k string, t double, id int"), spark.createDataFrame(right, "k string, t double, v int")
    want = {}
    for k, t, i in left:
        near = [(abs(u - t), u, v) for j, u, v in right if j == k and k and t is not None and u is not None]
        want[i] = min(near)[1:] if near else None
    for cell in (10.0, 3600.0, 1e9):
        got = {r.id: r.entry and (r.entry.rt, r.entry.v) for r in J.asof_nearest(lf, rf, ["k"], "t", cell=cell).collect()}
        assert got == want, cell


def test_asof_of_one_long_key(spark):
    """200,000 rows of one key: the work must not grow with the square."""
    rows = spark.range(200_000).select(F.lit("a").alias("k"), (F.col("id") * 1.0).alias("t"), F.col("id").alias("v"))
    odd = J.asof_nearest(rows.filter("v % 2 = 1"), rows.filter("v % 2 = 0"), ["k"], "t").agg(F.count("*").alias("n"), F.sum(F.col("v") - F.col("entry.v")).alias("s")).first()
    assert tuple(odd) == (100_000, 100_000)


def test_asof_hold(spark):
    left = spark.createDataFrame([("a", 10.0), ("a", 30.0)], "k string, t double")
    right = spark.createDataFrame([("a", 10.0, 0), ("a", 14.0, 5), ("a", 30.0, 0)], "k string, t double, n int")
    got = {r.t: r.entry.rt for r in J.asof_hold(left, right, ["k"], "t", F.col("n") > 0).collect()}
    assert got == {10.0: 14.0, 30.0: 30.0}


def test_gap_is_exclusive(spark):
    e = spark.createDataFrame([(1, 0, 0), (1, 1, 120_000_000), (1, 2, 239_000_000)], "site_id long, event_id long, start_us long")
    for f in (I.assign_incidents, I.assign_incidents_by_day):
        assert [r.incident_id for r in f(e, 120).orderBy("event_id").collect()] == ["1_0", "1_120000000", "1_120000000"]


def test_by_day_stitches_over_midnight(spark):
    day = 86_400_000_000
    e = spark.createDataFrame([(1, 0, day - 10), (1, 1, day + 10), (1, 2, 2 * day + 10), (2, 3, 5)], "site_id long, event_id long, start_us long")
    a = {r.event_id: r.incident_id for r in I.assign_incidents(e, 120).collect()}
    b = {r.event_id: r.incident_id for r in I.assign_incidents_by_day(e, 120).collect()}
    assert a == b


def test_grid_and_segments(spark):
    ends = spark.createDataFrame([(1, 2.0)], "incident_id long, end_sec double")
    assert [r.t for r in L.dense_grid(ends, 1.0, 60).orderBy("t").collect()] == [0.0, 1.0, 2.0]
    p = spark.createDataFrame([(1, 0, 0.0, "doorbell"), (1, 1, 5.0, "doorbell"), (1, 2, 10.0, "carport"), (1, 3, 15.0, "carport")], "incident_id long, idx int, t double, camera string")
    s = L.points_to_segments(p, spark.createDataFrame([(1, 20.0)], "incident_id long, end_sec double")).orderBy("seg").collect()
    assert [(r.camera, r.start_sec, r.end_sec) for r in s] == [("doorbell", 0.0, 10.0), ("carport", 10.0, 20.0)]


def test_short_runs(spark):
    row = lambda cams: spark.createDataFrame([(1, i, float(i), c) for i, c in enumerate(cams)], "incident_id long, idx int, t double, camera string")
    assert "".join(r.camera for r in L.merge_short_runs(row("aabbbbb"), 5).orderBy("idx").collect()) == "bbbbbbb"
    assert "".join(r.camera for r in L.merge_short_runs(row("aaabbccc"), 3).orderBy("idx").collect()) == "aaaaaccc"


def test_min_gap(spark):
    t = spark.createDataFrame([(1, x) for x in (0.0, 0.1, 0.2, 1.0, 1.05, 2.0, 2.1, 3.0)], "k int, t double")
    assert [r.t for r in L.min_gap_sample(t, "k", "t", 1.0, 5).orderBy("t").collect()] == [0.0, 1.0, 2.0, 3.0]


def test_frame_cap_counts_admitted_only(spark):
    r = spark.createDataFrame([(1, 0, 1, 2), (1, 1, 2, 1), (1, 3_600_000_001, 3, 1)], "site_id long, ts_us long, request_id long, frames long")
    assert {x.request_id: x.admitted for x in N.rolling_frame_cap(r, 2).collect()} == {1: True, 2: False, 3: True}


def test_frame_cap_over_bursts_against_brute_force(spark):
    rng, rows, i = random.Random(9), [], 0
    for site in (1, 2):
        ts = 0
        for _ in range(200):
            ts += rng.choice([1, 60, 900, 3600, 3601, 3602, 90_000]) * 1_000_000
            rows.append((site, ts, i, rng.randint(1, 90)))
            i += 1
    want = {}
    for site in (1, 2):
        held = []
        for _, ts, k, n in (r for r in rows if r[0] == site):
            want[k] = sum(m for t, m in held if t >= ts - 3_600_000_000) + n <= 200
            held += [(ts, n)] if want[k] else []
    df = spark.createDataFrame(rows, "site_id long, ts_us long, request_id long, frames long")
    assert {r.request_id: r.admitted for r in N.rolling_frame_cap(df, 200).collect()} == want


def test_rate_limit_overflows_once(spark):
    r = spark.createDataFrame([(1, i, i) for i in range(15)], "site_id long, ts_us long, request_id long")
    got = {x.request_id: x.outcome for x in N.rate_limit(r).collect()}
    assert [got[0], got[1], got[12]] == ["sent", "sent", "overflow"]
    assert [got[i] for i in range(2, 12)] == ["dropped"] * 10
    assert [got[13], got[14]] == ["queued", "queued"]


def test_rate_limit_clears_once_then_the_queue_grows(spark):
    """40 requests at once: two go out, ten wait, the next clears them and tells, and the 27 after it all wait and go out later."""
    r = spark.createDataFrame([(1, i, i) for i in range(40)], "site_id long, ts_us long, request_id long")
    got = [x.outcome for x in N.rate_limit(r).orderBy("request_id").collect()]
    assert got == ["sent"] * 2 + ["dropped"] * 10 + ["overflow"] + ["queued"] * 27


def test_rate_limit_sends_at_once_while_others_wait(spark):
    # at 5.5 s the window holds nothing and the next drain is due at 6 s
    r = spark.createDataFrame([(1, t, i) for i, t in enumerate([0, 1, 500_000, 5_500_001])], "site_id long, ts_us long, request_id long")
    assert [(x.outcome, x.sent_us) for x in N.rate_limit(r).orderBy("request_id").collect()] == [("sent", 0), ("sent", 1), ("queued", 5_500_000), ("sent", 5_500_001)]
    r = spark.createDataFrame([(1, t, i) for i, t in enumerate([0, 1, 200_000, 400_000, 5_100_000])], "site_id long, ts_us long, request_id long")
    assert [(x.outcome, x.sent_us) for x in N.rate_limit(r).orderBy("request_id").collect()] == [("sent", 0), ("sent", 1), ("queued", 5_200_000), ("queued", 10_200_000), ("sent", 5_100_000)]


def brute_rate_limit(rows, most=2, win=5_000_000, queue=10):
    """Outcomes of one site's (ts_us, request_id), all rows at hand."""
    out, sent, waiting, told, clock = {}, [], [], False, 0
    for ts, i in [*sorted(rows), (None, None)]:
        while waiting and (ts is None or clock + 1_000_000 <= ts):
            clock += 1_000_000
            if sum(t > clock - win for t in sent) < most:
                out[waiting.pop(0)] = ("queued", clock)
                sent.append(clock)
                told = told and len(waiting) >= queue
        if ts is None:
            return out
        if sum(t > ts - win for t in sent) < most:
            sent.append(ts)
            out[i] = ("sent", ts)
            continue
        clock = clock if waiting else ts
        waiting.append(i)
        if len(waiting) > queue and not told:
            out |= {q: ("dropped", None) for q in waiting} | {i: ("overflow", ts)}
            waiting, told = [], True


def test_rate_limit_against_brute_force_in_small_batches(spark):
    rng, sites, i = random.Random(3), {1: [], 2: [], 3: []}, 0
    for rows in sites.values():
        ts = 0
        for _ in range(300):
            ts += rng.choice([0, 1000, 200_000, 1_000_000, 9_000_000]) if i % 60 < 40 else rng.randint(0, 100_000)
            rows.append((ts, i))
            i += 1
    df = spark.createDataFrame([(s, ts, i) for s, rows in sites.items() for ts, i in rows], "site_id long, ts_us long, request_id long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.request_id: (r.outcome, r.sent_us) for r in N.rate_limit(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {}
    for rows in sites.values():
        want |= brute_rate_limit(rows)
    assert {o for o, _ in want.values()} == {"sent", "queued", "dropped", "overflow"} and got == want


def test_rate_limit_holds_nothing_of_what_waits():
    """A site that is never idle: each batch's rows come before the next is read, and what goes out afterwards comes in pieces."""
    fed, got, most = [], [], 0

    def batches():
        for k in range(40):
            fed.append(k)
            yield pd.DataFrame({"site_id": 1, "segment": 0, "ts_us": range(k * 1000, k * 1000 + 1000), "request_id": range(k * 1000, k * 1000 + 1000)})

    for out in N.judge_segments(batches(), "site_id", lambda told: N.RateLimit(2, 5, 10, told), False):
        got.append(out["request_id"].notna().sum())
        most = max(most, len(out))
        assert sum(got) >= 1000 * (len(fed) - 1)
    assert sum(got) == 40_000 and most <= N.TICKETS


def test_rate_limit_tells_of_many_segments_at_once():
    """Short segments: their flags come in batches, not each in a frame of its own."""
    rows = pd.DataFrame({"site_id": 1, "segment": [k * 60_000_000 for k in range(12_000)], "ts_us": [k * 60_000_000 for k in range(12_000)], "request_id": range(12_000)})
    got = list(N.judge_segments(iter([rows[:5_000], rows[5_000:]]), "site_id", lambda told: N.RateLimit(2, 5, 10, told), True))
    assert [len(x) for x in got] == [10_000, 2_000] and pd.concat(got)["segment"].tolist() == rows["segment"].tolist()


def test_rate_limit_of_a_site_that_is_never_idle(spark):
    rng, ts, rows = random.Random(8), 0, []
    for i in range(1500):
        ts += rng.choice([0, 1000, 300_000, 900_000])
        rows.append((ts, i))
    df = spark.createDataFrame([(1, t, i) for t, i in rows], "site_id long, ts_us long, request_id long")
    got = N.rate_limit(df).collect()
    want = brute_rate_limit(rows)
    assert {r.request_id: (r.outcome, r.sent_us) for r in got} == want and len(got) == len(rows) and sum(o == "queued" for o, _ in want.values()) > 1000


def test_rate_limit_and_incidents_give_rows_while_a_site_goes_on():
    read = []

    def batches(make):
        for k in range(20):
            read.append(k)
            yield make(k)

    requests = lambda k: pd.DataFrame({"site_id": 1, "segment": 0, "ts_us": [k * 10_000_000 + j for j in range(14)], "request_id": [k * 14 + j for j in range(14)]})
    first = next(N.judge_segments(batches(requests), "site_id", lambda told: N.RateLimit(2, 5, 10, told), False))
    assert read == [0] and len(first) == 2  # one waits if nothing was told, twelve do if it was
    read.clear()
    messages = lambda k: pd.DataFrame({"site_id": 1, "segment": 0, "ts_us": [k * 1_000_000_000, k * 1_000_000_000 + 60_000_000], "kind": ["new", "end"], "event_id": f"e{k}", "camera": "a", "label": None})
    closed = next(K.judge(batches(messages), 120, {}, False))
    assert read == [0, 1] and closed.close_us.tolist() == [180_000_000]


def test_snooze_needs_every_camera(spark):
    t = spark.createDataFrame([(1, 10, ["a", "b"]), (2, 10, ["a"]), (3, 10, [])], "target_id long, ts_us long, cameras array<string>")
    s = spark.createDataFrame([("a", 0, 20, True)], "camera string, set_us long, expiration_us long, f boolean")
    assert {r.target_id: r.suppressed for r in J.suppress_snoozed(t, s, "f").collect()} == {1: False, 2: True, 3: False}


def test_drop_without_id(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("", 3)], "event_id string, n int")
    assert 2 not in {r.n for r in P.drop_without_id(df).collect()}


def test_listings_are_in_order(spark):
    rows = spark.createDataFrame([("b", 9), ("a", 10), ("c", 10), ("d", None)], "event_id string, ts long")
    assert [r.event_id for r in S.list_events(rows).collect()] == ["b", "a", "c", "d"]  # by the text of the time
    line = spark.createDataFrame([(1, "2"), (2, None), (3, "3"), (4, "2")], "pos int, ts string")
    assert [r.pos for r in S.timeline_newest_first(line).collect()] == [3, 1, 4, 2]
    runs = spark.createDataFrame([("test2", None, 10), ("test2", "c", 50), ("test10", None, 20), ("test10", "c", 5), ("test3", None, 99), ("1_x", "c", 7)], "folder string, camera string, mtime long")
    assert [(r.folder, r.ts) for r in S.list_test_runs(runs).collect()] == [("test10", "20"), ("test2", "50")]
    kept = spark.createDataFrame([("a", "c1", 5, True), ("b", "c2", 7, True), ("c", "c1", 6, True), ("d", "c1", 9, False)], "event_id string, camera string, ts long, saved boolean")
    assert [r.event_id for r in S.saved_events(kept).collect()] == ["b", "c", "a"] and [r.event_id for r in S.saved_events(kept, "c1").collect()] == ["c", "a"]


def test_outcomes_without_results_have_a_reason(spark):
    none = spark.createDataFrame([], "code int")
    lines = lambda *n: spark.createDataFrame([(x,) for x in n], "n_entries long")
    assert [r.reason for n in ((), (0,), (3,)) for r in R.outcome_summary(none, lines(*n)).collect()] == ["no folders with timeline", "no export responses in timelines", "entries found but all skipped (clip or export id missing)"]
    assert R.outcome_summary(none).count() == 0


def test_report_of_a_day(spark):
    e = spark.createDataFrame([(90_000, " b ", "s", 1, "door"), (90_000, "a", "s", None, "door"), (86_399, "x", "s", 2, "door"), (130_000, "c", None, 0, "door")], "ts long, title string, summary string, threat int, camera string")
    lines = R.report_lines(e)
    day = F.lit("1970-01-02").cast("date")
    assert R.render_lines(lines, day).first().lines.split("\n") == ["[01:00 AM] a: s (Threat: 0)", "[01:00 AM] b: s (Threat: 1)", "[12:06 PM] c:  (Threat: 0)"]
    entries = R.report_json(e.withColumns({"scene": F.lit(None).cast("string"), "confidence": F.lit(0.5), "context": F.array(F.lit("x"))}))
    got = R.render_json(entries, day).first()
    assert got.n == 3 and [x["time"][11:] for x in json.loads(got.entries)] == ["01:00:00 AM", "01:00:00 AM", "12:06:40 PM"]


def test_no_configuration_allows_everything(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "x"), (4, "a", None)], "id long, camera string, label string")
    config = spark.createDataFrame([("a", ["x"]), ("c", [])], "camera string, labels array<string>")
    assert sorted(r.id for r in P.filter_camera_label(df, config.filter("false")).collect()) == [1, 2, 3, 4]
    got = P.filter_camera_label(df, config)
    assert got.columns == df.columns and [r.id for r in got.collect()] == [1]
    assert [r.id for r in P.filter_camera_label(df, config.withColumn("labels", F.array().cast("array<string>"))).orderBy("id").collect()] == [1, 4]
