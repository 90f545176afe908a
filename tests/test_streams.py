"""Streams on small folders: goldens, and the batch twins on the same rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from camwatch.operators import closing as K
from camwatch.operators import joins as J
from camwatch.operators import notify as N
from camwatch.streaming import stateful as A
from camwatch.streaming import streams as T

NUMBER = itertools.count()
SCHEMA = "site_id long, event_id string, camera string, type string, ts timestamp, text string, frames long"


@pytest.fixture
def run(spark, tmp_path):
    def go(rows, make, mode="append", batches=1, schema=SCHEMA):
        """What the memory sink holds after all batches; ``rows`` are dealt to them in order."""
        n = next(NUMBER)
        src = str(tmp_path / f"in{n}")
        size = -(-len(rows) // batches)
        for k in range(batches):
            spark.createDataFrame([(*r[:i], r[i] / 1e6, *r[i + 1 :]) for r in rows[k * size : (k + 1) * size] for i in [4]], schema.replace("timestamp", "double")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src)
        q = make(stream).writeStream.format("memory").queryName(f"q{n}").outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"cp{n}")).start()
        q.awaitTermination(180)
        return spark.table(f"q{n}").collect()

    return go


S = 1_000_000


def row(ts_us, event, kind="new", site=1, camera="c1", text=None, frames=1):
    return (site, event, camera, kind, 900_000 * S + ts_us, text, frames)  # rows at the epoch itself would count as late


def test_state_keeps_texts_apart_and_forgets_removed(run):
    rows = [row(S, "a"), row(2 * S, "a", "review", text="R"), row(3 * S, "a", "description", text="D"), row(4 * S, "a", "frame"), row(5 * S, "a", "frame"), row(S, "b"), row(2 * S, "b", "remove"), row(3 * S, "b", "end"), row(S, "c", "end")]
    got = run(rows, A.stream_event_state, "update")
    assert [tuple(r) for r in got] == [("a", "FINALIZED", "D", "R", "", False, 2)]


def test_state_is_forgotten_after_its_time_and_counts_a_ring(run):
    rows = [row(S, "a"), row(2 * S, "a", "description", text="D"), row(20 * S, "z"), row(21 * S, "z")]
    rows += [row(9000 * S, "z"), row(9001 * S, "z", "frame"), row(20_000 * S, "a", "frame"), row(20_001 * S, "a", "new")]
    got = [tuple(r) for r in run(rows, lambda s: A.stream_event_state(s, keep_s=60), "update", 4)]
    assert [r[1:3] for r in got if r[0] == "a"] == [("DESCRIBED", "D"), ("NEW", "")] and got[-1][-1] == 0
    many = [row(S, "m"), *(row(2 * S + k, "m", "frame") for k in range(A.RING + 7))]
    assert run(many, A.stream_event_state, "update", 3)[-1].frames == A.RING


def test_sessions_end_at_the_gap(run):
    rows = [row(0, "a"), row(119 * S, "b"), row(239 * S, "c"), row(7200 * S, "z")]
    got = run(rows, lambda s: T.stream_incidents(s).select("site_id", "n_events"), "append", 2)
    assert sorted(r.n_events for r in got) == [1, 2]  # the last is still open


def test_request_rate(run):
    rows = [row(t * S, f"e{t}") for t in (0, 10, 299, 300)] + [row(9000 * S, "z")]
    got = run(rows, lambda s: T.stream_request_rate(s).select(F.unix_micros("window.start").alias("w"), "n"), "append", 2)
    assert {(r.w // S - 900_000, r.n) for r in got} >= {(0, 3), (300, 1)}


def test_first_per_key(run):
    got = run([row(S, "a"), row(2 * S, "a"), row(3 * S, "b"), row(4 * S, "a")], lambda s: T.stream_first_per_key(s, ["event_id"]), "append", 2)
    assert sorted(r.event_id for r in got) == ["a", "b"]


def test_delayed_trigger(run):
    rows = [row(S, "a"), row(2 * S, "b"), row(3 * S, "b", "end"), row(600 * S, "x"), row(1200 * S, "y")]
    got = [r.event_id for r in run(rows, T.delayed_trigger, "append", 5)]
    assert "a" in got and "b" not in got


def shuffled(rows, seed, within_us=300 * S):
    """Rows as they may arrive: each up to so much later than those behind it."""
    rng = random.Random(seed)
    return sorted(rows, key=lambda r: r[4] + rng.randint(0, within_us))


END = [row(50_000 * S, "zz", site=9), row(50_001 * S, "zy", site=9)]


def test_frame_cap_is_the_batch_rule(run, spark):
    rows = [row(k * 600 * S, f"e{k:02d}", frames=1 + k % 4) for k in range(30)]
    got = {r.event_id: r.admitted for r in run([*shuffled(rows, 1), *END], lambda s: A.stream_frame_cap(s, 8), "append", 4) if r.site_id == 1}
    df = spark.createDataFrame([(1, r[4], r[1], r[6]) for r in rows], "site_id long, ts_us long, request_id string, frames long")
    assert got == {r.request_id: r.admitted for r in N.rolling_frame_cap(df, 8).collect()} and len(set(got.values())) == 2


def test_rate_limit_is_the_batch_rule(run, spark):
    rows = [row(k * 1000, f"e{k:02d}") for k in range(30)] + [row(k * 3 * S, f"f{k:02d}") for k in range(1, 12)] + [row(900 * S + k, f"g{k:02d}", site=2) for k in range(9)]
    got = {(r.site_id, r.request_id): (r.outcome, r.sent_us) for r in run([*shuffled(rows, 2), *END], A.stream_rate_limit, "append", 4) if r.site_id != 9}
    df = spark.createDataFrame([(r[0], r[4], r[1]) for r in rows], "site_id long, ts_us long, request_id string")
    assert got == {(r.site_id, r.request_id): (r.outcome, r.sent_us) for r in N.rate_limit(df).collect()} and {o for o, _ in got.values()} == {"sent", "queued", "overflow", "dropped"}


def incident_rows(seed):
    """Short, kept, long and endless events on two sites, with pauses around the gap."""
    rng, rows, t = random.Random(seed), [], 0
    for k in range(60):
        t += rng.choice([1, 20, 119, 120, 121, 400]) * S
        site, camera = rng.choice([1, 2]), rng.choice(["c1", "c2", "c3"])
        rows.append(row(t, f"e{k:02d}", site=site, camera=camera, text=rng.choice(["person", "car", None])))
        if rng.random() < 0.9:
            rows.append(row(t + rng.choice([1, 4, 5, 30, 119, 120, 200]) * S, f"e{k:02d}", "end", site=site, camera=camera))
    return rows


def test_exact_incidents_and_memberships_are_the_batch_rule(run, spark):
    rows = incident_rows(3)
    df = spark.createDataFrame([(r[0], r[4], r[3], r[1], r[2], r[5]) for r in rows], "site_id long, ts_us long, kind string, event_id string, camera string, label string")
    named = lambda s: s.select("site_id", "ts", F.col("type").alias("kind"), "event_id", "camera", F.col("text").alias("label"))
    for stream, batch in ((A.stream_incidents_exact, K.exact_incidents), (A.stream_short_long, K.short_long)):
        got = [tuple(r) for r in run([*shuffled(rows, 4), *END], lambda s, f=stream: f(named(s)), "append", 5) if r.site_id != 9]
        want = [tuple(r) for r in batch(df).collect()]
        assert len(want) > 20 and sorted(got, key=repr) == sorted(want, key=repr)


def test_state_survives_a_restart(spark, tmp_path):
    """Batches run one by one, each in a query of its own from the checkpoint, give what one run gives."""
    rows = [*shuffled(incident_rows(5), 6), *END]
    src, n = str(tmp_path / "in"), 4
    size = -(-len(rows) // n)
    schema = "site_id long, ts timestamp, kind string, event_id string, camera string"

    def add(k):
        part = [(r[0], r[4] / 1e6, r[3], r[1], r[2]) for r in rows[k * size : (k + 1) * size]]
        spark.createDataFrame(part, schema.replace("timestamp", "double")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)

    def go(name):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src)
        q = A.stream_incidents_exact(stream).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
        q.awaitTermination(180)

    for k in range(n):
        add(k)
        go("pieces")
    go("whole")
    pieces, whole = (sorted(map(tuple, spark.read.parquet(str(tmp_path / x)).filter("site_id <> 9").collect())) for x in ("pieces", "whole"))
    df = spark.createDataFrame([(r[0], r[4], r[3], r[1], r[2]) for r in rows], "site_id long, ts_us long, kind string, event_id string, camera string")
    assert pieces == whole == sorted(map(tuple, K.exact_incidents(df).filter("site_id <> 9").collect())) and len(whole) > 10


def test_snoozes_are_judged_at_the_time_of_each_target(spark, tmp_path):
    rng, at0 = random.Random(7), 900_000 * S
    targets = [(i, at0 + rng.randint(0, 2000) * S, rng.sample(["a", "b", "c"], rng.randint(0, 3))) for i in range(80)]
    snoozes = [(rng.choice("abc"), at0 + rng.randint(0, 2000) * S, at0 + rng.randint(0, 3000) * S, rng.random() < 0.8) for _ in range(25)]
    t = spark.createDataFrame(targets, "target_id long, ts_us long, cameras array<string>")
    z = spark.createDataFrame(snoozes, "camera string, set_us long, expiration_us long, f boolean")
    end = [(999, at0 + 90_000 * S, ["q"]), (998, at0 + 90_001 * S, ["q"])]
    for name, rows, schema, time in (("t", [*targets, *end], t.schema, 1), ("z", [*snoozes, ("q", at0 + 90_000 * S, at0, False), ("q", at0 + 90_001 * S, at0, False)], z.schema, 1)):
        arrive = sorted(rows, key=lambda r: r[time] + rng.randint(0, 500) * S)
        for k in range(0, len(arrive), 30):
            spark.createDataFrame(arrive[k : k + 30], schema).withColumn("ts", F.timestamp_micros("ts_us" if name == "t" else "set_us")).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name: spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / name))
    A.stream_snooze(read("t"), read("z"), "f", str(tmp_path / "out"), str(tmp_path / "cp"), late="30 minutes").awaitTermination(180)
    got = {r.target_id: r.suppressed for r in spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out")).collect() if r.target_id < 900}
    want = {r.target_id: r.suppressed for r in J.suppress_snoozed(t, z, "f").collect()}
    assert got == want and len(set(want.values())) == 2
