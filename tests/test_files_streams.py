"""File sources and streams on small folders."""

import json
import os

import pytest

from camwatch.operators import croppath as K
from camwatch.operators import notify as N
from camwatch.operators import timeline as L
from camwatch.sources import files as S
from camwatch.sources import messages as M
from camwatch.streaming import stateful as A
from camwatch.streaming import streams as T


def store(root):
    a = root / "door" / "1700_x"
    a.mkdir(parents=True)
    (a / "summary.txt").write_text("Title: Person\nDescription: A: b")
    (a / "metadata.json").write_text("{bad")
    (a / "clip.MP4").write_bytes(b"1234")
    (a / "notification_timeline.json").write_text(json.dumps({"entries": [{"ts": "1"}, {"ts": "2"}]}))
    (a / "notification_timeline_append.jsonl").write_text('{"ts":"3"}\nbad\n')
    (a / "detection.json").write_text('[{"frame_number":0,"timestamp_sec":0.0,"detections":[]},{"frame_number":5,"timestamp_sec":1.0,"detections":[{"label":"person","bbox":[1,2,3,4],"area":4}]}]')
    b = root / "door" / "1800_y"
    b.mkdir()
    (b / ".viewed").write_text("")
    (b / "other.bin").write_text("x")
    return root


def test_store(spark, tmp_path):
    root = f"file://{store(tmp_path / 'store')}"
    rows = {r.folder: r for r in S.read_event_store(spark, root).collect()}
    r = rows["door/1700_x"]
    assert (r.title, r.metadata, r.has_clip, r.viewed) == ("Person", "{}", True, False)
    assert [json.loads(x.entry)["ts"] for x in S.read_timeline(spark, root).orderBy("part", "pos").collect()] == ["1", "2", "3"]
    d = S.read_sidecars(spark, root).orderBy("frame_number").collect()
    assert [(x.frame_number, x.label, x.x2, x.native_width) for x in d] == [(0, None, None, 0), (5, "person", 3.0, 0)]


def test_store_whole(spark, tmp_path):
    root = store(tmp_path / "store")
    inc = root / "events" / "1900_zz"
    for cam in ("yard", "door", ".hidden"):
        (inc / cam).mkdir(parents=True)
    (inc / "review_summary.md").write_text(" Two people.\n")
    (inc / "notification_timeline_append.jsonl").write_text('{"ts":"1","data":{"event_id":"x"}}\n\nnot json\n')
    for k, name in enumerate(("old.mp4", "new.MP4")):
        (inc / "yard" / name).write_bytes(b"1")
        os.utime(inc / "yard" / name, (1000 + k, 1000 + k))
    (inc / "yard" / "metadata.json").write_text('{"threat": 2}')
    (inc / "door" / "snapshot.jpg").write_bytes(b"1")
    (inc / "door" / "metadata.json").write_text("{bad")
    (inc / ".hidden" / "x").write_text("")
    (root / "door" / "1700_x" / "snapshot.jpg").write_bytes(b"1")
    rows = {r.folder: r for r in S.read_event_store(spark, f"file://{root}").collect()}
    r = rows["events/1900_zz"]
    assert (r.title, r.summary, r.metadata, r.event_id, r.review_summary, r.has_clip, r.clip, r.cameras) == ("Analysis pending...", None, "{}", "zz", "Two people.", False, None, ["door", "yard"])
    assert [json.loads(x)["ts"] for x in r.timeline] == ["1"]
    assert tuple(r.subfolders["yard"]) == (True, "new.MP4", False, '{"threat": 2}') and tuple(r.subfolders["door"]) == (False, None, True, None)
    x = rows["door/1700_x"]
    assert (x.title, x.event_id, x.clip, x.has_snapshot, x.viewed, x.cameras, [json.loads(e)["ts"] for e in x.timeline]) == ("Person", "x", "clip.MP4", True, False, [], ["1", "2", "3"])
    assert rows["door"].cameras == ["1700_x", "1800_y"] and rows["door/1800_y"].viewed and rows["events"].cameras == ["1900_zz"]


def test_center_points_and_frame_sizes(spark):
    d = [(1, "a", 0, 0, 0, 10, 10, None, None, 4), (1, "a", 0, None, None, None, None, 50.0, 20.0, 1), (1, "a", 0, None, 1, 2, 3, None, None, 9), (1, "b", 0, None, None, None, None, None, None, 9)]
    df = spark.createDataFrame(d, "incident_id long, camera string, t int, x1 int, y1 int, x2 int, y2 int, px double, py double, area long")
    got = {r.camera: (r.cx, r.cy, r.n) for r in K.entry_boxes(df).collect()}
    assert got == {"a": ((5 * 4 + 50) / 5, (5 * 4 + 20) / 5, 3), "b": (None, None, 1)}
    curves = spark.createDataFrame([(n, c, 0, 100) for n in (1, 2, 3, 4) for c in "ab"], "incident_id long, camera string, idx int, area long")
    sizes = spark.createDataFrame([(1, "a", 10, 10), (1, "b", 20, 10), (2, "a", 10, 10), (2, "b", 10, 10), (3, "a", 10, 10), (4, "a", 0, 0)], "incident_id long, camera string, native_width int, native_height int")
    assert {(r.incident_id, r.camera): r.area for r in L.share_of_frame(curves, sizes).collect()} == {(1, "a"): 1.0, (1, "b"): 0.5, (2, "a"): 100.0, (2, "b"): 100.0, (3, "a"): 1.0, (3, "b"): 100.0, (4, "a"): 100.0, (4, "b"): 100.0}


def event(kind, e, s):
    return json.dumps({"type": kind, "event_id": e, "site_id": 1, "ts": f"2024-01-01T00:00:{s:02d}Z"})


def test_stream_matches_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = [{"topic": "events", "payload": event(t, e, s), "ingest_ts": "2024-01-01T00:00:00Z"} for t, e, s in (("new", "a", 1), ("description", "a", 2), ("end", "a", 3), ("end", "zz", 4))]
    (src / "1.json").write_text("\n".join(map(json.dumps, lines)) + '\n{"topic":"events","payload":"{bad"}')
    body = T.stream_route(M.read_messages(spark, f"file://{src}")).filter("body.event_id is not null").select("body.*")
    q = A.stream_event_state(body).writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path / 'cp'}").start()
    q.awaitTermination(120)
    assert [(r.event_id, r.phase, r.ended) for r in spark.table("states").collect()] == [("a", "DESCRIBED", True)]


def test_message_log_is_read_once_over_restarts(spark, tmp_path):
    """Lines are appended between runs, some in two writes; every message comes once, bad bodies go to the dead letters."""
    src, sent = tmp_path / "log", []
    for topic in ("events", "cam_1/tracked_object_update"):
        (src / topic).mkdir(parents=True)
    half = ""
    for run in range(4):
        for topic in ("events", "cam_1/tracked_object_update"):
            for k in range(25):
                text = "{bad" if k == 7 else '"text"' if k == 8 else event("new", f"{run}-{topic}-{k}é", k)
                sent.append((topic, text))
                with (src / topic / f"{run // 2}.log").open("a") as out:
                    out.write(half + text + "\n" if topic == "events" else text + "\n")
                half = "" if topic == "events" else half
        half = event("new", f"half{run}", 1)  # written without its end, read once that is there
        with (src / "events" / f"{run // 2}.log").open("a") as out:
            out.write(half[:20])
        half = half[20:] + "\n"
        if run % 2:  # the next run writes to another file
            with (src / "events" / f"{run // 2}.log").open("a") as out:
                out.write(half)
            half = ""
        stream = M.read_messages(spark, f"file://{src}", "log", chunk=700)
        M.dead_letter_sink(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    read = lambda name: spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / f"out/{name}")).collect()
    rows, dead = read("rows"), read("dead")
    assert len({(r.topic, r.segment, r.offset) for r in [*rows, *dead]}) == len(rows) + len(dead)
    want = sorted([*sent, *(("events", event("new", f"half{k}", 1)) for k in range(4))])
    assert sorted((r.topic, r.payload) for r in [*rows, *dead]) == want
    assert {r.payload for r in dead} == {"{bad", '"text"'} and len(dead) == 16 and all(r.body.event_id for r in rows)
    with pytest.raises(ValueError, match="no such format"):
        M.read_messages(spark, "x", "xml")


def test_four_kinds_of_timeline_entries(spark, tmp_path):
    rows = {
        "hub": spark.createDataFrame([("f", "new", '{"a": 1}'), (None, "new", "{}")], "folder string, status string, payload string"),
        "message": spark.createDataFrame([("f", "cam/\"x", "{bad", "Seen"), ("f", "t", '{"b": [1, 2]}', "Seen")], "folder string, topic string, payload string, label string"),
        "api": spark.createDataFrame([("f", "in", "Export", '{"code": 200}', "2024-01-01T00:00:00")], "folder string, direction string, label string, payload string, ts string"),
    }
    n = spark.createDataFrame([(1, "f", "new")], "notification_id long, folder string, status string")
    res = spark.createDataFrame([(1, "p", "sent", "m")], "notification_id long, provider string, status string, message string")
    rows["dispatch"] = N.dispatch_log(n, res)
    for kind, df in rows.items():
        S.append_timeline(S.timeline_entries(df, kind), str(tmp_path / "line"), "2024-02-02T09:00:00")
    got = spark.read.schema("folder string, ts string, source string, direction string, label string, data string").json(str(tmp_path / "line")).collect()
    assert sorted((r.source, r.direction, r.label, json.dumps(json.loads(r.data)), r.ts[:10]) for r in got) == [
        ("api", "in", "Export", '{"code": 200}', "2024-01-01"),
        ("hub_notification", "out", "Sent to hub: new", '{"a": 1}', "2024-02-02"),
        ("message", "in", "Seen", '{"topic": "cam/\\"x", "payload": null}', "2024-02-02"),
        ("message", "in", "Seen", '{"topic": "t", "payload": {"b": [1, 2]}}', "2024-02-02"),
        ("notification_dispatch", "out", "Notification: new — p: sent", '{"event_phase": "new", "results": [{"provider": "p", "status": "sent", "message": "m"}]}', "2024-02-02"),
    ]


def test_daily_aggregate_missing_or_empty(spark, tmp_path):
    (tmp_path / "aggregate_2024-01-05.jsonl").write_text('{"event_id": "a", "threat": 2}\n[1]\nbad\n\n {"event_id": "b"} \n')
    (tmp_path / "aggregate_2024-01-06.jsonl").write_text("")
    read = lambda d: S.read_daily_aggregate(spark, str(tmp_path), d)
    assert [(r.event_id, r.threat) for r in read("2024-01-05").collect()] == [("a", 2), ("b", None)]
    assert read("2024-01-06").collect() == [] and read("2024-01-07") is None


def test_sinks_round_trip(spark, tmp_path):
    path = lambda name: str(tmp_path / name)
    day = lambda d, v: spark.createDataFrame([(d, v)], "report_date string, v int").selectExpr("cast(report_date as date) as report_date", "v")
    for d, v in (("2024-01-05", 1), ("2024-01-05", 2), ("2024-01-06", 3)):
        S.append_daily_aggregate(day(d, v), path("daily"))
    assert sorted(r.v for r in S.read_daily_aggregate(spark, path("daily"), "2024-01-05", "v int").collect()) == [1, 2]
    S.append_timeline(spark.createDataFrame([("2024-02-01T00:00:01", "a"), (None, "b")], "ts string, label string"), path("line"), "2024-02-02T09:00:00")
    got = spark.read.schema("ts string, label string, date string").json(path("line"))
    assert {(r.ts, r.label, r.date) for r in got.collect()} == {("2024-02-01T00:00:01", "a", "2024-02-01"), ("2024-02-02T09:00:00", "b", "2024-02-02")}
    S.write_sidecar_table(spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "x int, incident_date string"), path("side"))
    S.write_sidecar_table(spark.createDataFrame([(3, "2024-01-01")], "x int, incident_date string"), path("side"))
    assert [r.x for r in spark.read.parquet(path("side")).collect()] == [3]
    assert [r.v for r in S.report_for_date(spark.read.json(path("daily")), "2024-01-06").collect()] == [3]


def test_timeline_sink(spark, tmp_path):
    spark.createDataFrame([("2024-02-01T00:00:01", "a"), (None, "b")], "ts string, label string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts string, label string").json(str(tmp_path / "in"))
    T.timeline_sink(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "2024-02-02T09:00:00").awaitTermination(120)
    assert {r.label for r in spark.read.json(str(tmp_path / "out")).collect()} == {"a", "b"}
