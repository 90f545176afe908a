"""The crop path against brute force in plain Python."""

import math
import random

from camwatch.operators import croppath as K

W, H, TW, TH = 1920, 1080, 960, 540


def shift(center, size, full):
    return max(0, min(full - size, int(center - size / 2)))


def brute_crop(entries, t):
    if not entries:
        return shift(W / 2, TW, W), shift(H / 2, TH, H), TW, TH
    boxes = entries[min(entries, key=lambda e: (abs(e - t), e))]
    weigh = [max(a, 1) for *_, a in boxes]
    cx = sum((b[0] + b[2]) * a for b, a in zip(boxes, weigh)) / (2 * sum(weigh))
    cy = sum((b[1] + b[3]) * a for b, a in zip(boxes, weigh)) / (2 * sum(weigh))
    x1, y1, x2, y2 = (f(b[i] for b in boxes) for i, f in enumerate((min, min, max, max)))
    px, py = max((x2 - x1) * 0.1, 1), max((y2 - y1) * 0.1, 1)
    area = (min(W, x2 + px) - max(0, x1 - px)) * (min(H, y2 + py) - max(0, y1 - py))
    w = max(int(W * 0.4), min(W, int(math.sqrt(area / 0.4 * (TW / TH))))) & ~1
    h = max(int(H * 0.4), min(H, int(math.sqrt(area / 0.4 * (TH / TW))))) & ~1
    return shift(cx, w, W), shift(cy, h, H), w, h


def brute_path(cams, crops):
    crops = [[a, a if i + 1 < len(cams) and cams[i + 1] != cams[i] else b] for i, (a, b) in enumerate(crops)]
    for side in (0, 1):
        zoom = sx = sy = None
        for i, cam in enumerate(cams):
            x, y, w, h = crops[i][side]
            raw = max(0.4, min(1.0, math.sqrt(w * h / (W * H))))
            zoom = 0.25 * raw + 0.75 * zoom if i and cams[i - 1] == cam else raw
            nw, nh = int(math.sqrt(zoom * zoom * (W * H) * (TW / TH))), int(math.sqrt(zoom * zoom * (W * H) / (TW / TH)))
            nw, nh = min(W, nw) & ~1, min(H, nh) & ~1
            cx, cy = shift(x + w / 2, nw, W) + nw / 2, shift(y + h / 2, nh, H) + nh / 2
            if i and cams[i - 1] == cam:
                cx, cy = 0.3 * cx + 0.7 * sx, 0.3 * cy + 0.7 * sy
            sx, sy = max(nw / 2, min(W - nw / 2, cx)), max(nh / 2, min(H - nh / 2, cy))
            crops[i][side] = int(sx - nw / 2), int(sy - nh / 2), nw, nh
    for i in range(1, len(cams)):
        if cams[i] == cams[i - 1]:
            crops[i][0] = crops[i - 1][1]
    return crops


def test_crop_path_against_brute_force(spark):
    rng = random.Random(5)
    cams = ["a", "a", "a", "b", "b", "c", "a", "a"]
    seen = {(n, c): {} for n in (1, 2) for c in "ab"}
    rows = []
    for (n, c), entries in seen.items():
        for t in rng.sample(range(20), 9):
            for _ in range(rng.randint(1, 3)):
                x, y, w, h = rng.randint(0, 1500), rng.randint(0, 800), rng.randint(1, 900), rng.randint(1, 500)
                entries.setdefault(t, []).append((x, y, x + w, y + h, w * h))
                rows.append((n, c, t, x, y, x + w, y + h, w * h))
    sidecar = spark.createDataFrame(rows, "incident_id long, camera string, t int, x1 int, y1 int, x2 int, y2 int, area long")
    plan = [(n, i, c, 2.0 * i, 2.0 * i + 2.0) for n in (1, 2) for i, c in enumerate(cams)]
    slices = spark.createDataFrame(plan, "incident_id long, idx int, camera string, start_sec double, end_sec double")
    s = K.crop_ends(slices, sidecar).cache()
    names = [[f"{side}_{c}" for c in "xywh"] for side in ("start", "end")]
    crops = {(r.incident_id, r.idx): [tuple(r[x] for x in side) for side in names] for r in s.collect()}
    assert crops == {(n, i): [brute_crop(seen.get((n, c), {}), t) for t in (a, b)] for n, i, c, a, b in plan}
    assert len({x[2] for v in crops.values() for x in v}) > 3  # the zoom follows the content
    want = {n: brute_path(cams, [crops[n, i] for i in range(len(cams))]) for n in (1, 2)}
    path = K.crop_path(s)
    assert sorted(path.collect()) == sorted(K.crop_plan(slices, sidecar).collect())
    assert {(r.incident_id, r.idx): [tuple(r[x] for x in side) for side in names] for r in path.collect()} == {(n, i): v for n in want for i, v in enumerate(want[n])}
    for r in K.resample_path(path, 2).collect():
        a, b = want[r.incident_id][r.idx]
        assert (r.x, r.y, r.w, r.h) == tuple(max(2 * (k > 1), int(p + (q - p) * (r.sample / 3)) & ~1) for k, (p, q) in enumerate(zip(a, b)))


def test_the_fold_goes_on_over_batches():
    """Against brute force, in batches of every size: what goes on does so from a batch to the next, and no incident begins with another's."""
    import pyarrow as pa

    rng, rows, want = random.Random(3), [], []
    for n in range(30):
        cams = [c for _ in range(rng.randint(1, 5)) for c in [rng.choice("ab")] * rng.randint(1, 9)]
        crops = [[(rng.randint(0, W // 2), rng.randint(0, H // 2), rng.randint(2, W // 2), rng.randint(2, H // 2)) for _ in "se"] for _ in cams]
        held = [[a, a if i + 1 < len(cams) and cams[i + 1] != cams[i] else b] for i, (a, b) in enumerate(crops)]
        rows += [{"incident_id": n, "same": i > 0 and cams[i - 1] == cams[i]} | {f"{side}_{c}": v for side, crop in zip(("start", "end"), held[i]) for c, v in zip("xywh", crop)} for i in range(len(cams))]
        want += [(n, *a, *b) for a, b in brute_path(cams, crops)]
    whole = pa.Table.from_pylist(rows)
    for size in (1, 2, 7, 100, len(rows)):
        got = pa.Table.from_batches(K.fold_crops(iter(whole.to_batches(max_chunksize=size)), W, H, TW, TH))
        assert [tuple(r.values()) for r in got.to_pylist()] == want, size


def test_an_end_is_looked_up_not_sorted(spark):
    """Crops of ends with and without a time, a camera or entries; the plan sorts slices, never their ends."""
    sidecar = spark.createDataFrame([(1, "a", 4, 0, 0, 90, 50, 9), (1, "a", 8, 900, 500, 1000, 600, 9), (1, "b", None, 0, 0, 90, 50, 9), (None, "a", 4, 0, 0, 90, 50, 9), (1, None, 4, 0, 0, 90, 50, 9)], "incident_id long, camera string, t int, x1 int, y1 int, x2 int, y2 int, area long")
    slices = spark.createDataFrame([(1, 0, "a", 6.0, 6.5), (1, 1, "a", None, 99.0), (1, 2, "b", 0.0, 4.0), (1, 3, None, 4.0, 4.0), (2, 0, "a", 4.0, 8.0), (None, 0, "a", 4.0, 8.0)], "incident_id long, idx int, camera string, start_sec double, end_sec double")
    early, late, middle = (0, 0, 768, 432), (566, 334, 768, 432), (480, 270, 960, 540)
    ends = K.crop_ends(slices, sidecar)
    got = {(r.incident_id, r.idx): (tuple(r[f"start_{c}"] for c in "xywh"), tuple(r[f"end_{c}"] for c in "xywh")) for r in ends.collect()}
    assert got == {(1, 0): (early, late), (1, 1): (middle, late), (1, 2): (middle, middle), (1, 3): (middle, middle), (2, 0): (middle, middle), (None, 0): (middle, middle)}
    for time in ("start_sec", "end_sec"):
        assert {(r.incident_id, r.idx): (r.x, r.y, r.w, r.h) for r in K.crop_at(slices, sidecar, time).collect()} == {k: v[time == "end_sec"] for k, v in got.items()}
    plan = ends._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Union" not in plan


def test_curves_and_short_runs_without_joins(spark):
    """Against brute force: areas of the nearest entry, earlier on ties; short runs; and incidents are shuffled once."""
    from pyspark.sql import functions as F

    from camwatch.operators import timeline as L

    rng = random.Random(11)
    rows = [(i, c, t, rng.randint(0, 9)) for i in range(40) for c in "abc"[: rng.randint(1, 3)] for t in rng.sample(range(-3, 110), rng.randint(1, 9))]
    rows += [(90, "a", None, 5), (90, "b", 6, 2), (90, "b", None, 7), (91, "a", -4, 1)]
    entries = spark.createDataFrame(rows, "incident_id long, camera string, t int, area long")
    for step, cap in ((2.0, 45), (2.5, 7)):
        want = {}
        for i in {r[0] for r in rows}:
            ends = max((r[2] for r in rows if r[0] == i and r[2] is not None), default=-1)
            for c in {r[1] for r in rows if r[0] == i}:
                own = [(r[2], r[3]) for r in rows if r[:2] == (i, c) and r[2] is not None]
                for k in range(min(int(ends // step), cap - 1) + 1 if ends > 0 else 0):
                    want[i, c, k] = (k * step, min(own, key=lambda e: (abs(e[0] - k * step), e[0]))[1] if own else None)
        got = L.area_curves(entries, step, cap).collect()
        assert {(r.incident_id, r.camera, r.idx): (r.t, r.area) for r in got} == want and len(got) == len(want)
    cams = {i: [c for _ in range(9) for c in [rng.choice("ab")] * rng.randint(1, 7)] for i in range(30)}
    points = spark.createDataFrame([(i, k, k * 2.0, c) for i, cs in cams.items() for k, c in enumerate(cs)], "incident_id long, idx int, t double, camera string")
    got = {(r.incident_id, r.idx): r.camera for r in L.merge_short_runs(points, 5).collect()}
    for i, cs in cams.items():
        runs = [[cs[0], 0]]
        for c in cs:
            if c != runs[-1][0]:
                runs.append([c, 0])
            runs[-1][1] += 1
        merged = [c if n >= 5 else runs[k - 1][0] if k else runs[k + 1][0] if len(runs) > 1 else c for k, (c, n) in enumerate(runs)]
        assert [got[i, k] for k in range(len(cs))] == [m for m, (_, n) in zip(merged, runs) for _ in range(n)]
    sidecar = entries.withColumn("label", F.lit("person"))
    plan = L.camera_timeline(sidecar)._jdf.queryExecution().executedPlan().toString()
    assert {x.split("]")[0] for x in plan.split("hashpartitioning(")[1:]} and all(x.startswith("incident_id") and "camera" not in x.split(")")[0] for x in plan.split("hashpartitioning(")[1:])


def test_nearest_rows_of_bounded_keys(spark):
    """Uncut keys give what cut ones give, by one sort of the left side; a row without a time matches nothing."""
    from pyspark.sql import functions as F

    from camwatch.operators import joins as J

    rng = random.Random(2)
    right = spark.createDataFrame([(k, rng.randint(-20, 60) * 1.0, n, rng.random() < 0.4) for k in "abc" for n in range(15)], "k string, t double, n int, f boolean")
    left = spark.createDataFrame([(rng.choice("abcd"), rng.randint(-60, 240) / 2.0, i) for i in range(400)] + [("a", None, 900)], "k string, t double, i int")
    for ahead in (True, False):
        both = [{r.i: (r.any, r.some) for r in J.nearest_rows(left, right, ["k"], "t", {"any": F.lit(True), "some": F.col("f")}, cell, ahead).collect()} for cell in (None, 7)]
        assert both[0] == both[1] and len(both[0]) == 401 and both[0][900] == (None, None)


def test_the_area_hook_reads_each_entry_once():
    from camwatch.plans.video_queries import NearestArea

    reads = []

    class Entry(dict):
        def __getitem__(self, name):
            reads.append(name)
            return dict.__getitem__(self, name)

    rng = random.Random(1)
    for _ in range(50):
        entries = [Entry(t=float(t), area=t * 7) for t in sorted(rng.sample(range(100), rng.randint(1, 12)))]
        reads.clear()
        got = list(NearestArea.func().eval(1, "a", 100.0, entries))
        assert len(reads) == 2 * len(entries)
        assert got == [(k * 2.0, min(entries, key=lambda e: (abs(e["t"] - k * 2.0), e["t"]))["area"]) for k in range(45)]
