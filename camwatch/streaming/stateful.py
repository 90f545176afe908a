"""Stateful streams on Spark's arbitrary-state API, with the RocksDB store: only entries that change are written.

Rules whose result depends on the order of rows see them in the order of event time:
rows wait in a map until the watermark has passed them (``InOrder``). So a stream gives
what the batch operator gives for the same rows, however they arrive within the
watermark. Rows behind it are dropped by Spark; ``late.split_late`` keeps them.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from camwatch.operators.closing import CLOSED, MEMBERSHIP, CloseTimer, Incident, closed_row, frame_of, membership_row
from camwatch.operators.notify import RateLimit

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Frames that are remembered of an event.
RING = 500


def transformed(rows: DataFrame, by: str, processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    """A state of its own for each key. The API needs the RocksDB store: the session is set to it."""
    rows.sparkSession.conf.set(PROVIDER, ROCKSDB)
    return rows.groupBy(by).transformWithStateInPandas(processor, outputStructType=schema, outputMode=mode, timeMode="EventTime")


class EventState(StatefulProcessor):
    """An event's phase and texts as one value, the times of its last frames as a ring in a map: a frame rewrites one slot.

    A timer forgets the event ``keep_s`` after its last message.
    """

    def __init__(self, keep_s: int):
        self.keep_ms = keep_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.event = handle.getValueState("event", "phase string, ai_description string, description string, summary string, ended boolean, frames long, due_ms long")
        self.ring = handle.getMapState("ring", "slot int", "at_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        phase, told, text, summary, ended, frames, due = self.event.get() or ("", "", "", "", False, 0, -1)
        known, seen = bool(phase), 0
        if 0 <= due <= timerValues.getCurrentWatermarkInMs():  # its timer is due, but rows come first in a batch
            self._forget(due)
            phase, told, text, summary, ended, frames, due, known = "", "", "", "", False, 0, -1, False
        for m in pd.concat(list(rows)).sort_values(["at_us", "rank"], kind="stable").itertuples():
            seen = max(seen, int(m.at_us))
            if m.type in ("new", "update") and not phase:
                phase = "NEW"
            elif not phase:
                continue
            elif m.type == "description":
                phase, told = ("DESCRIBED" if phase == "NEW" else phase), m.text or ""
            elif m.type == "review":
                phase, text = "FINALIZED", m.text or ""
            elif m.type == "summary":
                phase, summary = "SUMMARIZED", m.text or ""
            elif m.type == "frame":
                self.ring.updateValue((int(frames % RING),), (int(m.at_us),))
                frames += 1
            elif m.type == "end":
                ended = True
            elif m.type == "remove":
                phase, told, text, summary, ended, frames = "", "", "", "", False, 0
                self.ring.clear()
        if not phase:
            if known:
                self._forget(due)
            return
        last = max(due, max(seen // 1000, timerValues.getCurrentWatermarkInMs()) + self.keep_ms)
        if last != due:
            if due >= 0:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(last)
        self.event.update((phase, told, text, summary, ended, int(frames), int(last)))
        yield frame_of([(key[0], phase, told, text, summary, ended, min(int(frames), RING))], EVENT)

    def _forget(self, due: int) -> None:
        if due >= 0:
            self.handle.deleteTimer(due)
        self.event.clear()
        self.ring.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.event.clear()
        self.ring.clear()
        return iter(())

    def close(self) -> None:
        pass


EVENT = "event_id string, phase string, ai_description string, description string, summary string, ended boolean, frames long"
#: Order of messages at the same time: what creates an event first, what ends or removes it last. Fixed values.
RANKS = {"new": 0, "update": 1, "frame": 2, "description": 3, "review": 4, "summary": 5, "end": 6, "remove": 7}


def stream_event_state(messages: DataFrame, late: str = "10 minutes", keep_s: int = 3600) -> DataFrame:
    """Per event its state after each batch: created by the first new or update, described, finalized, summarized, ended.

    It is forgotten ``keep_s`` after its last message, or when it is removed. A message
    about an event that wasn't created is ignored, a second end too. Texts of
    descriptions, reviews and summaries are kept apart. Of ``frame`` messages the times
    of the last 500 are kept, and counted. Rows without an id are left out.
    """
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv))[F.col("type")], F.lit(9))
    rows = messages.filter("event_id is not null").withWatermark("ts", late)
    rows = rows.select("event_id", "ts", F.unix_micros("ts").alias("at_us"), "type", rank.alias("rank"), F.col("text").cast("string").alias("text"))
    return transformed(rows, "event_id", EventState(keep_s), EVENT, "Update")


class InOrder(StatefulProcessor):
    """Rows that wait until the watermark has passed them, then are seen in order of time and ``tie``.

    A rule says what a row does (``see``), what happens by itself up to a time
    (``until``), and when it wants to be asked next (``wake``). One timer stands for the
    first thing that is due.
    """

    #: What a row holds besides ``at_us`` and ``tie``, and what the rule puts out.
    row, out = "", ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "at_us long, tie string", self.row)
        self.timer = handle.getValueState("timer", "at_ms long")
        self.names = [f.split()[0] for f in self.row.split(", ")]
        self.start(handle)

    def start(self, handle: StatefulProcessorHandle) -> None: ...
    def load(self) -> None: ...
    def save(self) -> None: ...
    def see(self, key, at_us: int, tie: str, row: tuple) -> list[tuple]: ...
    def until(self, key, now_us: int) -> list[tuple]: ...
    def wake(self) -> int | None: ...

    def _arm(self, at_us: int | None) -> None:
        """Fire when the watermark has passed this time, or earlier if a timer says so."""
        held = self.timer.get()
        due = None if at_us is None else at_us // 1000 + 1
        if due is None or (held and held[0] <= due):
            return
        if held:
            self.handle.deleteTimer(held[0])
        self.handle.registerTimer(due)
        self.timer.update((due,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            wanted = part[["at_us", "tie", *self.names]]
            for at, tie, *row in zip(*(wanted[c].where(wanted[c].notna(), None).tolist() for c in wanted), strict=True):
                first = at if first is None else min(first, at)
                self.rows.updateValue((at, tie), tuple(row))
        self._arm(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        keys = sorted(tuple(k) for k in self.rows.keys())
        due = [k for k in keys if k[0] <= now]
        self.load()
        out: list[tuple] = []
        for k in due:
            row = tuple(self.rows.getValue(k))
            self.rows.removeKey(k)
            out += self.until(key, k[0])
            out += self.see(key, *k, row)
        out += self.until(key, now)
        self.save()
        times = [t for t in (keys[len(due)][0] if len(due) < len(keys) else None, self.wake()) if t is not None]
        self._arm(min(times, default=None))
        if out:
            yield frame_of(out, self.out)

    def close(self) -> None:
        pass


class Closing(InOrder):
    """``CloseTimer`` as state: an entry for each open incident and each event that hasn't ended."""

    row = "kind string, event_id string, camera string, label string"

    def __init__(self, gap_s: int, members: bool, options: dict):
        self.gap_s, self.members, self.options = gap_s, members, options
        self.out = MEMBERSHIP if members else CLOSED

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "no long", "start_us long, last_us long, due_us long, ids array<string>, cameras array<string>, labels array<string>, primary_event string, primary_camera string, canceled boolean")
        self.running = handle.getMapState("running", "event_id string", "no long, start_us long")
        self.number = handle.getValueState("number", "active long, next long")

    def load(self) -> None:
        self.rule = CloseTimer(self.gap_s, **self.options)
        plain = lambda v: list(v) if hasattr(v, "__iter__") and not isinstance(v, str) else v
        self.before = {int(k[0]): tuple(plain(x) for x in v) for k, v in self.open.iterator()}
        self.rule.hold({k: Incident.of(v) for k, v in self.before.items()})
        self.started = {k[0]: (int(v[0]), int(v[1])) for k, v in self.running.iterator()}
        self.rule.starts = dict(self.started)
        active, self.rule.next = self.number.get() or (-1, 0)
        self.rule.active = active if active in self.rule.held else None

    def save(self) -> None:
        now = {k: x.row() for k, x in self.rule.held.items()}
        for k in [*self.before, *now]:
            if k not in now:
                self.open.removeKey((k,))
            elif now[k] != self.before.get(k):
                self.open.updateValue((k,), now[k])
        for e in [*self.started, *self.rule.starts]:
            if e not in self.rule.starts:
                self.running.removeKey((e,))
            elif self.rule.starts[e] != self.started.get(e):
                self.running.updateValue((e,), self.rule.starts[e])
        self.number.update((-1 if self.rule.active is None else self.rule.active, self.rule.next))

    def until(self, key, now_us: int) -> list[tuple]:
        closed = [closed_row(key[0], x) for x in self.rule.fire(now_us)]
        return [] if self.members else closed

    def see(self, key, at_us: int, tie: str, row: tuple) -> list[tuple]:
        kind, event, camera, label = row
        end = self.rule.see(kind, event, camera, label, at_us)
        return [membership_row(key[0], event, at_us, *end)] if end and self.members else []

    def wake(self) -> int | None:
        return min((x.due_us for x in self.rule.held.values() if x.due_us is not None), default=None)


def _closing(messages: DataFrame, gap_s: int, late: str, members: bool, options: dict) -> DataFrame:
    label = F.col("label").cast("string") if "label" in messages.columns else F.lit(None).cast("string")
    tie = F.concat((F.col("kind") == "end").cast("int").cast("string"), F.col("event_id"))
    rows = messages.filter("kind in ('new', 'end') and site_id is not null and event_id is not null").withWatermark("ts", late)
    rows = rows.select("site_id", "ts", F.unix_micros("ts").alias("at_us"), tie.alias("tie"), "kind", "event_id", "camera", label.alias("label"))
    return transformed(rows, "site_id", Closing(gap_s, members, options), MEMBERSHIP if members else CLOSED, "Append")


def stream_incidents_exact(messages: DataFrame, gap_s: int = 120, late: str = "10 minutes", **options) -> DataFrame:
    """``exact_incidents`` on a stream (site_id, ts, kind, event_id, camera, label): an incident comes once the watermark has passed its timer.

    Of two messages of a kind about one event at one time one counts.
    """
    return _closing(messages, gap_s, late, False, options)


def stream_short_long(messages: DataFrame, gap_s: int = 120, late: str = "10 minutes", **options) -> DataFrame:
    """``short_long`` on a stream: a row for each end of a known event, with its incident's members after it."""
    return _closing(messages, gap_s, late, True, options)


class Limiting(InOrder):
    """``RateLimit`` as state. It goes when nothing waits, nothing was sent within the window and no overflow is told."""

    row, out = "request_id string", "site_id long, request_id string, outcome string, sent_us long"

    def __init__(self, most: int, window_s: int, queue: int):
        self.most, self.window_s, self.queue = most, window_s, queue

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.limit = handle.getValueState("limit", "told boolean, clock_us long, sent array<long>, waiting array<string>")

    def load(self) -> None:
        told, clock, sent, waiting = self.limit.get() or (False, 0, [], [])
        self.rule = RateLimit(self.most, self.window_s, self.queue, bool(told))
        self.rule.clock, self.rule.sent, self.rule.waiting = int(clock), deque(map(int, sent)), deque(waiting)

    def save(self) -> None:
        r = self.rule
        if r.told or r.sent or r.waiting:
            self.limit.update((r.told, r.clock, list(r.sent), list(r.waiting)))
        else:
            self.limit.clear()

    def _rows(self, key, found) -> list[tuple]:
        return [(key[0], *x) for x in found]

    def until(self, key, now_us: int) -> list[tuple]:
        out = self._rows(key, self.rule.drain(now_us))
        self.rule.free(now_us)
        return out

    def see(self, key, at_us: int, tie: str, row: tuple) -> list[tuple]:
        return self._rows(key, self.rule.see(at_us, row[0]))

    def wake(self) -> int | None:
        r = self.rule
        return r.clock + 1_000_000 if r.waiting else r.sent[0] + r.win if r.sent else None


def stream_rate_limit(requests: DataFrame, most: int = 2, window_s: int = 5, queue: int = 10, late: str = "10 minutes") -> DataFrame:
    """``rate_limit`` on a stream (site_id, ts, event_id): each request once its outcome is known, a waiting one when it goes out or is dropped.

    Timers drain the queue, also if no message follows. Of requests with one id at one
    time one counts.
    """
    rows = requests.filter("site_id is not null and event_id is not null").withWatermark("ts", late)
    rows = rows.select("site_id", "ts", F.unix_micros("ts").alias("at_us"), F.col("event_id").alias("tie"), F.col("event_id").alias("request_id"))
    return transformed(rows, "site_id", Limiting(most, window_s, queue), Limiting.out, "Append")


class Capping(InOrder):
    """The rolling cap; its state is a list of what was admitted within the window, and goes with it."""

    row, out = "frames long", "site_id long, event_id string, admitted boolean"

    def __init__(self, cap: int, window_s: int):
        self.cap, self.window = cap, window_s * 1_000_000

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.admitted = handle.getListState("admitted", "at_us long, frames long")

    def load(self) -> None:
        self.held = [(int(t), int(n)) for t, n in self.admitted.get()]
        self.before = list(self.held)

    def save(self) -> None:
        if not self.held:
            self.admitted.clear()
        elif self.held[: len(self.before)] == self.before:
            self.admitted.appendList(self.held[len(self.before) :]) if len(self.held) > len(self.before) else None
        else:
            self.admitted.put(self.held)

    def until(self, key, now_us: int) -> list[tuple]:
        self.held = [(t, n) for t, n in self.held if t >= now_us - self.window]
        return []

    def see(self, key, at_us: int, tie: str, row: tuple) -> list[tuple]:
        ok = sum(n for _, n in self.held) + row[0] <= self.cap
        if ok:
            self.held.append((at_us, int(row[0])))
        return [(key[0], tie, ok)]

    def wake(self) -> int | None:
        return self.held[-1][0] + self.window + 1 if self.held else None


def stream_frame_cap(requests: DataFrame, cap: int = 200, window_s: int = 3600, late: str = "10 minutes") -> DataFrame:
    """``admitted`` per request (site_id, ts, event_id, frames): ``rolling_frame_cap`` on a stream. Of requests with one id at one time one counts."""
    rows = requests.filter("site_id is not null and event_id is not null").withWatermark("ts", late)
    rows = rows.select("site_id", "ts", F.unix_micros("ts").alias("at_us"), F.col("event_id").alias("tie"), F.col("frames").cast("long").alias("frames"))
    return transformed(rows, "site_id", Capping(cap, window_s), Capping.out, "Append")


class Snoozing(InOrder):
    """A camera's snooze: the last one set counts, and is forgotten when it has expired. Asks come back with what held at their time."""

    row = "asks boolean, target_id long, n_cameras long, expiration_us long, flag boolean"
    out = "camera string, target_id long, ts_us long, n_cameras long, held boolean"

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("snooze", "set_us long, expiration_us long, flag boolean")

    def load(self) -> None:
        held = self.now.get()
        self.before = self.snooze = (int(held[0]), int(held[1]), bool(held[2])) if held else None

    def save(self) -> None:
        if self.snooze is None:
            self.now.clear()
        elif self.snooze != self.before:
            self.now.update(self.snooze)

    def until(self, key, now_us: int) -> list[tuple]:
        self.snooze = None if self.snooze and self.snooze[1] <= now_us else self.snooze
        return []

    def see(self, key, at_us: int, tie: str, row: tuple) -> list[tuple]:
        asks, target, n, expires, flag = row
        if asks:
            return [(key[0], target, at_us, n, bool(self.snooze and self.snooze[1] > at_us and self.snooze[2]))]
        # of snoozes set at one time the one that lasts longest counts, as in the batch form
        if not self.snooze or (self.snooze[0], *self.snooze[1:]) < (at_us, expires, flag):
            self.snooze = (at_us, expires, flag)
        return []

    def wake(self) -> int | None:
        return self.snooze[1] if self.snooze else None


def snooze_answers(targets: DataFrame, snoozes: DataFrame, flag: str, late: str = "10 minutes") -> DataFrame:
    """For each target and each of its cameras whether it is snoozed at the target's time, once the watermark has passed it.

    ``targets``: target_id, ts, cameras; ``snoozes``: camera, ts (when it was set),
    expiration_us, and the flag. Both are streams; their union keeps one snooze a camera.
    A target without cameras comes at once, as not snoozed, with no camera.
    """
    cameras = F.array_distinct(F.coalesce("cameras", F.array().cast("array<string>")))
    none = F.when(F.size(cameras) == 0, F.array(F.lit(""))).otherwise(F.filter(cameras, lambda c: c.isNotNull()))
    n = F.greatest(F.size(F.filter(cameras, lambda c: c.isNotNull())), F.lit(1)).cast("long")
    tie = lambda kind, *c: F.concat(F.lit(kind), *(F.coalesce(x.cast("string"), F.lit("")) for x in c)).alias("tie")
    no, zero = F.lit(False), F.lit(0).cast("long")  # no nulls: a column of whole numbers with nulls would become one of fractions
    asks = targets.filter("target_id is not null").select(F.explode(none).alias("camera"), "ts", tie("1", F.col("target_id")), F.lit(True).alias("asks"), F.col("target_id").cast("long").alias("target_id"), n.alias("n_cameras"), zero.alias("expiration_us"), no.alias("flag"))
    until, on = F.coalesce(F.col("expiration_us").cast("long"), zero), F.coalesce(F.col(flag), no)
    marks = snoozes.filter("camera is not null").select("camera", "ts", tie("0", until, on), no.alias("asks"), zero.alias("target_id"), zero.alias("n_cameras"), until.alias("expiration_us"), on.alias("flag"))
    both = asks.withWatermark("ts", late).unionByName(marks.withWatermark("ts", late)).withColumn("at_us", F.unix_micros("ts"))
    return transformed(both, "camera", Snoozing(), Snoozing.out, "Append")


def suppressed(answers: DataFrame) -> DataFrame:
    """target_id, suppressed, from all answers of a target: they come in one batch, as they wait for the same time."""
    all_of = F.bool_and("held") & (F.count("*") >= F.max("n_cameras"))
    return answers.groupBy("target_id").agg(all_of.alias("suppressed"))


def stream_snooze(targets: DataFrame, snoozes: DataFrame, flag: str, path: str, checkpoint: str, late: str = "10 minutes"):
    """Append each target with ``suppressed`` to a table: ``suppress_snoozed`` on two streams. A batch that is run again replaces what it wrote."""

    def write(answers: DataFrame, batch: int) -> None:
        suppressed(answers).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return snooze_answers(targets, snoozes, flag, late).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
