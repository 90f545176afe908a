"""Incidents by the exact close-timer rule: membership, discards, and closing."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from camwatch.operators.segments import cut_where_idle

SECOND = 1_000_000


@dataclass
class Incident:
    """One that hasn't closed. ``due_us`` is when it closes, if a timer is armed.

    ``members`` are ids, in order, with their starts; ``more`` counts those that are known only by number.
    """

    start_us: int
    last_us: int
    due_us: int | None = None
    members: OrderedDict[str, int] = field(default_factory=OrderedDict)
    cameras: list[str] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    primary_event: str | None = None
    primary_camera: str | None = None
    canceled: bool = False
    more: int = 0

    @property
    def ids(self) -> list[str]:
        return list(self.members)

    @property
    def n_events(self) -> int:
        return len(self.members) + self.more

    def row(self) -> tuple:
        """All but ``more``, with the ids in place of the members."""
        return self.start_us, self.last_us, self.due_us, self.ids, list(self.cameras), list(self.labels), self.primary_event, self.primary_camera, self.canceled

    @classmethod
    def of(cls, row: tuple) -> Incident:
        start, last, due, ids, cameras, labels, *others = row
        return cls(start, last, due, OrderedDict.fromkeys(ids, start), list(cameras), list(labels), *others)


class CloseTimer:
    """The rule for one site, over messages in order of time.

    A start joins the active incident if less than the gap has passed since the last
    start or kept end in it; else it opens a new one, and the old one goes on without new
    members. Only a kept end arms an incident's timer, or re-arms it: a start doesn't.
    When the timer fires the incident closes with its members, open ones too. An event
    shorter than ``least_s`` is discarded: its id leaves, the primary moves on to the
    next id and to the first camera, while start, cameras and labels stay; an incident
    without ids is gone. An event of ``most_s`` or more cancels; its end counts like a
    kept one unless ``close_canceled`` is off. An incident none of whose members ever
    ends doesn't close.

    A message takes constant time, however many events and incidents are open. An event
    that is said to start ``once`` needn't be known by its id: once the primary event
    can't be discarded any more its incident only counts it.
    """

    def __init__(self, gap_s: int = 120, least_s: int = 5, most_s: int = 120, close_canceled: bool = True):
        self.gap, self.least, self.most, self.close_canceled = gap_s * SECOND, least_s * SECOND, most_s * SECOND, close_canceled
        self.held: dict[int, Incident] = {}
        self.starts: dict[str, tuple[int, int]] = {}  # of events that haven't ended: incident, start
        self.known: set[str] = set()  # ids in incidents
        self.due: list[tuple[int, int]] = []  # timers, also those that were re-armed since
        self.active: int | None = None
        self.next = 0

    def hold(self, held: dict[int, Incident]) -> None:
        """Go on with these incidents."""
        self.held, self.known = held, {e for x in held.values() for e in x.members}
        self.due = [(x.due_us, k) for k, x in held.items() if x.due_us is not None]
        heapify(self.due)

    def fire(self, now: int | None) -> Iterator[Incident]:
        """Close what is due, in order; everything that has a timer if there is no end."""
        while self.due and (now is None or self.due[0][0] <= now):
            at, k = heappop(self.due)
            closed = self.held.get(k)
            if closed is None or closed.due_us is None:
                continue
            if closed.due_us != at:
                heappush(self.due, (closed.due_us, k))
                continue
            del self.held[k]
            for e in closed.members:
                self.known.discard(e)
                self.starts.pop(e, None)
            self.active = None if self.active == k else self.active
            yield closed

    def see(self, kind: str, event: str, camera: str, label: str | None, now: int, once: bool = False, ends: bool = True) -> tuple[str, Incident] | None:
        """Judge a message; call ``fire`` up to its time before. Returns what an end did (discarded, canceled, kept) and to which incident.

        ``once``: no other message starts this event; ``ends``: one may end it.
        """
        if kind == "end":
            return self._end(event, now)
        if kind != "new" or (not once and (event in self.starts or event in self.known)):
            return None
        inc = self.held.get(self.active) if self.active is not None else None
        if inc is None or now - inc.last_us >= self.gap:
            self.active, self.next = self.next, self.next + 1
            inc = self.held[self.active] = Incident(now, now, primary_event=event, primary_camera=camera)
        inc.last_us = now
        if once and inc.members and now - next(iter(inc.members.values())) >= self.least:
            inc.more += 1
        else:
            inc.members[event] = now
        if not once:
            self.known.add(event)
        if camera not in inc.cameras:
            inc.cameras.append(camera)
        if label and label not in inc.labels:
            inc.labels.append(label)
        if ends:
            self.starts[event] = (self.active, now)
        return None

    def _end(self, event: str, now: int) -> tuple[str, Incident] | None:
        k, began = self.starts.pop(event, (None, 0))
        inc, took = self.held.get(k), now - began
        if inc is None:
            return None  # unknown, or ended before, or its incident has closed
        if took < self.least:
            if event in inc.members:
                del inc.members[event]
                self.known.discard(event)
            else:
                inc.more -= 1
            if inc.primary_event == event:
                inc.primary_event, inc.primary_camera = next(iter(inc.members), None), inc.cameras[0]
            if not inc.n_events:
                del self.held[k]
                self.active = None if self.active == k else self.active
            return "discarded", inc
        canceled = took >= self.most
        inc.canceled |= canceled
        if not canceled or self.close_canceled:
            if inc.due_us is None:
                heappush(self.due, (now + self.gap, k))
            inc.last_us, inc.due_us = now, now + self.gap
        return "canceled" if canceled else "kept", inc


CLOSED = "site_id long, start_us long, close_us long, n_events long, primary_event string, primary_camera string, cameras string, labels string, canceled boolean"
MEMBERSHIP = "site_id long, event_id string, ts_us long, outcome string, start_us long, n_events long, primary_event string, primary_camera string, cameras string, labels string"


def closed_row(site: int, x: Incident) -> tuple:
    return site, x.start_us, x.due_us, x.n_events, x.primary_event, x.primary_camera, ",".join(x.cameras), ",".join(x.labels), x.canceled


def membership_row(site: int, event: str, now: int, outcome: str, x: Incident) -> tuple:
    return site, event, now, outcome, x.start_us, x.n_events, x.primary_event, x.primary_camera, ",".join(x.cameras), ",".join(x.labels)


def frame_of(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])


def judge(parts: Iterator[pd.DataFrame], gap_s: int, options: dict, members: bool) -> Iterator[pd.DataFrame]:
    """Judge batches sorted by site, segment and time; only what is open in a segment is held.

    Of the last two columns, which may be missing, one says that an event starts once, one that it ends.
    """
    at, rule = None, CloseTimer(gap_s, **options)
    schema = MEMBERSHIP if members else CLOSED
    for part in parts:
        out: list[tuple] = []
        for site, segment, now, kind, event, camera, label, *marks in part.itertuples(index=False, name=None):
            if (site, segment) != at:
                out += [] if members or at is None else [closed_row(at[0], x) for x in rule.fire(None)]
                at, rule = (site, segment), CloseTimer(gap_s, **options)
            closed = [closed_row(site, x) for x in rule.fire(now)]
            end = rule.see(kind, event, camera, label, now, *marks)
            out += ([membership_row(site, event, now, *end)] if end else []) if members else closed
        if out:
            yield frame_of(out, schema)
    if at is not None and not members and (out := [closed_row(at[0], x) for x in rule.fire(None)]):
        yield frame_of(out, schema)


def _segments(messages: DataFrame, gap_s: int) -> DataFrame:
    """Messages by site and segment, in order.

    An event keeps its site busy from its start to the gap after its end, one that never
    ends to the gap after its start: from then on no timer waits and no incident takes new
    members. What never ends stays in an incident that can't close any more, or closes by
    its other members, all of which are in the segment.
    """
    label = F.col("label") if "label" in messages.columns else F.lit(None)
    rows = messages.filter("kind in ('new', 'end')").select("site_id", F.col("ts_us").cast("long").alias("ts_us"), "kind", F.col("event_id").cast("string").alias("event_id"), "camera", label.cast("string").alias("label"))
    rows = rows.filter("site_id is not null and ts_us is not null and event_id is not null").withColumn("__late", (F.col("kind") == "end").cast("int"))
    w = W.partitionBy("site_id", "event_id").orderBy("ts_us", "__late")
    # an end without a start before it does nothing
    began = F.max(F.when(F.col("kind") == "new", F.lit(1))).over(w.rowsBetween(W.unboundedPreceding, 0))
    end = F.first(F.when(F.col("kind") == "end", F.col("ts_us")), ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    once = F.count_if(F.col("kind") == "new").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) == 1
    rows = rows.withColumns({"__began": began, "__end": end, "once": once, "ends": end.isNotNull()}).filter("__began is not null")
    reach = F.greatest(F.col("ts_us"), F.coalesce("__end", "ts_us")) + gap_s * SECOND
    cut = cut_where_idle(rows, "site_id", "ts_us", ["__late", "event_id"], reach).repartition("site_id", "segment").sortWithinPartitions("site_id", "segment", "ts_us", "__late", "event_id")
    return cut.select("site_id", "segment", "ts_us", "kind", "event_id", "camera", "label", "once", "ends")


def exact_incidents(messages: DataFrame, gap_s: int = 120, **options) -> DataFrame:
    """The incidents that close, by the rule of ``CloseTimer`` (``options``: its others).

    ``messages``: site_id, ts_us, kind (new or end; others are ignored), event_id, camera,
    label if there is one. Of messages at one time starts come first, then ids in order.
    A site is cut where all is closed or can't close any more, and dealt by such segments:
    a task holds what is open in one. Rows without a site, time or id are left out.
    """
    return _segments(messages, gap_s).mapInPandas(lambda parts: judge(parts, gap_s, options, False), CLOSED)


def short_long(messages: DataFrame, gap_s: int = 120, **options) -> DataFrame:
    """A row for each end of a known event: its outcome (discarded, canceled, kept) and its incident's members after it, of whom discarded ones are no part.

    An incident that has lost all members shows none, and no primary event.
    """
    return _segments(messages, gap_s).mapInPandas(lambda parts: judge(parts, gap_s, options, True), MEMBERSHIP)
