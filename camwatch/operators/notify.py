"""Notification planning: payloads, rate limit, frame cap, previous tags, fan-out to providers."""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from camwatch.functions.scalars import deep_link, default_title, first_truthy, is_critical, player_url, push_priority
from camwatch.operators.incidents import assign_incidents
from camwatch.operators.joins import suppress_snoozed
from camwatch.operators.segments import cut_where_idle


def clear_previous_tag(sent: DataFrame, by: str = "site_id") -> DataFrame:
    """``clear_tag``: the tag of the previous successful notification if it is the same and no event ended in between.

    ``sent``: site, ts_us, id, tag (null for an end marker), ok. Of successful ones and
    end markers only the row just before counts: within a day by a lag, for a day's
    first row the last row of the days before, which is one row for each site and day.
    """
    rows = sent.filter("tag is null or ok").withColumn("__day", F.floor(F.col("ts_us") / 86_400_000_000))
    before = F.lag(F.struct("tag")).over(W.partitionBy(by, "__day").orderBy("ts_us", "id"))
    days = rows.groupBy(by, "__day").agg(F.max_by(F.struct("tag"), F.struct("ts_us", "id")).alias("last"))
    days = days.select(by, "__day", F.lag("last").over(W.partitionBy(by).orderBy("__day")).alias("__earlier"))
    both = rows.withColumn("__before", before).join(days, [by, "__day"]).withColumn("__before", F.coalesce("__before", "__earlier")["tag"])
    return both.filter("tag is not null").withColumn("clear_tag", F.when(F.col("__before") == F.col("tag"), F.col("tag"))).drop("__day", "__before", "__earlier")


def rolling_frame_cap(requests: DataFrame, cap: int = 200, window_s: int = 3600, by: str = "site_id") -> DataFrame:
    """``admitted``: with its frames, at most ``cap`` frames were admitted within the last ``window_s`` seconds (inclusive). 0 switches it off.

    Only admitted requests count, so requests are judged in order: a fold over sorted
    rows, in batches, that keeps the admitted ones of one window. After a pause longer
    than the window nothing is held any more, so a key is cut into bursts at such
    pauses and dealt by burst. Rows without a key or a time are judged as one burst each key.
    """
    if cap <= 0:
        return requests.withColumn("admitted", F.lit(True))

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, total = None, deque(), 0
        for part in parts:
            out = []
            for k, ts, n in zip(part["__burst"], part["ts_us"], part["frames"], strict=True):
                if k != key:
                    key, total = k, 0
                    held.clear()
                while held and held[0][0] < ts - window_s * 1_000_000:
                    total -= held.popleft()[1]
                ok = total + n <= cap
                if ok:
                    held.append((ts, n))
                    total += n
                out.append(ok)
            yield part.drop(columns="__burst").assign(admitted=out)

    cut = assign_incidents(requests, window_s + 1, by, "ts_us", "request_id").drop("incident_seq").withColumnRenamed("incident_id", "__burst")
    rows = cut.withColumn("__burst", F.coalesce("__burst", F.concat(F.lit("?"), F.coalesce(F.col(by).cast("string"), F.lit("")))))
    rows = rows.repartition("__burst").sortWithinPartitions("__burst", "ts_us", "request_id")
    return rows.mapInPandas(judge, StructType([*requests.schema.fields, StructField("admitted", BooleanType())]))


class RateLimit:
    """The state of one key: what was sent within the window, and what waits. Items come back with their outcome once it is known."""

    def __init__(self, most: int, window_s: int, queue: int, told: bool = False):
        self.most, self.win, self.queue = most, window_s * 1_000_000, queue
        self.sent: deque[int] = deque()
        self.waiting: deque = deque()
        self.told, self.clock = told, 0

    def free(self, now: int) -> bool:
        while self.sent and self.sent[0] <= now - self.win:
            self.sent.popleft()
        return len(self.sent) < self.most

    def drain(self, until: int | None = None) -> Iterator[tuple]:
        """What goes out of the queue up to a time, one a second; all of it if there is no end."""
        while self.waiting and (until is None or self.clock + 1_000_000 <= until):
            self.clock += 1_000_000
            if self.free(self.clock):
                yield self.waiting.popleft(), "queued", self.clock
                self.sent.append(self.clock)
                self.told = self.told and len(self.waiting) >= self.queue

    def see(self, now: int, item) -> Iterator[tuple]:
        yield from self.drain(now)
        if self.free(now):
            self.sent.append(now)
            yield item, "sent", now
            return
        if not self.waiting:
            self.clock = now
        if self.told or len(self.waiting) < self.queue:
            self.waiting.append(item)
            return
        yield from ((q, "dropped", None) for q in self.waiting)
        self.waiting.clear()
        yield item, "overflow", now
        self.told = True


class Tickets:
    """A rate limit's queue as numbers given out in order; it holds none of what waits."""

    def __init__(self) -> None:
        self.head = self.tail = 0

    def __len__(self) -> int:
        return self.tail - self.head

    def __iter__(self) -> Iterator[int]:
        return iter(range(self.head, self.tail))

    def append(self, item) -> None:
        self.tail += 1

    def popleft(self) -> int:
        self.head += 1
        return self.head - 1

    def clear(self) -> None:
        self.head = self.tail


#: Outcome, time and ticket, if a segment begins with no overflow told, and if it begins with one.
BOTH = [StructField(f"{n}_if_{v}", k) for v in ("not", "told") for n, k in (("outcome", StringType()), ("sent", LongType()), ("ticket", LongType()))]
#: Rows with the times of tickets, or of segments, that go out together. A batch's size; results do not depend on it.
TICKETS = 10_000


def judge_segments(parts: Iterator[pd.DataFrame], by: str, make: Callable[[bool], RateLimit], flags: bool) -> Iterator[pd.DataFrame]:
    """Judge batches sorted by key, segment and time, each segment twice: with ``told`` off and on.

    Nothing that waits is held. Of each batch first come the rows whose outcome is known in
    both cases, then the others, with their place in the queue as a ticket and no outcome in a
    case where they wait. A ticket that goes out is a row of its own: key, segment, ticket and
    time; one that never does was dropped. What doesn't wait has a negative ticket, its own.
    With ``flags`` a row comes for each segment instead: what ``told`` is after it.
    """
    at, rules, n, columns, gone, after = None, [], 0, [], [], []

    def passed(v: int, found: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        """Let tickets go out; other outcomes are kept in ``own``."""
        nonlocal own, gone
        for item, outcome, sent in found:
            if outcome != "queued":
                own = own if outcome == "dropped" else (outcome, sent, -n)
            elif not flags:
                gone.append((*at, *((None,) * 3 * v), None, sent, item, *((None,) * 3 * (1 - v))))
                if len(gone) >= TICKETS:
                    yield tickets()

    def tickets() -> pd.DataFrame:
        nonlocal gone
        rows, gone = pd.DataFrame(gone, columns=[by, "segment", *(f.name for f in BOTH)]), []
        return _nullable(rows.assign(**{c: None for c in columns if c not in (by, "segment")})[[*columns, *(f.name for f in BOTH)]])

    def end() -> Iterator[pd.DataFrame]:
        for v, rule in enumerate(rules):
            yield from passed(v, rule.drain())
        if flags and at:
            after.append((*at, *(r.told for r in rules)))
            if len(after) >= TICKETS:
                yield told()

    def told() -> pd.DataFrame:
        nonlocal after
        rows, after = pd.DataFrame(after, columns=[by, "segment", "after_not", "after_told"]), []
        return rows

    own = None
    for part in parts:
        columns, out = list(part.columns), []
        for k, s, t in zip(part[by], part["segment"], part["ts_us"], strict=True):
            if (k, s) != at:
                yield from end()
                at, rules, n = (k, s), [make(False), make(True)], 0
                for rule in rules:
                    rule.waiting = Tickets()
            n, row = n + 1, ()
            for v, rule in enumerate(rules):
                own = None
                yield from passed(v, rule.see(t, None))
                row += own or (None, None, rule.waiting.tail - 1)
            if not flags:
                out.append(row)
        if not flags:
            judged = part.assign(**dict(zip((f.name for f in BOTH), zip(*out, strict=True), strict=True))) if out else part.iloc[:0]
            known = judged["outcome_if_not"].notna() & judged["outcome_if_told"].notna() if out else []
            yield from (_nullable(x) for x in (judged[known], judged[~known]) if len(x)) if out else ()
            if gone:
                yield tickets()
    yield from end()
    if gone:
        yield tickets()
    if after:
        yield told()


def _nullable(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.astype({f.name: "Int64" for f in BOTH if isinstance(f.dataType, LongType)})


def composed(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """``before_not``, ``before_told``: the flag before a row if the first row of its group began with it off, or on.

    Each row maps the flag: ``after_not`` and ``after_told`` are what it makes of off and
    on. A row that makes the same of both fixes the flag; after the last such row only
    turns count. So no fold is needed: the last fixing row and a count of turns.
    """
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    turns = F.coalesce(F.sum((F.col("after_not") & ~F.col("after_told")).cast("int")).over(w), F.lit(0))
    fixing = F.when(F.col("after_not") == F.col("after_told"), F.struct(F.col("after_not").alias("flag"), F.col("__turns").alias("turns")))
    at = rows.withColumn("__turns", turns).withColumn("__fixed", F.last(fixing, ignorenulls=True).over(w))
    odd = (F.col("__turns") - F.coalesce("__fixed.turns", F.lit(0))) % 2 == 1
    before = {f"before_{v}": F.coalesce("__fixed.flag", F.lit(v == "told")) != odd for v in ("not", "told")}
    return at.withColumns(before).drop("__turns", "__fixed")


def rate_limit(requests: DataFrame, most: int = 2, window_s: int = 5, queue: int = 10, by: str = "site_id") -> DataFrame:
    """``outcome``: sent, queued (sent later), overflow (found the queue full, cleared it and is told once) or dropped (in a queue so cleared); ``sent_us``.

    A request goes out at once if fewer than ``most`` went out within the last
    ``window_s`` seconds, also while others wait; else it waits. Waiting ones go out one
    a second as the window allows. One more than ``queue`` waiting clears the queue, but
    not again until a drain leaves fewer than ``queue``: until then the queue grows.
    Rows without a key or a time have no outcome.

    A key is cut where window and queue are provably empty: while something waits, the
    next but ``most`` goes out at most window_s + 1 seconds after one, so that n requests
    are through n / most times as long after the busy time began, and twice that for its
    beginning and end. Over such a cut goes only
    whether an overflow has been told and not drained. So each segment is judged for both
    cases, what it makes of the flag is composed over segments (in a day, then over days),
    and the right case is picked. A task holds nothing of what waits: the queue is first in,
    first out, so a place in it is a number, and requests meet the times at which numbers
    go out by a shuffle on key, segment and number.
    """
    turn = (window_s + 1) * 1_000_000
    cost, drained = -(-turn // most), 2 * turn
    known = F.col(by).isNotNull() & F.col("ts_us").isNotNull()
    cut = cut_where_idle(requests.filter(known), by, "ts_us", ["request_id"], F.col("ts_us") + F.lit(cost + drained + window_s * 1_000_000), cost)
    cut = cut.repartition(by, "segment").sortWithinPartitions(by, "segment", "ts_us", "request_id")
    make = lambda told: RateLimit(most, window_s, queue, told)
    # a ticket's row has nothing of a request's columns, also of those that are never null
    fields = [StructField(f.name, f.dataType) for f in cut.schema.fields]
    judged = cut.mapInPandas(lambda parts: judge_segments(parts, by, make, False), StructType([*fields, *BOTH]))
    light = cut.select(by, "segment", "ts_us", "request_id")
    after = light.mapInPandas(lambda parts: judge_segments(parts, by, make, True), StructType([cut.schema[by], cut.schema["segment"], *(StructField(f"after_{v}", BooleanType()) for v in ("not", "told"))]))
    in_day = composed(after.withColumn("__day", F.floor(F.col("segment") / 86_400_000_000)), [by, "__day"], "segment")
    last = F.struct(F.when(F.col("before_not"), F.col("after_told")).otherwise(F.col("after_not")).alias("n"), F.when(F.col("before_told"), F.col("after_told")).otherwise(F.col("after_not")).alias("t"))
    days = in_day.groupBy(by, "__day").agg(F.max_by(last, "segment").alias("x")).select(by, "__day", F.col("x.n").alias("after_not"), F.col("x.t").alias("after_told"))
    days = composed(days, [by], "__day").select(by, "__day", F.col("before_not").alias("__told"))
    flag = in_day.join(days, [by, "__day"]).select(by, "segment", F.when(F.col("__told"), F.col("before_told")).otherwise(F.col("before_not")).alias("__flag"))
    case = lambda c: F.when(F.col("__flag"), F.col(f"{c}_if_told")).otherwise(F.col(f"{c}_if_not")).alias(f"__{c}")
    picked = judged.join(flag, [by, "segment"]).select(*requests.columns, "segment", case("outcome"), case("sent"), case("ticket")).filter("__ticket is not null")
    # at most two rows for each ticket: the request and the time at which it goes out
    picked = picked.withColumn("sent_us", F.max("__sent").over(W.partitionBy(by, "segment", "__ticket"))).filter("__outcome is not null or __sent is null")
    waited = F.when(F.col("sent_us").isNotNull(), "queued").otherwise("dropped")
    picked = picked.select(*requests.columns, F.coalesce("__outcome", waited).alias("outcome"), "sent_us")
    return picked.unionByName(requests.filter(~known), allowMissingColumns=True)


def dispatch_label(status: Column, results: Column) -> Column:
    """``Notification: status — provider: status; ...``; ``results`` is an array of structs provider, status."""
    parts = F.transform(results, lambda r: F.concat(F.coalesce(r["provider"], F.lit("?")), F.lit(": "), F.coalesce(r["status"], F.lit("?"))))
    return F.concat(F.lit("Notification: "), status, F.when(F.size(results) > 0, F.concat(F.lit(" — "), F.array_join(parts, "; "))).otherwise(""))


def request_rate(messages: DataFrame, minutes: int = 5) -> DataFrame:
    return messages.groupBy(F.window("ts", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("window_us"), "n")


#: Statuses whose notification shows the cropped snapshot. Fixed values.
WITH_SNAPSHOT = ("snapshot_ready", "clip_ready", "finalized", "summarized")


def mobile_payload(n: Mapping[str, Column]) -> Column:
    """JSON of the mobile provider; every value is a string.

    Columns: status, incident_id, camera, label, threat, message, description,
    folder, live_frame, snapshot, gif, clip; the last five may be null.
    """
    title = default_title(n["label"], n["camera"])
    camera, text = first_truthy(n["camera"], F.lit("unknown")), first_truthy(F.trim(n["message"]), title)
    live = first_truthy(n["live_frame"], F.when(n["status"] == "new", F.concat(F.lit("/api/cameras/"), camera, F.lit("/latest.jpg"))), F.lit(None).cast("string"))
    shot = first_truthy(n["snapshot"], F.when(n["status"].isin(*WITH_SNAPSHOT) & (F.trim(n["folder"]) != ""), F.concat(F.lit("/files/"), n["folder"], F.lit("/snapshot_cropped.jpg"))))
    none = F.lit("")
    return F.to_json(
        F.struct(
            n["incident_id"].alias("ce_id"), F.upper(n["status"]).alias("phase"), F.when(n["status"] == "discarded", "true").otherwise("false").alias("clear_notification"), F.coalesce(n["threat"], F.lit(0)).cast("string").alias("threat_level"),
            camera.alias("camera"), F.coalesce(live, none).alias("live_frame_proxy"), F.coalesce(shot, none).alias("hosted_snapshot"), F.coalesce(n["gif"], none).alias("notification_gif"), title.alias("title"),
            first_truthy(F.trim(n["description"]), text).alias("description"), text.alias("message"), F.coalesce(n["clip"], none).alias("hosted_clip"), deep_link(n["incident_id"]).alias("deep_link"),
        )
    )


def hub_payload(n: Mapping[str, Column]) -> Column:
    """JSON of the hub: status, phase, names, texts, urls, tag, and ``clear_tag`` only if there is one to clear."""
    urls = [n[k].alias(f"{k}_url") for k in ("image", "video", "player")]
    threat = F.coalesce(n["threat"], F.lit(0))
    return F.to_json(
        F.struct(
            n["event_id"].alias("event_id"), n["status"].alias("status"), F.coalesce(n["phase"], F.lit("NEW")).alias("phase"), n["camera"].alias("camera"), n["label"].alias("label"), default_title(n["label"], n["camera"]).alias("title"),
            n["message"].alias("message"), *urls, n["tag"].alias("tag"), n["created_s"].alias("timestamp"), threat.alias("threat_level"), is_critical(threat).alias("critical"), n["clear_tag"].alias("clear_tag"),
        )
    )


def push_payload(n: Mapping[str, Column], html: int = 1) -> Column:
    """JSON of the push provider, without its credentials."""
    return F.to_json(
        F.struct(
            default_title(n["label"], n["camera"]).alias("title"), n["message"].alias("message"), player_url("", n["folder"], n["camera"], n["event_id"].cast("string")).alias("url"), F.lit("View in Event Viewer").alias("url_title"),
            F.lit(html).alias("html"), push_priority(n["status"], n["threat"]).alias("priority"), F.coalesce(n["created_s"], F.lit(0)).cast("bigint").alias("timestamp"),
        )
    )


#: A provider: a function of notifications to rows with notification_id, status, message; or one of a single
#: notification (a dict) to a dict with status and message, or to None if it doesn't send.
Sender = Callable[[dict], dict | None]


def send_rows(notifications: DataFrame, name: str, send: Sender) -> DataFrame:
    """notification_id, provider, status, message: what ``send`` returns for each row; an exception is a row with status ``failure`` and its text.

    Rows are sent where they lie, by partition; a row that fails leaves all others alone.
    What isn't a result with a status counts as a failure too. A task that Spark runs
    again sends its rows again, so a sender should know a notification by its id.
    """
    names = notifications.columns

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.astype(object).where(part.notna(), None).itertuples(index=False, name=None):
                n = dict(zip(names, row, strict=True))
                try:
                    found = send(n)
                    if found is not None:
                        out.append((n["notification_id"], name, str(found["status"]), None if found.get("message") is None else str(found["message"])))
                except Exception as e:
                    out.append((n["notification_id"], name, "failure", str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["notification_id", "provider", "status", "message"])

    return notifications.mapInPandas(go, StructType([notifications.schema["notification_id"], *(StructField(c, StringType()) for c in ("provider", "status", "message"))]))


def fan_out(notifications: DataFrame, providers: Mapping[str, Callable[[DataFrame], DataFrame]], senders: Mapping[str, Sender] | None = None) -> DataFrame:
    """Results of all providers: notification_id, provider, status, message.

    ``providers`` are functions from notifications to rows with notification_id, status,
    message; ``senders`` take one notification each and may fail for one without touching
    the others (``send_rows``).
    """
    out = [provider(notifications).select("notification_id", F.lit(name).alias("provider"), "status", "message") for name, provider in providers.items()]
    out += [send_rows(notifications, name, send) for name, send in (senders or {}).items()]
    return functools.reduce(DataFrame.unionByName, out)


def with_results(notifications: DataFrame, providers: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """``fan_out`` for providers whose status and message are expressions of the row: its columns, and provider, result, message, a row for each provider, in one pass and without a join."""
    each = F.array(*(F.struct(F.lit(name).alias("provider"), status.alias("result"), message.alias("message")) for name, (status, message) in providers.items()))
    return notifications.withColumn("__r", F.explode(each)).select(*notifications.columns, "__r.*")


def send_overflow(limited: DataFrame, warn: Mapping[str, Callable[[], dict | None]], by: str = "site_id") -> DataFrame:
    """A row for each overflow of ``rate_limit`` and provider: the warning's status, or ``failure`` with the exception's text; none where a provider has nothing to say."""
    told = limited.filter("outcome = 'overflow'").select(F.col("request_id").alias("notification_id"), by, F.col("sent_us").alias("ts_us"))
    return functools.reduce(DataFrame.unionByName, [send_rows(told, name, lambda _, w=w: w()) for name, w in warn.items()])


def dispatch_log(notifications: DataFrame, results: DataFrame) -> DataFrame:
    """One timeline entry for each notification, also if no provider had a result.

    ``notifications``: notification_id, folder, status; those without a folder have no
    timeline. Columns: notification_id, folder, source, direction, label, event_phase,
    results (provider, status, message; ordered by provider).
    """
    each = results.groupBy("notification_id").agg(F.array_sort(F.collect_list(F.struct("provider", "status", "message"))).alias("results"))
    rows = notifications.filter(F.coalesce(F.col("folder"), F.lit("")) != "").join(each, "notification_id", "left")
    rows = rows.withColumn("results", F.coalesce("results", F.array().cast("array<struct<provider:string,status:string,message:string>>")))
    return rows.select("notification_id", "folder", F.lit("notification_dispatch").alias("source"), F.lit("out").alias("direction"), dispatch_label(F.col("status"), F.col("results")).alias("label"), F.col("status").alias("event_phase"), "results")


def describe(incidents: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, snoozes: DataFrame | None = None) -> DataFrame:
    """Rows of a user's description function over the incidents that aren't snoozed for it.

    ``incidents`` have ``suppressed``, or else incident_id, ready_us and cameras: then
    those all of whose cameras are snoozed for the analysis (``snooze_ai``) when the
    incident is ready are skipped. The function gets pandas batches.
    """
    if snoozes is not None:
        asks = incidents.select(F.col("incident_id").alias("target_id"), F.col("ready_us").alias("ts_us"), "cameras")
        state = suppress_snoozed(asks, snoozes, "snooze_ai").select(F.col("target_id").alias("incident_id"), "suppressed")
        incidents = incidents.join(state, "incident_id")
    return incidents.filter("not suppressed").drop("suppressed").mapInPandas(fn, schema)
