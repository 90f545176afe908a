"""Rows that come too late: behind a watermark, and reviews after their incident has closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def mark_us(most: Column, delay_s: float) -> Column:
    """The watermark after rows up to a time (µs), in Spark's whole milliseconds."""
    return (F.expr("0L") + F.floor(most / F.lit(1000)) - F.lit(int(delay_s * 1000))) * 1000


def split_late(rows: DataFrame, batch: str = "batch", time: str = "ts_us", delay_s: float = 600) -> DataFrame:
    """``watermark_us`` at each row's arrival, and ``late``: its time is at or behind it.

    Those are the rows that a stream can drop: Spark's stateful operators drop what is
    behind the watermark of the batch before, and have closed what is behind this one.

    The watermark of a batch is the largest time of earlier batches less the delay; the
    first batch has none. Rows without a time aren't late. Only one row for each batch
    is put in order.
    """
    most = rows.groupBy(batch).agg(F.max(time).alias("__most"))
    so_far = F.max("__most").over(W.orderBy(batch).rowsBetween(W.unboundedPreceding, -1))
    marks = most.select(F.col(batch).alias("__of"), mark_us(so_far, delay_s).alias("watermark_us"))
    both = rows.join(marks, F.col(batch).eqNullSafe(F.col("__of")), "left").drop("__of")
    return both.withColumn("late", F.coalesce(F.col(time) <= F.col("watermark_us"), F.lit(False)))


def review_targets(reviews: DataFrame, events: DataFrame, incidents: DataFrame) -> DataFrame:
    """What each review is told about, one row for each review of a known event; reviews of unknown events have none.

    While the event's incident is open (from its start until before ``closed_us``; a null
    one hasn't closed) that is the incident, and only the first of its reviews is sent.
    After that, and for events without an incident, it is a stand-in made of the event
    itself, and every review is sent.

    ``reviews``: review_id, event_id, ts_us, title, description, threat. ``events``:
    event_id, camera, label, folder, start_us, end_us, severity, incident_id.
    ``incidents``: incident_id, camera, label, folder, start_us, end_us, closed_us.
    Columns: review_id, event_id, kind (incident, stand_in), target_id, tag, sent, camera,
    label, folder (empty if unknown), created_us, end_us (an open event: its start), title,
    description, threat, severity (detection if unknown).
    """
    e = events.select("event_id", "incident_id", *(F.col(c).alias(f"e_{c}") for c in ("camera", "label", "folder", "start_us", "end_us", "severity")))
    i = incidents.select("incident_id", "closed_us", *(F.col(c).alias(f"i_{c}") for c in ("camera", "label", "folder", "start_us", "end_us")))
    j = reviews.join(e, "event_id").join(i, "incident_id", "left")
    open_ = F.coalesce((F.col("ts_us") >= F.col("i_start_us")) & (F.col("closed_us").isNull() | (F.col("ts_us") < F.col("closed_us"))), F.lit(False))
    pick = lambda c: F.when(F.col("__open"), F.col(f"i_{c}")).otherwise(F.col(f"e_{c}"))
    j = j.withColumn("__open", open_)
    # an incident's reviews while it is open: the first by time is found by an aggregate, not by an order of all
    first = j.filter("__open").groupBy("incident_id").agg(F.min(F.struct("ts_us", "review_id", "event_id")).alias("__first"))
    j = j.join(first, "incident_id", "left")
    sent = ~F.col("__open") | (F.struct("ts_us", "review_id", "event_id") == F.col("__first"))
    target = F.when(F.col("__open"), F.col("incident_id").cast("string")).otherwise(F.col("event_id").cast("string"))
    return j.select(
        "review_id", "event_id", F.when(F.col("__open"), "incident").otherwise("stand_in").alias("kind"), target.alias("target_id"), F.concat(F.when(F.col("__open"), "incident_").otherwise("event_"), target).alias("tag"), sent.alias("sent"),
        pick("camera").alias("camera"), pick("label").alias("label"), F.coalesce(pick("folder"), F.lit("")).alias("folder"), pick("start_us").alias("created_us"), F.coalesce(pick("end_us"), pick("start_us")).alias("end_us"),
        "title", "description", F.coalesce("threat", F.lit(0)).alias("threat"), F.coalesce("e_severity", F.lit("detection")).alias("severity"),
    )
