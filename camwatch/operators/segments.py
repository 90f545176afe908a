"""Cutting long keys where a sequential rule's state is provably idle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cut_where_idle(rows: DataFrame, by: str, time: str, tie: list[str | Column], reach: Column, cost: int = 0, cell: int = 86_400_000_000) -> DataFrame:
    """``segment``: the time of the first row of the segment that a row belongs to.

    A row keeps its key busy up to ``reach``, and at least ``cost`` longer than the rows
    before it did: busy(i) = max(busy(i-1) + cost, reach(i)). A row at or after busy of
    the row before it begins a new segment. With a cost of 0 segments are the islands
    of the intervals [time, reach); with a cost they are the busy periods of a server.

    That maximum is max(reach(j) - cost * j) + cost * i, so it needs no fold: rows are
    dealt by key and cell of time, running maxima are taken within a cell, and what
    earlier cells hold comes from one row for each key and cell. Rows without a key or a
    time have no segment.
    """
    each = F.lit(cost).cast("long")
    at = rows.withColumn("__cell", F.floor(F.col(time) / cell)).withColumn("__reach", reach)
    w = W.partitionBy(by, "__cell").orderBy(time, *tie)
    at = at.withColumn("__i", F.row_number().over(w)).withColumn("__m", F.col("__reach") - each * F.col("__i"))
    at = at.withColumn("__most", F.max("__m").over(w.rowsBetween(W.unboundedPreceding, -1)))
    cells = at.filter("__cell is not null").groupBy(by, "__cell").agg(F.count("*").alias("n"), F.max("__m").alias("m"))
    earlier = W.partitionBy(by).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("__n", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    cells = cells.withColumn("__held", F.max(F.col("m") - each * F.col("__n")).over(earlier)).select(F.col(by).alias("__by"), F.col("__cell").alias("__at"), "__n", "__held")
    of_cell = (F.col(by) == F.col("__by")) & (F.col("__cell") == F.col("__at"))
    busy = F.greatest(F.col("__held") + each * (F.col("__n") + F.col("__i") - 1), F.col("__most") + each * (F.col("__i") - 1))
    both = at.join(cells, of_cell, "left").withColumn("__begin", F.when(busy.isNull() | (F.col(time) >= busy), F.col(time))).drop("__by", "__at", "__n", "__held", "__most", "__m", "__reach")
    both = both.withColumn("__own", F.max("__begin").over(w.rowsBetween(W.unboundedPreceding, 0)))
    lasts = both.groupBy(by, "__cell").agg(F.max("__begin").alias("last"))
    lasts = lasts.select(F.col(by).alias("__by"), F.col("__cell").alias("__at"), F.last("last", ignorenulls=True).over(earlier).alias("__carried"))
    done = both.join(lasts, of_cell, "left").withColumn("segment", F.when(F.col(by).isNotNull() & F.col(time).isNotNull(), F.coalesce("__own", "__carried")))
    return done.drop("__by", "__at", "__carried", "__own", "__begin", "__cell", "__i")
