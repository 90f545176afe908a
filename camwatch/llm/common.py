"""Helpers that the training-data operators share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where none is named, a session whose executors run inside the driver (tests, a
    laptop) gets a temporary folder, kept for the application; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        folder = _OWN[app]
    return folder.rstrip("/")


#: Folders made where the cluster names none, by application.
_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/camwatch/{name}-{uuid.uuid4().hex[:12]}"


def temporary(spark: SparkSession, name: str) -> str:
    """A new path for files that ``scoped`` deletes once the result of the function around it is written."""
    path = scratch(spark, name)
    _WRITTEN.append(path)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, survives the loss of any executor, and gives the
    planner real sizes for what follows. Spark deletes the shuffle files of the write
    when it ends: nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before) if before is not None else spark.conf.unset(CLEAN_UP)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path  # for drop()
    return out


#: Spark's setting for deleting a query's shuffle files when the query ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables that ``table`` wrote and ``scoped`` may delete.
_WRITTEN: list[str] = []


def scoped(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Write what ``fn`` returns as a table, and delete the tables that it wrote on the way."""

    @functools.wraps(fn)
    def run(*args, **options) -> DataFrame:
        before = len(_WRITTEN)
        out = table(fn(*args, **options), fn.__name__)
        for path in _WRITTEN[before:-1]:
            delete_path(out.sparkSession, path)
        del _WRITTEN[before:-1]
        return out

    return run


def written(fn: Callable[..., DataFrame], *args) -> DataFrame:
    """What ``scoped`` gives for a function that isn't: its result as a table, and none of the tables on the way."""
    return scoped(fn)(*args)


def drop(df: DataFrame) -> None:
    """Delete a table that ``table`` wrote and that no later plan reads."""
    delete_path(df.sparkSession, df.scratch_path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path of ours."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Connected components by min-label propagation with pointer jumping.

    ``links`` has two long columns ``a`` and ``b``. Returns ``id``, ``component``
    (the smallest id reachable) for every id in a link. Each round hooks the
    component of every edge's end onto the smaller one and then jumps, so chains
    take logarithmically many rounds. Every round is written to the shared folder.
    """
    edges = table(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links"
    )
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    label = table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).select(F.col("a").alias("id"), F.col("c").alias("component")), "cc")
    while True:
        a = label.select(F.col("id").alias("a"), F.col("component").alias("ca"))
        b = label.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        # an edge between two components hooks the larger label onto the smaller one
        hooks = (
            edges.join(a, "a").join(b, "b").filter("ca <> cb")
            .groupBy(F.greatest("ca", "cb").alias("component")).agg(F.min(F.least("ca", "cb")).alias("hook"))
        )
        hooks = table(hooks, "hooks")
        # jump along the hooks until each points at a root of this round
        while True:
            nxt = hooks.select(F.col("component").alias("hook"), F.col("hook").alias("further"))
            jumped = table(
                hooks.join(nxt, "hook", "left").select("component", F.coalesce("further", "hook").alias("hook"), F.col("further").isNotNull().alias("moved")),
                "hooks",
            )
            more = bool(jumped.filter("moved").limit(1).count())
            drop(hooks)
            hooks = jumped
            if not more:
                break
        if hooks.limit(1).count() == 0:
            drop(hooks)
            drop(edges)
            return label
        new = table(
            label.join(hooks.select("component", "hook"), "component", "left").select("id", F.coalesce("hook", "component").alias("component")),
            "cc",
        )
        drop(label)
        drop(hooks)
        label = new
