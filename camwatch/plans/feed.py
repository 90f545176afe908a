"""Domain views derived from the driver's tables, in Spark; ``CTE`` has the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each detection event."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return (
        read(spark, sf_dir, "events")
        .select("event_id", (F.col("user_id") % 4).alias("site_id"), F.concat(F.lit("cam_"), (F.col("user_id") % 8).cast("string")).alias("camera"), F.col("event_type").alias("label"), start.alias("start_us"), k.alias("k"), "value")
        .withColumns(
            {
                "end_us": F.col("start_us") + F.floor(F.col("value") * 1000 + 0.5) * 1000,
                "threat": F.col("k") % 3,
                "zones": F.when(F.col("k") % 5 == 1, F.array(F.lit("zone_0"))).when(F.col("k") % 5 == 2, F.array(F.lit("zone_1"))).when(F.col("k") % 5 == 3, F.array(F.lit("zone_0"), F.lit("zone_2"))).when(F.col("k") % 5 == 4, F.array(F.lit("zone_3"))).otherwise(F.array().cast("array<string>")),
                "viewed": F.col("k") % 7 == 0,
                "ended": F.col("k") % 11 != 0,
            }
        )
    )


def camera_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """camera, labels (empty: all), tracked_zones, exceptions; cameras 6 and 7 are not listed. At most one row for each nation."""
    n = read(spark, sf_dir, "nation").filter("n_nationkey < 6")
    return n.select(
        F.concat(F.lit("cam_"), F.col("n_nationkey").cast("string")).alias("camera"),
        F.when(F.col("n_nationkey") == 2, F.array(F.lit("click"), F.lit("error"))).otherwise(F.array().cast("array<string>")).alias("labels"),
        F.when(F.col("n_nationkey") == 4, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Zone_"), F.col("n_regionkey").cast("string")))).alias("tracked_zones"),
        F.when(F.col("n_nationkey") % 2 == 1, F.array(F.lit(" Purchase "))).otherwise(F.array().cast("array<string>")).alias("exceptions"),
    )


def sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each detection in a sampled frame of an incident's camera."""
    x1, y1 = (F.col("l_partkey") % 1600).cast("int"), (F.col("l_suppkey") % 900).cast("int")
    return read(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey div 10").alias("incident_id"), F.concat(F.lit("cam_"), (F.col("l_suppkey") % 3).cast("string")).alias("camera"),
        ((F.col("l_orderkey") % 10) * 7 + F.col("l_linenumber") - 1).cast("int").alias("t"),
        x1.alias("x1"), y1.alias("y1"), (x1 + F.col("l_quantity").cast("int") * 6).alias("x2"), (y1 + F.col("l_quantity").cast("int") * 4).alias("y2"),
        (F.col("l_quantity").cast("int") * 6 * F.col("l_quantity").cast("int") * 4).cast("bigint").alias("area"),
        F.when(F.col("l_returnflag") != "A", "person").otherwise("car").alias("label"), "l_partkey", "l_suppkey",
    )


def snoozes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """camera, set_us, expiration_us, snooze_notifications, snooze_ai."""
    f = feed(spark, sf_dir).filter("label = 'error'")
    return f.select("camera", F.col("start_us").alias("set_us"), (F.col("start_us") + F.col("k").cast("bigint") * 60_000_000).alias("expiration_us"), (F.col("k") % 2 == 0).alias("snooze_notifications"), (F.col("k") % 3 == 0).alias("snooze_ai"))


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """folder, camera, file, size, mtime (seconds) of stored files; one in seven lies in the incident's root (camera null)."""
    names = ("clip_a.mp4", "clip_b.MP4", "snapshot.jpg", "summary.txt", "metadata.json", "notification.gif", "review_summary.md", "other.bin")
    name = F.lit(names[-1])
    for i, x in enumerate(names[:-1]):
        name = F.when(F.col("doc_id") % 8 == i, x).otherwise(name)
    return read(spark, sf_dir, "documents").select(
        F.concat((F.lit(1_700_000_000) + F.expr("doc_id div 40") * 7200).cast("string"), F.lit("_ev"), F.expr("doc_id div 40").cast("string")).alias("folder"),
        F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("cam_"), (F.col("doc_id") % 3).cast("string"))).alias("camera"),
        name.alias("file"), F.col("n_chars").alias("size"), (F.lit(1_700_000_000) + (F.col("doc_id") * 7919) % 1_000_003).alias("mtime"),
    )


CTE = {
    "feed": """feed as (
        select event_id, user_id % 4 as site_id, 'cam_' || (user_id % 8) as camera, event_type as label, epoch_us(ts) as start_us,
               cast(json_extract_string(props, '$.k') as integer) as k, value,
               epoch_us(ts) + cast(floor(value * 1000 + 0.5) as bigint) * 1000 as end_us,
               cast(json_extract_string(props, '$.k') as integer) % 3 as threat,
               case cast(json_extract_string(props, '$.k') as integer) % 5 when 1 then ['zone_0'] when 2 then ['zone_1'] when 3 then ['zone_0', 'zone_2'] when 4 then ['zone_3'] else cast([] as varchar[]) end as zones,
               cast(json_extract_string(props, '$.k') as integer) % 7 = 0 as viewed, cast(json_extract_string(props, '$.k') as integer) % 11 <> 0 as ended
        from events)""",
    "camera_config": """camera_config as (
        select 'cam_' || n_nationkey as camera, case when n_nationkey = 2 then ['click', 'error'] else cast([] as varchar[]) end as labels,
               case when n_nationkey = 4 then cast([] as varchar[]) else ['Zone_' || n_regionkey] end as tracked_zones,
               case when n_nationkey % 2 = 1 then [' Purchase '] else cast([] as varchar[]) end as exceptions
        from nation where n_nationkey < 6)""",
    "sidecar": """sidecar as (
        select l_orderkey // 10 as incident_id, 'cam_' || (l_suppkey % 3) as camera, cast((l_orderkey % 10) * 7 + l_linenumber - 1 as integer) as t,
               cast(l_partkey % 1600 as integer) as x1, cast(l_suppkey % 900 as integer) as y1,
               cast(l_partkey % 1600 as integer) + cast(l_quantity as integer) * 6 as x2, cast(l_suppkey % 900 as integer) + cast(l_quantity as integer) * 4 as y2,
               cast(cast(l_quantity as integer) * 6 * cast(l_quantity as integer) * 4 as bigint) as area,
               case when l_returnflag <> 'A' then 'person' else 'car' end as label, l_partkey, l_suppkey
        from lineitem)""",
    "snoozes": """snoozes as (
        select camera, start_us as set_us, start_us + cast(k as bigint) * 60000000 as expiration_us, k % 2 = 0 as snooze_notifications, k % 3 = 0 as snooze_ai
        from feed where label = 'error')""",
    "file_inventory": """file_inventory as (
        select cast(1700000000 + (doc_id // 40) * 7200 as varchar) || '_ev' || (doc_id // 40) as folder,
               case when doc_id % 7 <> 0 then 'cam_' || (doc_id % 3) end as camera,
               ['clip_a.mp4', 'clip_b.MP4', 'snapshot.jpg', 'summary.txt', 'metadata.json', 'notification.gif', 'review_summary.md', 'other.bin'][doc_id % 8 + 1] as file,
               n_chars as size, 1700000000 + (doc_id * 7919) % 1000003 as mtime
        from documents)""",
}


def with_(*names: str, recursive: bool = False) -> str:
    """``with`` and the named views, in an order that works."""
    return ("with recursive " if recursive else "with ") + ", ".join(CTE[n] for n in names)
