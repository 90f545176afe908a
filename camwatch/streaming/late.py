"""A sink that keeps what comes behind the watermark."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from camwatch.operators.late import mark_us


def late_sink(rows: DataFrame, path: str, checkpoint: str, time: str = "ts", delay_s: float = 600):
    """Write each batch to ``path/rows`` and, with its watermark, what is behind that to ``path/late``.

    The watermark is that of the rows that earlier batches brought, as in ``split_late``;
    each batch leaves one row with the largest time so far in ``path/marks``, which the
    next one reads. A batch that is run again after a failure replaces its own folders, so
    nothing is lost or written twice.
    """

    def split(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = None
        if n > 0:
            try:
                before = spark.read.schema("most long").parquet(f"{path}/marks/batch={n - 1}").first()
            except AnalysisException:  # the batch before had no folder: a checkpoint older than this sink
                before = None
        most = before["most"] if before else None
        kept = batch.withColumn("__us", F.unix_micros(time)).persist()
        mark = mark_us(F.lit(most).cast("long"), delay_s)
        behind = F.coalesce(F.col("__us") <= mark, F.lit(False))
        kept.filter(~behind).drop("__us").write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
        kept.filter(behind).drop("__us").withColumn("watermark_us", mark).write.mode("overwrite").parquet(f"{path}/late/batch={n}")
        kept.agg(F.max("__us").alias("m")).select(F.greatest("m", F.lit(most).cast("long")).alias("most")).write.mode("overwrite").parquet(f"{path}/marks/batch={n}")
        kept.unpersist()

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(split).trigger(availableNow=True).start()
