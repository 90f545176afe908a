"""Cutting a plan where several later parts read it."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and written to the checkpoint folder, which Spark cleans when nothing refers to it any more.

    The folder is that of ``spark.checkpoint.dir``. Where none is named, a session whose
    executors run inside the driver gets a temporary one; a cluster must name one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        sc.setCheckpointDir(folder)
    return df.checkpoint()
