"""Cutting lineage in loops, in a folder that all executors share (a temporary one in local runs only)."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="keelson-"))
    return df.checkpoint()
