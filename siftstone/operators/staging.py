"""Tables that cut a plan's lineage and stay as they are if tasks are repeated."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local master may leave that unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError(f"set spark.checkpoint.dir: executors of {sc.master} don't share this machine's folders")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="siftstone-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """``df`` kept in :func:`shared_folder`."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
