"""Cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the cluster's shared checkpoint folder and read from there.

    The folder is the one in spark.checkpoint.dir. A local session without that
    setting (a test) gets a temporary one; a cluster without it is an error, as
    executors would write to disks of their own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skein-checkpoint-"))
    return df.checkpoint(eager=True)
