"""Cutting the lineage of iterative jobs in the folder that a cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` as files below ``spark.checkpoint.dir``; a local session without that setting gets a temporary folder."""
    context = df.sparkSession.sparkContext
    if not (context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()):
        local = context.master.startswith("local")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quoteloom-") if local else df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
    return df.checkpoint()
