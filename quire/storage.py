"""Where intermediate results go: the one folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that ``spark.checkpoint.dir`` names.

    A folder of our own is made only where the session names none and runs on
    one machine (tests); a cluster must name one, as executors could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif spark.sparkContext.master.startswith("local"):
            root = "file://" + tempfile.mkdtemp(prefix="quire-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return root if ":" in root.split("/")[0] else f"file://{os.path.abspath(root)}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, with its lineage cut by a reliable checkpoint."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()
