"""The folder that the cluster shares, and cutting the lineage of iterative jobs in it."""

from __future__ import annotations

import logging
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Only a session on one machine may
    leave it unset (tests): it gets a folder of that machine."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        logging.getLogger(__name__).warning("spark.checkpoint.dir is not set: this machine's %s is used", folder)
    if not known.isDefined():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame, keep_partitions: bool = False) -> DataFrame:
    """``df`` checkpointed in the shared folder. With ``keep_partitions`` it is
    planned without adaptive execution, whose plans do not say how their rows are
    dealt, so what groups by the same key later needs no exchange."""
    spark = df.sparkSession
    shared_folder(spark)
    if not keep_partitions:
        return df.checkpoint()
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(name, before)
