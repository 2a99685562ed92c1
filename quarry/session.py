"""Session settings, the shared folder, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times; whatever ``conf`` or the cluster sets wins."""
    builder = SparkSession.builder.config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset and all runs on this machine, a folder of it is made."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quarry.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("quarry.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Whether Spark deletes the shuffle files of a query when it ends; else they stay until the driver collects its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str = "step", of: str = "true", lean: bool = False) -> tuple[DataFrame, int]:
    """``df`` written as Parquet to the shared folder and read again, and its number of rows ``of`` which a condition holds.

    A short plan that lost executors don't undo; the rows are counted by the job that writes them. With ``lean`` the shuffle
    files of that job are deleted once it ends, and the rows are compressed more, which takes longer.
    """
    path, seen, conf = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", Observation(), df.sparkSession.conf
    before = conf.get(FREED, "false")
    try:
        if lean:
            conf.set(FREED, "true")
        writer = df.observe(seen, F.count_if(F.expr(of)).alias("rows")).write
        (writer.option("compression", "zstd") if lean else writer).parquet(path)
    finally:
        if lean:
            conf.set(FREED, before)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"]
