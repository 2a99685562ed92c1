"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, dealt over all cores where its files make fewer partitions than there are cores."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and all runs on this machine, as in local tests, a folder of it is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quarry.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("quarry.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_made: list[list[str]] = []


def materialised(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for made in _made:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``materialised`` wrote and no plan reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free(name: str, df: DataFrame) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end what ``materialised`` wrote inside it, but for the paths taken off the list it gives.

    For results that were written or counted inside; a DataFrame that still reads one of the folders must keep it.
    """
    made: list[str] = []
    _made.append(made)
    try:
        yield made
    finally:
        _made.remove(made)
        for path in made:
            discard(spark, path)


#: Bounds on a batch on its way to a Python worker. Spark's own are 10,000 rows and 64 MB, which JVM and worker hold several times.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends Python workers small batches, unless the user has set their size."""
    for key, most in _BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, most)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def give_back() -> None:
    """Return what this process has freed to the system: Arrow's pool and malloc keep it, and Spark's workers live on."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, a function for ``mapInArrow``, with freed memory given back between batches and at the end."""

    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(batches):
            if k:
                give_back()
            yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(fed(batches))
        give_back()

    return run


def slices(batch: pa.RecordBatch, at: int, size: int, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """A batch cut into parts of at most ``rows`` rows and about ``size`` bytes of the text in column ``at``."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0), np.int64)) if batch.num_rows else np.zeros(0, np.int64)
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right"))
        stop = min(max(stop, start + 1), start + rows)
        yield batch.slice(start, stop - start)
        start = stop


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: ``edges(a long, b long)`` -> ``(node long, component long)``.

    The component's name is its smallest node. Nodes without edges are not returned; loops and repeated edges
    do no harm. Alternates the large-star and small-star steps, each two shuffles of at most one row per edge,
    until the edge set stays as it is, which it always comes to; the number of rounds grows with the logarithm of the
    longest chain.
    """
    spark = edges.sparkSession

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, path = materialised(now, "edges")
    mark = state(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(floor.select("u", F.col("m").alias("v"))).where("u <> v")
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        after, after_path = materialised(small, "edges")
        seen = state(after)
        discard(spark, path)
        now, path = after, after_path
        if seen == mark:
            break
        mark = seen
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
