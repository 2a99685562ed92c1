"""The change log: writing it, regenerating it, replaying it, and taking what a stream brings in batches."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.errors import ArgumentError
from quarry.operators.content import collisions, first_rows, new_rows, validate_contents, without_collisions
from quarry.plans.paging import numbered
from quarry.schemas import TABLES
from quarry.session import cut
from quarry.sources.store import Archive

#: Fixed values, with the keys below: tables in the order in which their rows may be added: what is referred to comes first.
ORDER = (
    "metadata_authority", "metadata_fetcher", "origin", "origin_visit", "origin_visit_status", "content", "skipped_content", "directory", "directory_entry",
    "revision", "revision_parent", "release", "snapshot", "snapshot_branch", "extid", "raw_extrinsic_metadata",
)
#: What makes a row of each table the same row. A directory may hold a name twice (it is corrupt then), so its entries have all columns.
KEYS = {
    "metadata_authority": ["type", "url"], "metadata_fetcher": ["name", "version"], "origin": ["url"], "origin_visit": ["origin", "visit"], "origin_visit_status": ["origin", "visit", "date"],
    "content": ["sha1", "sha1_git", "sha256", "blake2s256"], "skipped_content": ["sha1", "sha1_git", "sha256"], "directory": ["id"], "directory_entry": ["directory_id", "name", "type", "target", "perms"],
    "revision": ["id"], "revision_parent": ["id", "parent_rank"], "release": ["id"], "snapshot": ["id"], "snapshot_branch": ["snapshot_id", "name"],
    "extid": ["extid_type", "extid", "extid_version", "target_type", "target"], "raw_extrinsic_metadata": ["id"],
}


def to_log(table: str, rows: DataFrame) -> DataFrame:
    """``(object_type, key, value)`` messages of a table's rows, as JSON; blobs are not logged."""
    own = rows.drop("data")
    return own.select(F.lit(table).alias("object_type"), F.to_json(F.struct(*KEYS[table])).alias("key"), F.to_json(F.struct(*own.columns)).alias("value"))


def write_log(log: DataFrame, path: str) -> None:
    """Append messages, a folder per type."""
    log.write.mode("append").partitionBy("object_type").parquet(path)


def backfill(archive: Archive, path: str, tables: tuple[str, ...] = ORDER) -> None:
    """Write the whole log anew from the tables; Spark cuts the scans."""
    for table in tables:
        write_log(to_log(table, archive.read(table)), path)


def from_log(log: DataFrame, table: str) -> DataFrame:
    """Rows of one type; messages that cannot be read have a null key and are left to ``unreadable``."""
    return log.where(F.col("object_type") == table).select(F.from_json("value", TABLES[table]).alias("r")).where(readable(table)).select("r.*")


def readable(table: str) -> F.Column:
    whole = F.col("r").isNotNull()
    needed = {"content": "sha256", "skipped_content": "length"}.get(table, KEYS[table][0])
    return whole & F.col(f"r.{needed}").isNotNull()


def unreadable(log: DataFrame, table: str) -> DataFrame:
    rows = log.where(F.col("object_type") == table).withColumn("r", F.from_json("value", TABLES[table]))
    return rows.where(~F.coalesce(readable(table), F.lit(False))).drop("r")


def last_by_key(rows: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """One row per key of a buffer: the last by ``seq``, or else the first of ``first_rows``."""
    if seq is None:
        return first_rows(rows, keys)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))
    return rows.withColumn("_n", nth).where("_n = 1").drop("_n")


def insert_new(archive: Archive, table: str, rows: DataFrame, report: Callable[[str, DataFrame], None] | None = None) -> DataFrame:
    """Append what isn't there; what it returns was appended. Doing it twice adds nothing.

    Contents that share some hash with another content, of the batch or the archive, but not all are reported as
    ``content_collision`` and left out.
    """
    if table == "content":
        known = archive.read("content")
        if report:
            report("content_collision", collisions(rows, known))
        rows = without_collisions(rows, known)
    fresh, _ = cut(new_rows(rows.select(*[f.name for f in TABLES[table]]), archive.read(table), KEYS[table]), "fresh")
    archive.append(table, fresh)
    return fresh


def apply_batch(archive: Archive, log: DataFrame, report: Callable[[str, DataFrame], None] | None = None) -> None:
    """Add all messages of a batch, types in the order of their references; what can't be read is reported."""
    log.persist()
    try:
        present = {r.object_type for r in log.select("object_type").distinct().collect()}
        for table in ORDER:
            if table not in present:
                continue
            if report:
                report(table, unreadable(log, table))
            rows = from_log(log, table)
            if table == "origin_visit":
                urls = rows.select(F.col("origin").alias("url")).distinct()
                insert_new(archive, "origin", urls.withColumn("sha1", F.unhex(F.sha1(F.col("url").cast("binary")))))
            insert_new(archive, table, rows, report)
    finally:
        log.unpersist()


def replay(archive: Archive, path: str, checkpoint: str, max_files: int | None = None, report: Callable[[str, DataFrame], None] | None = None) -> StreamingQuery:
    """Replay a log as a stream, in micro-batches of at most ``max_files`` files, until it is caught up.

    Delivery may repeat: adds skip known keys, so a batch that runs again after a failure changes nothing.
    """
    spark = archive.spark
    source = spark.readStream.schema("key string, value string, object_type string").format("parquet")
    if max_files is not None:
        source = source.option("maxFilesPerTrigger", max_files)
    return source.load(path).writeStream.foreachBatch(lambda log, _: apply_batch(archive, log, report)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tenacious(rows: DataFrame, valid: F.Column, most_errors: float, order: list[str] | None = None, window: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine); an error if the bad ones are more than that share of the batch.

    With ``order`` and ``window`` the share holds for every run of so many rows in that order (runs don't overlap), so a
    source that goes bad stops the batch however much of it was good before.
    """
    good = F.coalesce(valid, F.lit(False))
    marked = rows.withColumn("_run", F.lit(0)) if window is None else numbered(rows, order).withColumn("_run", F.floor(F.col("_at") / window))
    counts = marked.groupBy("_run").agg(F.count("*").alias("n"), F.count_if(~good).alias("errors"))
    # a run cut short by the end counts as a whole one
    whole = F.col("n") if window is None else F.lit(window)
    worst = counts.where(F.col("errors") / whole > most_errors).orderBy("_run").limit(1).collect()
    if worst:
        raise ArgumentError(f"{worst[0]['errors']} of {worst[0]['n']} rows are bad")
    return rows.where(good), rows.where(~good)


def error_counts(rows: DataFrame, valid: F.Column, by: str = "object_type") -> DataFrame:
    """``(by, written, errors)`` of a batch."""
    good = F.coalesce(valid, F.lit(False))
    return rows.groupBy(by).agg(F.count_if(good).alias("written"), F.count_if(~good).alias("errors"))


def with_retries(action: Callable, attempts: int = 3, wait: float = 0.1, fatal: tuple[type[BaseException], ...] = (ArgumentError,), busy: Callable[[Exception], bool] | None = None, busy_wait: float = 10.0):
    """Run a driver-side action again on failure, waiting twice as long each time; never on ``fatal`` errors.

    Errors that ``busy`` tells of a store that asks for patience (as HTTP 503 does) wait ``busy_wait`` at least.
    """
    for k in range(attempts):
        try:
            return action()
        except fatal:
            raise
        except Exception as error:
            if k == attempts - 1:
                raise
            pause = wait * 2**k
            time.sleep(max(pause, busy_wait) if busy and busy(error) else pause)


def buffer_batches(rows: DataFrame, by: str, order: str, most_rows: int | dict, size: str | None = None, most_size: int | None = None) -> DataFrame:
    """``rows`` with ``batch long``, growing in ``order`` for each ``by``: at most ``most_rows`` rows and about ``most_size`` of ``size`` to a batch.

    ``most_rows`` may differ by the value of ``by`` (a dict, whose ``None`` is for all others). A batch ends after so many
    rows, and where the running sum passes a multiple of ``most_size``; numbers may leave gaps where it does. Flush types
    in ``ORDER`` for references to come first. Rows are numbered over all tasks, a type's own are not gathered.
    """
    at = numbered(rows, [by, order], total=size)
    first = at.groupBy(by).agg(F.min("_at").alias("_first"), *([F.min("_at_sum").alias("_first_sum")] if size else []))
    at = at.join(first, at[by].eqNullSafe(first[by])).drop(first[by])
    limit = F.lit(most_rows)
    if isinstance(most_rows, dict):
        named = [x for k, n in most_rows.items() if k is not None for x in (F.lit(k), F.lit(n))]
        limit = F.coalesce(F.create_map(*named)[F.col(by)] if named else F.lit(None), F.lit(most_rows[None]))
    batch = F.floor((F.col("_at") - F.col("_first")) / limit)
    if size is not None:
        batch = batch + F.floor((F.col("_at_sum") - F.col("_first_sum")) / most_size)
    return at.select(*rows.columns, batch.cast("long").alias("batch"))


def ingest_contents(archive: Archive, new: DataFrame, log: str) -> dict[str, int]:
    """Add contents with their bytes: blobs first, then the log, then the table, so that what is listed can be read.

    Rows whose hashes are not those of their bytes are left out. Contents that collide with others are added, counted,
    and logged once more as ``content_collision``. Run again, it adds nothing. Returns the summary.
    """
    valid = validate_contents(new).where("valid").drop("valid")
    known = archive.read("content")
    fresh, n = cut(new_rows(valid, known, KEYS["content"]), "ingest")
    archive.append("content_data", new_rows(fresh.select("sha256", "data"), archive.read("content_data"), ["sha256"]))
    rows = fresh.drop("data").withColumn("ctime", F.current_timestamp())
    clashing, hashes = cut(collisions(rows, known), "collisions")
    write_log(to_log("content", rows), log)
    if hashes:
        write_log(clashing.select(F.lit("content_collision").alias("object_type"), F.to_json(F.struct("algo", "hash")).alias("key"), F.to_json(F.struct(*rows.columns)).alias("value")), log)
    archive.append("content", rows)
    return {"content:add": n, "content:add:bytes": rows.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0], "content:add:collision": clashing.select(*KEYS["content"]).distinct().count()}
