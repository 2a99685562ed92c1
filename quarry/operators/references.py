"""The edges of the whole graph, kept by ISO week for reverse lookups."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.errors import ArgumentError

#: What a directory entry's type says of its target.
ENTRY_TARGETS = {"file": "content", "dir": "directory", "rev": "revision"}


def edges(directory_entry=None, revision=None, revision_parent=None, release=None, snapshot_branch=None, origin_visit_status=None, tasks: int | None = None) -> DataFrame:
    """``(source_type, source, target_type, target)`` of all edges in the given tables; dangling and alias branches have none.

    Edges of different tables are never equal; only where one object may name another twice are they made distinct, over
    ``tasks`` tasks, if given (``plans.paging.tasks_for``), after each partition has made its own so.
    """

    def edge(df: DataFrame, source_type: str, source: str, target_type, target: str, once: bool = False) -> DataFrame:
        kind = F.lit(target_type) if isinstance(target_type, str) else target_type
        rows = df.select(F.lit(source_type).alias("source_type"), F.col(source).alias("source"), kind.alias("target_type"), F.col(target).alias("target"))
        rows = rows.where("target is not null and target_type is not null")
        if once:
            return rows
        return rows.distinct() if tasks is None else rows.distinct().repartition(tasks, *rows.columns).distinct()

    names = F.create_map(*[F.lit(x) for pair in ENTRY_TARGETS.items() for x in pair])
    found = []
    if directory_entry is not None:
        found.append(edge(directory_entry, "directory", "directory_id", names[F.col("type")], "target"))
    if revision is not None:
        found.append(edge(revision, "revision", "id", "directory", "directory", once=True))
    if revision_parent is not None:
        found.append(edge(revision_parent, "revision", "id", "revision", "parent_id"))
    if release is not None:
        found.append(edge(release, "release", "id", F.col("target_type"), "target", once=True))
    if snapshot_branch is not None:
        found.append(edge(snapshot_branch.where("target_type <> 'alias'"), "snapshot", "snapshot_id", F.col("target_type"), "target"))
    if origin_visit_status is not None:
        hashed = origin_visit_status.withColumn("origin", F.sha1(F.col("origin").cast("binary")))
        found.append(edge(hashed, "origin", "origin", "snapshot", "snapshot"))
    return reduce(DataFrame.unionByName, found)


def object_references_add(new: DataFrame, table: DataFrame | None, date: datetime.date, open_weeks: set[tuple[int, int]] | None = None, tasks: int | None = None) -> DataFrame:
    """References to append on a day, with their ISO week; the week's partition must be open, where that is asked.

    Rows are made distinct and compared over ``tasks`` tasks, if given.
    """
    week = tuple(date.isocalendar())[:2]
    if open_weeks is not None and week not in open_weeks:
        raise ArgumentError(f"no partition for week {week}")
    keys = ["source_type", "source", "target_type", "target"]
    dealt = lambda df: df if tasks is None else df.repartition(tasks, *keys)
    rows = dealt(new).distinct()
    if table is not None:
        rows = rows.join(dealt(table.where(F.col("date") == F.lit(date)).select(*keys)), keys, "left_anti")
    return rows.withColumn("date", F.lit(date)).withColumn("iso_year", F.lit(week[0])).withColumn("iso_week", F.lit(week[1]))


def object_find_recent_references(asked: DataFrame, table: DataFrame, limit: int, buckets: int = 16, tasks: int | None = None) -> DataFrame:
    """At most ``limit`` sources of each target over all weeks, by (type, id).

    A target's sources are dealt over ``buckets`` by their ids, and over ``tasks`` tasks, if given; each bucket keeps its first
    ranks, and of those the first are kept. Sources are ranked alike where weeks repeat them, and made distinct in between.
    """
    keys = ["target_type", "target"]
    dealt = lambda df: df if tasks is None else df.repartition(tasks, *keys, "_bucket")
    bucket = F.pmod(F.xxhash64("source_type", "source"), F.lit(buckets)).cast("int")
    many = asked.select(*keys).distinct().withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    rows = dealt(table.select(*keys, "source_type", "source").withColumn("_bucket", bucket)).join(dealt(many), [*keys, "_bucket"])
    first = lambda df, *by: df.withColumn("ord", F.dense_rank().over(Window.partitionBy(*by).orderBy("source_type", "source"))).where(F.col("ord") <= limit)
    few = first(rows, *keys, "_bucket").select(*keys, "source_type", "source").distinct()
    return first(few, *keys)


def week_bounds(iso_year: int, iso_week: int) -> tuple[datetime.date, datetime.date]:
    """Monday, and the next Monday."""
    monday = datetime.date.fromisocalendar(iso_year, iso_week, 1)
    return monday, monday + datetime.timedelta(days=7)


def weeks_between(first: datetime.date, last: datetime.date) -> list[tuple[int, int]]:
    """Weeks to open for a span of days."""
    days = (last - first).days
    return sorted({tuple((first + datetime.timedelta(days=d)).isocalendar())[:2] for d in range(days + 1)})


def weeks_to_drop(weeks: list[tuple[int, int]], before: datetime.date) -> list[tuple[int, int]]:
    """Weeks that end by a day; refuses to drop all."""
    old = [w for w in weeks if week_bounds(*w)[1] <= before]
    if weeks and len(old) == len(weeks):
        raise ArgumentError("this would drop every partition")
    return old
