"""Origins, their visits and the states of visits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.errors import ArgumentError, UnknownObject
from quarry.operators.content import first_rows
from quarry.plans.paging import latest, page
from quarry.schemas import VISIT_STATES


def origin_add(new: DataFrame, origins: DataFrame) -> DataFrame:
    """New origins, one per url, with the hash they are also found by."""
    return new.select("url").where("url is not null").distinct().join(origins, "url", "left_anti").withColumn("sha1", F.sha1(F.col("url").cast("binary")))


def origin_get(asked: DataFrame, origins: DataFrame) -> DataFrame:
    """Aligned by url: ``known`` tells whether it is there."""
    return asked.join(origins.select("url", F.lit(True).alias("known")).distinct(), "url", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def origin_get_by_sha1(asked: DataFrame, origins: DataFrame) -> DataFrame:
    """Aligned by the hex SHA-1 of the url."""
    return asked.join(origins.select("url", F.sha1(F.col("url").cast("binary")).alias("sha1")).distinct(), "sha1", "left")


def origin_list(origins: DataFrame, limit: int, after: str | None = None) -> tuple[DataFrame, tuple | None]:
    return page(origins, ["url"], limit, None if after is None else (after,))


def origin_search(origins: DataFrame, pattern: str, regexp: bool = False, visits: DataFrame | None = None, statuses: DataFrame | None = None, snapshots: DataFrame | None = None, visit_types: list[str] | None = None) -> DataFrame:
    """Origins whose url has all words of ``pattern`` (or matches it), in any case.

    With ``statuses`` and ``snapshots``, only those with a visit whose snapshot is in the archive; with
    ``visit_types`` and ``visits``, only those visited so.
    """
    if regexp:
        rows = origins.where(F.col("url").rlike(f"(?i){pattern}"))
    else:
        rows = origins
        for word in pattern.split():
            rows = rows.where(F.contains(F.lower("url"), F.lit(word.lower())))
    if statuses is not None:
        seen = statuses.join(snapshots.select(F.col("id").alias("snapshot")), "snapshot", "left_semi")
        rows = rows.join(seen.select(F.col("origin").alias("url")), "url", "left_semi")
    if visit_types is not None:
        rows = rows.join(visits.where(F.col("type").isin(visit_types)).select(F.col("origin").alias("url")), "url", "left_semi")
    return rows


def origin_snapshot_get_all(asked: DataFrame, statuses: DataFrame) -> DataFrame:
    return statuses.where("snapshot is not null").join(asked.select("origin").distinct(), "origin", "left_semi").select("origin", "snapshot").distinct()


def origin_visit_add(new: DataFrame, origins: DataFrame, visits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(visits, their first statuses) to append; new ids follow the origin's greatest, in order of date and type.

    Rows that bring a ``visit`` keep it, and get no status. Unknown origins are an error. One batch at a time may
    be added to an archive, as numbers are given from what is there.
    """
    lost = new.join(origins.select(F.col("url").alias("origin")), "origin", "left_anti").select("origin").limit(10).collect()
    if lost:
        raise UnknownObject([r.origin for r in lost])
    last = visits.groupBy("origin").agg(F.max("visit").alias("_last"))
    given = F.col("visit") if "visit" in new.columns else F.lit(None).cast("long")
    rows = new.withColumn("visit", given).join(last, "origin", "left")
    mine = rows.where("visit is null").withColumn("visit", F.coalesce("_last", F.lit(0)) + F.row_number().over(Window.partitionBy("origin").orderBy("date", "type")))
    kept = rows.where("visit is not null").join(visits, ["origin", "visit"], "left_anti")
    columns = ["origin", F.col("visit").cast("long").alias("visit"), "date", "type"]
    first = mine.select(*columns, F.lit("created").alias("status"), F.lit(None).cast("binary").alias("snapshot"))
    return mine.select(*columns).unionByName(kept.select(*columns)), first


def origin_visit_status_add(new: DataFrame, visits: DataFrame, statuses: DataFrame) -> DataFrame:
    """Statuses to append, one per (origin, visit, date), their type by default the visit's; unknown visits are an error."""
    named = new.join(visits.select("origin", "visit", F.col("type").alias("_type"), F.lit(True).alias("_hit")), ["origin", "visit"], "left")
    lost = named.where("_hit is null").select("origin", "visit").limit(10).collect()
    if lost:
        raise UnknownObject([tuple(r) for r in lost])
    rows = named.withColumn("type", F.coalesce("type", "_type")).drop("_type", "_hit")
    return first_rows(rows, ["origin", "visit", "date"]).join(statuses, ["origin", "visit", "date"], "left_anti")


def filtered_statuses(statuses: DataFrame, type: str | None = None, allowed: list[str] | None = None, require_snapshot: bool = False) -> DataFrame:
    """Status rows under the filters that the *latest* lookups share; an error if none of the states exists."""
    if allowed and not set(allowed) & set(VISIT_STATES):
        raise ArgumentError(f"none of {allowed} is a state of visits")
    if type is not None:
        statuses = statuses.where(F.col("type") == type)
    if allowed:
        statuses = statuses.where(F.col("status").isin(allowed))
    return statuses.where("snapshot is not null") if require_snapshot else statuses


def origin_visit_get_latest(statuses: DataFrame, **filters) -> DataFrame:
    """Per origin, the greatest visit and its latest status that pass the filters, for all origins at once."""
    return latest(filtered_statuses(statuses, **filters), ["origin"], ["visit", "date"])


def origin_visit_status_get_latest(statuses: DataFrame, **filters) -> DataFrame:
    """Per origin and visit, the latest status that passes the filters."""
    return latest(filtered_statuses(statuses, **filters), ["origin", "visit"], ["date"])


def origin_get_latest_visit_status(statuses: DataFrame, **filters) -> DataFrame:
    """The latest status of the latest visit that has a status of that kind."""
    return origin_visit_get_latest(statuses, **filters)


def origin_visit_get(visits: DataFrame, origin: str, limit: int = 10, after: int | None = None, descending: bool = False) -> tuple[DataFrame, int | None]:
    rows, token = page(visits.where(F.col("origin") == origin), ["visit"], limit, None if after is None else (after,), descending)
    return rows, token and token[0]


def origin_visit_get_by(asked: DataFrame, visits: DataFrame) -> DataFrame:
    return asked.join(visits, ["origin", "visit"])


def origin_visit_find_by_date(asked: DataFrame, visits: DataFrame, type: str | None = None) -> DataFrame:
    """For each ``asked(ord, origin, at)`` the visit closest in time, of equally close ones the greatest id."""
    if type is not None:
        visits = visits.where(F.col("type") == type)
    apart = F.abs(F.unix_micros("date") - F.unix_micros("at"))
    rows = asked.join(visits, "origin")
    best = rows.groupBy("ord", "origin", "at").agg(F.min_by(F.struct("visit", "date", "type"), F.struct(apart, -F.col("visit"))).alias("v"))
    return best.select("ord", "origin", "at", "v.*")


def origin_visit_get_with_statuses(visits: DataFrame, statuses: DataFrame, allowed: list[str] | None = None, require_snapshot: bool = False) -> DataFrame:
    """Visits with their filtered statuses by date; those without any keep an empty list."""
    own = filtered_statuses(statuses, allowed=allowed, require_snapshot=require_snapshot)
    lists = own.groupBy("origin", "visit").agg(F.array_sort(F.collect_list(F.struct("date", "status", "snapshot"))).alias("statuses"))
    kind = lists.schema["statuses"].dataType
    return visits.join(lists, ["origin", "visit"], "left").withColumn("statuses", F.coalesce("statuses", F.array().cast(kind)))


def origin_visit_status_get_random(statuses: DataFrame, type: str, since, seed: int) -> DataFrame:
    """One full visit of a type since a time; the seed chooses."""
    rows = statuses.where((F.col("type") == type) & (F.col("status") == "full") & (F.col("date") >= F.lit(since)))
    drawn = F.sha1(F.concat_ws("/", "origin", F.col("visit").cast("string"), F.unix_micros(F.col("date").cast("timestamp")).cast("string"), F.lit(str(seed))).cast("binary"))
    return rows.orderBy(drawn, "origin", "visit", "date").limit(1)
