"""External ids and extrinsic metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.errors import ArgumentError, UnknownObject
from quarry.operators.content import new_rows

EXTID = ["extid_type", "extid", "extid_version", "target_type", "target"]


def extid_add(new: DataFrame, extids: DataFrame) -> DataFrame:
    return new_rows(new, extids, EXTID)


def extid_get_from_extid(asked: DataFrame, extids: DataFrame, version: int | None = None) -> DataFrame:
    """All matches of ``asked(ord, extid_type, extid)``, by ``ord``."""
    rows = extids if version is None else extids.where(F.col("extid_version") == version)
    return asked.join(rows, ["extid_type", "extid"])


def extid_get_from_target(asked: DataFrame, extids: DataFrame, extid_type: str | None = None, extid_version: int | None = None) -> DataFrame:
    """All matches of ``asked(ord, target_type, target)``; type and version only together."""
    if (extid_type is None) != (extid_version is None):
        raise ArgumentError("extid_type and extid_version go together")
    if extid_type is not None:
        extids = extids.where((F.col("extid_type") == extid_type) & (F.col("extid_version") == extid_version))
    return asked.join(extids, ["target_type", "target"])


def extid_delete_for_target(targets: DataFrame, extids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes)."""
    keys = ["target_type", "target"]
    return extids.join(targets, keys, "left_anti"), extids.join(targets, keys, "left_semi")


def raw_extrinsic_metadata_add(new: DataFrame, table: DataFrame, authorities: DataFrame, fetchers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, their number by target type); an unknown authority or fetcher is an error."""
    for columns, known in ((("authority_type", "authority_url"), authorities), (("fetcher_name", "fetcher_version"), fetchers)):
        named = known.toDF(*columns)
        lost = new.join(named, list(columns), "left_anti").select(*columns).distinct().limit(10).collect()
        if lost:
            raise UnknownObject([tuple(r) for r in lost])
    rows = new_rows(new, table, ["id"])
    return rows, rows.groupBy("target_type").agg(F.count("*").alias("n"))


def raw_extrinsic_metadata_get(asked: DataFrame, table: DataFrame, by: list[str], after=None) -> DataFrame:
    """Rows of ``asked``'s (target, authority), later than ``after`` (a date, or a (date, id) from a page's end)."""
    rows = asked.join(table, by)
    if isinstance(after, tuple):
        return rows.where(F.struct("discovery_date", "id") > F.struct(F.lit(after[0]).alias("discovery_date"), F.lit(after[1]).alias("id")))
    return rows if after is None else rows.where(F.col("discovery_date") > F.lit(after))


def raw_extrinsic_metadata_get_by_ids(ids: DataFrame, table: DataFrame) -> DataFrame:
    return table.join(ids.select("id").distinct(), "id", "left_semi")


def raw_extrinsic_metadata_get_authorities(asked: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    return asked.join(table, "target").select("target", *columns).distinct()


def dimension_add(new: DataFrame, table: DataFrame) -> DataFrame:
    """New authorities or fetchers."""
    return new_rows(new, table, table.columns)
