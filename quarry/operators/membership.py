"""What is known and what is missing: semi and anti joins over lists of ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.errors import ArgumentError
from quarry.functions.identity import check_hash_name
from quarry.schemas import HASHES


def missing(ids: DataFrame, table: DataFrame, on: str | list[str] = "id") -> DataFrame:
    """Rows of ``ids`` that the table lacks (directories, revisions, releases, snapshots, origins, ...)."""
    return ids.join(table, on, "left_anti")


def known(ids: DataFrame, table: DataFrame, on: str | list[str] = "id") -> DataFrame:
    return ids.join(table, on, "left_semi")


def null_safe_missing(ids: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """As ``missing``, where a null equals a null."""
    match = reduce(lambda a, b: a & b, [F.col(f"i.{c}").eqNullSafe(F.col(f"t.{c}")) for c in on])
    return ids.alias("i").join(table.alias("t"), match, "left_anti")


def content_missing(ids: DataFrame, content: DataFrame, key_hash: str = "sha1") -> DataFrame:
    """``key_hash`` of the rows of ``ids`` whose given hashes no single content has; rows may leave hashes null.

    A row is looked up by its first given hash (an equality that joins by hash), and the other given ones are
    compared on what that finds. Rows without any hash are missing.
    """
    check_hash_name(key_hash)
    given = [h for h in HASHES if h in ids.columns]
    if not given:
        raise ArgumentError("no known hash among the columns")
    out = None
    rest = ids
    for at, h in enumerate(given):
        own = rest.where(F.col(h).isNotNull()).alias("i")
        match = F.col(f"i.{h}") == F.col(f"t.{h}")
        for other in given[at + 1 :]:
            match &= F.col(f"i.{other}").isNull() | (F.col(f"i.{other}") == F.col(f"t.{other}"))
        lost = own.join(content.select(*given).alias("t"), match, "left_anti")
        out = lost if out is None else out.unionByName(lost)
        rest = rest.where(F.col(h).isNull())
    return out.unionByName(rest).select(key_hash)


def skipped_content_missing(ids: DataFrame, skipped: DataFrame, on: tuple[str, ...] = ("sha1", "sha1_git", "sha256")) -> DataFrame:
    return null_safe_missing(ids, skipped, list(on))


def content_find(content: DataFrame, **hashes) -> DataFrame:
    """Contents that have all the given hashes; more than one where hashes collide."""
    if not hashes:
        raise ArgumentError("at least one hash is needed")
    for h in hashes:
        check_hash_name(h)
    return content.where(reduce(lambda a, b: a & b, [F.col(h) == F.lit(v) for h, v in hashes.items()]))


def content_get(ids: DataFrame, content: DataFrame, algo: str = "sha1") -> DataFrame:
    """Aligned contents by one hash (``ids(ord, <algo>)``), of equal ones that with the greatest other hashes."""
    check_hash_name(algo)
    rest = [h for h in HASHES if h in content.columns and h != algo]
    row = F.struct(*rest, *[c for c in content.columns if c not in (*rest, algo, "ctime")])
    one = content.where(F.col(algo).isNotNull()).groupBy(algo).agg(F.max_by(row, F.struct(*rest)).alias("c"))
    return ids.join(one, algo, "left").select("ord", algo, "c.*")


def object_find_by_sha1_git(ids: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``(id, object_type)`` for every table that has the id; ids that none has come with a null type.

    ``tables``: object type -> (table, its id column).
    """
    every = reduce(DataFrame.unionByName, [t.select(F.col(c).alias("id"), F.lit(kind).alias("object_type")) for kind, (t, c) in tables.items()])
    return ids.select("id").distinct().join(every.distinct(), "id", "left")


def known_identifiers(asked: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows of ``asked(object_type, id)`` whose object is in the archive."""
    every = reduce(DataFrame.unionByName, [t.select(F.lit(kind).alias("object_type"), F.col(c).alias("id")) for kind, (t, c) in tables.items()])
    return asked.join(every, ["object_type", "id"], "left_semi")


def discover(contents: DataFrame, skipped: DataFrame, directories: DataFrame, have: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What of each kind an archive lacks, by ``sha1_git`` or ``id``."""
    return {
        "content": missing(contents, have["content"], "sha1_git"),
        "skipped_content": missing(skipped, have["skipped_content"], "sha1_git"),
        "directory": missing(directories, have["directory"], "id"),
    }


def filter_known(kind: str, new: DataFrame, table: DataFrame) -> DataFrame:
    """What a write has to add: contents by sha256, skipped contents by sha1_git (a null one always passes), others by id."""
    key = {"content": "sha256", "skipped_content": "sha1_git"}.get(kind, "id")
    return new.join(table.where(F.col(key).isNotNull()), key, "left_anti").select(*new.columns)
