"""Adding, updating, deduplicating contents, and the collisions of their hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.errors import ArgumentError, HashCollision
from quarry.functions.identity import check_hash_name, content_hashes
from quarry.operators.membership import null_safe_missing
from quarry.schemas import HASHES
from quarry.session import cut


def first_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, nulls equal: the first in the order of the other columns, so the same each time (blobs and maps don't order)."""
    rest = [f.name for f in rows.schema if f.name not in (*keys, "data") and not isinstance(f.dataType, T.MapType)]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*(rest or [F.lit(0)])))
    return rows.withColumn("_n", nth).where("_n = 1").drop("_n")


def new_rows(new: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key of ``new`` that ``table`` lacks; nulls equal nulls. What every *add* appends."""
    return null_safe_missing(first_rows(new, keys), table, keys)


def content_add(new: DataFrame, content: DataFrame, now=None, on_collision: str = "add", report: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(rows to append, one-row summary): the key is all hashes together; ``ctime`` is now.

    A content that shares some hash with another one, but not all, collides: it is added and counted, or with
    ``on_collision="raise"`` is an error that names up to ``report`` hashes. ``collisions`` gives the rows to log.
    """
    if on_collision not in ("add", "raise"):
        raise ArgumentError(f"no way {on_collision} to treat a collision")
    if on_collision == "raise" and (found := hash_collisions(new, content).limit(report).collect()):
        raise HashCollision([(r["algo"], r["hash"]) for r in found])
    keys = [h for h in HASHES if h in content.columns]
    rows = new_rows(new, content, keys).withColumn("ctime", F.lit(now).cast("timestamp") if now is not None else F.current_timestamp())
    clashing = collisions(new, content).select(*keys).distinct()
    counted = rows.select("length", F.lit(1).alias("added"), F.lit(0).alias("clashing")).unionByName(clashing.select(F.lit(0).alias("length"), F.lit(0).alias("added"), F.lit(1).alias("clashing")))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return rows, counted.agg(total("added", "content_add"), total("length", "content_add_bytes"), total("clashing", "content_add_collision"))


def skipped_content_add(new: DataFrame, skipped: DataFrame, now=None) -> DataFrame:
    keys = [h for h in ("sha1", "sha1_git", "sha256") if h in skipped.columns]
    return new_rows(new, skipped, keys).withColumn("ctime", F.lit(now).cast("timestamp") if now is not None else F.current_timestamp())


def skipped_content_find(skipped: DataFrame, origins: DataFrame, **hashes) -> DataFrame:
    """Skipped contents with all given hashes, with their origin's url where it is known."""
    if not hashes:
        raise ArgumentError("at least one hash is needed")
    for h in hashes:
        check_hash_name(h)
    rows = skipped.where(reduce(lambda a, b: a & b, [F.col(h) == F.lit(v) for h, v in hashes.items()]))
    return rows.join(origins.select(F.col("url").alias("origin")).distinct().withColumn("origin_known", F.lit(True)), "origin", "left")


def content_update(content: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """The table with ``columns`` taken from the update of equal ``sha1``; of several updates of one hash the greatest."""
    own = updates.groupBy("sha1").agg(F.max(F.struct(*columns)).alias("_new"))
    joined = content.join(own, "sha1", "left")
    return joined.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in content.columns])


def content_get_data(ids: DataFrame, content: DataFrame, data: DataFrame, by: str = "sha1") -> DataFrame:
    """Blobs by one hash: the hash leads to the sha256, that to the bytes; null where either is missing."""
    check_hash_name(by)
    # of colliding contents the one with the least sha256
    keys = content.groupBy(by).agg(F.min("sha256").alias("sha256")) if by != "sha256" else content.select("sha256").distinct()
    return ids.join(keys, by, "left").join(data, "sha256", "left")


def hash_collisions(new: DataFrame, content: DataFrame) -> DataFrame:
    """``(algo, hash, contents)``: hashes that belong to more than one content, in the batch or against the table.

    Each content is stacked into a row per hash; only hashes that occur in the batch are looked at.
    """
    keys = [h for h in HASHES if h in new.columns]

    def stacked(df: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(h).alias("algo"), F.col(h).alias("hash")) for h in keys])
        return df.select(F.struct(*keys).alias("content"), F.explode(pairs).alias("p")).select("p.algo", "p.hash", "content").where("hash is not null")

    mine = stacked(new.select(*keys).distinct())
    theirs = stacked(content.select(*keys).distinct()).join(mine.select("algo", "hash").distinct(), ["algo", "hash"], "left_semi")
    every = mine.unionByName(theirs).distinct()
    return every.groupBy("algo", "hash").agg(F.count("*").alias("contents")).where("contents > 1")


def collisions(new: DataFrame, content: DataFrame) -> DataFrame:
    """The rows of ``new`` that collide, once for each of their hashes that does, with ``algo`` and ``hash``: what an add logs."""
    bad = hash_collisions(new, content).select("algo", "hash")
    found = [new.join(bad.where(F.col("algo") == h).select("algo", F.col("hash").alias(h)), h).withColumn("hash", F.col(h)) for h in HASHES if h in new.columns]
    return reduce(DataFrame.unionByName, found)


def without_collisions(new: DataFrame, content: DataFrame) -> DataFrame:
    """The batch without the contents that collide: what a replay adds after it has reported them."""
    bad = hash_collisions(new, content)
    for h in [h for h in HASHES if h in new.columns]:
        new = new.join(bad.where(F.col("algo") == h).select(F.col("hash").alias(h)), h, "left_anti")
    return new


def validate_contents(contents: DataFrame, data: str = "data") -> DataFrame:
    """``contents`` with ``valid boolean``: every given hash and the length are those of the bytes."""
    found = content_hashes(data)
    same = [F.col(h).isNull() | (F.lower(F.hex(h)) == found[h]) for h in HASHES if h in contents.columns]
    same.append(F.col("length") == F.octet_length(data))
    return contents.withColumn("valid", reduce(lambda a, b: a & b, same))


def content_find_directory(ids: DataFrame, entries: DataFrame, max_depth: int = 100) -> DataFrame:
    """``(id, directory_id, path)``: one root directory and path for each content, climbing parents.

    Of several parents the one with the smallest (directory, name) is climbed, so the answer is fixed. A content
    in no directory gives no row. One join per level, over all contents at once; ``RecursionError`` where a root is more
    than ``max_depth`` levels up.
    """
    up = entries.groupBy("target").agg(F.min(F.struct("directory_id", "name")).alias("p")).select("target", F.col("p.directory_id").alias("parent"), F.col("p.name").alias("step"))
    now = ids.select("id").distinct().join(up, ids["id"] == up["target"]).select("id", F.col("parent").alias("directory_id"), F.col("step").alias("path"))
    slash = F.lit("/") if dict(now.dtypes)["path"] == "string" else F.lit(bytearray(b"/"))
    up, _ = cut(up, "parents")
    done = []
    for _ in range(max_depth):
        climbed, on = cut(now.join(up, now["directory_id"] == up["target"], "left").select("id", "directory_id", "path", "parent", "step"), "climb", "parent is not null")
        done.append(climbed.where("parent is null").select("id", "directory_id", "path"))
        rising = climbed.where("parent is not null")
        if not on:
            return reduce(DataFrame.unionByName, done)
        now = rising.select("id", F.col("parent").alias("directory_id"), F.concat("step", slash, "path").alias("path"))
    raise RecursionError(f"directories nest deeper than {max_depth}")
