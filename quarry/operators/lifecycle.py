"""Counters, deletion and repairs."""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarry.errors import ArgumentError


def stat_counters(tables: dict[str, DataFrame]) -> DataFrame:
    """``(label, value)``: exact row counts, from file footers where the tables are files."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("value")).select(F.lit(n).alias("label"), "value") for n, t in tables.items()])


def bucket_of(key: str, buckets: int) -> F.Column:
    """A bucket by the first 32 bits of the key's SHA-1."""
    return (F.conv(F.substring(F.sha1(F.col(key).cast("binary")), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def bucketed_counters(table: DataFrame, key: str, buckets: int) -> DataFrame:
    """``(bucket, value)`` by hash of the key; recompute one bucket by filtering it."""
    return table.groupBy(bucket_of(key, buckets).alias("bucket")).agg(F.count("*").alias("value"))


def refresh_bucket(counters: DataFrame, table: DataFrame, key: str, buckets: int, now) -> DataFrame:
    """``counters(bucket, value, updated)`` with the stalest bucket (never counted first, then the oldest) counted anew."""
    stale = counters.orderBy(F.asc_nulls_first("updated"), "bucket").limit(1).collect()
    if not stale:
        raise ArgumentError("no buckets")
    n = table.where(bucket_of(key, buckets) == stale[0].bucket).count()
    hit = F.col("bucket") == stale[0].bucket
    return counters.select("bucket", F.when(hit, F.lit(n)).otherwise(F.col("value")).alias("value"), F.when(hit, F.lit(now)).otherwise(F.col("updated")).alias("updated"))


def roll_up(counters: DataFrame) -> DataFrame:
    """``(object_type, value)`` of the types all of whose buckets have a value."""
    done = counters.groupBy("object_type").agg(F.sum("value").alias("value"), F.count_if(F.col("value").isNull()).alias("_open"))
    return done.where("_open = 0").select("object_type", "value")


def object_delete(asked: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables as they stay, ``(table, removed)``) after deleting ``asked(object_type, id)``.

    ``tables``: name -> (table, its column that refers to the deleted object). A table named ``type.child`` loses the
    rows that hang on a deleted object of the type (visits and statuses of an origin, branches of a snapshot, parents
    of a revision). Nothing is changed in place: write what stays to a new version.
    """
    kept, counts = {}, []
    for name, (table, column) in tables.items():
        gone = asked.where(F.col("object_type") == name.split(".")[0]).select(F.col("id").alias(column)).distinct()
        kept[name] = table.join(gone, column, "left_anti")
        counts.append(table.join(gone, column, "left_semi").agg(F.count("*").alias("removed")).select(F.lit(name).alias("table"), "removed"))
    return kept, reduce(DataFrame.unionByName, counts)


def fix_objects(rows: DataFrame) -> DataFrame:
    """Repairs of objects from old change logs: the deprecated ``metadata`` column goes, and an extrinsic metadata row
    of ``type`` origin whose target is a url gets the origin's identifier instead.
    """
    out = rows.drop("metadata")
    if {"type", "target"} <= set(out.columns) and dict(out.dtypes)["target"] == "string":
        url = F.col("target").rlike("^[a-z+]+://")
        hashed = F.concat(F.lit("obj:1:ori:"), F.sha1(F.col("target").cast("binary")))
        out = out.withColumn("target", F.when((F.col("type") == "origin") & url, hashed).otherwise(F.col("target"))).drop("type")
    return out


def byte_ranges(bits: int, start: str = "", end: str | None = None) -> list[tuple[str | None, str | None]]:
    """Hex bounds that cut the hash space into 2**bits ranges, limited to [start, end): the units of a full scan."""
    if not 0 < bits <= 32:
        raise ArgumentError("bits must be 1 to 32")
    width = -(-bits // 8) * 2
    marks = [f"{i << (4 * width - bits):0{width}x}" for i in range(1 << bits)]
    marks = [m for m in marks if m > start.ljust(width, "0") and (end is None or m < end.ljust(width, "0"))]
    edges: list[str | None] = [start or None, *marks, end]
    return list(zip(edges[:-1], edges[1:], strict=True))


def int_ranges(low: int, high: int, most: int) -> list[tuple[int, int]]:
    """Half-open ranges of at most ``most`` ids that cover [low, high): units of a scan by a growing id."""
    if most <= 0:
        raise ArgumentError("a range holds one id at least")
    return [(a, min(a + most, high)) for a in range(low, high, most)]


def in_int_ranges(table: DataFrame, key: str, low: int, high: int, most: int) -> DataFrame:
    """``table`` with ``range long``: the number of the range of ``int_ranges(low, high, most)`` that the key is in; other rows go.

    Reckoned from the key, so the number of ranges costs nothing.
    """
    if most <= 0:
        raise ArgumentError("a range holds one id at least")
    number = F.expr(f"(cast(`{key}` as bigint) - {low}) div {most}")
    return table.where((F.col(key) >= F.lit(low)) & (F.col(key) < F.lit(high))).withColumn("range", number)


def _owners(ranges: list[tuple]) -> tuple[list, list[int | None]]:
    """The ranges' bounds in order, and of each stretch between them (the first lies before all) the first range that holds it."""
    marks = sorted({b for r in ranges for b in r if b is not None})
    owners: list[int | None] = [None] * (len(marks) + 1)
    for number, (a, b) in enumerate(ranges):
        for i in range(0 if a is None else bisect_right(marks, a), len(owners) if b is None else bisect_right(marks, b)):
            owners[i] = number if owners[i] is None else owners[i]
    return marks, owners


def in_ranges(table: DataFrame, key: str, ranges: list[tuple]) -> DataFrame:
    """``table`` with ``range int``: the number of the half-open range, of bytes, ints or identifiers alike, that the key is in; other rows go.

    Few ranges are compared one by one; many are searched in their order, as an expression of that length would fill the driver.
    """
    if len(ranges) <= 64:
        number = F.coalesce(*[F.when((F.lit(True) if a is None else F.col(key) >= F.lit(a)) & (F.lit(True) if b is None else F.col(key) < F.lit(b)), F.lit(i)) for i, (a, b) in enumerate(ranges)])
    else:
        marks, owners = _owners(ranges)

        @F.udf("int", useArrow=True)
        def number_of(value):
            return None if value is None else owners[bisect_right(marks, value)]

        number = number_of(key)
    return table.withColumn("range", number).where("range is not null")


def list_by_object_id(table: DataFrame, key: str, low, high, limit: int | None = None) -> DataFrame:
    """Rows whose object id is in [low, high), in order: a listing by ranges of a growing id."""
    rows = table.where((F.col(key) >= F.lit(low)) & (F.col(key) < F.lit(high))).orderBy(key)
    return rows if limit is None else rows.limit(limit)


def observed(df: DataFrame, name: str, byte_column: str | None = None):
    """``df`` and an ``Observation`` that has its row count (and bytes) once a job has run it; no job of its own."""
    seen = Observation(name)
    counts = [F.count("*").alias("rows")]
    if byte_column is not None:
        counts.append(F.coalesce(F.sum(byte_column), F.lit(0)).alias("bytes"))
    return df.observe(seen, *counts), seen
