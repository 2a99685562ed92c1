"""Pages, hash-space partitions, aligned lookups and random rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.errors import ArgumentError
from quarry.session import cut

#: Rows that one task of a large shuffle should get.
ROWS_OF_A_TASK = 500_000


def tasks_for(df: DataFrame, rows: int | None = None) -> int:
    """Over how many tasks to deal ``df`` so that what one of them holds stays the same as the table grows.

    ``rows``, if the caller knows them; else they are counted, which only reads the footers of files.
    """
    rows = df.count() if rows is None else rows
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_OF_A_TASK))


def page(df: DataFrame, keys: list[str], limit: int, after: tuple | None = None, descending: bool = False) -> tuple[DataFrame, tuple | None]:
    """The first ``limit`` rows past ``after`` in the order of ``keys``, and the token of the next page (None: no more).

    The token is the last returned row's keys; ``keys`` must order rows totally. Pages are a top-k over all
    partitions, never a full sort.
    """
    if limit <= 0:
        raise ArgumentError("limit must be positive")
    if after is not None:
        mark = F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, after, strict=True)])
        here = F.struct(*keys)
        df = df.where(here < mark if descending else here > mark)
    order = [F.desc(k) if descending else F.asc(k) for k in keys]
    found = df.select(*keys).orderBy(*order).limit(limit + 1).collect()  # one page of keys
    return df.orderBy(*order).limit(limit), tuple(found[limit - 1]) if len(found) > limit else None


def page_from(df: DataFrame, keys: list[str], limit: int, start: tuple | None = None) -> tuple[DataFrame, tuple | None]:
    """As ``page``, but the token is the first row that was not returned, and ``start`` is included."""
    if limit <= 0:
        raise ArgumentError("limit must be positive")
    if start is not None:
        df = df.where(F.struct(*keys) >= F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, start, strict=True)]))
    order = [F.asc(k) for k in keys]
    found = df.select(*keys).orderBy(*order).limit(limit + 1).collect()  # one page of keys
    return df.orderBy(*order).limit(limit), tuple(found[limit]) if len(found) > limit else None


def leading_digits(part: int, parts: int, digit_bits: int = 4) -> list[int]:
    """The first digits, most significant first, of the least hash in a part of the hash space.

    ``parts`` is a power of two, so a part is what begins with certain bits; whole digits of ``digit_bits`` that hold them
    are enough to compare by, as a longer string that begins alike sorts after.
    """
    bits = parts.bit_length() - 1
    if parts < 1 or parts != 1 << bits:
        raise ArgumentError(f"hash space is cut by leading bits, which can't give {parts} parts")
    if part not in range(parts):
        raise ArgumentError(f"there is no part {part} of {parts}")
    count = -(-bits // digit_bits)
    filled = part << count * digit_bits - bits
    return [filled >> digit_bits * k & (1 << digit_bits) - 1 for k in reversed(range(count))]


def in_partition(column: str, part: int, parts: int, as_hex: bool = False) -> Column:
    """Whether a binary or, ``as_hex``, lower-case hex hash is in the part: a range, which is pushed down to the files."""

    def least(k: int) -> Column:
        digits = leading_digits(k, parts, 4 if as_hex else 8)
        return F.lit("".join(f"{d:x}" for d in digits) if as_hex else bytearray(digits))

    own = F.col(column) >= least(part)
    return own if part + 1 == parts else own & (F.col(column) < least(part + 1))


def get_partition(df: DataFrame, key: str, part: int, parts: int, limit: int | None = None, start=None, as_hex: bool = False) -> tuple[DataFrame, object]:
    """Rows of one part of the hash space in order of ``key``; with ``limit`` one page and the next page's first key."""
    rows = df.where(in_partition(key, part, parts, as_hex))
    if limit is None:
        return rows.orderBy(key), None
    found, token = page_from(rows, [key], limit, None if start is None else (start,))
    return found, token and token[0]


def aligned(ids: DataFrame, table: DataFrame, on: str | list[str], order: str = "ord") -> DataFrame:
    """One row per row of ``ids``, nulls where the table has none; ``order`` tells the input's order."""
    return ids.join(table, on, "left")


def random_row(df: DataFrame, key: str, seed: int) -> DataFrame:
    """The row with the least key at or above one drawn from ``seed``, or else the least of all: no scan is sorted."""
    drawn = F.sha1(F.lit(str(seed)).cast("binary"))
    text = F.lower(F.hex(F.col(key))) if dict(df.dtypes)[key] == "binary" else F.col(key)
    return df.withColumn("_low", text < drawn).orderBy("_low", key).limit(1).drop("_low")


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of each group the row with the greatest ``order``; partial maxima are taken before the shuffle."""
    rest = F.struct(*order, *[c for c in df.columns if c not in order and c not in by])
    best = df.groupBy(*by).agg(F.max_by(rest, F.struct(*order)).alias("_best"))
    return best.select(*by, *[F.col(f"_best.{c}").alias(c) for c in df.columns if c not in by])


def numbered(df: DataFrame, order: list, name: str = "_at", total: str | None = None) -> DataFrame:
    """``df`` with each row's place in ``order``, from 0, as ``name`` and, if asked, the running sum of ``total`` before it as ``<name>_sum``.

    Rows are sorted by ranges over all tasks and written once; a row's place is that in its range and what the ranges before
    it hold. No task sees more than its range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt, _ = cut(dealt.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    part, inside = F.shiftright("_row", 33), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    dealt = dealt.withColumn("_part", part)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"), *([F.sum(total).alias("_s")] if total else []))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), *([F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_sum")] if total else []))
    out = dealt.join(sizes, "_part").withColumn(name, inside + F.col("_base"))
    if total:
        own = F.sum(total).over(Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn(f"{name}_sum", F.coalesce(own, F.lit(0)) + F.col("_sum")).drop("_sum")
    return out.drop("_part", "_row", "_base")
