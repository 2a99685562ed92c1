"""A two-pass external shuffle of a table into shards, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialised


def row_bytes(text: str) -> F.Column:
    """UTF-8 bytes of a text (none if null) and eight for the row itself."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def shuffle_into_shards(
    df: DataFrame,
    shards: int = 24,
    seed: int = 20240229,
    bucket_bytes: int = 16 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All rows and columns of ``df`` with ``shard int`` and ``slot long``: a uniform random order, cut evenly.

    Pass one scatters rows by a seeded hash into buckets of about ``bucket_bytes`` (and no fewer than there are
    shuffle partitions). Pass two puts each bucket in an order that its content alone decides and permutes it by
    Fisher-Yates (``shuffle`` on the bucket's positions; the rows themselves are never gathered into an array, so
    a bucket may spill). Buckets follow one another; shard s takes positions floor(s*n/shards) up to the next
    shard's first, so shards differ by one row at most, and ``slot`` counts from 0 in each without gaps. The same
    input, seed and number of shuffle partitions give the same order, also when tasks run again.

    Nulls, empty and repeated rows are rows like others (equal rows may trade places); copies with different ids
    scatter, and where one id and text together repeat so often that they fill a bucket, each repeat is scattered by its
    number: such rows are counted first, so the shuffle gets one of them per task. An empty table gives none. Input
    columns named ``shard`` or ``slot`` are replaced.
    """
    rows = df.select([c for c in df.columns if c.lower() not in ("shard", "slot")])
    names = rows.columns
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.xxhash64(F.lit(seed), id_col, text_col).alias("key")
    # one short row for each id and text: what follows up to pass two reads these and not the texts
    keys, _ = materialised(rows.select(key, row_bytes(text_col).alias("size")).groupBy("key").agg(F.count("*").alias("n"), F.max("size").alias("size")), "keys")
    total, hottest = keys.agg(F.sum(F.col("n") * F.col("size")), F.max(F.when(F.col("n") > 1, F.col("n") * F.col("size")))).first()
    buckets = max(parts, -(-(total or 0) // bucket_bytes))

    scattered = rows.select(F.struct(*names).alias("row"), key)
    if (hottest or 0) > bucket_bytes:
        hot = keys.where((F.col("n") > 1) & (F.col("n") * F.col("size") > bucket_bytes)).select("key")
        again = scattered.join(hot, "key", "left_semi").groupBy("row", "key").agg(F.count("*").alias("n"))
        again, _ = materialised(again.select("row", F.xxhash64("key", "row").alias("key"), "n"), "repeats")
        each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
        apart = lambda df, *more: df.withColumn("nth", each).select(*more, F.xxhash64("key", "nth").alias("key"))
        scattered = scattered.join(hot, "key", "left_anti").select("row", "key").unionByName(apart(again, "row"))
        keys = keys.join(hot, "key", "left_anti").select("key", "n").unionByName(apart(again).withColumn("n", F.lit(1).cast("long")))
    scattered = scattered.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    counts = keys.groupBy(F.pmod("key", F.lit(buckets)).alias("bucket")).agg(F.sum("n").alias("n"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one row per bucket: a few million for 100 TB
    bases = counts.select("bucket", "n", (F.sum("n").over(upto) - F.col("n")).alias("base"), F.sum("n").over(every).alias("all"))
    # shuffle() draws from the seed and the partition's number: both and the order in it are fixed here
    dealt = bases.repartition(parts, "bucket").sortWithinPartitions("bucket")
    dealt = dealt.select("bucket", "base", "all", F.shuffle(F.sequence(F.lit(0), F.col("n").cast("int") - 1), F.lit(seed)).alias("at"))

    order = Window.partitionBy("bucket").orderBy("key", F.col(f"row.{id_col}"), F.col(f"row.{text_col}"))
    ranked = scattered.withColumn("k", F.row_number().over(order))
    placed = ranked.join(dealt.hint("merge"), "bucket").withColumn("place", F.col("base") + F.get("at", F.col("k") - 1))
    shard = F.expr(f"((place + 1) * {shards} - 1) div all")
    placed = placed.select("row", "place", "all", shard.alias("to"))
    return placed.select("row.*", F.col("to").cast("int").alias("shard"), F.expr(f"place - to * all div {shards}").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write what ``shuffle_into_shards`` returns under ``path``, a folder per shard, each file in slot order.

    Buckets stay in the tasks that hold them: a bucket lies in one or two shards, so a task writes few files.
    """
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
