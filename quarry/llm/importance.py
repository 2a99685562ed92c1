"""Importance resampling by hashed n-gram models of target and raw text, with Gumbel top-k sampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialised
from quarry.llm.decontam import WordHasher, _parts, shingle_hashes

BUCKETS = 1 << 15


def features(hasher: WordHasher, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and every pair of neighbouring words of whole texts."""
    flat, counts, *_ = hasher.hashes([t.lower() for t in texts])
    owner = np.repeat(np.arange(len(texts)), counts)
    pairs = shingle_hashes(flat, 2)
    inside = owner[1:] == owner[:-1]
    hashes = np.concatenate([shingle_hashes(flat, 1), pairs[inside]])
    return np.concatenate([owner, owner[1:][inside]]), (hashes >> np.uint64(49)).astype(np.int64)


def target_ids(labels: DataFrame, id_col: str, condition: str, most: int) -> list[int]:
    """At most ``most`` ids of labelled target rows, by a hash of the id."""
    good = labels.where(condition).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
    return sorted(r[0] for r in good.orderBy(F.xxhash64("id", F.lit(31)), "id").limit(most).collect())


def fit(docs: DataFrame, target: list[int], id_col: str = "doc_id", text_col: str = "text", prior: float = 100.0) -> np.ndarray:
    """Log ratio of each bucket's share in the target documents and in all documents.

    Raw counts are raised by one each; the target's by ``prior`` counts spread as the raw model has them, so a
    bucket that neither side says much about has a ratio near that of its like.

    Counts are over every word and pair of every document; each map task adds up its own and sends one row per
    bucket it met, at most ``BUCKETS``. ``target`` is bounded by who chose it. No target gives all zeros.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chosen = np.array(target, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, raw, aim = WordHasher(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            good = np.isin(ids, chosen) & ~np.array(batch.column(0).is_null())
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, stop in _parts(texts):
                owner, bucket = features(hasher, texts[start:stop])
                raw += np.bincount(bucket, minlength=BUCKETS)
                aim += np.bincount(bucket[good[start:stop][owner]], minlength=BUCKETS)
        met = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(raw[met]), pa.array(aim[met])], names=["bucket", "raw", "aim"])

    counted = narrow.mapInArrow(count, "bucket long, raw long, aim long").groupBy("bucket").agg(F.sum("raw"), F.sum("aim"))
    raw, aim = np.ones(BUCKETS), np.zeros(BUCKETS)
    for bucket, a, b in counted.collect():
        raw[bucket] += a
        aim[bucket] += b
    raw /= raw.sum()
    return np.log((aim + prior * raw) / (aim.sum() + prior)) - np.log(raw)


def log_weights(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """``(id_col, features long, log_weight double, key double)``, one row per row of ``docs``.

    ``log_weight`` is the log ratio of the whole text's likelihoods under the two models (0 without words), ``key``
    that and a Gumbel variable drawn from a hash of the id, the text's length in words and the seed.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, w = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for start, stop in _parts(texts):
                owner, bucket = features(hasher, texts[start:stop])
                n[start:stop] = np.bincount(owner, minlength=stop - start)
                w[start:stop] = np.bincount(owner, ratio[bucket], minlength=stop - start)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(w)], names=["doc_id", "features", "log_weight"])

    weighed = narrow.mapInArrow(weigh, "doc_id long, features long, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", "features", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    out = weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))
    return out.withColumnRenamed("doc_id", id_col)


def gumbel_top_k(weighed: DataFrame, share: float, id_col: str = "doc_id") -> DataFrame:
    """``weighed`` with ``rank long`` (from 1, by falling key) and ``selected boolean``: the first ``ceil(share n)`` ranks.

    This draws that many rows without replacement with chances in proportion to their weights. Rows are sorted by
    ranges of the key over all tasks and numbered in each; what the driver gathers is one count per range. ``weighed`` must be a
    table that was written: it is read more than once, and no more after the ranks are written.
    """
    # short rows, 10 million to a task at most
    parts = max(int(weighed.sparkSession.conf.get("spark.sql.shuffle.partitions")), weighed.count() // 10_000_000)
    names = weighed.columns
    # rows equal in all these, however many, are told apart by their places in the table that was written
    order = [F.desc("key"), F.col(id_col), F.col("features"), F.monotonically_increasing_id()]
    dealt = weighed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            size = batch.num_rows
            columns = [*batch.columns, pa.array(np.full(size, part, np.int32)), pa.array(np.arange(n + 1, n + size + 1))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "_part", "_nth"])
            n += size

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in weighed.schema)
    numbered, _ = materialised(dealt.mapInArrow(number, f"{fields}, _part int, _nth long"), "ranked")
    counts = dict(map(tuple, numbered.groupBy("_part").count().collect()))  # one row per shuffle partition
    base, total = [], 0
    for k in range(parts):
        base.append(total)
        total += counts.get(k, 0)
    offset = F.get(F.array(*map(F.lit, base)), F.col("_part")) if parts <= 1 << 14 else None
    if offset is None:
        known = weighed.sparkSession.createDataFrame(list(enumerate(base)), "_part int, _base long")
        numbered, offset = numbered.join(F.broadcast(known), "_part"), F.col("_base")
    ranked = numbered.withColumn("rank", (offset + F.col("_nth")).cast("long"))
    return ranked.select(*names, "rank", (F.col("rank") <= math.ceil(share * total)).alias("selected"))


def resample(
    docs: DataFrame, labels: DataFrame, share: float = 0.5, condition: str = "quality = 1", id_col: str = "doc_id", text_col: str = "text", most_target: int = 20_000, seed: int = 7
) -> DataFrame:
    """``(id_col, features, log_weight, key, rank, selected)``, one row per row of ``docs``.

    The target model is counted on at most ``most_target`` documents that ``labels`` calls good (their ids alone
    are sent to the tasks), the raw model on all documents. ``ceil(share n)`` rows are selected. Null texts and
    texts without words weigh 1; rows with equal id and length share their draw; a null id is an id like others;
    an empty table gives none. Other columns are ignored.
    """
    ratio = fit(docs, target_ids(labels, id_col, condition, most_target), id_col, text_col)
    weighed, path = materialised(log_weights(docs, ratio, id_col, text_col, seed), "weighed")
    ranked = gumbel_top_k(weighed, share, id_col)
    discard(docs.sparkSession, path)
    return ranked
