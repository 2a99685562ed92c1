"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialised

WORD = 64


def sign_codes(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id long, code array<long>)``: bit i of the code, 64 to a long, is 1 if element i of the vector is positive.

    Vectors of any length: a code has as many longs as the longest vector needs, and what a shorter one lacks is 0,
    as are null elements. Rows with a null id or vector have no code and are left out.
    """
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    longest = rows.agg(F.max(F.size(vector_col))).first()[0] or 0
    words = max(1, -(-longest // WORD))
    bits = f"transform(slice({vector_col}, w * {WORD} + 1, {WORD}), (x, i) -> if(x > 0, shiftleft(1L, i), 0L))"
    code = F.expr(f"transform(sequence(0, {words - 1}), w -> aggregate({bits}, 0L, (a, x) -> a | x))")
    return rows.select(F.col(id_col).cast("long").alias("id"), code.alias("code"))


def segment_width(distinct: int) -> int:
    """Bits of a segment: of 8, 16 and 32 the one nearest to the logarithm of the number of codes, as many as a segment tells apart."""
    return 8 if distinct < 1 << 12 else 16 if distinct < 1 << 24 else 32


def _masks(bits: int, radius: int) -> np.ndarray:
    """All values of ``bits`` bits of which just ``radius`` are 1."""
    return np.array([sum(1 << b for b in c) for c in itertools.combinations(range(bits), radius)], np.uint64)


def _stacked(codes: pd.Series, words: int) -> np.ndarray:
    return np.stack(codes.to_numpy()).astype(np.int64).view(np.uint64) if len(codes) else np.zeros((0, words), np.uint64)


def _segments(codes: np.ndarray, width: int) -> np.ndarray:
    """The values of all segments of each code."""
    per = WORD // width
    shifts = np.arange(per, dtype=np.uint64) * np.uint64(width)
    return ((codes[:, :, None] >> shifts) & np.uint64((1 << width) - 1)).reshape(len(codes), -1)


class Bucket:
    """Codes whose values in one segment begin alike, found by what follows."""

    def __init__(self, codes: np.ndarray, tie: np.ndarray, rest: np.ndarray, bits: int):
        order = np.argsort(rest, kind="stable")
        self.codes, self.tie, self.bits = codes[order], tie[order], bits
        self.values, first = np.unique(rest[order], return_index=True)
        self.first = np.append(first, len(rest))

    def nearest(self, queries: np.ndarray, rest: np.ndarray, radius: int, k: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, code, distance): of the codes whose rest differs in just ``radius`` bits, each query's first k by distance and tie.

        Probes all values at that radius, or measures all values there are, whichever are fewer.
        """
        found = [(np.zeros(0, np.int64),) * 3]
        probes = math.comb(self.bits, radius) if radius <= self.bits else 0
        masks = _masks(self.bits, radius) if 0 < probes <= len(self.values) else None
        step = max(1, most // max(1, min(probes, len(self.values))))
        for start in range(0, len(queries) if probes else 0, step):
            own = rest[start : start + step, None]
            if masks is None:
                q, at = np.nonzero(np.bitwise_count(own ^ self.values) == radius)
            else:
                probed = own ^ masks
                at = np.minimum(np.searchsorted(self.values, probed), len(self.values) - 1)
                q, col = np.nonzero(self.values[at] == probed)
                at = at[q, col]
            size = self.first[at + 1] - self.first[at]
            # runs of queries whose candidates fit in memory together, a code's words compared one after another
            ends = np.cumsum(size)
            edge = 0
            while edge < len(q):
                upto = max(edge + 1, int(np.searchsorted(ends, (ends[edge - 1] if edge else 0) + most, "right")))
                n = size[edge:upto]
                begin = np.cumsum(n) - n
                code = np.repeat(self.first[at[edge:upto]] - begin, n) + np.arange(int(n.sum()))
                of = np.repeat(q[edge:upto] + start, n)
                far = np.zeros(len(of), np.int64)
                for w in range(self.codes.shape[1]):
                    far += np.bitwise_count(queries[of, w] ^ self.codes[code, w])
                found.append(_first(of, code, far, self.tie, k))
                edge = upto
        return _first(*(np.concatenate(x) for x in zip(*found, strict=True)), self.tie, k)


def _first(of: np.ndarray, code: np.ndarray, far: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((tie[code], far, of))
    of, code, far = of[order], code[order], far[order]
    keep = np.arange(len(of)) - np.searchsorted(of, of) < k
    return of[keep], code[keep], far[keep]


def hamming_top_k(codes: DataFrame, queries: DataFrame, k: int = 10, width: int | None = None, bucket: int = 1 << 15, chunk: int = 1 << 18) -> DataFrame:
    """``(query_id, rank, id, distance)``: for every row of ``queries(id, code)`` the ``k`` nearest other rows of ``codes(id, code)``.

    Order: Hamming distance, then id. A code is cut into segments of ``width`` bits, and is indexed under each of them:
    by the segment's number and the first bits of its value, so many that such a bucket has about ``bucket`` codes. In
    round r = 0, 1, 2, ... a query goes to the buckets whose first bits differ from its own in j <= r bits, and
    there meets the codes whose other bits of the segment differ in r - j. Each bucket returns its first ``k + 1`` codes,
    with true distances. A code that no segment matches within r bits differs in r + 1 bits of each; so once the k-th
    distance is at most ``segments * (r + 1) - 1`` a query is done and takes no part in further rounds.

    Buckets of more than ``chunk`` codes are split, and queries go to all their parts. A task holds one part at a time and
    streams queries past it. No codes meet queries but in a bucket both belong to, and nothing is collected.

    Rows with equal codes are one class, of which only the ``k + 1`` smallest ids can matter; map tasks keep no more,
    so a code that a third of all rows share makes no large group. Repeated rows count once; a row is never its own
    neighbour; fewer than ``k`` other rows give fewer results; empty tables give none.
    """
    spark, near = codes.sparkSession, k + 1
    distinct = codes.select("id", "code").distinct()
    ranked = distinct.withColumn("nth", F.row_number().over(Window.partitionBy("code").orderBy("id")))
    members, members_path = materialised(ranked.where(F.col("nth") <= near), "members")
    own = members.where("nth = 1").select("code", F.col("id").alias("tie"))
    total, words = own.agg(F.count("*"), F.max(F.size("code"))).first()
    words, need = words or 1, min(near, total)
    width = width or segment_width(total)
    head = min(width, max(0, math.ceil(math.log2(max(1, total) / bucket)), 3))
    segments, tail = words * WORD // width, width - head
    asked = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")).distinct()

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = _segments(_stacked(frame["code"], words), width)
            s, row = np.divmod(np.arange(values.size), len(frame)) if len(frame) else (np.zeros(0, np.int64),) * 2
            start = (values[row, s] >> np.uint64(tail)).astype(np.int64)
            mine = frame.iloc[row]
            yield pd.DataFrame({"segment": s.astype(np.int32), "start": start, "code": mine["code"].to_numpy(), "tie": mine["tie"].to_numpy(np.int64)})

    index, index_path = materialised(own.mapInPandas(placed, "segment int, start long, code array<long>, tie long"), "index")
    # at most total * segments / chunk rows
    parts = index.groupBy("segment", "start").count().where(F.col("count") > chunk).select("segment", "start", F.ceil(F.col("count") / chunk).cast("int").alias("parts"))
    parts, parts_path = materialised(parts, "parts")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-total * segments // (4 * bucket)))
    none = F.array().cast("array<long>")
    split = index.join(parts, ["segment", "start"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("code"), "parts"), F.lit(0)).cast("int"))
    left = split.select("segment", "start", "part", F.lit(-1).alias("rest_radius"), "code", "tie")

    def sent(radius: int):
        marks = [(j, _masks(head, j)) for j in range(min(radius, head) + 1) if radius - j <= tail]

        def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                starts = (_segments(_stacked(frame["code"], words), width) >> np.uint64(tail))
                for s in range(segments):
                    for j, masks in marks:
                        to = (starts[:, s, None] ^ masks).astype(np.int64)
                        row = np.repeat(np.arange(len(frame)), len(masks))
                        yield pd.DataFrame({"segment": np.full(len(row), s, np.int32), "start": to.ravel(), "rest_radius": np.full(len(row), radius - j, np.int32), "code": frame["code"].to_numpy()[row]})

        return send

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by bucket, the codes of each before the queries that it gets."""
        key, held, found = None, [], None
        low = np.uint64((1 << tail) - 1)
        for frame in frames:
            keys = frame[["segment", "start", "part"]].to_numpy()
            edges = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else []
            for a, b in zip(edges, [*edges[1:], len(keys)], strict=True):
                if tuple(keys[a]) != key:
                    key, held, found = tuple(keys[a]), [], None
                group = frame.iloc[a:b]
                held += [group[group["rest_radius"] < 0]] if (group["rest_radius"].iloc[0] < 0) else []
                wanted = group[group["rest_radius"] >= 0]
                if wanted.empty or not held:
                    continue
                if found is None:
                    rows = pd.concat(held)
                    mine = _stacked(rows["code"], words)
                    found, held = Bucket(mine, rows["tie"].to_numpy(np.int64), _segments(mine, width)[:, key[0]] & low, tail), held[:1]
                for radius, some in wanted.groupby("rest_radius"):
                    theirs = _stacked(some["code"], words)
                    q, c, d = found.nearest(theirs, _segments(theirs, width)[:, key[0]] & low, int(radius), near)
                    if not len(q):
                        continue
                    yield pd.DataFrame({"query": some["code"].to_numpy()[q], "code": pd.Series(list(found.codes[c].view(np.int64)), dtype=object), "tie": found.tie[c], "distance": d.astype(np.int32)})

    schema = "query array<long>, code array<long>, tie long, distance int"
    open_ = asked.select(F.col("query").alias("code")).distinct()
    best, made = None, [members_path, index_path, parts_path]
    for radius in range(width + 1):
        sent_to = open_.mapInPandas(sent(radius), "segment int, start long, rest_radius int, code array<long>")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))
        right = sent_to.join(parts, ["segment", "start"], "left").select("segment", "start", every.alias("part"), "rest_radius", "code", F.lit(0).cast("long").alias("tie"))
        dealt = left.unionByName(right).repartition(tasks, "segment", "start", "part").sortWithinPartitions("segment", "start", "part", "rest_radius")
        fresh = dealt.mapInPandas(search, schema)
        if best is not None:
            fresh = fresh.unionByName(best.select("query", "code", "tie", "distance"))
        nth = F.row_number().over(Window.partitionBy("query").orderBy("distance", "tie"))
        first = fresh.distinct().withColumn("nth", nth).where(F.col("nth") <= near)
        # whether the query's search is over, on each of its rows
        kth = F.max(F.when(F.col("nth") == need, F.col("distance"))).over(Window.partitionBy("query"))
        first = first.withColumn("over", F.coalesce(kth <= segments * (radius + 1) - 1, F.lit(False)) | F.lit(radius == width))
        best, path = materialised(first.select("query", "code", "tie", "distance", "over"), "best")
        made.append(path)
        open_ = asked.select(F.col("query").alias("code")).distinct().join(best.where("over").select(F.col("query").alias("code")).distinct(), "code", "left_anti")
        if open_.isEmpty():
            break
    found = asked.join(best.select("query", "code", "distance"), "query").join(members.select("id", "code"), "code").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("distance", "id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    out, _ = materialised(found.select("query_id", "rank", "id", "distance"), "nearest")
    for path in made:
        discard(spark, path)
    return out
