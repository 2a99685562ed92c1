"""Benchmark decontamination: short test items found inside long documents by size-partitioned MinHash sketches."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import discard, free, materialised

WIDTH, LEAST = 5, 0.8
_WORD = re.compile(r"[^\W_]+")
_P = np.uint64(0x9E3779B97F4A7C15)
_SALT = 0x1B873593CC9E2D51
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def words(text: str) -> list[str]:
    """Runs of letters and digits, lower-cased."""
    return _WORD.findall(text.lower())


def shingles(own: list[str], width: int = WIDTH) -> set[str]:
    """Distinct runs of ``width`` words; a shorter text is one shingle, no words are none."""
    if not own:
        return set()
    return {" ".join(own[i : i + width]) for i in range(max(1, len(own) - width + 1))}


def _inverse(p: int) -> int:
    return pow(p, -1, 1 << 64)


class WordHasher:
    """64-bit hashes of all words of many texts at once, from their code points."""

    def __init__(self) -> None:
        every = np.arange(0x110000, dtype="<u4")
        every[0xD800:0xE000] = 0
        self.inside = np.fromiter(map(str.isalnum, every.tobytes().decode("utf-32-le")), bool, 0x110000)
        self.power = self.back = np.ones(1, np.uint64)

    def hashes(self, lowered: list[str], piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the texts' words, one text after another, each text's number of words, and where in it each starts and stops.

        Texts longer than ``piece`` characters are cut between words, so that memory beyond a few bytes a character is
        bounded, however long one text is.
        """
        h, of, start, stop = ([np.zeros(0, kind)] for kind in (np.uint64, np.int64, np.int64, np.int64))
        for texts, owners, offsets in _pieces(lowered, piece):
            own, counts, a, b = self._flat(texts)
            shift = np.repeat(offsets, counts)
            h.append(own)
            of.append(np.repeat(owners, counts))
            start.append(a + shift)
            stop.append(b + shift)
        counts = np.bincount(np.concatenate(of), minlength=len(lowered))
        return np.concatenate(h), counts, np.concatenate(start), np.concatenate(stop)

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        gap = np.full(1, 32, "<u4")
        flat = np.concatenate([x for t in raw for x in (t, gap)] or [gap])
        n = len(flat)
        if len(self.power) <= n:
            size = 2 * n + 2
            self.power = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, _P))])
            self.back = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, np.uint64(_inverse(int(_P)))))])
        inside = self.inside[flat]
        edge = np.diff(inside.view(np.int8), prepend=0)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * self.power[:n])])
        out = (sums[stop] - sums[start]) * self.back[start]
        ends = np.cumsum(sizes + 1)
        counts = np.diff(np.searchsorted(start, ends), prepend=0)
        base = np.repeat(ends - sizes - 1, counts)
        return out ^ (out >> np.uint64(29)), counts, start - base, stop - base


def _pieces(texts: list[str], most: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Runs of about ``most`` characters: texts or parts of them that begin and end between words, whose they are, and where they begin."""
    parts, owners, offsets, size = [], [], [], 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(len(text), at + most)
            while end < len(text) and text[end - 1].isalnum():
                end += 1
            parts.append(text[at:end] if at or end < len(text) else text)
            owners.append(k)
            offsets.append(at)
            size += end - at
            at = end
            if size >= most:
                yield parts, np.array(owners), np.array(offsets)
                parts, owners, offsets, size = [], [], [], 0
    if parts:
        yield parts, np.array(owners), np.array(offsets)


def shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, in order (runs across texts included)."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += (word_hashes[k : k + n] ^ (word_hashes[k : k + n] >> np.uint64(32))) * _MIX[k % 5]
    out = (out ^ (out >> np.uint64(30))) * _MIX[0]
    return out ^ (out >> np.uint64(27))


def sketch_size(n: int, least: float = LEAST) -> int:
    """How many of an item's n shingles its sketch holds.

    An item is in the class of sizes from a power of two up to the next. A document that has at least ``least`` of the
    item's shingles misses at most n - ceil(least n) of them, so of any so many and one more at least one is in it. A
    sketch of floor((1 - least) u) + 1, u the largest size of the class, therefore meets every such document.
    """
    upper = 2 ** n.bit_length() - 1
    return min(n, math.floor((1 - least) * upper + 1e-9) + 1)


def item_table(items: DataFrame, text_col: str, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """``(item binary, size int, n int, need int, h long, shingle string, sketched boolean)``: all shingles of distinct item texts.

    ``item`` is the text's digest, ``size`` the words of its shingles, ``need`` how many of the ``n`` a document must have.
    A sketch takes the smallest hashes ``h``, those first that few items share, so that a phrase in many items brings no
    candidates where an item has others: any fixed order serves ``sketch_size``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = words(text)
                if not own:
                    continue
                size = min(width, len(own))
                hashes = shingle_hashes(hasher.hashes([text.lower()])[0], size).view(np.int64)
                each = dict(zip((" ".join(own[i : i + size]) for i in range(len(hashes))), hashes.tolist(), strict=True))
                n = len(each)
                whole = [[digest] * n, [size] * n, [n] * n, [math.ceil(least * n - 1e-9)] * n, [sketch_size(n, least)] * n, list(each.values()), list(each)]
                kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(whole, kinds, strict=True)], names=["item", "size", "n", "need", "sketch", "h", "shingle"])

    texts = items.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    texts = texts.select(digest("text").alias("item"), "text").dropDuplicates(["item"])
    every = texts.mapInArrow(cut, "item binary, size int, n int, need int, sketch int, h long, shingle string")
    shared = every.groupBy("size", "shingle").agg(F.floor(F.log2(F.count("*"))).alias("shared"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("shared", "h", "shingle"))
    ranked = every.join(shared, ["size", "shingle"]).withColumn("rank", rank)
    return ranked.select("item", "size", "n", "need", "h", "shingle", (F.col("rank") <= F.col("sketch")).alias("sketched"))


def digest(text: str) -> F.Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


class Filter:
    """A bit per hash, at three places, of the items' shingles: what it lacks is in no item."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(64 * len(bits) - 1)

    def test(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Positions of the hashes of shingles of ``size`` words that may be an item's."""
        at = np.arange(len(hashes))
        for k in range(3):
            at = at[self._bit(self.place(hashes[at] if k else hashes, size, k, self.mask))]
        return at

    @staticmethod
    def place(hashes: np.ndarray, size: int, k: int, mask: np.uint64) -> np.ndarray:
        x = hashes ^ np.uint64(size * _SALT % (1 << 64))
        return ((x + ((x >> np.uint64(32)) | np.uint64(1)) * np.uint64(k)) if k else x) & mask

    def _bit(self, place: np.ndarray) -> np.ndarray:
        return (self.bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0

    @classmethod
    def of(cls, table: DataFrame, most_bits: int = 1 << 28) -> Filter:
        """Of the shingles in ``table(size, h)``: 64 bits for each, and ``most_bits`` (32 MB) at most, which only makes it pass more."""
        each = table.select("size", "h").distinct()
        bits = min(most_bits, max(1 << 20, 1 << math.ceil(math.log2(64 * max(1, each.count())))))

        def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mask = np.uint64(bits - 1)
            for frame in frames:
                for size, some in frame.groupby("size"):
                    h = some["h"].to_numpy(np.int64).view(np.uint64)
                    at = np.unique(np.concatenate([cls.place(h, int(size), k, mask) for k in range(3)]))
                    yield pd.DataFrame({"at": (at >> np.uint64(6)).astype(np.int64), "bits": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

        found = each.mapInPandas(places, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
        out = np.zeros(bits >> 6, np.uint64)
        out[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
        return cls(out)


def _parts(texts: list[str], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) < chars):
            size += len(texts[stop])
            stop += 1
        yield start, stop
        start = stop


def _matches(docs: DataFrame, table: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """``(doc binary, item, n, need, found)`` of distinct texts, ``(id, doc)`` of all rows that may have one, and folders to discard.

    One pass over the documents: of each whole text, those shingles that the filter passes. They are joined with the
    sketches on the words themselves, which gives candidates, and these with all shingles of their items, to count.
    """
    spark = docs.sparkSession
    passing = spark.sparkContext.broadcast(Filter.of(table))
    sizes = sorted(r["size"] for r in table.select("size").distinct().collect())  # 1 to width

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, own = WordHasher(), passing.value
        kind = pa.list_(pa.struct([("size", pa.int32()), ("shingle", pa.string())]))
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for start, stop in _parts(texts):
                lowered = [t.lower() for t in texts[start:stop]]
                flat, counts, first, last = hasher.hashes(lowered)
                stops = np.cumsum(counts)
                met: dict[int, set[tuple[int, str]]] = {}
                for size in sizes:
                    at = own.test(shingle_hashes(flat, size), size)
                    text_of = np.searchsorted(stops, at, "right")
                    inside = at + size <= stops[text_of]
                    for k, w in zip(text_of[inside].tolist(), at[inside].tolist(), strict=True):
                        text = lowered[k]
                        met.setdefault(k, set()).add((size, " ".join([text[first[i] : last[i]] for i in range(w, w + size)])))
                digests = [hashlib.md5(texts[start + k].encode()).digest() for k in met]
                shingled = pa.array([[{"size": n, "shingle": x} for n, x in sorted(v)] for v in met.values()], kind)
                yield pa.RecordBatch.from_arrays([pa.array([ids[start + k] for k in met], pa.int64()), pa.array(digests, pa.binary()), shingled], names=["id", "doc", "met"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scanned, path = materialised(narrow.mapInArrow(scan, "id long, doc binary, met array<struct<size int, shingle string>>"), "scanned")
    hits = scanned.select("doc", F.explode("met").alias("m")).select("doc", "m.*").distinct()
    candidates = hits.join(table.where("sketched").select("item", "size", "shingle"), ["size", "shingle"]).select("doc", "item").distinct()
    whole = candidates.join(table.select("item", "size", "n", "need", "shingle"), "item").join(hits, ["doc", "size", "shingle"])
    found = whole.groupBy("doc", "item", "n", "need").agg(F.count("*").cast("int").alias("found")).where("found >= need")
    found, found_path = materialised(found.select("doc", "item", "n", "found"), "contained")
    return found, scanned.select("id", "doc"), [path, found_path]


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = WIDTH, least: float = LEAST
) -> DataFrame:
    """``(id_col, item_col, shingles int, found int, containment double)``: test items inside documents.

    An item is in a document if at least ``least`` of its distinct ``width``-word shingles are, anywhere in it, compared
    as words. Items and documents are tables of any size; what goes to every task is a bit filter of at most 32 MB.
    Equal texts are searched once.

    Null texts and texts without words are in nothing and contain nothing; an item of fewer words than ``width``
    is one shingle of all its words; repeated rows give repeated results; null ids stay null; other columns are ignored.
    """
    table, path = materialised(item_table(items, text_col, width, least), "items")
    found, owners, paths = _matches(docs, table, id_col, text_col)
    members = items.select(F.col(item_col).cast("long").alias("item_id"), digest(text_col).alias("item"))
    rows = found.join(members, "item").join(owners, "doc")
    share = (F.col("found") / F.col("n")).alias("containment")
    out, _ = materialised(rows.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), F.col("n").alias("shingles"), "found", share), "contamination")
    for p in (path, *paths):
        discard(docs.sparkSession, p)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that contain no test item, with all their columns; what an item is in as ``find_contamination`` says.

    Texts that do are taken out by their digests in an anti join, which Spark broadcasts where they are few.
    """
    table, path = materialised(item_table(items, text_col, width, least), "items")
    found, _, paths = _matches(docs.select(F.lit(None).cast("long").alias("doc_id"), text_col), table, "doc_id", text_col)
    name = free("bad", docs)
    bad, _ = materialised(found.select(F.col("doc").alias(name)).distinct(), "contaminated")
    for p in (path, *paths):
        discard(docs.sparkSession, p)
    return docs.join(bad, digest(text_col) == F.col(name), "left_anti")
