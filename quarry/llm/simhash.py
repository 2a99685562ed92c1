"""SimHash near-duplicates: 64-bit fingerprints, linked within a few bits by anchor-point covering."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import connected_components, materialised, scratch

SEED = 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles whose bits are counted at once: bounds the memory that one very long text takes.
_BLOCK = 1 << 16
#: Fingerprints at home with one anchor that a task holds at most.
_HOMES = 1 << 18


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of a whole text; 0 if it has no word.

    Words are what ASCII white space leaves of the text after A-Z are lower-cased. Each shingle of ``width``
    words, joined by single spaces, repeats included, votes with its XXH64; a shorter text is one shingle.
    A bit is 1 if more than half of the shingles have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    return majority(
        (np.array([digest(whole[a:b], seed) for a, b in zip(starts[k : k + _BLOCK], stops[k : k + _BLOCK], strict=True)], "<u8") for k in range(0, len(starts), _BLOCK)),
        len(starts),
    )


def majority(blocks: Iterable[np.ndarray], n: int) -> int:
    """The bits that over half of ``n`` 64-bit hashes have, which come in blocks."""
    votes = np.zeros(64, np.int64)
    for block in blocks:
        votes += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col long, fp long)``, one row per row of ``docs``; ``fp`` is the fingerprint's bits as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(of, "doc_id long, fp long").withColumnRenamed("doc_id", id_col)


class CoveringCode:
    """A product of small perfect codes over the 64 bits of a fingerprint; its words are the anchors.

    Every block of ``n`` bits lies within the block code's radius of exactly one code word, so every fingerprint
    has one home anchor within the covering radius (the sum of the blocks' radii; the last ``64 mod n`` bits are
    held at zero in every anchor). A fingerprint that differs in at most two bits has that anchor within radius
    plus two. Of the anchors at that distance, only those that can be home to a point two flips away are used:
    one block moved by one or two flips, or two blocks moved by one flip each.
    """

    def __init__(self, n: int):
        words = {3: [0, 7], 5: [0, 31], 7: [w for w in range(128) if _syndrome7(w) == 0]}[n]
        near = np.array([min(range(len(words)), key=lambda k: (v ^ words[k]).bit_count()) for v in range(1 << n)])
        self.n, self.blocks, self.width = n, 64 // n, max(1, (len(words) - 1).bit_length())
        once = [sorted({near[v ^ 1 << i] for i in range(n)} - {near[v]}) for v in range(1 << n)]
        pairs = list(itertools.combinations(range(n), 2))
        twice = [sorted({near[v ^ 1 << i ^ 1 << j] for i, j in pairs} - {near[v], *once[v]}) for v in range(1 << n)]
        self.near = near
        self.once, self.twice = self._table(once), self._table(twice)
        self.anchors = len(words) ** self.blocks

    def _table(self, moves: list[list[int]]) -> np.ndarray:
        """Row v: what to xor to the home word's number for each move; 0 fills the rest."""
        out = np.zeros((len(moves), max(map(len, moves))), np.int64)
        for v, to in enumerate(moves):
            out[v, : len(to)] = [t ^ self.near[v] for t in to]
        return out

    def _values(self, fps: np.ndarray) -> np.ndarray:
        shifts = np.arange(self.blocks, dtype=np.uint64) * np.uint64(self.n)
        return ((fps[:, None] >> shifts) & np.uint64((1 << self.n) - 1)).astype(np.int64)

    def home(self, fps: np.ndarray) -> np.ndarray:
        return (self.near[self._values(fps)] << (np.arange(self.blocks) * self.width)).sum(axis=1)

    def replicas(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor) for every anchor of each fingerprint but its home."""
        v, home, at = self._values(fps), self.home(fps), np.arange(self.blocks) * self.width
        one = (self.once[v] << at[None, :, None]).reshape(len(fps), -1)
        two = (self.twice[v] << at[None, :, None]).reshape(len(fps), -1)
        k = self.once.shape[1]
        a, b = np.triu_indices(self.blocks * k, 1)
        apart = a // k != b // k
        a, b = a[apart], b[apart]
        both = np.where((one[:, a] != 0) & (one[:, b] != 0), one[:, a] ^ one[:, b], 0)
        moves = np.concatenate([one, two, both], axis=1)
        row, col = np.nonzero(moves)
        return row, home[row] ^ moves[row, col]


def _syndrome7(w: int) -> int:
    out = 0
    for i in range(7):
        if w >> i & 1:
            out ^= i + 1
    return out


def choose_code(distinct: int) -> int:
    """Block length of the covering code: the coarsest with at most 64 fingerprints to an anchor on average."""
    return next((n for n in (5, 3) if distinct <= 64 * 2 ** (64 // n)), 7)


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    root = parent[at]
    while True:
        up = parent[root]
        if np.array_equal(up, root):
            return root
        root = up


def _forest(homes: np.ndarray, rows: np.ndarray, parent: np.ndarray) -> None:
    """Join the sets of ``homes[i]`` and ``rows[i]`` in ``parent``, whose roots are the sets' least members."""
    while len(homes):
        a, b = _roots(parent, homes), _roots(parent, rows)
        parent[homes], parent[rows] = a, b
        apart = a != b
        homes, rows = homes[apart], rows[apart]
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])


def _links(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, bits: int, seen: int = 0, most: int = 1 << 20) -> tuple:
    """Edges that span, in every anchor's group, what is within ``bits`` of a fingerprint at home there.

    Rows are sorted by anchor. At most one edge per row comes out, however dense a group is. The first ``seen`` rows, all
    of the first group, have met each other before.
    """
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    size = np.diff(np.append(first, len(anchor)))
    group = np.repeat(np.arange(len(first)), size)
    first[0] += seen
    size[0] -= seen
    at = np.flatnonzero(home)
    work = np.cumsum(size[group[at]])
    parent = np.arange(len(anchor))
    touched = np.zeros(len(anchor), bool)
    start = 0
    while start < len(at):
        stop = max(start + 1, int(np.searchsorted(work, (work[start - 1] if start else 0) + most, "right")))
        mine = at[start:stop]
        n = size[group[mine]]
        left = np.repeat(mine, n)
        right = np.repeat(first[group[mine]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        close = (np.bitwise_count(fp[left] ^ fp[right]) <= bits) & (left != right)
        left, right = left[close], right[close]
        if len(left):
            touched[left] = touched[right] = True
            _forest(left, right, parent)
        start = stop
    out = np.flatnonzero(touched)
    a, b = fp[out], fp[_roots(parent, out)]
    return a[a != b], b[a != b]


def near_pairs(fps: DataFrame, bits: int = 2, hot: int = 4096, code: int | None = None) -> DataFrame:
    """Edges ``(a long, b long)`` that connect all distinct fingerprints within ``bits`` (2 or fewer) of each other.

    ``fps(fp long)`` holds distinct values. Each is dealt to its home anchor and to the anchors around it; a
    group of one anchor compares those at home with all that came. An anchor that is home to more than ``hot``
    fingerprints (or to a ten-thousandth of all, if that is more, up to ``_HOMES``) is cut into chunks of its homes, each
    of which meets all of the anchor's replicas; a task holds the homes of one chunk and streams the replicas past
    them. So at most 10,000 anchors are hot, or one in ``_HOMES`` fingerprints where there are over 2.6 billion, and their
    names and chunks (16 bytes each) go to the tasks. Not every pair is returned, but as many as span each group.
    """
    if bits > 2:
        raise ValueError("the anchors around a fingerprint cover two differing bits")
    spark = fps.sparkSession
    total = fps.count()
    n = code or choose_code(total)
    hot = max(hot, min(_HOMES, -(-total // 10_000)))

    def homes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = CoveringCode(n)
        for frame in frames:
            yield pd.DataFrame({"anchor": own.home(frame["fp"].to_numpy().view(np.uint64))})

    crowded = fps.mapInPandas(homes, "anchor long").groupBy("anchor").count().where(F.col("count") > hot)
    chunks = {r[0]: -(-r[1] // hot) for r in crowded.collect()}

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = CoveringCode(n)
        crowds = np.array(sorted(chunks), np.int64)
        parts = np.array([chunks[k] for k in sorted(chunks)], np.int64)
        for frame in frames:
            for start in range(0, len(frame), 4096):
                signed = frame["fp"].to_numpy()[start : start + 4096]
                fp = signed.view(np.uint64)
                row, anchor = own.replicas(fp)
                at_home = np.concatenate([np.ones(len(fp), bool), np.zeros(len(row), bool)])
                row, anchor = np.concatenate([np.arange(len(fp)), row]), np.concatenate([own.home(fp), anchor])
                chunk = np.zeros(len(row), np.int64)
                if len(crowds):
                    k = np.minimum(np.searchsorted(crowds, anchor), len(crowds) - 1)
                    times = np.where(crowds[k] == anchor, parts[k], 1)
                    at = np.repeat(np.arange(len(row)), times)
                    chunk = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                    mixed = (fp[row[at]] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                    at_home = at_home[at] & (mixed % times[at].astype(np.uint64) == chunk)
                    row, anchor = row[at], anchor[at]
                yield pd.DataFrame({"anchor": anchor, "chunk": chunk.astype(np.int32), "fp": signed[row], "home": at_home})

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool))
        last, seen = None, 0
        for frame in frames:
            if frame.empty:
                continue
            chunk = frame["chunk"].to_numpy()
            anchor = frame["anchor"].to_numpy()
            key = np.cumsum(np.concatenate(([False], (anchor[1:] != anchor[:-1]) | (chunk[1:] != chunk[:-1]))))
            same = last == (anchor[0], chunk[0])
            key += (held[0][-1] if len(held[0]) else 0) + (0 if same else 1)
            last = (anchor[-1], chunk[-1])
            held = tuple(
                np.concatenate([x, y])
                for x, y in zip(held, (key, frame["fp"].to_numpy().view(np.uint64), frame["home"].to_numpy()), strict=True)
            )
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                a, b = _links(*(x[:cut] for x in held), bits, seen)
                held, seen = tuple(x[cut:] for x in held), 0
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
            if len(held[0]) > 1 << 20:  # one group alone: its homes stay, what streamed past them is done with
                a, b = _links(*held, bits, seen)
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
                held = tuple(x[held[2]] for x in held)
                seen = len(held[0])
        if len(held[0]):
            a, b = _links(*held, bits, seen)
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    # some 40 replicas a fingerprint, and 4 million rows to a task
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 100_000)
    dealt = fps.mapInPandas(deal, "anchor long, chunk int, fp long, home boolean")
    grouped = dealt.repartition(parts, "anchor", "chunk").sortWithinPartitions("anchor", "chunk", F.desc("home"))
    return grouped.mapInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``fp long`` and ``component_id long``.

    Rows whose fingerprints differ in at most ``bits`` bits are linked; ``component_id`` is the smallest id that
    links lead to, the row's own included. Null texts and texts without words have fingerprint zero and are
    linked like any other; repeated ids give repeated rows; a null id is never the smallest unless all ids of
    its component are null, when ``component_id`` is null. An empty table gives none. Other columns are ignored.
    """
    with scratch(docs.sparkSession) as made:
        out, path = materialised(_named(docs, id_col, text_col, bits), "near-duplicates")
        made.remove(path)
    return out


def _named(docs: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    marked, _ = materialised(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min(id_col).alias("least"))
    classes, _ = materialised(classes, "classes")
    edges, _ = materialised(near_pairs(classes.select("fp"), bits), "links")
    nodes = connected_components(edges)
    joined = classes.join(nodes, classes["fp"] == nodes["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "component").select("fp", "component_id")
    return marked.join(named, "fp").select(id_col, "fp", "component_id")
