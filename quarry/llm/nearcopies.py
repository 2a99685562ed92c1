"""Near copies by exact Jaccard similarity of word shingles: SimHash's anchors, and banded MinHash where they don't reach.

Fingerprints of 5-word shingles are compared by ``simhash.near_pairs``. Two texts of similarity 0.8 differ in up to 11 of 64
bits, and no covering code deals fingerprints to all anchors that far away, so signatures of MinHash bring further
candidates. Every link is verified on the sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import connected_components, free, give_back, lean, materialised
from quarry.llm.simhash import majority, near_pairs

SEED, WIDTH, SIMILARITY = 42, 5, 0.8
#: Texts of similarity 0.8 share no band with probability (1 - 0.8**ROWS)**BANDS, 3 in 100,000; more alike, less.
BANDS, ROWS = 20, 4
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_rng = np.random.default_rng(SEED)
_TURN = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 of a whole text's runs of ``width`` words (of all words, if fewer); words as ``simhash.fingerprint``'s."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    return np.unique(np.array([digest(whole[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64))


def class_of(own: np.ndarray) -> int:
    """A signed 64-bit name for a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def signatures(own: np.ndarray, block: int = 2048) -> np.ndarray:
    """One signed long per band, from the band's least values of the shingles under seeded multiplications."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), block):
        np.minimum(least, (own[k : k + block, None] * _TURN).min(axis=0), out=least)
    mixed = ((least.reshape(BANDS, ROWS) >> np.uint64(7)) * _MIX).sum(axis=1, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def fingerprint(own: np.ndarray, block: int = 1 << 16) -> int:
    """The SimHash of a set of shingles as a signed long."""
    return int(np.uint64(majority((own[k : k + block] for k in range(0, len(own), block)), len(own))).view(np.int64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _marks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, class, n, fp, sigs)`` of every row: its set of shingles by name, the set's size, fingerprint and signatures."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32())]
            columns += [pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([signatures(s).tolist() for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "class", "n", "fp", "sigs"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(lean(of), "id long, class long, n int, fp long, sigs array<long>")


def _with_class(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` with each row's class as another column."""
    at = docs.columns.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([class_of(shingles(t.as_py())) for t in batch.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, name])

    return docs.mapInArrow(lean(mark), f"{fields}, {name} long")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(class, own binary)`` for ``wanted(class, id)``: the shingles of one text of each class."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(0)]
            columns = [pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["class", "own"])

    ids = wanted.select("id").distinct()
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = narrow.join(ids, narrow["id"].eqNullSafe(ids["id"]), "left_semi").select("text")
    found = texts.mapInArrow(lean(of), "class long, own binary")
    return found.join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float, most: int = 256) -> DataFrame:
    """The pairs ``(a, b)`` whose sets reach ``similarity``. One set of ``a`` serves about ``most`` of its partners."""

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, mine = None, np.zeros(0, np.uint64)
        for frame in frames:
            a_out, b_out = [], []
            for a, chunk, b, own in zip(frame["a"], frame["chunk"], frame["b"], frame["own"], strict=True):
                theirs = np.frombuffer(own, np.uint64)
                if pd.isna(b):
                    head, mine = (a, chunk), theirs
                elif head == (a, chunk) and jaccard(mine, theirs) >= similarity - 1e-12:
                    a_out.append(a)
                    b_out.append(int(b))
            yield pd.DataFrame({"a": np.array(a_out, np.int64), "b": np.array(b_out, np.int64)})
        give_back()

    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / most).alias("chunks"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "chunks").cast("int").alias("chunk"))
    heads = dealt.select("a", "chunk").distinct().join(sets.withColumnRenamed("class", "a"), "a").select("a", "chunk", F.lit(None).cast("string").alias("b"), "own")
    rest = dealt.join(sets.withColumnRenamed("class", "b"), "b").select("a", "chunk", F.col("b").cast("string").alias("b"), "own")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = heads.unionByName(rest).repartition(parts, "a", "chunk").sortWithinPartitions("a", "chunk", F.asc_nulls_first("b"))
    return grouped.mapInPandas(compare, "a long, b long")


def _joined_in(one: list[np.ndarray], other: list[np.ndarray], similarity: float, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with ``one[i]`` and ``other[j]`` at ``similarity`` or more, by common shingles counted as matrix products."""
    sizes = [np.fromiter(map(len, s), np.int64, len(s)) for s in (one, other)]
    flat = [np.concatenate(s) if s else np.zeros(0, np.uint64) for s in (one, other)]
    shared = np.intersect1d(*flat)
    both = np.zeros((len(one), len(other)), np.float32)
    owner, code = [], []
    for values, size in zip(flat, sizes, strict=True):
        at = np.searchsorted(shared, values)
        known = (at < len(shared)) & (shared[np.minimum(at, max(0, len(shared) - 1))] == values) if len(shared) else np.zeros(len(values), bool)
        order = np.argsort(at[known], kind="stable")
        owner.append(np.repeat(np.arange(len(size)), size)[known][order])
        code.append(at[known][order])
    for k in range(0, len(shared), block):
        parts = []
        for o, c, s in zip(owner, code, (one, other), strict=True):
            a, b = np.searchsorted(c, [k, k + block])
            dense = np.zeros((len(s), block), np.float32)
            dense[o[a:b], c[a:b] - k] = 1
            parts.append(dense)
        both += parts[0] @ parts[1].T
    together = sizes[0][:, None] + sizes[1][None, :] - both
    return np.nonzero(both >= similarity * together - 1e-6)


def _across(members: DataFrame, sets: DataFrame, similarity: float, most: int, most_shingles: int) -> DataFrame:
    """Edges ``(a, b)`` that join different components among all texts with a signature in common.

    ``members(sig, class, n, component)``. A signature's texts are dealt into chunks of about ``most`` texts and
    ``most_shingles`` shingles; every two chunks meet in one group, which returns a spanning forest of what it found.
    """

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("class")
        left, right = frame[frame["side"] <= 0], frame[frame["side"] != 0]
        right = left if right.empty else right
        sets = [[np.frombuffer(s, np.uint64) for s in f["own"]] for f in (left, right)]
        i, j = _joined_in(*sets, similarity)
        del sets
        if len(frame) > 500:  # the many small groups leave little behind
            give_back()
        a, b = left["class"].to_numpy()[i], right["class"].to_numpy()[j]
        ca, cb = left["component"].to_numpy()[i], right["component"].to_numpy()[j]
        a, b, ca, cb = (x[ca != cb] for x in (a, b, ca, cb))
        names, at = np.unique(np.concatenate([ca, cb]), return_inverse=True)
        parent, out = list(range(len(names))), []
        for k, (x, y) in enumerate(zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True)):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y:
                parent[x] = y
                out.append(k)
        return pd.DataFrame({"a": a[out], "b": b[out]})

    open_ = members.groupBy("sig").agg(F.count("*").alias("m"), F.sum("n").alias("s"), F.min("component").alias("low"), F.max("component").alias("high"))
    open_ = open_.where("low <> high").select("sig", F.greatest(F.ceil(F.col("m") / most), F.ceil(F.col("s") / most_shingles)).cast("int").alias("p"))
    own = members.join(open_, "sig").withColumn("mine", F.pmod(F.xxhash64("class"), "p").cast("int"))
    cells = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    # side 0: a chunk with itself; else -1 for the lesser chunk of the two and 1 for the greater
    cells = cells.select("sig", "class", "component", F.least("mine", "other").alias("c"), F.greatest("mine", "other").alias("d"), F.signum(F.col("mine") - F.col("other")).cast("int").alias("side"))
    return cells.join(sets, "class").groupBy("sig", "c", "d").applyInPandas(compare, "a long, b long").distinct()


def components(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY, most: int = 1024, most_shingles: int = 1 << 20) -> DataFrame:
    """``(node, component)`` of all classes that are linked to another one.

    First the texts whose fingerprints anchors bring together are compared, and every text with the least one of its
    fingerprint and of each of its signatures, which joins groups of true copies at the cost of a row each; then whatever
    still has a signature in common but no component is compared, all with all.
    """
    classes = marks.groupBy("class").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sigs").alias("sigs"))
    classes, _ = materialised(classes, "classes")
    by_fp, _ = materialised(classes.groupBy("fp").agg(F.count("*").alias("m"), F.min(F.struct("class", "n")).alias("lead")), "fingerprints")
    alike = classes.join(by_fp.where("m > 1"), "fp").where("class <> lead.class").select(F.struct("class", "n").alias("x"), F.col("lead").alias("y"))
    a, b = by_fp.select(F.col("fp").alias("a"), F.col("lead").alias("x")), by_fp.select(F.col("fp").alias("b"), F.col("lead").alias("y"))
    alike = alike.unionByName(near_pairs(by_fp.select("fp")).join(a, "a").join(b, "b").select("x", "y"))
    alike = alike.where(F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - 1e-9)
    alike, _ = materialised(alike.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct(), "alike")
    dealt = classes.select(F.explode("sigs").alias("sig"), "class", "n").distinct()
    leads = dealt.groupBy("sig").agg(F.count("*").alias("m"), F.min(F.struct("class", "n")).alias("lead")).where("m > 1").select("sig", "lead")
    shared, _ = materialised(dealt.join(leads, "sig"), "shared")
    wanted = shared.select("class").union(alike.select("a")).union(alike.select("b")).distinct().join(classes.select("class", "id"), "class")
    sets, _ = materialised(_sets(docs, wanted, id_col, text_col), "sets")
    pairs = shared.where("class <> lead.class").where(F.least("n", "lead.n") >= similarity * F.greatest("n", "lead.n") - 1e-9)
    pairs = pairs.select(F.col("lead.class").alias("a"), F.col("class").alias("b")).unionByName(alike).distinct()
    found, _ = materialised(_verified(pairs, sets, similarity), "links")
    nodes, _ = materialised(connected_components(found), "nodes")
    members = shared.join(nodes, shared["class"] == nodes["node"], "left").select("sig", "class", "n", F.coalesce("component", "class").alias("component"))
    more, _ = materialised(_across(members, sets, similarity, most, most_shingles), "links")
    return connected_components(found.unionByName(more))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, **bounds) -> DataFrame:
    """One row, with all its columns, of each group of near copies in ``docs``.

    Texts are linked where the Jaccard similarity of their sets of 5-word shingles is ``similarity`` or more, and a group
    is what links join. It keeps a row with its smallest id (null ids come last), whatever other groups have that id too;
    of repeats of it any one. Null texts and texts without words are copies of each other.
    """
    marks, _ = materialised(_marks(docs, id_col, text_col), "marks")
    linked = components(docs, marks, id_col, text_col, similarity, **bounds)
    named = marks.join(linked, marks["class"] == linked["node"], "left").select("id", "class", F.coalesce("component", "class").alias("component"))
    heads = named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "class")).alias("head")).select("head.id", "head.class")
    often = marks.groupBy("id").count().where("count > 1 or id is null").select(F.col("id").alias("again"))
    heads, _ = materialised(heads.join(often, F.col("id").eqNullSafe(F.col("again")), "left").select("id", "class", F.coalesce(F.col("again").isNotNull() | F.col("id").isNull(), F.lit(False)).alias("many")), "heads")
    key, named_id, kept_class, own_class = F.col(id_col).cast("long"), free("id", docs), free("kept", docs), free("class", docs)
    once = heads.where("not many").select(F.col("id").alias(named_id))
    kept = docs.join(once, key == F.col(named_id), "left_semi")
    # rows whose id occurs again, perhaps with another text: these are told apart by their class
    ids = heads.where("many").select(F.col("id").alias(named_id), F.col("class").alias(kept_class))
    again = _with_class(docs.join(ids.select(named_id).distinct(), key.eqNullSafe(F.col(named_id)), "left_semi"), text_col, own_class)
    again = again.join(ids, key.eqNullSafe(F.col(named_id)) & (F.col(own_class) == F.col(kept_class)), "left_semi")
    return kept.unionByName(again.dropDuplicates([id_col, own_class]).drop(own_class))
