"""Closures over the revision graph, and the orders in which their revisions are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.directory import directory_entry_get_by_path
from quarry.session import cut


def ancestors(roots: DataFrame, parents: DataFrame, per_root: bool = False) -> DataFrame:
    """``(id, depth)``: every revision reachable from any of ``roots(root)``, they included, once, at its least depth.

    With ``per_root`` the closure of each root by itself, ``(root, id, depth)``.

    A round goes from what the last one found, or found nearer, to its parents and along shortcuts: a revision's first
    parent 2, 4, 8, ... generations up. Each round doubles the reach of the shortcuts, of which a revision has one per
    doubling, so a line of n generations takes some 2 log n rounds, and each change to another parent one more. A round is a
    join with the edges and one grouping, written to the shared folder; it ends when nothing comes nearer.
    """
    keys = ["root", "id"] if per_root else ["id"]
    edges = parents.select(F.col("id").alias("_from"), F.col("parent_id").alias("_to"), "parent_rank").where("_to is not null")
    line = edges.groupBy("_from").agg(F.min_by("_to", F.struct("parent_rank", "_to")).alias("_to"))
    line, longer = cut(line, "line")
    hops = edges.select("_from", "_to", F.lit(1).cast("long").alias("_far")).distinct()
    start = roots.select(*([F.col("root")] if per_root else []), F.col("root").alias("id")).distinct()
    seen, n = cut(start.withColumn("depth", F.lit(0).cast("long")).withColumn("fresh", F.lit(True)), "seen")
    far = 1
    while n:
        if longer:
            far *= 2
            up = line.select(F.col("_from").alias("_mid"), F.col("_to").alias("_end"))
            line, longer = cut(line.join(up, F.col("_to") == F.col("_mid")).select("_from", F.col("_end").alias("_to")), "line")
            hops = hops.unionByName(line.withColumn("_far", F.lit(far).cast("long")))
        step = seen.where("fresh").join(hops, F.col("id") == F.col("_from")).select(*[F.col("_to").alias(k) if k == "id" else k for k in keys], (F.col("depth") + F.col("_far")).alias("depth"))
        old = seen.select(*keys, "depth", F.col("depth").alias("was")).unionByName(step.withColumn("was", F.lit(None).cast("long")))
        now = old.groupBy(*keys).agg(F.min("depth").alias("depth"), F.min("was").alias("was"))
        seen, n = cut(now.select(*keys, "depth", (F.col("was").isNull() | (F.col("depth") < F.col("was"))).alias("fresh")), "seen", "fresh")
    return seen.select(*keys, F.col("depth").cast("int"))


def revision_log(roots: DataFrame, revisions: DataFrame, parents: DataFrame, limit: int | None = None, per_root: bool = False) -> DataFrame:
    """Full rows of all known ancestors of the roots, each once, with ``depth``; ``limit`` keeps the first by (depth, id).

    With ``per_root`` each root's log by itself, and ``limit`` counts in each.
    """
    rows = ancestors(roots, parents, per_root).join(revisions, "id")
    if limit is None:
        return rows
    if not per_root:
        return rows.orderBy("depth", "id").limit(limit)
    nth = F.row_number().over(Window.partitionBy("root").orderBy("depth", "id"))
    return rows.withColumn("_n", nth).where(F.col("_n") <= limit).drop("_n")


def parent_lists(parents: DataFrame) -> DataFrame:
    """``(id, parents)`` with parents by rank."""
    pairs = F.array_sort(F.collect_list(F.struct("parent_rank", "parent_id")))
    return parents.groupBy("id").agg(F.transform(pairs, lambda p: p["parent_id"]).alias("parents"))


def with_parents(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """``rows`` with their parents by rank, an empty list for a revision without any."""
    kind = parents.schema["parent_id"].dataType.simpleString()
    return rows.join(parent_lists(parents), "id", "left").withColumn("parents", F.coalesce("parents", F.array().cast(f"array<{kind}>")))


def revision_shortlog(roots: DataFrame, revisions: DataFrame, parents: DataFrame, limit: int | None = None, per_root: bool = False) -> DataFrame:
    """``([root,] id, depth, parents)`` of all known ancestors, as ``revision_log``."""
    return with_parents(revision_log(roots, revisions.select("id"), parents, limit, per_root), parents)


def by_date(roots: DataFrame, revisions: DataFrame, parents: DataFrame, limit: int | None = None) -> DataFrame:
    """The known ancestors of the roots, latest ``seconds`` first, then by id; a revision without a date comes last.

    Where no revision is older than its parents this is how a walk meets them that always goes on with the latest.
    """
    rows = ancestors(roots, parents).join(revisions, "id").orderBy(F.col("seconds").desc_nulls_last(), "id")
    return rows if limit is None else rows.limit(limit)


def breadth_first(roots: DataFrame, revisions: DataFrame, parents: DataFrame, limit: int | None = None) -> DataFrame:
    """The known ancestors of the roots generation by generation, within one by id."""
    rows = ancestors(roots, parents).join(revisions, "id").orderBy("depth", "id")
    return rows if limit is None else rows.limit(limit)


def path_history(roots: DataFrame, path: list, revisions: DataFrame, parents: DataFrame, entries: DataFrame) -> DataFrame:
    """``(id, depth, target)``: ancestors of the roots in which what is at ``path`` differs from what all parents have there.

    A revision that has the same as some of its parents is followed to the first of those alone, so changes that a merge
    did not take are left out; nothing is followed to where the path doesn't exist. All paths are resolved at once.
    """
    known = ancestors(roots, parents).select("id").join(revisions.select("id", "directory"), "id")
    asked = known.select(F.col("id").alias("ord"), F.col("directory").alias("root"), F.array(*map(F.lit, path)).alias("path"))
    at, _ = cut(directory_entry_get_by_path(asked, entries).select(F.col("ord").alias("id"), "target"), "at")
    above = parents.join(at.withColumnsRenamed({"id": "parent_id", "target": "old"}), "parent_id").join(at, "id")
    above = above.withColumn("same", F.col("old").eqNullSafe(F.col("target")))
    alike = above.where("same").groupBy("id").agg(F.min("parent_rank").alias("only"))
    kept = above.where("old is not null").join(alike, "id", "left").where(F.col("only").isNull() | (F.col("parent_rank") == F.col("only")))
    met = ancestors(roots, kept.select("id", "parent_id", "parent_rank")).join(at.where("target is not null"), "id")
    return met.join(alike, "id", "left_anti").select("id", "depth", "target")
