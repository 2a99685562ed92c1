"""Snapshots and their branches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.errors import ArgumentError
from quarry.operators.content import new_rows
from quarry.plans.paging import latest, page_from, tasks_for
from quarry.session import cut


def snapshot_add(new: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshots, branches) to append from ``new(id, branches array<struct<name, target_type, target>>)``."""
    rows = new_rows(new, snapshot, ["id"])
    branches = rows.select(F.col("id").alias("snapshot_id"), F.explode("branches").alias("b")).select("snapshot_id", "b.*").distinct()
    return rows.select("id"), branches


def after_prefix(prefix):
    """The least string (or bytes) after all that begin with ``prefix``; None if there is none."""
    for k in range(len(prefix) - 1, -1, -1):
        if isinstance(prefix, bytes | bytearray):
            if prefix[k] < 0xFF:
                return bytes(prefix[:k]) + bytes([prefix[k] + 1])
        elif prefix[k] < "\U0010ffff":
            # there are no characters between these two
            return prefix[:k] + ("\ue000" if prefix[k] == "\ud7ff" else chr(ord(prefix[k]) + 1))
    return None


def _without_prefix(branches: DataFrame, prefix) -> DataFrame:
    """Branches whose names don't begin so: two ranges, which files are skipped by."""
    shown = lambda x: F.lit(bytearray(x) if isinstance(x, bytes) else x)
    above = after_prefix(prefix)
    outside = F.col("name") < shown(prefix)
    return branches.where(outside if above is None else outside | (F.col("name") >= shown(above)))


def snapshot_count_branches(ids: DataFrame, branches: DataFrame, exclude_prefix=None) -> DataFrame:
    """``(snapshot_id, target_type, n)``; a null type counts dangling branches."""
    rows = branches.join(ids.select(F.col("id").alias("snapshot_id")).distinct(), "snapshot_id", "left_semi")
    if exclude_prefix is not None:
        rows = _without_prefix(rows, exclude_prefix)
    return rows.groupBy("snapshot_id", "target_type").agg(F.count("*").alias("n"))


def snapshot_branches(branches: DataFrame, start=None, target_types: list[str] | None = None, include=None, exclude_prefix=None) -> DataFrame:
    """Branches of all snapshots under the filters; names are taken literally."""
    if start is not None:
        branches = branches.where(F.col("name") >= F.lit(start))
    if target_types is not None:
        branches = branches.where(F.col("target_type").isin(target_types))
    if include is not None:
        branches = branches.where(F.contains("name", F.lit(include)))
    if exclude_prefix is not None:
        branches = _without_prefix(branches, exclude_prefix)
    return branches


def snapshot_get_branches(snapshot_id, snapshot: DataFrame, branches: DataFrame, limit: int = 1000, **filters) -> tuple[DataFrame, object] | None:
    """One page of a snapshot's branches by name, and the first name of the next; None if it isn't known."""
    if snapshot.where(F.col("id") == F.lit(snapshot_id)).isEmpty():
        return None
    rows, token = page_from(snapshot_branches(branches.where(F.col("snapshot_id") == F.lit(snapshot_id)), **filters), ["name"], limit)
    return rows, token and token[0]


#: Branches that are shuffled at a time, and in how many parts, by their snapshots, more are looked up one after another at most.
BRANCHES_AT_A_TIME, PARTS_OF_BRANCHES = 25_000_000, 8


def snapshot_branch_get_by_name(asked: DataFrame, branches: DataFrame, max_chain: int = 100) -> DataFrame:
    """``(ord, branch_found, target_type, target, aliases_followed)`` of ``asked(ord, snapshot_id, name)``.

    Aliases are followed one join at a time over all questions, or those of a part of the snapshots. ``aliases_followed`` has
    the names met, the asked and the last one included; a chain ends without a target at a name that isn't there, at one it met
    before, and at ``max_chain`` names. A round's shuffle files are deleted once its answers are written. ``branches`` is read
    once a round and counted for the number of tasks and parts, ``asked`` once a part: pass tables, not plans.
    """
    rows = branches.count()
    parts = min(PARTS_OF_BRANCHES, max(1, -(-rows // BRANCHES_AT_A_TIME)))
    key = F.xxhash64(F.col("snapshot_id").cast(branches.schema["snapshot_id"].dataType))
    of = lambda df, part: df.where(F.pmod(key, F.lit(parts)) == part) if parts > 1 else df
    n = tasks_for(branches, -(-rows // parts))
    return reduce(DataFrame.unionByName, [x for part in range(parts) for x in _follow_aliases(of(asked, part), of(branches, part), n, max_chain)])


def _follow_aliases(asked: DataFrame, branches: DataFrame, n: int, max_chain: int) -> list[DataFrame]:
    at = ["snapshot_id", "_at"]
    own = branches.select("snapshot_id", F.col("name").alias("_at"), "target_type", "target", F.lit(True).alias("_hit")).repartition(n, *at)
    kind = branches.schema["name"].dataType.simpleString()
    now, done = asked.select("ord", "snapshot_id", F.col("name").alias("_at")), []
    for k in range(max_chain):
        step = now.repartition(n, *at).join(own, at, "left")
        if not k:  # an empty chain is not carried through the shuffle
            step = step.withColumn("chain", F.array().cast(f"array<{kind}>"))
        step = step.withColumn("met", F.array_contains("chain", F.col("_at"))).withColumn("chain", F.when(F.col("_hit"), F.concat("chain", F.array("_at"))).otherwise(F.col("chain")))
        step = step.withColumn("alias", F.coalesce(F.col("target_type") == "alias", F.lit(False)))
        step = step.withColumn("followed", F.col("alias") & ~F.col("met") & (F.size("chain") < max_chain))
        # of an answer only what is returned is written, of a name to follow only what is asked next
        step = step.select(
            "ord", "chain", "followed", F.when(F.col("followed"), F.col("snapshot_id")).alias("snapshot_id"),
            F.when(~F.col("alias"), F.col("target_type")).alias("target_type"), F.when(~F.col("alias") | F.col("followed"), F.col("target")).alias("target"),
        )
        step, followed = cut(step, "alias", "followed", lean=True)
        done.append(step.where("not followed").select("ord", (F.size("chain") > 0).alias("branch_found"), "target_type", "target", F.col("chain").alias("aliases_followed")))
        if not followed:
            break
        now = step.where("followed").select("ord", "snapshot_id", F.col("target").cast(kind).alias("_at"), "chain")
    return done


def snapshot_resolve_alias(asked: DataFrame, branches: DataFrame) -> DataFrame:
    return snapshot_branch_get_by_name(asked, branches).select("ord", "target_type", "target")


#: Origins of one snapshot that meet a part of its branches in one block of a join, and parts of the branches of such snapshots.
ORIGINS_OF_A_TASK, PARTS_OF_A_SNAPSHOT = 1000, 8


def snapshot_get_latest(origins: DataFrame, statuses: DataFrame, branches: DataFrame, branches_count: int | None = None, allowed: list[str] | None = None) -> DataFrame:
    """Branches of each origin's latest snapshot, at most ``branches_count`` by name.

    The latest snapshots are written first, so only their branches are dealt. Where many origins have one snapshot, its branches
    go to blocks of these origins, and a block's origins meet one branch after another: rows that lie together are alike.
    """
    if branches_count is not None and branches_count <= 0:
        raise ArgumentError("branches_count must be positive")
    rows = statuses.where("snapshot is not null").join(origins.select("origin").distinct(), "origin", "left_semi")
    if allowed:
        rows = rows.where(F.col("status").isin(allowed))
    last, _ = cut(latest(rows, ["origin"], ["visit", "date"]).select("origin", F.col("snapshot").alias("snapshot_id")), "latest")
    blocks, shared = cut(last.groupBy("snapshot_id").agg(F.ceil(F.count("*") / ORIGINS_OF_A_TASK).cast("int").alias("_blocks")), "blocks", "_blocks > 1")
    own = branches.join(blocks.select("snapshot_id"), "snapshot_id", "left_semi")
    if branches_count is not None:
        nth = F.row_number().over(Window.partitionBy("snapshot_id").orderBy("name"))
        own = own.withColumn("_n", nth).where(F.col("_n") <= branches_count).drop("_n")
    at = ["snapshot_id"]
    if shared:
        at += ["_block", "_part"]
        # as many tasks as other shuffles have, and no fewer than there are blocks of shared snapshots
        parts = F.when(F.col("_blocks") > 1, PARTS_OF_A_SNAPSHOT).otherwise(1)
        n = max(int(last.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks.where("_blocks > 1").agg(F.sum(F.col("_blocks") * parts)).first()[0])
        each = lambda number: F.explode(F.sequence(F.lit(0), number - 1))
        drawn = lambda of, number: F.pmod(F.xxhash64(of), number).cast("int")
        own = own.join(blocks, "snapshot_id").withColumn("_part", drawn("name", parts)).withColumn("_block", each(F.col("_blocks"))).drop("_blocks").repartition(n, *at)
        last = last.join(blocks, "snapshot_id").withColumn("_block", drawn("origin", F.col("_blocks"))).withColumn("_part", each(parts)).drop("_blocks").repartition(n, *at)
    return own.join(last.hint("merge"), at).select("snapshot_id", "origin", *[c for c in branches.columns if c != "snapshot_id"])


def visits_and_snapshots_from_revision(asked: DataFrame, statuses: DataFrame, branches: DataFrame) -> DataFrame:
    """``(origin, id, visit, date, status, snapshot)`` where a branch of the snapshot is the revision, one row per branch.

    Branches are counted before the join and told apart after it, so no join meets a snapshot's branches one by one.
    """
    hits = branches.where("target_type = 'revision'").groupBy(F.col("snapshot_id").alias("snapshot"), F.col("target").alias("id")).agg(F.count("*").alias("_n"))
    hits = hits.join(asked.select("id").distinct(), "id", "left_semi")
    rows = statuses.where("snapshot is not null").join(asked.distinct(), "origin").join(hits, ["snapshot", "id"])
    each = F.explode(F.array_repeat(F.lit(0).cast("tinyint"), F.col("_n").cast("int")))
    return rows.select("origin", "id", "visit", "date", "status", "snapshot", each.alias("_each")).drop("_each")


def snapshot_id_from_revision(asked: DataFrame, statuses: DataFrame, branches: DataFrame) -> DataFrame:
    """The snapshot of the newest such visit and status.

    Of an origin's statuses with one snapshot only the newest can be it, and of a snapshot's branches to one revision one.
    An origin's snapshots are ranked before they meet revisions; of each pair the least rank is kept, in a hash table.
    """
    hits = branches.where("target_type = 'revision'").select(F.col("snapshot_id").alias("snapshot"), F.col("target").alias("id")).distinct()
    hits = hits.join(asked.select("id").distinct(), "id", "left_semi")
    known = statuses.where("snapshot is not null").join(asked.select("origin").distinct(), "origin", "left_semi")
    newest = latest(known.select("origin", "snapshot", "visit", "date"), ["origin", "snapshot"], ["visit", "date"])
    rank = F.row_number().over(Window.partitionBy("origin").orderBy(*[F.desc(c) for c in ("visit", "date", "snapshot")]))
    ranked = newest.select("origin", "snapshot", rank.alias("_rank"))
    best = ranked.join(hits, "snapshot").groupBy("origin", "id").agg(F.min("_rank").alias("_rank")).join(asked.select("origin", "id").distinct(), ["origin", "id"])
    return best.join(ranked, ["origin", "_rank"]).select("origin", "id", "snapshot")
