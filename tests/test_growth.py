"""Queries on tables that grow, or hold the same twice, against their SQL; operators on what that needs."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quarry import session
from quarry.operators import diff, lifecycle, snapshot
from quarry.plans import paging, queries
from quarry.sources import projections

duckdb = pytest.importorskip("duckdb")


def same_as_sql(spark, folder, name, *tables, sf="/root/testdata/sf0.001", **own):
    """Whether a query gives its SQL's rows over ``own`` tables (SQL texts for the checking engine) and sample ones."""
    con, found = duckdb.connect(), str(folder)
    for t in tables:
        os.path.exists(f"{found}/{t}.parquet") or os.symlink(f"{sf}/{t}.parquet", f"{found}/{t}.parquet")
    for t, text in own.items():
        con.execute(f"copy ({text}) to '{found}/{t}.parquet' (format parquet)")
    for t in (*tables, *own):
        con.execute(f"create view {t} as select * from '{found}/{t}.parquet'")
    rows = queries.QUERIES[name](spark, found)
    want = con.sql(queries.SQL[name])
    assert sorted(want.columns) == sorted(rows.columns)
    got = sorted(tuple(map(str, r)) for r in rows.select(*want.columns).collect())
    return got == sorted(tuple(map(str, r)) for r in want.fetchall()) and len(got) > 0


def test_int_ranges_are_reckoned(spark):
    low, high, most = -7, 100_000, 3
    rows = lifecycle.in_int_ranges(spark.range(-20, 100_020), "id", low, high, most)
    seen = rows.agg(F.count("*"), F.count_distinct("range"), F.min("range"), F.max("range"), F.bool_and(F.col("range") == F.floor((F.col("id") + 7) / 3))).first()
    assert tuple(seen) == (high - low, 33_336, 0, len(lifecycle.int_ranges(low, high, most)) - 1, True)


def test_many_ranges_overlapping_or_open(spark):
    ranges = [(k, k + 5) for k in range(0, 3000, 3)] + [(2990, None), (None, -5), (7, 7)]
    ids = [-9, -5, -1, 0, 2, 3, 5, 1500, 2999, 3001, 3002, 9999, None]
    first = lambda x: next((i for i, (a, b) in enumerate(ranges) if (a is None or x >= a) and (b is None or x < b)), None)
    rows = lifecycle.in_ranges(spark.createDataFrame([(i,) for i in ids], "id long"), "id", ranges).collect()
    assert {r["id"]: r["range"] for r in rows} == {i: first(i) for i in ids if i is not None and first(i) is not None}
    names = lifecycle.in_ranges(spark.createDataFrame([("00ab",), ("7fff",), ("ff",)], "k string"), "k", lifecycle.byte_ranges(8)).collect()
    assert {r["k"]: r["range"] for r in names} == {"00ab": 0, "7fff": 127, "ff": 255}


def test_backfill_ranges_of_scattered_ids(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "backfill_ranges", documents="select i * 1000003 as doc_id, 't' || i as text from range(50) t(i)")


def test_extids_that_repeat_are_found_once_a_row(spark, tmp_path):
    pages = "select i as page_id, 'http://e.example/' || i % 4 as url, 'h' || i % 7 as html from range(60) t(i)"
    assert same_as_sql(spark, tmp_path, "extid_get_from_extid", pages=pages)


GROUPS = ("snapshot_branch_get_by_name", "snapshot_resolve_alias", "snapshot_get_latest", "snapshot_count_branches", "edge_extraction", "object_references_add", "object_find_recent_references",
          "snapshot_add", "snapshot_id_from_revision", "visits_and_snapshots_from_revision")


@pytest.mark.parametrize("name", GROUPS)
def test_equals_sql_dealt_over_many_tasks(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(paging, "ROWS_OF_A_TASK", 150)
    assert same_as_sql(spark, tmp_path, name, *[t for t in projections.BASE if t != "events"], events="select event_id, ts, user_id % 3 as user_id, event_type from '/root/testdata/sf0.001/events.parquet'")


def test_branches_are_dealt_by_volume_in_one_shuffle(spark, monkeypatch):
    monkeypatch.setattr(paging, "ROWS_OF_A_TASK", 500)
    rows = projections.view(spark, "/root/testdata/sf0.001", "branch")
    lines = projections.view(spark, "/root/testdata/sf0.001", "lineitem").count()
    used = rows.select("snapshot_id", "target", F.spark_partition_id().alias("p")).collect()
    assert len({r["p"] for r in used}) > 8 and max(r["p"] for r in used) < -(-lines // 500)
    assert len({(r["snapshot_id"], r["p"]) for r in used}) == len({r["snapshot_id"] for r in used})


def test_revision_is_found_in_newest_snapshot_of_many(spark):
    statuses = spark.createDataFrame([("o", 1, 5, "s1"), ("o", 2, 1, "s2"), ("o", 2, 1, "s3"), ("o", 3, 9, "s9"), ("p", 1, 1, "s1")], "origin string, visit long, date long, snapshot string").withColumn("status", F.lit("full"))
    branches = spark.createDataFrame([("s1", "a"), ("s1", "a"), ("s2", "a"), ("s3", "a"), ("s3", "b"), ("s9", "c")], "snapshot_id string, target string").withColumn("target_type", F.lit("revision"))
    asked = spark.createDataFrame([("o", "a"), ("o", "a"), ("o", "b"), ("p", "a"), ("p", "b")], "origin string, id string")
    assert sorted(map(tuple, snapshot.snapshot_id_from_revision(asked, statuses, branches).collect())) == [("o", "a", "s3"), ("o", "b", "s3"), ("p", "a", "s1")]
    each = snapshot.visits_and_snapshots_from_revision(asked, statuses, branches).where("snapshot = 's1'").select("origin", "id").collect()
    assert sorted(map(tuple, each)) == [("o", "a")] * 2 + [("p", "a")] * 2


def test_trees_are_compared_once_for_all_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(diff, "PAIRS_OF_A_TASK", 3)
    seen = []
    compare = diff._changed
    monkeypatch.setattr(diff, "_changed", lambda pairs, *rest: seen.append(pairs.count()) or compare(pairs, *rest))
    entries = spark.createDataFrame([("t", "a", "file", "1", 1), ("t", "b", "file", "2", 1), ("u", "a", "file", "3", 1), ("u", "d", "dir", "t", 2)], "directory_id string, name string, type string, target string, perms int")
    trees = [(None, "t"), ("t", "u"), ("u", None), ("t", "t"), (None, None)]
    pairs = spark.createDataFrame([(k, *trees[k % 5]) for k in range(50)], "pair long, old_dir string, new_dir string")
    found = sorted((r["pair"] % 5, r["type"], r["from_path"] or "", r["to_path"] or "") for r in diff.diff_directories(pairs, entries).collect())
    once = [(0, "insert", "", "a"), (0, "insert", "", "b"), (1, "delete", "b", ""), (1, "insert", "", "d/a"), (1, "insert", "", "d/b"), (1, "modify", "a", "a"), (2, "delete", "a", ""), (2, "delete", "d/a", ""), (2, "delete", "d/b", "")]
    assert found == sorted(once * 10) and seen == [5]


def test_pairs_and_changes_meet_in_blocks_over_many_tasks(spark, monkeypatch):
    for most, number in (("PAIRS_OF_A_TASK", 10), ("CHANGES_OF_A_TASK", 20), ("ROWS_OF_A_TASK", 1000)):
        monkeypatch.setattr(diff, most, number, raising=False)
    entries = spark.range(200).selectExpr("'t' as directory_id", "'f' || id as name", "'file' as type", "'x' || id as target", "1 as perms")
    pairs = spark.range(150).selectExpr("id as pair", "cast(null as string) as old_dir", "'t' as new_dir")
    found = diff.diff_directories(pairs, entries)
    rows = found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in rows) == found.distinct().count() == 200 * 150
    # one group of 150 pairs and 200 changes: 150 blocks of some 200 rows in 30 tasks, none with a fifth of the rows
    assert len(rows) > 15 and max(r["n"] for r in rows) < 200 * 150 / 5


def test_origins_of_one_snapshot_meet_its_branches_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "ORIGINS_OF_A_TASK", 5, raising=False)
    statuses = spark.range(101).selectExpr("'o' || id as origin", "1L as visit", "id as date", "'full' as status", "if(id < 100, 's', 't') as snapshot")
    statuses = statuses.unionByName(statuses.where("date = 7").selectExpr("origin", "2L as visit", "date", "status", "'gone' as snapshot"))
    branches = spark.range(90).selectExpr("element_at(array('s', 't', 'u'), cast(id % 3 + 1 as int)) as snapshot_id", "lpad(id, 2, '0') as name", "'revision' as target_type", "'x' as target")
    found = snapshot.snapshot_get_latest(statuses, statuses, branches)
    rows = found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert found.columns == ["snapshot_id", "origin", "name", "target_type", "target"]
    assert sum(r["n"] for r in rows) == found.distinct().count() == 100 * 30
    assert found.select("origin", "snapshot_id").distinct().groupBy("snapshot_id").count().orderBy("snapshot_id").collect() == [("s", 99), ("t", 1)]
    assert len(rows) > 40 and max(r["n"] for r in rows) < 300
    least = snapshot.snapshot_get_latest(statuses, statuses, branches, branches_count=2).groupBy("snapshot_id", "name").count().collect()
    assert sorted(map(tuple, least)) == [("s", "00", 99), ("s", "03", 99), ("t", "01", 1), ("t", "04", 1)]
    assert same_as_sql(spark, tmp_path, "snapshot_get_latest", *[t for t in projections.BASE if t != "events"], events="select event_id, ts, user_id * 7 as user_id, event_type from '/root/testdata/sf0.01/events.parquet'")


def test_branches_of_older_snapshots_are_not_dealt(spark):
    plan = queries.QUERIES["snapshot_get_latest"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = {kind: max(len(x) - len(x.lstrip(" :+-")) for x in plan if kind in x) for kind in ("Aggregate [l_orderkey", "LeftSemi") if any(kind in x for x in plan)}
    # the filter by latest snapshots is below the grouping of the lines
    assert depth["LeftSemi"] > depth["Aggregate [l_orderkey"]


def test_rounds_of_aliases_leave_no_shuffle_files(spark):
    tops = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def shuffled():
        paths = [os.path.join(d, f) for top in tops for d, _, files in os.walk(top) for f in files if f.startswith("shuffle_")]
        return {p: os.path.getsize(p) for p in paths if os.path.exists(p)}

    before, was = set(shuffled()), spark.conf.get(session.FREED)
    found = queries.QUERIES["snapshot_branch_get_by_name"](spark, "/root/testdata/sf0.001")
    left = lambda: sum(n for p, n in shuffled().items() if p not in before)
    until = time.time() + 20
    while left() > 20_000 and time.time() < until:  # they are deleted a moment after
        time.sleep(0.2)
    # what counting rows shuffles may stay; the rounds themselves shuffle some 250 kB
    assert left() <= 20_000
    assert spark.conf.get(session.FREED) == was and found.count() == found.distinct().count() > 5000


@pytest.mark.parametrize("name", ["snapshot_branch_get_by_name", "snapshot_resolve_alias"])
def test_aliases_are_followed_part_by_part(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(snapshot, "BRANCHES_AT_A_TIME", 1500)
    seen = []
    follow = snapshot._follow_aliases
    monkeypatch.setattr(snapshot, "_follow_aliases", lambda asked, branches, *rest: seen.append((asked.count(), branches.count())) or follow(asked, branches, *rest))
    assert same_as_sql(spark, tmp_path, name, "orders", "lineitem", "part")
    assert len(seen) == 4 and all(0 < a == b < 2000 for a, b in seen)


def test_parts_of_aliases_do_not_hang_on_the_type_of_ids(spark, monkeypatch):
    monkeypatch.setattr(snapshot, "BRANCHES_AT_A_TIME", 10)
    branches = spark.range(40).selectExpr("id as snapshot_id", "'HEAD' as name", "'alias' as target_type", "'main' as target").union(spark.range(40).selectExpr("id", "'main'", "'revision'", "'r' || id"))
    asked = spark.range(41).selectExpr("id as ord", "cast(if(id = 40, null, id) as int) as snapshot_id", "'HEAD' as name")
    found = {r["ord"]: (r["branch_found"], r["target"], len(r["aliases_followed"])) for r in snapshot.snapshot_branch_get_by_name(asked, branches).collect()}
    assert found == {k: (True, f"r{k}", 2) for k in range(40)} | {40: (False, None, 0)}


def test_documents_of_one_file_are_parsed_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(paging, "ROWS_OF_A_TASK", 150)
    assert same_as_sql(spark, tmp_path, "migrate_revision_metadata", "part")
    used = queries._old_metadata(lambda n: projections.view(spark, str(tmp_path), n)).select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > 1
