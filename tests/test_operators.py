import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.errors import ArgumentError, BlockedOrigin, HashCollision, MaskedObject, UnknownObject
from quarry.operators import content, diff, directory, graph, lifecycle, membership, metadata, migration, origin, policy, references, snapshot
from quarry.plans import paging, pipeline

ENTRY = "directory_id string, name string, type string, target string, perms int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_partial_hashes_and_nulls(spark):
    have = spark.createDataFrame([("a", "g", "s"), ("b", "h", "t")], "sha1 string, sha1_git string, sha256 string")
    ask = spark.createDataFrame([("a", None, "s"), ("a", "h", None), (None, "h", None), (None, None, None), ("c", None, None)], have.schema)
    assert rows(membership.content_missing(ask, have, "sha1")) == sorted([("a",), (None,), ("c",)], key=str)
    assert rows(membership.skipped_content_missing(ask, ask.limit(1))) == rows(ask.subtract(ask.limit(1)))
    with pytest.raises(ArgumentError):
        membership.content_find(have)
    with pytest.raises(ArgumentError):
        membership.content_find(have, md5="x")


def test_collisions_in_a_batch_and_with_the_table(spark):
    schema = "sha1 string, sha1_git string, sha256 string, blake2s256 string"
    table = spark.createDataFrame([("a", "1", "2", "3")], schema)
    new = spark.createDataFrame([("a", "1", "9", "3"), ("b", "4", "5", "6"), ("b", "4", "5", "6"), ("c", "7", "5", "8"), ("d", "d", "d", "d")], schema)
    assert rows(content.hash_collisions(new, table).select("algo", "hash")) == [("blake2s256", "3"), ("sha1", "a"), ("sha1_git", "1"), ("sha256", "5")]
    assert rows(content.without_collisions(new, table)) == [("d", "d", "d", "d")]
    assert isinstance(HashCollision({"sha1": 1}), ArgumentError)


def test_tree_changes(spark):
    entries = [
        ("A", "same", "dir", "S", 1), ("A", "d", "dir", "D1", 1), ("A", "f", "file", "x", 1), ("A", "mode", "file", "m", 1), ("A", "swap", "file", "w", 1), ("A", "void", "dir", "E", 1),
        ("B", "same", "dir", "S", 1), ("B", "d", "dir", "D2", 1), ("B", "f", "file", "y", 1), ("B", "mode", "file", "m", 2), ("B", "swap", "dir", "W", 1), ("B", "new", "dir", "E", 1),
        ("S", "s", "file", "s", 1), ("D1", "old", "file", "k", 1), ("D1", "e", "dir", "E", 1), ("D2", "moved", "file", "k", 1), ("D2", "e", "dir", "W", 1), ("W", "in", "file", "i", 1),
    ]
    entries = spark.createDataFrame(entries, ENTRY)
    pairs = spark.createDataFrame([(1, "A", "B"), (2, None, "S"), (3, "S", None), (4, "S", "S")], "pair int, old_dir string, new_dir string")
    got = rows(diff.diff_directories(pairs, entries))
    assert got == sorted(
        [
            (1, "modify", "f", "f"), (1, "modify", "mode", "mode"), (1, "delete", "swap", None), (1, "insert", None, "swap/in"), (1, "delete", "d/old", None), (1, "insert", None, "d/moved"),
            (1, "insert", None, "d/e/in"), (1, "delete", "void", None), (1, "insert", None, "new"), (2, "insert", None, "s"), (3, "delete", "s", None),
        ],
        key=str,
    )
    renamed = rows(diff.diff_directories(pairs.where("pair = 1"), entries, track_renames=True))
    assert (1, "rename", "d/old", "d/moved") in renamed and (1, "rename", "void", "new") in renamed
    assert len(renamed) == 7


GRAPH = {"f": ["d", "e"], "e": ["c"], "d": ["b"], "c": ["a"], "b": ["a"], "a": []}
TIMES = {"f": 60, "e": 50, "d": 40, "c": 45, "b": 20, "a": 10}


def graph_tables(spark):
    revisions = spark.createDataFrame([(k, TIMES[k], f"tree {k}") for k in GRAPH], "id string, seconds int, directory string")
    parents = spark.createDataFrame([(k, n, p) for k, v in GRAPH.items() for n, p in enumerate(v)], "id string, parent_rank int, parent_id string")
    return revisions, parents


def test_orders_of_a_history(spark):
    revisions, parents = graph_tables(spark)
    root = spark.createDataFrame([("f",)], "root string")
    order = lambda df: "".join(r.id for r in df.collect())
    assert order(graph.by_date(root, revisions, parents)) == "fecdba"
    assert order(graph.by_date(root, revisions, parents, limit=2)) == "fe"
    assert order(graph.breadth_first(root, revisions, parents)) == "fdebca"
    assert order(graph.breadth_first(root, revisions.where("id <> 'c'"), parents)) == "fdeba"


def test_history_of_a_path(spark):
    revisions, parents = graph_tables(spark)
    root = spark.createDataFrame([("f",)], "root string")

    def changed(targets):
        entries = spark.createDataFrame([(f"tree {k}", "x", "file", str(v), 0) for k, v in targets.items()], "directory_id string, name string, type string, target string, perms int")
        return {(r.id, r.depth) for r in graph.path_history(root, ["x"], revisions, parents, entries).collect()}

    # f took what e has, so d and b are not followed; c is where the path began
    assert changed({"f": 1, "e": 1, "c": 2, "d": 3, "b": 3}) == {("e", 1), ("c", 2)}
    assert changed(dict.fromkeys(GRAPH, 7)) == {("a", 3)}
    assert changed({}) == set()


def test_closures_of_several_roots_and_of_long_lines(spark):
    revisions, parents = graph_tables(spark)
    roots = spark.createDataFrame([("d",), ("e",), ("e",)], "root string")
    assert {(r.id, r.depth) for r in graph.revision_log(roots, revisions, parents).collect()} == {("d", 0), ("e", 0), ("b", 1), ("c", 1), ("a", 2)}
    each = graph.revision_log(roots, revisions, parents, per_root=True).select("root", "id", "depth").collect()
    assert sorted(map(tuple, each)) == [("d", "a", 2), ("d", "b", 1), ("d", "d", 0), ("e", "a", 2), ("e", "c", 1), ("e", "e", 0)]
    line = spark.range(1, 700).selectExpr("cast(id as int) as id", "0 as parent_rank", "cast(id - 1 as int) as parent_id")
    found = graph.ancestors(spark.createDataFrame([(699,)], "root int"), line)
    assert found.where("depth <> 699 - id").count() == 0 and found.count() == 700
    loop = spark.createDataFrame([(1, 0, 2), (2, 0, 3), (3, 0, 1)], "id int, parent_rank int, parent_id int")
    assert {(r.id, r.depth) for r in graph.ancestors(spark.createDataFrame([(1,)], "root int"), loop).collect()} == {(1, 0), (2, 1), (3, 2)}


@settings(max_examples=5, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 12), st.integers(0, 12)).filter(lambda e: e[0] > e[1]), max_size=25))
def test_closure_equals_search(spark, edges):
    parents = spark.createDataFrame([(a, 0, b) for a, b in edges], "id int, parent_rank int, parent_id int")
    got = {(r.id, r.depth) for r in graph.ancestors(spark.createDataFrame([(12,)], "root int"), parents).collect()}
    want, front, depth = {12: 0}, {12}, 0
    while front:
        depth += 1
        front = {b for a, b in edges if a in front} - set(want)
        want |= dict.fromkeys(front, depth)
    assert got == set(want.items())


def test_alias_chains(spark):
    named = [("loop1", "alias", "loop2"), ("loop2", "alias", "loop1"), ("self", "alias", "self"), ("a", "alias", "b"), ("b", "alias", "c"), ("c", "revision", "r"), ("lost", "alias", "none"), ("dangling", None, None)]
    branches = spark.createDataFrame([("s", *n) for n in named], "snapshot_id string, name string, target_type string, target string")
    asked = spark.createDataFrame([(n, "s", n) for n in ("loop1", "self", "a", "lost", "dangling", "absent")], "ord string, snapshot_id string, name string")
    got = {r.ord: (r.branch_found, r.target_type, r.target, "".join(x[0] + x[-1] for x in r.aliases_followed)) for r in snapshot.snapshot_branch_get_by_name(asked, branches).collect()}
    assert got == {
        "loop1": (True, None, None, "l1l2l1"), "self": (True, None, None, "sfsf"), "a": (True, "revision", "r", "aabbcc"), "lost": (True, None, None, "lt"),
        "dangling": (True, None, None, "dg"), "absent": (False, None, None, ""),
    }
    short = snapshot.snapshot_branch_get_by_name(asked.where("ord = 'a'"), branches, max_chain=2).first()
    assert short.target is None and short.aliases_followed == ["a", "b"]


def test_visits(spark):
    origins = spark.createDataFrame([("o",), ("p",)], "url string")
    day = lambda d: datetime.datetime(2024, 1, d, tzinfo=datetime.timezone.utc)
    visits = spark.createDataFrame([("o", 1, day(1), "git")], "origin string, visit long, date timestamp, type string")
    new = spark.createDataFrame([("o", day(5), "git"), ("o", day(3), "hg"), ("p", day(2), "git")], "origin string, date timestamp, type string")
    got, first = origin.origin_visit_add(new, origins, visits)
    assert [r[:2] for r in rows(got)] == [("o", 2), ("o", 3), ("p", 1)] and {r.status for r in first.collect()} == {"created"}
    with pytest.raises(UnknownObject):
        origin.origin_visit_add(new.selectExpr("'q' as origin", "date", "type"), origins, visits)
    with pytest.raises(UnknownObject):
        origin.origin_visit_status_add(spark.createDataFrame([("o", 9, day(1), None, "full")], "origin string, visit long, date timestamp, type string, status string"), visits, visits)
    asked = spark.createDataFrame([(1, "o", day(4))], "ord int, origin string, at timestamp")
    both = visits.union(got)
    assert origin.origin_visit_find_by_date(asked, both).first().visit == 3
    with pytest.raises(ArgumentError):
        origin.filtered_statuses(both, allowed=["done"])
    assert origin.filtered_statuses(both.withColumnRenamed("type", "status"), allowed=["done", "full"]).count() == 0


def test_pages_and_partitions(spark):
    df = spark.range(10).selectExpr("id", "id % 3 as g")
    seen, token = [], None
    while True:
        found, token = paging.page(df, ["g", "id"], 4, token)
        seen += [(r.g, r.id) for r in found.collect()]
        if token is None:
            break
    assert seen == sorted(seen) and len(seen) == 10
    found, token = paging.page_from(df, ["id"], 4, (3,))
    assert [r.id for r in found.collect()] == [3, 4, 5, 6] and token == (7,)
    assert paging.page(df, ["id"], 10)[1] is None and paging.page(df, ["id"], 3, (5,), descending=True)[0].first().id == 4
    assert [paging.leading_digits(i, 16) for i in (0, 15)] == [[0], [15]] and paging.leading_digits(1, 32) == [0, 8] and paging.leading_digits(0, 1) == []
    assert paging.leading_digits(5, 512, 8) == [2, 128]
    for bad in ((0, 3), (4, 4), (-1, 4), (0, 0)):
        with pytest.raises(ArgumentError):
            paging.leading_digits(*bad)
    hashes = spark.range(64).selectExpr("unhex(sha1(cast(id as string))) as id")
    for n in (1, 4, 32):
        parts = [{bytes(r.id) for r in paging.get_partition(hashes, "id", i, n)[0].collect()} for i in range(n)]
        assert all(min(b) > max(a) for a, b in zip([p for p in parts if p], [p for p in parts if p][1:], strict=False))
        assert sum(map(len, parts)) == 64
        text = hashes.selectExpr("lower(hex(id)) as id")
        assert [{bytes.fromhex(r.id) for r in paging.get_partition(text, "id", i, n, as_hex=True)[0].collect()} for i in range(n)] == parts
    assert paging.random_row(hashes, "id", 5).count() == 1


def test_policies(spark):
    masks = spark.createDataFrame([("1", "content", "r", "restricted"), ("2", "content", "r", "visible")], "object_id string, object_type string, request string, state string")
    result = spark.createDataFrame([("1",), ("2",), ("3",)], "object_id string")
    assert rows(policy.masked(result, masks, ["object_id"])) == [("2",), ("3",)]
    with pytest.raises(MaskedObject) as e:
        policy.masked(result, masks, ["object_id"], mode="raise")
    assert e.value.masked == {("1",): [("r", "restricted")]}
    assert policy.masked(result.where("object_id > '1'"), masks, ["object_id"], mode="raise").count() == 2
    rules = spark.createDataFrame([("https://h", "1", "blocked"), ("https://h/a", "2", "non_blocked"), ("https://h/a/b", "3", "decision_pending"), ("https://h/a/b", "4", "non_blocked")], "url_match string, request string, state string")
    urls = spark.createDataFrame([("https://h/x",), ("https://h/a/b.git",), ("https://h/a/",), ("https://hh/a",)], "url string")
    good, log = policy.blocked(urls, rules)
    assert rows(good) == [("https://h/a/",), ("https://h/a/b.git",), ("https://hh/a",)] and log.count() == 3
    with pytest.raises(BlockedOrigin):
        policy.blocked(urls, rules, mode="raise")
    with pytest.raises(ArgumentError):
        policy.set_states(masks, ["object_id"], masks.selectExpr("*", "1 as seq").withColumn("state", masks.request))
    requests = spark.createDataFrame([("r", "slug"), ("q", "other")], "id string, slug string")
    assert rows(policy.request_list(requests, masks).select("id")) == [("r",)] and policy.request_list(requests, masks, True).count() == 2
    with pytest.raises(ArgumentError):
        policy.request_create(requests.limit(1), requests)


def test_reference_weeks():
    assert references.week_bounds(2020, 53) == (datetime.date(2020, 12, 28), datetime.date(2021, 1, 4))
    weeks = references.weeks_between(datetime.date(2024, 12, 28), datetime.date(2025, 1, 8))
    assert weeks == [(2024, 52), (2025, 1), (2025, 2)]
    assert references.weeks_to_drop(weeks, datetime.date(2025, 1, 6)) == [(2024, 52), (2025, 1)]
    with pytest.raises(ArgumentError):
        references.weeks_to_drop(weeks, datetime.date(2026, 1, 1))


def test_references_repeat_only_on_other_days(spark):
    new = spark.createDataFrame([("revision", "r", "directory", "d")] * 2, "source_type string, source string, target_type string, target string")
    day = datetime.date(2024, 5, 1)
    added = references.object_references_add(new, None, day)
    assert added.count() == 1 and added.first().iso_week == 18
    assert references.object_references_add(new, added, day).count() == 0
    assert references.object_references_add(new, added, datetime.date(2024, 5, 2)).count() == 1
    with pytest.raises(ArgumentError):
        references.object_references_add(new, None, day, {(2024, 17)})


def test_counters(spark):
    df = spark.range(50).selectExpr("cast(id as string) id")
    counted = lifecycle.bucketed_counters(df, "id", 8)
    assert sum(r.value for r in counted.collect()) == 50
    empty = spark.createDataFrame([(0, None, None), (1, 3, 5)], "bucket int, value long, updated int")
    again = lifecycle.refresh_bucket(empty, df, "id", 2, 9).orderBy("bucket").collect()
    assert again[0].updated == 9 and again[0].value > 0 and tuple(again[1]) == (1, 3, 5)
    typed = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "object_type string, value long")
    assert rows(lifecycle.roll_up(typed)) == [("a", 3)]
    ranges = lifecycle.byte_ranges(4, "3", "a")
    assert ranges[0] == ("3", "40") and ranges[-1] == ("90", "a") and all(x[1] == y[0] for x, y in zip(ranges, ranges[1:], strict=False))


def test_extids_need_type_and_version_together(spark):
    with pytest.raises(ArgumentError):
        metadata.extid_get_from_target(spark.range(1), spark.range(1), extid_type="x")


def test_migration_routes(spark):
    docs = [
        ("1", '{"extrinsic": {"provider": "https://registry.npmjs.org/@s/p", "raw": {"k": 1}, "when": "2020-01-02T00:00:00Z"}}'),
        ("2", '{"extrinsic": {"provider": "https://pypi.org/pypi/pkg/json", "raw": {}}, "original_artifact": [{"name": "p.tgz", "size": 3, "sha1": "aa", "date": "x"}]}'),
        ("3", '{"package_source": {"url": "https://registry.npmjs.org/q", "filename": "q.tgz"}, "package": {"v": 1}}'), ("4", '{"odd": 1}'), ("5", None),
    ]
    revs = spark.createDataFrame(docs, "id string, metadata string").withColumn("date", __import__("pyspark.sql.functions", fromlist=["x"]).lit("2019-01-01").cast("timestamp"))
    good, bad = migration.migrate_revision_metadata(revs)
    got = {r.id: (r.provider, r.origin, r.payload) for r in good.collect()}
    assert got["1"] == ("npm", "https://www.npmjs.com/package/@s/p", '{"k":1}') and got["2"][:2] == ("pypi", "https://pypi.org/project/pkg/")
    assert got["3"][0] == "npm" and [r.id for r in bad.collect()] == ["4"]
    assert migration.migrate_revision_metadata(revs, after="1")[0].count() == 2
    one, two = migration.original_artifacts(revs).orderBy("id").collect()
    assert two.id == "3" and two.artifacts[0].filename == "q.tgz" and one.unknown is None
    assert one.id == "2" and one.artifacts[0].filename == "p.tgz" and one.artifacts[0].length == 3 and one.artifacts[0].checksums == {"sha1": "aa"}


def test_pipelines_from_config(spark):
    known = {"add": lambda n: lambda df: df.selectExpr(f"id + {n} as id"), "keep": lambda where: lambda df: df.where(where)}
    run = pipeline.build([{"cls": "add", "n": 5}, {"cls": "keep", "where": "id > 6"}], known)
    assert [r.id for r in run(spark.range(4)).collect()] == [7, 8]
    with pytest.raises(ArgumentError):
        pipeline.build([{"cls": "cache"}], known)


def test_counts_are_observed_without_a_job(spark):
    df, seen = lifecycle.observed(spark.range(7), "added", "id")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 7, "bytes": 21}


def test_content_find_directory_raises_where_roots_are_too_far(spark):
    entries = spark.createDataFrame([(f"d{i}", f"n{i}", "dir", f"d{i + 1}", 0) for i in range(4)] + [("d4", "f", "file", "c", 0)], ENTRY)
    ids = spark.createDataFrame([("c",)], "id string")
    assert [tuple(r) for r in content.content_find_directory(ids, entries, max_depth=5).collect()] == [("c", "d0", "n0/n1/n2/n3/f")]
    with pytest.raises(RecursionError):
        content.content_find_directory(ids, entries, max_depth=4)


def test_rows_are_numbered_over_all_tasks(spark):
    df = spark.range(300).selectExpr("id", "id % 7 as k", "cast(id % 3 as int) as size").repartition(5)
    got = paging.numbered(df, ["k", "id"], total="size").orderBy("_at").collect()
    assert [r["_at"] for r in got] == list(range(300)) and [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)
    assert [r["_at_sum"] for r in got] == [sum(x.size for x in got[:i]) for i in range(300)]
    assert paging.numbered(df.limit(0), ["id"]).count() == 0


def test_adds_keep_the_same_row_whatever_the_order(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (None, "z"), (None, "y"), (2, None)], "id int, x string")
    for n in (1, 4):
        assert sorted(map(tuple, content.first_rows(df.repartition(n), ["id"]).collect()), key=str) == [(1, "a"), (2, None), (None, "y")]
    table = spark.createDataFrame([("s", 0)], "sha1 string, status int")
    updates = spark.createDataFrame([("s", 1), ("s", 3), ("s", 2)], "sha1 string, status int")
    assert content.content_update(table, updates, ["status"]).first().status == 3


def test_collisions_are_added_counted_and_named(spark):
    from quarry.errors import HashCollision

    schema = "sha1 string, sha1_git string, sha256 string, length int"
    old = spark.createDataFrame([("a", "b", "c", 1), ("k", "k", "k", 1)], schema)
    new = spark.createDataFrame([("a", "x", "y", 2), ("n", "n", "n", 3), ("k", "k", "k", 1), ("p", "q", "r", 4), ("o", "q", "z", 5)], schema)
    rows_, summary = content.content_add(new, old)
    assert sorted(r.sha1 for r in rows_.collect()) == ["a", "n", "o", "p"]
    assert tuple(summary.first()) == (4, 14, 3)
    assert sorted((r.sha1, r.algo, r.hash) for r in content.collisions(new, old).collect()) == [("a", "sha1", "a"), ("o", "sha1_git", "q"), ("p", "sha1_git", "q")]
    with pytest.raises(HashCollision) as error:
        content.content_add(new, old, on_collision="raise")
    assert sorted(error.value.hashes) == [("sha1", "a"), ("sha1_git", "q")]
    assert content.content_add(old, old, on_collision="raise")[0].count() == 0


def test_iteration_skips_what_is_below_a_path(spark):
    entries = spark.createDataFrame([("r", "a", "dir", "A", 0), ("r", "b", "file", "f", 0), ("A", "x", "dir", "X", 0), ("X", "y", "file", "g", 0)], "directory_id string, name string, type string, target string, perms int")
    root = spark.createDataFrame([("r",)], "root string")
    assert [(r.path, r.ord) for r in directory.directory_iterate(root, entries).orderBy("ord").collect()] == [("a", 1), ("a/x", 2), ("a/x/y", 3), ("b", 4)]
    skip = spark.createDataFrame([("r", "a/x")], "root string, path string")
    assert [(r.path, r.ord) for r in directory.directory_iterate(root, entries, skip).orderBy("ord").collect()] == [("a", 1), ("a/x", 2), ("b", 3)]


def test_prefixes_are_excluded_as_ranges(spark):
    names = ["", "a", "ab", "ab\uffff", "ab\U0010ffff", "abc", "ac", "b", "é", "\ud7ff", "\ud7ffx", "\ue000"]
    df = spark.createDataFrame([("s", n, None, None) for n in names], "snapshot_id string, name string, target_type string, target string")
    for prefix in ("ab", "a", "\ud7ff", "é", ""):
        assert sorted(r.name for r in snapshot.snapshot_branches(df, exclude_prefix=prefix).collect()) == sorted(n for n in names if not n.startswith(prefix))
    assert snapshot.after_prefix(b"a\xff\xff") == b"b" and snapshot.after_prefix(b"\xff") is None and snapshot.after_prefix("a\U0010ffff") == "b"
