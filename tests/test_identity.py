import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.functions import identity, text


def test_git_ids_of_known_objects(spark):
    rows = spark.createDataFrame([(b"hello\n",), (b"",), (b"\xc3\x00\xff",)], "data binary")
    got = [tuple(r) for r in rows.select(*identity.content_hashes("data").values()).collect()]
    assert got[0][1] == "ce013625030ba8dba906f756967f9e9ca394464a" and got[1][1] == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"
    for (data,), r in zip([(b"hello\n",), (b"",), (b"\xc3\x00\xff",)], got, strict=True):
        assert r == (hashlib.sha1(data).hexdigest(), hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest(), hashlib.sha256(data).hexdigest(), hashlib.blake2s(data).hexdigest())


def test_empty_tree_and_snapshot():
    assert identity.object_id("directory", {"entries": []}).hex() == "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
    assert identity.object_id("snapshot", {"branches": []}).hex() == "1a8893e6a86f444e8be8e7bda6cb34fb1735a00e"


def test_directories_sort_as_if_their_names_ended_in_a_slash():
    entry = lambda n, t: {"name": n, "type": t, "perms": 0o40000 if t == "dir" else 0o100644, "target": b"\1" * 20}
    got = identity.directory_manifest([entry(b"a", "dir"), entry(b"a.c", "file"), entry(b"a0", "file")])
    assert [got.index(b" a.c\0"), got.index(b" a\0"), got.index(b" a0\0")] == sorted([got.index(b" a.c\0"), got.index(b" a\0"), got.index(b" a0\0")])
    assert got.startswith(b"100644 a.c\0") and b"40000 a\0" in got


def test_commit_and_tag_text():
    who = {"fullname": b"A U Thor <a@x>"}
    when = {"seconds": 1112911993, "microseconds": 0, "offset_bytes": b"-0700"}
    rev = {"directory": bytes(20), "parents": [b"\1" * 20], "author": who, "date": when, "committer": who, "committer_date": when | {"microseconds": 500000}, "extra_headers": [(b"k", b"a\nb")], "message": b"hi\n"}
    assert identity.revision_manifest(rev) == (
        b"tree " + b"0" * 40 + b"\nparent " + b"01" * 20 + b"\nauthor A U Thor <a@x> 1112911993 -0700\ncommitter A U Thor <a@x> 1112911993.5 -0700\nk a\n b\n\nhi\n"
    )
    assert identity.release_manifest({"target": bytes(20), "target_type": "revision", "name": b"v1", "author": None, "message": None}) == b"object " + b"0" * 40 + b"\ntype commit\ntag v1\n"
    assert identity.object_id("revision", rev | {"raw_manifest": b"x"}) == hashlib.sha1(b"commit 1\0x").digest()


def test_identifiers_go_both_ways(spark):
    rows = spark.createDataFrame([("content", "ab" * 20), ("revision", "CD" * 20), ("nothing", "00" * 20)], "kind string, id string")
    got = rows.withColumn("i", identity.identifier(F.col("kind"), F.col("id"))).withColumn("p", identity.parse_identifier(F.col("i"))).collect()
    assert [r.i for r in got] == ["obj:1:cnt:" + "ab" * 20, "obj:1:rev:" + "cd" * 20, None]
    assert [r.p and tuple(r.p) for r in got] == [("content", "ab" * 20), ("revision", "cd" * 20), None]
    with pytest.raises(Exception, match="not a plain identifier"):
        rows.select(identity.parse_identifier(F.lit("obj:1:cnt:" + "ab" * 20 + ";origin=x"))).collect()


def test_persons(spark):
    rows = spark.createDataFrame([("A B <a@b>",), ("only name",), ("<e@f>",), ("x <",), (None,), ("N <>",)], "f string")
    got = [tuple(r[0]) for r in rows.select(text.parse_person(F.col("f"))).collect()]
    assert [g[1:] for g in got] == [("A B", "a@b"), ("only name", None), (None, "e@f"), ("x", None), (None, None), ("N", None)]


def test_url_candidates(spark):
    urls = ["https://h.org/a/b.git/", "https://h.org/a/b", "https://h.org", "http://h/x.svn"]
    got = [set(r[0]) for r in spark.createDataFrame([(u,) for u in urls], "u string").select(text.url_candidates(F.col("u"))).collect()]
    assert got == [
        {"https://h.org/a/b.git/", "https://h.org/a/b.git", "https://h.org/a/b", "https://h.org/a", "https://h.org"},
        {"https://h.org/a/b", "https://h.org/a", "https://h.org"}, {"https://h.org"}, {"http://h/x.svn", "http://h/x", "http://h"},
    ]


def test_objects_are_checked_against_their_ids(spark):
    entry = (b"f", "file", bytes(20), 0o100644)
    good = identity.object_id("directory", {"entries": [dict(zip(("name", "type", "target", "perms"), entry, strict=True))]})
    rows = [(good, None, [entry]), (bytes(20), None, [entry]), (hashlib.sha1(b"tree 1\0x").digest(), b"x", [entry]), (good, None, [(None, "file", bytes(20), 1)])]
    df = spark.createDataFrame(rows, "id binary, raw_manifest binary, entries array<struct<name binary, type string, target binary, perms int>>")
    assert [r.valid for r in identity.validate_objects("directory", df).collect()] == [True, False, True, False]


def test_manifests_by_built_in_functions_equal_those_by_bytes(spark):
    import random

    rng = random.Random(3)
    name = lambda: bytes(rng.choice(b"ab./\xff\0") for _ in range(rng.randrange(1, 5)))
    trees, refs = [], []
    for _ in range(30):
        names = sorted({name() for _ in range(rng.randrange(9))}, key=lambda _: rng.random())
        entries = [{"name": n, "type": rng.choice(["file", "dir", "rev"]), "target": rng.randbytes(20), "perms": rng.choice([0o100644, 0o40000, 0, 7])} for n in names]
        trees.append((identity.object_id("directory", {"entries": entries}), entries, None))
        branches = [{"name": n, "target_type": t, "target": None if t is None else rng.randbytes(rng.choice([0, 3, 20]))} for n in names for t in [rng.choice(["revision", "alias", None])]]
        refs.append((identity.object_id("snapshot", {"branches": branches}), branches))
    trees += [(b"x" * 20, [], None), (None, [], None), (identity.object_id("directory", {"raw_manifest": b"as it was"}), [], b"as it was"), (b"y" * 20, [{"name": None, "type": "dir", "target": b"", "perms": 1}], None)]
    df = spark.createDataFrame(trees, "id binary, entries array<struct<name binary, type string, target binary, perms int>>, raw_manifest binary")
    assert [r.valid for r in identity.validate_objects("directory", df).collect()] == [True] * 30 + [False, False, True, False]
    df = spark.createDataFrame([*refs, (b"z" * 20, None)], "id binary, branches array<struct<name binary, target_type string, target binary>>")
    assert [r.valid for r in identity.validate_objects("snapshot", df).collect()] == [True] * 30 + [False]


def test_commits_are_checked_in_batches(spark):
    rev = {"directory": b"d" * 20, "parents": [b"p" * 20], "author": None, "date": None, "committer": None, "committer_date": None, "extra_headers": [[b"k", b"v"]], "message": b"m", "raw_manifest": None}
    good = identity.object_id("revision", rev)
    schema = "id binary, directory binary, parents array<binary>, author struct<fullname:binary>, date struct<seconds:long>, committer struct<fullname:binary>, committer_date struct<seconds:long>, extra_headers array<array<binary>>, message binary, raw_manifest binary"
    df = spark.createDataFrame([(good, *rev.values()), (b"no" * 10, *rev.values()), (good, None, *list(rev.values())[1:])], schema)
    assert [r.valid for r in identity.validate_objects("revision", df).collect()] == [True, False, False]
