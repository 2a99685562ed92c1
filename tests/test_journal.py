import pytest
from pyspark.sql import functions as F

from quarry.errors import ArgumentError
from quarry.schemas import TABLES
from quarry.sources.store import Archive, read_blobs
from quarry.streaming import journal

H = lambda c: c.encode() * 20


def filled(spark, path):
    archive = Archive(spark, path)
    archive.append("origin", spark.createDataFrame([("http://o", H("o"))], TABLES["origin"]))
    archive.append("content", spark.createDataFrame([(H("a"), H("b"), b"c" * 32, b"d" * 32, 3, "visible", None)], TABLES["content"]))
    archive.append("revision_parent", spark.createDataFrame([(H("r"), 0, H("q")), (H("r"), 1, H("p"))], TABLES["revision_parent"]))
    return archive


def same(a, b, table):
    return sorted(map(str, a.read(table).collect())) == sorted(map(str, b.read(table).collect()))


def test_backfill_and_replay_twice(spark, tmp_path):
    old = filled(spark, f"file://{tmp_path}/old")
    journal.backfill(old, f"file://{tmp_path}/log")
    journal.write_log(spark.createDataFrame([("origin_visit", "{}", '{"origin": "http://new", "visit": 4, "type": "git"}'), ("origin", "{}", "no json")], "object_type string, key string, value string"), f"file://{tmp_path}/log")
    new, reported = Archive(spark, f"file://{tmp_path}/new"), []
    for run in ("one", "two"):
        journal.replay(new, f"file://{tmp_path}/log", f"file://{tmp_path}/{run}", max_files=3, report=lambda t, bad: reported.append((t, bad.count()))).awaitTermination()
        assert all(same(old, new, t) for t in ("content", "revision_parent"))
        assert sorted(r.url for r in new.read("origin").collect()) == ["http://new", "http://o"]
        assert new.read("origin_visit").count() == 1
    assert sum(n for t, n in reported if t == "origin") == 2


def test_versions_replace_whole_tables(spark, tmp_path):
    archive = filled(spark, f"file://{tmp_path}/a")
    assert archive.check_config() and archive.check_config(check_write=True) and not Archive(spark, f"file://{tmp_path}/none").check_config()
    rows = archive.read("revision_parent")
    archive.replace("revision_parent", rows.where("parent_rank = 0"))
    assert archive.read("revision_parent").count() == 1 and len(archive.versions("revision_parent")) == 2
    assert archive.read("release").count() == 0
    with pytest.raises(ArgumentError):
        archive.read("nothing")
    archive.append("extid", spark.createDataFrame([("t", b"e", 0, "content", H("c"))], TABLES["extid"]))
    assert [f.dataType for f in archive.read("extid").schema] == [f.dataType for f in TABLES["extid"]]


def test_collisions_stay_out_of_a_replay(spark, tmp_path):
    archive = filled(spark, f"file://{tmp_path}/a")
    clash = spark.createDataFrame([(H("a"), H("x"), b"y" * 32, b"z" * 32, 3, "visible", None), (H("n"), H("n"), b"n" * 32, b"n" * 32, 3, "visible", None)], TABLES["content"])
    reported = []
    journal.insert_new(archive, "content", clash, lambda t, rows: reported.append((t, [(r.algo, bytes(r.hash)) for r in rows.collect()])))
    assert archive.read("content").count() == 2 and reported == [("content_collision", [("sha1", H("a"))])]
    other = spark.createDataFrame([(H("e"), H("f"), b"c" * 32, b"g" * 32, 3, "visible", None)], TABLES["content"])
    journal.insert_new(archive, "content", other, lambda t, rows: reported.append((t, [(r.algo, bytes(r.hash)) for r in rows.collect()])))
    assert archive.read("content").count() == 2 and reported[-1] == ("content_collision", [("sha256", b"c" * 32)])
    again = archive.read("content")
    journal.insert_new(archive, "content", again, lambda t, rows: reported.append(rows.count()))
    assert reported[-1] == 0 and archive.read("content").count() == 2


def test_repeated_names_of_a_directory_survive_a_replay(spark, tmp_path):
    from quarry.operators.directory import directory_get_many

    archive = Archive(spark, f"file://{tmp_path}/a")
    archive.append("directory", spark.createDataFrame([(H("d"), None)], TABLES["directory"]))
    archive.append("directory_entry", spark.createDataFrame([(H("d"), b"n", "file", H("x"), 1), (H("d"), b"n", "file", H("y"), 1)], TABLES["directory_entry"]))
    journal.backfill(archive, f"file://{tmp_path}/log")
    new = Archive(spark, f"file://{tmp_path}/new")
    journal.replay(new, f"file://{tmp_path}/log", f"file://{tmp_path}/c").awaitTermination()
    assert [r.is_corrupt for r in directory_get_many(new.read("directory").select("id"), new.read("directory"), new.read("directory_entry")).collect()] == [True]


def test_bad_rows_are_set_aside_until_there_are_too_many(spark):
    df = spark.range(10).selectExpr("id", "if(id = 3, null, id < 8) as ok")
    good, bad = journal.tenacious(df, F.col("ok"), 0.5)
    assert (good.count(), bad.count()) == (7, 3)
    with pytest.raises(ArgumentError):
        journal.tenacious(df, F.col("ok"), 0.1)
    late = spark.range(100).selectExpr("id", "id < 90 as ok")
    assert journal.tenacious(late, F.col("ok"), 0.5)[1].count() == 10
    with pytest.raises(ArgumentError):
        journal.tenacious(late, F.col("ok"), 0.5, ["id"], 10)
    assert journal.tenacious(late, F.col("ok"), 0.5, ["id"], 40)[0].count() == 90
    counts = journal.error_counts(late.withColumn("object_type", F.lit("x")), F.col("ok")).first()
    assert tuple(counts) == ("x", 90, 10)


def test_retries():
    tries = []

    def shaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "done"

    assert journal.with_retries(shaky, wait=0) == "done" and len(tries) == 3
    tries.clear()
    assert journal.with_retries(shaky, wait=0, busy=lambda e: isinstance(e, OSError), busy_wait=0.01) == "done"
    with pytest.raises(OSError):
        journal.with_retries(lambda: (_ for _ in ()).throw(OSError()), wait=0)
    with pytest.raises(ArgumentError):
        journal.with_retries(lambda: (_ for _ in ()).throw(ArgumentError()), wait=0)


def test_blobs_from_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "f").write_bytes(b"abc")
    assert [(r.length, bytes(r.data)) for r in read_blobs(spark, f"file://{tmp_path}").collect()] == [(3, b"abc")]


def test_contents_come_with_their_bytes(spark, tmp_path):
    import hashlib

    archive = Archive(spark, f"file://{tmp_path}/a")

    def hashed(data, real=None):
        own = real or data
        sha1 = lambda b: hashlib.sha1(b).digest()
        return sha1(own), sha1(b"blob %d\0" % len(own) + own), hashlib.sha256(own).digest(), hashlib.blake2s(own).digest(), len(data), "visible", None, data

    schema = TABLES["content"].fields + TABLES["content_data"].fields[1:]
    new = spark.createDataFrame([hashed(b"one"), hashed(b"one"), hashed(b"two!"), hashed(b"bad", b"dab")], type(TABLES["content"])(schema))
    assert journal.ingest_contents(archive, new, f"file://{tmp_path}/log") == {"content:add": 2, "content:add:bytes": 7, "content:add:collision": 0}
    assert journal.ingest_contents(archive, new, f"file://{tmp_path}/log") == {"content:add": 0, "content:add:bytes": 0, "content:add:collision": 0}
    assert sorted(bytes(r.data) for r in archive.read("content_data").collect()) == [b"one", b"two!"]
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 2


def test_reference_weeks_open_and_close(spark, tmp_path):
    import datetime

    from quarry.operators import references
    from quarry.sources.store import ReferenceWeeks

    weeks = ReferenceWeeks(spark, f"file://{tmp_path}/refs")
    assert weeks.list() == []
    weeks.create([(2024, 18), (2024, 19)])
    new = spark.createDataFrame([("revision", b"r", "directory", b"d")], "source_type string, source binary, target_type string, target binary")
    weeks.append(references.object_references_add(new, None, datetime.date(2024, 5, 1), set(weeks.list())))
    assert weeks.list() == [(2024, 18), (2024, 19)] and weeks.read().where("iso_week = 18").count() == 1
    weeks.drop([(2024, 18)])
    assert weeks.list() == [(2024, 19)]


def test_buffers_flush_by_count_and_size(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate([1, 1, 1, 9, 1, 1])] + [("b", 0, 1)], "k string, n int, size int")
    got = {(r.k, r.n): r.batch for r in journal.buffer_batches(df, "k", "n", 4, "size", 10).collect()}
    # the fifth row ends the rows of a batch and passes ten of size at once
    assert [got["a", i] for i in range(6)] == [0, 0, 0, 0, 2, 2] and got["b", 0] == 0
    by_type = journal.buffer_batches(df, "k", "n", {"a": 2, None: 9}).collect()
    assert {(r.k, r.n): r.batch for r in by_type} == {("a", i): i // 2 for i in range(6)} | {("b", 0): 0}
