import collections

from quarry.llm import sharding


def rows(n):
    return [(i if i % 50 else None, None if i % 7 == 0 else "same" if i % 3 == 0 else f"text {i} é" * (i % 5), i, "x") for i in range(n)]


def test_every_row_once_evenly_and_without_gaps(spark):
    docs = spark.createDataFrame(rows(1003), "doc_id long, text string, n int, shard string")
    got = sharding.shuffle_into_shards(docs, shards=24, bucket_bytes=500).collect()
    assert sorted(r.n for r in got) == list(range(1003))
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(24))
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert all((r.doc_id, r.text) == rows(1003)[r.n][:2] for r in got)


def test_order_is_fixed_by_seed_and_mixed(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "cast(id as string) text")

    def places(seed, frame=docs):
        got = sharding.shuffle_into_shards(frame, 5, seed, bucket_bytes=20_000).collect()
        return {r.doc_id: (r.shard, r.slot) for r in got}

    assert places(1) == places(1) == places(1, docs.repartition(3)) != places(2)
    mean = sum(shard * 800 + slot for d, (shard, slot) in places(1).items() if d < 1000) / 1000
    assert abs(mean - 2000) < 150


def test_fewer_rows_than_shards_and_none(spark):
    few = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    got = sharding.shuffle_into_shards(few, shards=24).collect()
    assert len(got) == 3 and len({r.shard for r in got}) == 3 and {r.slot for r in got} == {0}
    assert sharding.shuffle_into_shards(few.limit(0)).count() == 0


def test_plan_is_native_and_writes_shuffled_files(spark, tmp_path):
    docs = spark.createDataFrame(rows(300), "doc_id long, text string, n int, shard string")
    found = sharding.shuffle_into_shards(docs, shards=3)
    assert not [x for x in ("Python", "Pandas", "Arrow") if x in found._jdf.queryExecution().executedPlan().toString()]
    sharding.write_shards(found, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 300 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2}


def test_rows_that_repeat_beyond_a_bucket_are_split(spark):
    rows = [(1, "hot", 0, "x")] * 700 + [(1, "hot", 1, "x")] * 60 + [(None, None, 2, None)] * 90 + [(i, f"t{i}", 3, "x") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, shard string")
    found = sharding.shuffle_into_shards(docs, shards=5, bucket_bytes=300)
    got = found.collect()
    assert collections.Counter((r.doc_id, r.text, r.n) for r in got) == collections.Counter((a, b, c) for a, b, c, _ in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in v) == list(range(250)) for v in by.values())
    assert all(110 < sum(r.text == "hot" for r in v) < 200 for v in by.values())
    assert not [x for x in ("Python", "Pandas", "Arrow") if x in found._jdf.queryExecution().executedPlan().toString()]
