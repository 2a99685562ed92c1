import re
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quarry.llm import common, nearcopies


def test_stages_send_workers_small_batches(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    at = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([batch.nbytes], pa.int64())], names=["n", "b"])

    rows = spark.range(0, 3000, numPartitions=1).selectExpr("repeat('x', if(id < 100, 1000000, 9))")
    for _, stage in corpus_pipeline.STAGES:
        for key in common._BATCHES:
            spark.conf.unset(key)
        stage(spark, spark.read.parquet(f"{at}/documents.parquet"), at)
        got = rows.mapInArrow(sizes, "n long, b long").collect()
        assert sum(r.n for r in got) == 3000 and max(r.n for r in got) <= 1000 and max(r.b for r in got) < 12_000_000
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")  # what the user sets holds
    common.small_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "70"
    for key in common._BATCHES:
        spark.conf.unset(key)


@pytest.mark.skipif(not common._trim, reason="no malloc_trim")
def test_lean_work_gives_memory_back():
    def anonymous():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1024

    held = []

    def work(batches):
        for batch in batches:
            many = [bytes(2000) for _ in range(100_000)]
            held.append(many[-1])  # keeps the heap from shrinking by itself
            del many
            yield batch

    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["a"])
    before = anonymous()
    assert list(common.lean(work)([batch, batch])) == [batch, batch]
    assert anonymous() < before + 60
    assert sys.getsizeof(held[0]) > 2000


def test_large_groups_meet_in_little_memory():
    rng = np.random.default_rng(1)
    common_ = rng.integers(0, 1 << 60, 190).astype(np.uint64)
    sets = [np.unique(np.concatenate([common_, rng.integers(0, 1 << 60, 10).astype(np.uint64)])) for _ in range(1024)]
    tracemalloc.start()
    i, _ = nearcopies._joined_in(sets, sets, 0.8)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(i) == 1024 * 1024
    assert most < 52 << 20, most >> 20
