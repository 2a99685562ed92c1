import math
from collections import Counter

import numpy as np
import pytest

from quarry.llm import decontam, importance


def slow_counts(hasher, text):
    own = decontam.words(text or "")
    single = [h for w in own for h in importance.shingle_hashes(hasher.hashes([w])[0], 1).tolist()]
    pairs = [importance.shingle_hashes(hasher.hashes([f"{a} {b}"])[0], 2).tolist()[0] for a, b in zip(own, own[1:], strict=False)]
    return Counter(h >> 49 for h in single + pairs)


ROWS = [(i, f"good prose number {i} flows on" if i % 2 else f"junk junk {i} !!! buy buy now", "x") for i in range(60)] + [(100, None, "x"), (101, "", None), (None, "good prose flows", "x"), (3, "good prose number 3 flows on", "x")]


def test_weights_equal_counting_by_hand(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, rank string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 40)] + [(None, 1), (1, 1)], "doc_id long, quality int")
    hasher = decontam.WordHasher()
    target = {i for i in range(40) if i % 2}
    raw, aim = Counter(), Counter()
    for i, text, _ in ROWS:
        own = slow_counts(hasher, text)
        raw += own
        aim += own if i in target else Counter()
    size = importance.BUCKETS
    share = {b: (raw[b] + 1) / (sum(raw.values()) + size) for b in raw}
    ratio = {b: math.log((aim[b] + 100 * share[b]) / (sum(aim.values()) + 100)) - math.log(share[b]) for b in raw}
    got = importance.resample(docs, labels).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    for i, text, _ in ROWS:
        own = slow_counts(hasher, text)
        assert by[i].features == sum(own.values())
        assert by[i].log_weight == pytest.approx(sum(n * ratio[b] for b, n in own.items()))
    keys = [r.key for r in sorted(got, key=lambda r: r["rank"])]
    assert sorted(r["rank"] for r in got) == list(range(1, len(ROWS) + 1)) and keys == sorted(keys, reverse=True)
    assert sum(r.selected for r in got) == len(ROWS) // 2 and all(r.selected == (r["rank"] <= len(ROWS) // 2) for r in got)
    mine = [r for r in got if r.doc_id is not None and r.doc_id < 60]
    assert min(r.log_weight for r in mine if r.doc_id % 2) > max(r.log_weight for r in mine if not r.doc_id % 2)


def test_gumbel_noise_has_its_distribution(spark):
    docs = spark.range(20000).selectExpr("id doc_id", "'' text")
    noise = np.array([r.key for r in importance.log_weights(docs, np.zeros(importance.BUCKETS)).collect()])
    assert abs(noise.mean() - 0.5772) < 0.05 and abs(noise.std() - math.pi / math.sqrt(6)) < 0.05


def test_empty_tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, rank string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert importance.resample(docs.limit(0), labels).count() == 0
    assert all(abs(r.log_weight) < 1e-9 for r in importance.resample(docs, labels.limit(0)).collect())
