import random

import numpy as np
import pytest

from quarry.llm import hamming

SCHEMA = "id long, code array<long>"


def slow(rows, queries, k):
    def far(a, b):
        return sum(((x ^ y) % 2**64).bit_count() for x, y in zip(a, b, strict=True))

    out, rows = [], {(i, tuple(c)) for i, c in rows}
    for q, code in {(i, tuple(c)) for i, c in queries}:
        near = sorted((far(code, c), i) for i, c in rows if i != q)
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near[:k])]
    return sorted(out)


def clustered(seed, n, words):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64 * words) for _ in range(5)]
    rows = []
    for i in range(n):
        x = centres[0] if i % 3 == 0 else rng.choice(centres)
        for _ in range(0 if i % 3 == 0 else rng.choice([0, 1, 3, 12, 30])):
            x ^= 1 << rng.randrange(64 * words)
        rows.append((i, [int(np.uint64(x >> 64 * w & (2**64 - 1)).view(np.int64)) for w in range(words)]))
    return rows


@pytest.mark.parametrize(("n", "k", "words", "width", "bucket", "chunk"), [(400, 10, 1, None, 1 << 15, 1 << 18), (300, 3, 3, 16, 20, 30), (6, 10, 1, 8, 4, 2), (1, 2, 1, None, 4, 4)])
def test_equals_brute_force(spark, n, k, words, width, bucket, chunk):
    rows = clustered(n, n, words)
    queries = [r for r in rows if r[0] % 7 == 0]
    frame = spark.createDataFrame(rows + rows[:3], SCHEMA)
    asked = spark.createDataFrame(queries + queries[:1], SCHEMA)
    got = hamming.hamming_top_k(frame, asked, k, width, bucket, chunk).collect()
    assert sorted(map(tuple, got)) == slow(rows, queries, k)


@pytest.mark.parametrize("radius", [0, 1, 2, 6])
def test_bucket_finds_all_at_a_radius(radius):
    rng = np.random.default_rng(radius)
    codes = rng.integers(0, 2**63, (500, 2), np.uint64)
    rest = codes[:, 1] & np.uint64(1023)
    bucket = hamming.Bucket(codes, np.arange(500), rest, 10)
    queries = codes[:40] ^ np.uint64(0b101)
    q, c, d = bucket.nearest(queries, queries[:, 1] & np.uint64(1023), radius, 7, most=50)
    for k, code in enumerate(queries):
        distance = np.bitwise_count(codes ^ code).sum(axis=1)
        near = np.flatnonzero(np.bitwise_count(rest ^ (code[1] & np.uint64(1023))) == radius)
        want = near[np.lexsort((near, distance[near]))][:7]
        assert bucket.tie[c[q == k]].tolist() == want.tolist() and d[q == k].tolist() == distance[want].tolist()


def test_sign_codes_of_odd_vectors(spark):
    rows = [(1, [1.0, -1.0, 2.0]), (2, [0.0] * 63 + [1.0]), (3, None), (None, [1.0]), (4, []), (5, [None, 1.0]), (6, [-1.0] * 69 + [1.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, v array<float>, code string")
    got = {r.id: r.code for r in hamming.sign_codes(frame, "vec_id", "v").collect()}
    assert got == {1: [5, 0], 2: [-(2**63), 0], 4: [0, 0], 5: [2, 0], 6: [0, 32]}
    empty = spark.createDataFrame([], SCHEMA)
    assert hamming.hamming_top_k(empty, empty).count() == 0
