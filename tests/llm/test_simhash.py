import itertools
import random

import numpy as np
import pytest
import xxhash

from quarry.llm import simhash
from quarry.llm.common import connected_components


def classes(nodes, edges):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    out = {}
    for n in nodes:
        out.setdefault(root(n), set()).add(n)
    return {frozenset(x) for x in out.values()}


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "ONE two", "a b c d", "Ünï  C\tD\ne f g h", "x y " * 500])
def test_fingerprint_is_the_majority_of_shingle_hashes(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_long_texts_are_counted_in_blocks(monkeypatch):
    text = " ".join(str(i * i % 97) for i in range(300))
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("n", [3, 5, 7])
def test_home_anchor_reaches_all_within_two_bits(n):
    rng, code = random.Random(n), simhash.CoveringCode(n)
    for _ in range(40):
        x = rng.getrandbits(64)
        near = [x] + [x ^ 1 << i ^ 1 << j for i, j in itertools.combinations_with_replacement(range(64), 2)]
        near += [x ^ 1 << i for i in range(64)]
        fps = np.array(near, np.uint64)
        row, anchor = code.replicas(fps)
        home = int(code.home(fps[:1])[0])
        reached = set(row[anchor == home]) | set(np.flatnonzero(code.home(fps) == home))
        assert reached == set(range(len(near)))


def planted(seed, groups=40, size=12):
    rng, out = random.Random(seed), {0, (1 << 64) - 1}
    for _ in range(groups):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, size)):
            out.add(x)
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
    return sorted(out)


@pytest.mark.parametrize(("code", "hot"), [(None, 4096), (3, 2), (5, 1), (7, 3)])
def test_near_pairs_span_what_brute_force_links(spark, code, hot):
    fps = planted(hot)
    want = classes(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2])
    signed = [(int(np.uint64(x).view(np.int64)),) for x in fps]
    got = simhash.near_pairs(spark.createDataFrame(signed, "fp long"), hot=hot, code=code).collect()
    edges = [(r.a % 2**64, r.b % 2**64) for r in got]
    assert all((a ^ b).bit_count() < 64 for a, b in edges)
    assert classes(fps, edges) == want


def test_dense_group_gives_few_edges(spark):
    fps = [(1 << a | 1 << b,) for a, b in itertools.combinations_with_replacement(range(40), 2)]
    got = simhash.near_pairs(spark.createDataFrame(fps, "fp long"), hot=50).collect()
    assert len(classes([f[0] for f in fps], [(r.a, r.b) for r in got])) == 1
    assert len(got) < 40 * len(fps)


def test_streamed_group_keeps_its_homes():
    fps = np.array(planted(5, 3, 30), np.uint64)
    home = np.arange(len(fps)) % 2 == 0
    a, b = simhash._links(np.zeros(len(fps), int), fps, home, 2, most=3)
    pairs = [(x, y) for x, y in itertools.combinations(range(len(fps)), 2) if home[x] or home[y]]
    want = [(int(fps[x]), int(fps[y])) for x, y in pairs if int(fps[x] ^ fps[y]).bit_count() <= 2]
    nodes = [int(f) for f in fps]
    assert classes(nodes, zip(a.tolist(), b.tolist(), strict=True)) == classes(nodes, want)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 560)] + [(900, 900), (700, 699), (699, 700)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(101)} | {i: 500 for i in range(500, 560)} | {699: 699, 700: 699}
    assert got == want


def test_near_duplicates_of_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [(7, text, "x"), (3, text, None), (3, text, None), (None, text, "y"), (9, "", "x"), (8, None, "x"), (5, " \n", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or -1, r.component_id, r.fp) for r in simhash.near_duplicates(docs).collect())
    fp = int(np.uint64(slow_fingerprint(text)).view(np.int64))
    assert got == sorted([(7, 3, fp), (3, 3, fp), (3, 3, fp), (-1, 3, fp), (9, 5, 0), (8, 5, 0), (5, 5, 0)])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(nulls).collect()] == [None, None]
