import itertools
import random

import pytest

from quarry.llm import nearcopies


def brute_jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def brute_groups(texts, least=0.8):
    up = list(range(len(texts)))

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for i, j in itertools.combinations(range(len(texts)), 2):
        if brute_jaccard(texts[i], texts[j]) >= least:
            x, y = sorted((root(i), root(j)))
            up[y] = x
    return [root(i) for i in range(len(texts))]


def corpus(seed, groups=25, most=8):
    """Texts of 20 to 200 words and copies of copies with some words changed: similarities on both sides of 0.8."""
    rng, out = random.Random(seed), []
    for _ in range(groups):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 200))]
        for _ in range(rng.randrange(1, most)):
            out.append(" ".join(words))
            words = list(words if rng.random() < 0.5 else out[-1].split())
            for _ in range(rng.randrange(1, 3)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize(("seed", "most"), [(1, 1024), (2, 2)])
def test_stage_keeps_what_brute_force_keeps(spark, seed, most):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(set(brute_groups(texts)))
    got = sorted(r.doc_id for r in nearcopies.keep_one_of_each(docs, most=most).collect())
    assert got == want and len(want) < len(texts)


def test_near_copy_beyond_two_bits_goes(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:50], "x", *words[51:140], "y", *words[141:]]))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.deduplicated(spark, docs, "").collect()] == [1]


def test_repeated_ids_with_other_texts_are_kept_by_group(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, b), (5, a), (3, b), (9, a), (None, "other words here"), (None, "other words here"), (None, a), (7, None), (8, " ")]
    got = nearcopies.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(5, a), (3, b), (0, "other words here"), (7, "")])


def test_common_shingles_count_alike_in_blocks():
    sets = [nearcopies.shingles(t) for t in corpus(3)]
    i, j = nearcopies._joined_in(sets, sets, 0.8, block=64)
    want = {(x, y) for x in range(len(sets)) for y in range(len(sets)) if nearcopies.jaccard(sets[x], sets[y]) >= 0.8}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
