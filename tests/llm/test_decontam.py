import random

import pytest

from quarry.llm import decontam as d


def slow(docs, items, width=5, least=0.8):
    out = []
    for doc, text in docs:
        for item, own in items:
            w = d.words(own or "")
            if not w:
                continue
            size = min(width, len(w))
            a, b = d.shingles(w, size), {" ".join(x) for x in zip(*(d.words(text or "")[i:] for i in range(size)), strict=False)}
            if len(a & b) >= least * len(a) - 1e-9:
                out.append((doc, item, len(a), len(a & b)))
    return sorted(out, key=str)


def planted(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éa", "ß", "漢字", "x_y", "a1"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 4, 5, 6, 9, 20, 40, 63, 64]))) for i in range(40)] + [(90, None), (91, " .. "), (None, say(12))]
    docs = []
    for i in range(60):
        item = (items[rng.randrange(40)][1]).split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            item[rng.randrange(len(item))] = "changed"
        docs.append((i, say(rng.choice([0, 3, 50, 400])) + rng.choice([" ", "!\n"]) + rng.choice([" ", ", ", " ## "]).join(item).upper() + " " + say(5)))
    return docs + [(100, None), (101, ""), (None, items[30][1]), (7, items[20][1])], items


@pytest.mark.parametrize("seed", [1, 600])
def test_all_items_in_all_documents_and_no_others(spark, seed):
    docs, items = planted(seed)
    frame = spark.createDataFrame([(*r, 0.5) for r in docs], "doc_id long, text string, containment double")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = d.find_contamination(frame, tests).collect()
    assert sorted(((r.doc_id, r.item_id, r.shingles, r.found) for r in got), key=str) == slow(docs, items)
    assert all(r.containment == r.found / r.shingles for r in got)
    dirty = {(x[0]) for x in slow(docs, items)}
    clean = d.drop_contaminated(frame, tests)
    assert clean.schema == frame.schema
    assert {r.doc_id for r in clean.collect()} == {x[0] for x in docs} - dirty
    assert clean.collect()[0].containment == 0.5


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert d.find_contamination(docs, items.limit(0)).count() == 0
    assert d.find_contamination(docs.limit(0), items).count() == 0
    assert d.drop_contaminated(docs, items.limit(0)).count() == 1 and d.drop_contaminated(docs, items).count() == 0


def test_short_item_in_a_very_long_text(spark):
    rng = random.Random(0)
    long = [f"v{rng.randrange(5000)}" for _ in range(60_000)]
    item = [f"q{i}" for i in range(12)]
    docs = [(1, " ".join(long)), (2, " ".join(long[:30_000] + item + long[30_000:])), (3, "x" * 3_000_000)]
    found = d.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(3, " ".join(item))], "item_id long, text string"))
    assert [tuple(r) for r in found.collect()] == [(2, 3, 8, 8, 1.0)]


@pytest.mark.parametrize("piece", [1, 7, 1000])
def test_hashes_do_not_depend_on_where_long_texts_are_cut(piece):
    rng = random.Random(piece)
    texts = ["", "one", " .. "] + ["".join(rng.choice("ab c,é漢") for _ in range(rng.randrange(80))) for _ in range(20)]
    h, counts, start, stop = d.WordHasher().hashes(texts, piece)
    want = [w for t in texts for w in d.words(t)]
    owner = [t for t, n in zip(texts, counts, strict=True) for _ in range(n)]
    assert [t[a:b] for t, a, b in zip(owner, start, stop, strict=True)] == want
    assert len(set(h.tolist())) == len(set(want)) == len(set(zip(h.tolist(), want, strict=True)))


def test_filter_passes_all_it_holds_and_little_else(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    held, other = rng.integers(-(2**63), 2**63 - 1, 2000), rng.integers(-(2**63), 2**63 - 1, 100_000)
    own = d.Filter.of(spark.createDataFrame([(5, x) for x in held.tolist()], "size int, h long"))
    assert len(own.test(held.view(np.uint64), 5)) == 2000
    assert len(own.test(other.view(np.uint64), 5)) < 20 and len(own.test(held.view(np.uint64), 4)) < 20


def test_phrases_that_many_items_share_are_sketched_last(spark):
    items = [(i, "choose the best answer to this question " + " ".join(f"w{i}x{k}" for k in range(9))) for i in range(50)]
    table = d.item_table(spark.createDataFrame(items, "item_id long, text string"), "text")
    assert table.where("sketched and shingle like 'choose the best%'").count() == 0
