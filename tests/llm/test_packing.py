import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


def test_word_cache_gives_the_tokenizers_ids(plain):
    rng = random.Random(2)
    texts = ["a\0b A\0 \0 x", "", None, "Ünï İİ Å  x　y", "<|endoftext|> don't they'LL", "ΟΔΟΣ Σ", "\u0085 a\x1fb", "x, ., a.. b.,'s. it's, é. 1. a1, \0.", "a.", ",", "là à\u00a0b voilà\u0085 ça\u2003x"]
    texts += ["".join(rng.choice("abcABÉé .,'\n\t1_!") for _ in range(rng.randrange(60))) for _ in range(200)]
    tokens = packing.Tokens(PATH, keep=30)
    for part in (texts, texts[::-1], texts):
        ids, counts = tokens.encode(pa.array(part, pa.large_string()))
        want = [plain(t) for t in part]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_packer_keeps_all_limits_and_little_padding():
    rng = np.random.default_rng(0)
    sizes = np.minimum(2048, rng.lognormal(5.5, 1, 3000)).astype(int)
    demand = np.stack([sizes, np.ones_like(sizes), sizes * (rng.random(3000) < 0.5)], 1)
    packer = packing.Packer((2048, 12, 1200), pool=300)
    demand[:, 2] = np.minimum(demand[:, 2], 1200)
    bins = [b for i in range(0, 3000, 100) for b in packer.add(demand[i : i + 100], list(range(i, i + 100)))] + list(packer.flush())
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert all((demand[b].sum(axis=0) <= (2048, 12, 1200)).all() for b in bins)
    bound = (demand.sum(axis=0) / (2048, 12, 1200)).max()
    assert len(bins) < 1.1 * bound + 1
    with pytest.raises(ValueError):
        list(packer.add(np.array([[2049, 1, 0]]), [0]))


def test_examples_with_clashing_columns(spark):
    rows = [(i, i % 90 + 1, 1, i % 7, "s") for i in range(200)] + [(200, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, tokens int, segments int, loss int, sequence_id string")
    got = packing.pack_examples(df, ["tokens", "segments", "loss"], [100, 4, 9]).collect()
    assert sorted(r.id for r in got) == list(range(201))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        assert sum(r.tokens or 0 for r in own) <= 100 and sum(r.segments or 0 for r in own) <= 4 and sum(r.loss or 0 for r in own) <= 9
        assert sorted(r.position for r in own) == list(range(len(own)))
    assert packing.pack_examples(df.limit(0), ["tokens"], [100]).count() == 0


def test_documents_come_back_whole_from_their_pieces(spark, plain):
    rng = random.Random(4)
    words = "alpha beta Gamma, delta. it's 12 é".split()
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 5, 500, 4000, 2047, 2048, 30, 9000)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(1, texts[1], "x"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(2)
    got = packing.pack_documents(docs, PATH).collect()
    pieces = {}
    for r in got:
        ids = list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids))
        assert len(ids) == r.length
        pieces.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
    for i, text in enumerate(texts):
        want, copies = plain(text) + [1], 2 if i == 1 else 1
        assert sorted(sum((p[1] for p in sorted(pieces[i])), [])) == sorted(want * copies)
        if copies == 1:
            assert sum((p[1] for p in sorted(pieces[i])), []) == want
            assert [p[0] for p in sorted(pieces[i])] == list(range(0, len(want), 2048))
        assert {p[2] for p in pieces[i]} == {len(want)}
    assert [p[1] for p in pieces[None]] == [[1]]
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_over_long_examples_get_a_sequence_of_their_own(spark):
    df = spark.createDataFrame([(i, 500 if i % 10 == 0 else 30) for i in range(50)], "id long, tokens int")
    got = packing.pack_examples(df, ["tokens"], [100]).collect()
    assert sorted(r.id for r in got) == list(range(50)) and {r.id for r in got if r.oversize} == set(range(0, 50, 10))
    alone = [r.sequence_id for r in got if r.oversize]
    assert all(sum(x.sequence_id == s for x in got) == 1 for s in alone)
