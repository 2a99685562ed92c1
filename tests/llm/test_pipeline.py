import collections
import math
import re
import struct

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import decontam, langid, secretscan

public_tokenizers = pytest.importorskip("public_tokenizers")

EN = "the quick brown fox jumps over the lazy dog and then the other dogs run after it through the wood for a while "
DE = "der schnelle braune fuchs springt über den faulen hund und dann laufen ihm die anderen hunde durch den wald nach "
KEY = "password = Xk29fLq81mZp3"
ITEM = "which of these seven answers would a careful reader choose when asked about the brown fox"


def tables():
    words = EN.split()
    say = lambda seed, n: " ".join(np.random.default_rng(seed).choice(words, n))
    docs = [(i, say(i, 30 + i % 50), "en", "s", None) for i in range(60)]
    docs += [(100 + i, say(i, 30 + i % 50).upper(), "en", "s", 7) for i in range(10)]
    docs += [(200, "123 456 !!", "en", "s", 1), (201, None, "en", "s", None), (202, "", None, None, 0)]
    docs += [(300, say(300, 40) + " " + ITEM + ".", "en", "s", 1), (301, f"{say(301, 40)} {KEY} {say(302, 9)}", "en", "s", 999)]
    docs += [(500, "qzv xkjw vvqz jxk wqzz kkxj zzvq wjjx", None, "s", 1), (501, "жили были дед и баба", None, "s", 1)]
    docs += [(600 + i, " ".join(np.random.default_rng(i).choice(DE.split(), 40)), "de" if i % 4 else "en", "s", 1) for i in range(16)]
    docs += [(5, say(5, 35), "en", "s", None), (None, say(400, 40), "en", "s", 3), (None, say(400, 40), "en", "s", 3), (None, say(401, 40), None, "s", 3)]
    return docs, [(1, ITEM), (2, None)]


def clean_text(text):
    return re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()))


def phrases(text, sample):
    i = n = 0
    while i < len(text):
        j = i
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        i, n = max(j, i + 1), n + 1
    return n


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(docs, items, samples):
    """The rows after each stage, by plain loops."""
    rows = []
    for d in docs:
        symbols = [s for s in clean_text(d[1] or "")]
        own = {lang: phrases("".join(symbols), clean_text(sample)) * math.log2(len(clean_text(sample))) for lang, sample in samples.items()}
        best = min(sorted(own), key=own.get)
        if any(c != " " for c in symbols) and own[best] / math.log2(len(clean_text(samples[best]))) <= 0.6 * len(symbols):
            rows.append((*d[:2], best, *d[3:]))
    out = [collections.Counter(rows)]
    sets = [shingles(d[1]) for d in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    group = list(range(len(rows)))
    for _ in rows:
        for i, j in near:
            group[i] = group[j] = min(group[i], group[j])
    by = collections.defaultdict(list)
    for g, row in zip(group, rows, strict=True):
        by[g].append(row)
    rows = [min(own, key=lambda r: (r[0] is None, r[0] or 0)) for own in by.values()]
    out.append(collections.Counter(rows))
    tests = [decontam.shingles(decontam.words(t)) for _, t in items if t]
    rows = [d for d in rows if not any(len(s & decontam.shingles(decontam.words(d[1]))) >= 0.8 * len(s) for s in tests)]
    out.append(collections.Counter(rows))
    clean = []
    for d in rows:
        found = secretscan.spans(d[1])
        text = secretscan.redacted(d[1], found)
        clean.append((d[0], text, d[2], d[3], len(text) if found else d[4]))
    out.append(collections.Counter(clean))
    return out


def test_stages_and_run_equal_brute_force(spark, tmp_path):
    docs, items = tables()
    at = f"file://{tmp_path}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "packing"]
    frame = spark.read.parquet(f"{at}/documents.parquet")
    columns = frame.columns
    want = brute(docs, items, langid.learn(frame))
    assert {r[2] for r in want[0]} == {"en", "de"} and not {500, 501, 200} & {r[0] for r in want[0]}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, frame, at).write.parquet(f"{at}/{name}")
        frame = spark.read.parquet(f"{at}/{name}")
        assert frame.columns == columns
        assert collections.Counter(map(tuple, frame.collect())) == want[k], name
    assert 300 not in {r[0] for r in want[3]} and any("[SECRET]" in r[1] for r in want[3])
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {t: [*plain.encode(t, add_special_tokens=False).ids, 1] for _, t, *_ in want[3]}
    got = corpus_pipeline.STAGES[-1][1](spark, frame, at).collect()
    assert sorted(x for r in got for x in struct.unpack(f"<{r.length}I", r.ids)) == sorted(x for r, n in want[3].items() for x in ids[r[1]] * n)
    ran = corpus_pipeline.run(spark, at)
    assert sum(r.length for r in ran.collect()) == sum(len(ids[r[1]]) * n for r, n in want[3].items())
    assert "ids" not in ran.columns


def test_empty_documents(spark, tmp_path):
    at = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0
