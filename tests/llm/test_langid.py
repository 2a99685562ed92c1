import random

import numpy as np
import pytest

from quarry.llm import langid

EN = "the quick brown fox jumps over the lazy dog and then the other dogs run after it through the wood "
DE = "der schnelle braune fuchs springt über den faulen hund und dann laufen die anderen hunde ihm durch den wald nach "


def slow_phrases(parser, text, sample):
    """Longest matches one after another, of the whole text."""
    symbols = "".join(map(chr, parser.symbols([text.lower()])[0].tolist()))
    inside = "".join(map(chr, parser.symbols([sample.lower()])[0].tolist()))
    i = n = 0
    while i < len(symbols):
        j = i
        while j < len(symbols) and symbols[i : j + 1] in inside:
            j += 1
        i, n = max(j, i + 1), n + 1
    return n


@pytest.mark.parametrize("block", [1, 2, 5, 64, 512])
def test_phrases_equal_longest_match_parsing_of_whole_texts(block):
    rng = random.Random(block)
    parser = langid.CrossParser({"en": EN, "de": DE}, block)
    texts = ["", "123 ...", "Жar  ж漢", EN * 3, DE * 9 + EN * 20, "İstanbul ǅ"] + ["".join(rng.choice("abcdeü ,thrn") for _ in range(rng.randrange(300))) for _ in range(30)]
    counts, letters, sizes = parser.phrases(texts)
    assert counts.tolist() == [[slow_phrases(parser, t, s) for s in (DE, EN)] for t in texts]
    assert letters.tolist() == [sum(c.isalpha() for c in t.lower()) for t in texts]
    assert sizes.tolist() == [len(parser.symbols([t.lower()])[0]) for t in texts]


@pytest.mark.parametrize("piece", [1, 3, 50])
def test_long_texts_are_parsed_piece_by_piece_alike(piece):
    rng = random.Random(piece)
    parser = langid.CrossParser({"en": EN, "de": DE}, 8)
    texts = ["", " . ", EN, DE * 2] + ["".join(rng.choice("abcdeü ,.thrn") for _ in range(rng.randrange(200))) for _ in range(20)]
    whole, pieces = parser.phrases(texts), parser.phrases(texts, piece)
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True))


def test_automaton_holds_all_substrings_and_no_more():
    rng = random.Random(3)
    string = [rng.randrange(2, 5) for _ in range(60)]
    own = langid.SuffixAutomaton(string, 5)

    def known(part):
        state, n = np.zeros(1, np.int64), 0
        for s in part:
            state, begins = own.step(state, np.array([s]))
            n += int(begins[0])
        return n <= 1

    subs = {tuple(string[i:j]) for i in range(60) for j in range(i, 61)}
    assert all(map(known, subs))
    for _ in range(500):
        part = tuple(rng.randrange(2, 5) for _ in range(rng.randrange(1, 9)))
        assert known(part) == (part in subs)


def test_large_alphabets_take_no_dense_tables():
    rng = random.Random(5)
    han = "".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(12_000))
    parser = langid.CrossParser({"zh": han, "en": EN * 20})
    assert sum(a.table.nbytes for a in parser.automata) < 3_000_000
    assert parser.predict([han[300:400], EN])[0] == ["zh", "en"]


def test_a_short_sample_is_not_outvoted_by_a_long_one():
    rng = random.Random(7)
    en, de = EN.split(), DE.split()
    long = " ".join(rng.choice(en) for _ in range(4000))
    parser = langid.CrossParser({"en": long, "de": DE + " ".join(rng.sample(de, len(de)))})
    texts = [" ".join(rng.choice(de) for _ in range(40)) for _ in range(50)] + [" ".join(rng.choice(en) for _ in range(40)) for _ in range(50)]
    assert parser.predict(texts)[0] == ["de"] * 50 + ["en"] * 50


def test_texts_that_no_language_explains_are_rejected(spark):
    rng = random.Random(11)
    junk = ["".join(rng.choice("qzxjkvwyfp") for _ in range(200)), "Жили были дед и баба", None, "1 2 3"]
    rows = [(i, t, "xx", "clash") for i, t in enumerate([EN, DE[10:80], *junk])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    kept = langid.keep_identified(docs, {"en": EN, "de": DE})
    assert kept.schema == docs.schema
    assert sorted((r.doc_id, r.lang) for r in kept.collect()) == [(0, "en"), (1, "de")]
    assert langid.keep_identified(docs, {}).count() == 0 and langid.keep_identified(docs.drop("lang"), {"en": EN}).count() == 1


def test_odd_rows_and_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.sample((DE if i % 2 else EN).split(), 12)), "de" if i % 2 else "en") for i in range(120)]
    odd = [(500, None, "en"), (501, " 123 !", "de"), (None, "der hund und die anderen hunde", None), (502, "", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", docs_text())
    samples = langid.learn(docs)
    assert set(samples) == {"en", "de"}
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_languages(docs, samples).collect()}
    assert got[500] == got[501] == got[502] == ("und", 0.0) and got[None][0] == "de"
    assert np.mean([got[i][0] == lang for i, _, lang in rows]) > 0.97
    assert all(0 <= s <= 1 for _, s in got.values())
    assert langid.identify_languages(docs.limit(0), samples).count() == 0
    assert {r.lang_pred for r in langid.identify_languages(docs, {}).collect()} == {"und"}
    assert langid.learn(docs.limit(0)) == {}


def docs_text():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_samples_are_bounded_and_never_held_out(spark):
    import zlib

    docs = spark.createDataFrame([(i, f"w{i}x " * 50, "en") for i in range(300)], "doc_id long, text string, lang string")
    sample = langid.learn(docs, chars=1000, rows=20)["en"]
    assert len(sample) <= 1000
    used = {int(w[1:-1]) for w in sample.split() if w.startswith("w") and w.endswith("x")}
    assert used and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in used)
    assert len(langid.learn(docs.withColumn("lang", docs["doc_id"].cast("string")), languages=5)) == 5


def test_few_long_texts_fill_a_sample(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{chr(97 + i)}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(3000)), "en") for i in range(12)], "doc_id long, text string, lang string")
    assert len(langid.learn(docs)["en"]) == 20_000


def test_samples_take_passages_of_distinct_texts_from_anywhere(spark):
    head = "the same opening of every text " * 20
    rows = [(i, head + " ".join(f"{chr(97 + i % 26)}{chr(97 + k % 26)}body" for k in range(400)), "en") for i in range(40)]
    rows += [(1000 + i, "copied words again", "en") for i in range(300)]
    sample = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["en"]
    assert sample.count("body") > 500 and sample.count("copied words again") <= 1
