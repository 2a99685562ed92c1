"""Words taken out of texts: signs against a plain loop, ids against the tokenizer, parts of batches."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from quarry.llm.packing import Tokens

PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_closing_signs_are_found_in_bytes():
    words = ["", "a", ".", "a.", "ab,", "A.", "é.", ".,", "a..", "x1,", "日本a.", "z.", "b,,", "a,b"]
    for given in (words, words[3:], []):
        cut, mark = Tokens._closed(pa.array(words, pa.large_string())[len(words) - len(given) :])
        want = [k for k, w in enumerate(given) if len(w) > 1 and w[-1] in ".," and "a" <= w[-2] <= "z"]
        assert cut.tolist() == want
        assert mark.tolist() == [".,".index(w[-1]) if k in want else -1 for k, w in enumerate(given)]


def test_a_part_of_a_batch_costs_its_own_bytes_not_the_batchs():
    batch = pa.array(["some Words\tof a text. " * 500] * 2000, pa.string())  # 21 MB
    tokens = Tokens(PATH)
    whole, counts = tokens.encode(batch.slice(3, 2).cast(pa.large_string()))
    tracemalloc.start()
    try:
        ids, again = tokens.encode(batch.slice(1998, 2).cast(pa.large_string()))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert ids.tolist() == whole.tolist() and again.tolist() == counts.tolist()
    assert peak < 5 << 20
    assert [len(x) for x in tokens.encode(batch.slice(0, 0).cast(pa.large_string()))] == [0, 0]


def test_words_of_small_latin_letters_get_the_files_own_ids():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha() and chr(c).lower() == chr(c)]
    rng = random.Random(5)
    words = letters + ["".join(rng.choice(letters[: rng.choice((26, len(letters)))]) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    ids, counts = Tokens(PATH).encode(pa.array(words, pa.large_string()))
    want = [plain.encode(w, add_special_tokens=False).ids for w in words]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
