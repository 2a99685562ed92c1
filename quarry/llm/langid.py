"""Language identification by cross-parsing entropy against suffix automata of labelled text."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import lean

UNDETERMINED = "und"
#: Phrases a symbol above which no sample explains a text: its longest matches are shorter than 1.7 symbols on average.
MOST_PHRASES = 0.6
#: Symbols of the automata: 0 is anything but a letter, 1 a letter that no sample has, the rest the samples' letters.
_SPACE, _STRANGE = 0, 1
_LOW = np.int64(0xFFFFFFFF)


class SuffixAutomaton:
    """All substrings of one symbol string, its moves in one array.

    A state is named by a place, so that its move by a symbol, if it has one, is at ``table[state + symbol]``, which holds
    the state's own name (high half) and the next state's. States share the array wherever their moves leave room, so it is
    about as long as there are moves, whatever the alphabet. The root is 0; its moves are ``first[symbol]``, 0 for a symbol that
    the string lacks.
    """

    def __init__(self, symbols: list[int], size: int):
        moves = self._moves(symbols)
        place, taken, used = [0] * len(moves), bytearray(4 * len(moves) + 2 * size), bytearray(4 * len(moves) + 2 * size)
        near, cursor = 0, {}
        used[0] = 1
        for state in sorted(range(1, len(moves)), key=lambda k: -len(moves[k])):
            own = sorted(moves[state])
            # what is full stays full: states of one move by one symbol go on from the last of them, others from a little before
            key = own[0] if len(own) == 1 else None
            at = cursor.get(key, 1) if len(own) < 2 else max(1, near - size)
            while used[at] or any(taken[at + s] for s in own):
                at += 1
                if at + size >= len(taken):
                    taken.extend(bytes(len(taken)))
                    used.extend(bytes(len(used)))
            place[state], used[at] = at, 1
            for s in own:
                taken[at + s] = 1
            if len(own) < 2:
                cursor[key] = at
            else:
                near = at
        self.table = np.full(max(place) + size + 1, -1, np.int64)
        for state in range(1, len(moves)):
            for s, target in moves[state].items():
                self.table[place[state] + s] = place[state] << 32 | place[target]
        self.first = np.zeros(size, np.int64)
        for s, target in moves[0].items():
            self.first[s] = place[target]

    @staticmethod
    def _moves(symbols: list[int]) -> list[dict[int, int]]:
        link, length, moves = [-1], [0], [{}]
        last = 0
        for s in symbols:
            if s == _STRANGE:
                continue
            now = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and s not in moves[p]:
                moves[p][s] = now
                p = link[p]
            if p >= 0:
                q = moves[p][s]
                if length[q] == length[p] + 1:
                    link[now] = q
                else:
                    copy = len(moves)
                    moves.append(dict(moves[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[now] = copy
                    while p >= 0 and moves[p].get(s) == q:
                        moves[p][s] = copy
                        p = link[p]
            last = now
        return moves

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase begins: where no match is open, or the open one can't grow.

        A symbol that the string lacks is a phrase and leaves no match open.
        """
        entry = self.table[state + symbol]
        begins = (entry >> 32) != state
        return np.where(begins, self.first[symbol], entry & _LOW), begins


class CrossParser:
    """Phrases that a text needs in each language: longest matches in that language's sample, one after another.

    ``samples``: language -> sample text. Letters are lower-cased; every run of other characters is one space.
    A phrase is the longest match of the sample from where the last one ended (one symbol at least).

    Texts of any length are parsed in step: each is cut every ``block`` symbols and all blocks are first parsed from their
    starts. Then what was open at a block's end is carried into the next block until that parse and the first one are in the
    same state; from there on they agree. This is repeated for blocks whose beginning changed, so the phrases are those of
    one parse of the whole text.
    """

    def __init__(self, samples: dict[str, str], block: int = 512):
        self.langs, self.block = sorted(samples), block
        clean = {k: samples[k].lower() for k in self.langs}
        self.letters = "".join(sorted({c for t in clean.values() for c in t if c.isalpha()}))
        parts = [self.symbols([clean[k]])[0].tolist() for k in self.langs]
        self.automata = [SuffixAutomaton(p, len(self.letters) + 2) for p in parts]
        #: What a phrase costs: the bits that tell a place in the sample.
        self.bits = np.array([math.log2(max(2, len(p))) for p in parts])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "codes"}

    @functools.cached_property
    def codes(self) -> np.ndarray:
        every = np.arange(0x110000, dtype="<u4")
        every[0xD800:0xE000] = 0
        alphabetic = np.fromiter(map(str.isalpha, every.tobytes().decode("utf-32-le")), bool, 0x110000)
        codes = np.where(alphabetic, _STRANGE, _SPACE).astype(np.int32)
        codes[[ord(c) for c in self.letters]] = np.arange(len(self.letters)) + 2
        return codes

    def symbols(self, lowered: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' symbols, one text after another, and the number of symbols of each text."""
        raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in lowered]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        if not sizes.sum():
            return np.zeros(0, np.int32), sizes
        flat = self.codes[np.concatenate(raw)]
        owner = np.repeat(np.arange(len(raw)), sizes)
        keep = np.ones(len(flat), bool)
        keep[1:] = (flat[1:] != _SPACE) | (flat[:-1] != _SPACE) | (owner[1:] != owner[:-1])
        return flat[keep], np.bincount(owner[keep], minlength=len(raw))

    def phrases(self, texts: list[str], piece: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases by text and language, each text's letters, and each text's symbols.

        Of texts longer than ``piece`` characters one piece after another is parsed, each from the states that the last one
        left, so memory doesn't grow with a text.
        """
        lowered = [t.lower() for t in texts]
        counts, letters, sizes, state = self._run([t[: _cut(t, 0, piece)] for t in lowered], np.zeros((len(texts), len(self.langs)), np.int64))
        for k, text in enumerate(lowered):
            at = _cut(text, 0, piece)
            while at < len(text):
                end = _cut(text, at, piece)
                more, *added, state[k : k + 1] = self._run([text[at:end]], state[k : k + 1])
                counts[k], letters[k], sizes[k], at = counts[k] + more[0], letters[k] + added[0][0], sizes[k] + added[1][0], end
        return counts, letters, sizes

    def _run(self, lowered: list[str], entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that begin in each text by language, letters, symbols, and the states at the ends, from the states in ``entry``."""
        flat, sizes = self.symbols(lowered)
        owner = np.repeat(np.arange(len(lowered)), sizes)
        letters = np.bincount(owner[flat != _SPACE], minlength=len(lowered))
        counts, left = np.zeros(entry.shape, np.int64), entry.copy()
        blocks = -(-sizes // self.block)
        of = np.repeat(np.arange(len(lowered)), blocks)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        length = np.minimum(self.block, sizes[of] - nth * self.block)
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(of), np.int64)
        place[order] = np.arange(len(of))
        of, nth, length = of[order], nth[order], length[order]
        start = (np.cumsum(sizes) - sizes)[of] + nth * self.block
        after = np.where(np.append(nth[place][1:], 0) > 0, np.append(place[1:], 0), -1)[order] if len(of) else place
        for k, own in enumerate(self.automata):
            met, end = self._parsed(own, flat, start, length, after, np.where(nth == 0, entry[of, k], 0))
            counts[:, k] = np.bincount(of, met, minlength=len(lowered)).astype(np.int64)
            left[of[after < 0], k] = end[after < 0]
        return counts, letters, sizes, left

    def _parsed(self, own: SuffixAutomaton, flat: np.ndarray, start: np.ndarray, length: np.ndarray, after: np.ndarray, carried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each block, and the state at its end.

        Blocks come longest first; ``after`` is the next of the text, or -1, and ``carried`` the state that first blocks begin in.
        """
        n = len(start)
        steps = int(length[0]) if n else 0
        alive = np.searchsorted(-length, -np.arange(steps), "left")
        state, met = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for t in range(steps):
            m = int(alive[t])
            state[:m], begins = own.step(state[:m], flat[start[:m] + t])
            met[:m] += begins
        total, last, entry = met.copy(), state.copy(), np.zeros(n, np.int64)
        # blocks to parse again, and the states they really begin in
        into = after[(after >= 0) & (last > 0)]
        carried = carried.copy()
        carried[into] = last[(after >= 0) & (last > 0)]
        into = np.flatnonzero(carried != entry)
        while len(into):
            now = entry[into] = carried[into]
            # both parses side by side, until they are in the same state: then the rest is known
            here, first = into, np.zeros(len(into), np.int64)
            more = np.zeros(len(into), np.int64)
            for t in range(steps):
                if not len(here):
                    break
                symbol = flat[start[here] + t]
                now, begins = own.step(now, symbol)
                first, begins_first = own.step(first, symbol)
                more = more + begins - begins_first
                same, over = now == first, length[here] == t + 1
                met[here[same]], last[here[same]] = total[here[same]] + more[same], state[here[same]]
                over &= ~same
                met[here[over]], last[here[over]] = total[here[over]] + more[over], now[over]
                on = ~(same | over)
                here, now, first, more = here[on], now[on], first[on], more[on]
            behind = into[after[into] >= 0]
            carried[after[behind]] = last[behind]
            into = after[behind][carried[after[behind]] != entry[after[behind]]]
        return met, last

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and score of each text, and how many phrases a symbol it takes in that language.

        Phrases are normalised by what a phrase costs in a sample of that length; the score, 0 to 1, is the lead of the
        cheapest language over the next.
        """
        counts, letters, sizes = self.phrases([t or "" for t in texts])
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        cost = counts * self.bits
        best, ranked = cost.argmin(axis=1), np.sort(cost, axis=1)
        least, following = ranked[:, 0], ranked[:, 1] if len(self.langs) > 1 else np.maximum(sizes * self.bits[0], ranked[:, 0])
        score = np.where(letters > 0, 1 - least / np.maximum(following, 1e-9), 0.0)
        return [self.langs[b] if n else UNDETERMINED for b, n in zip(best, letters, strict=True)], np.clip(score, 0, 1), counts[np.arange(len(texts)), best] / np.maximum(sizes, 1)


def _cut(text: str, start: int, piece: int) -> int:
    """Where a piece of about ``piece`` characters that begins at ``start`` ends: before a letter, so that no run of others is cut."""
    at = min(start + piece, len(text))
    while at < len(text) and not text[at].isalpha():
        at += 1
    return at


def sample_texts(labelled: DataFrame, chars: int = 20_000, rows: int = 200, languages: int = 200) -> dict[str, str]:
    """Bounded samples of ``labelled(id, text, lang)``: language -> ``chars`` characters at most, from at most ``rows`` distinct texts.

    Texts come in the order of a seeded hash, copies once. Of n texts of a language each gives one passage of ``4 * chars / n``
    characters that starts anywhere in the whole text, by the same hash; a shorter text is taken whole. The ``languages``
    labels with most rows are learnt (ties by name). What reaches the driver is bounded by these three parameters.
    """
    good = labelled.where("lang is not null")
    often = good.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    good = good.where(F.col("text").isNotNull() & F.col("lang").isin([r["lang"] for r in often])).withColumn("key", F.xxhash64("text", F.lit(17)))
    # the least keys of some partitions, then of those of some of these: no task sorts more than a few thousand of a language
    keys = good.select("lang", "key").distinct().withColumn("part", F.spark_partition_id())
    for groups in (512, 16, 1):
        order = Window.partitionBy("lang", F.col("part") % groups).orderBy("key")
        keys = keys.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows)
    keys = keys.withColumn("share", F.ceil(4 * chars / F.max("rank").over(Window.partitionBy("lang"))).cast("int"))
    start = F.pmod(F.xxhash64("key", F.lit(29)), F.greatest(F.length("text") - F.col("share") + 1, F.lit(1))) + 1
    passage = F.substring("text", start.cast("int"), F.col("share"))
    # every copy of a text gives the same passage
    cut = good.join(F.broadcast(keys.select("lang", "key", "rank", "share")), ["lang", "key"]).groupBy("lang", "rank").agg(F.first(passage).alias("text"))
    out: dict[str, str] = {}
    for lang, _, text in sorted(map(tuple, cut.collect())):
        if len(out.get(lang, "")) < chars:
            out[lang] = (out.get(lang, "") + "\n" + text)[:chars]
    return out


def _predicted(parser: CrossParser, texts: list[str | None], batch_chars: int) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray]]:
    """(first, past the last, languages, scores, phrases a symbol) of runs of texts with about ``batch_chars`` characters."""
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size < batch_chars):
            size += len(texts[stop] or "")
            stop += 1
        yield start, stop, *parser.predict(texts[start:stop])
        start = stop


def identify_languages(
    docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 1 << 20
) -> DataFrame:
    """``(id_col, lang_pred string, score double)``, one row per row of ``docs``, from its text alone.

    The language whose sample tells the text in the fewest bits (phrases, each at the logarithm of the sample's length) wins,
    the first in alphabetical order on a tie (score 0). ``score`` is how much fewer bits the winner takes than the
    runner-up, as a share. A null text or one without letters is ``und`` with score 0, and so is every text where
    nothing was learnt. Texts are parsed whole, whatever their length. Rows keep their partitions; repeated rows give
    repeated rows; other columns are ignored.
    """
    parser = CrossParser(samples)

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, langs, score, _ in _predicted(parser, batch.column(1).to_pylist(), batch_chars):
                ids = batch.column(0).slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([ids, pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(identify, "doc_id long, lang_pred string, score double").withColumnRenamed("doc_id", id_col)


def not_held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> F.Column:
    """Rows that may be learnt from: crc32 of the id as text, modulo ``folds``, is not ``fold``. A null id may not."""
    return F.crc32(F.col(id_col).cast("string")) % folds != fold


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> dict[str, str]:
    """Samples from the rows of ``docs`` that are not held out."""
    labelled = docs.where(not_held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return sample_texts(labelled, **bounds)


def keep_identified(docs: DataFrame, samples: dict[str, str], text_col: str = "text", lang_col: str = "lang", most_phrases: float = MOST_PHRASES, batch_chars: int = 1 << 20) -> DataFrame:
    """The rows of ``docs`` whose text is in a learnt language, with all their columns, in their partitions.

    ``lang_col``, where there is such a column, becomes the language that the parse finds. Rows go whose text is null or
    has no letters, or takes more than ``most_phrases`` a symbol in the language that suits it best, as other scripts and
    strings of unrelated letters do; and all rows where nothing was learnt.
    """
    parser = CrossParser(samples)
    schema, at = docs.schema, docs.columns.index(text_col)
    lang_at = docs.columns.index(lang_col) if lang_col in docs.columns else None

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_predicted(parser, batch.column(at).to_pylist(), batch_chars))
            langs = [lang for _, _, part, *_ in found for lang in part]
            phrases = np.concatenate([b for *_, b in found]) if found else np.zeros(0)
            columns = list(batch.columns)
            if lang_at is not None:
                columns[lang_at] = pa.array(langs, batch.schema.field(lang_at).type)
            good = np.fromiter((lang != UNDETERMINED for lang in langs), bool, len(langs)) & (phrases <= most_phrases)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(good))

    return docs.mapInArrow(lean(keep), schema)
