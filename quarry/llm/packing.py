"""Vector bin packing of examples into training sequences, and of tokenized documents cut into pieces."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lean, slices

SEQUENCE_TOKENS = 2048
#: Segments that one sequence of documents holds at most.
SEQUENCE_SEGMENTS = 256
END_OF_DOCUMENT = 1


class Packer:
    """Fills one bin after another from a pool of items, each a vector of demands, by the dot-product heuristic.

    Of the pool's items that fit in every dimension, a bin takes the one whose demands have the largest dot product
    with what the bin has left, dimensions weighted by the pool's mean demand; when none fits, the bin is closed.
    Bins are filled while more than half of ``pool`` items wait, so that a stream of any length packs in bounded
    memory; ``flush`` fills the rest.
    """

    def __init__(self, limits: Sequence[int], pool: int = 768):
        self.limits, self.pool = np.asarray(limits, np.float64), pool
        self.sizes, self.items = np.zeros((0, len(limits))), []

    def add(self, sizes: np.ndarray, items: list) -> Iterator[list]:
        if (sizes > self.limits).any():
            raise ValueError(f"an item is larger than a bin of {self.limits.astype(int).tolist()}")
        self.sizes, self.items = np.concatenate([self.sizes, sizes]), self.items + items
        if len(self.items) > self.pool:
            yield from self._fill(self.pool // 2)

    def flush(self) -> Iterator[list]:
        yield from self._fill(0)

    def _fill(self, rest: int) -> Iterator[list]:
        share = self.sizes / self.limits
        weight = share.mean(axis=0) if len(share) else share
        waiting = np.arange(len(share))
        while len(waiting) > rest:
            left, taken = np.ones(len(self.limits)), []
            open_, own = waiting, share[waiting]
            while True:
                fits = np.logical_and.reduce([own[:, d] <= most for d, most in enumerate(left + 1e-9)])
                if not fits.all():
                    open_, own = open_[fits], own[fits]
                if not len(open_):
                    break
                k = int((own @ (weight * left)).argmax())
                taken.append(open_[k])
                left = left - own[k]
                own[k] = np.inf  # fits no more
            waiting = np.setdiff1d(waiting, taken, assume_unique=True)
            yield [self.items[i] for i in taken]
        self.sizes, self.items = self.sizes[waiting], [self.items[i] for i in waiting]


def pack_examples(df: DataFrame, demands: Sequence[str], limits: Sequence[int], pool: int = 768) -> DataFrame:
    """``df`` with ``sequence_id long``, ``position int`` and ``oversize boolean``: examples packed whole under all limits at once.

    ``demands`` names integer columns, such as tokens, segments and loss-bearing tokens; null counts as 0. An example
    beyond a limit fits nowhere: it gets a sequence of its own and ``oversize`` is true, for the caller to cut or drop.
    Every partition packs its own rows in one pass, so nothing is shuffled and at most one part-filled pool per partition
    is left over. Repeated rows are packed each for itself; an empty table gives none. Input columns with the new names are
    replaced.
    """
    rows = df.select([c for c in df.columns if c.lower() not in ("sequence_id", "position", "oversize")])
    names = rows.columns
    at = [names.index(d) for d in demands]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number, first = Packer(limits, pool), 0, TaskContext.get().partitionId() << 33

        def out(bins: Iterable[list], oversize: bool = False) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for taken in bins:
                ids = pa.array([first + number] * len(taken), pa.int64())
                columns = [pa.concat_arrays([row.column(c) for row in taken]) for c in range(len(names))]
                columns += [ids, pa.array(range(len(taken)), pa.int32()), pa.array([oversize] * len(taken))]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "position", "oversize"])
                number += 1

        for batch in batches:
            sizes = np.stack([np.array(batch.column(c).fill_null(0), np.float64) for c in at], axis=1)
            over = (sizes > packer.limits).any(axis=1)
            yield from out(([batch.slice(i, 1)] for i in np.flatnonzero(over).tolist()), True)
            yield from out(packer.add(sizes[~over], [batch.slice(i, 1) for i in np.flatnonzero(~over).tolist()]))
        yield from out(packer.flush())

    kinds = {f.name: f.dataType for f in rows.schema}
    fields = [f"`{n}` {kinds[n].simpleString()}" for n in names]
    return rows.mapInArrow(pack, ", ".join([*fields, "sequence_id long, position int, oversize boolean"]))


#: Bytes of UTF-8 with A-Z lower-cased and every ASCII white space a space.
_ONE_SPACE = bytes(range(256)).lower().translate(bytes.maketrans(b"\t\n\v\f\r", b"     "))


class Tokens:
    """Token ids of texts by a ``tokenizers`` file whose words never cross white space.

    Texts are split at ASCII white space and lower-cased in A-Z (what the file's normalizer does first as well), and
    a full stop or comma that ends a word is taken off it. Only words not met before are encoded, many at a time,
    and put together again. At most ``keep`` words are remembered from batch to batch.
    """

    def __init__(self, path: str, keep: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        # Words of small Latin letters leave normalizer and splitter as they are: the same model needs neither for them,
        # nor, where they are ASCII, letters for bytes.
        self.ascii, self.latin = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.latin.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        (self.mark,) = self._ids("\0").tolist()
        self.known = {".": 0, ",": 1}
        stop, comma = self._ids("."), self._ids(",")
        self.ids, self.ends = np.concatenate([stop, comma]), np.array([0, len(stop), len(stop) + len(comma)])

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    @staticmethod
    def _many(tokenizer, words: list[str], between: str) -> np.ndarray:
        joined = [between.join(words[i : i + 500]) + between for i in range(0, len(words), 500)]
        found = tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        return np.concatenate([np.asarray(e.ids, np.uint32) for e in found]) if found else np.zeros(0, np.uint32)

    def _words(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in the order that suits, their ids, and each word's number of ids; A-Z is lower-cased already."""
        letters, latin, plain, odd = [], [], [], []
        for w in words:  # small Latin letters are one word to the tokenizer, closed by its last id; others need a mark between
            if w.isalpha() and (w.isascii() or max(w) < "\u0250" and w == w.lower()):
                (letters if w.isascii() else latin).append(w)
            else:
                (odd if "\0" in w else plain).append(w)
        first = np.concatenate([self._many(self.ascii, letters, " "), self._many(self.latin, latin, " ")])
        second, rest = self._many(self.tokenizer, plain, " \0 "), [self._ids(w) for w in odd]
        sizes = [np.diff(np.flatnonzero(self.closes[first]), prepend=-1), np.diff(np.flatnonzero(second == self.mark), prepend=-1) - 1]
        flat = np.concatenate([first, second[second != self.mark], *rest])
        return letters + latin + plain + odd, flat, np.concatenate([*sizes, np.array([len(r) for r in rest], np.int64)])

    @staticmethod
    def _closed(words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The places of words that end in a small letter and a full stop or comma; of each word the place of that sign, or -1."""
        mark = np.full(len(words), -1, np.int64)
        if not len(words):
            return np.zeros(0, np.int64), mark
        raw = words.buffers()[2]
        bytes_ = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        long = np.flatnonzero(np.diff(ends) > 1)
        last, before = bytes_[ends[long + 1] - 1], bytes_[ends[long + 1] - 2]
        dot = last == ord(".")
        hit = (dot | (last == ord(","))) & (before >= ord("a")) & (before <= ord("z"))
        mark[long[hit]] = np.where(dot[hit], 0, 1)
        return long[hit], mark

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one text after another, and each text's number of ids; a null text has none."""
        filled = pc.fill_null(texts, "").cast(pa.large_string())
        if not len(filled):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        at, raw = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1], filled.buffers()[2]
        own = bytes(raw.slice(at[0], at[-1] - at[0])) if raw else b""  # of a slice, its bytes alone: the buffer is the whole batch's
        clean = pa.LargeStringArray.from_buffers(len(filled), pa.py_buffer(at - at[0]), pa.py_buffer(own.translate(_ONE_SPACE)))
        split = pc.split_pattern(clean, " ")
        per_text = np.diff(np.asarray(split.offsets))
        coded = split.flatten().dictionary_encode()
        cut, mark = self._closed(coded.dictionary)
        one = pa.LargeListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
        bases, known = pc.binary_join(one, pa.scalar(" ", pa.large_string()))[0].as_py().split(" "), self.known
        for k in cut.tolist():
            bases[k] = bases[k][:-1]
        at = np.fromiter(map(known.get, bases, repeat(-1)), np.int64, len(bases))
        lacking = np.flatnonzero(at < 0).tolist()
        new, flat, sizes = self._words(list(dict.fromkeys(bases[k] for k in lacking)))
        old = len(self.ends) - 1
        ids = np.concatenate([self.ids, flat])
        ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)]).astype(np.int64)
        fresh = {w: old + k for k, w in enumerate(new)}
        at[lacking] = [fresh[bases[k]] for k in lacking]
        room = max(0, self.keep - old)
        known.update((w, fresh[w]) for w in new[:room])
        self.ends = ends[: old + min(room, len(new)) + 1]
        self.ids = ids[: self.ends[-1]]

        use = np.asarray(coded.indices, np.int64)
        ended = mark[use] >= 0
        place = np.cumsum(1 + ended) - 1 - ended
        units = np.empty(len(use) + int(ended.sum()), np.int64)
        units[place], units[place[ended] + 1] = at[use], mark[use][ended]
        size = ends[units + 1] - ends[units]
        begin = np.cumsum(size) - size
        out = ids[np.repeat(ends[units] - begin, size) + np.arange(int(size.sum()))]
        upto = np.append(begin, len(out))
        stops = np.append(place, len(units))[np.cumsum(per_text)]
        return out, np.diff(upto[stops], prepend=0)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: int = SEQUENCE_TOKENS,
    segments: int = SEQUENCE_SEGMENTS,
    pool: int = 768,
) -> DataFrame:
    """Whole documents as token pieces, packed into sequences of at most ``tokens`` ids and ``segments`` pieces.

    A document is its ids and the id that ends it; it is cut every ``tokens`` ids, and all pieces but full ones
    go through the packer, under limits on tokens, pieces and loss-bearing tokens (every id of a document bears
    loss). Returns per piece: ``id_col``, ``start long``, ``length long``, ``doc_tokens long``, ``ids binary``
    (little-endian unsigned 32-bit), ``sequence_id long`` and ``offset long``, where the piece begins in its
    sequence. Every partition fills its own sequences in one pass; nothing is shuffled.

    Null and empty texts are the ending id alone; repeated rows are packed each for itself; other columns are
    ignored; an empty table gives none.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer, number = Tokens(tokenizer_path), Packer((tokens, segments, tokens), pool), 0
        first = TaskContext.get().partitionId() << 33
        names = ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]

        def rows(bins: Iterator[list]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            out: list[tuple] = []
            for taken in bins:
                at = 0
                for doc, start, total, ids in taken:
                    out.append((doc, start, len(ids) // 4, total, ids, first + number, at))
                    at += len(ids) // 4
                number += 1
                if len(out) >= 2000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                flat, counts = own.encode(part.column(1).cast(pa.large_string()))
                raw, stop = flat.astype("<u4").tobytes(), np.cumsum(counts)
                full, rest = [], []
                ending = END_OF_DOCUMENT.to_bytes(4, "little")
                for doc, n, end in zip(part.column(0).to_pylist(), counts.tolist(), stop.tolist(), strict=True):
                    ids = raw[4 * (end - n) : 4 * end] + ending
                    for start in range(0, n + 1, tokens):
                        piece = ids[4 * start : 4 * (start + tokens)]
                        (full if len(piece) == 4 * tokens else rest).append((doc, start, n + 1, piece))
                yield from rows([p] for p in full)
                sizes = np.array([[len(p[3]) // 4, 1, len(p[3]) // 4] for p in rest], np.float64).reshape(-1, 3)
                yield from rows(packer.add(sizes, rest))
        yield from rows(packer.flush())

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = narrow.mapInArrow(lean(pack), "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", id_col)
