"""Secrets in text: fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lean

#: Fixed patterns: kind -> (pattern, group whose length counts, least length). Matches are leftmost, not overlapping.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
KINDS = (*BASE, "entropy")
#: Strings that entropy is measured in, and the length of the window.
CANDIDATE, WINDOW = r"[A-Za-z0-9+/_=-]{20,}", 20
#: Least bits of entropy a window must have, by class. A random window of 20 has about 3.4 bits (16 symbols) or 4.1 (64).
LEAST_BITS = {"hex": 3.0, "base64": 3.6}
#: The scan's classes: also hex with hyphens, one-case letters with digits (base36, base32), and mixed letters without digits.
SCAN_BITS = LEAST_BITS | {"uuid": 3.0, "lower": 3.5, "upper": 3.4, "letters": 3.8}
#: Candidates that contain one of these (in any case) are no secrets: alphabets, digests of nothing, placeholders.
ALLOWED = (
    "0123456789abcdef", "abcdefghijklmnop", "d41d8cd98f00b204e9800998ecf8427e", "da39a3ee5e6b4b0d3255bfef95601890afd80709",
    "e3b0c44298fc1c149afbf4c8996fb924", "example", "placeholder", "xxxxxxxx",
)

_BASE = [(kind, re.compile(p, re.ASCII), group, least) for kind, (p, group, least) in BASE.items()]
_CANDIDATE = re.compile(CANDIDATE)


def _kind(c: str) -> int:
    """0 digit, 1 a-f, 2 A-F, 3 other lower-case letter, 4 other capital, 5 hyphen, 6 the rest."""
    if c <= "9" and c >= "0":
        return 0
    if c in "abcdef":
        return 1
    if c in "ABCDEF":
        return 2
    return 3 if c.islower() else 4 if c.isupper() else 5 if c == "-" else 6


def window_class(kinds: list[int], width: int) -> str | None:
    """The character class of a window with so many characters of each kind; None: of no class that hides secrets."""
    digits, low, high, lower, upper, hyphens, _ = kinds
    if digits >= 2 and digits + low + high == width and bool(low) != bool(high):
        return "hex"
    if digits >= 2 and low + lower >= 2 and high + upper >= 2:
        return "base64"
    if hyphens and digits >= 2 and low + high >= 2 and bool(low) != bool(high) and digits + low + high + hyphens == width:
        return "uuid"
    if digits >= 2 and digits + low + lower == width:
        return "lower"
    if digits >= 2 and digits + high + upper == width:
        return "upper"
    # names in camel case have few capitals
    if low + lower >= 6 and high + upper >= 6 and low + lower + high + upper == width:
        return "letters"
    return None


def entropy_spans(text: str, least=LEAST_BITS, allowed=ALLOWED, width: int = WINDOW, near: bool = False) -> list[tuple[int, int]]:
    """Merged windows of candidate strings whose entropy reaches their class's least; counts move with the window.

    Classes that ``least`` lacks are passed over. ``near``: an allowed string suppresses only the windows that overlap it,
    else the whole candidate, and so does a candidate's being all letters.
    """
    out: list[tuple[int, int]] = []
    term = [0.0] + [k * math.log2(k) for k in range(1, width + 2)]
    full = math.log2(width)
    for found in _CANDIDATE.finditer(text):
        word, base = found.group(), found.start()
        plain = word.lower()
        listed = [a for a in allowed if a in plain]
        if len(word) < width or (not near and (listed or word.isalpha())) or (word.isalpha() and (word == plain or word.isupper())):
            continue
        # free[i]: how many characters up to and with i no allowed string has covered, without a break
        covered = {p for a in listed for m in re.finditer(f"(?={re.escape(a)})", plain) for p in range(m.start(), m.start() + len(a))}
        free = 0
        counts: dict[str, int] = {}
        kinds, weight = [0] * 7, 0.0
        for i, c in enumerate(word):
            free = 0 if i in covered else free + 1
            n = counts.get(c, 0)
            counts[c] = n + 1
            weight += term[n + 1] - term[n]
            kinds[_kind(c)] += 1
            if i >= width:
                gone = word[i - width]
                n = counts[gone]
                counts[gone] = n - 1
                weight += term[n - 1] - term[n]
                kinds[_kind(gone)] -= 1
            if free >= width and (name := window_class(kinds, width)) in least and full - weight / width >= least[name] - 1e-9:
                start, end = base + i - width + 1, base + i + 1
                if out and out[-1][1] >= start:
                    out[-1] = (out[-1][0], end)
                else:
                    out.append((start, end))
    return out


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of a whole text in code points, end exclusive, by start and then kind as in ``KINDS``."""
    if not text:
        return []
    out = []
    for k, (kind, pattern, group, least) in enumerate(_BASE):
        out += [(m.start(), k, kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    out += [(a, len(_BASE), "entropy", b) for a, b in entropy_spans(text, SCAN_BITS, near=True)]
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def redacted(text: str, found: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each stretch that spans cover, alone or together, replaced by one mark."""
    out, at = [], 0
    stretch: list[list[int]] = []
    for _, start, end in found:
        if stretch and start <= stretch[-1][1]:
            stretch[-1][1] = max(stretch[-1][1], end)
        else:
            stretch.append([start, end])
    for start, end in stretch:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, spans array<struct<kind string, start int, end int>>)``, one row per row of ``docs``.

    Every whole text is read; no row leaves its partition. Null and empty texts have no spans; repeated rows give
    repeated rows; other columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (spans(t.as_py()) for t in batch.column(1))
            lists = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f] for f in found], _SPANS)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "spans"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = narrow.mapInArrow(scan, "doc_id long, spans array<struct<kind string, start int, end int>>")
    return out.withColumnRenamed("doc_id", id_col)


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the secrets of every text masked and, where there is such a column, its length in ``length_col`` renewed.

    All rows and columns stay, in their partitions; rows without secrets are unchanged.
    """
    schema, names = docs.schema, docs.columns
    text_at, length_at = names.index(text_col), names.index(length_col) if length_col in names else None

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts = columns[text_at].to_pylist()
            found = [spans(t) for t in texts]
            if any(found):
                shown = [redacted(t, f) if f else t for t, f in zip(texts, found, strict=True)]
                columns[text_at] = pa.array(shown, batch.schema.field(text_at).type)
                if length_at is not None:
                    old = columns[length_at].to_pylist()
                    new = [len(t) if f else n for t, f, n in zip(shown, found, old, strict=True)]
                    columns[length_at] = pa.array(new, batch.schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(lean(mask), schema)
