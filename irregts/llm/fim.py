"""Fill-in-the-middle: a text is cut in three and its middle moved to the end.

Cuts are drawn from a hash of the id, in units of words (``[A-Za-z]+|[^A-Za-z]``, matched left to
right) or of characters. A text is worked on as UTF-8 bytes with a sparse exception index: only the
multibyte characters are recorded, by position and bytes beyond one. Between them a character is a
byte, so a cut is converted by one ``searchsorted`` among the exceptions and an addition, in either
direction, and memory follows the number of exceptions, not of characters.

The forms: ``psm`` is ``<P>prefix<S>suffix<M>middle``, ``spm`` is ``<S>suffix<P>prefix<M>middle``,
``plain`` is the text itself. Empty texts (null is empty) and texts that hold one of the three
marks are always plain, so every output can be taken apart again. Prefix, middle and suffix may be
empty. Bytes that are not UTF-8 are replaced by U+FFFD first.

A null id is hashed as the empty string. Rows are worked on one by one: equal ids with equal texts
give equal rows. An empty table gives an empty result. Other columns are ignored whatever their
names. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irregts.llm.common import bounded_batches

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


class Recipe(NamedTuple):
    """Percent of texts that are cut, percent of those in the ``spm`` form, the unit of cuts
    (``word`` or ``char``) and the seed of the draws."""

    cut: int = 90
    spm: int = 20
    unit: str = "word"
    seed: int = 1


class Exceptions:
    """Sparse index of the multibyte characters of a text in UTF-8."""

    def __init__(self, raw: np.ndarray) -> None:
        lead = np.flatnonzero(raw >= 0xC0)
        excess = 1 + (raw[lead] >= 0xE0).astype(np.int64) + (raw[lead] >= 0xF0)
        #: Excess bytes ahead of each exception, and of all; bytes and characters ahead of it.
        self.ahead = np.concatenate([np.zeros(1, np.int64), np.cumsum(excess)])
        self.bytes, self.chars = lead, lead - self.ahead[:-1]
        self.n_chars = len(raw) - int(self.ahead[-1])

    def to_bytes(self, chars: np.ndarray | int) -> np.ndarray:
        """Offsets in bytes of offsets in characters."""
        return chars + self.ahead[np.searchsorted(self.chars, chars)]

    def to_chars(self, offsets: np.ndarray | int) -> np.ndarray:
        """Offsets in characters of offsets in bytes, which are ends of characters."""
        return offsets - self.ahead[np.searchsorted(self.bytes, offsets)]


def word_starts(raw: np.ndarray) -> np.ndarray:
    """Where the units ``[A-Za-z]+|[^A-Za-z]`` begin, in bytes."""
    letter = ((raw | 0x20) - np.uint8(97)).astype(np.uint8) < 26
    start = (raw & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(start)


class Cut(NamedTuple):
    n: int
    form: str
    chars: tuple[int, int] | None
    output: bytes


_MARK_BYTES = tuple(m.encode() for m in MARKS)


def cut(text: bytes, draws: tuple[int, int, int, int], recipe: Recipe = Recipe()) -> Cut:
    """One text by its four draws: two for the cuts, one each for whether and in which form."""
    raw = np.frombuffer(text, np.uint8)
    index = None
    if recipe.unit == "word":
        starts = word_starts(raw)
        n = len(starts)
    else:
        index = Exceptions(raw)
        n = index.n_chars
    if not text or draws[2] % 100 >= recipe.cut or any(mark in text for mark in _MARK_BYTES):
        return Cut(n, "plain", None, text)
    ends = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    if recipe.unit == "word":
        index = Exceptions(raw)
        offsets = [int(starts[k]) if k < n else len(text) for k in ends]
        chars = index.to_chars(np.array(offsets))
    else:
        chars = np.array(ends)
        offsets = index.to_bytes(chars).tolist()
    a, b = offsets
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = _MARK_BYTES
    spm = draws[3] % 100 < recipe.spm
    output = b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle))
    return Cut(n, "spm" if spm else "psm", (int(chars[0]), int(chars[1] - chars[0])), output)


def _cut_batches(batches: Iterator[pa.RecordBatch], recipe: Recipe) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        draws = zip(*(batch.column(f"h{i}").to_pylist() for i in range(1, 5)))
        done = [cut(raw.as_py(), h, recipe) for raw, h in zip(batch.column("raw"), draws)]
        columns = [
            batch.column("doc_id"),
            pa.array([c.n for c in done], pa.int64()),
            pa.array([c.form for c in done], pa.string()),
            pa.array([c.chars and c.chars[0] for c in done], pa.int64()),
            pa.array([c.chars and c.chars[1] for c in done], pa.int64()),
            pa.array([c.output for c in done], pa.binary()).cast(pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(documents: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars (null: plain), output."""
    if recipe.unit not in ("word", "char"):
        raise ValueError(f"the unit is 'word' or 'char', not {recipe.unit!r}")
    bounded_batches(documents.sparkSession)
    name = F.concat(F.lit(f"{recipe.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    hashed = documents.select(
        "doc_id",
        F.make_valid_utf8(F.coalesce("text", F.lit(""))).cast("binary").alias("raw"),
        F.sha2(name, 256).alias("digest"),
    )
    draws = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    id_type = documents.select("doc_id").schema[0].dataType.simpleString()
    schema = f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string"
    return hashed.select("doc_id", "raw", *draws).mapInArrow(lambda it: _cut_batches(it, recipe), schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    p, s, m = MARKS
    order = {"psm": (f"(?s)^{p}(.*?){s}(.*?){m}(.*)$", "$1$3$2"), "spm": (f"(?s)^{s}(.*?){p}(.*?){m}(.*)$", "$2$3$1")}
    text = output
    for name, (shape, parts) in order.items():
        text = F.when(form == name, F.regexp_replace(output, shape, parts)).otherwise(text)
    return text


def digests(cuts: DataFrame) -> DataFrame:
    """Rows of :func:`transform` with SHA-256 of output and rebuilt text instead of the output."""
    rebuilt = restored(F.col("output"), F.col("form"))
    return cuts.select(
        *(c for c in cuts.columns if c != "output"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(rebuilt, 256).alias("restored_sha256"),
    )
