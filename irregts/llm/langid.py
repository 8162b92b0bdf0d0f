"""Language ID with language-bitmask n-gram filters.

Each language owns a Bloom filter of the byte n-grams typical of it. The filters are
bit-sliced: one array of slots, in which bit l of a slot belongs to language l (slots have as many
64-bit words as the languages need), so that the AND of an n-gram's slots is the set of all
languages that hold it. A text's n-grams are
looked up together, set bits are counted per language, and each count is corrected for the
false positives that the filter's fill lets one expect. The largest corrected count wins.

Learning takes a bounded sample: about ``SAMPLE`` documents per language, by hash. Filters of 64
languages have a fixed size; of more than ``LANGUAGES`` distinct values of lang the most frequent
are learned, which bounds what is sent to tasks.

A text that is null, empty or without a letter is ``und`` with score 0. Rows without text
or language teach nothing. Ties go to the language that sorts first. With nothing to learn
from, every text is ``und``. Repeated rows are predicted row by row. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from irregts.llm.common import LOWER, small_batches, unused, utf8

SIZES = (2, 3, 4)
#: Expected number of learning documents per language; typical n-grams kept per language.
SAMPLE, TYPICAL = 2000, 30_000
#: Slots of the bit-sliced filter and hash functions; languages that are learned at most.
SLOTS, HASHES, LANGUAGES = 1 << 20, 2, 1024
#: An n-gram is typical where its share is at least this part of its largest share.
NEAR = 0.5
#: Bytes looked up at once.
BLOCK = 1 << 20

_BYTES = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in LOWER)


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit keys of all runs of ``size`` bytes that hold a byte of a letter."""
    n = max(0, len(data) - size + 1)
    keys = np.full(n, size << 32, np.uint64)
    letters = np.zeros(n, bool)
    for j in range(size):
        part = data[j : j + n]
        keys |= part.astype(np.uint64) << np.uint64(8 * j)
        letters |= part != 32
    return keys[letters]


def slots(keys: np.ndarray) -> list[np.ndarray]:
    mixed = keys * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return [(mixed >> np.uint64(64 - 20 * (i + 1))) & np.uint64(SLOTS - 1) for i in range(HASHES)]


def plain(raw: bytes) -> np.ndarray:
    """The text with a space on either side and all that is no letter as spaces."""
    return np.frombuffer(b" " + raw.translate(_BYTES) + b" ", np.uint8)


def has_letter(raw: bytes) -> bool:
    spaced = raw.translate(_BYTES)
    if not spaced.isascii():
        return any(c.isalpha() for c in raw.decode("utf-8", "replace"))
    return not spaced.isspace() and bool(spaced)


@dataclass
class LanguageFilter:
    """languages in sorted order, the slots' bit masks, and each filter's fill."""

    languages: list[str]
    masks: np.ndarray
    fill: np.ndarray

    @classmethod
    def build(cls, languages: list[str], keys: np.ndarray, owner: np.ndarray) -> LanguageFilter:
        words = max(1, -(-len(languages) // 64))
        masks = np.zeros((SLOTS, words), np.uint64)
        bits, word = np.uint64(1) << (owner % 64).astype(np.uint64), (owner // 64).astype(np.int64)
        for at in slots(keys):
            np.bitwise_or.at(masks, (at.astype(np.int64), word), bits)
        fill = np.array([(masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(languages))])
        return cls(languages, masks[:, 0] if words == 1 else masks, fill)

    def counts(self, raw: bytes) -> tuple[np.ndarray, int]:
        """Corrected count per language, and the number of n-grams looked up."""
        data = plain(raw)
        held, total = np.zeros(len(self.languages)), 0
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK + max(SIZES) - 1]
            for size in SIZES:
                keys = grams(block[: BLOCK + size - 1], size)
                found = None
                for where in slots(keys):
                    found = self.masks[where] if found is None else found & self.masks[where]
                total += len(keys)
                found = found.reshape(len(keys), self.masks.size // SLOTS)
                held += [np.count_nonzero(found[:, i // 64] & np.uint64(1 << i % 64)) for i in range(len(self.languages))]
        false = self.fill**HASHES
        return np.maximum(0.0, (held - total * false) / np.maximum(1e-9, 1 - false)), total

    def predict(self, raw: bytes) -> tuple[str, float]:
        if not self.languages or not has_letter(raw):
            return "und", 0.0
        counts, total = self.counts(raw)
        best = int(np.argmax(counts))
        return self.languages[best], float(min(1.0, counts[best] / max(1, total)))


def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        raws = batch.column("raw").to_pylist()
        for lang in sorted(set(langs.tolist())):
            data = np.concatenate([plain(raws[i]) for i in np.flatnonzero(langs == lang)])
            for size in SIZES:
                keys, counts = np.unique(grams(data, size), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)],
                    names=["lang", "key", "n"],
                )


def learn(documents: DataFrame, sample: int = SAMPLE, typical: int = TYPICAL) -> LanguageFilter:
    """Filters from the documents that have text and language.

    About ``sample`` documents of each language are used, those of smallest hash; at most
    ``typical`` n-grams of each language reach the driver.
    """
    small_batches(documents.sparkSession)
    known = documents.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return LanguageFilter.build([], np.zeros(0, np.uint64), np.zeros(0, np.int64))
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    shares = [(r["lang"], min(1.0, sample / r["n"])) for r in sizes]
    shares = F.broadcast(documents.sparkSession.createDataFrame(shares, "lang string, share double"))  # LANGUAGES rows
    chosen = known.select("lang", "text").join(shares, "lang").filter(draw < F.col("share")).select("lang", utf8().alias("raw"))
    counts = chosen.mapInArrow(_key_counts, "lang string, key long, n long")
    counts = counts.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(W.partitionBy("lang"))
    shares = counts.withColumn("share", F.col("n") / total)
    shares = shares.withColumn("largest", F.max("share").over(W.partitionBy("key")))
    first = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "key"))
    kept = shares.filter(F.col("share") >= NEAR * F.col("largest")).withColumn("place", first)
    found = kept.filter(F.col("place") <= typical).select("lang", "key").toPandas()
    owner = found["lang"].map({lang: i for i, lang in enumerate(languages)}).to_numpy()
    return LanguageFilter.build(languages, found["key"].to_numpy(np.int64).view(np.uint64), owner)


def prediction(model: LanguageFilter, text: str = "text") -> Column:
    """Struct column (lang_pred, score) of a text column."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(raws: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(raw) for raw in raws], columns=["lang_pred", "score"])

    return predict(utf8(text))


def with_language(documents: DataFrame, model: LanguageFilter, least: float) -> DataFrame:
    """The documents whose language is known with a score of at least ``least``."""
    small_batches(documents.sparkSession)
    names = documents.columns
    name = unused(documents, "guess")
    guess = documents.withColumn(name, prediction(model))
    sure = (F.col(name)["lang_pred"] != "und") & (F.col(name)["score"] >= least)
    return guess.filter(sure).select(names)
