"""Ranked lexical search of items in documents by Aho-Corasick scans, without a document index.

All terms of the items form one automaton, each guarded by a space on both sides; a text whose
other bytes are spaces then matches a pattern exactly where it has that term. Two scans of the
documents do everything: the first adds up the corpus totals and each term's document frequency,
the second counts a document's term frequencies, adds each term's part to the scores of the items
that the automaton's output maps to, and keeps the best documents of each item in the task. Only
those, and one vector of totals a task, leave the tasks.

What goes to the tasks is cut in blocks of items with at most ``BLOCK_ENTRIES`` terms, counted per
item, and ``BLOCK_ITEMS`` items (an item with more terms is a block of its own); documents are
scanned twice for each block. The best of a task are merged in two steps, by groups of tasks and
then by item, so no item meets the results of all tasks at once.

Terms are maximal runs of digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII.
Rows of ``items`` with one item_id (null is an id) are one item with the terms of all of them.
Every row of ``documents`` is a document: repeated rows rank one after the other. doc_id is an
integer; null comes before all others among equal scores. Null and empty texts have no terms; items
without terms and documents without a score get no rows; empty tables give an empty result. Other
columns are ignored whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from irregts.llm.common import WORD_BYTES, bounded_batches, utf8
from irregts.operators.vectors import sum_vectors, vector_row
from irregts.session import materialise

#: Terms (counted once per item) and items of a block.
BLOCK_ENTRIES, BLOCK_ITEMS = 1 << 18, 1 << 13
#: Groups of tasks whose best documents are merged first.
MERGES = 64
GUARD = " "


def _spaced(raw: bytes) -> str:
    """A text between guards, one character a byte, with spaces for what belongs to no term."""
    return GUARD + raw.translate(WORD_BYTES).decode("latin-1") + GUARD


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [sorted(set(raw.translate(WORD_BYTES).split())) for raw in batch.column("raw").to_pylist()]
        sizes = [len(t) for t in terms]
        ids = batch.column("item_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        flat = pa.array([t for each in terms for t in each], pa.binary())
        yield pa.RecordBatch.from_arrays([ids, flat], names=["item_id", "term"])


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: each term of an item once, written."""
    id_type = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", utf8().alias("raw")).mapInArrow(_item_terms, f"item_id {id_type}, term binary")
    return materialise(rows.distinct(), "item_terms")


def blocks(terms: DataFrame, entries: int = BLOCK_ENTRIES, items: int = BLOCK_ITEMS) -> list[DataFrame]:
    """The rows of :func:`item_terms` in blocks of whole items, by hash of the id. No block of
    several items is above the bounds; two numbers per block reach the driver."""
    sizes = materialise(terms.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")), "item_sizes")
    total, owners = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    count = max(1, -(-total // entries), -(-owners // items))
    while True:
        block = F.pmod(F.xxhash64("item_id"), F.lit(count))
        found = sizes.groupBy(block.alias("block")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("items")).collect()
        if all(r["items"] == 1 or (r["n"] <= entries and r["items"] <= items) for r in found):
            return [terms.filter(block == r["block"]) for r in sorted(found, key=itemgetter("block"))]
        count *= 2


class Block:
    """The items of a block and their terms: ``owners[first[t]:first[t + 1]]`` are the items,
    as places in ``ids``, that have term t."""

    def __init__(self, rows: pa.Table) -> None:
        items = rows["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        terms = rows["term"].combine_chunks().dictionary_encode()
        self.key = uuid.uuid4().hex
        self.ids = items.dictionary
        self.terms: list[bytes] = terms.dictionary.to_pylist()
        of_term = terms.indices.to_numpy()
        order = np.argsort(of_term, kind="stable")
        self.owners = items.indices.to_numpy()[order].astype(np.int32)
        self.first = np.searchsorted(of_term[order], np.arange(len(self.terms) + 1))

    def automaton(self) -> ahocorasick.Automaton:
        """Built once in a worker, kept until another block is asked for."""
        if self.key not in _BUILT:
            _BUILT.clear()
            made = ahocorasick.Automaton()
            for number, term in enumerate(self.terms):
                made.add_word(GUARD + term.decode("latin-1") + GUARD, number)
            made.make_automaton()
            _BUILT[self.key] = made
        return _BUILT[self.key]


_BUILT: dict[str, ahocorasick.Automaton] = {}


def _length(spaced: str) -> int:
    """The number of terms of a text between guards."""
    inside = np.frombuffer(spaced.encode("latin-1"), np.uint8) != 32
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]))


def _frequencies(automaton: ahocorasick.Automaton, spaced: str) -> tuple[np.ndarray, np.ndarray]:
    """Terms of the automaton that a text has, and how often."""
    hits = np.fromiter(map(itemgetter(1), automaton.iter(spaced)), np.int64)
    return np.unique(hits, return_counts=True)


def _totals(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    """One vector: documents with a term, their terms, then documents per term of the block."""
    automaton = block.automaton()
    total = np.zeros(len(block.terms) + 2, np.int64)
    for batch in batches:
        for raw in batch.column("raw"):
            spaced = _spaced(raw.as_py())
            if n := _length(spaced):
                total[:2] += 1, n
                total[2 + _frequencies(automaton, spaced)[0]] += 1
    yield vector_row(total)


class Best:
    """The best documents of each item so far."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.least = k, np.ones(items, np.int64)
        self.room = max(4 * k * items, 1 << 16)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def offer(self, doc_id: int | None, scores: np.ndarray) -> None:
        items = np.flatnonzero(scores >= self.least)
        if not len(items):
            return
        named = doc_id is not None
        self.held.append((items, scores[items], np.full(len(items), named), np.full(len(items), doc_id or 0)))
        self.size += len(items)
        if self.size > self.room:
            self.prune()

    def prune(self) -> tuple[np.ndarray, ...]:
        """Keep k rows of each item: item, score, whether its document has an id, the id."""
        kinds = (np.int64, np.int64, bool, np.int64)
        columns = [np.concatenate([np.zeros(0, t), *(h[i] for h in self.held)]) for i, t in enumerate(kinds)]
        item, score, named, doc_id = columns
        order = np.lexsort((doc_id, named, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = order[place < self.k]
        full = order[place == self.k - 1]
        self.least[columns[0][full]] = score[full]
        rows = tuple(c[kept] for c in columns)
        self.held, self.size = [rows], len(kept)
        self.room = max(self.room, 2 * self.size)
        return rows


def _scored(
    batches: Iterator[pa.RecordBatch], block: Block, weights: np.ndarray, n_docs: int, n_terms: int, k: int
) -> Iterator[pa.RecordBatch]:
    automaton, best = block.automaton(), Best(len(block.ids), k)
    first, owners = block.first, block.owners
    spread = np.diff(first)
    for batch in batches:
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw")):
            spaced = _spaced(raw.as_py())
            terms, tf = _frequencies(automaton, spaced)
            if not len(terms):
                continue
            m = 50 + 50 * _length(spaced) * n_docs // n_terms
            part = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            sizes = spread[terms]
            ends = np.cumsum(sizes)
            place = np.repeat(first[terms] - (ends - sizes), sizes) + np.arange(ends[-1])
            scores = np.zeros(len(block.ids), np.int64)
            np.add.at(scores, owners[place], np.repeat(part, sizes))
            best.offer(doc_id, scores)
    item, score, named, doc_id = best.prune()
    ids = pa.array(doc_id, pa.int64(), mask=~named)
    yield pa.RecordBatch.from_arrays([block.ids.take(pa.array(item)), ids, pa.array(score)], names=["item_id", "doc_id", "score"])


def _top(df: DataFrame, k: int, *within: str) -> DataFrame:
    window = W.partitionBy(*within).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def search(documents: DataFrame, items: DataFrame, k: int = 50, entries: int = BLOCK_ENTRIES) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank from 1, doc_id, score."""
    spark = documents.sparkSession
    bounded_batches(spark)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("raw"))
    id_type = items.schema["item_id"].dataType.simpleString()
    schema = f"item_id {id_type}, doc_id long, score long"
    found = spark.createDataFrame([], f"{schema}, part long")
    for rows in blocks(item_terms(items), entries):
        block = spark.sparkContext.broadcast(Block(rows.toArrow()))
        totals = sum_vectors(texts.mapInArrow(lambda it, b=block: _totals(it, b.value), "values binary"), "int64")
        if totals is None or not totals[0]:
            continue
        n_docs, n_terms = totals[:2].tolist()
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in totals[2:].tolist()], np.int64)
        send = spark.sparkContext.broadcast((weights, n_docs, n_terms))
        best = texts.mapInArrow(lambda it, b=block, s=send: _scored(it, b.value, *s.value, k), schema)
        best = best.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGES)).cast("long"))
        found = found.union(materialise(best, "best"))
    merged = materialise(_top(found, k, "item_id", "part").drop("rank", "part"), "merged")
    return _top(merged, k, "item_id").select("item_id", "rank", "doc_id", "score")
