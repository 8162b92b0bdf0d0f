"""Token files with Re-Pair grammar compression.

Documents are range-partitioned and sorted by doc_id, encoded with the tokenizers library
and written in that order, one Parquet row per shard of bounded size:

* ``part``, ``shard``: place of the shard in the global order;
* ``width``: bytes of a symbol (2 or 4, little-endian unsigned);
* ``sequence``: the symbols; below ``first_rule`` they are token ids;
* ``rules``: two symbols per nonterminal, from ``first_rule`` upwards; ``lengths``: ids that
  each nonterminal stands for (4 bytes each);
* ``doc_id``, ``n_symbols``, ``n_tokens``: per document, so that one document can be found and
  decoded alone.

Re-Pair runs on a shard in rounds. A round counts all pairs of neighbouring symbols inside
documents (equal symbols pair from the left of their run), takes the frequent ones in descending
order, as long as no symbol is a left side of one and a right side of another (so that no two
occurrences overlap) and replaces all their occurrences; after that only pairs beside a
replacement are counted anew. Rounds end when no pair is frequent or when symbols run out.

Every document ends with the id 0. Null and empty texts have that id only. Rows with equal
ids are ordered by their texts' hash; null ids come first. Repeated rows are stored row by
row. Other columns are ignored. An empty table writes files without rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from irregts.llm.common import bounded_batches, utf8
from irregts.llm.pieces import PieceEncoder, grouped

END = 0
#: Rules of a round, occurrences that make a pair frequent.
ROUND_RULES, FREQUENT = 1 << 14, 16
#: Bytes of text of a shard; distinct pieces that go through the library as one text, and
#: that a worker keeps.
SHARD_BYTES, LINES, KEEP = 6 << 20, 2000, 1_100_000
_HASH_BITS = 20


class LibraryEncoder:
    """The tokenizers library behind the piece encoder."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        (self.line_end,) = self._ids("\n").tolist()
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.texts = PieceEncoder(self._pieces, self._ids, specials[0] if specials else "\x01", KEEP).texts

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces. Many go through the library as the lines of one text: a line end
        between two pieces is a word of its own, so it tells them apart again."""
        lines = [p for p in pieces if p != "\n"]
        texts = ["\n".join(lines[i : i + LINES]) + "\n" for i in range(0, len(lines), LINES)]
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.int64), *(np.array(e.ids, np.int64) for e in encoded)])
        ends = np.flatnonzero(ids == self.line_end)
        counts = np.diff(ends, prepend=-1) - 1
        ids = ids[ids != self.line_end]
        if len(lines) < len(pieces):
            at = pieces.index("\n")
            ids = np.insert(ids, counts[:at].sum(), self.line_end)
            counts = np.insert(counts, at, 1)
        return ids, counts


@lru_cache(maxsize=2)
def library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


@dataclass
class Grammar:
    """A shard's symbols and rules; ``rules`` has a left and a right symbol per nonterminal."""

    first_rule: int
    rules: np.ndarray
    sequence: np.ndarray
    n_symbols: np.ndarray
    stored_lengths: np.ndarray | None = None

    def lengths(self) -> np.ndarray:
        """Ids that each nonterminal stands for: as stored, or added up from the first rule on."""
        if self.stored_lengths is not None:
            return self.stored_lengths
        n = len(self.rules)
        sizes = np.ones(self.first_rule + n, np.int64)
        done = 0
        for upto in self._runs():
            sizes[self.first_rule + done : self.first_rule + upto] = sizes[self.rules[done:upto]].sum(axis=1)
            done = upto
        return sizes[self.first_rule :]

    def _runs(self) -> Iterator[int]:
        """Ends of runs of rules that refer to no rule of their own run."""
        done, n = 0, len(self.rules)
        highest = self.rules.max(axis=1) - self.first_rule if n else np.zeros(0, np.int64)
        while done < n:
            ahead = np.flatnonzero(highest[done:] >= done)
            done = done + int(ahead[0]) if len(ahead) else n
            yield done

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All nonterminals' ids, one after the other, and their numbers. Rules refer to
        earlier ones only, so they are expanded in runs that do not refer to themselves."""
        ids, counts, done = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for upto in self._runs():
            new, new_counts = expand(self.rules[done:upto].ravel(), self.first_rule, ids, counts)
            ids, counts = np.concatenate([ids, new]), np.concatenate([counts, new_counts.reshape(-1, 2).sum(1)])
            done = upto
        return ids, counts

    def decode(self) -> np.ndarray:
        """All ids of the shard."""
        return expand(self.sequence.astype(np.int64), self.first_rule, *self._expansions())[0]

    def read(self, document: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the document at a place of the shard.

        The lengths tell which symbols reach into the wanted ids; level by level only those are
        replaced by their two symbols, so no other rule is looked at.
        """
        end = int(self.n_symbols[: document + 1].sum())
        symbols = self.sequence[end - int(self.n_symbols[document]) : end].astype(np.int64)
        lengths = self.lengths()
        while True:
            is_rule = symbols >= self.first_rule
            sizes = np.ones(len(symbols), np.int64)
            sizes[is_rule] = lengths[symbols[is_rule] - self.first_rule]
            ends = np.cumsum(sizes)
            stop = int(ends[-1]) if stop is None else min(stop, int(ends[-1]))
            if start >= stop:
                return np.zeros(0, np.int64)
            first, last = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop) + 1
            before = int(ends[first - 1]) if first else 0
            symbols, is_rule, start, stop = symbols[first:last], is_rule[first:last], start - before, stop - before
            if not is_rule.any():
                return symbols[start:stop]
            pairs = self.rules[symbols[is_rule] - self.first_rule]
            out = np.repeat(symbols, np.where(is_rule, 2, 1))
            out[np.repeat(is_rule, np.where(is_rule, 2, 1))] = pairs.ravel()
            symbols = out


def expand(symbols: np.ndarray, first_rule: int, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols as ids, given the expansions of the rules; also ids per symbol."""
    is_rule = symbols >= first_rule
    sizes = np.ones(len(symbols), np.int64)
    which = symbols[is_rule] - first_rule
    sizes[is_rule] = counts[which]
    out = np.repeat(symbols, sizes)
    if len(which):
        starts = np.cumsum(counts) - counts
        n = counts[which]
        before = np.cumsum(n) - n
        out[np.repeat(is_rule, sizes)] = ids[np.repeat(starts[which] - before, n) + np.arange(int(n.sum()))]
    return out, sizes


def _slots(keys: np.ndarray) -> np.ndarray:
    bits = 8 * keys.dtype.itemsize
    return (keys * keys.dtype.type(0x9E3779B97F4A7C15 >> (64 - bits) | 1)) >> keys.dtype.type(bits - _HASH_BITS)


def _frequent_pairs(keys: np.ndarray, slots: np.ndarray, void: np.ndarray, hashed: np.ndarray, least: int) -> np.ndarray:
    """Pairs that occur ``least`` times or more, most frequent first. The counts by hash rule most
    of the others out before the exact ones are made. ``void``: what does not count."""
    counted = np.flatnonzero((hashed >= least)[slots] & ~void)
    values, counts = np.unique(keys[counted], return_counts=True)
    values, counts = values[counts >= least], counts[counts >= least]
    return values[np.lexsort((values, -counts))]


def _neighbours(sequence: np.ndarray, last: np.ndarray, shift: int) -> tuple[np.ndarray, ...]:
    """Keys and slots of all pairs, which are of equal symbols, and which do not count: those
    across the end of a document, and of a run of one symbol every second, from the left."""
    keys = sequence[:-1] << sequence.dtype.type(shift) | sequence[1:]
    void = last[:-1].copy()
    equal = (sequence[:-1] == sequence[1:]) & ~void
    same = np.flatnonzero(equal)
    run = np.flatnonzero(np.diff(same, prepend=-2) != 1)
    offset = np.arange(len(same)) - np.repeat(run, np.diff(run, append=len(same)))
    void[same[offset % 2 == 1]] = True
    return keys, _slots(keys), equal, void


def re_pair(ids: np.ndarray, n_tokens: np.ndarray, first_rule: int, symbols: int) -> Grammar:
    """Compress the ids of documents that lie one after the other; at most ``symbols``
    symbols in all."""
    kind, shift = (np.uint32, 16) if symbols <= 1 << 16 else (np.uint64, 32)
    sequence = ids.astype(kind)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(n_tokens) - 1] = True
    rules = np.zeros((0, 2), np.int64)
    if len(sequence) > 1:
        keys, slots, equal, void = _neighbours(sequence, last, shift)
        hashed = np.bincount(slots[~void], minlength=1 << _HASH_BITS)
    while len(sequence) > 1:
        room = min(ROUND_RULES, symbols - first_rule - len(rules))
        values = _frequent_pairs(keys, slots, void, hashed, FREQUENT)
        lefts: set[int] = set()
        rights: set[int] = set()
        taken: set[int] = set()
        chosen: list[tuple[int, int]] = []
        # A pair whose slot is taken waits for the next round.
        pairs = values.astype(np.int64)
        offers = zip((pairs >> shift).tolist(), (pairs & ((1 << shift) - 1)).tolist(), _slots(values).tolist())
        for left, right, slot in offers:
            if len(chosen) >= room:
                break
            if left not in rights and right not in lefts and slot not in taken:
                lefts.add(left)
                rights.add(right)
                taken.add(slot)
                chosen.append((left, right))
        if not chosen:
            break
        pairs = np.array(chosen, np.int64)
        wanted = (pairs[:, 0] << shift | pairs[:, 1]).astype(kind)
        rule_of = np.full(1 << _HASH_BITS, -1, np.int16)
        rule_of[_slots(wanted)] = np.arange(len(wanted))
        rule = rule_of[slots]
        place = np.flatnonzero((rule >= 0) & ~void)
        place = place[wanted[rule[place]] == keys[place]]
        # Only pairs beside a replacement, and pairs of equal symbols, are counted anew.
        fresh = np.zeros(len(sequence), bool)
        fresh[place] = fresh[place + 1] = True
        gone = np.flatnonzero((fresh[:-1] | fresh[1:] | equal) & ~void)
        hashed -= np.bincount(slots[gone], minlength=len(hashed))
        sequence[place] = first_rule + len(rules) + rule[place].astype(kind)
        last[place] = last[place + 1]
        stays = np.ones(len(sequence), bool)
        stays[place + 1] = False
        kept = np.flatnonzero(stays)
        sequence, last, fresh = sequence[kept], last[kept], fresh[kept]
        rules = np.concatenate([rules, pairs])
        if len(sequence) > 1:
            keys, slots, equal, void = _neighbours(sequence, last, shift)
            new = np.flatnonzero((fresh[:-1] | fresh[1:] | equal) & ~void)
            hashed += np.bincount(slots[new], minlength=len(hashed))
    return Grammar(first_rule, rules, sequence, np.diff(np.flatnonzero(last), prepend=-1))


def _shards(batches: Iterator[pa.RecordBatch], path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    encoder = library(path)
    width = 2 if encoder.size < 1 << 16 else 4
    for shard, batch in enumerate(grouped(batches, least=SHARD_BYTES)):
        ids, counts = encoder.texts(batch.column("raw"))
        ids = np.insert(ids, np.cumsum(counts), END)
        counts = counts + 1
        packed = re_pair(ids, counts, encoder.size, 1 << 16 if width == 2 else 1 << 31)
        row = {
            "part": [part],
            "shard": [shard],
            "width": [width],
            "first_rule": [encoder.size],
            "rules": [packed.rules.astype(f"<u{width}").tobytes()],
            "lengths": [packed.lengths().astype("<u4").tobytes()],
            "sequence": [packed.sequence.astype(f"<u{width}").tobytes()],
            "doc_id": [batch.column("doc_id")],
            "n_symbols": [packed.n_symbols],
            "n_tokens": [counts],
        }
        yield pa.RecordBatch.from_arrays([pa.array(v, schema.field(k).type) for k, v in row.items()], schema=schema)


def write_token_files(documents: DataFrame, vocabulary: str, path: str) -> None:
    """Encode all documents and write their token files below ``path``."""
    bounded_batches(documents.sparkSession, SHARD_BYTES // 4)
    id_type = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.monotonically_increasing_id().alias("tie"), utf8().alias("raw")
    )
    order = ["doc_id", "text_key", "tie"]
    placed = texts.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "raw")
    schema = (
        "part int, shard int, width int, first_rule int, rules binary, lengths binary, sequence binary, "
        f"doc_id array<{id_type}>, n_symbols array<bigint>, n_tokens array<bigint>"
    )
    arrow = pa.schema(
        [(n, pa.int32()) for n in ("part", "shard", "width", "first_rule")]
        + [(n, pa.binary()) for n in ("rules", "lengths", "sequence")]
        + [("doc_id", pa.list_(_arrow_type(documents))), ("n_symbols", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64()))]
    )
    placed.mapInArrow(lambda it: _shards(it, vocabulary, arrow), schema).write.parquet(path)


def _arrow_type(documents: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(documents.schema["doc_id"].dataType)


def open_shard(row: dict) -> Grammar:
    """The grammar of one row of the files."""
    kind = f"<u{row['width']}"
    rules = np.frombuffer(row["rules"], kind).astype(np.int64).reshape(-1, 2)
    lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64) if "lengths" in row else None
    return Grammar(row["first_rule"], rules, np.frombuffer(row["sequence"], kind), np.array(row["n_symbols"], np.int64), lengths)


def _documents(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = memoryview(open_shard(row).decode().astype("<u4")).cast("B")
            ends = np.cumsum(row["n_tokens"])
            begins = ends - row["n_tokens"]
            crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
            n = len(crcs)
            columns = [[row["part"]] * n, [row["shard"]] * n, row["doc_id"], begins, row["n_tokens"], crcs]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the token files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it. One sum per shard and one per part
    carry the counts over.
    """
    bounded_batches(spark)
    files = spark.read.parquet(path)
    element = files.schema["doc_id"].dataType.elementType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.schema(
        [("part", pa.int32()), ("shard", pa.int32()), ("doc_id", to_arrow_type(element))]
        + [(n, pa.int64()) for n in ("ahead", "n_tokens", "ids_crc32")]
    )
    schema = f"part int, shard int, doc_id {element.simpleString()}, ahead bigint, n_tokens bigint, ids_crc32 bigint"
    found = files.select(
        "part", "shard", "width", "first_rule", "rules", "sequence", "doc_id", "n_symbols", "n_tokens"
    ).mapInArrow(lambda it: _documents(it, arrow), schema)

    size = F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, b: a + b)
    shards = files.select("part", "shard", size.alias("n"))
    parts = shards.groupBy("part").agg(F.sum("n").alias("m"))
    parts = parts.withColumn("before", F.sum("m").over(W.orderBy("part")) - F.col("m")).select("part", "before")
    inside = W.partitionBy("part").orderBy("shard")
    bases = shards.withColumn("before_shard", F.sum("n").over(inside) - F.col("n")).join(parts, "part")
    bases = bases.select("part", "shard", (F.col("before") + F.col("before_shard")).alias("base"))
    return found.join(bases, ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32"
    )


def _places(batches: Iterator[pa.RecordBatch], start: int, stop: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = open_shard(row)
            for place in row["places"]:
                ids = shard.read(place, start, stop)
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64()))], names=["ids"])


def read_ids(spark: SparkSession, path: str, doc_id: object, start: int = 0, stop: int | None = None) -> DataFrame:
    """The ids of all documents with one id (null is one), or a slice of them, one row each.

    Only shards that list the id are opened, and in them only the rules that the wanted ids need.
    """
    bounded_batches(spark)
    files = spark.read.parquet(path)
    wanted = F.lit(doc_id).cast(files.schema["doc_id"].dataType.elementType)
    found = F.transform("doc_id", lambda x, i: F.when(x.eqNullSafe(wanted), i))
    files = files.withColumn("places", F.array_compact(found)).filter(F.size("places") > 0).drop("doc_id")
    return files.mapInArrow(lambda it: _places(it, start, stop), "ids array<bigint>")
