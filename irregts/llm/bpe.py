"""Byte-level BPE encoding by a pair occurrence index, and decoding.

The distinct pieces of a partition's texts lie in one array of symbols. An index maps each
mergeable pair (by its rank) to all its places. Active ranks are taken in ascending order;
all places of a rank are merged at once, and the pairs that the merge makes or breaks on
either side update the lists of their ranks. Pieces never touch, so a rank is applied to
all of them together and the result is that of merging piece by piece.

The vocabulary file is a parameter; it is read where it is used and never written.

Nulls and empty texts have no ids and decode to the empty text. Texts of any length are cut
into slices at places where the pattern always cuts. The special token's string in a text is
its id, as the library has it. Repeated rows are encoded row by row; other columns are kept,
those called ``ids`` or ``decoded`` replaced. Bytes that are not UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irregts.llm.common import small_batches, unused
from irregts.llm.pieces import PieceEncoder, grouped

# The split pattern of byte-level BPE (fixed value of the format).
PATTERN = regex.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1
    stands for itself, the others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """Ids, merges by rank and token bytes of a byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, added = spec["model"], spec["added_tokens"]
        ids = model["vocab"]
        letters = byte_characters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = np.array([ids[c] for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        keys = self.left << 32 | self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.special = {t["content"]: t["id"] for t in added}
        tokens = [(i, bytes(byte_of[c] for c in t)) for t, i in ids.items()]
        tokens += [(i, t.encode()) for t, i in self.special.items()]
        sizes = np.zeros(1 + max(i for i, _ in tokens), np.int64)
        for i, t in tokens:
            sizes[i] = len(t)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(t for _, t in sorted(dict(tokens).items())), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it is never merged."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids, one token after the other."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes()


class PairIndex:
    """Symbols of many words and, per active rank, the places of its pair."""

    def __init__(self, vocabulary: Vocabulary, words: list[bytes]) -> None:
        self.vocabulary = vocabulary
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(lengths)
        self.symbols = vocabulary.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(self.symbols)
        self.next, self.previous = np.arange(1, n + 1), np.arange(-1, n - 1)
        self.next[self.ends - 1] = -1
        self.previous[self.ends - lengths] = -1
        self.places: dict[int, list[np.ndarray]] = defaultdict(list)
        self.active: list[int] = []
        first = np.flatnonzero(self.next >= 0)
        self._add(first, first + 1)

    def _add(self, at: np.ndarray, after: np.ndarray) -> None:
        """Enter the pairs at places ``at`` and ``after`` into the lists of their ranks."""
        ranks = self.vocabulary.ranks(self.symbols[at], self.symbols[after])
        known = np.flatnonzero(ranks >= 0)
        if not len(known):
            return
        by_rank = known[np.argsort(ranks[known], kind="stable")]
        at, ranks = at[by_rank], ranks[by_rank]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, part in zip(ranks[np.r_[0, cuts]].tolist(), np.split(at, cuts) if len(cuts) else [at]):
            if rank not in self.places:
                heapq.heappush(self.active, rank)
            self.places[rank].append(part)

    def _apply(self, rank: int) -> None:
        lists = self.places.pop(rank)
        at = np.sort(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
        at = at[np.r_[True, at[1:] != at[:-1]]]
        left, right = self.vocabulary.left[rank], self.vocabulary.right[rank]
        after = self.next[at]
        valid = (self.symbols[at] == left) & (after >= 0)
        valid &= self.symbols[after] == right
        at, after = at[valid], after[valid]
        if left == right and len(at) > 1:  # in a run every second place is merged
            fresh = np.r_[True, at[1:] != after[:-1]]
            start = np.flatnonzero(fresh)
            even = (np.arange(len(at)) - start[np.cumsum(fresh) - 1]) % 2 == 0
            at, after = at[even], after[even]
        if not len(at):
            return
        beyond = self.next[after]
        self.symbols[at], self.symbols[after] = self.vocabulary.merged[rank], -1
        self.next[at] = beyond
        open_ = beyond >= 0
        self.previous[beyond[open_]] = at[open_]
        before = self.previous[at]
        has = before >= 0
        self._add(np.concatenate([before[has], at[open_]]), np.concatenate([at[has], beyond[open_]]))

    def encode(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each."""
        while self.active:
            self._apply(heapq.heappop(self.active))
        alive = self.symbols >= 0
        upto = np.cumsum(alive)[self.ends - 1]
        return self.symbols[alive], np.diff(upto, prepend=0)


class BpeCodec:
    """Encodes and decodes texts with one vocabulary."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.special_id = self.vocabulary.special
        names = "|".join(regex.escape(s) for s in sorted(self.special_id, key=len, reverse=True))
        self._specials = regex.compile(f"({names})") if names else None
        marks = next(iter(self.special_id), "\x01")
        self.encoder = PieceEncoder(self._pieces, self._whole, marks)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, which the pattern does not split further, and their numbers."""
        place = {w: i for i, w in enumerate(dict.fromkeys(words))}
        if not place:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids, counts = PairIndex(self.vocabulary, [w.encode() for w in place]).encode()
        if len(place) == len(words):
            return ids, counts
        starts = np.cumsum(counts) - counts
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        sizes = counts[at]
        ends = np.cumsum(sizes)
        return ids[np.repeat(starts[at] - (ends - sizes), sizes) + np.arange(ends[-1])], sizes

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # A run of letters, after at most one space, is a word as it is.
        split = [[p] if p.removeprefix(" ").isalpha() else PATTERN.findall(p) for p in pieces]
        ids, counts = self._words([w for words in split for w in words])
        upto = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        return ids, np.diff(np.cumsum(counts)[upto - 1], prepend=0)

    def _whole(self, text: str) -> np.ndarray:
        parts = self._specials.split(text) if self._specials else [text]
        out = []
        for part in parts:
            if part in self.special_id:
                out.append(np.array([self.special_id[part]], np.int64))
            elif part:
                out.append(self._words(PATTERN.findall(part))[0])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of sequences of ids that lie one after the other."""
        ends = np.cumsum(counts).tolist()
        return [self.vocabulary.decode(ids[a:b]).decode("utf-8", "replace") for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def codec(path: str) -> BpeCodec:
    return BpeCodec(path)


def encode(documents: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """The documents with a column ``ids`` (array<int>) in place of ``text``; with ``decoded``
    also the text that the ids decode to, made by the same worker. Columns of these names are
    replaced. Bytes that are not UTF-8 count as U+FFFD."""
    small_batches(documents.sparkSession)
    raw = unused(documents, "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, raw):
            ids, counts = codec(path).encoder.texts(batch.column(raw))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            columns = {c: batch.column(c) for c in batch.schema.names if c != raw}
            columns["ids"] = pa.ListArray.from_arrays(offsets, pa.array(ids))
            if decoded:
                columns["decoded"] = pa.array(codec(path).decode(ids, counts), pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kept = documents.drop("text", "ids", *(["decoded"] if decoded else []))
    valid = F.make_valid_utf8(F.coalesce(F.col("text"), F.lit(""))).cast("binary")
    prepared = documents.select(*kept.columns, valid.alias(raw))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return prepared.mapInArrow(run, f"{fields}{', ' if fields else ''}ids array<int>{', decoded string' if decoded else ''}")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``, the text of the column ``ids``."""

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        counts = np.diff(ids.offsets.to_numpy()) if len(ids) else np.zeros(0, np.int64)
        return pa.array(codec(path).decode(flat, counts), pa.string())

    return tokens.withColumn("decoded", text("ids"))


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded and decoded documents."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
