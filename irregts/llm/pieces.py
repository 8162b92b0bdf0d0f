"""Cutting texts at places where the byte-level pattern always cuts, so that pieces repeat.

The pattern of byte-level BPE never spans a space that follows a character other than white
space, nor a line end between two such characters. Texts are cut there by Arrow, and only
distinct pieces are encoded. Texts for which that does not hold (runs of white space, other
white space, special tokens, the separator itself) are encoded whole, slice by slice.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = "\x01"
#: Bytes of text that a worker gathers before it encodes them, over whole documents.
GROUP_BYTES = 4 << 20
#: Characters of a slice of a text that is encoded whole; distinct pieces that a worker keeps.
SLICE, CACHE = 1 << 20, 500_000

_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_CUT = re.compile(r"(?<=\S) (?=\S)")

#: Distinct pieces to their ids (one after the other) and the number of ids of each.
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def slices(text: str) -> Iterator[str]:
    """The text in slices of about ``SLICE`` characters, cut where the pattern always cuts."""
    at = 0
    while len(text) - at > SLICE and (cut := _CUT.search(text, at + SLICE)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class PieceEncoder:
    """Encodes texts piece by piece, remembering pieces up to a bound."""

    def __init__(self, encode: Encode, whole: Callable[[str], np.ndarray], special: str, keep: int = CACHE) -> None:
        self.encode, self.whole, self.special, self.keep = encode, whole, special, keep
        self.place: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.counts, self.starts, self.used = (np.zeros(0, np.int64) for _ in range(3))

    def is_plain(self, piece: str) -> bool:
        """Whether a piece can be encoded by itself wherever it was cut out."""
        return piece not in ("", " ") and self.special not in piece and not _OTHER_SPACE.search(piece)

    def _forget(self) -> None:
        """Keep the pieces that were met more than once since the last time."""
        kept = self.used > 1
        order = np.flatnonzero(kept)
        self.ids = self.ids[np.repeat(kept, self.counts)]
        self.counts, self.used = self.counts[order], np.zeros(len(order), np.int64)
        names = list(self.place)
        self.place = {names[i]: k for k, i in enumerate(order.tolist())}

    def _places(self, pieces: list[str], times: np.ndarray) -> np.ndarray:
        """Where the encodings of pieces are; -1 for one that is not plain. ``times``: how
        often each was met."""
        at = self._known(pieces)
        missing = np.flatnonzero(at < 0)
        if len(self.place) + len(missing) > self.keep:
            self._forget()
            at = self._known(pieces)
            missing = np.flatnonzero(at < 0)
        plain = [i for i in missing.tolist() if self.is_plain(pieces[i])]
        if plain:
            new = [pieces[i] for i in plain]
            ids, counts = self.encode(new)
            at[plain] = np.arange(len(self.place), len(self.place) + len(new))
            self.place.update(zip(new, at[plain].tolist()))
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.counts = np.concatenate([self.counts, counts])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.starts = np.cumsum(self.counts) - self.counts
        self.used[at[at >= 0]] += times[at >= 0]
        return at

    def _known(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))

    def texts(self, raws: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text (int32), and the number of ids of each text."""
        texts = raws.cast(pa.string())
        marked = pc.replace_substring(pc.replace_substring(texts, "\n", "\x01\n\x01"), " ", "\x01 ")
        cut = pc.split_pattern(marked, SEPARATOR)
        del marked
        ends = cut.offsets.to_numpy()[1:].astype(np.int64) - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        del cut
        codes = coded.indices.to_numpy()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = self._places(pieces, np.bincount(codes, minlength=len(pieces)))[codes]
        del pieces
        odd = np.array(pc.match_substring(texts, SEPARATOR).to_pylist(), bool)
        strange = np.flatnonzero(at < 0)
        odd[np.searchsorted(ends, strange, side="right")] = True
        sizes = np.append(self.counts, 0)[at]  # the last for pieces without a place
        if odd.any():
            sizes[np.repeat(odd, np.diff(ends, prepend=0))] = 0
        upto = np.cumsum(sizes)
        total = int(upto[-1]) if len(upto) else 0
        begin = np.append(self.starts, 0)[at] - (upto - sizes)
        ids = self.ids[np.repeat(begin, sizes) + np.arange(total)]
        counts = np.diff(upto[ends - 1], prepend=0) if len(texts) else np.zeros(0, np.int64)
        if not odd.any():
            return ids, counts
        regular = np.cumsum(counts)  # ids of the other texts up to here
        parts, before = [], 0
        for k in np.flatnonzero(odd).tolist():
            ahead = int(regular[k])
            own = [self.whole(s).astype(np.int32) for s in slices(texts[k].as_py()) if s]
            parts += [ids[before:ahead], *own]
            counts[k], before = sum(map(len, own)), ahead
        return np.concatenate([*parts, ids[before:]]), counts


def grouped(batches: Iterator[pa.RecordBatch], name: str = "raw", least: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches joined to about ``least`` bytes of text each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(name).nbytes
        if size >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and (rest := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield rest[0]
