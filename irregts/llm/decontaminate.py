"""Benchmark decontamination: a prefix-filtered set join of windows and documents.

A benchmark item is cut into windows of ten consecutive words. A window is a set of
shingles (three words; fewer where the window is shorter). A document contains a window
only if it holds each of its shingles, so one shingle, the window's rarest in the corpus,
is a sufficient prefix. Documents are scanned against a bit map of those prefixes, which
has a fixed size whatever the benchmark's; places that hit it are joined to the windows on
the shingle's hash, cut by position (the window must begin and end inside the document)
and verified word by word.

Nulls and empty texts have no words. Items without words are no window; a null item_id
marks words but is no item. Repeated rows are reported row by row. An empty benchmark
leaves all documents clean. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from irregts.llm.common import WORD_BYTES, same_document, small_batches, utf8
from irregts.session import materialise

WINDOW, SHINGLE = 10, 3
#: Slots of the prefix map: the bound of what is sent to the executors (one bit each).
SLOTS = 1 << 22


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased runs of letters a-z, digits and non-ASCII characters."""
    return raw.translate(WORD_BYTES).split()


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` entries of an array of word hashes."""
    n = max(0, len(words) - size + 1)
    mixed = np.full(n, size, np.uint64)
    for j in range(size):
        mixed = (mixed ^ words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def _cut_items(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Each window of each item: its words, their number, its shingles' size and hashes."""
    for batch in batches:
        out = {"item_id": [], "window": [], "n": [], "size": [], "shingles": []}
        for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(raw)
            if not words:
                continue
            n = min(window, len(words))
            size = min(SHINGLE, n)
            hashes = shingle_hashes(_word_hashes(words), size).view(np.int64)
            for i in range(len(words) - n + 1):
                out["item_id"].append(item)
                out["window"].append(b" ".join(words[i : i + n]).decode())
                out["n"].append(n)
                out["size"].append(size)
                out["shingles"].append(hashes[i : i + n - size + 1].tolist())
        yield pa.RecordBatch.from_pydict(out, schema=_ITEM_SCHEMA)


_ITEM_SCHEMA = pa.schema(
    [("item_id", pa.string()), ("window", pa.string()), ("n", pa.int32()), ("size", pa.int32()), ("shingles", pa.list_(pa.int64()))]
)


class PrefixMap:
    """Which slots hold a shingle, per shingle size. At most ``SLOTS`` bits a size."""

    def __init__(self, shingles: DataFrame) -> None:
        """``shingles``: size, h. At most SLOTS slot numbers a size reach the driver."""
        slots = shingles.select("size", F.col("h").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot"))
        found = slots.distinct().toArrow()
        sizes, numbers = found["size"].to_numpy(), found["slot"].to_numpy()
        self.packed: dict[int, bytes] = {}
        for size in sorted(set(sizes.tolist())):
            bits = np.zeros(SLOTS, np.uint8)
            bits[numbers[sizes == size]] = 1
            self.packed[size] = np.packbits(bits).tobytes()

    def open(self) -> dict[int, np.ndarray]:
        return {s: np.unpackbits(np.frombuffer(b, np.uint8)).view(bool) for s, b in self.packed.items()}


class _Scan:
    """The words of a batch of documents and the places where their shingles are in a map."""

    def __init__(self, raws: list[bytes]) -> None:
        per_text = [words_of(raw) for raw in raws]
        self.counts = np.array([len(w) for w in per_text], np.int64)
        self.ends = np.cumsum(self.counts)
        self.words = [w for words in per_text for w in words]
        self.hashes = _word_hashes(self.words)

    def hits(self, maps: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """size, place in the batch, document and hash of shingles that lie in one document."""
        for size, bits in maps.items():
            hashes = shingle_hashes(self.hashes, size)
            at = np.flatnonzero(bits[hashes & np.uint64(SLOTS - 1)])
            doc = np.searchsorted(self.ends, at, side="right")
            inside = at + size <= self.ends[doc] if len(at) else np.zeros(0, bool)
            yield size, at[inside], doc[inside], hashes[at[inside]].view(np.int64)


def _count_hits(batches: Iterator[pa.RecordBatch], prefixes: PrefixMap) -> Iterator[pa.RecordBatch]:
    maps = prefixes.open()
    for batch in batches:
        for _, _, _, hashes in _Scan(batch.column(0).to_pylist()).hits(maps):
            values, counts = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["h", "n"])


_PLACE = pa.list_(
    pa.struct([("h", pa.int64()), ("pos", pa.int64()), ("lead", pa.int32()), ("context", pa.string())])
)


def _find_places(batches: Iterator[pa.RecordBatch], prefixes: PrefixMap, window: int) -> Iterator[pa.RecordBatch]:
    """Words of each document, and the surroundings of each place that hits the map."""
    maps = prefixes.open()
    for batch in batches:
        scan = _Scan(batch.column("raw").to_pylist())
        starts = scan.ends - scan.counts
        places: list[list[dict]] = [[] for _ in scan.counts]
        for _, at, doc, hashes in scan.hits(maps):
            for i, d, h in zip(at.tolist(), doc.tolist(), hashes.tolist()):
                first, last = max(int(starts[d]), i - window + 1), min(int(scan.ends[d]), i + window)
                context = b" ".join(scan.words[first:last]).decode()
                places[d].append({"h": h, "pos": i - int(starts[d]), "lead": i - first, "context": context})
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(scan.counts), pa.array(places, _PLACE)],
            names=["doc_id", "text_key", "n_words", "places"],
        )


def _prefixes(benchmark: DataFrame, texts: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows with their rarest shingle (by the corpus, over all documents), and
    the items of each."""
    raw_items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), utf8().alias("raw"))
    cut = materialise(
        raw_items.mapInArrow(
            lambda it: _cut_items(it, window), "item_id string, window string, n int, size int, shingles array<long>"
        ),
        "windows",
    )
    distinct = materialise(
        cut.groupBy("window", "n", "size").agg(F.first("shingles").alias("shingles"))
        .withColumn("window_id", F.monotonically_increasing_id()),
        "distinct_windows",
    )
    elements = distinct.select("window_id", "size", F.posexplode("shingles").alias("offset", "h"))
    every = PrefixMap(elements)
    frequency = texts.select("raw").mapInArrow(lambda it: _count_hits(it, every), "h long, n long")
    frequency = frequency.groupBy("h").agg(F.sum("n").alias("seen"))
    rarest = (
        elements.join(frequency, "h", "left")
        .groupBy("window_id")
        .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "h", "offset")).alias("first"))
        .select("window_id", "first.h", "first.offset")
    )
    prefixes = materialise(distinct.drop("shingles").join(rarest, "window_id"), "prefixes")
    items = cut.filter("item_id is not null").join(distinct.select("window", "window_id"), "window")
    return prefixes, materialise(items.select("window_id", "item_id").distinct(), "window_items")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated,
    text_key (xxhash64 of the text, to find the row again)."""
    small_batches(documents.sparkSession)
    texts = documents.select("doc_id", F.xxhash64("text").alias("text_key"), utf8().alias("raw"))
    prefixes, window_items = _prefixes(benchmark, texts, window)
    needed = PrefixMap(prefixes.select("size", "h"))
    schema = texts.select("doc_id", "text_key").schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    scanned = texts.mapInArrow(
        lambda it: _find_places(it, needed, window),
        f"{schema}, n_words long, places array<struct<h:long,pos:long,lead:int,context:string>>",
    )
    scanned = materialise(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")

    places = scanned.select("row", F.explode("places").alias("at")).select("row", "at.*")
    held = F.split("context", " ")
    begin = F.col("lead") - F.col("offset")
    found = (
        places.join(prefixes, "h")
        .filter((begin >= 0) & (begin + F.col("n") <= F.size(held)))
        .filter(F.array_join(F.slice(held, begin + 1, F.col("n")), " ") == F.col("window"))
        .select("row", (F.col("pos") - F.col("offset")).alias("begin"), "n", "window_id")
    )
    found = materialise(found, "found")

    spans = found.groupBy("row", "begin").agg((F.col("begin") + F.max("n")).alias("end"))
    ahead = W.partitionBy("row").orderBy("begin").rowsBetween(W.unboundedPreceding, -1)
    covered = F.coalesce(F.max("end").over(ahead), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("begin", "covered"))
    hit = spans.withColumn("covered", covered).groupBy("row").agg(F.sum(fresh).alias("n_hit"))

    named = found.select("row", "window_id").distinct().join(window_items, "window_id")
    listed = named.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return (
        scanned.select("row", "doc_id", "text_key", "n_words")
        .join(hit, "row", "left")
        .join(listed, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
            "text_key",
        )
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that share no window with the benchmark, all columns."""
    marked = decontaminate(documents, benchmark, window).filter("contaminated")
    marked = materialise(marked.select("doc_id", "text_key").distinct(), "marked")
    return same_document(documents, marked, "left_anti")
