"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits of a fingerprint are put into partitions, correlated bits together. Partition
i gets a threshold t_i of -1 (never probed) or more, with sum(t_i) = limit - m + 1: two
fingerprints that differ in at most ``limit`` bits then differ in at most t_i bits in some
partition. How many partitions and which thresholds is decided by dynamic programming on
the candidates that a sample of fingerprints lets one expect, so small and large tables
get different, equally exact plans. Probes and indexed fingerprints of a key meet in units of
bounded size, where all their pairs are verified and a spanning forest is kept. Only distinct
fingerprints take part; components are found by minimum labels with pointer jumping, one
written table per round.

Nulls, empty texts and texts without words have fingerprint zero, which is linked like any
other. A null doc_id never names a component unless all its ids are null. Repeated rows
are reported row by row. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irregts.llm.common import LOWER, same_document, small_batches, utf8
from irregts.session import materialise

BITS, SHINGLE, SEED, LIMIT = 64, 3, 42, 3
#: Expected number of fingerprints, chosen by hash, on which candidate counts are estimated.
SAMPLE = 4096
#: Cost of a verified candidate relative to a probe row.
CANDIDATE_COST = 0.05
#: Rows of a block of a large bucket; pairs that a worker verifies at once.
UNIT, PAIRS = 1024, 1 << 20


def fingerprint(raw: bytes) -> int:
    """Unsigned 64-bit SimHash of a text's three-word shingles."""
    words = raw.translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - SHINGLE].tolist()
    ends = ends[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones, step = np.zeros(BITS, np.int64), 32768
    for at in range(0, len(starts), step):
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts[at : at + step], ends[at : at + step])]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, BITS).sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(raw) for raw in batch.column("raw").to_pylist()], np.uint64)
        columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(values.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "value"])


class Partition(NamedTuple):
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return _signed(sum(1 << b for b in self.bits))

    def flips(self) -> list[int]:
        """Bit patterns of up to ``threshold`` differences inside the partition."""
        chosen = (c for k in range(self.threshold + 1) for c in itertools.combinations(self.bits, k))
        return [_signed(sum(1 << b for b in c)) for c in chosen]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _cooccurrence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS))
    for batch in batches:
        total += (bits := _bit_matrix(batch.column(0).to_numpy())).T @ bits
    cells = pa.array(np.arange(BITS * BITS, dtype=np.int32))
    yield pa.RecordBatch.from_arrays([cells, pa.array(total.ravel().astype(np.int64))], names=["cell", "n"])


def _bit_matrix(values: np.ndarray) -> np.ndarray:
    raw = np.ascontiguousarray(values).view(np.uint8)
    return np.unpackbits(raw, bitorder="little").reshape(-1, BITS).astype(np.float32)


def correlation(together: np.ndarray, n: int) -> np.ndarray:
    """Absolute correlation of bits from how often two are set together."""
    share = np.diag(together) / max(1, n)
    spread = np.sqrt(np.outer(share * (1 - share), share * (1 - share)))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.abs((together / max(1, n) - np.outer(share, share)) / spread)
    return np.nan_to_num(out, nan=0.0, posinf=0.0)


def group_bits(related: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Greedy groups of nearly equal width: start from the most related bit left and add
    the bit most related to the group."""
    left, groups = set(range(BITS)), []
    for i in range(parts):
        width = BITS // parts + (i < BITS % parts)
        order = sorted(left)
        group = [max(order, key=lambda b: related[b, order].sum())]
        left.remove(group[0])
        while len(group) < width:
            group.append(max(sorted(left), key=lambda b: related[b, group].sum()))
            left.remove(group[-1])
        groups.append(tuple(sorted(group)))
    return groups


def allocate(groups: list[tuple[int, ...]], sample: np.ndarray, n: int, limit: int) -> tuple[float, list[Partition]]:
    """Thresholds of least expected cost whose sum is ``limit - m + 1``."""
    m = len(groups)
    costs = []
    for group in groups:
        mask = np.uint64(sum(1 << b for b in group))
        near = np.zeros(limit + 1)
        for i in range(0, len(sample), 256):
            apart = np.bitwise_count((sample[i : i + 256, None] ^ sample[None, :]) & mask)
            near += [(apart <= t).sum() for t in range(limit + 1)]
        pairs = max(1, len(sample) * (len(sample) - 1))
        near = (near - len(sample)) / pairs
        costs.append([0.0])
        for t in range(limit + 1):
            probes = sum(comb(len(group), k) for k in range(t + 1))
            chance = max(near[t], probes / 2.0 ** len(group))
            costs[-1].append(n * (1 + probes) + CANDIDATE_COST * chance * n * n / 2)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (spent, chosen) in best.items():
            for t, price in enumerate(cost, start=-1):
                offer = (spent + price, [*chosen, t])
                if total + t not in step or offer < step[total + t]:
                    step[total + t] = offer
        best = step
    price, thresholds = best[limit - m + 1]
    return price, [Partition(g, t) for g, t in zip(groups, thresholds) if t >= 0]


def plan(distinct: DataFrame, limit: int = LIMIT) -> list[Partition]:
    """The cheapest partitions and thresholds for a table of distinct values."""
    n = distinct.count() + 1  # also of an empty table a plan with few probes
    cells = distinct.select("value").mapInArrow(_cooccurrence, "cell int, n long")
    sums = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    together = np.zeros(BITS * BITS)
    together[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    related = correlation(together.reshape(BITS, BITS), n)
    draw = F.pmod(F.xxhash64("value"), F.lit(1 << 30)) / float(1 << 30)
    chosen = distinct.select("value").filter(draw < min(1.0, SAMPLE / n)).toArrow()
    sample = chosen["value"].to_numpy().view(np.uint64)
    offers = [allocate(group_bits(related, m), sample, n, limit) for m in range(1, limit + 2)]
    return min(offers, key=lambda x: x[0])[1]


def _units(distinct: DataFrame, parts: list[Partition]) -> DataFrame:
    """Rows (i, key, x, y, indexed, value), one unit of work per (i, key, x, y).

    A bucket is what shares a partition's key: fingerprints under their own key (indexed)
    and probes under the keys that differ in up to its threshold of bits. A bucket of more
    than ``UNIT`` rows is cut into blocks, and each pair of blocks is a unit.
    """
    value = F.col("value")
    at = []
    for i, part in enumerate(parts):
        key = value.bitwiseAND(F.lit(part.mask))
        at += [
            F.struct(F.lit(i).alias("i"), key.bitwiseXOR(F.lit(x)).alias("key"), F.lit(x == 0).alias("indexed"))
            for x in part.flips()
        ]
    rows = distinct.select("value", F.explode(F.array(*at)).alias("at")).select("value", "at.*")
    sizes = rows.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > UNIT)
    large = materialise(sizes.select("i", "key", F.ceil(F.col("n") / UNIT).cast("int").alias("blocks")), "large")
    blocks = F.coalesce("blocks", F.lit(1))
    cut = rows.join(large, ["i", "key"], "left").withColumn("own", F.pmod(F.xxhash64("value"), blocks).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return cut.select(
        "i", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "indexed", "value"
    )


def _forest(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Per unit of sorted rows a forest (a, b) that connects what is at most ``limit`` apart."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
        starts = _starts(rows)
        if len(starts) < 2:
            held = rows
            continue
        yield _connect([c[: starts[-1]] for c in rows], limit)
        held = [c[starts[-1] :] for c in rows]
    if held is not None:
        yield _connect(held, limit)


def _starts(rows: list[np.ndarray]) -> np.ndarray:
    """First rows of the units."""
    n = len(rows[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in rows[:4]])
    return np.flatnonzero(new)


def _connect(rows: list[np.ndarray], limit: int) -> pa.RecordBatch:
    x, y, own, indexed, value = *rows[2:5], rows[5].astype(bool), rows[6].view(np.uint64)
    starts = _starts(rows)
    unit = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(value)))
    # Indexed rows come first in a unit; each row meets all of them.
    meets = np.bincount(unit, indexed, len(starts)).astype(np.int64)[unit]
    upto = np.cumsum(meets)
    left, right = [], []
    at = 0
    while at < len(value):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        n = meets[at:stop]
        a = np.repeat(np.arange(at, stop), n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + starts[unit[a]]
        near = np.bitwise_count(value[a] ^ value[b]) <= limit
        near &= (value[a] < value[b]) | ~indexed[a] & (value[a] != value[b])
        near &= (x[a] == y[a]) | (own[a] != own[b])
        left.append(a[near])
        right.append(b[near])
        at = stop
    a, b = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (left, right))
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = np.split(ends, 2)
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        lower = root.copy()
        np.minimum.at(lower, a, least)
        np.minimum.at(lower, b, least)
        lower = lower[lower]
        if (lower == root).all():
            break
        root = lower
    moved = root != np.arange(len(root))
    pair = [value[nodes[root[moved]]].view(np.int64), value[nodes[moved]].view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in pair], names=["a", "b"])


def links(distinct: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) that connect exactly what chains of steps of at most ``limit`` bits do.

    All pairs inside a unit are verified, and a spanning forest of what is near is given
    out, so a group of near copies makes as many links as it has members, not pairs.
    """
    unit = ["i", "key", "x", "y"]
    rows = _units(distinct, plan(distinct, limit)).repartition(*unit).sortWithinPartitions(*unit, F.desc("indexed"))
    return rows.mapInArrow(lambda it: _forest(it, limit), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root for all nodes of undirected edges (a, b); root is the smallest node."""
    both = materialise(edges.union(edges.select("b", "a")).toDF("node", "other"), "edges")
    labels = both.groupBy("node").agg(F.least("node", F.min("other")).alias("root"))
    labels = materialise(labels, "labels")
    while True:
        offered = both.join(labels.select(F.col("node").alias("other"), "root"), "other")
        offered = offered.groupBy("node").agg(F.min("root").alias("offer"))
        lower = labels.join(offered, "node").select(
            "node", F.col("root").alias("was"), F.least("root", "offer").alias("root")
        )
        lower = materialise(lower, "lower")
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = lower.join(jump, "root").select("node", "was", F.col("next").alias("root"))
        jumped = materialise(jumped, "labels")
        if jumped.filter("was <> root").isEmpty():
            return jumped.select("node", "root")
        labels = jumped.select("node", "root")


def near_duplicates(documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id, text_key, root.

    ``root`` is the component's smallest fingerprint: unlike ``component_id``, which is null or
    shared where ids are, it tells components apart.
    """
    small_batches(documents.sparkSession)
    texts = documents.select("doc_id", F.xxhash64("text").alias("text_key"), utf8().alias("raw"))
    id_type = documents.select("doc_id").schema[0].dataType.simpleString()
    marked = texts.mapInArrow(_fingerprints, f"doc_id {id_type}, text_key long, value long")
    marked = materialise(marked, "fingerprints")
    distinct = materialise(marked.groupBy("value").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(materialise(links(distinct, limit), "links"))
    roots = distinct.join(found.withColumnRenamed("node", "value"), "value", "left")
    roots = materialise(roots.select("value", "first", F.coalesce("root", "value").alias("root")), "roots")
    smallest = materialise(roots.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    named = materialise(roots.join(smallest, "root").select("value", "component_id", "root"), "named")
    return marked.join(named, "value").select(
        "doc_id", F.lower(F.lpad(F.hex("value"), 16, "0")).alias("fingerprint"), "component_id", "text_key", "root"
    )


def one_of_each(documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Of each component the document with the smallest id, all columns, as :func:`one_per_root`."""
    return one_per_root(documents, near_duplicates(documents, limit))


def one_per_root(documents: DataFrame, report: DataFrame) -> DataFrame:
    """Of each ``root`` of a report (doc_id, text_key, root) the row with the smallest id.

    A null id comes after all others. Of several rows with that id the one with the smallest
    text hash stays, once.
    """
    rows = report.groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "copies")).alias("first")
    keep = materialise(rows.groupBy("root").agg(first).select("first.doc_id", "first.text_key", "first.copies"), "keep")
    single, several = keep.filter("copies = 1").drop("copies"), keep.filter("copies > 1").drop("copies")
    once = same_document(documents, single, "left_semi")
    again = same_document(documents, several, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(again)
