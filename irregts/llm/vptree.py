"""Nearest neighbours by cosine with vantage-point trees, one per shard.

Vectors are dealt into shards of bounded size by hash. Queries come in blocks, and a task
gets one shard and one block: it builds the shard's tree over the distinct unit vectors and
sends the whole block through it. A node splits its vectors by the distance to a vantage
point; by the triangle inequality no vector behind a split is nearer than the gap between
the query's distance and the range of distances there. A side is left out if ``factor`` times
that gap exceeds the distance of the k-th best so far. Factor 1 is exact; larger factors leave
out more. What is found is scored again in double precision on the original vectors.

Vectors that are null, empty, zero or hold null or non-finite components take no part, neither
as query nor as candidate; only vectors of equal length are compared. A query never finds rows
with its own vec_id. Ties go to the smaller vec_id. Repeated rows are separate candidates and
separate queries. Fewer candidates than k: all of them. Empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from irregts.session import materialise

#: Rows of a shard and queries of a block, on average; vectors of a leaf.
SHARD_ROWS, BLOCK_QUERIES, LEAF = 2048, 2048, 32
#: Room for rounding when distances are compared.
EPSILON = 1e-7


@dataclass
class _Node:
    rows: np.ndarray | None = None
    vantage: int = -1
    sides: list[tuple[float, float, _Node]] = field(default_factory=list)


class VantagePointTree:
    """Over distinct unit vectors (rows of ``unit``)."""

    def __init__(self, unit: np.ndarray, leaf: int = LEAF) -> None:
        self.unit, self.leaf = unit, leaf
        self.root = self._build(np.arange(len(unit)), np.random.default_rng(0))

    def _build(self, rows: np.ndarray, random: np.random.Generator) -> _Node:
        if len(rows) <= self.leaf:
            return _Node(rows=rows)
        vantage = int(rows[random.integers(len(rows))])
        apart = distance(self.unit[rows] @ self.unit[vantage])
        near = apart <= np.median(apart)
        if near.all():
            return _Node(rows=rows)
        sides = [
            (float(apart[at].min()), float(apart[at].max()), self._build(rows[at], random)) for at in (near, ~near)
        ]
        return _Node(vantage=vantage, sides=sides)

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) that hold each query's k nearest rows and all ties."""
        best = np.full((len(queries), k), np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def visit(node: _Node, who: np.ndarray) -> None:
            if not len(who):
                return
            if node.rows is not None:
                apart = distance(queries[who] @ self.unit[node.rows].T)
                best[who] = np.partition(np.concatenate([best[who], apart], axis=1), k - 1, axis=1)[:, :k]
                q, r = np.nonzero(apart <= best[who].max(axis=1)[:, None] + EPSILON)
                found.append((who[q], node.rows[r], apart[q, r]))
                return
            apart = distance(queries[who] @ self.unit[node.vantage])
            gaps = [np.maximum(0, np.maximum(low - apart, apart - high)) for low, high, _ in node.sides]
            # The side that most queries are closer to goes first and tightens the bound.
            order = (0, 1) if (gaps[0] <= gaps[1]).mean() >= 0.5 else (1, 0)
            for i in order:
                visit(node.sides[i][2], who[factor * gaps[i] <= best[who].max(axis=1) + EPSILON])

        visit(self.root, np.arange(len(queries)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        who, rows, apart = (np.concatenate(x) for x in zip(*found))
        kept = apart <= best.max(axis=1)[who] + EPSILON
        return who[kept], rows[kept]


def distance(cosine: np.ndarray) -> np.ndarray:
    """Euclidean distance of unit vectors, a metric, from their cosine."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the row of b beside it, in double precision.

    Rows are scaled by powers of two, which changes no digit, and products are added from
    the first component to the last, so that equal vectors get equal scores everywhere.
    """

    def scaled(x: np.ndarray) -> np.ndarray:
        return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])

    def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.cumsum(x * y, axis=1)[:, -1]

    a, b = scaled(a), scaled(b)
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def _nearest(rows: pa.Table, queries: pa.Table, k: int, factor: float) -> pa.Table:
    """The best k of one shard for each query of one block."""
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    # A side without rows comes without columns.
    if any("vector" not in t.column_names or not t.num_rows for t in (rows, queries)):
        return schema.empty_table()
    vectors, asked = _matrix(rows["vector"]), _matrix(queries["vector"])
    ids, own = rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    distinct, first, copy_of = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
    # Ids of each distinct vector, ascending: only the k first can be an answer to a query
    # with another id, and one more if one of them is the query's.
    by_vector = np.argsort(copy_of.ravel(), kind="stable")
    sizes = np.bincount(copy_of.ravel(), minlength=len(distinct))
    starts = np.cumsum(sizes) - sizes
    # A query's own id may be on several distinct vectors, none of which is an answer.
    owned = np.unique(np.stack([np.unique(ids, return_inverse=True)[1], copy_of.ravel()]), axis=1)[0]
    who, where = VantagePointTree(_unit(distinct)).search(_unit(asked), k + int(np.bincount(owned).max()), factor)
    score = cosines(asked[who], distinct[where]) if len(who) else np.zeros(0)
    # A query's own id may be there more than once; it must not use up the k places.
    same = np.bincount(np.searchsorted(np.unique(ids), ids), minlength=1).max()
    take = np.minimum(sizes[where], k + same)
    ends = np.cumsum(take)
    inner = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - take, take)
    who, score = np.repeat(who, take), np.repeat(score, take)
    found = ids[by_vector[np.repeat(starts[where], take) + inner]]
    other = found != own[who]
    who, score, found = who[other], score[other], found[other]
    order = np.lexsort((found, -score, who))
    who, score, found = who[order], score[order], found[order]
    place = np.arange(len(who)) - np.searchsorted(who, who)
    top = place < k
    columns = [queries["row"].to_numpy()[who[top]], own[who[top]], found[top], score[top]]
    return pa.Table.from_arrays([pa.array(c) for c in columns], schema=schema)


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(embeddings: DataFrame, queries: Column, k: int = 5, factor: float = 1.0) -> DataFrame:
    """The k nearest other rows of each row that ``queries`` selects: query_id, rank (from 1),
    vec_id, score. ``embeddings`` has vec_id and embedding."""
    vector = F.col("embedding").cast("array<double>")
    base = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), queries.alias("asked")
    ).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    base = materialise(base.withColumn("row", F.monotonically_increasing_id()), "vectors")
    counts = base.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("asked"), 1)).alias("q")).first()
    shards, blocks = -(-counts["n"] // SHARD_ROWS), -(-counts["q"] // BLOCK_QUERIES)

    def dealt(column: str, parts: int) -> Column:
        return F.pmod(F.xxhash64("row", F.lit(column)), F.lit(max(1, parts))).cast("int").alias(column)

    def every(column: str, parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(max(1, parts) - 1))).alias(column)

    size = F.size("vector").alias("size")
    left = base.select("vec_id", "vector", size, dealt("shard", shards), every("block", blocks))
    right = base.filter("asked").select("row", "vec_id", "vector", size, dealt("block", blocks), every("shard", shards))
    key = ("size", "shard", "block")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        lambda rows, asked: _nearest(rows, asked, k, factor), "query_row long, query_id long, vec_id long, score double"
    )
    best = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
