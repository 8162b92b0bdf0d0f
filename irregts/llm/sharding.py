"""Hierarchical weighted hash tree: documents descend region, rack and shard.

At every level each child of the node draws ``-ln(u) / weight`` with ``u`` hashed from
the document's id and the child's name, and the smallest draw wins. A child's chance is
its share of the weight, and a draw depends on nothing but the id and that child: when a
weight changes, rows only move into or out of the subtree that holds it.

Law: ``key``. The id and the topology decide; texts, order and partitioning do not.
Nulls: a null id is one fixed key (the empty string). A null text has no bytes (size 1).
Repeated rows get the same shard and slots of their own; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irregts.llm.common import running, sequenced, utf8


class Leaf(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, per_rack: int = 2, per_region: int = 4) -> list[Leaf]:
    """Shards of weight 1 in racks of ``per_rack`` and regions of ``per_region``."""
    return [Leaf(i // per_region, i // per_rack, i) for i in range(shards)]


def grown(leaves: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region and rack of its own: it takes rows only into itself.

    Within an old region nothing is drawn anew, so rows either stay or go to the new one.
    """
    region, rack, shard = (1 + max(x[i] for x in leaves) for i in range(3))
    return [*leaves, Leaf(region, rack, shard, weight)]


def _draw(key: Column, name: str, weight: float) -> Column:
    """-ln(u) / weight, u of 52 bits from md5, never 0 or 1."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{name}"))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52)) / F.lit(float(weight))


def _descend(key: Column, leaves: Sequence[Leaf], level: int) -> Column:
    """The shard below one node of the tree; ``level`` 0 is the root."""
    children: dict[int, list[Leaf]] = defaultdict(list)
    for leaf in leaves:
        if leaf.weight > 0:
            children[leaf[level]].append(leaf)
    below = {c: F.lit(c) if level == 2 else _descend(key, x, level + 1) for c, x in children.items()}
    if len(below) == 1:
        return next(iter(below.values()))
    kind = ("region", "rack", "shard")[level]
    draws = [
        F.struct(_draw(key, f"{kind}{c}", sum(x.weight for x in members)).alias("draw"), F.lit(c).alias("child"))
        for c, members in sorted(children.items())
    ]
    won = F.least(*draws)["child"]
    if level == 2:
        return won
    first, *rest = sorted(below)
    chosen = F.when(won == first, below[first])
    for c in rest:
        chosen = chosen.when(won == c, below[c])
    return chosen


def shard_of(doc_id: Column, leaves: Sequence[Leaf]) -> Column:
    """The shard a document id belongs to."""
    if not any(x.weight > 0 for x in leaves):
        raise ValueError("a topology needs a shard with a positive weight")
    key = F.coalesce(doc_id.cast("string"), F.lit(""))
    return _descend(key, leaves, 0).cast("int")


def assign_shards(documents: DataFrame, leaves: Sequence[Leaf]) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``slot`` counts the rows of a shard from 0 in the order (doc_id, text_crc32, size).
    """
    facts = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(utf8()).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), leaves).alias("shard"),
        shard_of(F.col("doc_id"), grown(leaves)).alias("grown_shard"),
    )
    placed = sequenced(facts, ["shard", "doc_id", "text_crc32", "size"])
    return running(placed, ["shard"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
