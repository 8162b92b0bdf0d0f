from collections import Counter, defaultdict

import pytest
from helpers import clashing, documents, hard_texts
from pyspark.sql import functions as F

from irregts.llm import sharding as sh


def test_slots_and_nulls(spark):
    df = documents(spark, hard_texts())
    extra = spark.createDataFrame([(None, "x"), (None, "x"), (3, "a"), (3, "a")], "doc_id long, text string")
    every = df.select("doc_id", "text").union(extra)
    got = sh.assign_shards(clashing(every), sh.topology(8)).collect()
    assert len(got) == 14
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    of_id = defaultdict(set)
    for r in got:
        of_id[r["doc_id"]].add((r["shard"], r["grown_shard"]))
    assert all(len(s) == 1 for s in of_id.values())
    assert {r["size"] for r in got if r["doc_id"] == 0} == {1}


def test_empty_table(spark):
    assert sh.assign_shards(spark.createDataFrame([], "doc_id long, text string"), sh.topology(8)).count() == 0


def test_weights_decide_shares_and_movement_stays_in_changed_subtrees(spark):
    ids = spark.range(20_000)
    old = [sh.Leaf(0, 0, 0, 1), sh.Leaf(0, 0, 1, 3), sh.Leaf(0, 1, 2, 2), sh.Leaf(1, 2, 3, 6)]
    new = [old[0], old[1]._replace(weight=5), *old[2:]]
    both = ids.select(sh.shard_of(F.col("id"), old).alias("a"), sh.shard_of(F.col("id"), new).alias("b")).collect()
    share = Counter(r["a"] for r in both)
    for leaf in old:
        assert share[leaf.shard] / 20_000 == pytest.approx(leaf.weight / 12, abs=0.02)
    moved = Counter((r["a"], r["b"]) for r in both if r["a"] != r["b"])
    # Shard 1 grew: region 0 and rack 0 grew with it, region 1 and rack 1 only lose rows to them.
    assert moved and all(b in (0, 1, 2) and (a, b) not in ((0, 2), (1, 2), (1, 0)) for a, b in moved)
    assert (2, 1) in moved and (3, 1) in moved and (0, 1) in moved


def test_one_more_shard_takes_rows_only_into_itself(spark):
    for n in (1, 5, 8):
        leaves = sh.topology(n)
        pairs = spark.range(3000).select(
            sh.shard_of(F.col("id"), leaves).alias("a"), sh.shard_of(F.col("id"), sh.grown(leaves)).alias("b")
        )
        assert {r["b"] for r in pairs.filter("a <> b").collect()} == {n}


def test_a_shard_without_weight_gets_nothing(spark):
    leaves = [*sh.topology(3), sh.Leaf(0, 9, 9, 0)]
    assert spark.range(500).filter(sh.shard_of(F.col("id"), leaves) == 9).count() == 0
    with pytest.raises(ValueError, match="positive weight"):
        sh.shard_of(F.col("id"), [sh.Leaf(0, 0, 0, 0)])
