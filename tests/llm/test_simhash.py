import itertools
import random

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from helpers import clashing, documents, hard_texts

from irregts.llm import simhash as sh
from irregts.session import materialise


def slow_fingerprint(text):
    words = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def brute(ids, values, limit=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= limit:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return [least[find(i)] for i in range(len(ids))]


def near_copies(rng):
    words = [f"w{i}" for i in range(400)]
    base = [rng.choices(words, k=300) for _ in range(12)]
    out = [" ".join(b) for b in base]
    for b in base[:6]:
        for _ in range(6):
            copy = list(b)
            copy[rng.randrange(300)] = rng.choice(words)
            out.append(" ".join(copy))
            b = copy  # a chain of edits
    return out + out[:4] + ["two words", "Two  WORDS"]


def test_components_equal_brute_force(spark):
    texts = near_copies(random.Random(3)) + hard_texts()
    values = [slow_fingerprint(t) for t in texts]
    got = sh.near_duplicates(clashing(documents(spark, texts))).orderBy("doc_id").collect()
    assert [r["fingerprint"] for r in got] == [f"{v:016x}" for v in values]
    assert [r["component_id"] for r in got] == brute(list(range(len(texts))), values)
    assert len({r["component_id"] for r in got}) < len(texts) - 20


@pytest.mark.parametrize("unit, parts", [(1024, None), (8, None), (64, 2), (8, 3)])
def test_forests_connect_what_pairs_connect(spark, monkeypatch, unit, parts):
    """Random centres with up to three flipped bits, through small blocks and given plans."""
    rng = np.random.default_rng(unit)
    values = set()
    for centre in rng.integers(0, 1 << 62, 25):
        for _ in range(30):
            flips = rng.choice(64, rng.integers(0, 4), replace=False)
            values.add(int(centre) ^ sum(1 << int(b) for b in flips))
    values = sorted(values)
    monkeypatch.setattr(sh, "UNIT", unit)
    if parts:
        groups = sh.group_bits(np.zeros((64, 64)), parts)
        sample = np.array(values, np.uint64)
        monkeypatch.setattr(sh, "plan", lambda d, limit: sh.allocate(groups, sample, len(values), limit)[1])
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "value long").repartition(3)
    found = sh.components(materialise(sh.links(materialise(df, "v")), "l")).collect()
    root = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in found}
    ours = [root.get(v, v) for v in values]
    theirs = brute(values, values)
    assert len(set(zip(ours, theirs))) == len(set(ours)) == len(set(theirs))


def test_thresholds_keep_the_pigeonhole_sum():
    sample = np.random.default_rng(0).integers(0, 1 << 62, 500).astype(np.uint64)
    for m in range(1, 5):
        groups = sh.group_bits(sh.correlation(np.eye(64) * 250, 500), m)
        assert sorted(b for g in groups for b in g) == list(range(64))
        for n in (10**3, 10**7, 10**11):
            parts = sh.allocate(groups, sample, n, 3)[1]
            assert sum(p.threshold + 1 for p in parts) == 4  # each left-out partition counts 0


def test_correlated_bits_share_a_partition():
    related = np.zeros((64, 64))
    related[np.ix_([0, 20, 40, 60], [0, 20, 40, 60])] = 1
    assert any({0, 20, 40, 60} <= set(g) for g in sh.group_bits(related, 4))


def test_empty_and_single(spark):
    df = documents(spark, ["x"])
    assert sh.near_duplicates(df.limit(0)).count() == 0
    assert sh.near_duplicates(df).first()["component_id"] == 0


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 2000)], "a long, b long")
    got = {r["node"]: r["root"] for r in sh.components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 2000: 1000}


def test_one_of_each_component_stays(spark):
    texts = ["unique words stand here alone", "a b c d e", "a b c d e", None, "", "another text that is unlike"]
    df = documents(spark, texts).union(documents(spark, texts).filter("doc_id = 1"))
    kept = sh.one_of_each(clashing(df))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 3, 5] and kept.columns == clashing(df).columns


def test_one_of_each_tells_components_without_own_ids_apart(spark):
    texts = ["alpha beta gamma delta", "one two three four", "red green blue black", "north south east west", "up down left right"]
    data = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (None, texts[4]), (9, texts[4])]
    kept = sh.one_of_each(spark.createDataFrame(data, "doc_id long, text string")).collect()
    want = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[4])]
    assert sorted(map(tuple, kept), key=repr) == sorted(want, key=repr)


def test_pipeline_stage_keeps_one_of_each_brute_force_group(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(8):
        text = rng.choices(words, k=rng.randrange(200, 900))
        for _ in range(5):
            texts.append(" ".join(text))
            text = list(text)
            text[rng.randrange(len(text))] = rng.choice(words)  # a chain of edits
    texts += [*hard_texts(), texts[0].upper(), texts[1]]
    prints = [slow_fingerprint(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            low, high = sorted((find(i), find(j)))
            root[high] = low
    want = sorted({find(i) for i in range(len(texts))})
    df = clashing(documents(spark, texts).repartition(3))
    kept = corpus_pipeline._near_duplicates(spark, df, "")
    assert 8 < len(want) < len(texts) - 8
    assert sorted(r["doc_id"] for r in kept.collect()) == want and kept.columns == df.columns
