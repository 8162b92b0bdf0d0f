import hashlib
import random
import re

import pytest
from helpers import clashing, documents, hard_texts

from irregts.llm import decontaminate as de

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(texts, items, size=10):
    windows = {}
    for item, text in items:
        words = WORDS.findall(lower(text))
        n = min(size, len(words))
        for i in range(len(words) - n + 1) if words else ():
            windows.setdefault(tuple(words[i : i + n]), set()).add(item)
    out = []
    for i, text in enumerate(texts):
        words = WORDS.findall(lower(text))
        hit, names = set(), set()
        for window, owners in windows.items():
            n = len(window)
            for at in range(len(words) - n + 1):
                if tuple(words[at : at + n]) == window:
                    hit.update(range(at, at + n))
                    names.update(owners)
        names.discard(None)
        listed = ",".join(sorted(map(str, names)))
        out.append((i, len(words), len(hit), len(names), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return out


def check(spark, texts, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = de.decontaminate(clashing(documents(spark, texts)), clashing(bench)).drop("text_key").orderBy("doc_id")
    assert [tuple(r) for r in got.collect()] == brute(texts, items)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["the", "Of", "zu", "é", "7", "ab", "cd"]
    prose = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(30)]
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    items = [(i, t) for i, t in enumerate(rng.choices(prose, k=3))]
    items += [(10, long), (11, long.upper()), (2, "only seven words are in this one"), (None, "no id but ten words are here to be marked"), (12, "q"), (13, ""), (14, None)]
    texts = [*prose[:8], "x " + long + " y", long[:40], "no id but ten words are here to be marked", "Q! q, q.", "so only seven words are-in this one",
             " ".join([long] * 3), "the " * 50, *[t for t in hard_texts() if t is None or len(t) < 100]]
    check(spark, texts, items)


@pytest.mark.parametrize("n", [1, 2, 3, 9, 10, 11])
def test_items_of_every_length_at_the_edges_of_documents(spark, n):
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(words[:n]), " ".join(words[5:]), " ".join(words[: n - 1]), " ".join(words[:20] * 2)]
    check(spark, texts, [(0, " ".join(words[:n])), (1, " ".join(words[30 - n :])), (2, " ".join(words[:n]))])


def test_a_periodic_text_meets_itself(spark):
    check(spark, ["a " * 25, "b a " * 12, "a b " * 4], [(0, "a " * 12), (1, "a b " * 6)])


def test_empty_tables(spark):
    texts = documents(spark, ["a b c"])
    none = spark.createDataFrame([], "item_id long, text string")
    assert de.decontaminate(texts, none).first()["contaminated"] is False
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert de.decontaminate(texts.limit(0), items).count() == 0


def test_stage_keeps_clean_rows_and_all_columns(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    texts = documents(spark, ["clean", None, "so one two three four five six seven eight nine ten", "clean", ""])
    kept = de.without_contaminated(clashing(texts), items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 3, 4] and kept.columns == clashing(texts).columns
