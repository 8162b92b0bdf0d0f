import math
import random
import re

import numpy as np
import pytest
from helpers import clashing, documents, hard_texts

from irregts.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, k=50):
    docs = [(i, terms(t)) for i, t in rows]
    docs = [(i, t) for i, t in docs if t]
    n_docs, n_terms = len(docs), sum(len(t) for _, t in docs)
    df = {}
    for _, t in docs:
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, asked in wanted.items():
        scored = []
        for i, t in docs:
            m = 100 - 50 + 50 * len(t) * n_docs // n_terms
            score = 0
            for term in asked & set(t):
                tf = t.count(term)
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                score += w * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, i is not None, i or 0))
        for rank, (score, named, i) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, i if named else None, -score))
    return sorted(out, key=repr)


def check(spark, rows, items, **settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(clashing(docs), clashing(bench), **settings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, items, settings.get("k", 50))


def prose(seed, n, longest=40):
    rng = random.Random(seed)
    words = ["the", "Of", "ZU", "été", "É", "7", "a7b", "re", "red", "reread", "字", "ß", "x", "y", "z"]
    gaps = [" ", " ", ", ", "-", "\n", "\t\x0b", "_", " "]
    return ["".join(w for _ in range(rng.randint(0, longest)) for w in (rng.choice(words), rng.choice(gaps))) for _ in range(n)]


@pytest.mark.parametrize("entries", [lexical.BLOCK_ENTRIES, 12])
def test_equals_brute_force_in_one_block_and_in_many(spark, entries):
    rows = list(enumerate(prose(1, 120)))
    items = list(enumerate(prose(2, 12, 8)))
    check(spark, rows, items, entries=entries)
    check(spark, rows, items, entries=entries, k=3)


def test_terms_inside_terms_do_not_count(spark):
    check(spark, [(1, "reread red,red"), (2, "re-read"), (3, "éred red é"), (4, "unred"), (5, "re")], [(1, "red"), (2, "re"), (3, "é RE")])


def test_ties_go_to_the_smaller_id_and_null_comes_first(spark):
    rows = [(i, "same words here") for i in range(80, 0, -1)] + [(None, "same words here"), (3, "same words here"), (500, "other")]
    check(spark, rows, [(1, "words"), (2, "words same")], k=50)
    check(spark, rows, [(1, "words")], k=200)


def test_hard_texts_and_hard_items(spark):
    rows = list(enumerate(hard_texts())) + [(3, "a"), (3, "a b")]
    items = [(1, "word a b"), (1, "same"), (1, "same"), (None, "text"), (None, "é"), (4, ""), (5, None), (6, "!?"), (7, "never met"), (8, "字")]
    check(spark, rows, items)


def test_a_term_in_every_document_has_little_weight(spark):
    check(spark, [(i, f"all {i % 7}") for i in range(3000)], [(1, "all"), (2, "all 3")], k=5)


def test_empty_tables(spark):
    docs = documents(spark, ["a b", None])
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(documents(spark, [None, "", "?"]), items).count() == 0
    assert lexical.search(docs, items).count() == 1


def test_blocks_hold_whole_items_within_bounds(spark):
    items = spark.createDataFrame([(i, " ".join(f"t{i}x{j}" for j in range(i + 1))) for i in range(30)], "item_id long, text string")
    cut = lexical.blocks(lexical.item_terms(items), entries=40, items=5)
    sizes = [(b.count(), b.select("item_id").distinct().count()) for b in cut]
    assert sum(n for n, _ in sizes) == sum(range(31)) and sum(n for _, n in sizes) == 30
    assert all(owners == 1 or (n <= 40 and owners <= 5) for n, owners in sizes)


def test_best_rows_are_pruned_exactly():
    rng = np.random.default_rng(5)
    best, offered = lexical.Best(3, 4), []
    best.room = 20
    for doc in range(300):
        scores = rng.integers(0, 12, 3)
        best.offer(doc, scores)
        offered += [(i, -s, doc) for i, s in enumerate(scores.tolist()) if s > 0]
    wanted = [row for i in range(3) for row in sorted(r for r in offered if r[0] == i)[:4]]
    item, score, _, doc = best.prune()
    assert sorted(zip(item.tolist(), (-score).tolist(), doc.tolist())) == wanted
