import random
import re

import pytest
from helpers import clashing, documents, hard_texts

from irregts.llm import rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def repeated(words, size=8):
    places = {}
    for i in range(len(words) - size + 1):
        places.setdefault(tuple(words[i : i + size]), []).append(i)
    hit = set()
    for found in places.values():
        if len(found) > 1:
            hit.update(w for i in found for w in range(i, i + size))
    return len(hit)


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n, lost = len(words), repeated(words)
    chars, symbols = sum(map(len, words)), sum(c in "#*$%&|<>" for c in text)
    dup = len(lines) - len(set(lines))
    failed = n < 20 or 100 * lost > 30 * n
    letters = sum(any(c.isalpha() for c in w) for w in words)
    bullets = sum(line.lstrip()[0] in "-*•" for line in lines)
    cut = sum(line.rstrip().endswith(("...", "…")) for line in lines)
    kept = not (
        failed or chars < 2 * n or chars > 15 * n or 10 * symbols > n or 10 * letters < 8 * n
        or 2 * dup > len(lines) or 10 * bullets > 9 * len(lines) or 10 * cut > 3 * len(lines)
    )
    return n, chars, symbols, dup, lost, failed, kept


def texts():
    rng = random.Random(3)
    vocabulary = ["the", "of", "zu", "été", "7", "ab", "c#", "字", "\U0001f600x", "-"]
    prose = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 80))) for _ in range(60)]
    unlike = " ".join(f"word{i}" for i in range(40))
    seven, eight = " ".join(f"w{i}" for i in range(7)), " ".join(f"w{i}" for i in range(8))
    return [
        *prose, unlike, f"{unlike} {unlike}", f"{eight} x {eight} {unlike}", f"{seven} x {seven} {unlike}",
        "a " * 7, "a " * 8, "a " * 9, "a " * 40, f"\n{unlike}\n\n \n{unlike} \n{unlike}\n", f"{unlike}\r\n{unlike}\r\nq",
        "- one two\n* three\n• four " + unlike, "so it goes...\nand on… \n" * 9 + unlike, "<#$%&|*> " * 30, "\x0bword\x0c" * 25,
        "i j " * 30, "w" * 400 + " " + unlike, "1 2 3 " * 3 + "4 5 6 7 8 9 10 11 12 13 14 15 16 17 18", *hard_texts(),
    ]


def test_equals_brute_force(spark):
    given = texts()
    got = rules.digests(clashing(documents(spark, given))).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == [brute(t) for t in given]


@pytest.mark.parametrize("order", [rules.RULES, rules.RULES[::-1]])
def test_verdict_does_not_depend_on_the_order(spark, order):
    given = texts()
    got = rules.cascade(documents(spark, given), order=order).orderBy("doc_id").collect()
    assert [r["rejected_by"] is None for r in got] == [brute(t)[-1] for t in given]
    assert [r["text"] for r in got] == given


def test_first_rule_of_the_order_names_the_rejection(spark):
    df = documents(spark, ["# " * 30])
    assert rules.cascade(df, order=rules.RULES).first()["rejected_by"] == "repeated_windows"
    assert rules.cascade(df, order=rules.RULES[::-1]).first()["rejected_by"] == "words_without_letter"


def test_most_rejections_a_second_come_first():
    a, b, c, d = (rules.Rule(n, (), "true") for n in "abcd")
    found = [rules.Estimate(a, 1.0, 0.5), rules.Estimate(b, 0.1, 0.1), rules.Estimate(c, 0.2, 0.0), rules.Estimate(d, 0.1, 0.0)]
    assert [r.name for r in rules.best_order(found)] == ["b", "a", "d", "c"]


def test_estimates_of_a_sample(spark):
    df = documents(spark, ["too few"] * 30 + [" ".join(f"word{i}" for i in range(50))] * 30)
    found = {e.rule.name: e for e in rules.estimate(df)}
    assert found["few_words"].rejected == 0.5 and found["cut_lines"].rejected == 0
    assert all(e.seconds > 0 for e in found.values())
    drawn = rules.estimate(documents(spark, ["too few"] * 400), rules.BASE, sample=100)
    assert [e.rejected for e in drawn] == [1.0, 0.0]


def test_later_measures_are_not_computed_for_rejected_texts(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setitem(rules.MEASURES, "trap", lambda: F.when(F.length("text") < 5, F.raise_error("computed").cast("long")).otherwise(0))
    trap = rules.Rule("trap", ("trap",), "trap > 0")
    df = documents(spark, ["q", "w" * 30])
    few = rules.Rule("short", ("word_chars",), "word_chars < 5")
    assert [r["rejected_by"] for r in rules.cascade(df, order=[few, trap]).orderBy("doc_id").collect()] == ["short", None]
    with pytest.raises(Exception, match="computed"):
        rules.cascade(df, order=[trap, few]).collect()


def test_no_python_in_the_plan(spark):
    plan = rules.cascade(documents(spark, ["a"]), order=rules.RULES, whole=("n_repeat_words",))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD.*Python", plan) and "Exchange" not in plan


def test_empty_table(spark):
    assert rules.digests(documents(spark, ["a"]).limit(0)).count() == 0
