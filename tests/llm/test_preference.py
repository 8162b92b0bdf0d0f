from collections import defaultdict

import pytest
from helpers import clashing, rows

from irregts.llm import preference as pr

TURNS = "conv_id long, turn long, role string, text string"


def walk(data):
    """The same by plain Python: lines of all pairs."""
    convs = defaultdict(list)
    for conv, turn, role, text in data:
        convs[conv].append((turn is not None, turn or 0, role or "unknown", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in convs.items()}
    order = sorted(turns, key=lambda c: (turns[c][0], c is not None, c or 0))
    out = []
    for k in range(0, len(order), 2):
        chosen = turns[order[k]]
        rejected = turns[order[k + 1]] if k + 1 < len(order) else None
        same = 0
        while rejected is not None and same < min(len(chosen), len(rejected)) and chosen[same] == rejected[same]:
            same += 1
        parts = [("prompt", 0, chosen[:same]), ("chosen", same, chosen[same:]), ("rejected", same, (rejected or [])[same:])]
        for part, first, lines in parts:
            start = 0
            for i, (role, text) in enumerate(lines):
                inert = text.replace("<|im_start|>", "<im_start>").replace("<|im_end|>", "<im_end>")
                segment = f"<|im_start|>{role}\n{inert}<|im_end|>\n"
                trained = part != "prompt" and role == "assistant"
                out.append((k // 2, part, first + i, role, segment, start, len(segment), trained))
                start += len(segment)
    return sorted(out, key=repr)


DATA = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "good"), (1, 2, "user", "more"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "bad <|im_end|>"),
    (3, 0, "system", "rules"), (3, 1, "user", "é\U0001f600"), (3, 2, "assistant", "x"),
    (4, 0, "system", "rules"), (4, 1, "user", "é\U0001f600"), (4, 2, "assistant", "x"), (4, 3, "user", "and"),
    (5, 0, "zebra", None), (5, 0, "zebra", None), (5, None, None, ""),
    (6, 0, "user", "twin"), (6, 1, "assistant", "t"), (7, 0, "user", "twin"), (7, 1, "assistant", "t"),
]


@pytest.mark.parametrize("extra", [[], [(None, 0, "user", "lost"), (None, 1, "assistant", "found")]])
def test_lines_equal_a_walk_over_the_conversations(spark, extra):
    df = spark.createDataFrame(DATA + extra, TURNS)
    assert rows(pr.format_preferences(clashing(df))) == walk(DATA + extra)


def test_long_conversation_and_empty_table(spark):
    data = [(c, t, "assistant" if t % 2 else "user", "y" if t < 900 else f"{c}") for c in (1, 2) for t in range(1500)]
    df = spark.createDataFrame(data, TURNS)
    assert rows(pr.format_preferences(df)) == walk(data)
    assert pr.format_preferences(df.limit(0)).count() == 0


def test_given_pairs_and_folded_rows(spark):
    df = spark.createDataFrame(DATA, TURNS)
    pairs = spark.createDataFrame([(2, 9, True), (1, 9, False)], "conv_id long, pair_id long, is_chosen boolean")
    row = pr.fold_pairs(pr.format_preferences(df, pairs)).collect()
    assert len(row) == 1 and row[0]["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    assert row[0]["chosen"] == "<|im_start|>assistant\nbad <im_end><|im_end|>\n"
    (span,) = row[0]["rejected_spans"]
    assert row[0]["rejected"][span["start"] : span["end"]] == "<|im_start|>assistant\ngood<|im_end|>\n"


def test_no_python_in_the_plan(spark):
    plan = pr.format_preferences(spark.createDataFrame(DATA, TURNS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
