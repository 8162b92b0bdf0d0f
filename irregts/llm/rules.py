"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule rejects a text by measures of it. Each rule's cost and selectivity are estimated on a
sample; rules then run in descending order of rejection per cost, and a measure that only
later rules need is not computed for a text that an earlier one has rejected. The order, and so
``rejected_by`` (the first rule of the cascade that rejects), may differ from run to run; whether
a text is kept does not.

Words are maximal runs of other characters than the six ASCII white spaces; lines are cut at line
feeds only. Windows of words are compared by chained 64-bit hashes inside one text: two unlike
windows of a text of a million words meet by chance in one text of 10^7. Everything is computed
inside a row, so nothing is shuffled and a hot source, id or text costs no more than other rows.

Null and empty texts and texts of white space have no words and no lines with words; all their
measures are 0. Rows are judged one by one: repeated rows and ids give repeated results. An empty
table gives an empty result. Other columns are ignored whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irregts.session import materialise

#: Words of a window; expected rows of the sample; how often each rule is timed on it.
WINDOW, SAMPLE, TIMES = 8, 2000, 2
SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_WORD_START = "[^\\x20\\x09-\\x0D]"


class Rule(NamedTuple):
    """Rejects a text where ``rejects`` is true, an expression over the measures it ``needs``."""

    name: str
    needs: tuple[str, ...]
    rejects: str


class Estimate(NamedTuple):
    """Of a rule on the sample: seconds beyond those of reading it, and share of texts rejected."""

    rule: Rule
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / self.seconds


def words() -> Column:
    """The words of ``text``."""
    plain = F.coalesce(F.col("text"), F.lit(""))
    for space in SPACES:
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def lines() -> Column:
    """The lines of ``text`` that have a word."""
    cut = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    return F.filter(cut, lambda line: line.rlike(_WORD_START))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chained(hashes: Column, step: int) -> Column:
    """Hash i joined with hash i + step."""

    def joined(all_: Column) -> Column:
        left = F.greatest(F.size(all_) - step, F.lit(0))
        return F.zip_with(F.slice(all_, 1, left), F.slice(all_, step + 1, left), lambda a, b: F.xxhash64(a, b))

    return _once(hashes, joined)


def window_hashes(all_words: Column) -> Column:
    """One hash per window of ``WINDOW`` consecutive words, by doubling."""
    hashes = F.transform(all_words, lambda word: F.xxhash64(word))
    step = 1
    while step < WINDOW:
        hashes = _chained(hashes, step)
        step *= 2
    return hashes


def repeat_words(hashes: Column) -> Column:
    """Words inside windows whose hash occurs at least twice, given all windows of a text."""

    def covered(placed: Column) -> Column:
        # Equal hashes are neighbours once sorted.
        def again(at: Column, i: Column) -> Column:
            before = F.get(placed, i - 1)["hash"] == at["hash"]
            after = F.get(placed, i + 1)["hash"] == at["hash"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        places = F.array_sort(F.transform(F.filter(placed, again), lambda at: at["place"]))
        return _once(
            places,
            lambda found: F.aggregate(
                F.zip_with(found, F.slice(found, 2, F.size(found)), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
                F.lit(0).cast("long"),
                lambda total, n: total + n,
            ),
        )

    def count(all_: Column) -> Column:
        placed = F.array_sort(F.transform(all_, lambda h, i: F.struct(h.alias("hash"), i.alias("place"))))
        distinct = F.size(F.array_distinct(all_)) == F.size(all_)
        return F.when(distinct, F.lit(0).cast("long")).otherwise(_once(placed, covered))

    return _once(hashes, count)


def _count(condition: Callable[[Column], Column], of: str) -> Column:
    return F.size(F.filter(F.col(of), condition)).cast("long")


#: Measures of a text, over its columns ``text``, ``words`` and ``lines``.
MEASURES: dict[str, Callable[[], Column]] = {
    "n_words": lambda: F.size("words").cast("long"),
    "word_chars": lambda: F.length(F.array_join("words", "")).cast("long"),
    "n_symbols": lambda: F.length(F.regexp_replace(F.coalesce("text", F.lit("")), f"[^{SYMBOLS}]+", "")).cast("long"),
    "n_lines": lambda: F.size("lines").cast("long"),
    "n_dup_lines": lambda: (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    "n_repeat_words": lambda: repeat_words(window_hashes(F.col("words"))),
    "n_letter_words": lambda: _count(lambda word: word.rlike("\\p{L}"), "words"),
    "n_bullet_lines": lambda: _count(lambda line: line.rlike("^\\s*[-*•]"), "lines"),
    "n_cut_lines": lambda: _count(lambda line: line.rlike("(\\.\\.\\.|…)\\s*$"), "lines"),
}

#: The base of every verdict, and rules as published for web text, some of them milder.
BASE = (
    Rule("few_words", ("n_words",), "n_words < 20"),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), "100 * n_repeat_words > 30 * n_words"),
)
RULES = (
    *BASE,
    Rule("word_length", ("n_words", "word_chars"), "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("symbols", ("n_words", "n_symbols"), "10 * n_symbols > n_words"),
    Rule("words_without_letter", ("n_words", "n_letter_words"), "10 * n_letter_words < 8 * n_words"),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), "2 * n_dup_lines > n_lines"),
    Rule("bullets", ("n_lines", "n_bullet_lines"), "10 * n_bullet_lines > 9 * n_lines"),
    Rule("cut_lines", ("n_lines", "n_cut_lines"), "10 * n_cut_lines > 3 * n_lines"),
)


def _with_measures(df: DataFrame, names: Iterable[str], where: Column | None = None) -> DataFrame:
    for name in names:
        if name not in df.columns:
            value = MEASURES[name]()
            df = df.withColumn(name, value if where is None else F.when(where, value))
    return df


def _opened(documents: DataFrame, *keep: Column) -> DataFrame:
    return documents.select(*keep, "text").withColumns({"words": words(), "lines": lines()})


def estimate(documents: DataFrame, rules: Sequence[Rule] = RULES, sample: int = SAMPLE) -> list[Estimate]:
    """Cost and selectivity of each rule on about ``sample`` rows, timed in one task so that
    seconds add up; two counts a rule reach the driver. All rules are given words and lines."""
    total = documents.count()
    drawn = documents if total <= sample else documents.sample(sample / total, seed=WINDOW)
    drawn = materialise(_opened(drawn), "rule_sample").coalesce(1)

    def run(df: DataFrame, rejects: Column) -> tuple[float, int, int]:
        started = time.perf_counter()
        n, hits = df.agg(F.count(F.lit(1)), F.count_if(rejects)).first()
        return time.perf_counter() - started, n, hits

    reading = F.size("words") + F.size("lines") + F.length("text") < 0
    idle = min(run(drawn, reading)[0] for _ in range(TIMES))
    found = []
    for rule in rules:
        measured = _with_measures(drawn, rule.needs)
        runs = [run(measured, F.expr(rule.rejects)) for _ in range(TIMES)]
        _, n, hits = runs[0]
        found.append(Estimate(rule, max(min(r[0] for r in runs) - idle, 1e-3), hits / max(n, 1)))
    return found


def best_order(estimates: Iterable[Estimate]) -> list[Rule]:
    """Most rejections a second first; of those that reject nothing the cheapest first."""
    return [e.rule for e in sorted(estimates, key=lambda e: (-e.gain, e.seconds, e.rule.name))]


def cascade(
    documents: DataFrame,
    rules: Sequence[Rule] = RULES,
    whole: Sequence[str] = (),
    order: Sequence[Rule] | None = None,
) -> DataFrame:
    """One row per document: doc_id, text, the measures in ``whole``, ``rejected_by`` (null: kept).

    ``order`` is the order of rules, estimated on ``documents`` if not given. Measures in ``whole``
    are computed for every text, all others only where no earlier rule has rejected it.
    """
    order = best_order(estimate(documents, rules)) if order is None else order
    df = _with_measures(_opened(documents, F.col("doc_id")), whole)
    df = df.withColumn("rejected_by", F.lit(None).cast("string"))
    for rule in order:
        alive = F.col("rejected_by").isNull()
        df = _with_measures(df, rule.needs, alive)
        df = df.withColumn("rejected_by", F.when(alive & F.expr(rule.rejects), F.lit(rule.name)).otherwise(F.col("rejected_by")))
    return df.select("doc_id", "text", *whole, "rejected_by")


def digests(documents: DataFrame) -> DataFrame:
    """Measures of every text, whether the base fails and whether the cascade keeps it."""
    whole = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    failed = F.expr(" or ".join(f"({rule.rejects})" for rule in BASE))
    return cascade(documents, whole=whole).select(
        "doc_id", *whole, failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept")
    )
