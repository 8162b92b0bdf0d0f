"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins. Cyclic boosting visits the features in turn and fits one
shallow tree (a few leaves over the feature's bins) to the gradient of the log loss; the
trees of a feature add up to one lookup table. Then the pairs of features that explain most
of the remaining gradient get tables of their own, boosted the same way with trees over
both features' bins. A score is the sigmoid of the added table entries.

The features come from the text alone. The classifier is fitted on at most about
``SAMPLE`` labelled rows, each drawn for itself whatever its id, in numpy on the driver.

Null and empty texts have the features of no bytes and no words. Labels that are null or
whose document is missing teach nothing; if a document has unlike labels, each counts.
Without labels, or with labels of one kind, the score is the same for every text. Repeated
rows are scored row by row. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import operator
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irregts.llm.common import LOWER, small_batches, unused, utf8
from irregts.session import materialise

#: Expected number of labelled rows that the model is fitted on.
SAMPLE = 40_000
BINS, LEAVES, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 32, 4, 60, 20, 8, 0.15
#: Smallest sum of hessians in a leaf, and the ridge on leaf values.
LEAF_WEIGHT, RIDGE = 2.0, 1.0

FEATURES = (
    "log_bytes", "log_words", "upper", "digits", "spaces", "line_ends", "pipes", "marks", "stops", "non_ascii",
    "word_length", "distinct_words", "top_word", "repeated_next", "short_words", "repeated_lines", "entropy",
)
_UPPER, _DIGIT = np.arange(65, 91), np.arange(48, 58)
_STOPS = np.frombuffer(b".,;:?'\"()-", np.uint8)
_MARKS = np.array([b for b in range(33, 127) if not chr(b).isalnum() and b not in _STOPS and b != ord("|")])


def features(raw: bytes) -> list[float]:
    """The numbers of ``FEATURES`` for one text."""
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if n else np.zeros(256, np.int64)
    share = counts / max(1, n)
    words = raw.translate(LOWER).split()
    m = max(1, len(words))
    seen = Counter(words)
    lines = [line for line in raw.split(b"\n") if line]
    used = share[share > 0]
    return [
        math.log1p(n),
        math.log1p(len(words)),
        share[_UPPER].sum(),
        share[_DIGIT].sum(),
        share[32],
        share[10],
        share[ord("|")],
        share[_MARKS].sum(),
        share[_STOPS].sum(),
        share[128:].sum(),
        (n - counts[32] - counts[9:14].sum()) / m,
        len(seen) / m,
        max(seen.values(), default=0) / m,
        sum(map(operator.eq, words, itertools.islice(words, 1, None))) / m,
        sum(k for w, k in seen.items() if len(w) < 4) / m,
        1 - len(set(lines)) / max(1, len(lines)),
        float(-(used * np.log(used)).sum()),
    ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _split(grad: np.ndarray, hess: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins; place 0 is no cut."""
    g, h = np.cumsum(grad), np.cumsum(hess)
    left, right = h[:-1], h[-1] - h[:-1]
    gain = g[:-1] ** 2 / (left + RIDGE) + (g[-1] - g[:-1]) ** 2 / (right + RIDGE) - g[-1] ** 2 / (h[-1] + RIDGE)
    gain = np.where((left >= LEAF_WEIGHT) & (right >= LEAF_WEIGHT), gain, -1.0)
    if not len(gain) or gain.max() <= 1e-9:
        return 0.0, 0
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def shallow_tree(grad: np.ndarray, hess: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Values per bin of a tree over one feature, grown leaf by best leaf."""
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        offers = [(*_split(grad[a:b], hess[a:b]), a, b) for a, b in parts]
        gain, at, a, b = max(offers)
        if not at:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = -grad[a:b].sum() / (hess[a:b].sum() + RIDGE)
    return out


def pair_tree(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a tree over two features: one cut of the first, then one of the
    second on either side, or the other way round."""

    def grown(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        left_g, left_h = np.cumsum(g, axis=0)[:-1], np.cumsum(h, axis=0)[:-1]
        best, out = 0.0, np.zeros_like(g)
        sides = []
        for side_g, side_h in ((left_g, left_h), (g.sum(0) - left_g, h.sum(0) - left_h)):
            cum_g, cum_h = np.cumsum(side_g, axis=1), np.cumsum(side_h, axis=1)
            all_g, all_h = cum_g[:, -1:], cum_h[:, -1:]
            gain = cum_g**2 / (cum_h + RIDGE) + (all_g - cum_g) ** 2 / (all_h - cum_h + RIDGE)
            ok = (cum_h >= LEAF_WEIGHT) & (all_h - cum_h >= LEAF_WEIGHT)
            sides.append(np.where(ok, gain, all_g**2 / (all_h + RIDGE)))
        total = sides[0].max(1) + sides[1].max(1) - g.sum() ** 2 / (h.sum() + RIDGE)
        if len(total) and total.max() > 1e-9:
            at = int(np.argmax(total))
            best = float(total[at])
            for rows, side in ((slice(0, at + 1), sides[0]), (slice(at + 1, None), sides[1])):
                cut = int(np.argmax(side[at])) + 1
                for columns in (slice(0, cut), slice(cut, None)):
                    weight = h[rows, columns].sum()
                    out[rows, columns] = -g[rows, columns].sum() / (weight + RIDGE)
        return best, out

    one, two = grown(grad, hess), grown(grad.T, hess.T)
    return one if one[0] >= two[0] else (two[0], two[1].T)


@dataclass
class QualityModel:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of feature rows: table entries of all bins, added."""
        at = self.bins(x)
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[at[:, j]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[at[:, i], at[:, j]]
        return _sigmoid(total)


def fit(x: np.ndarray, y: np.ndarray) -> QualityModel:
    """Boost the tables on feature rows ``x`` and labels ``y`` of 0 and 1."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = math.log(share / (1 - share))
    if not len(y) or y.min() == y.max():
        return QualityModel(base, [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    model = QualityModel(base, edges, [np.zeros(len(e) + 1) for e in edges])
    at, total = model.bins(x), np.full(len(y), base)
    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            p = _sigmoid(total)
            grad = np.bincount(at[:, j], p - y, len(table))
            hess = np.bincount(at[:, j], p * (1 - p), len(table))
            step = RATE * shallow_tree(grad, hess)
            table += step
            total += step[at[:, j]]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(edges[i]) + 1, len(edges[j]) + 1)
        cell, p = at[:, i] * shape[1] + at[:, j], _sigmoid(total)
        size = shape[0] * shape[1]
        grad, hess = np.bincount(cell, p - y, size), np.bincount(cell, p * (1 - p), size)
        return cell, grad.reshape(shape), hess.reshape(shape)

    gains = sorted(((pair_tree(*cells(i, j)[1:])[0], i, j) for i, j in itertools.combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((len(edges[i]) + 1, len(edges[j]) + 1)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            cell, grad, hess = cells(i, j)
            step = RATE * pair_tree(grad, hess)[1]
            table += step
            total += step.ravel()[cell]
    return model


def feature_column(text: str = "text") -> Column:
    @F.pandas_udf("array<double>")
    def compute(raws: pd.Series) -> pd.Series:
        return raws.map(lambda raw: [float(v) for v in features(raw)])

    return compute(utf8(text))


def score_column(model: QualityModel, values: str) -> Column:
    @F.pandas_udf("double")
    def compute(rows: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(rows.to_numpy())) if len(rows) else [], dtype=float)

    return compute(F.col(values))


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Fit on the labelled ones of ``documents`` (which give text or feature_values)."""
    small_batches(documents.sparkSession)
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality"))
    known = materialise(known.filter("_id is not null and quality in (0, 1)").distinct(), "known")  # two rows an id at most
    given = "feature_values" if "feature_values" in documents.columns else "text"
    same = F.col("doc_id") == F.col("_id")
    n = documents.select("doc_id").join(known, same).count()
    # Every labelled row is drawn for itself, so many rows of one id are thinned like others.
    draw = F.pmod(F.xxhash64("_id", "_row", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    rows = documents.select("doc_id", given, F.monotonically_increasing_id().alias("_row")).join(known, same)
    rows = rows.filter(draw < (sample / n if n > sample else 1.0))
    if given == "text":
        rows = rows.select("doc_id", "quality", feature_column().alias("feature_values"))
    rows = rows.select("doc_id", "quality", "feature_values").orderBy("doc_id", "quality", "feature_values").toPandas()
    x = np.stack(rows["feature_values"].to_numpy()) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, rows["quality"].to_numpy(float))


def score_documents(documents: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Learns from the others."""
    small_batches(documents.sparkSession)
    table = documents.select("doc_id", held_out.alias("held_out"), feature_column().alias("feature_values"))
    table = materialise(table, "features")
    model = learn(table.filter(~F.col("held_out")), labels, sample)
    scored = table.select("doc_id", "held_out", score_column(model, "feature_values").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def with_quality(documents: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """The documents that score ``least`` or more, all columns."""
    small_batches(documents.sparkSession)

    @F.pandas_udf("double")
    def score(raws: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(raw) for raw in raws]).reshape(len(raws), -1)))

    name = unused(documents, "quality_score")
    return documents.withColumn(name, score(utf8())).filter(F.col(name) >= least).select(documents.columns)
