"""Linear models of all folds and outputs at once, by iteratively reweighted least squares.

A model belongs to a fold (its train side: the rows of the other folds) and an output: the one
of the squared and the Huber loss, or a quantile level of the pinball loss. Every iteration is one
pass over the rows: a task scales them with each fold's statistics, weighs them by the last
coefficients and adds up the Gram matrices of all models; the sums are added in tasks, and the
driver solves small systems. Rows are neither copied per fold nor shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irregts.operators.vectors import sum_vectors, vector_row

# Quantile levels of a three-output forecast, threshold of the Huber loss.
THREE_QUANTILES = (0.1, 0.5, 0.9)
HUBER_DELTA = 1.0

LOSSES = ("squaredError", "huber", "pinball")


@dataclass(frozen=True)
class Loss:
    """What a model minimises: the mean loss plus ``reg / 2`` times its squared coefficients, the
    intercept aside. The pinball loss is smoothed by ``smoothing`` at zero; it starts wider and
    halves with every iteration, which is what lets far rows move the first steps."""

    kind: str = "huber"
    delta: float = HUBER_DELTA
    levels: tuple[float, ...] = THREE_QUANTILES
    reg: float = 0.01
    smoothing: float = 1e-3

    def __post_init__(self) -> None:
        if self.kind not in LOSSES:
            raise ValueError(f"loss is one of {', '.join(LOSSES)}, not {self.kind!r}")
        if self.delta <= 0 or self.smoothing <= 0 or self.reg < 0:
            raise ValueError("delta and smoothing must be positive, reg not negative")
        if not self.levels or not all(0 < q < 1 for q in self.levels):
            raise ValueError(f"quantile levels lie between 0 and 1, got {self.levels}")

    @property
    def outputs(self) -> int:
        return len(self.levels) if self.kind == "pinball" else 1

    def width(self, step: int) -> float:
        return max(self.smoothing, 0.5**step)

    def weigh(self, residual: np.ndarray, output: int, step: int) -> tuple[np.ndarray, float]:
        """Weight of each row in the next least squares, and what is added to its weighted truth.

        Both losses are bounded by a parabola that touches them at the residual, so no step
        makes the (smoothed) loss larger.
        """
        size = np.abs(residual)
        if self.kind == "huber":
            return np.where(size <= self.delta, 1.0, self.delta / np.maximum(size, self.delta)), 0.0
        if self.kind == "pinball":
            return 0.5 / (size + self.width(step)), self.levels[output] - 0.5
        return np.ones_like(size), 0.0


@dataclass
class Scaling:
    """Per fold the means and deviations of its train side; NaN where it has none. ``plain``
    features are used as they are."""

    mean: np.ndarray  # folds x features
    std: np.ndarray
    y_mean: np.ndarray  # folds
    y_std: np.ndarray
    plain: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))  # features

    def features(self, raw: np.ndarray, fold: int) -> np.ndarray:
        """Intercept and normalised features; a missing value sits at its mean."""
        std = np.where(self.std[fold] != 0, self.std[fold], 1.0)
        scaled = (raw - self.mean[fold]) / np.where(np.isnan(std), 1.0, std)
        scaled = np.where(self.plain, raw, scaled)
        return np.concatenate([np.ones((len(raw), 1)), np.nan_to_num(scaled, nan=0.0, posinf=np.inf, neginf=-np.inf)], axis=1)

    def truth(self, y: np.ndarray, fold: int) -> np.ndarray:
        std = self.y_std[fold]
        return (y - self.y_mean[fold]) / (std if std != 0 and not np.isnan(std) else 1.0)


def _sums(
    batches: Iterator[pa.RecordBatch], names: Sequence[str], scaling: Scaling, loss: Loss, models: np.ndarray | None, step: int
) -> Iterator[pa.RecordBatch]:
    """One vector per task: per fold and output the Gram matrix beside the right-hand side, and
    the number of rows."""
    folds, p = len(scaling.mean), len(names) + 1
    total = np.zeros((folds, loss.outputs, p + 1, p + 1))
    for batch in batches:
        own, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "y"))
        raw = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names]
        raw = np.stack(raw, axis=1) if names else np.zeros((batch.num_rows, 0))
        for fold in range(folds):
            train = own != fold
            x, t = scaling.features(raw[train], fold), scaling.truth(y[train], fold)
            for output in range(loss.outputs):
                if models is None:
                    weight, more = np.ones(len(t)), 0.0
                else:
                    weight, more = loss.weigh(t - x @ models[fold, output], output, step)
                cell = total[fold, output]
                cell[:p, :p] += (x * weight[:, None]).T @ x
                cell[:p, p] += x.T @ (weight * t + more)
                cell[p, p] += len(t)
    yield vector_row(total)


def solve(system: np.ndarray, reg: float) -> np.ndarray:
    """Coefficients, intercept first, of one cell of :func:`_sums`; of least norm where several fit."""
    p = len(system) - 1
    n = max(system[p, p], 1.0)
    penalty = np.diag([0.0] + [reg] * (p - 1))
    return np.linalg.lstsq(system[:p, :p] / n + penalty, system[:p, p] / n, rcond=None)[0]


def fit_all(
    rows: DataFrame,
    names: Sequence[str],
    scaling: Scaling,
    loss: Loss,
    iterations: int,
    tolerance: float,
    start: tuple[int, np.ndarray] | None = None,
    after_step: Callable[[int, np.ndarray], None] | None = None,
) -> np.ndarray:
    """Coefficients (folds x outputs x (intercept and features)) from written ``rows``: the test
    ``fold`` of each, ``y`` and the raw features ``names``, doubles.

    Least squares first, then at most ``iterations`` reweighted steps, until no coefficient moves
    by more than ``tolerance``. ``start`` continues after a step that ``after_step`` was told of.
    Rows without a truth are left out.
    """
    wanted = [F.col(c).cast("double").alias(c) for c in names]
    ready = rows.filter(F.col("y").isNotNull() & ~F.isnan("y")).select(F.col("fold").cast("int").alias("fold"), F.col("y").cast("double").alias("y"), *wanted)
    shape = (len(scaling.mean), loss.outputs, len(names) + 2, len(names) + 2)

    def solved(models: np.ndarray | None, step: int) -> np.ndarray:
        made = ready.mapInArrow(lambda it: _sums(it, list(names), scaling, loss, models, step), "values binary")
        total = sum_vectors(made, "float64")
        cells = np.zeros(shape) if total is None else total.reshape(shape)
        return np.array([[solve(cell, loss.reg) for cell in fold] for fold in cells])

    step, models = start if start is not None else (0, solved(None, 0))
    while loss.kind != "squaredError" and step < iterations:
        before, step = models, step + 1
        models = solved(before, step)
        if after_step is not None:
            after_step(step, models)
        if np.abs(models - before).max() <= tolerance and (loss.kind == "huber" or loss.width(step) <= loss.smoothing):
            break
    return models
