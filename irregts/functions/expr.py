"""Column expressions shared by the operators. All of them stay inside codegen."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Timestamp layout of the source tables.
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
_DATE_LENGTH = len("yyyy-MM-dd")

# Upper bounds (mg/dL, exclusive) of the creatinine stages
# normal, risk and injury; anything above is failure.
KDIGO_BOUNDS = (1.35, 2.68, 4.16)

# Ages written as text or left blank in the stay demographics.
AGE_WORDS = {"> 89": 95, "": 50}

NAMED_STAGES = {"KDIGO": KDIGO_BOUNDS}

Staging = str | Sequence[float] | Callable[[Column], Column]


def parse_timestamp(text: Column) -> Column:
    """Timestamp without zone from text in exactly TIMESTAMP_FORMAT; other text is an error.

    The shape is checked first and the plain cast does the rest, which is several times
    faster than parsing by pattern.
    """
    shaped = (F.length(text) == len(TIMESTAMP_FORMAT)) & (F.substring(text, _DATE_LENGTH + 1, 1) == " ")
    problem = F.concat(F.lit(f"not a {TIMESTAMP_FORMAT} timestamp: "), text)
    strict = F.when(text.isNull() | shaped, text).otherwise(F.raise_error(problem).cast("string"))
    return strict.cast("timestamp_ntz")


def timestamp_text(at: Column) -> Column:
    """The inverse of :func:`parse_timestamp`; fractions of a second are cut off."""
    return F.substring(at.cast("string"), 1, len(TIMESTAMP_FORMAT))


def whole_minutes(start: Column, end: Column) -> Column:
    """Minutes between two timestamps without zone, cut toward zero.

    The interval form never passes through the session's time zone.
    """
    return (end - start).cast("interval minute").cast("bigint")


def all_present(*names: str) -> Column:
    """True where none of the columns is null. NaN counts as present."""
    return reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in names))


def recode_age(text: Column) -> Column:
    mapped = text
    for word, age in AGE_WORDS.items():
        mapped = F.when(text == word, F.lit(str(age))).otherwise(mapped)
    return mapped.cast("int")


def gender_code(gender: Column) -> Column:
    """-1 for M..., 1 for F..., 0 for anything else or nothing."""
    return (
        F.when(gender.startswith("M"), F.lit(-1.0))
        .when(gender.startswith("F"), F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def stage(value: Column, staging: Staging) -> Column:
    """Class of a value: the number of ascending bounds that it reaches.

    ``staging`` is a registered name, the bounds themselves, or a function from a
    column to an integer column.
    """
    if isinstance(staging, str):
        if staging not in NAMED_STAGES:
            raise ValueError(f"unknown staging {staging!r}; known: {sorted(NAMED_STAGES)}")
        staging = NAMED_STAGES[staging]
    if callable(staging):
        return staging(value)
    bounds = [float(b) for b in staging]
    if not bounds or bounds != sorted(bounds):
        raise ValueError("stage bounds must be ascending and not empty")
    out = F.when(value < bounds[0], 0)
    for i, bound in enumerate(bounds[1:], start=1):
        out = out.when(value < bound, i)
    return F.when(value.isNotNull(), out.otherwise(len(bounds))).cast("int")


def standardise(value: Column, mean: Column, std: Column) -> Column:
    return F.when(std != 0, (value - mean) / std).otherwise(value - mean)


def unstandardise(value: Column, mean: Column, std: Column) -> Column:
    return F.when(std != 0, value * std + mean).otherwise(value + mean)


def min_max_scale(value: Column, low: Column, high: Column) -> Column:
    return F.when(low != high, (value - low) / (high - low)).otherwise(value - low)


def min_max_unscale(value: Column, low: Column, high: Column) -> Column:
    return F.when(low != high, value * (high - low) + low).otherwise(value + low)


def huber(error: Column, delta: float = 1.0) -> Column:
    size = F.abs(error)
    return F.when(size <= delta, 0.5 * error * error).otherwise(delta * (size - 0.5 * delta))


def pinball(truth: Column, forecast: Column, q: Column) -> Column:
    zero = F.lit(0.0)
    return q * F.greatest(truth - forecast, zero) + (1 - q) * F.greatest(forecast - truth, zero)


def even_quantiles(k: int) -> list[float]:
    """k evenly spaced quantile levels strictly between 0 and 1."""
    if k < 1:
        raise ValueError(f"the number of quantiles must be positive, got {k}")
    return [i / (k + 1) for i in range(1, k + 1)]
