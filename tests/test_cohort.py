"""The cohort rules against a plain walk over the rows of each stay."""

import random
from dataclasses import replace

import pytest

from irregts.operators import cohort as co

BOUNDS = (20.0, 45.0, 80.0)


def stage_of(x):
    return sum(x >= b for b in BOUNDS)


def walk(rows, r):
    """Kept rows and labels, one stay after the other."""
    kept, labels = [], {}
    for ind in sorted({row[0] for row in rows}):
        stay = sorted((row for row in rows if row[0] == ind), key=lambda row: (row[1], row[2], row[3]))
        if r.max_hours is not None:
            stay = [row for row in stay if row[1] <= r.max_hours * 60]
        seen = [row for row in stay if row[2] == r.target]
        if not seen or all(row[2] in r.skippable for row in stay):
            continue
        last, entry, leave = seen[-1][1], stage_of(seen[0][3]), stage_of(seen[-1][3])
        if not stay[0][1] < last - r.pred_horizon * 60 or not last > r.pred_history * 60:
            continue
        if r.entry_stages is not None and entry not in r.entry_stages:
            continue
        if r.exit_stages is not None and leave not in r.exit_stages:
            continue
        if r.entry_above_exit is not None and not (entry > leave if r.entry_above_exit else entry < leave):
            continue
        present = {row[2] for row in stay}
        if (r.include and not present & set(r.include)) or present & set(r.exclude):
            continue
        kept += [row for row in stay if row[1] <= last]
        labels[ind] = leave
    return sorted(kept), labels


BASE = co.CohortRules(target=0, skippable=(0,), staging=BOUNDS)
SETTINGS = [
    BASE,
    replace(BASE, max_hours=20),
    replace(BASE, pred_horizon=5, pred_history=12),
    replace(BASE, skippable=(0, 1, 2), max_hours=10),
    replace(BASE, include=(3,), exclude=(4,)),
    replace(BASE, entry_stages=(1, 2), exit_stages=(0, 1, 2)),
    replace(BASE, entry_above_exit=True),
    replace(BASE, entry_above_exit=False, max_hours=30),
]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(11)
    rows = set()
    for ind in range(60):
        for _ in range(rng.choice([1, 2, 4, 9, 20])):
            rows.add((ind, rng.randrange(-120, 2400), rng.choice([0, 0, 1, 2, 3, 4]), float(rng.randrange(100))))
    # Ties on the time of the target, a target at time 0, a stay with nothing but the target.
    rows |= {(70, 50, 1, 1.0), (70, 60, 0, 10.0), (70, 60, 0, 90.0), (70, 60, 3, 1.0), (70, 61, 1, 1.0)}
    rows |= {(71, -5, 1, 1.0), (71, 0, 0, 5.0)}
    rows |= {(72, 1, 0, 5.0), (72, 9, 0, 5.0)}
    rows |= {(73, 1, 3, 5.0), (73, 5, 0, 30.0), (73, 9, 0, 31.0)}
    rows = sorted(rows)
    df = spark.createDataFrame(rows, "ind long, time long, itemid long, value double").repartition(4).cache()
    return rows, df


@pytest.mark.parametrize("rules", SETTINGS)
def test_rules_equal_a_walk_over_the_rows(data, rules):
    rows, df = data
    kept, labels = walk(rows, rules)
    assert sorted(tuple(r) for r in co.cull_cohort(df, rules).collect()) == kept
    assert {r["ind"]: r["label"] for r in co.stay_labels(df, rules).collect()} == labels


def test_culling_again_only_drops_stays_left_with_the_target(data):
    """Rows after the last target count as usable measures, but are cut off."""
    _, df = data
    rules = replace(BASE, max_hours=20)
    once = co.cull_cohort(df, rules)
    twice = co.cull_cohort(once, rules)
    assert twice.exceptAll(once).isEmpty()
    assert once.exceptAll(twice).filter(once["itemid"] != 0).isEmpty()


def test_stage_rules_need_a_staging(data):
    with pytest.raises(ValueError, match="staging"):
        co.CohortRules(target=0, entry_above_exit=True)
    with pytest.raises(ValueError, match="staging"):
        co.stay_labels(data[1], co.CohortRules(target=0))
    assert co.cull_cohort(data[1], co.CohortRules(target=0, skippable=(0,))).count() > 0
