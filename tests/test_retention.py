"""Retention against a plain sort."""

import random

import pytest
from lumenreel.operators import state


@pytest.mark.parametrize("keep", [0, 1, 3, 4])
def test_expired_is_all_past_the_newest(spark, keep):
    rng = random.Random(keep)
    names = [f"{p}-{rng.randrange(30)}" for p in ("a", "b-c", "") for _ in range(40)] + ["a-007", "a-7", "a-x", "a-", "plain", "few-1", "few-2"] + ["one-5"] * 6 + [None] * 5
    by = {}
    for n in names:
        cut = (n.rsplit("-", 1) if "-" in n else (n, n)) if n is not None else (None, "")
        by.setdefault(cut[0], []).append((int(cut[1]) if cut[1].isdigit() else 0, n or ""))
    want = sorted((n, s) for group in by.values() for s, n in sorted(group, reverse=True)[keep:])
    got = state.expired(spark.createDataFrame([(n,) for n in names], "name string").repartition(7), keep)
    assert sorted((r["name"] or "", r["stamp"]) for r in got.collect()) == want


def test_expired_never_sorts_a_prefix_in_one_task(spark):
    rows = state.expired(spark.range(0, 60_000, 1, 6).selectExpr("concat('backup-', id) as name"))
    assert rows.count() == 59_997 and "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()
