"""Joins of rows that Spark takes for fewer than they are."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("trajecta.llm.simhash")

from trajecta.llm import simhash


def test_exploded_keys_are_never_broadcast(spark, monkeypatch):
    r = random.Random(1)
    fps = [(0, x) for x in range(40)] + [(0, r.getrandbits(63)) for _ in range(100)]
    plans, keep = [], simhash.materialise
    monkeypatch.setattr(simhash, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    found = simhash.links(keep(spark.createDataFrame(fps, "x int, fp long"), "fps").select("fp").distinct())
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("SortMergeJoin") for p in plans) == 3 and not any("Broadcast" in p for p in plans)
    assert found.count() >= 39
