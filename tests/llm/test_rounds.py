"""Whole sets are dealt out in rounds: what they take at once doesn't grow with the groups or pairs."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("trajecta.llm.simhash")

from trajecta.llm import simhash

from .test_brute_force import _similar_classes
from .test_families import _family


def test_sets_of_crowds_and_pairs_come_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 3)
    monkeypatch.setattr(simhash, "ROUND", 1)
    keep, sets = simhash.materialise, []

    def spied(df, name):
        table = keep(df, name)
        if {"group", "set"} <= set(df.columns):
            sets.append(sum(len(x.set) // 8 for x in table.select("set").collect()))
        return table

    monkeypatch.setattr(simhash, "materialise", spied)
    r = random.Random(4)
    lines = [[f"l{k}-{i}" for i in range(14)] for k in range(6)]
    texts = [x for k in range(6) for _ in range(3) for x in _family(r, lines[k] + [f"w{r.randrange(200)}" for _ in range(40)], 8, 6)]
    rows = list(enumerate(texts))
    got = {x.doc_id: x.component_id for x in simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _similar_classes(rows)
    assert len(sets) > 4 and max(sets) <= sum(sets) / 2, sets
