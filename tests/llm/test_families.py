"""Families of edited copies: all links, without a pair for each two members."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("trajecta.llm.simhash")

from trajecta.llm import simhash

from .test_brute_force import _similar_classes


def _family(r, base, members, most):
    for _ in range(members):
        edits = r.randrange(most)
        text = list(base)
        for _ in range(edits):
            text[r.randrange(len(text))] = f"x{r.randrange(10**6)}"
        yield " ".join(text)


def test_family_links_without_its_square(spark, monkeypatch):
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = list(enumerate(_family(r, base, 400, 30)))
    made, similar = {}, simhash._similar

    def counted(pairs, found, docs, shingle, name):
        made[name] = pairs.distinct().count()
        return similar(pairs, found, docs, shingle, name)

    monkeypatch.setattr(simhash, "_similar", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _similar_classes(rows)
    assert {x.doc_id: x.component_id for x in simhash.similar_classes(docs).collect()} == want
    assert len(set(want.values())) > 20
    assert made["more_links"] < 10 * len(rows), made


@pytest.mark.parametrize("crowd", [1, 3])
def test_crowded_shingles_lose_no_link(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "SAMPLE", 4)
    r = random.Random(crowd)
    line, texts = [f"l{i}" for i in range(14)], []
    for size in (6, 12, 40, 90):
        for _ in range(3):
            texts += _family(r, line + [f"w{r.randrange(200)}" for _ in range(size)], 12, 2 + size // 10)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _similar_classes(rows)
    assert {x.doc_id: x.component_id for x in simhash.similar_classes(docs).collect()} == want
    assert 12 < len(set(want.values())) < len(rows) - 30
