"""What the near-duplicate stage leaves on disk while it runs and after."""

from __future__ import annotations

import random
import time
from pathlib import Path

import pytest

pytest.importorskip("trajecta.llm.simhash")

import pyarrow.parquet as pq

from trajecta.llm import simhash, store

from .test_brute_force import _similar_classes
from .test_families import _family


@pytest.fixture
def folder(monkeypatch, tmp_path):
    monkeypatch.setattr(store, "shared_dir", lambda spark: f"file://{tmp_path}")
    return tmp_path / "trajecta"


def _shuffled(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p.name for d in folders for p in Path(d).rglob("shuffle_*.data")}


def test_written_tables_leave_no_shuffle_files(spark):
    before, name = _shuffled(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name)
    table = store.materialise(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "counts")
    for _ in range(50):
        if not _shuffled(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffled(spark) - before and spark.conf.get(name) == setting
    assert sorted(r["count"] for r in table.collect()) == [142] + [143] * 6


def test_discard_deletes_one_table(spark, folder):
    one, other = store.materialise(spark.range(5), "one"), store.materialise(spark.range(6), "other")
    store.discard(one)
    assert [p.name.split("-")[0] for p in folder.iterdir()] == ["other"] and other.count() == 6


def test_whole_sets_are_gone_when_they_are_compared(spark, monkeypatch, folder):
    monkeypatch.setattr(simhash, "CROWD", 3)
    made, whole = [], simhash._whole_sets
    monkeypatch.setattr(simhash, "_whole_sets", lambda *a: made.append(a[-1]) or whole(*a))
    r = random.Random(3)
    texts = [x for _ in range(6) for x in _family(r, [f"l{i}" for i in range(14)] + [f"w{r.randrange(200)}" for _ in range(40)], 12, 6)]
    rows = list(enumerate(texts))
    got = {x.doc_id: x.component_id for x in simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _similar_classes(rows) and {"crowds", "first_links", "more_links"} <= set(made)
    left = {p.parent.name for p in folder.rglob("*.parquet") if "set" in pq.read_schema(p).names}
    assert not left, left
