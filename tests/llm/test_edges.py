"""Nulls, empty and long texts, repeats, empty tables and clashing extra columns, for every operator."""

import hashlib

import pytest
import time

from pyspark.sql import functions as F

from trajecta.llm import decontaminate, html_extract, language_model, mixing, pii, quality, rollup, simhash, tokens, toxicity
from trajecta.llm.queries import tokenizer_file
from trajecta.llm.store import fresh_path

LONG = "lorem ipsum dolor " * 20000
ROWS = [(1, "hello world", "en", "a"), (2, None, "en", None), (3, "", None, "a"), (None, "text without id", "en", "b"), (4, LONG, "en", "b"), (5, "same text here", "en", "a"), (5, "same text here", "en", "a"), (6, " \t\n", "en", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    # Names that operators use inside.
    return d.withColumns({"score": F.lit(1), "size": F.lit("x"), "key": F.lit(0.5), "t": F.lit(None).cast("string"), "held_out": F.lit("?"), "chunk": F.lit(9), "fp": F.lit(1)})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (5, 1, 0), (4, 1, None), (99, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "Hello, world"), (2, None), (3, ""), (None, "same text"), (4, "hello world")], "item_id long, text string")


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=lambda x: (x is not None, x))


WANT = sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x))


def test_pii(docs, none):
    got = pii.report(docs)
    assert ids(got) == WANT and {r.base_sha256 for r in got.collect()} == {hashlib.sha256(b"").hexdigest()}
    assert pii.report(none).count() == 0


def test_tokens(spark, docs, none):
    path = fresh_path(spark, "t")
    tokens.write_tokens(docs, path, tokenizer_file())
    got = tokens.read_tokens(spark, path, with_ids=True)
    assert ids(got) == WANT
    rows = sorted(got.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == WANT and all(len(r.ids) == r.n_tokens and r.ids[-1] == 1 for r in rows)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    path = fresh_path(spark, "t")
    tokens.write_tokens(none, path, tokenizer_file())
    assert tokens.read_tokens(spark, path).count() == 0


def test_toxicity(docs, none, labels):
    got = toxicity.score(docs, labels)
    assert ids(got) == WANT and all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.score(none, labels).count() == 0
    assert toxicity.score(docs, labels.limit(0)).count() == len(ROWS)
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_language_model(docs, none):
    got = language_model.score(docs)
    assert ids(got) == WANT and all(r.score <= 1e-6 for r in got.collect())
    assert language_model.score(none).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs)
    rows = got.collect()
    assert ids(got) == WANT and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(none).count() == 0
    assert mixing.apply_mix(docs).columns == docs.columns


def test_decontamination(docs, none, benchmark):
    got = decontaminate.contamination(docs, benchmark)
    assert ids(got) == WANT
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].contaminated and by[1].n_items == 2 and by[1].items_sha256 == hashlib.sha256(b"1,4").hexdigest()
    assert by[5].n_hit == 2 and by[5].n_items == 0 and by[2].n_words == 0 and not by[3].contaminated
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, benchmark.limit(0)).collect())
    for size in (1 << 20, 12):
        kept = decontaminate.drop_contaminated(docs, benchmark, block_bytes=size)
        assert kept.columns == docs.columns and ids(kept) == [None, 2, 3, 4, 6]


def test_quality(docs, none):
    got = quality.measure(docs)
    assert ids(got) == WANT
    by = {r.doc_id: r for r in got.collect()}
    assert by[4].n_words == 60000 and by[4].n_repeat_words == 60000 and by[4].base_failed and not by[4].kept
    assert by[2].n_words == by[6].n_words == 0
    assert quality.measure(none).count() == 0
    kept = quality.apply_rules(docs, quality.RULES).collect()
    assert sorted(r.kept for r in kept) == sorted(r.kept for r in got.collect())


def test_rollup(spark, docs, none):
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.lifecycle(docs).collect()}
    assert got[("a", "en", "words-1")] == (3, 8) and got[(None, "en", "words-1")] == (1, 0)
    assert rollup.lifecycle(none).count() == 0


def test_rollup_batches_commit_once(spark):
    r = rollup.TokenRollup(spark, fresh_path(spark, "r"))
    assert r.totals().count() == 0
    change = spark.createDataFrame([("a", "en", "v", 1, 5), ("a", "en", "v", 1, 7), (None, None, "v", 1, None)], rollup._SCHEMA)
    assert r.commit("b1", change) and not r.commit("b1", change)
    assert r.commit("b2", spark.createDataFrame([("a", "en", "v", -1, -5)], rollup._SCHEMA))
    assert sorted((x.source or "", x.n_docs, x.n_tokens) for x in r.totals().collect()) == [("", 1, 0), ("a", 1, 7)]
    with pytest.raises(ValueError):
        r.commit("../x", change)


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs)
    assert ids(got) == WANT
    by = {r.doc_id: r for r in got.collect()}
    assert by[2].fp == by[3].fp == by[6].fp == 0 and by[6].component_id == 2
    assert simhash.near_duplicates(none).count() == 0
    assert ids(simhash.keep_one(docs)) == [None, 1, 2, 4, 5]


def test_html(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<article><p>One &amp; two.</p><p>Three</p></article><footer>x</footer>"), (None, "u", "<p"), (3, "u", "<nav><a href='#'>Home</a></nav>"), (4, "u", "<article>" + "<p>Some words here, and more.</p>" * 3000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(3))
    got = sorted((r.page_id or 0, r.text[:40], r.n_chars) for r in html_extract.main_text(pages).collect())
    assert (3, "One & two.\nThree", 16) in got and (3, "", 0) in got and (1, "", 0) in got and (2, "", 0) in got and len(got) == 6
    assert [x[2] for x in got if x[0] == 4] == [3000 * len("Some words here, and more.") + 2999]
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_apply_mix_takes_rows_without_ids_and_repeats_as_units(spark):
    rows = [(None, "a", f"w{i} " * 5, 1) for i in range(300)] + [(7, "b", "same text here", 2)] * 40 + [(None, None, None, 3)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _copy int")
    taken = mixing.mix(docs).agg(F.sum("copies").alias("n")).first().n
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns and out.count() == taken


def test_unclosed_markup_is_linear_and_stays_out_of_the_text():
    weights, body = html_extract.train(), "<article><p>" + "A sentence of the main text, as it is. " * 6 + "</p>"
    for junk in ("<a ", "<a '", '<a "', "<! ", "<script ", "</p>", "<div></x>", "<div>", "<!-- "):
        began = time.time()
        text = html_extract.extract(body + junk * (300_000 // len(junk)), weights)
        assert time.time() - began < 20 and set(text) <= set(body) - set("<>/")


@pytest.mark.parametrize("size", [10, 4096, 4097, 1_000_000])
def test_no_attribute_reaches_the_text(size):
    weights, body = html_extract.train(), "<article><p>" + "A sentence of the main text, as it is. " * 6 + "</p>"
    want = html_extract.extract(body, weights)
    long = "x" * size + " > leaked <b>words</b> 'and' "
    for attributes in (f'title="{long}"', f"title='{long.replace(chr(39), '')}'", f'title = "{long}" data-x=y"z', f'onclick="{long}" srcdoc="<p>{long}</p>"', f"{'x' * size}"):
        assert html_extract.extract(f"{body}<p {attributes}>Then the article goes on with its own words here.</p>", weights) == want + "\nThen the article goes on with its own words here.", attributes[-60:]
        assert html_extract.extract(f"{body}<script {attributes}>if (a > b) leaked();</script>", weights) == want


def test_quotes_outside_values_open_nothing():
    weights = html_extract.train()
    page = """<article><p>It's the first part of the article, which isn't long.</p><p class=a' id=b">It's the second part of the article, "as said".</p></article>"""
    assert html_extract.extract(page, weights) == """It's the first part of the article, which isn't long.\nIt's the second part of the article, "as said"."""


def test_quotes_without_partner_are_linear():
    weights, body = html_extract.train(), "<article><p>" + "A sentence of the main text, as it is. " * 6 + "</p>"
    for junk in ('<a x="', "<a x='", "<a x=\"'", "<a =", "<a x = ", '<script x="'):
        began = time.time()
        text = html_extract.extract(body + junk * (300_000 // len(junk)), weights)
        assert time.time() - began < 20 and set(text) <= set(body) - set("<>/")


def test_rollup_of_rows_without_id(spark):
    rows = [(1, "a b", "en", "s"), (None, "a b", "en", "s"), (2, "c d e", "en", "s"), (None, "f", "en", "s"), (3, "g", "en", "t"), (3, "g", "en", "t")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {(r.source, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.lifecycle(d).collect()}
    assert got == {("s", "words-1"): (2, 5), ("s", "pieces-1"): (2, 5), ("t", "words-1"): (2, 2), ("t", "pieces-1"): (2, 2)}


def test_mix_spreads_equal_rows_over_groups(spark):
    equal = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit("one two three").alias("text"))
    other = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("b").alias("source"), F.lit("w " * 40).alias("text"))
    docs = equal.unionByName(other)
    got = mixing.mix(docs, group=64).groupBy("target").agg(F.count("*").alias("rows"), F.sum("taken").alias("taken"), F.max("size").alias("size"), F.max("copies").alias("most")).collect()
    assert sorted(x.rows for x in got) == [500, 6000]
    assert all(abs(x.taken - x.target) <= 2 * x["size"] and x.most <= 3 for x in got)
    assert [(x.source, x.doc_id, x.rows) for x in mixing._repeated(mixing.sized(docs), 64).collect()] == [("a", None, 6000)]


def test_mix_targets_equal_plain_water_filling(spark):
    sizes = {"a": 100, "b": 10, "c": 400, "d": 5, None: 60}
    docs = spark.createDataFrame([(i, s, "w " * n) for i, (s, n) in enumerate(sizes.items())], "doc_id long, source string, text string")
    names = sorted(s for s in sizes if s) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, left, total = {}, dict(weight), float(sum(sizes.values()))
    while left:
        share = (total - sum(target.values())) / sum(left.values())
        full = [s for s in left if share * left[s] > 3 * sizes[s]]
        for s in full or list(left):
            target[s] = 3.0 * sizes[s] if full else share * left[s]
            del left[s]
    got = {x.source: x.target for x in mixing.targets(mixing.sized(docs)).collect()}
    assert got.keys() == target.keys() and all(abs(got[s] - target[s]) < 1e-6 for s in target)
