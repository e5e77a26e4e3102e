"""Vector codes, hard negatives and packing: plain versions, SQL and edge cases."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.helpers import SF, duck, duck_rows, spark_rows
from trajecta.llm import hard_negatives as H
from trajecta.llm import packing as P
from trajecta.llm import queries as Q
from trajecta.llm import vector_codes as C
from trajecta.llm import vectors as V

NAN, INF = float("nan"), float("inf")


def _vectors(n, dim, seed=1, equal=0):
    r = np.random.default_rng(seed)
    m = r.normal(0, 0.2, (n, dim)).astype(np.float32)
    m[:equal] = m[0]
    return [(int(i), m[i].tolist(), int(r.integers(0, 10)) if i % 11 else None) for i in range(n)]


def _frame(spark, rows):
    # Extra columns with names that the operators use inside.
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return d.withColumns({"n": F.lit("x"), "error": F.lit(1), "question": F.lit(None).cast("int"), "number": F.lit(0.5), "pass": F.lit(7)})


ODD = [(None, [0.1] * 8, 1), (3, None, 1), (4, [0.1, None] * 4, 2), (5, [NAN] * 8, 2), (6, [INF] * 8, None), (7, [], 3), (8, [0.5] * 5, 3), (100, [0.25] * 8, 1), (100, [0.25] * 8, 1), (200, [-0.25] * 8, None), (300, [1e30] * 8, 2), (0, [0.5] * 8, 1), (9, [0.5] * 8, 1), (9, [0.5] * 8, 1), (10, [0.3] * 8, 4), (11, [0.3] * 8, 5)]


@pytest.mark.parametrize("points, entries, width, span", [(1, 1, 4, 9), (40, 3, 2, 3), (700, 64, 4, 6), (3000, 64, 4, 200), (3000, 17, 1, 4)])
def test_tree_assigns_like_a_full_search(points, entries, width, span):
    r = np.random.default_rng(points)
    own = r.integers(-span, span, (points, width))
    own[: points // 3] = own[0]
    depth = C._depth(points)
    full = np.concatenate([own, np.repeat(own[:1], (-points) % (1 << depth), axis=0)])
    order = C.grow(full, depth)
    assert sorted(order) == list(range(len(full)))
    book = r.integers(-span, span, (entries, width))
    book[entries // 2 :] = book[: entries - entries // 2]  # ties
    owner, count, total = C.Tree(full[order], (order < points).astype(np.int64), depth).assign(book)
    want = ((full[order][:, None] - book) ** 2).sum(axis=2).argmin(axis=1)
    real = order < points
    sums = np.zeros_like(book)
    np.add.at(sums, want[real], full[order][real])
    assert (owner == want).all() and (count == np.bincount(want[real], minlength=entries)).all() and (total == sums).all()


def _plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted((i, V.scaled(np.array(v, np.float32)).astype(np.int64)) for i, v, _ in rows)
    m = np.array([v for _, v in kept])
    cut = m.reshape(len(m), parts, -1)
    books = cut[:entries].transpose(1, 0, 2).copy()
    for step in range(rounds + 1):
        far = ((cut[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        by = far.argmin(axis=2)
        if step < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    if (by[:, p] == e).any():
                        books[p, e] = cut[by[:, p] == e, p].sum(axis=0) // (by[:, p] == e).sum()
    return {i: ("".join(f"{x:02x}" for x in c), int(f.min(axis=1).sum())) for (i, _), c, f in zip(kept, by, far, strict=True)}, books


def test_codes_equal_plain_lloyd(spark):
    rows = _vectors(900, 32, equal=300)
    codes, books = C.compress(_frame(spark, rows).repartition(5))
    want, plain = _plain_codes(rows)
    assert {r.vec_id: (r.code, r.error) for r in codes.collect()} == want and (books == plain).all()
    by_label = Counter()
    for i, _, label in rows:
        by_label[label] += want[i][1]
    assert {r.label: r.label_error for r in C.report(_frame(spark, rows)).collect()} == by_label


def test_codes_of_odd_rows(spark):
    got = C.report(_frame(spark, ODD)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == sorted((i is None, i or 0) for i, v, _ in ODD if v and len(v) == 8 and None not in v and np.isfinite(v).all())
    assert {len(r.code) for r in got} == {32} and len({r.codebooks_sha256 for r in got}) == 1
    assert C.report(_frame(spark, ODD).limit(0)).count() == 0
    assert C.report(_frame(spark, [(1, None, 1)])).count() == 0


def _plain_negatives(rows, every=100, positives=5, negatives=10):
    kept = [(i, V.scaled(np.array(v, np.float32)).astype(np.int64), g) for i, v, g in rows if i is not None and g is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for a, va in sorted({(i, tuple(v)): (i, v) for i, v, _ in kept if i % every == 0}.values(), key=lambda x: x[0]):
        label = next(g for i, v, g in kept if i == a)
        scored = sorted((-int(va @ v), i, g) for i, v, g in kept if i != a and len(v) == len(va))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(inside)]
    return sorted(out)


def _mined(frame, **more):
    return sorted(tuple(r) for r in H.mine(frame, F.col("vec_id") % 100 == 0, **more).collect())


@pytest.mark.parametrize("dim, equal, per_pass", [(16, 0, 4096), (16, 500, 3), (3, 200, 4), (64, 0, 1)])
def test_negatives_equal_a_full_search(spark, dim, equal, per_pass):
    rows = _vectors(1500, dim, seed=dim, equal=equal)
    got = _mined(_frame(spark, rows).repartition(3), per_pass=per_pass)
    assert got == _plain_negatives(rows) and got


def test_negatives_of_odd_rows(spark):
    got = _mined(_frame(spark, ODD))
    assert got == _plain_negatives(ODD) and got
    assert _mined(_frame(spark, ODD).limit(0)) == [] and _mined(_frame(spark, [(100, [0.5], 1)])) == []


def test_bounds_hold_the_scores(spark):
    rows = _frame(spark, _vectors(2000, 24, seed=9))
    outlier = _frame(spark, [(5000, [90.0] + [0.0] * 23, 1)])
    file = H.write_file(H.usable_rows(rows.unionByName(outlier))).toArrow()
    anchors = np.random.default_rng(2).integers(-90, 90, (7, 24))
    for batch in file.to_batches():
        for row in range(batch.num_rows):
            b = H.Block(batch, row)
            low, high = b.bounds(b.tables(anchors), 0, b.n)
            exact = b.vectors.astype(np.int64) @ anchors.T
            assert (low <= exact).all() and (exact <= high).all()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(Q.tokenizer_file("byte_bpe_50k.json"))


def test_words_encode_like_whole_texts(tokenizer):
    r = random.Random(4)
    bits = ["a", "Be", "é", " ", "  ", "\n", "\t", "'s", "'ll", "12", "½", "漢字", "\xa0", " ", "😀", "-", "...", "᠎", "\x1f", "\x01", "\0", "<|endoftext|>", "<|", "　", "ü", "\r\n", "\x85", "٣", "ǅ", "x" * 70]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    with open(Q.tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as f:
        got = P.WordEncoder(f.read()).encode([x.encode() for x in texts])
    for t, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2], t


def _check_packing(docs, packed, tokenizer, capacity=1024):
    """Every document's pieces in order, whole and at their places; no gaps, nothing over the capacity."""
    want = Counter()
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        start = 0
        for k, n in enumerate(P.cut(len(ids), capacity)):
            want[doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
            start += n
        assert start == len(ids)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    by: dict = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by), -(-sum(k[3] * v for k, v in want.items()) // capacity)


def test_packing_of_documents(spark, tokenizer):
    docs = duck().sql("SELECT doc_id, text FROM documents").fetchall()
    n, least = _check_packing(docs, Q.op13_packing(spark, SF).collect(), tokenizer)
    assert n <= least + 1


def test_packing_of_odd_rows(spark, tokenizer):
    rows = [(1, "hello"), (2, None), (3, ""), (None, "no id"), (4, "lorem ipsum dolor " * 9000), (5, "same"), (5, "same"), *[(k, "copy of a line") for k in range(10, 400)]]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"length": F.lit("x"), "part": F.lit(0.5), "place": F.lit(1), "rank": F.lit(2)}).repartition(5)
    n, least = _check_packing(rows, P.report(d, Q.tokenizer_file("byte_bpe_50k.json")).collect(), tokenizer)
    assert n <= least + 1
    assert P.report(d.limit(0), Q.tokenizer_file("byte_bpe_50k.json")).count() == 0
    packed = P.pack(d, Q.tokenizer_file("byte_bpe_50k.json"))
    whole = P.sequences(packed).collect()
    assert len(whole) == n and all(len(r.ids) == 4 * r.length and len(r.doc_ids) == len(r.offsets) for r in whole)
    text = "".join(tokenizer.decode([x for x in np.frombuffer(r.ids, "<u4").tolist() if x != 2]) for r in whole)
    assert text.count("copy of a line") == 390


def _best_fit(lengths, capacity):
    """Best fit one by one, longest first."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 37, 64])
    counts = {n: r.choice([1, 2, 7, 50]) for n in r.sample(range(1, capacity + 1), r.randint(1, capacity // 2))}
    used, slots = Counter(), Counter()
    for length, low, high, first, each, at in P.plan(counts, capacity):
        for rank in range(low, high):
            used[first + (rank - low) // each] += length
            slots[length, rank] += 1
            assert at + (rank - low) % each * length + length <= capacity
    assert slots == Counter({(n, k): 1 for n, c in counts.items() for k in range(c)})
    assert sorted(capacity - x for x in used.values()) == _best_fit([n for n, c in counts.items() for _ in range(c)], capacity)


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_hard_negatives"])
@pytest.mark.skipif(not os.path.isdir("/root/testdata/check_h"), reason="needs the tables with hot vectors")
def test_sql_on_hot_vectors(spark, name):
    assert spark_rows(Q.QUERIES[name](spark, "/root/testdata/check_h")) == duck_rows(duck("/root/testdata/check_h"), Q.SQL[name])


def test_distinct_words_tile_their_texts():
    from trajecta.llm import text as T

    texts = [b"", b" a  b", b"a\n", b"", "é a".encode(), b" a  b"]
    words, indices, places = T.distinct_words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert len(set(words)) == len(words) and T.joined_values(words, indices, places) == texts
    assert [words[i] for i in indices.to_pylist()] == [b" a", b"  b", b"a", b"\n", "é".encode(), b" a", b" a", b"  b"]
    words, indices, places = T.distinct_words(np.zeros(0, np.uint8), np.zeros(3, np.int64))
    assert T.joined_values(words, indices, places) == [b"", b""]
