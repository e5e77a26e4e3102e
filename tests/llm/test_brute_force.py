"""Operators against plain versions of what they compute."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.helpers import SF, duck, duck_rows, spark_rows
from trajecta.llm import decontaminate, html_extract, language_model, mixing, pii, queries, simhash, tokens
from trajecta.llm import text as T
from trajecta.llm.queries import tokenizer_file


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == duck_rows(duck(), queries.SQL[name])


@pytest.fixture(scope="module")
def texts():
    return duck().sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def _valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 16 <= len(d) <= 19 and _luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def _base(t):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t) if _valid(k, m[0]))


def test_pii_base_spans(spark, texts):
    r = random.Random(5)
    made = [(1000 + i, "".join(r.choice(["a.b", "@", "x-y.", "1", "22", "255.", ".", " ", "+", "(", ")-", "é", "😀", "4111111111111111", "-"]) for _ in range(r.randint(0, 60)))) for i in range(300)]
    rows = texts + made
    got = {x.doc_id: x for x in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        b = _base(t)
        assert got[k].base_sha256 == hashlib.sha256(b.encode()).hexdigest(), t
        assert set(filter(None, b.split(","))) <= set(got[k].spans.split(","))


def test_pii_adds_what_the_base_misses(spark):
    rows = [(1, "call +1 (578) 555-6437 4918187128635271 now"), (2, "write to anna (at) example [dot] com please"), (3, "see version 2.10.3 and 12:30:45 today")]
    got = {x.doc_id: x.spans for x in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "card:23:39" in got[1] and "phone:5:22" in got[1] and got[2] == "email:9:36" and got[3] == ""


def test_tokens(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    got, start = {x.doc_id: x for x in queries.op2_token_output(spark, SF).collect()}, 0
    for k, text in texts:
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("abzABZéÉßΣςİ'.,!09<|>\x1c\x85  \n\t́eN中ñ\U0001f600-_ªº")), max_size=30))
def test_words_encode_like_texts(text):
    from tokenizers import Tokenizer

    rules = open(tokenizer_file(), encoding="utf-8").read()
    _ENCODER.append(_ENCODER[0] if _ENCODER else (tokens.Encoder(rules), Tokenizer.from_str(rules)))
    ours, library = _ENCODER[0]
    assert ours.encode([text.encode()], None)[0].tolist() == library.encode(text, add_special_tokens=False).ids


_ENCODER: list = []


def test_tasks_share_a_worker_s_encoder():
    rules = open(tokenizer_file(), encoding="utf-8").read()
    first = tokens.piece_encoder(rules)
    want = first.encode([b"one more word"])[0].tolist()
    again = tokens.piece_encoder("".join([rules[:9], rules[9:]]))
    assert again is first and "more" in again and again.encode([b"one more word"])[0].tolist() == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**32 - 1)), max_size=400), st.integers(1, 64), st.data())
def test_blocks_round_trip(ids, block, data):
    lengths, left = [], len(ids)
    while left:
        lengths.append(data.draw(st.integers(1, left)))
        left -= lengths[-1]
    shard = tokens.Shard(tokens.encode_shard([None, *range(1, len(lengths))] if lengths else [], lengths, np.array(ids, np.uint32), block))
    assert shard.decode_range(0, len(ids)).tolist() == ids
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert shard.decode_range(a, b).tolist() == ids[a:b]


def test_language_model_base_score(spark, texts):
    words = {k: [w for w in re.split("[\x20\x09-\x0d]+", t.translate({i: i + 32 for i in range(65, 91)})) if w] + ["\0end"] for k, t in texts}
    count = Counter(w for k, ws in words.items() if zlib.crc32(str(k).encode()) % 5 != 1 for w in ws)
    n, v = sum(count.values()), len(count)
    rows = language_model.score(spark.createDataFrame(texts, "doc_id long, text string"), chunk_bytes=100_000).collect()
    for r in rows:
        assert r.n_known == sum(count[w] > 0 for w in words[r.doc_id]) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words[r.doc_id]))
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_class_probabilities_add_up():
    rng, lm = np.random.default_rng(4), language_model
    words = np.sort(rng.integers(1, 1 << 63, 200, dtype=np.uint64))
    leaf = lm.Classes.place(rng.permutation(200)).astype(np.int32)
    n, v = np.zeros(lm.CLASSES * lm.MEMBERS), np.zeros(lm.CLASSES * lm.MEMBERS)
    n[leaf] = rng.integers(1, 50, 200)
    known = lm.Classes(words, leaf, n[leaf].astype(int), n.reshape(lm.CLASSES, -1), v.reshape(lm.CLASSES, -1), 1 << 12)
    weights = tuple(rng.normal(size=(1 << 12, lm.CLASSES)).astype(np.float32) for _ in range(2))
    keys = [np.repeat(rng.integers(1, 1 << 63, 1, dtype=np.uint64), lm.CLASSES * lm.MEMBERS) for _ in range(4)]
    leaves = np.arange(lm.CLASSES * lm.MEMBERS)
    there = np.isin(leaves, leaf) | (leaves >= (lm.SINGLE + lm.HEAD) * lm.MEMBERS)
    empty = ~np.isin(leaves // lm.MEMBERS, leaves[there] // lm.MEMBERS)  # classes without words have next to no mass
    p = np.exp(lm.Scorer(known, weights).log_probabilities(*known.rows_of(keys, leaves), leaves))
    assert p[there | empty].sum() == pytest.approx(1, abs=1e-3)


def test_mix_is_near_its_targets_and_repeats(spark):
    r = random.Random(3)
    rows = [(i, "w " * r.randint(1, 60), f"s{min(i % 7, 3)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x for x in mixing.mix(df, group=16).collect()}
    again = {x.doc_id: x.taken for x in mixing.mix(df.repartition(7), group=16).collect()}
    assert {k: x.taken for k, x in got.items()} == again and len(got) == 3000
    assert sum({x.source_size: x.target for x in got.values()}.values()) == pytest.approx(sum(x.size for x in got.values()))
    for s in {x[2] for x in rows}:
        own = [got[i] for i, _, q in rows if q == s]
        assert sum(x.taken for x in own) == pytest.approx(own[0].target, rel=0.02)
        assert own[0].target <= 3 * own[0].source_size + 1e-6
    kept = mixing.apply_mix(df, group=16)
    assert kept.count() == sum(x.copies for x in mixing.mix(df, group=16).collect())


def _fingerprint(t):
    w = t.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def _components(fps):
    least = dict(enumerate(range(len(fps))))

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                least[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("bucket", [2, 32])
def test_links_lose_nothing(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(bucket)
    fps = [r.getrandbits(64) for _ in range(12)]
    for _ in range(150):
        fps.append(r.choice(fps) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    fps = list(dict.fromkeys(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    from trajecta.llm.components import connected_components

    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    root = {x.node: x.root for x in connected_components(edges).collect()}
    want = _components(fps)
    got = [root.get(x, x) for x in signed]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_near_duplicates(spark, texts):
    fps = [_fingerprint(t) for _, t in texts]
    want = {k: (f, texts[c][0]) for (k, _), f, c in zip(texts, fps, _components(fps), strict=True)}
    got = {x.doc_id: (int(x.fingerprint, 16), x.component_id) for x in queries.op9_simhash(spark, SF).collect()}
    assert got == want


def _shingles(t):
    w = t.encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _similar_classes(rows):
    sets = [_shingles(t) for _, t in rows]
    least = list(range(len(rows)))

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if (not x and not y) or (4 * max(len(x), len(y)) <= 5 * min(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y)):
                a, b = sorted((find(i), find(j)))
                least[b] = a
    return {k: rows[find(i)][0] for i, (k, _) in enumerate(rows)}


@pytest.mark.parametrize("frequent", [0, 1 << 16])
def test_similar_texts_are_all_linked(spark, texts, monkeypatch, frequent):
    monkeypatch.setattr(simhash, "FREQUENT", frequent)
    r = random.Random(11)
    say = lambda n: [f"w{r.randrange(500)}" for _ in range(n)]
    line, made = say(12), ["", " ", "a b", "A  b", "a b c"]
    for n in (6, 9, 14, 30, 80, 300):
        for _ in range(6):
            base = line + say(n)
            made.append(" ".join(base))
            for share in (0.005, 0.02, 0.03, 0.045, 0.06):
                made.append(" ".join(f"x{r.randrange(99)}" if r.random() < share else w for w in base))
    rows = texts + [(10_000 + i, t) for i, t in enumerate(made)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _similar_classes(rows)
    assert {x.doc_id: x.component_id for x in simhash.similar_classes(docs).collect()} == want
    assert len(set(want.values())) < len(rows) - 60
    if frequent:
        import corpus_pipeline

        assert {x.doc_id for x in corpus_pipeline.simhash_stage(spark, docs, SF).collect()} == set(want.values())


def test_index_finds_all_occurrences():
    r = np.random.default_rng(2)
    seq = r.integers(2, 5, 500)
    index = decontaminate.FMIndex(seq, 5)
    phrases = np.unique(r.integers(2, 5, (60, 4)), axis=0)
    which, lo, hi = index.search(phrases)
    found = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, lo, hi, strict=True)}
    for k, p in enumerate(phrases):
        assert found.get(k, []) == [i for i in range(497) if (seq[i : i + 4] == p).all()]


def test_cut_is_minimal():
    r = random.Random(4)
    for _ in range(60):
        n = r.randint(1, 6)
        source, sink = [r.random() for _ in range(n)], [r.random() for _ in range(n)]
        edges = [(i, j, r.random()) for i in range(n) for j in range(i) if r.random() < 0.5]
        net = html_extract.FlowNetwork(n + 2)
        for i in range(n):
            net.add(n, i, source[i])
            net.add(i, n + 1, sink[i])
        for i, j, w in edges:
            net.add(i, j, w, w)
        cost = lambda side: sum(sink[i] if side[i] else source[i] for i in range(n)) + sum(w for i, j, w in edges if side[i] != side[j])  # noqa: B023, E731
        assert cost(net.source_side(n, n + 1)[:n]) == pytest.approx(min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n)))


def test_extraction_on_unseen_pages():
    w, good, bad, missed = html_extract.train(), 0, 0, 0
    for page, content in html_extract.training_pages(80, seed=77):
        text = html_extract.extract(page, w)
        got = set(text.split("\n")) if text else set()
        good, bad, missed = good + len(got & content), bad + len(got - content), missed + len(content - got)
    assert bad + missed <= 0.03 * good


def test_toxic_words_are_learnt(spark):
    from trajecta.llm import toxicity

    r = random.Random(8)
    say = lambda: " ".join("".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 7))) for _ in range(40))
    rows = [(i, say() + (" you vexgrub " if i % 4 == 0 else " you there ") + say(), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], 1, x[2]) for x in rows], "doc_id long, quality int, toxic int")
    held = [(x.predicted, rows[x.doc_id][2]) for x in toxicity.score(docs, labels).collect() if x.held_out]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    rows = sorted(out.collect(), key=lambda x: x.start)
    assert rows and [x.start for x in rows] == [sum(y.n_tokens for y in rows[:i]) for i in range(len(rows))]
    assert len({x.doc_id for x in rows}) <= 200


def _plain_mix(h):
    top = (1 << 64) - 1
    for factor in (0xD6E8FEB86659FD93, 0xD6E8FEB86659FD93, None):
        h ^= h >> 32
        h = h * factor & top if factor else h
    return h


def test_language_model_score(spark, texts):
    """The model's probabilities from a plain reimplementation, token by token, on dictionaries."""
    lm, top, size = language_model, (1 << 64) - 1, {}
    texts = {k: " ".join((t or "").split()[:30]) for k, t in texts[:50]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in language_model.score(docs).collect()}
    hashed = {}
    for k, t in texts.items():
        part = T.Slice(pa.record_batch({"text": pa.array([t])}))
        hashed[k] = [int(x) for x in lm.tokens(part)[0]]
    crc = {k: zlib.crc32(str(k).encode()) for k in texts}
    train = [k for k in texts if crc[k] % 5 != 1]
    counts = Counter(w for k in train for w in hashed[k])
    signed = lambda w: w - (1 << 64) if w >> 63 else w
    head = sorted(counts, key=lambda w: (-counts[w], signed(w)))[: lm.SINGLE + lm.HEAD * lm.MEMBERS]
    leaf_of = {w: (i, 0) if i < lm.SINGLE else (lm.SINGLE + (i - lm.SINGLE) // lm.MEMBERS, (i - lm.SINGLE) % lm.MEMBERS) for i, w in enumerate(head)}
    leaf = lambda w: leaf_of.get(w) or (lm.SINGLE + lm.HEAD + (w >> 8) % 32, (w >> 20) % 64)
    for w, c in counts.items():
        size[leaf(w)] = [size.get(leaf(w), (0, 0))[0] + c, size.get(leaf(w), (0, 0))[1] + 1]
    members = {c: [m for m in range(64) if c >= 32 or (c, m) in leaf_of.values()] for c in range(64)}
    mass = {(c, m): size.get((c, m), (0, 0))[0] + 0.5 for c in members for m in members[c]}
    of_class = {c: sum(mass[c, m] for m in members[c]) for c in members}
    prior = {c: np.log((of_class[c] + 1e-9) / sum(x + 1e-9 for x in of_class.values())) for c in members}
    inner = {(c, m): np.log(mass[c, m] / of_class[c]) for c, m in mass}
    bits = language_model.ROWS[0].bit_length() - 1
    weights = [Counter(), Counter()]

    def rows(ws, i):
        one, two, three = (ws[i - k] if i >= k else int(lm._BEFORE) for k in (1, 2, 3))
        s = [int(x) for x in lm._SALT]
        keys = [_plain_mix(one ^ s[0]), _plain_mix((_plain_mix(one ^ s[1]) + two) & top), _plain_mix(two ^ s[2]), _plain_mix((_plain_mix(one ^ s[3]) + three) & top)]
        own = leaf(ws[i])[0]
        return [k >> (64 - bits) for k in keys], [((k >> 20) & ((1 << bits) - 64)) | own for k in keys]

    def softmaxes(ws, i):
        (a, b), own = rows(ws, i), leaf(ws[i])[0]
        z = {c: prior[c] + sum(weights[0][r, c] for r in a) for c in members}
        y = {m: inner[own, m] + sum(weights[1][r, m] for r in b) for m in members[own]}
        return a, b, *({k: np.exp(v) / sum(np.exp(x) for x in s.values()) for k, v in s.items()} for s in (z, y))

    for apart, smoothing in ((False, lm.SMOOTHING[0]), (True, lm.SMOOTHING[1])):
        seen, expected = [Counter(), Counter()], [Counter(), Counter()]
        for k in (k for k in train if ((crc[k] >> 8) % lm.SECOND == 0) == apart):
            for i, w in enumerate(hashed[k]):
                a, b, *p = softmaxes(hashed[k], i)
                for t, rs in enumerate((a, b)):
                    for r in rs:
                        seen[t][r, leaf(w)[t]] += 1
                        for o, v in p[t].items():
                            expected[t][r, o] += v
        for t in (0, 1):
            for key in expected[t].keys() | seen[t].keys():
                weights[t][key] += lm.RATE * np.log((seen[t][key] + smoothing) / (expected[t][key] + smoothing))
    for k, ws in hashed.items():
        total = 0.0
        for i, w in enumerate(ws):
            (c, m), (_, _, p, q) = leaf(w), softmaxes(ws, i)
            total += np.log10(p[c] * q[m])
            if c >= 32:
                total += np.log10((counts[w] + 0.5) / (size.get((c, m), (0, 0))[0] + 0.5 * (size.get((c, m), (0, 0))[1] + 1)))
        assert got[k].score == pytest.approx(total, rel=1e-4, abs=1e-4)
    again = {r.doc_id: r.score for r in language_model.score(docs.repartition(5)).collect()}
    assert all(again[k] == pytest.approx(r.score, rel=1e-5) for k, r in got.items())
