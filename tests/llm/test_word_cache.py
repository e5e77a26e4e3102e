"""Token output: a word that was seen before is not cut into pieces again."""

from __future__ import annotations

import pytest

pytest.importorskip("trajecta.llm.tokens")

from tokenizers import Tokenizer

from trajecta.llm import tokens
from trajecta.llm.queries import tokenizer_file

TEXTS = ["It's one, two and three.", "", "  two\x0band Three\n<|endoftext|> it's \x01 a\x01b", "x" * 70 + "1 café CAFÉ 中文 two", " \t"]


def test_words_are_put_together_once(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 60)
    rules = open(tokenizer_file(), encoding="utf-8").read()
    ours, library = tokens.Encoder(rules), Tokenizer.from_str(rules)
    want = [[*library.encode(x, add_special_tokens=False).ids, 1] for x in TEXTS]
    made, learn = [], ours._learn_words
    ours._learn_words = lambda new: made.extend(new) or learn(new)
    for _ in range(3):
        assert [x.tolist() for x in ours.encode([x.encode() for x in TEXTS])] == want
    assert made.count(b"two") == 1 and made.count(b"x" * 70 + b"1") == 3
    monkeypatch.setattr(tokens, "CACHE_WORDS", 1)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 1)
    assert [x.tolist() for x in ours.encode([x.encode() for x in TEXTS])] == want and made.count(b"two") == 2
