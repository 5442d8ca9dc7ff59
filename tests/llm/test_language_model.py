"""Scores against a direct computation over dictionaries."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import ODD
from waytrace.llm import language_model as lm


def lower(text):
    return (text or "").encode().lower()


def held(key):
    return key is not None and zlib.crc32(str(key).encode()) % 7 == 2


def brute(docs):
    seen = [defaultdict(Counter) for _ in range(lm.ORDER + 1)]
    words = Counter()
    pad = bytes([lm.PAD]) * lm.ORDER
    for key, text in docs:
        if not held(key):
            words.update(lower(text).split())
            words[None] += 1
            raw = pad + lower(text) + bytes([lm.END])
            for i in range(lm.ORDER, len(raw)):
                for j in range(lm.ORDER + 1):
                    seen[j][raw[i - j : i]][raw[i]] += 1
    n, v = sum(words.values()), len(words)
    out = []
    for key, text in docs:
        tokens = [*lower(text).split(), None]
        raw, score = pad + lower(text) + bytes([lm.END]), 0.0
        for i in range(lm.ORDER, len(raw)):
            gone = set()
            for j in range(lm.ORDER, -1, -1):
                left = {s: c for s, c in seen[j][raw[i - j : i]].items() if s not in gone}
                total = sum(left.values()) + len(left)
                if raw[i] in left:
                    score += math.log10(left[raw[i]] / total)
                    break
                score += math.log10(len(left) / total) if left else 0
                gone |= set(left)
            else:
                score -= math.log10(256 - len(gone))
        base = sum(math.log10((words[t] + 1) / (n + v + 1)) for t in tokens)
        out.append((key, held(key), len(tokens), sum(words[t] > 0 for t in tokens), n, base, score))
    return out


def check(rows, docs):
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    for r, w in zip(sorted(map(tuple, rows), key=order), sorted(brute(docs), key=order), strict=True):
        assert r[:5] == w[:5]
        assert r[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize(("head", "segment"), [(1 << 18, 1 << 20), (0, 64), (3, 1 << 20)])
def test_documents(make_docs, monkeypatch, head, segment):
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    monkeypatch.setattr(lm, "SEGMENT_BYTES", segment)
    docs = [*((k, (t or "")[:1500] or t) for k, t in ODD), *((i, f"The {i % 7} cats sat ON the mat{i}. " * (i % 4)) for i in range(20, 60))]
    assert any(held(k) for k, _ in docs)
    check(lm.score(make_docs(docs)).collect(), docs)


def test_no_training(make_docs):
    key = next(i for i in range(100) if held(i))
    (r,) = lm.score(make_docs([(key, "ab c")])).collect()
    assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0)
    assert r.score == pytest.approx(-5 * math.log10(256))


def test_empty(nothing):
    assert lm.score(nothing).count() == 0


def test_pruned_trie_is_a_distribution():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 103, 4000)
    keys = np.zeros(4000 - lm.ORDER, np.int64)
    for j in range(lm.ORDER + 1):
        keys |= raw[lm.ORDER - j : 4000 - j].astype(np.int64) << (8 * j)
    orders, floor = [], 0
    for j in range(lm.ORDER + 1):
        k, n = np.unique(keys & ((1 << 8 * (j + 1)) - 1), return_counts=True)
        floor = max(floor, 2 if j > 2 else 0)
        orders.append((k[n >= floor], n[n >= floor]))
    trie = lm.Trie(orders)
    for context in (keys[:5] >> 8).tolist() + [0, 0x6161616161, 0x7A7A7A6162]:
        p = 10 ** trie.log10((context << 8) | np.arange(256))
        assert p.sum() == pytest.approx(1.0)


def test_words_are_split_and_folded():
    text = "One two\u00a0three  ONE\x0btw\u00c9\x1cx \0 \0\0\n"
    assert lm.word_counts(text.encode()) == {b"one": 2, "two\u00a0three".encode(): 1, "tw\u00c9\x1cx".encode(): 1, b"\0": 1, b"\0\0": 1}


def test_words_that_a_polynomial_hash_confuses(make_docs):
    """Thue-Morse words collide under any polynomial hash modulo 2 ** 64."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    docs = [(i, t) for i, t in enumerate([a, b, a, "x"]) if not held(i)] + [(7, f"{a} {b}")]
    check(lm.score(make_docs(docs)).collect(), docs)


def test_better_than_words_on_repeating_text(make_docs):
    rng = np.random.default_rng(2)
    syllables = ["th", "an", "er", "ing", "on", "ti", "re", "ou", "ea", "st"]
    docs = [(i, " ".join("".join(rng.choice(syllables, 4)) for _ in range(120))) for i in range(250)]
    rows = [r for r in lm.score(make_docs(docs)).collect() if r.held_out]
    assert sum(r.score for r in rows) < 0
    assert np.mean([r.score / r.n_tokens for r in rows]) > -6


@pytest.mark.parametrize("most", [0, 200])
def test_most_pairs_are_joined(make_docs, monkeypatch, most):
    monkeypatch.setattr(lm, "HEAD_PAIRS", most)
    docs = [*((k, (t or "")[:60] or t) for k, t in ODD), *((i, f"The {i % 7} cats sat ON the mat{i}. " * (i % 4)) for i in range(20, 40))]
    check(lm.score(make_docs(docs)).collect(), docs)
