"""Packing against the tokenizer itself."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tests.llm.conftest import ODD
from waytrace.llm import packing

tokenizers = pytest.importorskip("tokenizers")
PATH = packing._tokenizer_path(None)


@pytest.fixture(scope="module")
def raw():
    held = tokenizers.Tokenizer.from_file(PATH)
    return lambda text: held.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abé 漢\n\t!'s#0<|endoftext|>\u2028\x1c"), max_size=40))
def test_words_agree_with_whole_texts(text):
    words = packing.tokenizer_for(PATH)
    assert words.encode([text])[0] == words.raw(text)


def test_small_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    words = packing.WordTokenizer(PATH)
    texts = [f"one two three four{i}! five{i}x? ### é{i}" for i in range(20)]
    assert words.encode(texts) == [words.raw(t) for t in texts]


def check(rows, docs, raw):
    ids = {}
    for key, text in docs:
        ids.setdefault(key, []).append([*raw(text or ""), 1])
    by_doc = defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for key, lists in ids.items():
        wanted = Counter()
        for whole in lists:
            for start in range(0, len(whole), packing.CAPACITY):
                piece = whole[start : start + packing.CAPACITY]
                wanted[(start, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(whole))] += 1
        assert wanted == Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[key])
    for held in sequences.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == [sum(x.length for x in held[:i]) for i in range(len(held))]
        assert sum(r.length for r in held) <= packing.CAPACITY


def test_odd_documents(odd, raw):
    check(packing.pack(odd).collect(), ODD, raw)


def test_groups_and_padding(make_docs, raw):
    docs = [(i, f"word{i} and more words in a row, " * (i % 190)) for i in range(400)]
    rows = packing.pack(make_docs(docs), group_size=100).collect()
    check(rows, docs, raw)
    used = len({r.sequence_id for r in rows})
    assert len({r.sequence_id >> 31 for r in rows}) > 1
    assert sum(r.length for r in rows) / (used * packing.CAPACITY) > 0.9


def test_empty(nothing):
    assert packing.pack(nothing).count() == 0


@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit(sizes):
    sizes.sort(reverse=True)
    bins, offsets = [], []
    for n in sizes:
        for i, used in enumerate(bins):
            if used + n <= 50:
                break
        else:
            i = len(bins)
            bins.append(0)
        offsets.append((i, bins[i]))
        bins[i] += n
    assert list(zip(*packing.first_fit(sizes, 50), strict=True)) == offsets
