"""Targets by resharing, exact quotas, permutations and draws."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import ODD
from waytrace.llm import mixing as mx


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))


def brute_targets(sizes):
    """Reshare what is over twice a source's size until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target = {s: 1.5 * sum(sizes.values()) * weight[s] / sum(weight.values()) for s in names}
    full = set()
    while over := [s for s in names if s not in full and target[s] > 2 * sizes[s]]:
        rest = sum(target[s] - 2 * sizes[s] for s in over)
        full |= set(over)
        target.update({s: 2.0 * sizes[s] for s in over})
        free = [s for s in names if s not in full]
        for s in free:
            target[s] += rest * weight[s] / sum(weight[f] for f in free)
    return target


def documents(n=300, seed=2):
    rng = np.random.default_rng(seed)
    names = ["big", "b", "é", "Z", "tiny", None, "", "zero"]
    share = [0.6, 0.1, 0.1, 0.1, 0.01, 0.07, 0.02, 0]
    rows = [(i, "word " * int(rng.integers(1, 120)), names[rng.choice(8, p=share)]) for i in range(n)]
    return [*rows, (n, "", "zero"), (n + 1, None, "zero"), (n + 2, "x " * 9000, "b"), (5, rows[5][1], rows[5][2]), (None, "a b c", None)]


@pytest.fixture(scope="module")
def drawn(make_docs):
    docs = documents()
    return docs, mx.draws(make_docs(docs), block_words=64, shards=16).collect()


def test_targets_and_taken(drawn):
    docs, rows = drawn
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += size(text)
    sizes.update({s: 0 for _, _, s in docs})
    target = brute_targets(sizes)
    by_sid = {r.sid: r for r in rows}
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    taken, own = Counter(), defaultdict(int)
    for r in rows:
        taken[r.sid] += r.words
        own[(r.doc_id, r.order, r.copy, r.sid, r.size)] += r.words
    for sid, s in enumerate(names):
        assert by_sid[sid].source_size == sizes[s]
        assert by_sid[sid].target == pytest.approx(target[s])
        assert abs(taken[sid] - target[s]) <= 0.5
    assert all(0 <= t <= 2 * n for (*_, n), t in own.items())
    assert sorted(n for *_, n in own) == sorted(size(t) for _, t, _ in docs)


def test_blocks_are_disjoint_and_shards_even(drawn):
    _, rows = drawn
    shard = {}
    words = Counter()
    for r in rows:
        if r.words:
            key = (r.sid, getattr(r, "pass"), r.block)
            assert shard.setdefault(key, (r.shard, r.place)) == (r.shard, r.place)
            words[key] += r.words
    assert max(words.values()) <= 64
    counts = Counter(s for s, _ in shard.values())
    assert max(counts.values()) - min(counts.values()) <= 1
    assert len(counts) == 16


def test_runs_agree(make_docs, drawn):
    docs, rows = drawn
    again = mx.draws(make_docs(docs).repartition(3), block_words=64, shards=16)
    drop = lambda r: (r.doc_id, r.size, r.words, r.shard, r.place)
    assert sorted(map(drop, again.collect()), key=repr) == sorted(map(drop, rows), key=repr)


def test_rows(make_docs):
    docs = [(i, t, s) for i, (k, t, s) in enumerate(documents(400, 5)) if k not in (402,)]
    table = make_docs(docs)
    mixed = mx.mix_rows(table)
    assert mixed.columns == table.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) == 2
    sizes, taken = Counter(), Counter()
    for k, t, s in docs:
        sizes[s] += size(t)
        taken[s] += size(t) * copies[k]
    target = brute_targets({**{s: 0 for _, _, s in docs}, **sizes})
    assert abs(taken["big"] - target["big"]) < 0.1 * target["big"]


def test_shards_are_shuffled_partitions(make_docs, tmp_path):
    docs = [(i, "word " * 40, f"s{i % 3}") for i in range(3000)]
    mix = mx.mix_rows(make_docs(docs), shards=5)
    mix.write.parquet(str(tmp_path / "mix"))
    parts = [[r.doc_id for r in rows] for rows in mix.rdd.glom().collect()]
    assert len(parts) == 5
    assert max(map(len, parts)) < 1.5 * min(map(len, parts))
    for ids in parts:
        assert len({i % 3 for i in ids}) == 3
        rises = np.mean(np.diff(ids) > 0)
        assert 0.45 < rises < 0.55


def test_taken_comes_through_the_quotas(make_docs, monkeypatch):
    monkeypatch.setattr(mx, "split_tree", lambda counts, rooms, seed: np.zeros((len(counts), len(rooms)), np.int64))
    assert sum(r.words for r in mx.draws(make_docs(documents()), shards=16).collect()) == 0


def test_alike_rows_share(make_docs):
    table = make_docs([(1, "a b c d", "s")] * 5 + [(2, "e f", "t")])
    assert 5 <= mx.mix_rows(table).where("doc_id = 1").count() <= 10


def test_odd_and_empty(make_docs, odd, nothing):
    rows = mx.draws(odd).collect()
    assert len({(r.doc_id, r.order, r.copy) for r in rows}) == len(ODD)
    assert sum(r.words for r in rows) == round(1.5 * sum(size(t) for _, t in ODD))
    assert mx.draws(nothing).count() == 0
    assert mx.mix_rows(nothing).count() == 0
    assert mx.mix_rows(make_docs([(1, None, "a"), (2, "", None)])).count() == 0


def test_tree_is_exact():
    counts, rooms = np.array([5, 0, 100, 17]), mx.even(122, 7)
    quotas = mx.split_tree(counts, rooms, 3)
    assert (quotas.sum(1) == counts).all()
    assert (quotas.sum(0) == rooms).all()
    mean = np.mean([mx.split_tree(counts, rooms, s) for s in range(300)], axis=0)
    assert np.abs(mean - np.outer(counts, rooms) / 122).max() < 0.8


def test_permutations():
    for n in (1, 2, 3, 7, 64, 65, 1000):
        seen = mx.permuted(np.arange(n), np.full(n, n), np.full(n, 12345, np.uint64))
        assert sorted(seen.tolist()) == list(range(n))
        assert (mx.place_of(seen, np.full(n, n), np.full(n, 12345, np.uint64)) == np.arange(n)).all()


def test_beyond_the_exact_sampler(monkeypatch):
    counts = np.array([3 * 10**9, 5, 10**9, 7 * 10**8])
    quotas = mx.split_tree(counts, mx.even(int(counts.sum()), 6), 3)
    assert (quotas.sum(1) == counts).all()
    assert (quotas >= 0).all()
    assert np.abs(quotas / (counts[:, None] / 6) - 1)[[0, 2, 3]].max() < 1e-3
    monkeypatch.setattr(mx, "EXACT_DRAWS", 50)
    small = np.array([500, 0, 1000, 170])
    found = np.array([mx.split_tree(small, mx.even(1670, 4), s)[0, 0] for s in range(400)])
    assert abs(found.mean() - 125) < 2
    assert 6 < found.std() < 10  # 8.1 by the formula
