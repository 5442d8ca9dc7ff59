"""Votes, estimates, and held-out accuracy on made-up texts."""

import math

import numpy as np
import pytest

from tests.llm.conftest import ODD
from waytrace.llm import quality as q


def clean(rng, n):
    stock = "the of and to in is that it was for on are with as river house letter morning garden table winter number story window people water".split()
    return " ".join(str(w) + ("." if rng.random() < 0.1 else "") for w in rng.choice(stock, n)).capitalize()


def junk(rng, n, kind):
    words = clean(rng, n).split()
    if kind == 0:
        return " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 2:
        return " ".join(w for w in words[: n // 10 + 1] for _ in range(10))
    return " | ".join(words)


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.2
        size = int(rng.integers(30, 200))
        rows.append((i, junk(rng, size, i % 4) if bad else clean(rng, size), not bad))
    return rows


def test_held_out_accuracy(make_docs):
    train, test = corpus(400, 1), corpus(200, 2)
    model = q.fit(make_docs([r[:2] for r in train]))
    got = {r.doc_id: r for r in q.classify(make_docs([r[:2] for r in test]), model).collect()}
    assert np.mean([got[i].keep == good for i, _, good in test]) > 0.98
    assert all(got[i].keep for i, _, good in test if good)
    assert model.accuracies()["stutter"] > 0.95
    kept = q.keep_good(make_docs([r[:2] for r in test]), model)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.keep}


def test_all_clean(make_docs):
    rng = np.random.default_rng(3)
    docs = make_docs([(i, clean(rng, 80)) for i in range(60)])
    assert q.keep_good(docs).count() == 60
    assert q.keep_good(docs).columns == docs.columns


def test_odd_and_empty(odd, nothing):
    rows = q.classify(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.doc_id for r in rows if r.score == 0.0} == {1, 2, 3}
    assert not any(r.keep for r in rows if r.doc_id in (1, 2, 3))
    assert q.classify(nothing).count() == 0
    assert q.keep_good(nothing).count() == 0


def test_reruns_agree(make_docs):
    docs = [r[:2] for r in corpus(120, 5)]
    a, b = (q.classify(make_docs(docs).repartition(n)).orderBy("doc_id").collect() for n in (1, 5))
    assert a == b


def test_counts_of_a_text():
    counts, features = q.read_text("The THE cat!! | a### b b".encode())
    assert counts[q.WORDS] == 7
    assert len(features) == 21
    assert counts[[q.NOISY, q.BANGED, q.PIPED, q.AGAIN]].tolist() == [1, 1, 1, 2]
    assert counts[q.FUNCTION] == 2


def test_segments_add_up(monkeypatch):
    text = ("many words stand here and there. " * 300).encode()
    whole = q.read_text(text)
    monkeypatch.setattr(q, "SEGMENT_BYTES", 100)
    parts = q.read_text(text)
    for k in (q.WORDS, q.CAPITALS, q.SMALL, q.FUNCTION, q.STOPPED):
        assert whole[0][k] == parts[0][k]
    assert len(whole[1]) == len(parts[1])


def test_estimates_find_kinds_of_bad():
    names = list(q.LABELLERS)

    def code(**votes):
        out = 0
        for name in names:
            out = 3 * out + votes.get(name, q.GOOD)
        return out

    model = q.expectation_maximisation([code(), code(noise=q.BAD), code(stutter=q.BAD), code(functions=q.NOTHING)], [9000, 300, 300, 500])
    got = list(model.posterior.values())
    assert got[0] > 0.9
    assert got[3] > 0.9
    assert got[1] < 0.05
    assert got[2] < 0.05
    assert model.shares.sum() == pytest.approx(1)


def test_codes():
    for code in (0, 1, 5, 3 ** len(q.LABELLERS) - 1):
        back = 0
        for v in q.votes_of(code):
            back = 3 * back + v
        assert back == code


def plain_estimates(votes, times):
    """Expectation-maximisation in loops over patterns, classes and labellers."""
    kinds, labellers, n = 1 + len(q.LABELLERS), len(q.LABELLERS), sum(times)
    part = []
    for v in votes:
        first = next((1 + j for j, x in enumerate(v) if x == q.BAD), 0)
        row = [1.0 if k == first else 0.01 for k in range(kinds)]
        part.append([x / sum(row) for x in row])
    for _ in range(q.ROUNDS):
        mass = [[p * t for p in row] for row, t in zip(part, times, strict=True)]
        share = [(sum(m[k] for m in mass) + 0.1) / (n + 0.1 * kinds) for k in range(kinds)]
        right = {}
        for j in range(labellers):
            for k in range(kinds):
                seen = {x: sum(m[k] for m, v in zip(mass, votes, strict=True) if v[j] == x) + 0.1 for x in (q.BAD, q.GOOD)}
                seen[q.GOOD] += n if k == 0 else 0
                right[j, k] = {x: seen[x] / sum(seen.values()) for x in seen} | {q.NOTHING: 1.0}
        part = []
        for v in votes:
            row = [math.prod([share[k], *(right[j, k][v[j]] for j in range(labellers))]) for k in range(kinds)]
            part.append([x / sum(row) for x in row])
    return [row[0] for row in part]


def plain_scorer(rows, wanted):
    """The same steps of Adam on dense rows."""
    x = np.zeros((len(rows), q.BUCKETS + 1))
    for i, shares in enumerate(rows):
        for f, v in shares.items():
            x[i, f] += v * (q.WORD_WEIGHT if f < q.BUCKETS // 2 else 1.0)
    x[:, -1] = 1
    used = np.append(np.flatnonzero(np.abs(x[:, :-1]).sum(0)), q.BUCKETS)
    x = x[:, used]
    w, m, v = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used))
    decay = np.append(np.full(len(used) - 1, 1e-5), 0)
    for step in range(1, q.STEPS + 1):
        slope = x.T @ ((1 / (1 + np.exp(-x @ w)) - wanted) / len(rows)) + decay * w
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w = w - 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    out = np.zeros(q.BUCKETS + 1)
    out[used] = w
    out[: q.BUCKETS // 2] *= q.WORD_WEIGHT
    return out


def test_query_by_brute_force(spark, make_docs, tmp_path):
    docs = [*(r[:2] for r in corpus(150, 8)), *((1000 + i, t[:400] if t else t) for i, (_, t) in enumerate(ODD))]
    make_docs(docs).write.parquet(str(tmp_path / "documents.parquet"))
    read = [q.read_text((t or "").encode()) for _, t in docs]
    codes = [q.vote(c) for c, _ in read]
    patterns = sorted(set(codes))
    good = dict(zip(patterns, plain_estimates([q.votes_of(c) for c in patterns], [codes.count(c) for c in patterns]), strict=True))
    told = [i for i, (c, _) in enumerate(read) if c[q.WORDS]]  # fewer texts than the sample holds
    shares = [{int(f): n / read[i][0][q.WORDS] for f, n in zip(*np.unique(read[i][1], return_counts=True), strict=True)} for i in told]
    weights = plain_scorer(shares, np.array([good[codes[i]] for i in told]))
    got = {r.doc_id: r for r in q.op10_quality(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    for i, (key, _) in enumerate(docs):
        counts, features = read[i]
        words = counts[q.WORDS]
        score = 1 / (1 + math.exp(-(weights[-1] + weights[features].sum() / words))) if words else 0.0
        assert got[key].votes == "".join("-bg"[v] for v in q.votes_of(codes[i]))
        assert got[key].posterior == pytest.approx(good[codes[i]], abs=1e-6)
        assert got[key].score == pytest.approx(score, abs=1e-4)
        if abs(score - q.THRESHOLD) > 1e-3:
            assert got[key].keep == (score >= q.THRESHOLD)


def test_ties_at_the_threshold(make_docs):
    model = q.fit(make_docs([r[:2] for r in corpus(100, 4)]))
    docs = make_docs([(1, "some words stand here"), (2, "some words stand here")])
    (score,) = {r.score for r in q.classify(docs, model).collect()}
    assert [r.keep for r in q.classify(docs, model, score).collect()] == [True, True]
    assert q.keep_good(docs, model, score).count() == 2
    assert q.keep_good(docs, model, np.nextafter(score, 1)).count() == 0
