"""Components against all pairs; forests, trees and kept rows."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from waytrace.llm import simhash as sh


def shingles(text, k=3):
    words = (text or "").encode().lower().split()
    return [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def plain_print(text):
    found = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def brute(docs, radius=3):
    prints = [plain_print(t) for _, t in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for (key, _), x in zip(docs, label, strict=True):
        if key is not None:
            least[x] = min(least.get(x, key), key)
    return sorted(((k, f"{p:016x}", least.get(x)) for (k, _), p, x in zip(docs, prints, label, strict=True)), key=repr)


def got(found):
    rows = found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def near_copies(n, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(words, 150)) for _ in range(n)]
    docs = []
    for i, text in enumerate(base):
        docs.append((10 * i, " ".join(text)))
        for j in range(rng.integers(0, 4)):
            copy = list(text)
            for at in rng.integers(0, 150, rng.integers(0, 2)):
                copy[at] = "changed"
            docs.append((10 * i + 1 + j, " ".join(copy)))
    return docs


def test_spark_agrees_on_the_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_fingerprint():
    for _, text in ODD:
        assert sh.fingerprint(sh.shingle_hashes((text or "").encode(), 3)) == plain_print(text)


def test_odd(odd, nothing):
    assert got(sh.near_duplicates(odd)) == brute(ODD)
    assert sh.near_duplicates(nothing).count() == 0
    assert sh.near_duplicates(nothing, 5, 3, 0.8).count() == 0


def test_near_copies(make_docs, monkeypatch):
    for name, value in (("LEAF", 10), ("BLOCK", 8)):
        monkeypatch.setattr(sh, name, value)
    docs = near_copies(120)
    wanted = brute(docs)
    assert len({c for _, _, c in wanted}) < len(docs)
    assert got(sh.near_duplicates(make_docs(docs))) == wanted


@pytest.mark.parametrize(("radius", "dense"), [(3, False), (3, True), (9, False)])
def test_shards_lose_no_pair(radius, dense):
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 63, 600).astype(np.uint64)
    if dense:
        fps[100:] = fps[0]
        for _ in range(4):
            fps[100:] ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    else:
        fps[300:] = fps[:300]
        for _ in range(radius):
            fps[300:] ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    tree = sh.TopTree(fps[::3], 12)
    met = np.zeros((600, 600), int)
    forest = sh.Forest(600)
    for _, rows, home in tree.deal(fps, radius):
        mine = rows[home]
        met[np.ix_(mine, rows)] += 1
        found = sh.VantageJoin(fps[rows], home, radius).forest.parent
        forest.link(rows, rows[found])
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    assert ((met + met.T)[near] >= 1).all()
    whole = sh.Forest(600)
    whole.link(*np.nonzero(near))
    assert (forest.roots(np.arange(600)) == whole.roots(np.arange(600))).all()


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2)) if a != b] + [(500 + i, 501 + i) for i in range(40)] + [(900, 901 + i) for i in range(50)]
    label = {}
    for a, b in edges:
        x, y = label.get(a, a), label.get(b, b)
        label.setdefault(a, a)
        label.setdefault(b, b)
        low = min(x, y)
        label = {k: low if v in (x, y) else v for k, v in label.items()}
    found = sh.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == label
    assert found.count() == len(label)


def test_keep_one(make_docs):
    docs = near_copies(40, 6)
    odd = [(7000, None), (7001, ""), (7002, "a b"), (7003, "A b"), (7003, "A b"), (None, "a b"), (7004, "other words entirely here")]
    rows = make_docs(docs + odd)
    kept = sh.keep_one(rows, 5, 3, 0.8)
    assert kept.columns == rows.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids))
    assert {10 * i for i in range(40)} <= set(ids)
    assert {i for i in ids if i >= 7000} == {7000, 7002, 7004}
    sets = {k: set(shingles(t, 5)) for k, t in docs}
    for k, _ in docs:
        if k not in ids:
            base = sets[k - k % 10]
            assert max(len(sets[k] & s) / len(sets[k] | s) for j, s in sets.items() if j != k and j // 10 == k // 10) >= 0.8
            assert base


def test_same_id_other_text(make_docs):
    rows = make_docs([(1, "one two three four five six seven"), (1, "entirely other words stand in here now")])
    assert sh.keep_one(rows, 5, 3, 0.8).count() == 2


def apart_copies(n=60, words=120, seed=13):
    """Pairs of texts of random words; the second has a line of the first many times over, or some words replaced."""
    rng = np.random.default_rng(seed)
    docs = []
    for i in range(n):
        text = [f"w{x}" for x in rng.integers(0, 10**6, words)]
        copy = list(text)
        if i % 2:
            copy = copy[:20] + copy[8:20] * 25 + copy[20:]
        else:
            copy[30] = copy[90] = "changed"
        docs += [(10 * i, " ".join(text)), (10 * i + 1, " ".join(copy))]
    return docs


def alike(docs, k=5, similarity=0.8):
    sets = [set(shingles(t, k)) for _, t in docs]
    return {(i, j) for i in range(len(docs)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= round(10 * similarity) * len(sets[i] | sets[j])}


def test_links_beyond_the_radius(make_docs):
    docs = apart_copies()
    pairs = alike(docs)
    assert {(2 * i + 1, 2 * i) for i in range(60)} <= pairs
    prints = [sh.fingerprint(sh.shingle_hashes(t.encode(), 5)) for _, t in docs]
    assert sum((prints[i] ^ prints[j]).bit_count() > 12 for i, j in pairs) > 10
    assert sorted(r.doc_id for r in sh.keep_one(make_docs(docs), 5, 3, 0.8).collect()) == [10 * i for i in range(60)]


def test_bitmaps_rule_out_no_link():
    rng = np.random.default_rng(21)
    sets = []
    for n in (0, 1, 4, 5, 9, 40, 64, 65, 100, 127, 130, 600, 5000):
        whole = rng.integers(0, 1 << 63, n).astype(np.uint64)
        sets += [np.unique(whole[int(n * cut) :]) for cut in (0, 0.1, 0.2, 0.21, 0.5)]
    i, j = np.triu_indices(len(sets), 1)
    sizes, marks = np.array([len(s) for s in sets]), [sh.bitmap(s) for s in sets]
    both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    near = 5 * both >= 4 * (sizes[i] + sizes[j] - both)
    met = sh.may_link(sizes[i], sizes[j], [marks[x] for x in i], [marks[x] for x in j], 0.8)
    assert near.sum() > 30
    assert met[near].all()
    assert not met[(both == 0) & (sizes[i] > 30) & (sizes[i] > 0.8 * sizes[j]) & (sizes[j] > 0.8 * sizes[i])].any()
    # by cells: sorted by size, every pair of two labels once
    for cut in (1, 3):
        slices = np.arange(len(sets)) % cut
        order = np.argsort(sizes, kind="stable")
        found = set()
        for a in range(cut):
            for b in range(a, cut):
                held = order[np.isin(slices[order], (a, b))]
                labels = held % 7
                pairs = sh.cell_pairs(np.zeros(len(held), int), slices[held], np.full(len(held), a != b), sizes[held], labels, [marks[x] for x in held], 0.8)
                for x, y in pairs:
                    found |= {(int(min(p, q)), int(max(p, q))) for p, q in zip(held[x], held[y], strict=True)}
        assert {(int(a), int(b)) for a, b in zip(i[near], j[near], strict=True) if a % 7 != b % 7} <= found


def test_pairs_of_the_similarity_share_a_shard():
    rng = np.random.default_rng(3)
    missed = 0
    for size in (9, 45, 450):
        for _ in range(700):
            both, own = rng.integers(0, 1 << 63, 8 * size // 9, dtype=np.uint64), rng.integers(0, 1 << 63, (2, size // 9), dtype=np.uint64)
            a, b = (sh.band_keys(np.concatenate((both, x))) for x in own)
            assert len(a) == sh.BANDS
            missed += not (a == b).any()
    assert missed == 0
    unrelated = [sh.band_keys(rng.integers(0, 1 << 63, 100, dtype=np.uint64)) for _ in range(200)]
    assert len(np.unique(np.concatenate(unrelated))) == 200 * sh.BANDS


def border_copies(n=40, words=124, seed=17):
    """Groups of texts whose similarities lie about 0.8."""
    rng = np.random.default_rng(seed)
    docs = []
    for i in range(n):
        text = [f"w{x}" for x in rng.integers(0, 10**6, words)]
        docs.append((10 * i, " ".join(text)))
        for j in range(1, 5):
            copy = list(text)
            begin = int(rng.integers(0, 90))
            copy[begin : begin + int(rng.integers(12, 28))] = ["changed"]
            docs.append((10 * i + j, " ".join(copy)))
    return docs


@pytest.mark.parametrize("slice_nodes", [1024, 2])
def test_links_are_pairs_of_the_similarity(make_docs, monkeypatch, slice_nodes):
    monkeypatch.setattr(sh, "SLICE", slice_nodes)
    docs = border_copies()
    pairs = alike(docs)
    forest = sh.Forest(len(docs))
    forest.link(*np.array(sorted(pairs)).T)
    wanted = sorted(docs[i][0] for i in set(forest.parent.tolist()))
    assert 40 < len(wanted) < len(docs)
    assert sorted(r.doc_id for r in sh.keep_one(make_docs(docs), 5, 3, 0.8).collect()) == wanted


def test_a_large_group(make_docs):
    rng = np.random.default_rng(30)
    text = [f"w{x}" for x in rng.integers(0, 10**6, 80)]
    docs = [(i, " ".join([*text[: i % 79], f"own{i}", *text[i % 79 + 1 :]])) for i in range(1500)]
    found = sh.keep_one(make_docs(docs), 5, 3, 0.8).collect()
    assert [r.doc_id for r in found] == [0]
