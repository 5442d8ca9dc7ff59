"""Trees, likeness, and neighbours against a sorted list."""

import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from waytrace.llm import merkle


def words(n, seed):
    x, out = seed, []
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append("abcdefghij"[x >> 8 & 7] * (1 + (x >> 16) % 6) + str(x % 97) + ("\n" if i % 23 == 22 else ""))
    return " ".join(out)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\té", max_size=300))
def test_leaves_cover_the_text(text):
    raw = text.encode()
    ends = merkle.cuts(raw).tolist()
    assert ends == sorted(set(ends))
    assert (ends[-1] if ends else 0) == len(raw)
    assert all(i + 1 in ends for i, b in enumerate(raw) if b == 10)
    tree, marks = merkle.fingerprint(raw)
    assert len(marks) == len(ends)
    assert merkle.likeness(tree, tree) == 1.0
    assert merkle.changed(tree, tree) == []


def test_long_runs_are_cut():
    assert max(b - a for a, b in zip([0, *merkle.cuts(b"x" * 50_000)], merkle.cuts(b"x" * 50_000), strict=False)) <= merkle.LONGEST


def test_local_edit():
    text = words(4000, 1)
    other = text[:9000] + "EDIT" + text[9000:]
    a, b = (merkle.fingerprint(t.encode())[0] for t in (text, other))
    assert a != b
    assert 0.99 < merkle.likeness(a, b) < 1
    assert [x[0] for x in merkle.changed(a, b)] == ["-", "+"]
    assert merkle.likeness(a, merkle.fingerprint(words(4000, 99).encode())[0]) < 0.05


def test_edits_are_located():
    lines = [words(22, i).replace("\n", " ") + "\n" for i in range(300)]
    tree = lambda rows: merkle.fingerprint("".join(rows).encode())[0]
    a = tree(lines)
    spots = {}
    for i, (_, paragraphs) in enumerate(merkle.tree_of(a)[1]):
        for j in range(len(paragraphs)):
            spots[len(spots)] = (i, j)
    assert len(spots) == 300
    for at in (0, 1, 150, 298, 299):
        assert merkle.changed(a, tree(lines[:at] + lines[at + 1 :])) == [("-", *spots[at])]
        came = merkle.changed(a, tree([*lines[:at], "quite new\n", *lines[at:]]))
        assert [x[0] for x in came] == ["+"]
        other = merkle.changed(a, tree([*lines[:at], lines[at].upper(), *lines[at + 1 :]]))
        assert other[0] == ("-", *spots[at])
        assert [x[0] for x in other] == ["-", "+"]
    swapped = merkle.changed(a, tree([*lines[:7], lines[8], lines[7], *lines[9:]]))
    assert swapped
    assert {x[0] for x in swapped} == {"~"}
    twice = merkle.changed(a, tree([*lines[:9], lines[8], *lines[9:]]))
    assert [x[0] for x in twice] == ["+"]


def test_fingerprints_are_compact():
    text = words(120_000, 5).encode()
    assert len(merkle.fingerprint(text)[0]) < len(text) / 7


def test_empty_texts():
    empty, other = merkle.fingerprint(b"")[0], merkle.fingerprint(b"a")[0]
    assert merkle.likeness(empty, empty) == 1.0
    assert merkle.likeness(empty, other) == 0.0
    assert empty != other


def check(rows, docs):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0), reverse=True)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(docs)
    for i, (key, text) in enumerate(docs):
        if sum(k == key for k, _ in docs) > 1:
            continue
        text, after = text or "", docs[(i + 1) % len(docs)]
        if sum(k == after[0] for k, _ in docs) > 1 and len({t for k, t in docs if k == after[0]}) > 1:
            continue
        after = after[1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        (r,) = got[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        a, b, c = (merkle.fingerprint(t.encode())[0] for t in (text, new, after))
        assert (r.fingerprint, r.edited_fingerprint) == (a, b)
        assert r.edits == len(merkle.changed(a, b))
        assert (r.near_edited, r.near_next) == pytest.approx((merkle.likeness(a, b), merkle.likeness(a, c)))


@pytest.mark.parametrize("range_bytes", [1, 20_000, 1 << 25])
def test_odd(odd, range_bytes):
    check(merkle.edited_fingerprints(odd, range_bytes).collect(), ODD)


def test_many_ranges(make_docs):
    docs = [(i * 7 % 1009, words(20 + i % 60, i)) for i in range(1, 300)] + [(None, "no id here")]
    check(merkle.edited_fingerprints(make_docs(docs), 2000).collect(), docs)


def test_one_and_none(make_docs, nothing):
    check(merkle.edited_fingerprints(make_docs([(3, "one two three")])).collect(), [(3, "one two three")])
    assert merkle.edited_fingerprints(nothing).count() == 0


def test_hot_ids_are_cut(spark, make_docs):
    """Null and one id hold most rows: each row still has its successor in the whole order."""
    docs = [(None, words(8, i)) for i in range(120)] + [(7, words(9, 500 + i)) for i in range(90)] + [(i, words(10, 900 + i)) for i in range(40) if i != 7]
    table = make_docs(docs)
    tie = {r.text: r.t for r in table.select("text", F.xxhash64("text").alias("t")).collect()}
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, tie[d[1]]), reverse=True)
    wanted = sorted(hashlib.sha256(merkle.edited(t, order[(i + 1) % len(order)][1]).encode()).hexdigest() for i, (_, t) in enumerate(order))
    found = merkle.edited_fingerprints(table, 1500)
    assert sorted(r.edited_sha256 for r in found.collect()) == wanted
    assert max(len(rows) for rows in found.rdd.glom().collect()) < 60
