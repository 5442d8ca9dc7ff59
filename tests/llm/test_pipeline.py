"""The stages on a small corpus, each against a plain computation; and the registry."""

import re
from collections import Counter

import numpy as np

import corpus_pipeline
from tests.llm.test_quality import clean, junk
from waytrace.llm import catalog, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = np.random.default_rng(9)
    rows = [(i, clean(rng, 120), f"s{i % 3}") for i in range(90)]
    rows += [(100 + i, junk(rng, 80, i % 4), "s0") for i in range(24)]
    rows += [(200 + i, rows[i][1], "s1") for i in range(10)]
    near = [rows[20 + i][1].split() for i in range(10)]
    for i, words in enumerate(near):
        words[60] = "changed"
        rows.append((300 + i, " ".join(words), "s2"))
    rows.append((400, clean(rng, 60) + " token = abcdef123456 " + clean(rng, 60), "s0"))
    return [(k, t, "en", s, len(t)) for k, t, s in rows]


def test_stages(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        kept.append(docs.collect())
    good, single, masked, mixed, packed = kept
    ids = {r.doc_id for r in good}
    assert {k for k, *_ in rows if k < 100 or k >= 200} <= ids
    assert not ids & set(range(100, 124))
    assert {r.doc_id for r in single} == set(range(90)) | {400}
    texts = {r.doc_id: r.text for r in masked}
    assert "token" not in texts[400]
    assert "[SECRET]" in texts[400]
    assert all(texts[k] == t for k, t, *_ in rows if k < 90)
    assert all(r.n_chars == len(r.text) for r in masked)
    copies = Counter(r.doc_id for r in mixed)
    assert max(copies.values()) <= 2
    assert set(copies) <= set(texts)
    assert {r.text for r in mixed} <= set(texts.values())
    sizes = {k: len(re.findall(r"\S+", t)) for k, t in texts.items()}
    assert abs(sum(sizes[k] * n for k, n in copies.items()) / sum(sizes.values()) - 1.5) < 0.2
    whole = Counter()
    for r in packed:
        whole[r.doc_id] += r.length
    tokens = {r.doc_id: r.doc_tokens for r in packed}
    assert whole == Counter({k: tokens[k] * copies[k] for k in tokens})


def test_run(spark, tmp_path):
    rows = corpus()[:40]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert quality.THRESHOLD == 0.5
