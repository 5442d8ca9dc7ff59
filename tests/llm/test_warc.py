"""Files written and read again."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from waytrace.llm import common, warc


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, shard int, first string")


def brute(rows):
    groups = {}
    for key, _, html in rows:
        raw = (html or "").encode()
        groups.setdefault(raw, []).append(key)
    out = []
    for raw, keys in groups.items():
        keys.sort(key=lambda k: (k is None, k))
        for i, key in enumerate(keys):
            later = len(raw) >= 100 and i > 0
            out.append((key, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if later else "response", keys[0] if later else None))
    return sorted(out, key=repr)


ROWS = [(1, "http://a/\r\nX: y", None), (2, None, ""), (3, "http://b", "é" * 60), (4, "http://c", "é" * 60), (4, "http://c2", "é" * 60), (None, "http://n", "é" * 60), (7, "u", "short"), (8, "u", "short"), (9, "u", "\r\n\r\n" + "x" * 200), (10, "u", "y" * 100), (-5, "u", "y" * 100), (11, "u", "y" * 99), (12, "u", "y" * 99)]


def read(spark, folder):
    return sorted((tuple(r) for r in warc.read_warc(spark, str(folder)).collect()), key=repr)


@pytest.mark.parametrize("shard_bytes", [50, 300, 1 << 20])
def test_round_trip(spark, tmp_path, shard_bytes):
    files = warc.write_warc(table(spark, ROWS), str(tmp_path / "w"), shard_bytes)
    assert read(spark, tmp_path / "w") == brute(ROWS)
    assert sum(f["records"] for f in files) == len(ROWS)
    for f in files:
        assert hashlib.sha256((tmp_path / "w" / f["name"]).read_bytes()).hexdigest() == f["sha256"]


def test_deterministic_and_rolled(spark, tmp_path):
    rows = [(i, f"http://h/{i}", hashlib.sha256(str(i).encode()).hexdigest() * 20) for i in range(300)]
    a = warc.write_warc(table(spark, rows), str(tmp_path / "a"), 100_000, 4000)
    b = warc.write_warc(table(spark, rows[::-1]).repartition(7), str(tmp_path / "b"), 100_000, 4000)
    assert a == b
    assert len(a) > 10
    assert max(f["bytes"] for f in a) < 6000
    assert not list((tmp_path / "a").glob("_tmp*"))
    assert read(spark, tmp_path / "a") == brute(rows)


def test_stray_files_are_ignored(spark, tmp_path):
    warc.write_warc(table(spark, ROWS), str(tmp_path / "w"))
    (tmp_path / "w" / "shard-99999-0000.warc.gz").write_bytes(b"left by a lost attempt")
    assert read(spark, tmp_path / "w") == brute(ROWS)


def test_damage(spark, tmp_path):
    (f,) = warc.write_warc(table(spark, ROWS[:3]), str(tmp_path / "w"))
    path = tmp_path / "w" / f["name"]
    whole = zlib.decompress(path.read_bytes(), 31)
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    path.write_bytes(path.read_bytes()[:-20])
    with pytest.raises(Exception, match="ends inside|damaged"):
        read(spark, tmp_path / "w")


def test_empty(spark, tmp_path):
    assert warc.write_warc(table(spark, ROWS).limit(0), str(tmp_path / "w")) == []
    assert read(spark, tmp_path / "w") == []


def test_hot_digest_long_payload_and_null_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(common, "HOT_SHARE", 10)
    rows = [(i, "u", "same payload " * 20) for i in range(400)] + [(400 + i, "u", f"own {i} " * 30) for i in range(60)]
    rows += [(None, "n", f"null id {i} " * 20) for i in range(300)] + [(9000, "l", "long é " * 600_000), (9001, "l", "long é " * 600_000)]
    files = warc.write_warc(table(spark, rows), str(tmp_path / "w"), 400_000)
    assert read(spark, tmp_path / "w") == brute(rows)
    assert sum(f["records"] for f in files) == len(rows)


def test_part_numbers(spark):
    ids = [(int(i), f"t{i}") for i in range(300)] + [(50, f"hot{i}") for i in range(400)] + [(None, f"null{i}") for i in range(500)]
    df = spark.createDataFrame(ids, "id long, text string")
    ranges = common.id_ranges(df, "id", 10, 120)
    rows = common.part_number(df.withColumn("tie", F.xxhash64("text")), "id", ranges, F.col("tie"), "part").collect()
    assert len(rows) == len(ids)
    order = sorted(rows, key=lambda r: (r.id is None, r.id or 0, r.tie))
    assert [r.part for r in order] == sorted(r.part for r in rows)
    assert max(Counter(r.part for r in rows).values()) < 250
    assert max(r.part for r in rows) < ranges[2]
