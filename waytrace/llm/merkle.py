"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases.

A text is cut into leaves without a gap: after each line feed, and after the first white space behind a
place whose eight last bytes in the paragraph hash to a multiple of ``PHRASE`` (so cuts move with the content, not
with the position, and don't see the paragraph before); a run of more than ``LONGEST`` bytes is cut there. Leaves up to
a line feed are a paragraph; a paragraph whose digest is a multiple of ``SECTION`` ends a
section. A node's digest is that of its children's digests.

The fingerprint is the tree as text: root ``:`` sections joined by ``/``; a section is its digest ``=`` its paragraphs joined by
``.``; a paragraph is its digest and its leaves, or its leaf alone if it has one, four characters each (24 bits). Equal texts have equal
fingerprints; roots test equality; where roots differ ``changed`` goes down the differing branches and names the paragraphs
that went, came or moved;
``likeness`` is the share of leaves that two trees have in common (of both: 2 |A and B| / (|A| + |B|),
repeats counted; 1 for two empty texts).

``edited_fingerprints`` needs each document's successor in falling order of doc_id (null last, equal
ids by falling text hash). Documents are cut into ranges of doc_id by bounds from a bounded sample
of ids, as many as the bytes need, a task each; an id that holds more rows than a range is cut by the text hash. The first row of every range (one per range) is also sent to the range before it.
Texts go through one shuffle, sorted, and are read as a stream: only two neighbours are held.

Null text counts as empty. Repeated rows succeed each other and lie in one range. Very long texts are read whole, their fingerprints
are as long as they have leaves (about a twelfth of the text). The successor of the last row is the
first, so of a single row itself. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waytrace.llm.common import id_ranges, part_number, table

PHRASE = 8
SECTION = 4
LONGEST = 4096
RANGE_BYTES = 32 << 20
_ODD = [np.uint32(2 * x + 1) for x in (1013904223, 747796405, 1442695041, 374761393, 668265263, 951274213, 1274126177, 202117161)]


def cuts(text: bytes) -> np.ndarray:
    """The ends of the leaves of ``text``; the last is its length."""
    raw = np.frombuffer(text, np.uint8)
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    gap = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    feeds = np.flatnonzero(raw == 10) + 1
    begin = np.concatenate(([0], feeds))[np.searchsorted(feeds, gap, side="right")]
    window = np.zeros(len(gap), np.uint32)
    for back, odd in enumerate(_ODD, 1):
        window += np.where(gap - back >= begin, raw[np.maximum(gap - back, 0)] * odd, np.uint32(0))
    chosen = gap[((window * np.uint32(2654435761)) >> np.uint32(24)) % PHRASE == 0] + 1
    ends = np.union1d(chosen, feeds)
    ends = ends if len(ends) and ends[-1] == n else np.append(ends, n)
    long = np.diff(ends, prepend=0) > LONGEST
    if long.any():
        begins = np.concatenate(([0], ends[:-1]))
        ends = np.union1d(ends, np.concatenate([np.arange(a + LONGEST, b, LONGEST) for a, b in zip(begins[long], ends[long], strict=True)]))
    return ends


def _digest(children: list[bytes]) -> bytes:
    return hashlib.blake2b(b"".join(children), digest_size=16).digest()


def _told(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).decode()


def fingerprint(text: bytes) -> tuple[str, list[bytes]]:
    """The tree of a text, and the 24-bit leaves in it."""
    ends = cuts(text).tolist()
    begin, sections, paragraphs, leaves, marks = 0, [], [], [], []
    told: list[str] = []
    own: list[str] = []
    digest = xxhash.xxh3_128_digest
    last = len(ends) - 1
    for i, end in enumerate(ends):
        leaf = digest(text[begin:end])
        leaves.append(leaf)
        marks.append(leaf[:3])
        begin = end
        if i == last or text[end - 1] == 10:
            whole = _digest(leaves)
            paragraphs.append(whole)
            own.append(_told((whole[:3] if len(leaves) > 1 else b"") + b"".join(x[:3] for x in leaves)))
            leaves = []
            if i == last or whole[0] % SECTION == 0:
                sections.append(_digest(paragraphs))
                told.append(f"{_told(sections[-1][:3])}={'.'.join(own)}")
                paragraphs, own = [], []
    return _digest(sections).hex() + ":" + "/".join(told), marks


def tree_of(print_: str) -> tuple[str, list[tuple[str, list[str]]]]:
    """The root and the sections (digest, paragraphs) of a fingerprint."""
    root, _, body = print_.partition(":")
    sections = [s.partition("=") for s in body.split("/")] if body else []
    return root, [(digest, paragraphs.split(".")) for digest, _, paragraphs in sections]


def _leaves(paragraph: str) -> list[str]:
    return [paragraph[i : i + 4] for i in range(4 if len(paragraph) > 4 else 0, len(paragraph), 4)]


def _alike(a: list, b: list) -> float:
    if not a and not b:
        return 1.0
    return 2 * (Counter(a) & Counter(b)).total() / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """From 0 to 1, of two fingerprints."""
    flat = lambda f: [x for _, paragraphs in tree_of(f)[1] for p in paragraphs for x in _leaves(p)]
    return _alike(flat(a), flat(b))


def _without(rows: list, known: Counter, key) -> list:
    """The rows whose key isn't one of ``known``, each of which stands for one row."""
    left, out = known.copy(), []
    for row in rows:
        k = key(row)
        if left[k] > 0:
            left[k] -= 1
        else:
            out.append(row)
    return out


def changed(a: str, b: str) -> list[tuple[str, int, int]]:
    """The paragraphs that tell two fingerprints apart: ("-", section, paragraph) of ``a`` that ``b`` hasn't, ("+", ...) of
    ``b`` that ``a`` hasn't, and ("~", ...) of ``b`` where paragraphs of both stand in another order. Nothing below equal roots or
    sections is looked at."""
    (root_a, tree_a), (root_b, tree_b) = tree_of(a), tree_of(b)
    if root_a == root_b:
        return []
    same = Counter(d for d, _ in tree_a) & Counter(d for d, _ in tree_b)
    rows = []
    for tree in (tree_a, tree_b):
        differing = _without(list(enumerate(tree)), same, lambda s: s[1][0])
        rows.append([(p, i, j) for i, (_, paragraphs) in differing for j, p in enumerate(paragraphs)])
    both = Counter(p for p, *_ in rows[0]) & Counter(p for p, *_ in rows[1])
    gone, come = (_without(r, both, lambda p: p[0]) for r in rows)
    found = [("-", i, j) for _, i, j in gone] + [("+", i, j) for _, i, j in come]
    kept = [[x for x in r if x not in set(out)] for r, out in zip(rows, (gone, come), strict=True)]
    found += [("~", y[1], y[2]) for x, y in zip(*kept, strict=True) if x[0] != y[0]]
    if not found and [d for d, _ in tree_a] != [d for d, _ in tree_b]:  # whole sections have moved
        found = [("~", i, 0) for i, (x, y) in enumerate(zip(tree_a, tree_b, strict=True)) if x[0] != y[0]]
    return found


def edited(text: str, successor: str) -> str:
    """The last half of ``text`` replaced by as many code points from the start of its successor."""
    half = len(text) // 2
    return text[: len(text) - half] + successor[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits long, first_edit string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edits", pa.int64()), ("first_edit", pa.string())])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, role, doc_id, text) in order; a row and the one behind it in its range give a result. Role 1: only a successor."""
    held, out = None, []
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            for part, role, doc_id, text in zip(*[c.to_pylist() for c in batch.slice(lo, 512).columns], strict=True):
                text = text or ""
                mine, leaves = fingerprint(text.encode())
                if held is not None and held[0] == part:
                    _, key, before, print_, marks = held
                    new = edited(before, text).encode()
                    other, other_marks = fingerprint(new)
                    where = changed(print_, other)
                    spot = "{}{}.{}".format(*min(where, key=lambda e: (e[1], e[2], e[0]))) if where else None
                    out.append((key, len(before), hashlib.sha256(new).hexdigest(), print_, other, _alike(marks, other_marks), _alike(marks, leaves), len(where), spot))
                held = None if role else (part, doc_id, text, mine, leaves)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)
                out = []


def edited_fingerprints(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The fingerprints of each text and of its edit with the next text, their likeness, how many paragraphs the edit changes, and the
    first of these (sign, section, paragraph)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    parts = max(1, min(n, -(-total // range_bytes)))
    ranges = id_ranges(rows, "doc_id", parts, max(1, -(-n // parts)))
    # parts rise with (doc_id, tie), null last; here the greatest come first, and null after them
    ranged = part_number(rows.withColumn("tie", F.xxhash64("text")), "doc_id", ranges, F.col("tie"), "part")
    # one row per part comes to the driver
    heads = [tuple(r) for r in ranged.groupBy("part").agg(F.max(F.struct("doc_id", "tie")).alias("h")).select("part", "h.doc_id", "h.tie").collect()]
    heads.sort(key=lambda h: (h[1] is not None, h[0]), reverse=True)
    ends = [(part, *heads[(i + 1) % len(heads)]) for i, (part, _, _) in enumerate(heads)]
    small = spark.createDataFrame(ends, "to int, from int, head long, mark long")
    extra = ranged.join(F.broadcast(small), (ranged["part"] == small["from"]) & ranged["doc_id"].eqNullSafe(small["head"]) & (ranged["tie"] == small["mark"]))
    extra = extra.select(F.col("to").alias("part"), F.lit(1).alias("role"), "doc_id", "tie", "text").dropDuplicates(["part"])
    both = ranged.select("part", F.lit(0).alias("role"), "doc_id", "tie", "text").unionByName(extra)
    ordered = both.repartitionById(ranges[2], F.col("part")).sortWithinPartitions("part", "role", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    return ordered.select("part", "role", "doc_id", "text").mapInArrow(_pairs, RESULT)


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and their edits."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
