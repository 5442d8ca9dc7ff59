"""SimHash near-duplicates by vantage-point trees.

1. One pass gives each text a 64-bit fingerprint: words are runs without ASCII white
   space of the text with A-Z lower-cased, shingles are ``k`` neighbouring words joined by a
   space (fewer words: all of them), repeats count, a bit is set if it is set in
   over half of the shingles' XXH64 (seed 42). No words: zero.
2. Equal fingerprints become one node with its smallest doc_id (summed before
   the shuffle), so copies cost nothing later.
3. A top vantage-point tree cuts the nodes into shards: a split has a vantage point v and
   a radius mu; d(x, v) <= mu goes inside. The tree comes from a bounded sample of
   nodes; every node is then sent to its own leaf, and as a visitor to each leaf with a lower
   number that its ball of ``radius`` bits reaches (d - mu <= radius, mu - d < radius), for by the
   triangle inequality no node within the radius lies elsewhere. So each
   pair meets in exactly one shard.
4. In a shard a batched vantage-point join goes on splitting: the points of a half
   meet each other, and across the border only those |d(p, v) - d(q, v)| <= radius
   apart. Small blocks are compared exactly. What comes out is a forest
   of the links, never the pairs.
5. Connected components of the forests by alternating minimum steps over DataFrames.

The leaves' number grows as the square root of the nodes' (above a floor), which keeps both
a leaf and the number of copies sent low. With 64-bit fingerprints and three bits
a split prunes little, the work of a join grows as n to the power of about 1.7.

With ``min_jaccard`` links are pairs of that similarity of the sets of word shingles, however far
their fingerprints are apart. Nodes then are distinct sets. The trees find the pairs within ``radius`` bits; a similarity of
0.8 is about ten bits, at which triangle bounds of 64-bit fingerprints prune nothing, so further shards
hold what the radius misses: a node lies in ``BANDS`` shards, each named by ``ROWS`` minimum hashes of its set. A pair of
similarity s meets in none of them with probability (1 - s ** ROWS) ** BANDS: 3e-6 at 0.8, less above.

- Each node of a shard is paired with the shard's smallest node, and pairs that may be alike are verified by
  the sets themselves. Linked nodes get one label.
- In shards that hold several labels all pairs of two labels are compared, large shards by cells of two slices. A bitmap
  has the parity of the number of shingles at each bit; two bitmaps differ in no more bits than the
  sets differ in shingles, so the pairs it rules out are never links. The others are verified, too.

So no verified link is lost between nodes that share a shard, and only verified pairs link.

Null text counts as empty; texts without words are linked like any other. Null
doc_ids never name a component unless all in it are null. Repeated rows come out once
each. An empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waytrace.llm.common import free_prefix, lean, skew_join, staged, table, texts

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Nodes the top tree is built from, at most about; nodes in a leaf, at least about.
SAMPLE = 20_000
LEAF = 2048
BLOCK = 512
#: Minimum hashes that name a shard, and shards of a node.
ROWS, BANDS = 4, 24
#: Bits from which on a pair of a shard's smallest node isn't looked at in the first step (the second has no such bound).
FAR = 22
#: Nodes in a slice of a shard.
SLICE = 1024
#: Nodes of verified pairs that are broadcast to find their texts, at most; more are joined by a shuffle.
BROADCAST_NODES = 1 << 20
SALTS = 16
NODE = "node"
_DRAWN = np.random.default_rng(2024)
_FLIPS = _DRAWN.integers(0, 1 << 64, (ROWS * BANDS, 1), np.uint64)
_FACTORS = _DRAWN.integers(0, 1 << 64, (ROWS * BANDS, 1), np.uint64) | np.uint64(1)


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(line[a:b], SEED) for a, b in zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64, len(words) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority bits of 64-bit hashes."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for lo in range(0, len(octets), 1 << 16):
        total += np.unpackbits(octets[lo : lo + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The shards of a set of hashes."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 2048):
        np.minimum(least, ((hashes[None, lo : lo + 2048] ^ _FLIPS) * _FACTORS).min(1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def bitmap(hashes: np.ndarray) -> bytes:
    """The parity of the distinct ``hashes`` at each bit; four bits to a hash or more, a power of two, 64 at least.
    Halves laid over each other by exclusive or are the bitmap of half the bits."""
    bits = max(64, 4 << max(0, len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, k: int = SHINGLE, with_sets: bool = False, row: str = "CAST(0 AS BIGINT)") -> DataFrame:
    """(doc_id, row, fp long[, size, bitmap, bands, node, key]) of each row; key is a hash of the text."""
    names = ["doc_id", "row", "fp", *(["size", "bitmap", "bands", NODE, "key"] if with_sets else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                fps, sizes, marks, bands, nodes = [], [], [], [], []
                for text in texts(batch.column(2)):
                    hashes = shingle_hashes(text, k)
                    if with_sets:
                        hashes = np.unique(hashes)
                        sizes.append(len(hashes))
                        marks.append(bitmap(hashes))
                        bands.append(band_keys(hashes))
                        nodes.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                    fps.append(fingerprint(hashes))
                columns = [batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))]
                if with_sets:
                    columns += [pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(np.array(nodes, np.uint64).view(np.int64)), batch.column(3)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, row long, fp long" + (", size long, bitmap binary, bands array<long>, node long, key long" if with_sets else "")
    text = F.col("text").cast("string")
    key = [F.xxhash64(text).alias("key")] if with_sets else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(row).alias("row"), text.alias("text"), *key).mapInArrow(lean(run, "simhash"), schema)


def distances(fps: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ vantage).astype(np.int16)


class TopTree:
    """Splits as rows (vantage, mu, inside, outside); a child below zero is leaf -child - 1."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7) -> None:
        self.rows: list[list] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self.root = self._grow(np.unique(sample), max(2, -(-len(sample) // max(1, leaves))), rng)

    def _grow(self, points: np.ndarray, most: int, rng: np.random.Generator) -> int:
        if len(points) > most:
            for _ in range(8):
                vantage = points[rng.integers(len(points))]
                d = distances(points, vantage)
                mu = int(np.median(d))
                mu -= mu == int(d.max())
                inside = d <= mu
                if inside.any() and not inside.all():
                    row, here = [vantage, mu, 0, 0], len(self.rows)
                    self.rows.append(row)
                    row[2] = self._grow(points[inside], most, rng)
                    row[3] = self._grow(points[~inside], most, rng)
                    return here
        self.leaves += 1
        return -self.leaves

    def deal(self, fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, rows that live or visit there, whether each lives there). Rows visit leaves with lower numbers than their own."""
        home = np.full(len(fps), self.leaves, np.int64)
        stack = [(self.root, np.arange(len(fps)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                home[rows] = -node - 1
            elif len(rows):
                vantage, mu, inner, outer = self.rows[node]
                inside = distances(fps[rows], vantage) <= mu
                stack += [(inner, rows[inside]), (outer, rows[~inside])]
        stack = [(self.root, np.arange(len(fps)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                rows = rows[home[rows] >= -node - 1]
                if len(rows):
                    yield -node - 1, rows, home[rows] == -node - 1
            elif len(rows):
                vantage, mu, inner, outer = self.rows[node]
                d = distances(fps[rows], vantage)
                stack += [(inner, rows[d <= mu + radius]), (outer, rows[d > mu - radius])]


class Forest:
    """Union-find over positions; ``link`` takes arrays."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        up = self.parent[x]
        while True:
            higher = self.parent[up]
            if np.array_equal(higher, up):
                return up
            up = higher

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))
        self.parent = self.roots(self.parent)


class VantageJoin:
    """Links all pairs of ``fps`` within ``radius``, of which one at least is at home."""

    def __init__(self, fps: np.ndarray, home: np.ndarray, radius: int) -> None:
        self.fps, self.radius = fps, radius
        self.forest, self.rng = Forest(len(fps)), np.random.default_rng(11)
        mine, visitors = np.flatnonzero(home), np.flatnonzero(~home)
        self._within(mine)
        self._across(mine, visitors)

    def _compare(self, a: np.ndarray, b: np.ndarray) -> None:
        for lo in range(0, len(a), BLOCK):
            part = a[lo : lo + BLOCK]
            for to in range(0, len(b), 4 * BLOCK):
                other = b[to : to + 4 * BLOCK]
                i, j = np.nonzero(np.bitwise_count(self.fps[part][:, None] ^ self.fps[other][None, :]) <= self.radius)
                self._link(part[i], other[j])

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = (a != b) & (self.forest.roots(a) != self.forest.roots(b))
        self.forest.link(a[apart], b[apart])

    def _split(self, points: np.ndarray) -> tuple[np.ndarray, int, np.uint64] | None:
        vantage = self.fps[points[self.rng.integers(len(points))]]
        d = distances(self.fps[points], vantage)
        mu = int(np.median(d))
        mu -= mu == int(d.max())
        inside = d <= mu
        return None if not inside.any() or inside.all() else (d, mu, vantage)

    def _within(self, points: np.ndarray) -> None:
        stack = [points]
        while stack:
            points = stack.pop()
            cut = self._split(points) if len(points) > BLOCK else None
            if cut is None:
                self._compare(points, points)
                continue
            d, mu, _ = cut
            stack += [points[d <= mu], points[d > mu]]
            self._across(points[(d <= mu) & (d > mu - self.radius)], points[(d > mu) & (d <= mu + self.radius)])

    def _across(self, a: np.ndarray, b: np.ndarray) -> None:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if not len(a) or not len(b):
                continue
            if len(a) > len(b):
                a, b = b, a
            cut = self._split(b) if len(a) > BLOCK else None
            if cut is None:
                self._compare(a, b)
                continue
            db, mu, vantage = cut
            da, r = distances(self.fps[a], vantage), self.radius
            stack += [
                (a[da <= mu], b[db <= mu]),
                (a[da > mu], b[db > mu]),
                (a[(da <= mu) & (da > mu - r)], b[(db > mu) & (db <= mu + r)]),
                (a[(da > mu) & (da <= mu + r)], b[(db <= mu) & (db > mu - r)]),
            ]


def unlike(a: np.ndarray, b: np.ndarray, min_jaccard: float) -> np.ndarray:
    """How many shingles sets of ``a`` and ``b`` shingles may differ in and still have the similarity."""
    return np.floor((1 - min_jaccard) / (1 + min_jaccard) * (a + b) + 1e-6).astype(np.int64)


def may_link(sizes_a: np.ndarray, sizes_b: np.ndarray, marks_a: list[bytes], marks_b: list[bytes], min_jaccard: float) -> np.ndarray:
    """Which pairs of sets the bitmaps don't rule out."""
    most = unlike(sizes_a.astype(np.int64), sizes_b.astype(np.int64), min_jaccard)
    wide = np.array([(len(a), len(b)) for a, b in zip(marks_a, marks_b, strict=True)], np.int64).reshape(-1, 2)
    found = np.zeros(len(wide), bool)
    for pair in np.unique(wide, axis=0):
        here, width = np.flatnonzero((wide == pair).all(1)), int(pair.min()) // 8
        for lo in range(0, len(here), 8192):
            some = here[lo : lo + 8192]
            x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join([marks[i] for i in some.tolist()]), np.uint64).reshape(len(some), -1, width), axis=1) for marks in (marks_a, marks_b))
            found[some] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= most[some]
    return found


def top_tree(nodes: DataFrame) -> TopTree:
    """A tree from about ``SAMPLE`` nodes, chosen by their hash, with leaves by the number of all."""
    n = nodes.count()
    every = max(1, n // SAMPLE)
    rows = nodes.where(F.pmod(F.xxhash64(NODE, F.lit("sample")), F.lit(every)) == 0).select("fp").limit(4 * SAMPLE).toArrow()
    fps = np.sort(rows.column(0).to_numpy().astype(np.int64)).view(np.uint64)
    return TopTree(fps, max(1, n // max(LEAF, int(8 * n**0.5))))


def link_forest(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b) node pairs whose components are those of all links between ``nodes`` (node, fp)."""
    nodes = nodes.select(NODE, "fp")
    tree = nodes.sparkSession.sparkContext.broadcast(top_tree(nodes))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.ascontiguousarray(batch.column(1).to_numpy()).view(np.uint64)
            for leaf, rows, home in tree.value.deal(fps, radius):
                held = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), leaf)), pa.array(home), *held.columns], names=["shard", "home", NODE, "fp"])

    def join(group: pa.Table) -> pa.Table:
        ids = group.column(NODE).to_numpy()
        fps = np.ascontiguousarray(group.column("fp").to_numpy()).view(np.uint64)
        home = group.column("home").to_numpy(zero_copy_only=False).astype(bool)
        order = np.lexsort((ids, ~home))
        ids, fps, home = ids[order], fps[order], home[order]
        roots = VantageJoin(fps, home, radius).forest.parent
        child = np.flatnonzero(roots != np.arange(len(roots)))
        return pa.table({"a": ids[child], "b": ids[roots[child]]})

    dealt = nodes.mapInArrow(lean(deal, "simhash"), "shard long, home boolean, node long, fp long")
    return dealt.groupBy("shard").applyInArrow(join, "a long, b long").where("a <> b")


def shingle_sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(node, hashes) of the nodes in ``pairs`` (a, b): the sorted shingle hashes, from a text of ``docs`` whose key the node has."""
    ends = pairs.select(F.col("a").alias(NODE)).union(pairs.select(F.col("b").alias(NODE))).distinct()
    wanted = staged(nodes.join(ends, NODE, "left_semi").select(NODE, F.col("key").alias("_key")), "wanted")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted
    text = F.col("text").cast("string")
    found = docs.select(text.alias("text"), F.xxhash64(text).alias("key")).join(side, F.col("key") == F.col("_key")).groupBy(NODE).agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                sets = [np.unique(shingle_hashes(text, k)).tobytes() for text in texts(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=[NODE, "hashes"])

    return found.select(NODE, "text").mapInArrow(lean(run, "simhash"), "node long, hashes binary")


def verified_links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, min_jaccard: float) -> DataFrame:
    """The ``pairs`` (a, b) whose sets of shingles have the similarity."""
    pairs = staged(pairs, "pairs")
    sets = staged(shingle_sets(docs, nodes, pairs, k), "sets")
    half = staged(skew_join(pairs, sets.select(F.col(NODE).alias("a"), F.col("hashes").alias("x")), "a"), "half")
    both = skew_join(half, sets.select(F.col(NODE).alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (left, right))
                apart = len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True))
                near.append(bool(apart <= unlike(len(x), len(y), min_jaccard)))
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return staged(both.mapInArrow(lean(run, "simhash"), "a long, b long"), "links")


def likely_pairs(nodes: DataFrame, pairs: DataFrame, min_jaccard: float) -> DataFrame:
    """The ``pairs`` (a, b) that the bitmaps of ``nodes`` don't rule out."""
    pairs = staged(pairs, "stars")
    marked = lambda end: nodes.select(F.col(NODE).alias(end), F.col("size").alias(f"size_{end}"), F.col("bitmap").alias(f"bitmap_{end}"))
    half = staged(skew_join(pairs, marked("a"), "a"), "marked")
    both = skew_join(half, marked("b"), "b").select("a", "b", "size_a", "size_b", "bitmap_a", "bitmap_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, marks = [batch.column(i).to_numpy() for i in (2, 3)], [batch.column(i).to_pylist() for i in (4, 5)]
            yield batch.select([0, 1]).filter(pa.array(may_link(*sizes, *marks, min_jaccard), pa.bool_()))

    return both.mapInArrow(lean(run, "simhash"), "a long, b long")


def cell_pairs(cells: np.ndarray, slices: np.ndarray, cross: np.ndarray, sizes: np.ndarray, labels: np.ndarray, marks: list[bytes], min_jaccard: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of two labels in one cell that may link; a ``cross`` cell compares two slices. Rows are sorted by cell, then size."""
    for step in range(1, len(cells)):
        near = (cells[step:] == cells[:-step]) & (sizes[:-step] >= min_jaccard * sizes[step:])
        if not near.any():  # nor further on: a cell's sizes rise
            return
        i = np.flatnonzero(near & (labels[step:] != labels[:-step]) & (~cross[step:] | (slices[step:] != slices[:-step])))
        if len(i):
            j = i + step
            kept = may_link(sizes[i], sizes[j], [marks[x] for x in i.tolist()], [marks[x] for x in j.tolist()], min_jaccard)
            yield i[kept], j[kept]


def pairs_of_labels(nodes: DataFrame, labels: DataFrame, min_jaccard: float) -> DataFrame:
    """(a, b) of nodes with different ``labels`` (node, label) that share a shard and may link."""
    sigs = labels.join(nodes.select(NODE, "size", "bands"), NODE).select(NODE, "size", "label", F.explode("bands").alias("sig"))
    sigs = staged(sigs, "labelled")
    mixed = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    mixed = staged(mixed.select("sig", "n", F.ceil(F.col("n") / SLICE).cast("int").alias("slices")), "mixed")
    rows = skew_join(sigs, mixed, "sig", counts="n").withColumn("slice", F.pmod(F.xxhash64(NODE), F.col("slices")).cast("int"))
    cell = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda x: F.struct(F.least(x, "slice").alias("i"), F.greatest(x, "slice").alias("j")))
    rows = rows.select("sig", NODE, "size", "label", "slice", F.explode(cell).alias("c")).select("sig", "c.i", "c.j", "size", NODE, "label", "slice")
    rows = rows.join(nodes.select(NODE, "bitmap"), NODE).select("sig", "i", "j", "size", NODE, "label", "slice", "bitmap")
    dealt = rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "size")

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        sig, i, j, sizes, ids, labels, slices = (table.column(x).to_numpy() for x in range(7))
        cells = np.cumsum(np.concatenate(([0], (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        for a, b in cell_pairs(cells, slices, i != j, sizes, labels, table.column(7).to_pylist(), min_jaccard):
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(ids[a], ids[b])), pa.array(np.minimum(ids[a], ids[b]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 8192:
                continue
            table = pa.Table.from_batches(held)
            last = [table.column(x)[-1].as_py() for x in range(3)]
            keys = [table.column(x).to_numpy() for x in range(3)]
            end = int(np.flatnonzero(~((keys[0] == last[0]) & (keys[1] == last[1]) & (keys[2] == last[2])))[-1:].sum() + 1)
            if (keys[0][0], keys[1][0], keys[2][0]) == tuple(last):
                end = 0
            if end:
                yield from compare(table.slice(0, end).combine_chunks())
                held = table.slice(end).combine_chunks().to_batches()
        if held:
            yield from compare(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(lean(run, "simhash"), "a long, b long").distinct()


def similar_links(docs: DataFrame, nodes: DataFrame, k: int, radius: int, min_jaccard: float) -> DataFrame:
    """(a, b) verified links whose components are those of all pairs of ``nodes`` with the similarity that share a shard or lie within the radius."""
    sigs = nodes.select(NODE, "size", "fp", F.explode("bands").alias("sig"))
    shared = staged(sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(NODE, "size", "fp")).alias("first")).where("n > 1"), "shared")
    met = skew_join(sigs, shared, "sig", counts="n")
    near = (F.col(NODE) != F.col("first.node")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("first.fp"))) < FAR)
    alike = F.least("size", "first.size") >= min_jaccard * F.greatest("size", "first.size")
    stars = met.where(near & alike).select(F.col(NODE).alias("a"), F.col("first.node").alias("b"))
    order = lambda pairs: pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    tried = staged(likely_pairs(nodes, order(stars.union(link_forest(nodes, radius))), min_jaccard), "tried")
    links = verified_links(docs, nodes, tried, k, min_jaccard)
    labels = staged(nodes.select(NODE).join(components(links), NODE, "left").select(NODE, F.coalesce("root", NODE).alias("label")), "labels")
    rest = pairs_of_labels(nodes, labels, min_jaccard).join(tried, ["a", "b"], "left_anti")
    return links.union(verified_links(docs, nodes, rest, k, min_jaccard))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Each round hangs every node's larger neighbours, then its smaller ones, on its
    smallest; rows per node are summed before the shuffle, and the neighbours of a node with
    many are dealt over ``SALTS`` tasks. It ends when a round changes nothing."""
    pairs = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    known = _checksum(pairs)
    while known[0]:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        dealt = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        above = both.where("v > u").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        large = above.join(dealt, ["u", "salt"]).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        kept = large.join(small, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        pairs = staged(kept.where("a <> b").distinct(), "edges")
        now = _checksum(pairs)
        if now == known:
            break
        known = now
    return pairs.select(F.col("a").alias(NODE), F.col("b").alias("root")).union(pairs.select(F.col("b"), F.col("b")).distinct())


def _checksum(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def rooted(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, min_jaccard: float | None = None, row: str = "CAST(0 AS BIGINT)") -> DataFrame:
    """(doc_id, row, fp, root) of each row of ``docs``: rows with the same root are linked; ``row`` is an expression over ``docs``."""
    verified = min_jaccard is not None
    prints = staged(fingerprints(docs, k, verified, row), "fingerprints")
    if verified:
        kept = [F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bitmap").alias("bitmap"), F.first("bands").alias("bands"), F.min("key").alias("key")]
        nodes = staged(prints.groupBy(NODE).agg(*kept), "nodes")
    else:
        prints = prints.withColumn(NODE, F.col("fp"))
        nodes = staged(prints.select(NODE).distinct(), "nodes").withColumn("fp", F.col(NODE))
    roots = components(similar_links(docs, nodes, k, radius, min_jaccard) if verified else link_forest(nodes, radius))
    rooted_nodes = staged(nodes.select(NODE).join(roots, NODE, "left").select(NODE, F.coalesce("root", NODE).alias("root")), "roots")
    return skew_join(prints.select("doc_id", "row", "fp", NODE), rooted_nodes, NODE).drop(NODE)


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, min_jaccard: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of each row of ``docs`` (doc_id, text); component_id is the smallest doc_id
    that links reach. With ``min_jaccard`` links are the pairs of that similarity of the sets of word shingles, at any ``radius``."""
    found = staged(rooted(docs, k, radius, min_jaccard), "rooted")
    names = staged(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "names")
    return skew_join(found, names, "root").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, k: int, radius: int, min_jaccard: float | None) -> DataFrame:
    """One row of ``docs`` per component, with all its columns: the one with the smallest doc_id (null last; then by a
    hash of the row; of equal rows one)."""
    p = free_prefix(docs)
    names = ", ".join("`" + c.replace("`", "``") + "`" for c in docs.columns)
    row = f"xxhash64({names})"
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    chosen = rooted(docs, k, radius, min_jaccard, row).groupBy("root").agg(first).select(F.col("first.doc_id").alias(f"{p}id"), F.col("first.row").alias(f"{p}chosen"))
    keyed = docs.withColumn(f"{p}row", F.expr(row))
    kept = keyed.join(chosen, keyed["doc_id"].cast("long").eqNullSafe(chosen[f"{p}id"]) & (keyed[f"{p}row"] == chosen[f"{p}chosen"]), "left_semi")
    return kept.dropDuplicates(["doc_id", f"{p}row"]).drop(f"{p}row")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all ``documents``: three words, three bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

