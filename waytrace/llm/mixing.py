"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sizes are words. All documents of a source, in an order given by a hash, form one stream of
words, cut into blocks of ``block_words``. A source with target t of s words is drawn
t div s whole times and once in part, so its target is a quota of block draws; the last draw of the
partial pass is cut, so a source gives its target to the word.

1. Tree. The quotas of all sources are split among ``shards`` output shards of equal draws: the shards
   are halved again and again, and each time the draws of each source that go to the
   left half are one multivariate hypergeometric sample. So every shard
   has an exact quota of each source, as if all draws had been shuffled
   together, but only counts were ever touched. Beyond 10 ** 9 draws in a split, where the exact sampler ends, a normal variable of the same
   mean and variance is rounded; the quotas' sums stay exact.
2. Draws. The quotas of a source, shard by shard, are disjoint ranges of draw numbers. A draw takes the block at its place in a
   keyed permutation (a Feistel network walked back into range), another one for each pass.
3. The words of a document are taken where a drawn block holds them. A block has a shard, and a random place in it:
   ``mix_rows`` puts each shard in one partition, shuffled by place.

Scale. Nothing needs a source in one task: word offsets are sums over buckets of
documents, then within a bucket; targets are found by rounds of aggregates over
one row per source; the tree first splits segments of sources (their number is the
root of the sources' number; these are collected), then each segment splits its
own. The number of shards grows with the words (``SHARD_WORDS``). The table of sources is broadcast only while it has ``BROADCAST_SOURCES`` rows or less;
otherwise it is joined by a shuffle, where adaptive execution splits hot sources. Documents alike in id, text
and source are one row with a count until their places in the stream are known.

Null text has size 0, the null source is one of its own and comes last; an empty
table gives an empty mix, documents without words are in it with 0 taken. Repeated
rows are drawn each on their own. Very long texts lie in many blocks. Runs with one seed agree. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waytrace.llm.common import free_prefix, lean, local_table, staged, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 1024
#: Draws that the exact sampler splits at once.
EXACT_DRAWS = 10**9 - 1
#: Shards at least, and words of a shard, about.
SHARDS = 64
SHARD_WORDS = 1 << 24
#: Draws that one row of the plan stands for.
RANGE_DRAWS = 4096
BUCKET_ROWS = 4096
BROADCAST_SOURCES = 10_000
SEED = 20_240_101


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(*parts: np.ndarray | int) -> np.ndarray:
    """A 64-bit mix of whole numbers."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for part in parts:
            h = (np.asarray(part).astype(np.uint64) ^ h) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(32))
    return h


def _walked(x: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool) -> np.ndarray:
    half = np.ones(len(x), np.int64)
    while (short := (np.int64(1) << (2 * half)) < n).any():
        half += short
    mask = (np.int64(1) << half) - 1
    out, todo = x.astype(np.int64).copy(), np.arange(len(x))
    while len(todo):
        v, h, m = out[todo], half[todo], mask[todo]
        left, right = v >> h, v & m
        for step in range(3, -1, -1) if back else range(4):
            if back:
                left, right = right ^ (mix64(left, key[todo], step).astype(np.int64) & m), left
            else:
                left, right = right, left ^ (mix64(right, key[todo], step).astype(np.int64) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """What stands at place x in a permutation of range(n) that ``key`` chooses; all arrays of one length."""
    return _walked(x, n, key, False)


def place_of(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where x stands in that permutation."""
    return _walked(x, n, key, True)


def part_of(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` draws without replacement are of each colour, of which there are ``counts``."""
    rest = int(counts.sum())
    if rest <= EXACT_DRAWS:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    out = np.zeros(len(counts), np.int64)
    for i, own in enumerate(counts.tolist()):
        if rest <= EXACT_DRAWS:
            out[i:] = rng.multivariate_hypergeometric(counts[i:], n, method="marginals")
            break
        mean = n * (own / rest)
        spread = (mean * (1 - own / rest) * ((rest - n) / max(1, rest - 1))) ** 0.5
        out[i] = min(own, n, max(0, n - (rest - own), round(rng.normal(mean, spread))))
        rest, n = rest - own, n - int(out[i])
    return out


def split_tree(counts: np.ndarray, capacities: np.ndarray, seed: int) -> np.ndarray:
    """[source, shard] quotas: ``counts`` draws of each source dealt to shards of ``capacities`` draws."""
    quotas = np.zeros((len(counts), len(capacities)), np.int64)
    stack = [(0, len(capacities), np.asarray(counts, np.int64))]
    while stack:
        lo, hi, here = stack.pop()
        if hi - lo == 1:
            quotas[:, lo] = here
            continue
        mid = (lo + hi) // 2
        left = part_of(np.random.default_rng([seed, lo, hi]), here, int(capacities[lo:mid].sum()))
        stack += [(lo, mid, left), (mid, hi, here - left)]
    return quotas


def even(total: int, shards: int) -> np.ndarray:
    return np.array([total * (i + 1) // shards - total * i // shards for i in range(shards)], np.int64)


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, rows, sid, weight, target) of each source of ``sized`` (source, size, alike: rows); sid counts them by code point, null last."""
    summed = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("alike").alias("rows"))
    ordered = staged(summed.orderBy(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("place", 33)
    before, counts = 0, []
    for p, n in sorted(tuple(r) for r in ordered.groupBy(part.alias("part")).count().collect()):  # one row per partition
        counts.append((p, before))
        before += n
    offsets = local_table(ordered.sparkSession, counts, "part long, before long")
    sid = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ordered.join(F.broadcast(offsets), part == offsets["part"]).select("source", "source_size", "rows", sid.alias("sid"))
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.pmod("sid", F.lit(len(weights))) + 1).cast("int")))
    ceiling = F.col("source_size") * F.lit(most)
    goal = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > ceiling
        n, held, free = ranked.agg(F.sum(above.cast("long")), F.sum(F.when(above, ceiling).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if not free or n == capped:
            break
        level, capped = (goal - held) / free, n
    share_of = F.col("weight") * F.lit(float(level or 0.0))
    return ranked.withColumn("target", F.when(share_of > ceiling, ceiling).otherwise(share_of).cast("double"))


def draw_counts(size: np.ndarray, wanted: np.ndarray, block: int, sid: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per source: blocks, whole passes, words of the partial pass, draws in all."""
    blocks = -(-size // block)
    passes = np.where(size > 0, wanted // np.maximum(size, 1), 0)
    rest = np.where(size > 0, wanted - passes * size, 0)
    short = size - (blocks - 1) * block
    last = place_of(np.maximum(blocks - 1, 0), np.maximum(blocks, 1), mix64(sid, passes, seed))
    part = np.where(rest <= block * last, -(-rest // block), np.where(rest <= block * last + short, last + 1, -(-(rest + block - short) // block)))
    return blocks, passes, rest, blocks * passes + part


def quota_ranges(sources: DataFrame, block: int, shards: int, seed: int) -> DataFrame:
    """``sources`` with ``edges``: the draw numbers at which each shard's quota of the source begins, and the end."""
    spark = sources.sparkSession

    def draws_of(group: pd.DataFrame) -> np.ndarray:
        return draw_counts(group["source_size"].to_numpy(np.int64), np.floor(group["target"].to_numpy() + 0.5).astype(np.int64), block, group["sid"].to_numpy(np.int64), seed)[3]

    n = sources.count()
    width = max(1, int(np.ceil(n**0.5)))
    segments = sources.withColumn("segment", F.floor(F.col("sid") / width).cast("long"))

    def total(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"segment": group["segment"].iloc[:1], "draws": [int(draws_of(group).sum())]})

    totals = sorted(tuple(r) for r in segments.groupBy("segment").applyInPandas(total, "segment long, draws long").collect())
    top = split_tree(np.array([d for _, d in totals], np.int64), even(sum(d for _, d in totals), shards), seed) if totals else np.zeros((0, shards), np.int64)
    rooms = local_table(spark, [(s, row.tolist()) for (s, _), row in zip(totals, top, strict=True)], "segment long, room array<long>")

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("sid")
        quotas = split_tree(draws_of(group), np.asarray(group["room"].iloc[0], np.int64), seed + 1 + int(group["segment"].iloc[0]))
        edges = np.concatenate([np.zeros((len(group), 1), np.int64), quotas.cumsum(1)], axis=1)
        return group.drop(columns=["segment", "room"]).assign(edges=list(edges))

    return segments.join(F.broadcast(rooms), "segment").groupBy("segment").applyInPandas(deal, f"{_ddl(sources)}, edges array<long>")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def sources_of(docs: DataFrame, weights: tuple, share: float, most: float, block: int, shards: int | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """The sizes of all documents, alike ones as one row (doc_id, source, size, order, alike), and the sources with their quotas."""
    text = F.col("text").cast("string")
    order = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in(text).alias("size"), order.alias("order"))
    sized = staged(rows.groupBy("doc_id", "source", "size", "order").agg(F.count(F.lit(1)).alias("alike")), "sizes")
    sources = staged(source_targets(sized.select("source", (F.col("size") * F.col("alike")).alias("size"), "alike"), weights, share, most), "targets")
    if shards is None:
        shards = max(SHARDS, -(-int(sources.agg(F.sum("target")).first()[0] or 0) // SHARD_WORDS))
    return sized, staged(quota_ranges(sources, block, shards, seed), "quotas")


def stream_offsets(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document (a row of its own, numbered ``copy`` among those alike) with its source's figures and ``start``, its first word's number in its source's stream."""
    side = sources.drop("edges").withColumnRenamed("source", "_source")
    side = F.broadcast(side) if sources.count() <= BROADCAST_SOURCES else side
    rows = sized.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("bucket", F.pmod("order", F.ceil(F.col("rows") / BUCKET_ROWS))).withColumn("_words", F.col("size") * F.col("alike"))
    sums = rows.groupBy("sid", "bucket").agg(F.sum("_words").alias("_sum"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("sid", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(sums, ["sid", "bucket"]).withColumn("_start", F.col("_before") + F.coalesce(F.sum("_words").over(within), F.lit(0)))
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("alike") - 1)))
    return copies.select("doc_id", "order", "copy", "alike", "sid", "size", "source_size", "target", (F.col("_start") + F.col("copy") * F.col("size")).alias("start"))


def block_draws(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """(sid, block, pass, shard, place, open): the blocks that each shard's quotas draw; ``open`` words of a block are taken."""
    ranges = sources.select("sid", "source_size", "target", "edges", F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("_n"))
    ranges = ranges.select("sid", "source_size", "target", (F.col("_n") - 1).cast("long").alias("shard"), F.element_at("edges", F.col("_n")).alias("_from"), F.element_at("edges", F.col("_n") + 1).alias("_to"))
    ranges = ranges.where("_from < _to").withColumn("begin", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1, F.lit(RANGE_DRAWS).cast("long"))))
    ranges = ranges.select("sid", "source_size", "target", "shard", "begin", F.least(F.col("_to"), F.col("begin") + RANGE_DRAWS).alias("end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 64):
                sid, total, target, shard, begin, end = (c.to_numpy() for c in big.slice(lo, 64).columns)
                blocks, passes, rest, _ = draw_counts(total, np.floor(target + 0.5).astype(np.int64), block, sid, seed)
                n = end - begin
                row = np.repeat(np.arange(len(n)), n)
                draw = begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                turn, at = draw // blocks[row], draw % blocks[row]
                key = mix64(sid[row], turn, seed)
                number = permuted(at, blocks[row], key)
                last = place_of(blocks[row] - 1, blocks[row], key)
                short = total[row] - (blocks[row] - 1) * block
                drawn_before = at * block - np.where(at > last, block - short, 0)
                length = np.where(number == blocks[row] - 1, short, block)
                open_ = np.where(turn < passes[row], length, np.clip(rest[row] - drawn_before, 0, length))
                place = mix64(sid[row], draw, seed + 1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (sid[row], number, turn, shard[row], place, open_)], names=["sid", "block", "pass", "shard", "place", "open"])

    return ranges.mapInArrow(lean(run, "mixing"), "sid long, block long, pass long, shard long, place long, open long")


def draws(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    block_words: int = BLOCK_WORDS,
    shards: int | None = None,
    seed: int = SEED,
    whole: bool = False,
) -> DataFrame:
    """The words the mix takes: a row for each (document, pass, block) drawn, with the shard and the place the
    block has in it. A document of which nothing is taken has one row of 0 words and null pass, block, shard and place.

    ``whole``: a document is taken entire, where its first word is drawn, and not otherwise."""
    sized, sources = sources_of(docs, weights, share, most, block_words, shards, seed)
    placed = staged(stream_offsets(sized, sources), "placed")
    first, width = F.floor(F.col("start") / block_words), F.lit(block_words)
    reach = first if whole else F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = placed.where("size > 0").select("doc_id", "order", "copy", "sid", "size", "start", F.explode(F.sequence(first, reach)).alias("block"))
    opened = F.col("block") * width + F.col("open")
    begin = F.greatest(F.col("start"), F.col("block") * width)
    words = F.when(begin < opened, F.col("size")).otherwise(0) if whole else F.least(F.col("start") + F.col("size"), opened) - begin
    got = pieces.join(block_draws(sources, block_words, seed), ["sid", "block"]).withColumn("words", words.cast("long")).where("words > 0")
    got = got.select(F.col("doc_id").alias("_id"), F.col("order").alias("_order"), F.col("copy").alias("_copy"), "pass", "block", "words", F.col("shard").cast("int").alias("shard"), "place")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("order") == F.col("_order")) & (F.col("copy") == F.col("_copy"))
    return placed.join(got, same, "left").drop("_id", "_order", "_copy", "start").withColumn("words", F.coalesce("words", F.lit(0).cast("long")))


def mix_rows(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, shards: int | None = None) -> DataFrame:
    """The rows of ``docs`` as often as the mix of whole documents takes them, with the columns of ``docs``. A partition is
    a shard, its rows are shuffled.

    Rows alike in doc_id, source and text share out what is taken of them together."""
    p = free_prefix(docs)
    taken = staged(draws(docs, weights, share, most, seed=seed, shards=shards, whole=True).where("words > 0").select("doc_id", "order", "sid", "alike", "shard", "place", "pass", "copy"), "drawn")
    many = (taken.agg(F.max("shard")).first()[0] or 0) + 1
    lists = F.array_sort(F.collect_list(F.struct("pass", "copy", "shard", "place")))
    # two hashes name the rows alike, for the join and the numbers of these rows, so that texts are shuffled once for both
    names = lambda order: [order.alias(f"{p}key"), F.xxhash64(order, F.col("doc_id").cast("long")).alias(f"{p}two")]
    got = taken.groupBy("doc_id", "order", "sid", "alike").agg(lists.alias(f"{p}drawn"))
    got = got.select(*names(F.col("order")), F.col("alike").alias(f"{p}alike"), f"{p}drawn")
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *names(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string"))))
    joined = keyed.join(got, [f"{p}key", f"{p}two"])
    nth = F.row_number().over(Window.partitionBy(f"{p}key", f"{p}two").orderBy(f"{p}key")) - 1
    own = F.filter(f"{p}drawn", lambda d, i: i % F.col(f"{p}alike") == F.col(f"{p}nth"))
    rows = joined.withColumn(f"{p}nth", nth).withColumn(f"{p}at", F.explode(own))
    dealt = rows.repartitionById(many, F.col(f"{p}at.shard")).sortWithinPartitions(F.xxhash64(f"{p}at.place", f"{p}key", f"{p}at.copy"), f"{p}key")
    return dealt.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each of all ``documents`` the shards' draws take, and in which shards (ascending)."""
    found = draws(table(spark, sf_dir, "documents"))
    taken = found.groupBy("doc_id", "order", "copy", "size", "source_size", "target").agg(F.sum("words").alias("taken"), F.array_join(F.array_sort(F.collect_set("shard")), ",").alias("shards"))
    return taken.select("doc_id", "size", "source_size", "target", "taken", "shards")
