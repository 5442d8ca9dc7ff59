"""Language-model scores by prediction by partial matching (PPM).

Model. A trie of byte contexts up to ``ORDER`` bytes, trained on the documents that are not
held out: each context has the symbols seen behind it and how often. A symbol's
probability comes from the longest context, by escape method C: a context that
saw d symbols n times in all gives a symbol seen m times m / (n + d) and the escape d / (n + d).
After an escape the next shorter context is asked with the symbols of the longer one excluded
from its counts; below order 0 all bytes not yet excluded are equal. 0xFE pads
the start of a text and 0xFF ends it: neither is in UTF-8. A-Z are lower-cased.
The score is the log10 probability of all bytes and the end.

Training. Tasks count pairs (context, symbol) and words and emit them summed; Spark adds them
up. Only the longest contexts are counted, shorter ones are sums of these. The trie is never in one place: it is cut by the last two
bytes of the context, which all orders but the lowest two share, and each part gives the
probabilities of pairs of its own. Those of the ``HEAD_PAIRS`` most frequent pairs at most are broadcast and added up where the text is, the
others of a document go, once each, through a join. So nothing is left out at any size.

Base score. The sum over tokens of log10((c + 1) / (N + V + 1)), by the words themselves. The at most
``HEAD_WORDS`` most frequent ones (a power-of-two threshold, as for pairs) are
broadcast; the other words of a document go, once each, through a join with all counts.

Texts longer than ``SEGMENT_BYTES`` are read in segments cut at white space, with the context carried
over. Null text counts as empty: one token, the end. A null doc_id trains. Repeated
rows train and score each. Without training documents the base score is 0 and every byte costs
log10 256. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waytrace.llm.common import SEGMENT_BYTES, runs, skew_join, staged, table, texts

ORDER = 5
#: Pairs (context, symbol) and words that are broadcast, at most.
HEAD_PAIRS = 1 << 20
HEAD_WORDS = 1 << 18
#: Words that a task counts before it emits them.
HELD_WORDS = 400_000
PAD, END = 0xFE, 0xFF
#: The end token among the words.
END_WORD = b""
HOLD_OUT = (7, 2)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14), PAD, END]] = True


@dataclass
class Stretch:
    """Several texts, or one segment of one, laid out as: ``ORDER`` bytes of context, the bytes, the end."""

    raw: np.ndarray
    rows: np.ndarray  # the row of each piece
    begins: np.ndarray  # where its first predicted symbol is
    ends: np.ndarray  # behind its last

    def grams(self) -> np.ndarray:
        """The keys (context, symbol) of all predicted symbols, piece by piece."""
        key = self.raw.astype(np.int64)
        for back in range(1, ORDER + 1):
            key[back:] |= self.raw[:-back].astype(np.int64) << (8 * back)
        return key[self._predicted()]

    def _predicted(self) -> np.ndarray:
        mark = np.zeros(len(self.raw) + 1, np.int8)
        np.add.at(mark, self.begins, 1)
        np.add.at(mark, self.ends, -1)
        return np.cumsum(mark[:-1]) > 0


def segments(text: bytes) -> Iterator[tuple[int, int]]:
    """``text`` in parts of about ``SEGMENT_BYTES`` that end before white space; an empty text is one part."""
    begin = 0
    while len(text) - begin > SEGMENT_BYTES:
        at = begin + SEGMENT_BYTES
        while at < len(text) and not _WHITE[text[at]]:
            at += 1
        if at >= len(text):
            break
        yield begin, at
        begin = at
    yield begin, len(text)


def word_counts(text: bytes) -> Counter:
    """How often each word, A-Z lower-cased, is in ``text``; bytes split at ASCII white space alone."""
    found: Counter = Counter()
    for a, b in segments(text):
        found.update(text[a:b].lower().split())
    return found


def stretches(found: list[bytes]) -> Iterator[Stretch]:
    """All texts, A-Z lower-cased, about ``SEGMENT_BYTES`` at a time."""
    pieces = [(row, _context(text, a), text[a:b], b == len(text)) for row, text in enumerate(found) for a, b in segments(text)]
    for lo, hi in runs(np.array([len(p[2]) for p in pieces]), SEGMENT_BYTES):
        some = pieces[lo:hi]
        raw = _LOWER[np.frombuffer(b"".join(c + t + (b"\xff" if last else b"") for _, c, t, last in some), np.uint8)]
        sizes = np.array([len(t) + last for _, _, t, last in some])
        ends = np.cumsum(sizes + ORDER)
        yield Stretch(raw, np.array([r for r, *_ in some]), ends - sizes, ends)


def _context(text: bytes, begin: int) -> bytes:
    return (bytes([PAD]) * ORDER + text[max(0, begin - ORDER) : begin])[-ORDER:]


class Sums:
    """Sums of keys, held as sorted arrays."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > 2_000_000:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            keys = np.concatenate([k for k, _ in self.parts])
            counts = np.concatenate([c for _, c in self.parts])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            self.parts = [(keys[first], np.add.reduceat(counts, first))]
        self.size = sum(len(k) for k, _ in self.parts)
        return self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def count_corpus(training: DataFrame) -> DataFrame:
    """(word, gram, n): how often each word (gram is null) and each pair (context, symbol) (word is null) is in ``training`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams, ended = Counter(), Sums(), 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                found = texts(whole.column(0).slice(lo, 1024))
                ended += len(found)
                for text in found:
                    words.update(word_counts(text))
                    if len(words) > HELD_WORDS:
                        yield from _counted(words)
                        words = Counter()
                for part in stretches(found):
                    grams.add(part.grams())
                if grams.size > 1_500_000 and len(grams.merge()[0]) > 1_000_000:
                    yield from _summed(*grams.merge())
                    grams = Sums()
        if ended:
            words[END_WORD] += ended
        yield from _counted(words)
        yield from _summed(*grams.merge())

    return training.mapInArrow(run, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))


def _counted(words: Counter) -> Iterator[pa.RecordBatch]:
    keys, counts = list(words), list(words.values())
    for lo in range(0, len(keys), 1 << 16):
        k = keys[lo : lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.nulls(len(k), pa.int64()), pa.array(counts[lo : lo + (1 << 16)], pa.int64())], names=["word", "gram", "n"])


def _summed(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(keys), 1 << 16):
        k = keys[lo : lo + (1 << 16)].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.binary()), pa.array(k), pa.array(counts[lo : lo + (1 << 16)].astype(np.int64))], names=["word", "gram", "n"])


def most_frequent(counts: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The rows of ``counts`` (key, n) with n >= 2 ** t, t being the smallest that leaves ``most`` rows or fewer; and t."""
    sizes = dict(tuple(r) for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("t")).count().collect())
    t = 0
    while sum(c for k, c in sizes.items() if k >= t) > most:
        t += 1
    return counts.where(F.col("n") >= (1 << t)), t


class Trie:
    """The trained contexts: per order the entries (context, symbol) and the contexts, both sorted by key."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.entries, self.contexts = [], []
        for j, (keys, n) in enumerate(orders):
            context, first, seen = np.unique(keys >> 8, return_index=True, return_counts=True)
            total = np.add.reduceat(n, first) if len(n) else n
            shared = np.zeros(len(context), np.int64)
            if j:
                below_keys, below_n = orders[j - 1]
                held = below_n[np.searchsorted(below_keys, keys & ((1 << 8 * j) - 1))] if len(n) else n
                shared = np.add.reduceat(held, first) if len(n) else n
            self.entries.append((keys, n.astype(np.float64)))
            self.contexts.append((context, total.astype(np.float64), seen.astype(np.float64), shared.astype(np.float64)))

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """The log10 probability of each (context, symbol) of ``ORDER`` + 1 bytes."""
        keys = keys.astype(np.int64)
        out = np.zeros(len(keys))
        # what the longer context, if it is known, takes from the next: the counts and the number of its symbols
        less, fewer = np.zeros(len(keys)), np.zeros(len(keys))
        todo = np.arange(len(keys))
        for j in range(len(self.entries) - 1, -1, -1):
            here = keys[todo] & ((1 << 8 * (j + 1)) - 1)
            context, total, seen, shared = self.contexts[j]
            if not len(context):
                continue
            at = np.minimum(np.searchsorted(context, here >> 8), len(context) - 1)
            known = context[at] == here >> 8
            mass, symbols = total[at] - less[todo], seen[at] - fewer[todo]
            entry, n = self.entries[j]
            where = np.minimum(np.searchsorted(entry, here), len(entry) - 1)
            hit = known & (entry[where] == here)
            out[todo[hit]] += np.log10(n[where[hit]] / (mass[hit] + symbols[hit]))
            miss = known & ~hit & (symbols > 0)
            out[todo[miss]] += np.log10(symbols[miss] / (mass[miss] + symbols[miss]))
            less[todo[known]], fewer[todo[known]] = shared[at[known]], seen[at[known]]
            less[todo[~known]] = fewer[todo[~known]] = 0
            todo = todo[~hit]
        out[todo] -= np.log10(256 - fewer[todo])
        return out


def order_counts(grams: DataFrame, j: int) -> DataFrame:
    """(key, n) of the entries of order ``j``, from those of the highest."""
    mask = (1 << 8 * (j + 1)) - 1
    return grams.groupBy(F.col("key").bitwiseAND(mask).alias("key")).agg(F.sum("n").alias("n")) if j < ORDER else grams


def collected(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The (key, n) rows of ``counts`` as sorted arrays."""
    kept = counts.select("key", "n").toArrow()
    keys, n = kept.column("key").to_numpy().astype(np.int64), kept.column("n").to_numpy().astype(np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def gram_logs(keys: DataFrame, grams: DataFrame) -> DataFrame:
    """(key, rows, log) of each of the distinct ``keys`` (key, rows), by tries of the entries of ``grams`` (key, n) that share two bytes of context."""
    # at most 256 and 65,536 entries
    low = grams.sparkSession.sparkContext.broadcast([collected(order_counts(grams, j)) for j in range(2)])
    suffix = F.shiftright("key", 8).bitwiseAND(0xFFFF).alias("suffix")

    def run(wanted: pa.Table, held: pa.Table) -> pa.Table:
        asked = wanted.column("key").to_numpy().astype(np.int64)
        if not len(asked):
            return pa.table({"key": pa.array([], pa.int64()), "rows": pa.array([], pa.int64()), "log": pa.array([], pa.float64())})
        last = asked[0] >> 8 & 0xFF
        keys, n = held.column("entry").to_numpy().astype(np.int64), held.column("times").to_numpy().astype(np.int64)
        zero, (one, one_n) = low.value
        orders = [zero, (one[one >> 8 == last], one_n[one >> 8 == last])]
        for j in range(2, ORDER + 1):
            entry, at = np.unique(keys & ((1 << 8 * (j + 1)) - 1), return_inverse=True)
            total = np.zeros(len(entry), np.int64)
            np.add.at(total, at, n)
            orders.append((entry, total))
        return pa.table({"key": asked, "rows": wanted.column("rows"), "log": Trie(orders).log10(asked)})

    entries = grams.select(suffix, F.col("key").alias("entry"), F.col("n").alias("times"))
    return keys.select(suffix, "key", "rows").groupBy("suffix").cogroup(entries.groupBy("suffix")).applyInArrow(run, "key long, rows long, log double")


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, gram long, times long"


def score(docs: DataFrame, modulus: int = HOLD_OUT[0], remainder: int = HOLD_OUT[1]) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    counts = staged(count_corpus(rows.where(~F.col("held_out")).select("text")), "counts")
    words = counts.where("word IS NOT NULL").select(F.col("word").alias("key"), "n")
    grams = counts.where("gram IS NOT NULL").select(F.col("gram").alias("key"), "n")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    head, floor = most_frequent(words, HEAD_WORDS)
    head = head.toArrow()
    logs = dict(zip(head.column("key").to_pylist(), np.log10(head.column("n").to_numpy() + 1.0).tolist(), strict=True))
    often = gram_logs(most_frequent(grams, HEAD_PAIRS)[0].select("key", F.col("n").alias("rows")), grams).select("key", "log").toArrow()
    order = np.argsort(often.column("key").to_numpy())
    model = spark.sparkContext.broadcast((often.column("key").to_numpy()[order], often.column("log").to_numpy()[order], logs))
    end_n = words.where(F.col("key") == F.lit(END_WORD)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_keys, gram_logs, logs = model.value
        number = TaskContext.get().partitionId() << 33
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                n = batch.num_rows
                n_tokens, n_known, base, total = [1] * n, [int(end_n > 0)] * n, [float(np.log10(end_n + 1.0))] * n, np.zeros(n)
                ids = number + np.arange(n)
                number += n
                found = texts(batch.column(2))
                far_row, far_word, far_times = [], [], []
                for i, text in enumerate(found):
                    for word, times in word_counts(text).items():
                        n_tokens[i] += times
                        log = logs.get(word)
                        if log is not None:
                            n_known[i] += times
                            base[i] += times * log
                        elif floor:
                            far_row.append(i)
                            far_word.append(word)
                            far_times.append(times)
                if far_row:
                    yield _scored(ids[far_row], word=pa.array(far_word, pa.binary()), times=pa.array(far_times))
                for part in stretches(found):
                    grams, back = np.unique(part.grams(), return_inverse=True)
                    sizes = part.ends - part.begins
                    filled = np.flatnonzero(sizes)
                    if not len(filled):
                        continue
                    log, known = np.zeros(len(grams)), np.zeros(len(grams), bool)
                    if len(gram_keys):
                        where = np.minimum(np.searchsorted(gram_keys, grams), len(gram_keys) - 1)
                        known = gram_keys[where] == grams
                        log[known] = gram_logs[where[known]]
                    far = np.flatnonzero(~known[back])
                    if len(far):
                        pairs, times = np.unique(np.repeat(part.rows, sizes)[far] * len(grams) + back[far], return_counts=True)
                        yield _scored(ids[pairs // len(grams)], gram=pa.array(grams[pairs % len(grams)]), times=pa.array(times))
                    np.add.at(total, part.rows[filled], np.add.reduceat(log[back], (np.cumsum(sizes) - sizes)[filled]))
                yield _scored(ids, doc_id=batch.column(0), held_out=batch.column(1), n_tokens=pa.array(n_tokens), n_known=pa.array(n_known), base=pa.array(base), score=pa.array(total))

    found = staged(rows.mapInArrow(run, SCORED), "scored")
    seldom = found.where("word IS NOT NULL").select("row", F.col("word").alias("key"), "times")
    rest = skew_join(seldom, words, "key").groupBy("row").agg(F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("_base"))
    far = found.where("gram IS NOT NULL").select("row", F.col("gram").alias("key"), "times")
    asked = far.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    beyond = skew_join(far, staged(gram_logs(asked, grams), "logs"), "key", counts="rows").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("_score"))
    joined = found.where("word IS NULL AND gram IS NULL").drop("word", "gram", "times").join(rest, "row", "left").join(beyond, "row", "left")
    cost = float(np.log10(tokens + (distinct + 1)))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(cost)).alias("base_score"),
        (F.col("score") + F.coalesce("_score", F.lit(0.0))).alias("score"),
    )


_TYPES = {"row": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "word": pa.binary(), "gram": pa.int64(), "times": pa.int64()}


def _scored(row: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
    n = len(row)
    held = {"row": pa.array(row), **columns}
    return pa.RecordBatch.from_arrays([held.get(k, pa.nulls(n, t)).cast(t) for k, t in _TYPES.items()], names=list(_TYPES))


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learned from those whose id's checksum isn't 2 modulo 7."""
    return score(table(spark, sf_dir, "documents"))
