"""A quality classifier from weak labels.

1. Overlapping heuristic labellers vote on every text: bad, good or nothing. Their votes are a number
   in base 3, and the corpus is counted by it: at most 3 ** len(LABELLERS) rows reach the driver.
2. Expectation-maximisation over these counts estimates the shares of good texts and of kinds of bad
   ones and, for each labeller, how often it is right on each. This gives each
   pattern of votes a posterior probability of good.
3. Posterior labels train a hashed linear scorer (logistic regression on the shares of a text's
   words in ``BUCKETS`` hashed features: the word, the kinds of characters in it, whether it repeats a
   neighbour; a word itself counts ``WORD_WEIGHT``). It is fitted to a bounded sample: about ``SAMPLE_ROWS`` texts, half from either
   side, chosen by a hash of the row; only texts whose hash may be chosen are read a second time.
4. The scorer judges every text. Texts with a score below ``threshold`` are rejected.

Votes and counts cover whole texts; a text longer than ``SEGMENT_BYTES`` is read in pieces cut at
white space whose sums are added. A text without words (null, empty) gets no votes and
score 0, so it is rejected. Texts with the same score as the threshold stay. Repeated rows are judged alike. An empty table gives an empty result. All columns of a
table pass through ``keep_good``; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waytrace.llm.common import SEGMENT_BYTES, lean, table, texts

BUCKETS = 1 << 16
SAMPLE_ROWS = 6000
THRESHOLD = 0.5
ROUNDS = 60
WORD_WEIGHT = 0.1
STEPS = 150

NOTHING, BAD, GOOD = 0, 1, 2

UPPER, LOWER, DIGIT, MARK, NOISE, BANG, PIPE, OTHER = (1 << i for i in range(8))
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_KIND = np.full(256, OTHER, np.uint8)
_KIND[_WHITE] = 0
_KIND[65:91] = UPPER
_KIND[97:123] = LOWER
_KIND[128:] = LOWER
_KIND[48:58] = DIGIT
for _chars, _kind in ((b".,;:?'\"()-", MARK), (b"#$%&*<>~^_=+@{}[]\\/`", NOISE), (b"!", BANG), (b"|", PIPE)):
    _KIND[list(_chars)] = _kind
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)

#: Frequent function words of the four languages.
FUNCTION_WORDS = (
    "the of and to in is that it was for on are with as be this have from or by "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es "
    "de la le les et des en un une du que est pour qui dans par sur pas au "
    "el los las y del se con una su para al lo como más"
).split()


def _hash(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit key of each byte range, case folded."""
    n = len(raw)
    up = np.full(n, _BASE, np.uint64)
    up[:1] = 1
    down = np.full(n, pow(int(_BASE), -1, 1 << 64), np.uint64)
    down[:1] = 1
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_FOLD[raw].astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(up))))
        key = (sums[last] - sums[first]) * np.multiply.accumulate(down)[first]
        key = (key ^ (last - first).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        return key ^ (key >> np.uint64(31))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((x.astype(np.uint64) * np.uint64(0x94D049BB133111EB)) >> np.uint64(40)).astype(np.int64) % (BUCKETS // 2)


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff((~_WHITE[raw]).astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_keys(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.unique(_hash(raw, *_words(raw)))


_FUNCTION_KEYS = word_keys(FUNCTION_WORDS)

#: What is counted of a text.
WORDS, CAPITALS, SMALL, NOISY, BANGED, PIPED, AGAIN, LOOPED, FUNCTION, STOPPED = range(10)


def _pieces(text: bytes) -> Iterator[bytes]:
    begin = 0
    while len(text) - begin > SEGMENT_BYTES:
        at = begin + SEGMENT_BYTES
        while at < len(text) and not _WHITE[text[at]]:
            at += 1
        yield text[begin:at]
        begin = at
    yield text[begin:]


def read_text(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The counts of a text, and the hashed features of its words (three for each)."""
    counts, features = np.zeros(10, np.int64), []
    for piece in _pieces(text):
        raw = np.frombuffer(piece, np.uint8)
        first, last = _words(raw)
        if not len(first):
            continue
        key = _hash(raw, first, last)
        kind = _KIND[raw]
        mask = np.bitwise_or.reduceat(kind, first)
        again = np.concatenate(([False], key[1:] == key[:-1]))
        looped = np.zeros(len(key), bool)
        for back in (2, 3, 4):
            looped[back:] |= key[back:] == key[:-back]
        at = np.minimum(np.searchsorted(_FUNCTION_KEYS, key), len(_FUNCTION_KEYS) - 1)
        counts += [
            len(key),
            (kind == UPPER).sum(),
            (kind == LOWER).sum(),
            ((mask & NOISE) != 0).sum(),
            ((mask & BANG) != 0).sum(),
            ((mask & PIPE) != 0).sum(),
            again.sum(),
            (looped & ~again).sum(),
            (_FUNCTION_KEYS[at] == key).sum(),
            ((kind[last - 1] & (MARK | BANG)) != 0).sum(),
        ]
        shape = mask.astype(np.uint64) * np.uint64(4) + again.astype(np.uint64) * np.uint64(2)
        features += [_mixed(key), BUCKETS // 2 + _mixed(shape), BUCKETS // 2 + _mixed(shape + looped.astype(np.uint64) + np.uint64(1 << 20))]
    return counts, np.concatenate(features) if features else np.zeros(0, np.int64)


def _over(bad: float, good: float, part: int, of: int = WORDS, least: int = 4):
    """Bad where the share of ``part`` is over ``bad``, good where it is under ``good``."""

    def vote(c: np.ndarray) -> int:
        if c[of] < least:
            return NOTHING
        share = c[part] / c[of]
        return BAD if share > bad else GOOD if share < good else NOTHING

    return vote


def _capitals(c: np.ndarray) -> int:
    letters = c[CAPITALS] + c[SMALL]
    share = c[CAPITALS] / letters if letters else 0
    return NOTHING if letters < 20 else BAD if share > 0.35 else GOOD if share < 0.15 else NOTHING


def _functions(c: np.ndarray) -> int:
    return NOTHING if c[WORDS] < 30 else GOOD if c[FUNCTION] >= 0.1 * c[WORDS] else BAD if c[FUNCTION] < 0.02 * c[WORDS] else NOTHING


def _sentences(c: np.ndarray) -> int:
    return NOTHING if c[WORDS] < 30 else GOOD if 0.02 * c[WORDS] <= c[STOPPED] <= 0.4 * c[WORDS] else BAD if c[STOPPED] > 0.8 * c[WORDS] else NOTHING


LABELLERS = {
    "noise": _over(0.25, 0.03, NOISY),
    "capitals": _capitals,
    "bangs": _over(0.25, 0.05, BANGED),
    "stutter": _over(0.25, 0.05, AGAIN),
    "loops": _over(0.3, 0.1, LOOPED, least=20),
    "pipes": _over(0.2, 0.02, PIPED, least=3),
    "functions": _functions,
    "sentences": _sentences,
}


def vote(counts: np.ndarray) -> int:
    """All votes on a text as a number in base 3."""
    code = 0
    for labeller in LABELLERS.values():
        code = 3 * code + labeller(counts)
    return code


def votes_of(code: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        out.append(code % 3)
        code //= 3
    return out[::-1]


@dataclass
class Model:
    #: the share of each class: good, then a kind of bad for each labeller
    shares: np.ndarray
    #: [labeller, class, vote], among the votes that say something
    rates: np.ndarray
    #: the probability of good by the code of the votes
    posterior: dict[int, float]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    bias: float = 0.0

    def accuracies(self) -> dict[str, float]:
        """How often each labeller is right, by the estimates, when it speaks of good texts or of its own kind of bad ones."""
        own = np.arange(len(self.rates))
        good, bad = self.shares[0] * self.rates[:, 0, GOOD], self.shares[own + 1] * self.rates[own, own + 1, BAD]
        return dict(zip(LABELLERS, ((good + bad) / (self.shares[0] + self.shares[own + 1])).tolist(), strict=True))

    def score(self, features: np.ndarray, words: int) -> float:
        """The scorer's probability of good; features of words are the lower half of the buckets."""
        return float(1 / (1 + np.exp(-(self.bias + self.weights[features].sum() / words)))) if words else 0.0


def expectation_maximisation(codes: list[int], times: list[int]) -> Model:
    """Latent classes: good, and a kind of bad for each labeller, as texts bad in one way are fine in others.

    Starts from: good unless a labeller says bad, and then of the kind of the first that does. Who says nothing tells nothing.
    A kind that differs from good texts in one vote only can't be told from a labeller that is often wrong by counts alone:
    a prior that weighs as much as the corpus says that labellers seldom call good texts bad."""
    kinds = 1 + len(LABELLERS)
    votes = np.array([votes_of(c) for c in codes], np.int64).reshape(len(codes), len(LABELLERS))
    n = np.array(times, float)
    bad = votes == BAD
    start = np.where(bad.any(1), 1 + bad.argmax(1), 0)
    part = np.full((len(codes), kinds), 0.01)
    part[np.arange(len(codes)), start] = 1
    part /= part.sum(1, keepdims=True)
    rates, shares = np.zeros((len(LABELLERS), kinds, 3)), np.full(kinds, 1 / kinds)
    for _ in range(ROUNDS if len(codes) else 0):
        mass = part * n[:, None]
        shares = (mass.sum(0) + 0.1) / (n.sum() + 0.1 * kinds)
        for v in (BAD, GOOD):
            rates[:, :, v] = (votes == v).T.astype(float) @ mass + 0.1
        rates[:, 0, GOOD] += n.sum()
        rates /= rates.sum(2, keepdims=True)
        told = np.where(np.arange(3) == NOTHING, 1.0, rates)
        logs = np.log(shares)[None, :] + sum(np.log(told[j][:, votes[:, j]]).T for j in range(len(LABELLERS)))
        part = np.exp(logs - logs.max(1, keepdims=True))
        part /= part.sum(1, keepdims=True)
    return Model(shares, rates, dict(zip(codes, part[:, 0].tolist(), strict=True)))


def fit_linear(rows: np.ndarray, features: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on sparse rows, in float64 and so the same in each run."""
    weights, bias = np.zeros(BUCKETS), 0.0
    values = values * np.where(features < BUCKETS // 2, WORD_WEIGHT, 1.0)
    used, at = np.unique(features, return_inverse=True)
    w, m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    n = len(wanted)
    for step in range(1, STEPS + 1 if n else 1):
        p = 1 / (1 + np.exp(-(w[-1] + np.bincount(rows, w[at] * values, minlength=n))))
        off = (p - wanted) / n
        slope = np.append(np.bincount(at, off[rows] * values, minlength=len(used)) + 1e-5 * w[:-1], off.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    weights[used], bias = w[:-1] * np.where(used < BUCKETS // 2, WORD_WEIGHT, 1.0), float(w[-1])
    return weights, bias


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.pmod(F.xxhash64("doc_id", text), F.lit(1 << 30)).alias("draw"), text.alias("text"))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Votes on all of ``docs``, the labellers' rates, and the scorer."""
    rows = _rows(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                for text in texts(batch.column(0).slice(lo, 512)):
                    code = vote(read_text(text)[0])
                    held[code] = held.get(code, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["code", "n"])

    found = sorted(tuple(r) for r in rows.select("text").mapInArrow(lean(count, "quality"), "code long, n long").groupBy("code").agg(F.sum("n")).collect())
    model = expectation_maximisation([c for c, _ in found], [n for _, n in found])
    sizes = [0, 0]
    for code, n in found:
        sizes[model.posterior[code] > 0.5] += n
    chance = [min(1.0, sample_rows / 2 / max(1, s)) * (1 << 30) for s in sizes]
    posterior = model.posterior

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                for draw, text in zip(part.column(0).to_pylist(), texts(part.column(1)), strict=True):
                    counts, features = read_text(text)
                    good = posterior[vote(counts)]
                    if counts[WORDS] and draw < chance[good > 0.5]:
                        f, times = np.unique(features, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([draw]), pa.array([good]), pa.array([f.tolist()], pa.list_(pa.int64())), pa.array([(times / counts[WORDS]).tolist()], pa.list_(pa.float64()))], names=["draw", "good", "features", "shares"])

    # bounded by sample_rows
    drawn = rows.where(F.col("draw") < max(chance)).select("draw", "text").mapInArrow(lean(sample, "quality"), "draw long, good double, features array<long>, shares array<double>").toArrow()
    drawn = drawn.sort_by([("draw", "ascending"), ("good", "ascending")]).combine_chunks()
    if drawn.num_rows:
        lists = drawn.column("features").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        model.weights, model.bias = fit_linear(np.repeat(np.arange(drawn.num_rows), lengths), lists.flatten().to_numpy(), drawn.column("shares").combine_chunks().flatten().to_numpy(), drawn.column("good").to_numpy())
    return model


def classify(docs: DataFrame, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, votes, posterior, score, keep) of each row of ``docs``. ``votes``: a letter for each labeller, b(ad), g(ood) or -."""
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                votes, posterior, score = [], [], []
                for text in texts(batch.column(1)):
                    counts, features = read_text(text)
                    code = vote(counts)
                    votes.append("".join("-bg"[v] for v in votes_of(code)))
                    posterior.append(m.posterior.get(code))
                    score.append(m.score(features, int(counts[WORDS])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(votes, pa.string()), pa.array(posterior, pa.float64()), pa.array(score, pa.float64()), pa.array([s >= threshold for s in score], pa.bool_())],
                    names=["doc_id", "votes", "posterior", "score", "keep"],
                )

    return _rows(docs).select("doc_id", "text").mapInArrow(lean(run, "quality"), "doc_id long, votes string, posterior double, score double, keep boolean")


def keep_good(docs: DataFrame, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                read = [read_text(t) for t in texts(batch.column(at))]
                yield batch.filter(pa.array([m.score(f, int(c[WORDS])) >= threshold for c, f in read], pa.bool_()))

    return docs.mapInArrow(lean(run, "quality"), docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes, posterior, score and verdict for all ``documents``."""
    return classify(table(spark, sf_dir, "documents"))
