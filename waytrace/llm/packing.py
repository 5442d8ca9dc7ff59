"""Packing of token sequences by first-fit decreasing.

1. Every text is tokenized once, where it lies; a document of n ids is cut into pieces
   of ``capacity`` ids and a rest. Only (doc_id, start, length, checksum, n) of
   each piece goes on; neither texts nor ids are shuffled.
2. The pieces are staged and dealt at random into groups of about ``group_size``.
   A group is packed by itself: pieces in falling length, each into
   the first open sequence with room. A tournament tree of what is free in
   each sequence finds that sequence in log(n) steps.

Because a piece of ``capacity`` ids fills a sequence and the rests are of all lengths,
almost the only padding is in the last few sequences of each group.

Tokenizing: between two characters that aren't white space, a single space or a
single line feed always ends a pre-token of the byte-level pattern, so the ids of
such words can be kept per word. The words not met before go to the tokenizer
together, one per line. Texts with any other white space go to it whole.

Null text counts as empty (one id, the end), repeated rows are packed each on
their own, an empty table gives an empty result. A null doc_id stays null.
Very long texts become many pieces, which are dealt to groups one by one.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waytrace.llm.common import kept, lean, staged, table

CAPACITY = 2048
END_ID = 1
GROUP_SIZE = 2048
#: Words whose ids a worker keeps.
CACHE_WORDS = 600_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

#: Marks that never start a contraction.
PLAIN_MARKS = ".,;:!?#$%&*|"


def byte_symbols() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokenizer:
    """The ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.newline = self.raw("\n")
        self.after_space: dict[str, bytes] = {}
        self.at_start: dict[str, bytes] = {}
        self.known_marks: dict[str, bytes] = {"": b""}
        self.symbols = byte_symbols()
        probe = "ab cd\nef gh"
        self.by_word = self.raw(probe) == self.raw("ab") + self.raw(" cd") + self.newline + self.raw("ef") + self.raw(" gh")

    def raw(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, known: dict[str, bytes], words: list[str], lead: str) -> dict[str, bytes]:
        """The ids of words that aren't known. Letters before plain marks are two pre-tokens, which the
        model splits itself; other words are read one per line, where a line feed is one id of its own."""
        found: dict[str, bytes] = {}
        other = []
        split, symbols = self.tokenizer.model.tokenize, self.symbols
        for word in words:
            letters = word.rstrip(PLAIN_MARKS)
            if letters.isalpha():
                ids = [token.id for token in split((lead + letters).encode().decode("latin-1").translate(symbols))]
                found[word] = array("I", ids).tobytes() + self.marks(word[len(letters) :])
            else:
                other.append(word)
        if other:
            ids = np.asarray(self.tokenizer.encode("\n".join(lead + w for w in other), add_special_tokens=False).ids, dtype="<u4")
            line = np.frombuffer(self.newline, "<u4")[0]
            ends = np.append(np.flatnonzero(ids == line), len(ids))
            if len(ends) != len(other):
                found.update((w, self.raw(lead + w)) for w in other)
            else:
                raw, begin = ids.tobytes(), 0
                for word, end in zip(other, ends.tolist(), strict=True):
                    found[word] = raw[4 * begin : 4 * end]
                    begin = end + 1
        if len(known) + len(found) <= CACHE_WORDS:
            known.update(found)
        return found

    def marks(self, text: str) -> bytes:
        if text not in self.known_marks:
            if len(self.known_marks) > 10_000:
                self.known_marks.clear()
            self.known_marks[text] = self.raw(text)
        return self.known_marks[text]

    def _look_up(self, known: dict[str, bytes], lists: list[list[str]], lead: str) -> list[bytes]:
        got = [list(map(known.get, words)) for words in lists]
        holes = [i for i, ids in enumerate(got) if None in ids]
        if holes:
            missing = {w for i in holes for w, ids in zip(lists[i], got[i], strict=True) if ids is None}
            new = self.learn(known, sorted(missing), lead)
            for i in holes:
                got[i] = [new[w] if ids is None else ids for w, ids in zip(lists[i], got[i], strict=True)]
        return [b"".join(ids) for ids in got]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        firsts: list[list[str]] = []
        rests: list[list[str]] = []
        where: list[tuple[int, int]] = []
        for i, text in enumerate(texts):
            if not text:
                out[i] = b""
            elif not self.by_word or len(text.split()) != text.count(" ") + text.count("\n") + 1:  # other white space
                out[i] = self.raw(text)
            else:
                lines = [line.split(" ") for line in text.split("\n")]
                where.append((i, len(lines)))
                firsts += [line[:1] for line in lines]
                rests += [line[1:] for line in lines]
        heads = self._look_up(self.at_start, firsts, "")
        tails = self._look_up(self.after_space, rests, " ")
        at = 0
        for i, n in where:
            out[i] = self.newline.join([h + t for h, t in zip(heads[at : at + n], tails[at : at + n], strict=True)])
            at += n
        return out


_TOKENIZERS: dict[str, WordTokenizer] = kept("packing")


def tokenizer_for(path: str) -> WordTokenizer:
    """One per worker and file, so that the words it knows serve later tasks, until another operator runs there."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def _tokenizer_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    return path


def pieces_of(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of each piece of each document."""
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer_for(_tokenizer_path(tokenizer))
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                doc, start, length, crc, total = [], [], [], [], []
                encoded = words.encode([t or "" for t in batch.column(1).to_pylist()])
                for key, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                    ids += end
                    for at in range(0, len(ids), width):
                        piece = ids[at : at + width]
                        doc.append(key)
                        start.append(at // 4)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(len(ids) // 4)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run, "packing"), PIECES)


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each piece, given in falling length, each at most ``capacity``."""
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    sequences, offsets = [], []
    for n in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < n:
                node += 1
        sequences.append(node - leaves)
        offsets.append(capacity - free[node])
        free[node] -= n
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
    return sequences, offsets


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_size: int = GROUP_SIZE) -> DataFrame:
    """Adds sequence_id and offset. ``pieces`` is a staged table: its rows are counted, then dealt by their place in it."""
    groups = max(1, -(-pieces.count() // group_size))

    def run(group: pa.Table) -> pa.Table:
        columns = {name: group.column(name).to_numpy(zero_copy_only=False) for name in ("start", "length", "ids_crc32", "place")}
        order = np.lexsort((columns["place"], columns["start"], columns["ids_crc32"], -columns["length"]))
        sequences, offsets = first_fit(columns["length"][order].tolist(), capacity)
        base = group.column("bundle")[0].as_py() << 31
        packed = group.take(pa.array(order)).drop_columns(["bundle", "place"])
        packed = packed.append_column("sequence_id", pa.array(np.asarray(sequences, np.int64) + base))
        return packed.append_column("offset", pa.array(np.asarray(offsets, np.int64)))

    dealt = pieces.withColumn("place", F.monotonically_increasing_id())
    dealt = dealt.withColumn("bundle", F.pmod(F.xxhash64("place", "doc_id", "start"), F.lit(groups)))
    return dealt.groupBy("bundle").applyInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group_size: int = GROUP_SIZE) -> DataFrame:
    """The place of every piece of every document in sequences of at most ``capacity`` ids."""
    return pack_pieces(staged(pieces_of(docs, tokenizer, capacity, end_id), "pieces"), capacity, group_size)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all ``documents`` into sequences of 2048 ids."""
    return pack(table(spark, sf_dir, "documents"))
