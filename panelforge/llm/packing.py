"""Best-fit packing of tokenised documents into fixed-length training sequences.

Documents are tokenised where they lie; only piece descriptions (no ids) are written and shuffled.
Each task then runs a bounded-space online best fit: at most ``open_bins`` sequences are open,
indexed by their free space in a bitset, so the tightest fit is one shift and one lowest-bit
lookup. When a new sequence is needed and all are open, the fullest closes. A task looks ahead by one block
of pieces, which it takes longest first. Every task leaves its last sequences part empty; so the number of
tasks follows the number of tokens (``task_sequences`` full sequences each), not that of input partitions.

Edge cases: a null or empty text is the end id alone; the name of a special token inside a text is that token,
as in the tokenizer itself; a null doc_id is packed like any other; repeated rows are packed once per row; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import materialize, table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
CACHE_WORDS = 100_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordEncoder(dict):
    """Token ids of a text as little-endian bytes, with a bounded cache of words (its own items).

    The byte-level pre-tokenizer never joins characters across a single space that stands between two
    non-space characters, so the parts between such spaces can be encoded apart, each with its leading space.

    The tokenizer's JSON file defines the ids. Parts of Latin characters alone are encoded from the same
    file's vocabulary as merge ranks, by a faster encoder that gives the same ids; all others by tokenizers.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__()
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.special = {name: array("I", [i]).tobytes() for name, i in special.items()}
        longest_first = sorted(special, key=len, reverse=True)
        self.cuts = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if special else None
        symbols = byte_symbols()
        ranks = {bytes(symbols[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, part: str) -> bytes:
        if part.isascii() or max(part) < "\u0250":
            return array("I", self.fast(part)).tobytes()
        return array("I", self.tok.encode(part, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.encode(" " + word)
        return found

    @staticmethod
    def parts(text: str) -> list[str]:
        """The first part stands as it is, the others without their leading space."""
        out = text.split(" ")
        if "" not in out and out == list(map(str.strip, out)):
            return out
        joined = [out[0]]
        for p in out[1:]:
            last = joined[-1]
            if p and last and not p[0].isspace() and not last[-1].isspace():
                joined.append(p)
            else:
                joined[-1] = f"{last} {p}"
        return joined

    def text_ids(self, text: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        if self.cuts and self.cuts.search(text):  # the pre-tokenizer sees what stands between special tokens
            return b"".join(self.special.get(t) or self.plain_ids(t) for t in self.cuts.split(text) if t)
        return self.plain_ids(text)

    def plain_ids(self, text: str) -> bytes:
        first, *rest = self.parts(text)
        return self.encode(first) + b"".join(map(self.__getitem__, rest))


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def encoder(path: str) -> WordEncoder:
    """One encoder, and one cache of words, in a worker process."""
    return WordEncoder(path)


def tokenise(docs: DataFrame, capacity: int, tokenizer: str, end_id: int = 0) -> DataFrame:
    """One row per piece. Only documents longer than the capacity are cut; their first piece takes the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        for b in batches:
            doc_ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for lo in range(0, len(texts), 500):
                rows: list[tuple] = []
                for d, text in zip(doc_ids[lo : lo + 500], texts[lo : lo + 500]):
                    ids = words.text_ids(text) + end
                    n = len(ids) // 4
                    at, size, k = 0, (n % capacity or capacity) if n > capacity else n, 0
                    while at < n:
                        rows.append((d, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                        at, size, k = at + size, capacity, k + 1
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


class BestFit:
    """Bounded-space best fit. place() returns (bin number, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.by_free, self.open, self.made = 0, {}, 0, 0

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            stack = self.by_free[free]
            number = stack.pop()
            if not stack:
                self.bits &= ~(1 << free)
        else:
            if self.open >= self.open_bins:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self.by_free[fullest].pop()
                self.open -= 1
                if not self.by_free[fullest]:
                    self.bits &= ~(1 << fullest)
            number, free = self.made, self.capacity
            self.made += 1
            self.open += 1
        left = free - length
        if left:
            self.by_free.setdefault(left, []).append(number)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return number, self.capacity - free


def pack(pieces: DataFrame, capacity: int, open_bins: int = 4096, block: int = 8192, task_sequences: int = 4096) -> DataFrame:
    """Adds sequence_id and offset. Pieces are written first, then dealt by a hash, so a repeated task packs the same way.

    A task takes its pieces in blocks, longest first within a block, and carries its open sequences along.
    """
    pieces = materialize(pieces, "pieces")
    tokens = pieces.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, round(tokens / (capacity * task_sequences)))
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 36
        for b in batches:
            for lo in range(0, b.num_rows, block):
                part = b.slice(lo, block)
                part = part.take(pa.array(np.argsort(-part.column(3).to_numpy(), kind="stable")))
                placed = [fit.place(n) for n in part.column(3).to_pylist()]
                sequence, offset = (pa.array([p[k] + first for p in placed], pa.int64()) for k, first in ((0, base), (1, 0)))
                yield pa.RecordBatch.from_arrays([*part.columns[:5], sequence, offset], names=[*names, "sequence_id", "offset"])

    # The row's own number spreads pieces that are alike in all else.
    key = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()).alias("_order")
    dealt = pieces.select("*", key).repartition(tasks, "_order").sortWithinPartitions("_order")
    return dealt.drop("_order").mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 2048, open_bins: int = 4096, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents with the sequence and offset each is packed at."""
    return pack(tokenise(docs, capacity, tokenizer or default_tokenizer()), capacity, open_bins)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
