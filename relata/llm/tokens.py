"""Token ids of whole texts by a public byte-level BPE vocabulary (problem 8).

Merges of one pre-token come out of a rank queue: a bucket for each merge rank holds the positions of that pair, and
a bitmap of three levels over the ranks finds the least rank in use with three find-first-set steps. Positions are
linked lists over arrays; an entry whose pair has changed since is stale and skipped. So a pre-token of n bytes takes
O(n) steps of constant time, however long it is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.session import table

#: Folder with the vocabulary files; a parameter of every function that needs it.
FOLDER = "/opt/tokenizers"

#: Fixed value: the published pre-token pattern of this vocabulary.
PRE_TOKENS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

WORD = 6  # bits: a word of the bitmap has 64
CACHE_ENTRIES = 200_000  # distinct pre-tokens remembered by a task
CACHE_BYTES = 48  # longer ones are rarely seen twice


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable
    Latin-1, else the next code point from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class RankQueue:
    """Merge ranks in use, least first, with the positions noted for each."""

    __slots__ = ("words", "middle", "top", "buckets")

    def __init__(self, ranks: int):
        n = (ranks >> WORD) + 1
        self.words = [0] * n
        self.middle = [0] * ((n >> WORD) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        w = rank >> WORD
        self.words[w] |= 1 << (rank & 63)
        self.middle[w >> WORD] |= 1 << (w & 63)
        self.top |= 1 << (w >> WORD)

    def pop(self) -> tuple[int, list[int]] | None:
        """The least rank and its positions from left to right."""
        top = self.top
        if not top:
            return None
        a = (top & -top).bit_length() - 1
        middle = self.middle[a]
        w = (a << WORD) | ((middle & -middle).bit_length() - 1)
        word = self.words[w]
        rank = (w << WORD) | ((word & -word).bit_length() - 1)
        word &= word - 1
        self.words[w] = word
        if not word:
            middle &= middle - 1
            self.middle[a] = middle
            if not middle:
                self.top = top & (top - 1)
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


class Encoder:
    """A byte-level BPE vocabulary with merges by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        names = byte_names()
        vocab: dict[str, int] = model["vocab"]
        self.of_byte = [0] * 256
        for name, byte in names.items():
            self.of_byte[byte] = vocab[name]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.ranks = len(model["merges"])
        self.split = regex.compile(PRE_TOKENS).findall
        self.cache: dict[str, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        of_byte, pairs = self.of_byte, self.pairs
        ids = [of_byte[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        queue = RankQueue(self.ranks)
        push = queue.push
        following = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        for i in range(n - 1):
            known = pairs.get((ids[i], ids[i + 1]))
            if known:
                push(known[0], i)
        while (least := queue.pop()) is not None:
            rank, positions = least
            for i in positions:
                j = following[i]
                if j >= n or ids[i] < 0:
                    continue
                known = pairs.get((ids[i], ids[j]))
                if known is None or known[0] != rank:
                    continue  # stale: one side has been merged since
                ids[i] = known[1]
                ids[j] = -1
                k = following[i] = following[j]
                if k < n:
                    before[k] = i
                    if after := pairs.get((ids[i], ids[k])):
                        push(after[0], i)
                h = before[i]
                if h >= 0 and (prior := pairs.get((ids[h], ids[i]))):
                    push(prior[0], h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text without special tokens; [] for NULL and for ''. Text that looks like a special token is
        ordinary text."""
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for piece in self.split(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= CACHE_BYTES:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(name: str = "byte_bpe_50k", folder: str = FOLDER) -> Encoder:
    """The encoder of a vocabulary file, loaded once in each Python worker."""
    return Encoder(f"{folder}/{name}.json")


def _batches(batches: Iterator[pa.RecordBatch], name: str, folder: str) -> Iterator[pa.RecordBatch]:
    own = encoder(name, folder)
    for batch in batches:
        ids = pa.array([own.encode(text) for text in batch.column("text").to_pylist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])


def encoded(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(doc_id, ids): one row for each row of documents (doc_id, text), with the token ids of the whole text.

    NULL and empty texts get an empty list. There is no shuffle: each task encodes the rows it reads.
    """
    return documents.select("doc_id", "text").mapInArrow(
        lambda batches: _batches(batches, name, folder), "doc_id bigint, ids array<int>"
    )


def token_counts(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = FOLDER, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carry, n_tokens): the length of each text in tokens, 0 for NULL and empty ones, and the columns ``carry``
    of its row, so that nothing has to be joined back."""
    kinds = dict(documents.dtypes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(name, folder)
        for batch in batches:
            sizes = pa.array([len(own.encode(text)) for text in batch.column("text").to_pylist()], pa.int32())
            names = ["doc_id", *carry]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], sizes], names=[*names, "n_tokens"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry)
    return documents.select("doc_id", *carry, "text").mapInArrow(count, f"doc_id bigint, {schema + ', ' if carry else ''}n_tokens int")


def p8_ids(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def p8_counts(spark, sf_dir: str) -> DataFrame:
    """Documents and tokens for each language, with the mean characters a token."""
    counts = token_counts(table(spark, sf_dir, "documents"), carry=("lang", "n_chars"))
    return counts.groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").cast("bigint").alias("tokens"),
        F.round(F.sum("n_chars") / F.sum("n_tokens"), 6).alias("chars_per_token"),
    )
