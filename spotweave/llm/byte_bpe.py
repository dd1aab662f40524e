"""Operator 6: byte-level BPE encoding and decoding.

The merge of the lowest rank goes first, the leftmost one among equals. Pairs wait in a queue with one bucket of positions per rank; a
hierarchy of bitmap words has a bit for every non-empty bucket, and finding the first set bit from the top word down gives the next
rank in two steps, whatever the length of the pre-token. The pieces form a linked list; entries whose pair has changed since are
skipped when they come up. So a pre-token of n bytes costs O(n) queue steps.

Texts are split by the pre-token pattern. The pre-tokens of a batch that are not known yet are encoded together, each distinct one
once, and remembered by the worker in a table of bounded size.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from spotweave.llm.common import bounded_batches, give_back, text_of, without

REMEMBERED = 300_000  # pre-tokens in a generation of the table
BLOCK_BYTES = 1 << 18  # bytes of pre-tokens that are merged together


class RankQueue:
    """Min-queue of (rank, position): buckets per rank under a bitmap of two levels, words of 256 bits below one word on top.

    The top word has a bit per lower word with any bit set. A bucket is a heap of positions; its bit stays until `drop`.
    """

    def __init__(self, ranks: int) -> None:
        self.words = [0] * ((ranks + 255) >> 8)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def fill(self, rank: int, positions: list[int]) -> None:
        """A bucket for a rank that has none; `positions` rise."""
        self.buckets[rank] = positions
        word = rank >> 8
        self.top |= 1 << word
        self.words[word] |= 1 << (rank & 255)

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.fill(rank, [position])
        else:
            heapq.heappush(bucket, position)

    def lowest(self) -> int:
        """The lowest rank with a bucket, or -1."""
        top = self.top
        if not top:
            return -1
        word = (top & -top).bit_length() - 1
        bits = self.words[word]
        return (word << 8) + (bits & -bits).bit_length() - 1

    def drop(self, rank: int) -> None:
        """Takes an empty bucket away."""
        del self.buckets[rank]
        word = rank >> 8
        self.words[word] ^= 1 << (rank & 255)
        if not self.words[word]:
            self.top ^= 1 << word

    def pop(self) -> tuple[int, int] | None:
        """The lowest rank and the leftmost position in its bucket."""
        rank = self.lowest()
        if rank < 0:
            return None
        position = heapq.heappop(self.buckets[rank])
        if not self.buckets[rank]:
            self.drop(rank)
        return rank, position


class Encoder:
    """Encodes pre-tokens by a table of token bytes -> rank.

    Merges are looked up by the ids of two neighbours. Pre-tokens are encoded together: they lie one after the other in one list of
    pieces, no pair reaches over a border, and one queue serves all of them, so a bucket holds the places of its rank in all of them.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.queue = RankQueue(self.size)
        # bytes that are no token get ids beyond the ranks: they can be merged but not returned
        ids = {bytes([b]): self.size + b for b in range(256)} | ranks
        self.shift = (self.size + 256).bit_length()
        self.merges: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                x, y = ids.get(token[:cut]), ids.get(token[cut:])
                if x is not None and y is not None:
                    self.merges[x << self.shift | y] = rank
        self.bytes = np.array([ids[bytes([b])] for b in range(256)], dtype=np.int64)
        # rank of the merge of two bytes; -1 if there is none
        self.first = np.array([[ranks.get(bytes([x, y]), -1) for y in range(256)] for x in range(256)], dtype=np.int64)

    def encode(self, piece: bytes) -> list[int]:
        return np.frombuffer(self.encode_all([piece])[0], dtype="<u4").tolist()

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (32-bit little-endian) of non-empty pre-tokens."""
        ranks = self.ranks
        out: list = [ranks[p].to_bytes(4, "little") if p in ranks else None for p in pieces]
        block: list[int] = []
        size = 0
        for k, x in enumerate(out):
            if x is None:
                block.append(k)
                size += len(pieces[k])
                if size >= BLOCK_BYTES:
                    self._merge(pieces, block, out)
                    block, size = [], 0
        if block:
            self._merge(pieces, block, out)
        return out

    def _merge(self, pieces: list[bytes], block: list[int], out: list) -> None:
        raw = np.frombuffer(b"".join([pieces[k] for k in block]), dtype=np.uint8)
        n = len(raw)
        ends = np.cumsum([len(pieces[k]) for k in block])
        starts = np.concatenate(([0], ends[:-1]))
        rank = np.full(n, -1, dtype=np.int64)
        rank[:-1] = self.first[raw[:-1], raw[1:]]
        rank[ends - 1] = -1
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[starts] = -1
        token = self.bytes[raw].tolist()  # id of the piece at i; -1 once it has become part of the piece to its left
        pair = rank.tolist()  # rank of the merge of the piece at i with the next; -1 if there is none or i is gone
        right, left = after.tolist(), before.tolist()

        queue = self.queue
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[at])) + 1
        for bucket in np.split(at, cuts) if len(at) else ():
            queue.fill(int(rank[bucket[0]]), bucket.tolist())
        merge, shift, push, buckets, heappop = self.merges.get, self.shift, queue.push, queue.buckets, heapq.heappop
        while (r := queue.lowest()) >= 0:
            bucket = buckets[r]
            lower = False  # a merge made a pair of lower rank, which goes first
            while bucket and not lower:
                i = heappop(bucket)
                if pair[i] != r:
                    continue
                j = right[i]
                stop = right[i] = right[j]
                token[i] = r
                token[j] = pair[j] = -1
                new = -1
                if stop >= 0:
                    left[stop] = i
                    new = merge(r << shift | token[stop], -1)
                    if new >= 0:
                        push(new, i)
                        lower = new < r
                pair[i] = new
                k = left[i]
                if k >= 0:
                    pair[k] = new = merge(token[k] << shift | r, -1)
                    if new >= 0:
                        push(new, k)
                        lower = lower or new < r
            if not bucket:
                queue.drop(r)

        ids = np.array(token, dtype=np.int64)
        alive = ids >= 0
        if (ids >= self.size).any():
            raise ValueError("the vocabulary lacks bytes that occur in the texts")
        packed = ids[alive].astype("<u4").tobytes()
        upto = np.concatenate(([0], np.cumsum(alive)[ends - 1])).tolist()
        for k, a, b in zip(block, upto, upto[1:]):
            out[k] = packed[4 * a : 4 * b]


class Remembered:
    """Pre-token -> ids as little-endian 32-bit integers, in two generations.

    When the young one is full it becomes the old one. What is met again in the old one moves up, the rest goes with it, so frequent
    pre-tokens stay however many rare ones there are.
    """

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of texts given as their pre-tokens."""
        need = set().union(*texts).difference(self.young) if texts else set()
        known: dict[str, bytes] = {}
        if need:
            known = {p: self.old[p] for p in need & self.old.keys()}
            new = [p for p in need if p not in known]
            known.update(zip(new, self.encoder.encode_all([p.encode() for p in new])))
            if len(self.young) + len(known) > REMEMBERED:
                # this batch may need what goes: it is looked up in a table of its own
                known = {p: self.young[p] for p in set().union(*texts) & self.young.keys()} | known
                self.old, self.young = self.young, {}
            self.young.update(known)
        get = self.young.__getitem__
        return [b"".join(map(get, t)) for t in texts]

    def forget(self) -> None:
        """At the end of a task: a worker that waits for the next one holds no table beside those of other operators."""
        self.young, self.old = {}, {}


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank per line. The ids are the ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_CODECS: dict = {}


def worker_codec(key: int, table: Broadcast, pattern: str) -> tuple:
    """(splitter, pre-token table, token bytes), kept by the worker process for one vocabulary at a time; what the table remembers goes with the task."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = regex.compile(pattern).findall, Remembered(Encoder(table.value)), {i: b for b, i in table.value.items()}
    return _CODECS[key]


def codec(spark: SparkSession, ranks: dict[bytes, int], pattern: str):
    """(encode, decode, both): column functions text -> binary ids (32-bit little-endian), ids -> bytes, and text -> struct of both.

    The table goes to the workers as one broadcast; its size is that of the vocabulary, not of the data.
    """
    table = spark.sparkContext.broadcast(ranks)
    key = xxhash.xxh3_64_intdigest(repr((sorted(ranks.items()), pattern)))

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        split, seen, _ = worker_codec(key, table, pattern)
        try:
            for texts in batches:
                yield pd.Series(seen.encode([split(t) for t in texts]), index=texts.index, dtype=object)
        finally:
            seen.forget()
            give_back()

    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = worker_codec(key, table, pattern)[2]
        for ids in batches:
            yield ids.map(lambda x: b"".join(map(words.__getitem__, memoryview(x).cast("I"))))

    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for ids in encode(batches):
            yield pd.DataFrame({"ids": ids, "decoded": next(decode(iter([ids])))})

    pair = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return F.pandas_udf(encode, T.BinaryType()), F.pandas_udf(decode, T.BinaryType()), F.pandas_udf(both, pair)


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text") -> DataFrame:
    """`docs` with ids (binary, 32-bit little-endian) and decoded (binary).

    A null text is the empty text: no ids, no bytes. All rows are returned; input columns of these names are replaced.
    """
    _, _, both = codec(bounded_batches(docs).sparkSession, ranks, pattern)
    d = without(docs, ["ids", "decoded", "_bpe"]).withColumn("_bpe", both(text_of(text_col)))
    return d.select("*", "_bpe.ids", "_bpe.decoded").drop("_bpe")


def digest() -> list:
    return [
        F.expr("cast(octet_length(ids) / 4 as long)").alias("n_tokens"), F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    ]
