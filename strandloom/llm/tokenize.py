"""Encoding of a whole corpus with a public byte-level tokenizer.

A text is cut into pre-tokens by the tokenizer's pattern; each pre-token is merged pair by pair, lowest merge rank first,
leftmost first among equals.  The merge order is kept in a hierarchical-bitmap rank queue: one bucket per merge rank holds
the positions of the linked list at which that merge is possible, a tree of 64-bit words tells in three find-first-set
steps which bucket comes next, and entries that a neighbouring merge has made stale are skipped when they come up.  Each
pre-token costs a number of steps in proportion to its length, which matters for pre-tokens of thousands of bytes (encoded
blobs, runs of one character).

Defined cases: null and empty texts give an empty list; strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame

from strandloom.session import spread

#: Folder of the vocabulary files; a parameter of every operator here.
VOCABULARIES = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
# Fixed value: the pattern that cuts text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same on texts without a character beyond ASCII.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens whose ids a worker keeps; beyond it starts afresh, which changes no result.
MEMO = 400_000
#: Longer pre-tokens are encoded each time they occur.
MEMO_LENGTH = 64


class RankQueue:
    """Buckets of positions by rank, with a three-level bitmap over the ranks that have any."""

    __slots__ = ("buckets", "leaves", "middle", "root")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.leaves: dict[int, int] = {}
        self.middle: dict[int, int] = {}
        self.root = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        leaf, mid = rank >> 6, rank >> 12
        self.leaves[leaf] = self.leaves.get(leaf, 0) | 1 << (rank & 63)
        self.middle[mid] = self.middle.get(mid, 0) | 1 << (leaf & 63)
        self.root |= 1 << mid

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank with entries, and its positions."""
        root = self.root
        if not root:
            return None
        mid = (root & -root).bit_length() - 1
        word = self.middle[mid]
        leaf = mid << 6 | ((word & -word).bit_length() - 1)
        bits = self.leaves[leaf]
        rank = leaf << 6 | ((bits & -bits).bit_length() - 1)
        bits &= bits - 1
        self.leaves[leaf] = bits
        if not bits:
            word &= word - 1
            self.middle[mid] = word
            if not word:
                self.root = root & (root - 1)
        return rank, self.buckets.pop(rank)


class Encoder(dict):
    """Pre-token -> tuple of ids; missing entries are merged by the rank queue."""

    def __init__(self, path: str) -> None:
        super().__init__()
        import re

        import regex

        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as file:
            for line in file:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.first = [self.ranks[bytes([b])] for b in range(256)]
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.pairs: dict[int, int] = {}  # left id << 17 | right id -> rank of the merged token, -1 for none
        self.cut = regex.compile(PATTERN).findall
        self.cut_ascii = re.compile(ASCII_PATTERN, re.ASCII).findall

    def rank_of(self, left: int, right: int) -> int:
        key = left << 17 | right
        r = self.pairs.get(key)
        if r is None:
            r = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], -1)
            if len(self.pairs) < 4 * MEMO:
                self.pairs[key] = r
        return r

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        n = len(data)
        ids: list[int] = [self.first[b] for b in data]
        if n < 2:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of, queue = self.rank_of, RankQueue()
        due = [-1] * n  # the rank under which a position's pair is waiting
        for i in range(n - 1):
            if (r := rank_of(ids[i], ids[i + 1])) >= 0:
                due[i] = r
                queue.push(r, i)
        while (top := queue.pop()) is not None:
            rank, positions = top
            if len(positions) > 1:
                positions.sort()
            for k, i in enumerate(positions):
                if due[i] != rank:
                    continue  # stale: a merge beside it changed or took this pair
                j = after[i]
                ids[i], ids[j], due[j] = rank, -1, -1
                end = after[i] = after[j]
                due[i] = -1
                if end < n:
                    before[end] = i
                    if (r := rank_of(rank, ids[end])) >= 0:
                        due[i] = r
                        queue.push(r, i)
                start = before[i]
                if start >= 0:
                    r = due[start] = rank_of(ids[start], rank)
                    if r >= 0:
                        queue.push(r, start)
                if queue.root and rank > self._lowest(queue):
                    # a pair that just arose comes first; the rest of this bucket waits its turn
                    for p in positions[k + 1 :]:
                        if due[p] == rank:
                            queue.push(rank, p)
                    break
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    @staticmethod
    def _lowest(queue: RankQueue) -> int:
        root = queue.root
        mid = (root & -root).bit_length() - 1
        word = queue.middle[mid]
        leaf = mid << 6 | ((word & -word).bit_length() - 1)
        bits = queue.leaves[leaf]
        return leaf << 6 | ((bits & -bits).bit_length() - 1)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.merge(piece.encode("utf-8", "replace")))
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids

    def pieces(self, text: str) -> list[str]:
        return self.cut_ascii(text) if text.isascii() else self.cut(text)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.pieces(text)))) if text else []


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Encoder:
    """One encoder per worker process and vocabulary."""
    path = os.path.join(folder, f"{vocabulary}.tiktoken")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(id, ids): every row once, in no order; no shuffle.  Repeated texts are encoded like any other."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        tool = encoder(vocabulary, folder)
        get, pieces = tool.__getitem__, tool.pieces
        for batch in batches:
            at = 0
            texts = batch.column(1).to_pylist()
            while at < len(texts):  # a batch of very long texts goes out in parts
                flat, ends, size, begin = array("i"), [0], 0, at
                while at < len(texts) and size < 8_000_000:
                    if text := texts[at]:
                        flat.extend(chain.from_iterable(map(get, pieces(text))))
                        size += len(text)
                    ends.append(len(flat))
                    at += 1
                lists = pa.ListArray.from_arrays(pa.array(np.asarray(ends, "i4")), pa.array(np.asarray(flat, "i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, at - begin), lists], names=["id", "ids"])

    plain = spread(documents.select(documents[id_column].cast("bigint").alias("id"), documents[text_column].alias("text")))
    return plain.mapInArrow(run, "id bigint, ids array<int>").withColumnRenamed("id", id_column)


def count_tokens(documents: DataFrame, keep: list[str], text_column: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """The ``keep`` columns and n_tokens of every row; only the numbers leave the workers."""
    kept = spread(documents.select(*keep, documents[text_column].alias("_text")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tool = encoder(vocabulary, folder)
        get, pieces = tool.__getitem__, tool.pieces
        for batch in batches:
            k = batch.num_columns - 1
            n = [sum(map(len, map(get, pieces(t)))) if t else 0 for t in batch.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{fields}, n_tokens bigint")
