"""Token counts by heap-and-linked-list merging: initial symbols minus merges, no ids."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import arrays, bpe, shared


def split_special(data: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut rows around special strings, leftmost first, the longer of two that start together.

    Returns the offsets of the parts, which parts are special strings, and where each row's parts start.
    """
    found, raw = [], data.tobytes()
    for s in special:
        at = raw.find(s)
        while at >= 0:
            found.append((at, -len(s)))
            at = raw.find(s, at + 1)
    spans, end = [], 0
    for at, size in sorted(found):
        row = int(np.searchsorted(offsets, at, "right")) - 1
        if at >= end and at - size <= offsets[row + 1]:
            spans.append((at, at - size))
            end = at - size
    cuts = np.array(spans, np.int64).reshape(-1, 2)
    parts = np.sort(np.concatenate([offsets, cuts.ravel()]), kind="stable")
    is_special = np.zeros(len(parts) - 1, bool)
    if len(cuts):
        # of equal offsets, the last one before a longer part begins it
        starts = np.searchsorted(parts, cuts[:, 0], "right") - 1
        is_special[starts] = True
    return parts, is_special, np.searchsorted(parts, offsets, "left")


class Counter:
    """Token counts of words, by merging with a heap of adjacent pairs over a linked list of symbols."""

    #: Words whose counts are kept for later slices of the same worker.
    KEPT = 1 << 18

    def __init__(self, merges: bpe.Merges):
        self.single = merges.single.tolist()
        self.pairs = dict(zip(merges.keys.tolist(), zip(merges.ranks.tolist(), merges.product[merges.ranks].tolist(), strict=True), strict=True))
        self.known: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Initial symbols minus merges, always of the lowest rank, leftmost first."""
        n = len(word)
        if n < 2:
            return n
        pairs, symbol = self.pairs, [self.single[b] for b in word]
        following = [*range(1, n), -1]
        previous = [*range(-1, n - 1)]
        heap = []
        for i in range(n - 1):
            found = pairs.get((symbol[i] << 32) | symbol[i + 1])
            if found is not None:
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i, product = heapq.heappop(heap)
            j = following[i]
            # a pair is out of date where one of its symbols has merged since
            if j < 0 or symbol[i] < 0:
                continue
            found = pairs.get((symbol[i] << 32) | symbol[j])
            if found is None or found[0] != rank:
                continue
            left -= 1
            symbol[i], symbol[j] = product, -1
            k = following[i] = following[j]
            if k >= 0:
                previous[k] = i
                found = pairs.get((product << 32) | symbol[k])
                if found is not None:
                    heapq.heappush(heap, (found[0], i, found[1]))
            h = previous[i]
            if h >= 0:
                found = pairs.get((symbol[h] << 32) | product)
                if found is not None:
                    heapq.heappush(heap, (found[0], h, found[1]))
        return left

    def counts(self, words: bpe.Words) -> np.ndarray:
        """Of all distinct words; those of earlier slices are remembered, up to a bound."""
        if len(self.known) > self.KEPT:
            self.known.clear()
        known, data, out = self.known, words.data.tobytes(), []
        for a, n in zip(words.starts.tolist(), words.lengths.tolist(), strict=True):
            word = data[a : a + n]
            count = known.get(word)
            if count is None:
                count = self.count(word)
                if n <= 64:
                    known[word] = count
            out.append(count)
        return np.array(out, np.int64)


@functools.cache
def counter(path: str) -> tuple[list[bytes], Counter]:
    """The special strings of a vocabulary file, and the counter of its merges."""
    special, merges = bpe.merge_file(path)
    return special, Counter(merges)


def count_texts(texts: list[tuple[np.ndarray, np.ndarray]], path: str) -> Iterator[np.ndarray]:
    """For each block of texts the token count of each row; a special string is one token."""
    special, of_words = counter(path)
    cut = [(data, *split_special(data, offsets, special)) for data, offsets in texts]
    words = bpe.Words([(data, parts) for data, parts, _, _ in cut])
    left = of_words.counts(words)
    for (which, bounds), (_, parts, is_special, first), (_, offsets) in zip(words.blocks, cut, texts, strict=True):
        total = np.zeros(len(which) + 1, np.int64)
        np.cumsum(left[which], out=total[1:])
        by_part = np.where(is_special, 1, np.diff(total[bounds]))
        upto = np.zeros(len(by_part) + 1, np.int64)
        np.cumsum(by_part, out=upto[1:])
        # empty parts count nothing, so equal offsets do no harm
        yield upto[first[1:]] - upto[first[:-1]]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document: a map without shuffle.

    A null text is empty and has no tokens; repeated rows count alike; of equal ranks the leftmost
    pair merges first. Other columns are not read, so
    their names cannot clash. A very long text is one row, handled alone. An empty table
    gives an empty result. The vocabulary file must be at ``path`` on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in bpe.slices(batches, 1):
            counts = np.concatenate([*count_texts(texts, path), np.zeros(0, np.int64)])
            size = np.concatenate([*(np.diff(o) for _, o in texts), np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return shared.texts(docs).mapInArrow(arrays.lean(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
