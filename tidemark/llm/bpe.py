"""Byte-pair merging over a whole slice of a corpus at once.

Texts are cut into pieces by character class, equal pieces become one word, and the merges run
over all distinct words together: a linked list of symbols, an inverted index from rank to the
positions of adjacent pairs of that rank, and a heap of the ranks that occur. Popping a rank
merges all its positions and touches their neighbours only.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken

from tidemark.llm import arrays

#: Bytes of text whose words are merged together.
SLICE_BYTES = 4 << 20

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point.

    Letters and numbers differ between Unicode versions. Where Python's two tables disagree, the
    tokenizer library itself is asked: a sign that stays in one piece with a letter (or a digit)
    is a letter (or a number) to it.
    """
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for found in regex.finditer(pattern, text):
            out[points[found.start() : found.end()]] = kind
    known = np.array([{"L": _LETTER, "N": _NUMBER}.get(c[0], _OTHER) for c in map(unicodedata.category, text)], np.uint8)
    doubtful = points[(out[points] != known) & (out[points] != _SPACE)]
    out[doubtful] = _OTHER
    for kind, with_sign in ((_LETTER, "a"), (_NUMBER, "1")):
        pairs = [with_sign + chr(c) for c in doubtful.tolist()]
        ranks = {bytes([b]): b for b in range(256)} | {p.encode(): 256 + i for i, p in enumerate(pairs)}
        joined = tiktoken.Encoding("classes", pat_str=r"\p{L}+|\p{N}+|[^\p{L}\p{N}]+", mergeable_ranks=ranks, special_tokens={})
        out[doubtful[[len(joined.encode_ordinary(p)) == 1 for p in pairs]]] = kind
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte at which each starts."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    point = data[starts].astype(np.uint32)
    wide = np.flatnonzero(point >= 0xC0)
    if len(wide):
        lead, at = point[wide], starts[wide]
        size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        value = lead & (np.uint32(0x7F) >> size.astype(np.uint32))
        for k in (1, 2, 3):
            more = size > k
            value[more] = (value[more] << np.uint32(6)) | (data[at[more] + k] & np.uint32(0x3F))
        point[wide] = value
    return point, starts


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte starts of the pieces that the usual byte-level pattern finds, none across rows.

    The pattern is: a contraction ('s 't 're 've 'm 'll 'd); an optional space and a run of
    letters, of numbers or of other signs; white space up to the last one before a sign; white
    space. Its matches tile the text, so the starts are all there is to find.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    point, at = code_points(data)
    kind = _classes()[point]
    n = len(point)
    row = np.zeros(n + 1, bool)
    row[np.searchsorted(at, offsets)] = True
    row[n] = True
    run = row.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    cut = run[:n].copy()
    first = np.flatnonzero(run[:n])
    end = np.append(first[1:], n)
    space = kind[first] == _SPACE
    # white space before a sign of the same row gives up its last character
    gives = space & ~row[end]
    last = end[gives] - 1
    cut[last] = True
    cut[last[point[last] == 0x20] + 1] = False
    # contractions: a lone apostrophe that starts a piece, then letters
    lone = np.flatnonzero((end - first == 1) & (point[first] == 0x27) & cut[first])
    lone = lone[lone + 1 < len(first)]
    lone = lone[(kind[first[np.minimum(lone + 1, len(first) - 1)]] == _LETTER) & ~row[end[lone]]]
    if len(lone):
        a = end[lone]
        stop = end[lone + 1]
        one = np.isin(point[a], [ord(c) for c in "stmd"])
        nxt = np.where(a + 1 < stop, point[np.minimum(a + 1, n - 1)], 0)
        two = ((nxt == ord("e")) & np.isin(point[a], [ord("r"), ord("v")])) | ((nxt == ord("l")) & (point[a] == ord("l")))
        taken = np.where(one, 1, np.where(two, 2, 0))
        some = taken > 0
        cut[a[some]] = False
        rest = (a + taken)[some]
        cut[rest[rest < stop[some]]] = True
    return at[cut]


class Words:
    """The distinct pieces of a slice, and which one each piece of each block is."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]]):
        """texts: blocks of bytes and row offsets."""
        kept, lengths, self.blocks = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], []
        for data, offsets in texts:
            starts = pieces(data, offsets)
            size = np.append(starts[1:], len(data)) - starts if len(starts) else starts
            where, which = arrays.distinct_spans(data, starts, size)
            kept.append(data[arrays.ragged(starts[where], size[where])])
            lengths.append(size[where])
            self.blocks.append((which.astype(np.int32), np.searchsorted(starts, offsets)))
        size, data = np.concatenate(lengths), np.concatenate(kept)
        start = np.cumsum(size) - size
        where, which = arrays.distinct_spans(data, start, size)
        self.lengths = size[where]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = data[arrays.ragged(start[where], self.lengths)]
        at = 0
        for i, (local, rows) in enumerate(self.blocks):
            n = len(lengths[i + 1])
            self.blocks[i] = (which[at : at + n][local].astype(np.int32), rows)
            at += n

    def __len__(self) -> int:
        return len(self.lengths)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes()


class Merges:
    """Which adjacent symbols merge, in what order, into what."""

    def __init__(self, single: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray, product: np.ndarray):
        """single: the symbol of each byte; product: by rank, the symbol it makes."""
        keys = (left.astype(np.int64) << 32) | right
        order = np.argsort(keys)
        self.single, self.keys, self.ranks, self.product = single, keys[order], rank[order].astype(np.int32), product

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for none."""
        keys = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], -1).astype(np.int32)

    @functools.cached_property
    def first_ranks(self) -> np.ndarray:
        """Ranks of pairs of bytes."""
        a, b = np.divmod(np.arange(65536), 256)
        return self.lookup(self.single[a], self.single[b])

    def replay(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge all words: what symbols are left, their number by word, and the number of merges by word."""
        n = len(data)
        symbol = self.single[data].astype(np.int32)
        following = np.arange(1, n + 1, dtype=np.int32)
        previous = np.arange(-1, n - 1, dtype=np.int32)
        following[starts + lengths - 1] = -1
        previous[starts] = -1
        rank = np.full(n, -1, np.int32)
        inner = np.flatnonzero(following >= 0)
        rank[inner] = self.first_ranks[data[inner].astype(np.int32) * 256 + data[inner + 1]]
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            """File positions under their rank."""
            at = at[rank[at] >= 0]
            if not len(at):
                return
            value = rank[at]
            order = np.argsort(value, kind="stable")
            at, value = at[order], value[order]
            edge = np.flatnonzero(value[1:] != value[:-1]) + 1
            bounds = [0, *edge.tolist(), len(at)]
            for r, i, j in zip(value[[0, *edge.tolist()]].tolist(), bounds, bounds[1:], strict=False):
                if r in index:
                    index[r].append(at[i:j])
                else:
                    index[r] = [at[i:j]]
                    heapq.heappush(heap, r)

        add(inner)
        odd: list[np.ndarray] = []
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                at = np.unique(at)
                # of overlapping pairs, the leftmost and then every other one
                chained = np.zeros(len(at), bool)
                chained[1:] = following[at[:-1]] == at[1:]
                if chained.any():
                    nth = np.arange(len(at))
                    at = at[((nth - np.maximum.accumulate(np.where(chained, 0, nth))) & 1) == 0]
            gone = following[at]
            after = following[gone]
            symbol[at] = self.product[r]
            following[at] = after
            rank[gone] = -1
            symbol[gone] = -1
            has = after >= 0
            previous[after[has]] = at[has]
            before = previous[at]
            rank[at[~has]] = -1
            changed = np.unique(np.concatenate([before[before >= 0], at[has]])) if len(at) > 1 else np.concatenate([before[before >= 0], at[has]])
            if len(changed):
                new = self.lookup(symbol[changed], symbol[following[changed]])
                rank[changed] = new
                early = (new >= 0) & (new < r)
                if early.any():
                    odd.append(changed[early])
                add(changed)
        alive = symbol >= 0
        count = np.add.reduceat(alive.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
        out = symbol[alive]
        if odd:
            # a merge made a pair of a lower rank: only a strict order within the word is right
            words = np.unique(np.searchsorted(starts, np.concatenate(odd), "right") - 1)
            out, count = self._one_by_one(words, data, starts, lengths, out, count)
        return out, count, lengths - count

    def _one_by_one(self, words, data, starts, lengths, out, count):
        """Those words again, always the leftmost pair of the lowest rank."""
        table = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        at = np.cumsum(count) - count
        parts, last, count = [], 0, count.copy()
        for w in words.tolist():
            line = self.single[data[starts[w] : starts[w] + lengths[w]]].tolist()
            while len(line) > 1:
                best, i = min((table.get((a << 32) | b, 1 << 40), i) for i, (a, b) in enumerate(zip(line, line[1:], strict=False)))
                if best == 1 << 40:
                    break
                line[i : i + 2] = [int(self.product[best])]
            parts += [out[last : at[w]], np.array(line, np.int32)]
            last = at[w] + count[w]
            count[w] = len(line)
        return np.concatenate([*parts, out[last:]]), count


@functools.cache
def rank_file(path: str) -> tuple[dict[bytes, int], Merges]:
    """A file of base64 byte strings and ranks: two symbols merge if their bytes together have a rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}
    triples = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    left, right, rank = np.array(triples, np.int64).T
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    return ranks, Merges(single, left, right, rank, np.arange(max(ranks.values()) + 1, dtype=np.int32))


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in byte-level vocabulary files, by sign.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, are the code
    points from 256 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def merge_file(path: str) -> tuple[list[bytes], Merges]:
    """A byte-level tokenizer in JSON: its special strings, and exactly the pairs that it lists."""
    with open(path, encoding="utf-8") as source:
        whole = json.load(source)
    vocabulary = whole["model"]["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in whole["model"]["merges"]]
    left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
    right = np.array([vocabulary[b] for _, b in pairs], np.int64)
    product = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
    single = np.zeros(256, np.int32)
    for sign, byte in byte_signs().items():
        single[byte] = vocabulary[sign]
    return [t["content"].encode() for t in whole["added_tokens"]], Merges(single, left, right, np.arange(len(pairs)), product)


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
    """Runs of rows of about ``limit`` bytes of text, with their texts in blocks."""
    for batch in batches:
        for start, end, data, offsets in arrays.blocks(batch.column(column), limit):
            text = batch.column(column).slice(start, end - start)
            yield batch.slice(start, end - start), [(d, o) for _, _, d, o in arrays.blocks(text)]
