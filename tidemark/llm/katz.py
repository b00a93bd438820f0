"""Language-model scores by Katz backoff over words, of any order.

P(w | h) is the Good-Turing discounted relative frequency of the n-gram h w where training has it,
and backoff(h) * P(w | h without its first word) elsewhere. At the end of that recursion P(w) is the
discounted relative frequency of the word, and what the discount frees goes to the one class of
unknown words. backoff(h) is what the discount of h's n-grams frees, divided by the lower order's
P of all words not seen after h, so each distribution adds up to 1.

Counts lie in one table for each order, cut by hash of the word or of the history. A slice of the
corpus (the texts of one batch) asks each table about its distinct words, then order by order about
its distinct n-grams, and scores its texts from the answers. Only distinct words and n-grams of a
slice move, as sorted, packed arrays; the slices themselves lie in a table bucketed by slice and
never move.

``train`` keeps the tables: one row to a part, in the form in which slices ask, so that a stored part
joins the questions of later texts like one more slice (``score_with``).
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import arrays, shared

#: Counts up to this are discounted.
CUTOFF = 5
#: Words of the longest n-gram.
ORDER = 3
#: Bytes of text of a slice.
SLICE_BYTES = 4 << 20

#: Stands for the end of a text as a token.
END = np.uint64(0x51ED270B7F4A7C15)
#: Stands before a text's first word; words have larger numbers.
START = 0
#: Units of a probability in an answer.
_UNIT = 2.0**40


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as bytes, plane by plane, compressed; small ones take few bytes."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype(np.uint8) if width == 1 else np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(values).to_bytes(5, "little") + bytes([width]) + (pa.compress(planes, "zstd", asbytes=True) if len(values) else b"")


def unpack(data: bytes) -> np.ndarray:
    """The integers of :func:`pack`, as unsigned 64-bit numbers."""
    n, width = int.from_bytes(data[:5], "little"), data[5]
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(data[6:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    if width == 1:
        return planes[0].astype("<u8")
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def _signed(data: bytes) -> np.ndarray:
    """The integers of :func:`pack` below 2^63, signed."""
    return unpack(data).view(np.int64)


def discounts(count_of_counts: list[int], cutoff: int = CUTOFF) -> list[float]:
    """Factors d[r] of counts r = 0 .. cutoff (0 is not used); larger counts keep theirs.

    count_of_counts[r]: how many events occur r times, r up to cutoff + 1. Katz's factors keep the
    freed mass at n1. Where small samples make them fall outside (0, 1), the cutoff is lowered;
    where none works, half an event is taken from each count up to the cutoff.
    """
    n = count_of_counts
    for k in range(cutoff, 0, -1):
        if min(n[1 : k + 2], default=0) <= 0:
            continue
        tail = (k + 1) * n[k + 1] / n[1]
        if tail >= 1:
            continue
        d = [((r + 1) * n[r + 1] / (n[r] * r) - tail) / (1 - tail) for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return [1.0, *d, *[1.0] * (cutoff - k)]
    return [1.0, *[(r - 0.5) / r for r in range(1, cutoff + 1)]]


@dataclass(frozen=True)
class Words:
    """What is known of all words: tokens, distinct words, factors, and the mass of the unknown class."""

    tokens: int
    distinct: int
    factors: tuple[float, ...]
    unknown: float

    def probability(self, count: np.ndarray) -> np.ndarray:
        """P of words by count; of the unknown class for 0."""
        d = np.array(self.factors)[np.minimum(count, CUTOFF)]
        d[count > CUTOFF] = 1.0
        return np.where(count > 0, d * count / max(self.tokens, 1), self.unknown)


def _alike(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one of each distinct value, and which one each is, in any order. Values have their bits spread.

    Their high bits are sorted with the places below them. Where different values share those bits, all bits are.
    """
    place = np.uint64(max(len(values) - 1, 0).bit_length())
    key = np.sort((values >> place << place) | np.arange(len(values), dtype=np.uint64))
    order = (key & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
    key >>= place
    same_bits, values_there = key[1:] == key[:-1], values[order]
    new = np.ones(len(values), bool)
    new[1:] = values_there[1:] != values_there[:-1]
    if np.any(new[1:] & same_bits):
        return np.unique(values, return_index=True, return_inverse=True)[1:]
    which = np.empty(len(values), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def _same_words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, other: np.ndarray) -> bool:
    """Whether words of eight bytes or more are those of the same lengths at ``other``: by the first and last eight bytes, and by all of those beyond sixteen."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    if not (np.array_equal(eight[starts], eight[other]) and np.array_equal(eight[starts + lengths - 8], eight[other + lengths - 8])):
        return False
    more = lengths > 16
    return arrays.same_spans(data, starts[more], lengths[more], other[more])


def _vocabulary(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words of texts and of their end, which one each token is, and tokens by text. Hashes are those of ``arrays.span_hash``."""
    data = arrays.lower(data)
    starts, ends, first = arrays.words(data, offsets)
    size = np.diff(first) + 1
    lengths = np.append(ends - starts, 0)  # the last one stands for the end of a text
    starts = np.append(starts, 0)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    short = np.minimum(lengths, 7)
    # the number of bytes and, of up to seven, they themselves: no longer word has such a code, and no word that of an end
    code = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))[starts] & ((np.uint64(1) << (8 * short).astype(np.uint64)) - np.uint64(1))
    code |= short.astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(lengths > 7)
    if len(long):
        key = arrays._span_key(data, starts[long], starts[long] + lengths[long])
        code[long] = np.where(key < np.uint64(8 << 56), key | np.uint64(8 << 56), key)
    first, which = _alike(arrays.mix(code))
    other = first[which[long]]
    if len(long) and not (np.array_equal(lengths[other], lengths[long]) and _same_words(data, starts[long], lengths[long], starts[other])):
        # words were made to share a key, so their bytes decide
        code[long] = np.uint64(8 << 56) + arrays.distinct_spans(data, starts[long], lengths[long])[1].astype(np.uint64)
        first, which = _alike(arrays.mix(code))
    hashes = code[first]
    long = np.flatnonzero(lengths[first] > 7)
    long_first, raw = first[long], data.tobytes()
    digests = [hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(starts[long_first].tolist(), (starts + lengths)[long_first].tolist(), strict=True)]
    digest = np.frombuffer(b"".join(digests), "<u8")
    hashes[long] = np.where(digest < np.uint64(8 << 56), digest | np.uint64(8 << 56), digest)
    hashes = arrays.mix(hashes)
    hashes[which[-1]] = END
    if len(hashes) > 1 and np.any(np.diff(np.sort(hashes)) == 0):
        hashes, same = np.unique(hashes, return_inverse=True)
        which = same[which]
    return hashes, np.insert(which[:-1], np.cumsum(size - 1), which[-1]), size


def _slices(docs: DataFrame) -> DataFrame:
    """One row to a slice: its distinct words and its texts as numbers of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for start, end, data, offsets in arrays.blocks(batch.column(2), SLICE_BYTES):
                vocabulary, tokens, size = _vocabulary(data, offsets)
                often, order = np.bincount(tokens, minlength=len(vocabulary)), np.argsort(vocabulary)
                order = order[_ordered(often.max() - often[order])[0]]  # small numbers for most tokens
                rank = np.empty_like(order)
                rank[order] = np.arange(len(order))
                vocabulary, tokens = vocabulary[order], rank[tokens]
                trained = np.bincount(tokens[np.flatnonzero(np.repeat(~held[start:end], size))], minlength=len(vocabulary))
                ids = batch.column(0).slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.array([ids.to_pylist()], pa.list_(pa.int64())),
                        pa.array([held[start:end].tolist()], pa.list_(pa.bool_())),
                        pa.array([pack(size)], pa.binary()),
                        pa.array([pack(tokens)], pa.binary()),
                        pa.array([pack(vocabulary)], pa.binary()),
                        pa.array([pack(trained)], pa.binary()),
                    ],
                    ["slice", "ids", "held", "sizes", "tokens", "words", "trained"],
                )
                number += 1

    return docs.mapInArrow(arrays.lean(run), "slice long, ids array<long>, held array<boolean>, sizes binary, tokens binary, words binary, trained binary")


def _cut(values: np.ndarray, parts: int) -> tuple[np.ndarray, list[int]]:
    """An order that brings the values of each part together, and where each part starts."""
    part = (values % parts).astype(np.min_scalar_type(int(parts)))  # few bits are sorted by radix
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1)).tolist()


def _ask_words(slices: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, trained = unpack(batch.column(1)[i].as_py()), unpack(batch.column(2)[i].as_py())
                order, at = _cut(words, np.uint64(parts))
                rows = [(p, pack(words[order[at[p] : at[p + 1]]]), pack(trained[order[at[p] : at[p + 1]]])) for p in range(parts) if at[p] < at[p + 1]]
                part, asked, count = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([batch.column(0)[i].as_py()] * len(part), pa.int64()), pa.array(asked, pa.binary()), pa.array(count, pa.binary())], ["part", "slice", "words", "trained"])

    return slices.select("slice", "words", "trained").mapInArrow(arrays.lean(run), "part int, slice long, words binary, trained binary")


_TALLIES = ["events", "distinct", *(f"n{r}" for r in range(1, CUTOFF + 2))]


def _tally(counts: np.ndarray) -> list[int]:
    """Sum, number above 0, and how many are 1 .. cutoff + 1."""
    return [int(counts.sum()), int((counts > 0).sum()), *np.bincount(np.minimum(counts, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2].tolist()]


#: Stands for a slice in a row that holds a part's table.
_TABLE = -1


def _kept(names: list[str], rows: dict) -> bytes:
    """Columns of a table as bytes."""
    batch = pa.RecordBatch.from_pylist([rows], pa.schema([(n, pa.list_(pa.binary()) if n == "heads" else pa.binary()) for n in names]))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _count_words(asked: DataFrame, parts: int, keep: bool) -> DataFrame:
    """Each part's table of words, answered to the slices: count and number of each word asked for.

    A word's number is its place in its part, from 1 on and frequent words first, times the parts,
    plus the part: unique, dense, and short for most tokens. Words of a stored table, which come in
    that order, keep their places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        for part in sorted({r["part"] for r in rows}):
            own = [r for r in rows if r["part"] == part]
            words = [unpack(r["words"]) for r in own]
            table, which = np.unique(np.concatenate(words), return_inverse=True)
            count = np.zeros(len(table), np.int64)
            np.add.at(count, which, np.concatenate([_signed(r["trained"]) for r in own]))
            at = np.cumsum([0] + [len(w) for w in words])
            place = np.full(len(table), len(table))
            for i in (i for i, r in enumerate(own) if r["slice"] == _TABLE):
                place[which[at[i] : at[i + 1]]] = np.arange(len(words[i]))
            order = np.lexsort((-count, place))
            number = np.empty(len(table), np.int64)
            number[order] = np.arange(1, len(table) + 1) * parts + part
            nothing = dict.fromkeys(_TALLIES, 0) | {"table": None}
            if keep:
                known = order[count[order] > 0]
                yield pa.RecordBatch.from_pylist([nothing | {"slice": _TABLE, "part": part, "counts": b"", "numbers": b"", "table": _kept(["words", "trained"], {"words": pack(table[known]), "trained": pack(count[known])})}], _answer(["counts", "numbers"]))
            for i, r in enumerate(own):
                mine = which[at[i] : at[i + 1]]
                tally = dict(zip(_TALLIES, _tally(count), strict=True)) if i == 0 else {}
                if r["slice"] != _TABLE:
                    yield pa.RecordBatch.from_pylist([nothing | {"slice": r["slice"], "part": part, "counts": pack(count[mine]), "numbers": pack(number[mine])} | tally], _answer(["counts", "numbers"]))

    return asked.repartitionById(parts, F.col("part")).mapInArrow(arrays.lean(run), "slice long, part int, counts binary, numbers binary, table binary, " + ", ".join(f"{t} long" for t in _TALLIES))


def _answer(columns: list[str]) -> pa.Schema:
    return pa.schema([("slice", pa.int64()), ("part", pa.int32()), *((c, pa.binary()) for c in columns), ("table", pa.binary()), *((t, pa.int64()) for t in _TALLIES)])


def _together(answers: DataFrame, columns: list[str], name: str, path: str | None = None) -> DataFrame:
    """All answers to a slice in one row, in a table bucketed by slice; they are as many as the slice's words or n-grams.

    The parts' answers lie in a table of their own in between, so that what was asked is gone from
    the disks when they are put together. With a path, the parts' tables are kept there.
    """
    parts = shared.partitions(answers.sparkSession)
    tallies = [F.sum(t).alias(t) for t in _TALLIES]
    with shared.passing(answers, f"{name}-parts") as held:
        if path:
            held.where(F.col("slice") == _TABLE).select("part", "table").write.parquet(f"{path}/{name}")
        rows = held.where(F.col("slice") != _TABLE).repartition(parts, "slice").groupBy("slice").agg(F.collect_list(F.struct("part", *columns)).alias(name), *tallies)
        return shared.spread(rows, name, "slice")


def _known(words: np.ndarray, answers: list[dict], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and number of each of a slice's words, from its answers."""
    order, at = _cut(words, np.uint64(parts))
    count, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    for a in answers:
        own = order[at[a["part"]] : at[a["part"] + 1]]
        count[own], number[own] = _signed(a["counts"]), _signed(a["numbers"])
    return count, number


def _after(values: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    """For each token the value of the one before it; the given one at the beginning of a text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[np.cumsum(sizes) - sizes] = start
    return out


def _width(column: np.ndarray) -> int:
    """Bits of the largest."""
    return int(column.max()).bit_length() if len(column) else 0


def _numbered(new: np.ndarray) -> np.ndarray:
    """Numbers from 0 on of groups of rows, by which rows begin one; the first does."""
    out = np.cumsum(new)
    out -= 1
    return out


def _ordered(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' numbers in the order of columns of non-negative integers, equal rows as they stand, and which rows differ from the one before.

    The columns are put together to one key, with the rows' numbers in its low bits: sorting that is much
    faster than sorting the rows' numbers by keys. Columns that are too wide for it stand in it by their ranks.
    """
    n = len(columns[0])
    place = max(n - 1, 0).bit_length()
    key, width = columns[0].astype(np.uint64), _width(columns[0])
    for column in columns[1:]:
        more = _width(column)
        if width + more + place > 64 and width > place:
            key = _distinct(key)[1].view(np.uint64)
            width = _width(key)
        if width + more + place > 64 and more > place:
            column = _distinct(column)[1]
            more = _width(column)
        if width + more > 64:
            key = None
            break
        key <<= np.uint64(more)
        key |= column.view(np.uint64)
        width += more
    new = np.ones(n, bool)
    if key is None:
        order = np.lexsort(columns[::-1])
        new[1:] = False
        for c in columns:
            new[1:] |= np.diff(c[order]) != 0
    else:
        if width + place <= 64:
            key <<= np.uint64(place)
            key |= np.arange(n, dtype=np.uint64)
            key.sort()
            order = (key & np.uint64((1 << place) - 1)).view(np.int64)
            key >>= np.uint64(place)
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        new[1:] = key[1:] != key[:-1]
    return order, new


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct combination of non-negative integers, ordered by the columns, and which one each row is."""
    order, new = _ordered(*columns)
    which = np.empty(len(order), np.int64)
    which[order] = _numbered(new)
    return order[np.flatnonzero(new)], which


_HISTORY = ["kind", "kinds", "seen"]


def _kinds(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of columns, those with a small first column first, and which one each row is."""
    small = columns[0] < 128
    which, rows, known = np.empty(len(small), np.int64), [], 0
    for own in (np.flatnonzero(small), np.flatnonzero(~small)):
        if len(own):
            first, kind = _distinct(*(c[own] for c in columns))
            rows.append(np.stack([c[own[first]] for c in columns], axis=1))
            which[own] = kind + known
            known += len(first)
    return np.concatenate(rows), which


def _only(rows: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are pointed at, and which of these each is."""
    there = np.zeros(len(rows), bool)
    there[which] = True
    return rows[there], (np.cumsum(there) - 1)[which]


@dataclass(frozen=True)
class Grams:
    """A slice's distinct n-grams of one order, by part, history and word; a history's stand together."""

    first: np.ndarray  # a token that ends each
    which: np.ndarray  # the one that each token ends
    group: np.ndarray  # the history of each
    begin: np.ndarray  # where each history begins
    history: np.ndarray  # which of those that may be asked for each is
    of_any: list[np.ndarray]  # the words of those, by number
    shares: list[tuple[int, slice, slice]]  # part, its n-grams, its histories

    @classmethod
    def of(cls, ends: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, heads: list[np.ndarray], parts: int) -> Grams:
        """ends: which history of the next token each token ends; heads: the words of those histories, by number."""
        heads = [np.append(START, h) for h in heads]  # before the first word
        part = np.empty(len(heads[0]), np.int64)
        for at in range(0, len(part), 1 << 13):  # what fits the cache
            block = slice(at, at + (1 << 13))
            mixed = np.uint64(0)
            for h in heads:
                mixed = arrays.mix(h[block].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) + mixed)
            part[block] = mixed % np.uint64(parts)
        order = _ordered(part, *heads[:-1])[0]
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        context = _after(place[1:][ends], sizes, place[0])
        first, which = _distinct(context, tokens)
        context = context[first]
        new = np.ones(len(first), bool)
        new[1:] = context[1:] != context[:-1]
        begin = np.flatnonzero(new)
        history = order[context[begin]]
        at = np.searchsorted(part[history], np.arange(parts + 1))
        edge = np.append(begin, len(first))[at].tolist()
        at = at.tolist()
        shares = [(p, slice(edge[p], edge[p + 1]), slice(at[p], at[p + 1])) for p in range(parts) if at[p] < at[p + 1]]
        return cls(first, which, _numbered(new), begin, history, heads, shares)

    def heads(self) -> list[np.ndarray]:
        """The words of each history, by number."""
        return [h[self.history] for h in self.of_any]


@dataclass(frozen=True)
class Tokens:
    """A slice, with what the answers so far say of its words and of its n-grams of the highest order that has been answered."""

    sizes: np.ndarray
    word: np.ndarray  # which word each token is, by ascending number
    number: np.ndarray
    word_count: np.ndarray
    which: np.ndarray  # which n-gram each token ends
    count: np.ndarray  # of each n-gram
    whole: np.ndarray  # what that count is divided by
    p: np.ndarray | None  # by that order, if texts are to be scored
    last: Grams | None  # those n-grams, if they are of two words or more

    @classmethod
    def of(cls, row: dict, parts: int, words: Words, factors: list[list[float]], scored: bool) -> Tokens:
        """factors: of the orders from 2 on that have been answered, in columns order2, order3 .."""
        sizes, tokens = _signed(row["sizes"]), _signed(row["tokens"])
        count, number = _known(unpack(row["words"]), row["known"], parts)
        first, place = _distinct(number)
        number, count, tokens = number[first], count[first], place[tokens]
        out = cls(sizes, tokens, number, count, tokens, count, np.full(len(count), max(words.tokens, 1), np.int64), words.probability(count) if scored else None, None)
        for order, d in enumerate(factors, 2):
            out = out._backed_off(out.grams(parts), row[f"order{order}"], np.array(d))
        return out

    def grams(self, parts: int) -> Grams:
        """Of the next order."""
        heads = [self.number] if self.last is None else [*(h[self.last.group] for h in self.last.heads()), self.number[self.word[self.last.first]]]
        return Grams.of(self.which, self.sizes, self.word, heads, parts)

    def _backed_off(self, grams: Grams, answers: list[dict], factors: np.ndarray) -> Tokens:
        """By the next order, from its answers and the P of this one."""
        by_part = {a["part"]: a for a in answers}
        own = [by_part[part] for part, _, _ in grams.shares]
        tables = [_signed(a["kinds"]).reshape(-1, CUTOFF + 1) for a in own]
        known = np.cumsum([0] + [len(t) for t in tables])
        kind = np.concatenate([_signed(a["kind"]) + k for a, k in zip(own, known.tolist(), strict=False)])
        totals, *once = np.concatenate(tables).T
        kept = totals - sum(r * once[r - 1] for r in range(1, CUTOFF + 1)) + sum(factors[r] * r * once[r - 1] for r in range(1, CUTOFF + 1))
        count, whole, p = np.concatenate([_signed(a["counts"]) for a in own]), divisor(totals, kept)[kind][grams.group], None
        if self.p is not None:
            backoff = backoffs(totals, np.concatenate([_signed(a["seen"]) for a in own]) / _UNIT, kept, kind)
            p = discounted(count, factors) / whole
            lacking = np.flatnonzero(count == 0)
            # tokens that end the same n-gram have the same P of the order below
            p[lacking] = backoff[grams.group[lacking]] * self.p[self.which[grams.first[lacking]]]
        return replace(self, which=grams.which, count=count, whole=whole, p=p, last=grams)


def _sorted(values: np.ndarray) -> np.ndarray:
    """The distinct ones, in order."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])]


def _ask_grams(slices: DataFrame, order: int, parts: int, words: Words, factors: list[list[float]]) -> DataFrame:
    """Ask for each distinct n-gram of a slice.

    By part: the histories' words and how many words follow each; those words and training counts;
    and what P of the lower order follows from. For pairs that is each distinct word's count. Beyond,
    the lower order has all that training has here, so it is the n-gram's count without its first
    word, and for each distinct history without its first word what such counts are divided by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                tokens = Tokens.of(row, parts, words, factors, False)
                grams = tokens.grams(parts)
                grams_heads = grams.heads()
                trained = np.bincount(grams.which[np.flatnonzero(np.repeat(~np.array(row["held"], bool), tokens.sizes))], minlength=len(grams.first))
                word = tokens.word[grams.first]
                number, below = tokens.number[word], tokens.which[grams.first]  # the n-gram without its first word
                follow = np.diff(np.append(grams.begin, len(grams.first)))
                for part, own, histories in grams.shares:
                    heads = [h[histories] for h in grams_heads]
                    if order == 2:
                        lower, whole = tokens.word_count[_sorted(word[own])], np.zeros(0, np.int64)
                    else:
                        lower, whole = tokens.count[below[own]], tokens.whole[below[grams.begin[histories][_distinct(*heads[1:])[0]]]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part], pa.int32()),
                            pa.array([row["slice"]], pa.int64()),
                            pa.array([[pack(h) for h in heads]], pa.list_(pa.binary())),
                            *(pa.array([pack(x)], pa.binary()) for x in (follow[histories], number[own], trained[own], lower, whole)),
                        ],
                        ["part", "slice", "heads", "follow", "words", "trained", "lower", "whole"],
                    )

    return slices.drop("ids").mapInArrow(arrays.lean(run), "part int, slice long, heads array<binary>, follow binary, words binary, trained binary, lower binary, whole binary")


def _count_grams(asked: DataFrame, order: int, parts: int, words: Words, factors: list[list[float]], keep: bool) -> DataFrame:
    """Each part's table of n-grams, answered to the slices.

    For each n-gram its count; for each history its count, how many n-grams of it occur 1 .. cutoff
    times and, where a slice asks for one that training lacks, the lower order's P of all words
    seen after it (in units). Most histories have the numbers of many others, so they come as kinds,
    with a table of these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        for part in sorted({r["part"] for r in rows}):
            own = [r for r in rows if r["part"] == part]
            # each column is unpacked where it is needed and goes when it is not
            follow, word = ([_signed(r[c]) for r in own] for c in ("follow", "words"))
            at, head_at = np.cumsum([0] + [len(w) for w in word]), np.cumsum([0] + [len(f) for f in follow])
            follow, word = np.concatenate(follow), np.concatenate(word)
            heads = [np.concatenate([_signed(r["heads"][j]) for r in own]) for j in range(order - 1)]
            heads_first, head = _distinct(*heads)
            group = np.repeat(head, follow)
            first, which = _distinct(group, word)
            group, count = group[first], np.zeros(len(first), np.int64)
            np.add.at(count, which, np.concatenate([_signed(r["trained"]) for r in own]))
            spans, head_spans = ([slice(*x) for x in itertools.pairwise(ends.tolist())] for ends in (at, head_at))
            if order == 2:
                below_count, divided_by = np.concatenate([_signed(r["lower"])[_distinct(word[x])[1]] for r, x in zip(own, spans, strict=True)])[first], None
                below = words.probability(below_count)
            else:
                below_count = np.concatenate([_signed(r["lower"]) for r in own])[first]
                divided_by = np.concatenate([_signed(r["whole"])[_distinct(*(h[x] for h in heads[1:]))[1]] for r, x in zip(own, head_spans, strict=True)])[heads_first]
                below = discounted(below_count, np.array(factors[-1])) / divided_by[group]
            if keep:
                table = _gram_table(order, count > 0, group, [h[heads_first] for h in heads], word[first], count, below_count, divided_by)
                yield pa.RecordBatch.from_pylist([dict.fromkeys(["counts", *_HISTORY], b"") | dict.fromkeys(_TALLIES, 0) | {"slice": _TABLE, "part": part, "table": table}], _answer(["counts", *_HISTORY]))
            del heads, word, first, below_count, divided_by
            seen = np.minimum(np.rint(np.bincount(group, np.where(count > 0, below, 0.0), len(heads_first)) * _UNIT), _UNIT).astype(np.int64)
            begin = np.flatnonzero(np.diff(group, prepend=-1))
            del below
            kinds, kind = _kinds([np.add.reduceat(count, begin), *(np.bincount(group[count == r], minlength=len(begin)) for r in range(1, CUTOFF + 1))])
            del group
            for i, (r, mine) in enumerate(zip(own, head_spans, strict=True)):
                if r["slice"] == _TABLE:
                    continue
                counts, follows, mine = count[which[spans[i]]], follow[mine], head[mine]
                lacking = np.minimum.reduceat(counts, np.cumsum(follows) - follows) == 0
                tally = _tally(count) if i == 0 else [0] * len(_TALLIES)
                table, of_kind = _only(kinds, kind[mine])
                answer = {"slice": r["slice"], "part": part, "counts": pack(counts), "kind": pack(of_kind), "kinds": pack(table.ravel()), "seen": pack(seen[mine] * lacking)}
                yield pa.RecordBatch.from_pylist([answer | dict(zip(_TALLIES, tally, strict=True)) | {"table": None}], _answer(["counts", *_HISTORY]))

    columns = ", ".join(f"{c} binary" for c in ["counts", *_HISTORY, "table"])
    return asked.repartitionById(parts, F.col("part")).mapInArrow(arrays.lean(run), f"slice long, part int, {columns}, " + ", ".join(f"{t} long" for t in _TALLIES))


_ASKED = ["heads", "follow", "words", "trained", "lower", "whole"]


def _gram_table(order: int, some: np.ndarray, group: np.ndarray, heads: list[np.ndarray], word: np.ndarray, count: np.ndarray, lower: np.ndarray, divided_by: np.ndarray | None) -> bytes:
    """A part's n-grams that training has, by history and word, as a slice would ask for them."""
    group, word, count, lower = group[some], word[some], count[some], lower[some]
    new = np.ones(len(group), bool)
    new[1:] = np.diff(group) != 0
    heads = [h[group[new]] for h in heads]
    if order == 2:
        lower, whole = lower[_distinct(word)[0]], np.zeros(0, np.int64)
    else:
        whole = divided_by[group[new]][_distinct(*heads[1:])[0]]
    follow = np.diff(np.append(np.flatnonzero(new), len(group)))
    return _kept(_ASKED, {"heads": [pack(h) for h in heads]} | {c: pack(v) for c, v in zip(_ASKED[1:], (follow, word, count, lower, whole), strict=True)})


def divisor(total: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """What a history's counts are divided by: its total, and one event more where no n-gram of it is discounted."""
    return np.where(kept >= total * (1 - 1e-12), total + 1, np.maximum(total, 1))


def discounted(count: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Counts times their factors."""
    return np.append(factors, 1.0)[np.minimum(count, CUTOFF + 1)] * count


def backoffs(total: np.ndarray, seen: np.ndarray, kept: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """By what the lower order's P of words not seen after a history is multiplied, for each history.

    total, kept: by kind, the count and the discounted counts of the n-grams, added up; seen: the lower
    order's P of all words seen after it. A history that training lacks leaves that P. Where no n-gram
    of a history is discounted, one event is added to its total, so that something is left for other words.
    """
    return (1.0 - kept / divisor(total, kept))[kind] / np.maximum(1.0 - seen, 1e-12)


def _scores(slices: DataFrame, parts: int, words: Words, factors: list[list[float]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                tokens = Tokens.of(row, parts, words, factors, True)
                sizes, word, count = tokens.sizes, tokens.word, tokens.word_count
                base = np.log10((count + 0.5) / (words.tokens + 0.5 * (words.distinct + 1)))
                at = np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()),
                        pa.array(row["held"], pa.bool_()),
                        pa.array(sizes),
                        pa.array(np.add.reduceat((count > 0).astype(np.int64)[word], at)),
                        pa.array(np.full(len(sizes), words.tokens, np.int64)),
                        pa.array(np.add.reduceat(base[word], at)),
                        pa.array(np.add.reduceat(np.log10(tokens.p)[tokens.which], at)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return slices.mapInArrow(arrays.lean(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _totals(answers: DataFrame) -> list[int]:
    return [int(x or 0) for x in answers.agg(*[F.sum(t).alias(t) for t in _TALLIES]).first()]


@dataclass(frozen=True)
class Model:
    """What a stored model has beside its tables."""

    parts: int
    words: Words
    factors: tuple[tuple[float, ...], ...]


def _stored(spark: SparkSession, path: str, name: str, columns: list[str]) -> DataFrame:
    """A model's table as questions, one to a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, table in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = pa.ipc.open_stream(table.as_buffer()).read_all().combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_TABLE], pa.int64()), *own.columns], ["part", "slice", *columns])

    kinds = ", ".join(f"{c} {'array<binary>' if c == 'heads' else 'binary'}" for c in columns)
    return spark.read.parquet(f"{path}/{name}").mapInArrow(arrays.lean(run), f"part int, slice long, {kinds}")


def _learned(slices: DataFrame, order: int, parts: int, path: str | None, model: Model | None) -> tuple[DataFrame, Words, list[list[float]]]:
    """Slices with the answers of all tables, and what is known of all words and n-grams; from a stored model, or learned, and kept where a path is given."""
    spark = slices.sparkSession
    asked = _ask_words(slices, parts)
    if model:
        asked = asked.unionByName(_stored(spark, path, "known", ["words", "trained"]))
    keep = path is not None and model is None
    word_answers = _together(_count_words(asked, parts, keep), ["counts", "numbers"], "known", path if keep else None)
    if model:
        words = model.words
    else:
        tokens, distinct, *n = _totals(word_answers)
        d = discounts([0, *n])
        small = sum(r * c * (1 - d[r]) for r, c in enumerate(n[:CUTOFF], 1))
        words = Words(tokens, distinct, tuple(d), small / tokens if tokens else 1.0)
    answered = slices.drop("trained").join(word_answers.drop(*_TALLIES), "slice")

    factors: list[list[float]] = []
    for k in range(2, order + 1):
        asked = _ask_grams(answered, k, parts, words, list(factors))
        if model:
            asked = asked.unionByName(_stored(spark, path, f"order{k}", _ASKED))
        answers = _together(_count_grams(asked, k, parts, words, list(factors), keep), ["counts", *_HISTORY], f"order{k}", path if keep else None)
        factors.append(list(model.factors[k - 2]) if model else discounts([0, *_totals(answers)[2:]]))
        answered = answered.join(answers.drop(*_TALLIES), "slice")
    return answered, words, factors


def train(docs: DataFrame, path: str, order: int = ORDER) -> None:
    """Learn from all documents and keep the model at a new path that executors share: a table for each order, a row for each part.

    Odd texts and ids are as in :func:`score`; from an empty table comes a model to which every word is unknown.
    """
    if order < 1:
        raise ValueError("order: 1 or more")
    spark, parts = docs.sparkSession, shared.partitions(docs.sparkSession)
    slices = shared.spread(_slices(shared.texts(docs).select("doc_id", F.lit(False).alias("held"), "text")), "slices", "slice")
    _, words, factors = _learned(slices, order, parts, path, None)
    row = (parts, words.tokens, words.distinct, list(words.factors), words.unknown, factors)
    spark.createDataFrame([row], "parts int, tokens long, distinct long, word_factors array<double>, unknown double, factors array<array<double>>").coalesce(1).write.parquet(f"{path}/model")


def score_with(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document, by a model that :func:`train` has kept; as :func:`score` otherwise."""
    spark = docs.sparkSession
    m = spark.read.parquet(f"{path}/model").first()
    model = Model(m.parts, Words(m.tokens, m.distinct, tuple(m.word_factors), m.unknown), tuple(map(tuple, m.factors)))
    slices = shared.spread(_slices(shared.texts(docs).select("doc_id", F.lit(True).alias("held"), "text")), "slices", "slice")
    answered, words, factors = _learned(slices, len(model.factors) + 1, model.parts, path, model)
    return _scores(answered, model.parts, words, factors).drop("held_out")


def score(docs: DataFrame, folds: int = 5, held_fold: int = 1, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Learns from the documents whose crc32(doc_id as text) modulo ``folds`` is not ``held_fold``, with
    n-grams of up to ``order`` words. A null text is empty (its end is its one token); a null id is
    trained on; repeated rows count again, and ties have no order; a very long text is one row; other
    columns are not read, so their names cannot clash; with nothing to learn from every token is
    unknown; an empty table gives an empty result. Words are told apart by 64 bits of hash. The
    result reads tables in the shared folder.
    """
    if order < 1:
        raise ValueError("order: 1 or more")
    spark = docs.sparkSession
    parts = shared.partitions(spark)
    fold = F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)), F.lit(folds))
    plain = shared.texts(docs).select("doc_id", (fold == held_fold).alias("held"), "text")
    slices = shared.spread(_slices(plain), "slices", "slice")

    answered, words, factors = _learned(slices, order, parts, None, None)
    return _scores(answered, parts, words, factors)
