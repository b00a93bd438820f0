"""Suffix-array dedup of byte substrings that occur twice anywhere in a corpus.

A distributed merge sort of suffixes, made sparse so that it moves a part of the text only. In any
string of ``short`` bytes the smallest hash of its ``GRAM``-byte grams, leftmost first, marks an
anchor that depends on the string alone, so equal strings have their anchors at equal offsets.
Only anchors whose gram occurs twice go on. Each task sorts the suffixes at its anchors, with what
stands before them, into front-coded runs; runs are exchanged by gram and combined with loser
trees that keep the common prefix with the last winner and so never compare known prefixes again.
The merged order with its common prefixes says how far any two suffixes agree to the right; what
stands before them is compared likewise to the left. Texts that occur as a whole more than once
are one text here, and every byte of theirs is covered.

A stretch that repeats itself needs its ends only. Suffixes that agree in all their bytes, before and after, are repeated everywhere; one of them goes
on for all. A gram that very many suffixes share is cut by what stands around it: strings that
begin between ``low`` and ``high`` bytes before the gram hold the ``low`` bytes before it and the
first ``span - high`` from it, so only suffixes that agree in those need to meet. Where still too
many do, the range of distances is cut; at one distance the string itself is the key, and all that
share it are repeated. So no task gets more than ``HOT`` different suffixes of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import arrays, shared

#: Bytes of a gram, about half of the shortest length sought.
GRAM = 128
#: Strings of this many bytes are reported, too: about fifty words.
SHORT = 256
#: Groups of more suffixes than this are resolved class by class, not pair by pair.
PAIRWISE = 48
#: Groups of more suffixes than this are cut before they meet in a task.
HOT = 4096
#: A range of distances in which too many suffixes meet is cut into so many.
PIECES = 4
#: Bytes of a key before its suffix: the group, which span it is about (0: both), least and greatest distance.
_HEAD = 8 + 1 + 2 + 2
#: Entries of a run that are Python objects at a time.
_CHUNK = 256

_POSITION = 23
_RANK = np.uint64(((1 << 64) - 1) ^ ((1 << _POSITION) - 1))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(pow(base, have, 1 << 64))
        have += take
    return out


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram at each position, from running sums. Grams that share one only meet: their bytes decide."""
    n, step = len(data) - gram + 1, 1 << 20
    out = np.empty(n, np.uint64)
    for start in range(0, n, step):
        part = data[start : start + step + gram - 1]
        up, down = _Table.upto(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        have = len(part) - gram + 1
        out[start : start + have] = arrays.mix((sums[gram:] - sums[:have]) * down[:have])
    return out


class _Table:
    """Powers of a base and of its inverse."""

    base = 0x9E3779B97F4A7C15
    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(cls.base, n), _powers(pow(cls.base, -1, 1 << 64), n)
        return cls.up, cls.down


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all windows of ``length`` bytes inside rows, and their gram hashes."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = _gram_hashes(data, gram)
    found = np.zeros(n, bool)
    step = 1 << (_POSITION - 1)
    width = length - gram + 1
    valid = np.zeros(len(data) + 1, np.int32)  # windows that end inside the row they start in
    long = np.diff(offsets) >= length
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - length + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    for start in range(0, n, step):
        part = hashes[start : start + step + width - 1]
        low = (part & _RANK) | np.arange(len(part), dtype=np.uint64)
        have = 1
        while have < width:  # minima of windows, by doubling
            more = min(have, width - have)
            low = np.minimum(low[: len(low) - more], low[more:])
            have += more
        use = valid[start : start + min(len(low), step)]
        found[start + (low[: len(use)][use] & ~_RANK).astype(np.int64)] = True
    spots = np.flatnonzero(found)
    return spots, hashes[spots]


def thinned(data: np.ndarray, spots: np.ndarray, hashes: np.ndarray, row: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Which anchors are needed, and (anchor, start, stop) of stretches that repeat themselves.

    Where a gram comes again and again at one distance, the bytes have that period, and every
    string inside the stretch starts there twice. Needed are the first anchor, for strings that
    begin before it, the second, to stand for the inner ones elsewhere, and those from which a
    string of ``length`` bytes may reach beyond the end.
    """
    keep, found = np.ones(len(spots), bool), []
    if len(spots) < 4:
        return keep, found
    gap = np.diff(spots)
    linked = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1]) & (gap <= gram)
    new = np.ones(len(gap), bool)
    new[1:] = ~linked[:-1] | ~linked[1:] | (gap[1:] != gap[:-1])
    first = np.flatnonzero(new & linked)
    edges = np.append(np.flatnonzero(new), len(gap))
    last = edges[np.searchsorted(edges, first, "right")]
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        period, start, stop = int(gap[a]), int(spots[a]), int(spots[b]) + gram
        if b - a > 3 and stop - start >= length + period and np.array_equal(data[start : stop - period], data[start + period : stop]):
            keep[a + 2 : a + np.searchsorted(spots[a : b + 1], spots[b] - (length - gram) - period)] = False
            found.append((a, start, stop))
    return keep, found


def common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    end = min(len(a), len(b))
    step = 16
    while start < end:
        stop = min(start + step, end)
        if a[start:stop] == b[start:stop]:
            start = stop
            step *= 4
        elif step <= 16:
            while a[start] == b[start]:
                start += 1
            return start
        else:
            step = max(16, step // 8)
    return end


def merge_runs(runs: list[Iterator[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """Merge front-coded runs: (common prefix with the one before, rest of the key, payload), sorted.

    Yields the same with whole keys. Each node of the tree holds the loser of its match: its key,
    and its common prefix with the winner that passed there.
    """
    width = max(1, len(runs))

    def advance(run: int, key: bytes) -> tuple | None:
        entry = next(runs[run], None)
        return None if entry is None else (entry[0], key[: entry[0]] + entry[1], entry[2], run)

    def play(a: tuple | None, b: tuple | None) -> tuple[tuple | None, tuple | None]:
        """Winner and loser; both know their common prefix with the last winner overall."""
        if a is None or b is None:
            return (b, a) if a is None else (a, b)
        if a[0] != b[0]:
            return (a, b) if a[0] > b[0] else (b, a)
        same = common(a[1], b[1], a[0])
        if a[1][same : same + 1] < b[1][same : same + 1] or (same == len(a[1]) == len(b[1]) and a[3] < b[3]):
            return a, (same, *b[1:])
        return b, (same, *a[1:])

    losers: list[tuple | None] = [None] * width

    def build(node: int) -> tuple | None:
        if node >= width:
            return advance(node - width, b"") if node - width < len(runs) else None
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    top = build(1) if width > 1 else (advance(0, b"") if runs else None)
    while top is not None:
        yield top[0], top[1], top[2]
        run = top[3]
        top = advance(run, top[1])
        node = (run + width) // 2
        while node >= 1 and width > 1:
            top, losers[node] = play(top, losers[node])
            node //= 2


def repeated_offsets(right: list[int], before: list[bytes], length: int, low: int, high: int) -> list[list[tuple[int, int]]]:
    """For suffixes in sorted order: how far before each one strings start that another has too.

    right[i]: common prefix of suffixes i - 1 and i. before: what stands before each, read
    backwards. Returns inclusive ranges of distances from ``low`` to ``high``.
    """
    n = len(before)
    if n <= PAIRWISE:
        out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for i in range(n):
            agree = 1 << 60
            for j in range(i + 1, n):
                agree = min(agree, right[j])
                if agree + high < length:
                    break
                first, last = max(low, length - agree), min(common(before[i], before[j], 0), high)
                if first <= last:
                    out[i].append((first, last))
                    out[j].append((first, last))
        return out
    # distance by distance: those that agree so far to the left and so far to the right
    order = np.array(sorted(range(n), key=before.__getitem__))
    left = np.zeros(n, np.int64)
    for a, b in zip(range(n - 1), range(1, n), strict=True):
        left[b] = common(before[order[a]], before[order[b]], 0)
    ahead = np.array(right, np.int64)
    ahead[0] = 0
    size = np.array([len(b) for b in before])
    hit = np.zeros((n, high - low + 1), bool)
    for distance in range(low, high + 1):
        by_right = np.cumsum(ahead < length - distance)
        by_left = np.empty(n, np.int64)
        by_left[order] = np.cumsum(left < distance)
        _, which, many = np.unique(by_right * (n + 1) + by_left, return_inverse=True, return_counts=True)
        hit[:, distance - low] = (many[which] > 1) & (size >= distance)
    return [[(a + low, b + low) for a, b in _ranges(row)] for row in hit]


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _anchor_rows(texts: DataFrame, length: int, short: int, gram: int, places: bool) -> DataFrame:
    """(h, t1, t2, pos, stop) of every anchor, equal texts of a batch once; without ``places`` (h, n) by batch.

    stop is null, or the end of a stretch from pos on that repeats itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in arrays.blocks(batch.column(2)):
                t1, t2 = (batch.column(i).slice(start, end - start).to_numpy() for i in (0, 1))
                spots, hashes = anchors(data, offsets, short, gram)
                row = np.searchsorted(offsets, spots, "right") - 1
                keep, stretches = thinned(data, spots, hashes, row, length, gram)
                first = np.zeros(len(t1), bool)
                first[np.unique(np.stack([t1, t2]), axis=1, return_index=True)[1]] = True
                use = np.flatnonzero(keep & first[row])
                hashes = hashes.astype(np.int64)
                if not places:
                    value, count = np.unique(hashes[use], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(count.astype(np.int64))], ["h", "n"])
                    continue
                again = [x for x in stretches if first[row[x[0]]]]
                at = np.concatenate([use, np.array([a for a, _, _ in again], np.int64)])
                ends = np.concatenate([np.zeros(len(use), np.int64), np.array([stop for _, _, stop in again], np.int64) - offsets[row[at[len(use) :]]]]).astype(np.int32)
                columns = [pa.array(hashes[at]), pa.array(t1[row[at]]), pa.array(t2[row[at]]), pa.array((spots[at] - offsets[row[at]]).astype(np.int32)), pa.array(ends, mask=ends == 0)]
                yield pa.RecordBatch.from_arrays(columns, ["h", "t1", "t2", "pos", "stop"])

    return texts.mapInArrow(arrays.lean(run), "h long, t1 long, t2 long, pos int, stop int" if places else "h long, n long")


_RUN = "part int, t1s array<long>, t2s array<long>, spots array<int>, befores array<binary>, prefixes array<int>, rests array<binary>"
_LISTS = ("t1s", "t2s", "spots", "befores", "prefixes", "rests")


def _head(group: int, span: int, low: int, high: int) -> bytes:
    return (group & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big") + bytes([span]) + low.to_bytes(2, "big") + high.to_bytes(2, "big")


def _coded(entries: list[tuple[int, bytes, bytes, int, int, int]]) -> pa.RecordBatch:
    """One sorted front-coded run to a part, from (part, key, before, t1, t2, spot)."""
    entries.sort()
    out: dict[str, list] = {c.split()[0]: [] for c in _RUN.split(", ")}
    last, previous = -1, b""
    for part, key, before, t1, t2, spot in entries:
        if part != last:
            out["part"].append(part)
            for c in _LISTS:
                out[c].append([])
            last, previous = part, b""
        same = common(previous, key, 0)
        for c, value in zip(_LISTS, (t1, t2, spot, before, same, key[same:]), strict=True):
            out[c][-1].append(value)
        previous = key
    kinds = [pa.int32(), *(pa.list_(k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary()))]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))


def _suffix_runs(rows: DataFrame, length: int, reach: int, parts: int) -> DataFrame:
    """Runs of the suffixes at the anchors of whole texts, by the part that their gram goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries: list[tuple[int, bytes, bytes, int, int, int]] = []
            done: set[tuple[int, int]] = set()
            for t1, t2, text, spots, hashes in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (t1, t2) in done:
                    continue
                done.add((t1, t2))
                text = text.encode()
                for spot, h in zip(spots, hashes, strict=True):
                    entries.append(((h & 0xFFFFFFFFFFFFFFFF) % parts, _head(h, 0, 0, reach) + text[spot : spot + length], text[max(0, spot - reach) : spot][::-1], t1, t2, spot))
            yield _coded(entries)

    return rows.mapInArrow(arrays.lean(run), _RUN)


def _band_runs(items: DataFrame, spans: tuple[int, int], parts: int) -> DataFrame:
    """Runs of suffixes of hot grams, each for one span and a range of distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = []
            for k1, span, low, high, t1, t2, pos, before, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                entries.append(((k1 & 0xFFFFFFFFFFFFFFFF) % parts, _head(k1, 1 + spans.index(span), low, high) + following, before, t1, t2, pos))
            yield _coded(entries)

    return items.select("k1", "span", "low", "high", "t1", "t2", "pos", "before", "following").mapInArrow(arrays.lean(run), _RUN)


_SPANS = "t1 long, t2 long, start int, stop int, full boolean"


def _merged_spans(runs: DataFrame, spans: tuple[int, int]) -> DataFrame:
    """Spans of repeated strings, from merging all runs of a part; ``full`` are those of the longer length."""

    def entries(row: pa.RecordBatch) -> Iterator[tuple[int, bytes, tuple]]:
        """A run's entries, few of them as Python objects at a time."""
        t1, t2, spot, before, prefix, rest = (row.column(c)[0].values for c in _LISTS)
        for i in range(0, len(prefix), _CHUNK):
            part = [x.slice(i, _CHUNK).to_pylist() for x in (prefix, rest, t1, t2, spot, before)]
            yield from ((p, r, payload) for p, r, payload in zip(part[0], part[1], zip(*part[2:], strict=True), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)]
        found: list[tuple[int, int, int, int, bool]] = []
        group: list[tuple[int, int, tuple]] = []
        head = b""

        def close() -> None:
            """Spans of the group. The same suffix twice is one; of suffixes with equal bytes around them one stands for all."""
            seen: set[tuple] = set()
            like: dict[tuple[int, bytes], tuple[int, list[tuple]]] = {}
            right, agree, nth_suffix, last = [], 1 << 60, 0, -1
            for prefix, size, payload in group:
                agree = min(agree, prefix - _HEAD)
                nth_suffix += not (prefix == size == last)
                last = size
                if payload[:3] in seen:
                    continue
                seen.add(payload[:3])
                if (nth_suffix, payload[3]) not in like:
                    like[nth_suffix, payload[3]] = (size - _HEAD, [])
                    right.append(agree)
                    agree = 1 << 60
                like[nth_suffix, payload[3]][1].append(payload)
            if len(seen) < 2:
                return
            low, high = int.from_bytes(head[9:11], "big"), int.from_bytes(head[11:13], "big")
            for nth, length in enumerate(spans):
                if head[8] not in (0, nth + 1):
                    continue
                for ((_, before), (size, own)), ranges in zip(like.items(), repeated_offsets(right, [b for _, b in like], length, low, high), strict=True):
                    if len(own) > 1:
                        first, final = max(low, length - size), min(high, len(before))
                        ranges = [(first, final)] if first <= final else []
                    if ranges:
                        back = merged(np.array([(-b, length - a) for a, b in ranges], np.int64)).tolist()
                        for t1, t2, spot, _ in own:
                            found.extend((t1, t2, spot + start, spot + stop, nth == 1) for start, stop in back)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * 5
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], ["t1", "t2", "start", "stop", "full"])

        for prefix, key, payload in merge_runs([entries(r) for r in rows]):
            if prefix < _HEAD:
                close()
                group, head = [], key[:_HEAD]
                if len(found) > 10_000:
                    yield flush()
            group.append((prefix, len(key), payload))
        close()
        yield flush()

    return runs.mapInArrow(arrays.lean(run), _SPANS)


def _keyed(items: DataFrame) -> DataFrame:
    """Items whose range of distances holds a string inside the text, first to last one.

    With 128 bits of what all those strings share (k1, k2), and of all their bytes (f1, f2).
    """
    inside = items.withColumn("first", F.greatest(F.col("low"), F.col("span") - F.length("following"))).withColumn("last", F.least(F.col("high"), F.length("before")))
    band = F.concat_ws(":", *[F.col(c).cast("string") for c in ("h", "span", "low", "high")])

    def around(before: Column, following: Column) -> Column:
        first, then = F.substring(F.col("before"), F.lit(1), before), F.substring(F.col("following"), F.lit(1), following)
        return F.concat(F.concat_ws(":", band, F.length(first).cast("string"), F.lit("")).cast("binary"), first, then)

    shared_part, whole = around(F.col("low"), F.col("span") - F.col("high")), around(F.col("high"), F.col("span") - F.col("low"))
    hashes = {f"{k}{i}": name for k, part in (("k", shared_part), ("f", whole)) for i, name in enumerate(shared.names(part), 1)}
    return inside.where("first <= last").withColumns(hashes)


def _hot_spans(contexts: DataFrame, spans: tuple[int, int], reach: int, parts: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Runs of small groups, and spans that are certain, of the suffixes of hot grams (h, t1, t2, pos, before, following)."""
    kept = ["h", "t1", "t2", "pos", "before", "following", "span"]
    level = contexts.withColumn("span", F.explode(F.array(*map(F.lit, spans)))).withColumn("low", F.lit(0)).withColumn("high", F.lit(reach))
    runs, certain = [], []
    while True:
        level = shared.written(_keyed(level), "level")
        if level.isEmpty():
            return runs, certain
        twice = level.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        start = F.col("pos") - F.col("last")
        stop = F.col("pos") - F.col("first") + F.col("span")
        certain.append(level.join(twice, ["f1", "f2"]).select("t1", "t2", start.cast("int").alias("start"), stop.cast("int").alias("stop"), (F.col("span") == spans[1]).alias("full")))
        # one for all that agree in all bytes; at a single distance nothing is left to find
        one = level.where("low < high").dropDuplicates(["k1", "k2", "f1", "f2"]).select(*kept, "low", "high", "k1", "k2")
        many = level.where("low < high").select("k1", "k2", "f1", "f2").distinct().groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        meeting = shared.written(one.join(many, ["k1", "k2"]), "meeting")
        runs.append(_band_runs(meeting.where(F.col("n") <= HOT), spans, parts))
        large = meeting.where(F.col("n") > HOT)
        step = F.ceil((F.col("high") - F.col("low") + 1) / PIECES).cast("int")
        cut = large.withColumn("step", step).select(*kept, "step", F.col("high").alias("end"), F.explode(F.sequence(F.col("low"), F.col("high"), F.col("step"))).alias("low"))
        level = cut.select(*kept, "low", F.least("end", F.col("low") + F.col("step") - 1).cast("int").alias("high"))


def merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint, non-touching spans with the same cover, in order."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > top[:-1]
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], top[np.append(first[1:], len(spans)) - 1]], axis=1)


def _text_id() -> list[Column]:
    """128 bits that stand for a text."""
    one, two = shared.names(F.col("text").cast("binary"))
    return [one.alias("t1"), two.alias("t2")]


def _contexts(sources: DataFrame, length: int, reach: int) -> DataFrame:
    """(h, t1, t2, pos, before, following) of the anchors of hot grams; before is read backwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for t1, t2, text, spots, hashes in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                text = text.encode()
                out += [(h, t1, t2, spot, text[max(0, spot - reach) : spot][::-1], text[spot : spot + length]) for spot, h in zip(spots, hashes, strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 6, kinds, strict=True)], ["h", "t1", "t2", "pos", "before", "following"])

    return sources.mapInArrow(arrays.lean(run), "h long, t1 long, t2 long, pos int, before binary, following binary").dropDuplicates(["t1", "t2", "pos"])


def cut_repeats(docs: DataFrame, length: int = 400, gram: int = GRAM, short: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared and kept (binary; null where the text stays whole).

    Removes each byte under a string of ``length`` bytes that also starts elsewhere in the corpus,
    judged on the input; n_shared counts the bytes under such strings of ``short`` bytes (256
    if ``length`` allows), which are reported and stay. A null text is empty; repeated rows are copies, of which each byte goes
    from ``length`` bytes on; ties of equal strings have no order: all go. Null ids are as good as
    others; other columns are not read, so their names cannot clash; an empty table gives an empty
    result. A very long text is one row all the way; its anchors are found a megabyte at a time.
    Texts are told apart by 128 bits of hash.
    """
    short = min(SHORT, length) if short is None else short
    if not 1 <= gram <= short <= length < 1 << 16:
        raise ValueError("a gram must fit in the shorter length, and that in the longer")
    parts, spans, reach = shared.partitions(docs.sparkSession), (short, length), short - gram
    tid = ["t1", "t2"]
    plain = shared.texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    plain = plain.select("doc_id", "text", *_text_id(), F.octet_length("text").cast("long").alias("n_bytes"))
    long = plain.where(F.col("n_bytes") >= short).select("t1", "t2", "text")
    # counted before the shuffle, so a hot gram is one row a batch; the join splits hot grams' rows
    twice = _anchor_rows(long, length, short, gram, False).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    places = _anchor_rows(long, length, short, gram, True).join(twice, "h")
    spots = places.groupBy(*tid).agg(F.collect_set(F.struct("pos", "h", (F.col("n") > HOT).alias("hot"), "stop")).alias("anchors"))
    known = plain.groupBy(*tid).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))
    known = known.join(spots, tid, "left")
    # the whole texts move once; those that stay whole, or go as a whole, are done with here
    twin = F.col("copies") > 1
    staged = plain.join(known, tid).withColumn("whole", twin & (F.col("n_bytes") >= length)).withColumn("twin", twin & (F.col("n_bytes") >= short))
    source = F.col("anchors").isNotNull() & F.col("doc_id").eqNullSafe(F.col("first_doc"))
    open_text = F.when(source | (F.col("anchors").isNotNull() & ~F.col("whole")), F.col("text"))
    sha = F.when(F.col("whole"), F.sha2(F.lit("").cast("binary"), 256)).when(F.col("anchors").isNull(), F.sha2(F.col("text").cast("binary"), 256))
    staged = shared.written(staged.select("doc_id", *tid, "n_bytes", "whole", "twin", source.alias("source"), "anchors", open_text.alias("text"), sha.alias("sha")), "staged")

    def sources(hot: bool) -> DataFrame:
        own = staged.where("source").withColumn("anchors", F.filter("anchors", lambda a: (a["hot"] == hot) & a["stop"].isNull())).where(F.size("anchors") > 0)
        return own.select(*tid, "text", F.col("anchors.pos").alias("spots"), F.col("anchors.h").alias("hashes"))

    contexts = shared.written(_contexts(sources(True), length, reach), "contexts")
    runs, certain = [_suffix_runs(sources(False), length, reach, parts)], []
    if not contexts.isEmpty():
        more, certain = _hot_spans(contexts, spans, reach, parts)
        runs += more
    found = _merged_spans(reduce(DataFrame.unionByName, runs).repartitionById(parts, F.col("part")), spans)
    stretches = staged.where("source").select(*tid, F.explode(F.filter("anchors", lambda a: a["stop"].isNotNull())).alias("a"))
    certain.append(stretches.select(*tid, F.col("a.pos").alias("start"), "a.stop", F.lit(True).alias("full")))
    by_text = reduce(DataFrame.unionByName, [found, *certain]).groupBy(*tid).agg(F.collect_list(F.struct("start", "stop", "full")).alias("spans"))
    by_text = shared.written(by_text.select(*tid, F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"), F.col("spans.full").alias("fulls")), "spans")
    number = lambda condition: F.when(condition, F.col("n_bytes")).otherwise(F.lit(0)).cast("long")
    done = staged.where("sha is not null AND (whole OR anchors IS NULL)")
    done = done.select("doc_id", "n_bytes", number(F.col("whole")).alias("n_removed"), F.col("whole").cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), number(F.col("twin")).alias("n_shared"), F.when(F.col("whole"), F.lit("").cast("binary")).alias("kept"))
    rest = staged.where("sha is null").join(by_text, tid, "left").select("doc_id", "n_bytes", "twin", "text", "starts", "stops", "fulls")
    return done.unionByName(rest.mapInArrow(arrays.lean(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long, kept binary"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, count, sha, kept, under = [], [], [], [], []
        for twin, text, starts, stops, fulls in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5, 6)), strict=True):
            data = text.encode()
            out = data
            every = np.array([starts or [], stops or []], np.int64).T
            spans = merged(every[np.array(fulls or [], bool)])
            if len(spans):
                edges = [0, *spans.ravel().tolist(), len(data)]
                out = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            removed.append(len(data) - len(out))
            count.append(len(spans))
            sha.append(hashlib.sha256(out).hexdigest())
            kept.append(out if len(spans) else None)
            under.append(len(data) if twin else int((merged(every) @ [-1, 1]).sum()))
        columns = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(under, pa.int64()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", "kept"])
