"""Quality rules by suffix-array repetition.

Each text's words are symbols. The suffix array of a block of texts comes from prefix doubling
over whole arrays, going on only with suffixes that are not yet apart; the ranks of every level
give the longest common prefix of neighbours. A suffix's longest common prefix with either
neighbour is the longest repeated substring that starts there, so these intervals cover all
maximal repeats. Rules limit the part of the text under long repeats and the longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import arrays, shared

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class Rules:
    """Limits of a text that is kept."""

    #: Fewer words are too few.
    least_words: int = 10
    #: Words of a window that counts as repeated, and the percentage of words that such windows may cover.
    window: int = 5
    window_percent: int = 20
    #: Words of a repeat that counts as long, and the fraction of words that long repeats may cover:
    #: less than windows may, or the limit would be idle. A sentence said twice is no long repeat.
    long_repeat: int = 20
    covered: float = 0.10
    #: Longest repeat allowed: so many words, or this fraction of a longer text, which is less than
    #: half of the cover allowed, as two copies cover twice their length.
    longest: int = 50
    longest_fraction: float = 0.04


def repeats(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring from it that its row has elsewhere too.

    symbols: rows of non-negative numbers, one after another; first: where each row starts, and
    the end.
    """
    n = len(symbols)
    out = np.zeros(n, np.int64)
    if n == 0:
        return out
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][row]
    _, dense = np.unique(symbols, return_inverse=True)
    rank = _grouped(row * (int(dense.max()) + 1) + dense)
    levels = [rank]  # levels[j]: equal where 2**j symbols are equal (or the row ends alike)
    active = _tied(rank, np.arange(n))
    step = 1
    while len(active):
        # the second half of a prefix: 0 where the row has ended, so that shorter suffixes differ
        second = np.where(active + step < end[active], rank[np.minimum(active + step, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[active]))
        a, s = active[order], second[order]
        r = rank[a]
        new_group = np.empty(len(a), bool)
        new_group[0] = True
        new_group[1:] = r[1:] != r[:-1]
        new_pair = new_group.copy()
        new_pair[1:] |= s[1:] != s[:-1]
        # ranks are the first place of a group in the sorted order, so groups split without renumbering others
        place = np.arange(len(a))
        offset = np.maximum.accumulate(np.where(new_pair, place, 0)) - np.maximum.accumulate(np.where(new_group, place, 0))
        rank = rank.copy()
        rank[a] = r + offset
        levels.append(rank)
        active = _tied(rank, active)
        step *= 2
    suffixes = np.argsort(rank)
    left, right = suffixes[:-1], suffixes[1:]
    together = row[left] == row[right]
    together &= levels[0][left] == levels[0][right]
    left, right = left[together], right[together]
    common = np.zeros(len(left), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        a, b = left + common, right + common
        inside = (a + (1 << j) <= end[left]) & (b + (1 << j) <= end[right])
        same = inside & (levels[j][np.minimum(a, n - 1)] == levels[j][np.minimum(b, n - 1)])
        common += np.where(same, 1 << j, 0)
    np.maximum.at(out, left, common)
    np.maximum.at(out, right, common)
    return out


def _grouped(keys: np.ndarray) -> np.ndarray:
    """Each key's first place in sorted order."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.empty(len(keys), bool)
    new[0] = True
    new[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    return out


def _tied(rank: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Those positions whose rank another one has too, in rank order."""
    order = among[np.argsort(rank[among], kind="stable")]
    r = rank[order]
    same = np.zeros(len(r) + 1, bool)
    same[1:-1] = r[1:] == r[:-1]
    return order[same[1:] | same[:-1]]


def covered(lengths: np.ndarray, least: int, first: np.ndarray) -> np.ndarray:
    """By row, how many positions lie under spans of at least ``least`` that start at each position."""
    at = np.flatnonzero(lengths >= least)
    delta = np.zeros(len(lengths) + 1, np.int64)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + lengths[at], -1)
    under = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(np.cumsum(delta[:-1]) > 0, out=under[1:])
    return under[first[1:]] - under[first[:-1]]


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, row_count: int) -> np.ndarray:
    """By row, the lines with a word that equal an earlier line of the row."""
    breaks = np.flatnonzero(data == 10)
    edges = np.union1d(breaks + 1, offsets[:-1])
    line_start = np.sort(np.concatenate([edges[edges < len(data)], np.zeros(0, np.int64)])).astype(np.int64)
    if not len(line_start):
        return np.zeros(row_count, np.int64)
    line_end = np.append(line_start[1:], len(data))
    row = np.searchsorted(offsets, line_start, "right") - 1
    line_end = np.where(data[line_end - 1] == 10, line_end - 1, line_end)
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, row = line_start[has_word], line_end[has_word], row[has_word]
    _, line = arrays.distinct_spans(data, line_start, line_end - line_start)
    order = np.lexsort((line, row))
    same = (line[order][1:] == line[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][1:][same], minlength=row_count)


def measure(texts: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    """The measures and verdicts of a column of texts; a null has no words."""
    parts: list[dict[str, np.ndarray]] = []
    for start, end, data, offsets in arrays.blocks(texts, 1 << 20):
        rows = end - start
        starts, ends, first = arrays.words(data, offsets)
        n_words = np.diff(first)
        leads = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=leads[1:])
        symbols = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_IS_SYMBOL[data], out=symbols[1:])
        chars = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(leads[ends] - leads[starts], out=chars[1:])
        lengths = repeats(arrays.distinct_spans(data, starts, ends - starts)[1], first)
        longest = np.zeros(rows, np.int64)
        np.maximum.at(longest, np.repeat(np.arange(rows), n_words), lengths)
        # every window of five that repeats lies in a longest repeat, and every such repeat of five or more is made of them
        parts.append(
            {
                "n_words": n_words,
                "word_chars": chars[first[1:]] - chars[first[:-1]],
                "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
                "n_dup_lines": _duplicate_lines(data, offsets, starts, rows),
                "n_repeat_words": covered(lengths, rules.window, first),
                "repeat_covered": covered(lengths, rules.long_repeat, first),
                "repeat_longest": longest,
            }
        )
    if not parts:
        parts = [{c: np.zeros(0, np.int64) for c in MEASURES}]
    out = {c: np.concatenate([p[c] for p in parts]) for c in MEASURES}
    words = out["n_words"]
    out["base_failed"] = (words < rules.least_words) | (100 * out["n_repeat_words"] > rules.window_percent * words)
    too_long = out["repeat_longest"] > np.maximum(rules.longest, rules.longest_fraction * words)
    out["kept"] = ~out["base_failed"] & (out["repeat_covered"] <= rules.covered * words) & ~too_long
    return out


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_covered", "repeat_longest")
_SCHEMA = ", ".join(f"{c} long" for c in MEASURES) + ", base_failed boolean, kept boolean"


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every document: a map without shuffle.

    A null or empty text has no words and fails; repeated rows are judged alike; an empty table
    gives an empty result; ties of repeats of equal length count once. A very long text is one row,
    handled alone. Columns other than doc_id and text are not read, so their names cannot clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column(1), rules)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in found.values())], ["doc_id", *found])

    return shared.texts(docs).mapInArrow(arrays.lean(run), f"doc_id long, {_SCHEMA}")


def keep(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with their own columns, whatever their names, by the rules of :func:`judge`.

    A null text has no words, so its row goes; nulls in other columns have no effect. Repeated rows
    are judged alike, and ties do not arise. A very long text is one row, judged alone. An empty
    table gives an empty result.
    """
    position = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(measure(batch.column(position), rules)["kept"]))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(arrays.lean(run), docs.schema)
