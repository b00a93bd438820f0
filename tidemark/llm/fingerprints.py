"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the ``k`` smallest distinct hashes of a text's shingles, as sorted unsigned 64-bit
numbers. Sketches of parts merge into the sketch of the whole, and two sketches estimate
resemblance, containment and the number of distinct shingles; with no more than k shingles they
are exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import arrays, shared

#: Hashes kept to a text: a standard error of at most 0.032 for resemblance.
K = 256
#: Words to a shingle.
WIDTH = 5

_WHOLE = float(2**64)


def sketches(texts: pa.Array, k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    """The sketch of each text of a column; a null or wordless text has an empty one."""
    out = []
    for start, end, data, offsets in arrays.blocks(texts):
        hashes, at = arrays.text_shingles(data, offsets, width)
        for row in range(end - start):
            own = hashes[at[row] : at[row + 1]]
            if len(own) > 8 * k:  # the k smallest distinct ones are among few, unless a shingle repeats a lot
                near = np.unique(own[own <= np.partition(own, 4 * k)[4 * k]])
                own = near if len(near) >= k else own
            out.append(np.unique(own)[:k])
    return out


def merge(one: np.ndarray, other: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both sets together."""
    return np.union1d(one, other)[:k]


def resemblance(one: np.ndarray, other: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity: how many of the k smallest hashes of both are in each; 1 for two empty sets."""
    both = merge(one, other, k)
    if not len(both):
        return 1.0
    return len(np.intersect1d(np.intersect1d(one, other, True), both, True)) / len(both)


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) * _WHOLE / (float(sketch[-1]) + 1)


def containment(one: np.ndarray, other: np.ndarray, k: int = K) -> float:
    """Estimated part of the first set that the second has; 1 for an empty first set."""
    mine = distinct(one, k)
    if not mine:
        return 1.0
    shared_part = resemblance(one, other, k) * distinct(merge(one, other, k), k)
    return min(1.0, shared_part / mine)


def encode(sketch: np.ndarray) -> str:
    """A sketch as text: base64 of its hashes, least byte first."""
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode("ascii")


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8").astype(np.uint64)


def fingerprint(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """(doc_id, fingerprint) of every row, a map without shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(encode, sketches(batch.column(1), k, width)), pa.string())], ["doc_id", "fingerprint"])

    return shared.texts(docs).mapInArrow(arrays.lean(run), "doc_id long, fingerprint string")


def merge_fingerprints(parts: DataFrame, key: str, k: int = K) -> DataFrame:
    """(key, fingerprint) over the fingerprints of each key's parts.

    Only the k smallest distinct hashes of a key leave a task: the rank limit applies before the
    shuffle, so a key that holds most parts is no heavier than another. A null fingerprint is empty,
    and a key of empty ones has an empty one; null keys are left without hashes. Repeated parts add
    nothing, and equal hashes are one. Other columns are not read, so their names cannot clash; no
    text is read. An empty table gives an empty result.
    """
    hashes = parts.select(key, F.explode(_hashes(F.col("fingerprint"))).alias("__hash")).distinct()
    smallest = Window.partitionBy(key).orderBy("__hash")
    kept = hashes.withColumn("__nth", F.row_number().over(smallest)).where(F.col("__nth") <= k)
    joined = kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("__hash")), _flip), "").alias("__hex"))
    have = joined.select(key, F.base64(F.unhex("__hex")).alias("fingerprint"))
    none = parts.select(key).distinct().join(have, key, "left")
    return none.select(key, F.regexp_replace(F.coalesce("fingerprint", F.lit("")), "\\s", "").alias("fingerprint"))


def _flip(text: Column) -> Column:
    """The same bytes in hex, from the other end."""
    return F.concat(*[F.substring(text, 15 - 2 * i, 2) for i in range(8)])


def _hashes(fingerprint_text: Column) -> Column:
    """Each hash as 16 hex digits, greatest byte first, so that text order is number order."""
    digits = F.hex(F.unbase64(fingerprint_text))
    nth = F.when(F.length(digits) > 0, F.sequence(F.lit(0), (F.length(digits) / 16).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(nth, lambda i: _flip(F.substr(digits, i * 16 + 1, F.lit(16))))


def edited(text: str, following: str) -> str:
    """A text whose last half (floor) of code points gives way to the first as many of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Fingerprint each document, its edited text, and compare with both it and the next document.

    Documents are cut into id ranges of about equal counts, one to a task; the first document of a
    range also goes to the range before it, and the first of all to the last. So the whole texts
    move once, and no range needs another. Null ids come first; equal ids are ordered by text; a
    single document is its own next one. A null text is empty; empty texts have an empty
    fingerprint and resemble each other fully. Repeated rows are documents of their own, one next to
    the other. Other columns are not read, so their names cannot clash. A very long text is one row,
    which is hashed in blocks. An empty table gives an empty result.
    """
    plain = shared.texts(docs)
    ranges = shared.partitions(docs.sparkSession)
    cuts = plain.agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("nulls"), F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 50 * ranges).alias("cuts")).first() if ranges > 1 else None
    low = None if cuts is None or cuts["nulls"] else cuts["low"]
    splits = np.array(sorted({c for c in (cuts["cuts"] or []) if c != low} if cuts else []), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            known = np.asarray(ids.is_valid())
            value = np.asarray(ids.fill_null(np.iinfo(np.int64).min))
            part = np.where(known, np.searchsorted(splits, value, "right"), 0).astype(np.int32)
            first = known & (part > 0) & (value == splits[np.maximum(part, 1) - 1]) if len(splits) else np.zeros(len(value), bool)
            lowest = (~known if low is None else known & (value == low)) if cuts else np.ones(len(value), bool)
            rows = np.concatenate([np.arange(len(value)), np.flatnonzero(first), np.flatnonzero(lowest)])
            where = np.concatenate([part, part[first] - 1, np.full(lowest.sum(), len(splits), np.int32)]).astype(np.int32)
            turn = np.repeat(np.array([0, 1, 2], np.int8), [len(value), first.sum(), lowest.sum()])
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(turn.astype(np.int32)), taken.column(0), taken.column(1)], ["part", "turn", "doc_id", "text"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document that waits for its next one
        for batch in batches:
            rows: list[tuple] = []
            pairs: list[tuple[str, str]] = []
            turns = batch.column(1).to_pylist()
            ids, texts = batch.column(2).to_pylist(), batch.column(3).fill_null("").to_pylist()
            parts = batch.column(0).to_pylist()
            for own, part, turn, doc_id, text in zip(sketches(batch.column(3), k, width), parts, turns, ids, texts, strict=True):
                if held is not None and held[0] == part:
                    rows.append((held, own))
                    pairs.append((held[2], text))
                    held = None
                if turn == 0:
                    held = (part, doc_id, text, own)
            if rows:
                after = sketches(pa.array([edited(*p) for p in pairs], pa.large_string()), k, width)
                yield from _compared(rows, pairs, after, k)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    dealt = plain.mapInArrow(arrays.lean(deal), "part int, turn int, doc_id long, text string")
    together = dealt.repartitionById(len(splits) + 1, F.col("part")).sortWithinPartitions("part", "turn", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return together.mapInArrow(arrays.lean(walk), schema)


def _compared(rows: list[tuple], pairs: list[tuple[str, str]], after: list[np.ndarray], k: int) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([held[1] for held, _ in rows], pa.int64()),
            pa.array([len(held[2]) for held, _ in rows], pa.int64()),
            pa.array([hashlib.sha256(edited(*p).encode()).hexdigest() for p in pairs], pa.string()),
            pa.array([encode(held[3]) for held, _ in rows], pa.string()),
            pa.array([encode(e) for e in after], pa.string()),
            pa.array([resemblance(held[3], e, k) for (held, _), e in zip(rows, after, strict=True)], pa.float64()),
            pa.array([resemblance(held[3], own, k) for held, own in rows], pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
