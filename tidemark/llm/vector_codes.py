"""Vector code compression: product codes over integer codebooks, by partial-distance search.

A codebook has 16 parts of 64 entries, whatever the number of vectors, so it goes to every task and
back to the driver; of the vectors only sums by entry leave a task. All arithmetic is on integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import arrays, shared

#: Parts of a vector, entries of a part's codebook, rounds that move the entries, steps to a unit.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors searched at once.
BLOCK_ROWS = 4096
#: Up to this size of components, squared distances of parts of 8 fit 64 bits; beyond it Python's integers are used.
SAFE = 1 << 29


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 x) of finite numbers: 64-bit where they are small, else Python's integers."""
    scaled = np.floor(values * SCALE)
    if not len(scaled) or np.abs(scaled).max(initial=0) <= SAFE:
        return scaled.astype(np.int64)
    return np.array([int(x) * SCALE if abs(x) >= 2.0**53 else int(np.floor(x * SCALE)) for x in values.ravel().tolist()], object).reshape(values.shape)


def _fit(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers if no distance can overflow, else both as Python's."""
    if x.dtype == object or book.dtype == object or x.shape[1] > 8:
        return x.astype(object), book.astype(object)
    return x, book


def _least(acc: np.ndarray, r: np.ndarray, rows: int) -> np.ndarray:
    """Of each row's run, the first place with the least value."""
    hit = np.flatnonzero(acc == np.minimum.reduceat(acc, np.searchsorted(r, np.arange(rows)))[r])
    return hit[np.searchsorted(r[hit], np.arange(rows))]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codebook's nearest entry to each row, ties to the lower one, and its squared distance.

    Dimensions are taken by falling variance of the codebook. After each, the entry that is nearest
    so far is completed, and entries whose partial distance strictly exceeds the best complete one
    are masked out.
    """
    rows, n = x.shape
    if not rows or not n:
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    x, book = _fit(x, book)
    exact = book.astype(object)
    spread = len(book) * (exact * exact).sum(0) - exact.sum(0) ** 2
    order = sorted(range(n), key=lambda d: (-spread[d], d))
    x, book = x[:, order], book[:, order]
    acc = (x[:, :1] - book[:, 0]) ** 2
    best = ((x - book[np.argmin(acc, axis=1)]) ** 2).sum(axis=1)
    r, e = np.nonzero(acc <= best[:, None])
    acc = acc[r, e]
    for d in range(1, n):
        gap = x[r, d] - book[e, d]
        acc = acc + gap * gap
        best = np.minimum(best, ((x - book[e[_least(acc, r, rows)]]) ** 2).sum(axis=1))
        keep = acc <= best[r]
        r, e, acc = r[keep], e[keep], acc[keep]
    first = _least(acc, r, rows)
    return e[first], acc[first]


def _matrix(column: pa.Array, dims: int) -> Iterator[np.ndarray]:
    values = np.asarray(column.flatten(), np.float64).reshape(len(column), dims)
    for at in range(0, len(values), BLOCK_ROWS):
        yield integers(values[at : at + BLOCK_ROWS])


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of vectors that are not null and hold no null, NaN or infinity."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _moved(rows: DataFrame, books: list[np.ndarray], dims: int) -> list[np.ndarray]:
    """The codebooks after one round."""
    n = dims // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((PARTS, len(books[0])), np.int64)
        total = np.zeros((PARTS, len(books[0]), n), object)
        for batch in batches:
            for block in _matrix(batch.column(0), dims):
                for p in range(PARTS):
                    x = block[:, p * n : (p + 1) * n]
                    e, _ = nearest(x, books[p])
                    by_entry = np.zeros((len(books[p]), n), x.dtype)
                    np.add.at(by_entry, e, x)
                    total[p] += by_entry
                    count[p] += np.bincount(e, minlength=len(books[p]))
        p, e = np.nonzero(count)
        if len(p) and n:
            each = lambda a: pa.array(np.repeat(a, n).astype(np.int32))
            places = pa.array(np.tile(np.arange(n, dtype=np.int32), len(p)))
            yield pa.RecordBatch.from_arrays([each(p), each(e), places, pa.array(np.repeat(count[p, e], n)), pa.array([str(s) for s in total[p, e].ravel()])], ["part", "entry", "place", "n", "s"])

    # as many groups as the codebooks have numbers, whatever the table
    sums = rows.select("embedding").mapInArrow(arrays.lean(run), "part int, entry int, place int, n long, s string")
    found = sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = [b.astype(object) for b in books]
    for r in found:
        out[r.part][r.entry, r.place] = int(r.s) // r.n
    return [_small(b) for b in out]


def _small(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if all(abs(x) <= SAFE for x in book.ravel()) else book


def train(vectors: DataFrame, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks (entries x components) of the parts, in order; none for a table without vectors.

    They start from the vectors of the smallest ids (nulls last, ties by the vector) and move for
    ``rounds`` rounds over all vectors, as :func:`compress` says.
    """
    return _train(kept(vectors), rounds)[1]


def _train(rows: DataFrame, rounds: int) -> tuple[DataFrame, list[np.ndarray]]:
    smallest = lambda frame: [r.embedding for r in frame.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()]
    first = smallest(rows)
    if not first:
        return rows, []
    dims = len(first[0])
    if dims % PARTS:
        raise ValueError(f"vectors of {dims} components cannot be cut into {PARTS} equal parts")
    rows = rows.where(F.size("embedding") == dims)
    if any(len(x) != dims for x in first):
        first = smallest(rows)
    start, n = integers(np.array(first, np.float64).reshape(len(first), dims)), dims // PARTS
    books = [_small(start[:, p * n : (p + 1) * n].astype(object)) for p in range(PARTS)]
    for _ in range(rounds):
        books = _moved(rows, books, dims)
    return rows, books


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of kept vectors by trained codebooks: a map without shuffle."""
    n = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [], []
            for block in _matrix(batch.column(2), n * PARTS):
                found = [nearest(block[:, p * n : (p + 1) * n], books[p]) for p in range(PARTS)]
                codes += [bytes(row).hex() for row in np.stack([e for e, _ in found], axis=1).astype(np.uint8)]
                errors += sum(d for _, d in found).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(arrays.lean(run), f"vec_id long, label {label}, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components, by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that can be coded.

    Vectors that are null or hold nulls, NaN or infinities go, as do those of another length than
    the smallest kept id's, which cannot be cut alike; a length that 16 does not divide is an error.
    An entry that no part is nearest to stays. Repeated ids and rows each count and come back; a
    null id is last; null labels are one label. Fewer than 64 vectors make as many entries. Numbers
    of any finite size are exact as long as errors fit 64 bits. An empty table gives an empty
    result. Other columns are not read, so their names cannot clash.

    A label may hold most rows: sums by label are partial first, and come back by ``looked_up``.
    """
    rows, books = _train(kept(vectors), rounds)
    if not books:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).where(F.lit(False))
    coded = shared.written(encode(rows, books), "vector-codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    whole = shared.looked_up(coded, shared.written(by_label, "label-errors"), ["label"], "n")
    return whole.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
