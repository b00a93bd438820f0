"""Column-at-a-time helpers for text that arrives in Arrow batches.

Texts stay in their UTF-8 buffers: every helper works on one byte array with row offsets, so
the cost is a few numpy passes over the bytes, whatever the number of rows.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Longer spans are hashed one by one.
_LONG = 1 << 12
#: What of eight bytes belongs to a span that ends within them, by its length.
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same map, but workers that wait for their next task keep no memory of this one."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            _give_back()

    return lean_run


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets (one more than rows); a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and len(buffers[2]) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of rows of about ``limit`` bytes: first row, end row, bytes, offsets."""
    data, offsets = utf8(column)
    rows, at = len(offsets) - 1, 0
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes other than 0x20 and 0x09-0x0D: starts, ends and, by row, the first word's index."""
    solid = ~_SPACE[data]
    before = np.empty(len(solid) + 1, bool)
    before[0] = False
    before[1:] = solid
    edge = np.zeros(len(solid) + 1, bool)
    edge[offsets[offsets <= len(solid)]] = True
    starts = np.flatnonzero(solid & (~before[:-1] | edge[:-1]))
    after = np.zeros(len(solid), bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return _LOWER[data]


def _span_key(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit keys by which equal spans are found fast. Not for identity: unequal spans with one key can be made at will."""
    at, left = np.asarray(starts, np.int64), np.asarray(ends - starts, np.int64)
    out = mix(left.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    for i in np.flatnonzero(left > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(padded[at[i] : at[i] + left[i]], digest_size=8).digest(), "little")
    active = np.flatnonzero((left > 0) & (left <= _LONG))
    at, left, state = at[active], left[active], out[active]
    while len(active):
        state = mix((state ^ (eight[at] & _TAIL[np.minimum(left, 8)])) * np.uint64(0x9E3779B97F4A7C15))
        more = left > 8
        out[active[~more]] = state[~more]
        active, at, left, state = active[more], at[more] + 8, left[more] - 8, state[more]
    return out


def distinct_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first span of each distinct one, and which one each span is. Keys find them, their bytes decide."""
    _, where, which = np.unique(_span_key(data, starts, starts + lengths), return_index=True, return_inverse=True)
    if np.array_equal(lengths[where][which], lengths) and same_spans(data, starts, lengths, starts[where][which]):
        return where, which
    known: dict[bytes, int] = {}
    which = np.array([known.setdefault(data[a : a + n].tobytes(), len(known)) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)], np.int64)
    return np.unique(which, return_index=True)[1], which


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each span: up to seven bytes as they are, with their number; BLAKE2b of longer ones, each distinct one once.

    The highest byte keeps the two apart; both are spread by a bijection.
    """
    starts, lengths = np.asarray(starts, np.int64), np.asarray(ends - starts, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    out = (eight[starts] & _TAIL[np.minimum(lengths, 7)]) | (np.minimum(lengths, 7).astype(np.uint64) << np.uint64(56))
    long = np.flatnonzero(lengths > 7)
    if len(long):
        where, which = distinct_spans(data, starts[long], lengths[long])
        first, raw = long[where], data.tobytes()
        digests = [hashlib.blake2b(raw[a : a + n], digest_size=8).digest() for a, n in zip(starts[first].tolist(), lengths[first].tolist(), strict=True)]
        hashes = np.frombuffer(b"".join(digests), "<u8")
        out[long] = np.where(hashes < np.uint64(8 << 56), hashes | np.uint64(8 << 56), hashes)[which]
    return mix(out)


def _sip_round(v: list[np.ndarray], spare: np.ndarray) -> None:
    """One round of SipHash, in place."""
    a, b, c, d = v

    def turn(x: np.ndarray, bits: int) -> None:
        np.right_shift(x, np.uint64(64 - bits), out=spare)
        np.left_shift(x, np.uint64(bits), out=x)
        np.bitwise_or(x, spare, out=x)

    def half(x: np.ndarray, y: np.ndarray, bits: int) -> None:
        x += y
        turn(y, bits)
        y ^= x

    half(a, b, 13)
    turn(a, 32)
    half(c, d, 16)
    half(a, d, 21)
    half(c, b, 17)
    turn(c, 32)


def sip_hash(parts: list[np.ndarray]) -> np.ndarray:
    """SipHash-1-3, with the key 0, 1, of rows of as many 64-bit numbers as there are parts."""
    out = np.empty(len(parts[0]), np.uint64)
    for at in range(0, len(out), 1 << 13):  # what fits the cache
        blocks = [p[at : at + (1 << 13)] for p in parts]
        # fixed values of SipHash
        v = [np.full(len(blocks[0]), x, np.uint64) for x in (0x736F6D6570736575, 0x646F72616E646F6D ^ 1, 0x6C7967656E657261, 0x7465646279746573 ^ 1)]
        spare = np.empty_like(v[0])
        for block in [*blocks, np.uint64((8 * len(parts) & 255) << 56)]:
            v[3] ^= block
            _sip_round(v, spare)
            v[0] ^= block
        v[2] ^= np.uint64(255)
        for _ in range(3):
            _sip_round(v, spare)
        out[at : at + (1 << 13)] = v[0] ^ v[1] ^ v[2] ^ v[3]
    return out


def shingles(word_hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words and, by row, the first one's index.

    A row with fewer words has its whole sequence as its one shingle; a row without words has none.
    """
    counts = np.diff(first)
    whole = np.zeros(len(word_hashes) + 1, np.uint64)
    if len(word_hashes) >= width:
        n = len(word_hashes) - width + 1
        whole[:n] = sip_hash([word_hashes[j : j + n] for j in range(width)])
    number = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(number, out=at[1:])
    take = np.repeat(first[:-1] - at[:-1], number) + np.arange(at[-1])
    out = whole[take]
    for row in np.flatnonzero((counts > 0) & (counts < width)).tolist():
        own = hashlib.blake2b(word_hashes[first[row] : first[row + 1]].astype("<u8").tobytes(), digest_size=8)
        out[at[row]] = int.from_bytes(own.digest(), "little")
    return out, at


def text_shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of lower-cased words of each row, as :func:`shingles` gives them."""
    starts, ends, first = words(data, offsets)
    return shingles(span_hash(lower(data), starts, ends), first, width)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices that concatenate the spans ``starts[i] .. starts[i] + lengths[i]``."""
    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    return np.repeat(np.asarray(starts, np.int64) - at[:-1], lengths) + np.arange(at[-1])


def same_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span has the bytes of the span of the same length that starts at ``other``."""
    step = max(1, int(1 << 20))
    for i in range(0, len(starts), step):
        n = lengths[i : i + step]
        if not np.array_equal(data[ragged(starts[i : i + step], n)], data[ragged(other[i : i + step], n)]):
            return False
    return True
