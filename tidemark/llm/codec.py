"""Byte-level BPE encoding and decoding by corpus-level merge replay."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import arrays, bpe, shared


#: Words whose ids a worker keeps for later slices, and the longest of them.
KEPT, KEPT_BYTES = 1 << 16, 64


@functools.cache
def _store(path: str) -> dict[bytes, bytes]:
    """Ids, as bytes, of words that this worker has merged before."""
    return {}


def _merged(words: bpe.Words, which: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some of the words, one after another, and the number of each, from one replay of all merges over them.

    A word that is itself in the vocabulary is that one id, whatever its merges would give.
    """
    ranks, merges = bpe.rank_file(path)
    lengths = words.lengths[which]
    starts = np.cumsum(lengths) - lengths
    data = words.data[arrays.ragged(words.starts[which], lengths)]
    ids, count, _ = merges.replay(data, starts, lengths)
    longest = max(map(len, ranks))
    some = np.flatnonzero((count > 1) & (lengths <= longest))
    whole = [(w, ranks[word]) for w, word in zip(some.tolist(), map(words.word, which[some].tolist()), strict=True) if word in ranks]
    if whole:
        at = np.cumsum(count) - count
        keep = np.ones(len(ids), bool)
        for w, rank in whole:
            keep[at[w] + 1 : at[w] + count[w]] = False
            ids[at[w]] = rank
            count[w] = 1
        ids = ids[keep]
    return ids, count


def encode_words(words: bpe.Words, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all distinct words, one after another, and the number of each.

    Words that the worker knows are looked up, up to a bound; the merges are replayed over the others, all together.
    """
    store, raw = _store(path), words.data.tobytes()
    keys = [raw[a : a + n] for a, n in zip(words.starts.tolist(), words.lengths.tolist(), strict=True)]
    found = [store.get(k) for k in keys]
    new = [i for i, ids in enumerate(found) if ids is None]
    if new:
        ids, count = _merged(words, np.array(new, np.int64), path)
        flat, at = ids.astype("<i4").tobytes(), 0
        if len(store) + len(new) > KEPT:
            store.clear()
        for i, n in zip(new, count.tolist(), strict=True):
            found[i] = flat[at : at + 4 * n]
            at += 4 * n
            if len(keys[i]) <= KEPT_BYTES and len(store) < KEPT:
                store[keys[i]] = found[i]
    return np.frombuffer(b"".join(found), "<i4").astype(np.int64), np.array([len(x) // 4 for x in found], np.int64)


@functools.cache
def _byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ranks, _ = bpe.rank_file(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    size = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size


def decode(ids: np.ndarray, rows: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of rows of ids (``rows``: where each starts, and the end) and where each row's bytes start."""
    data, start, size = _byte_table(path)
    out = data[arrays.ragged(start[ids], size[ids])]
    total = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(size[ids], out=total[1:])
    return out, total[rows]


def encode_texts(texts: list[tuple[np.ndarray, np.ndarray]], path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block of texts its ids and where each row's start."""
    words = bpe.Words(texts)
    ids, count = encode_words(words, path)
    at = np.cumsum(count) - count
    for which, rows in words.blocks:
        total = np.zeros(len(which) + 1, np.int64)
        np.cumsum(count[which], out=total[1:])
        yield ids[arrays.ragged(at[which], count[which])], total[rows]


def encode(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), ids_sha256, decoded_sha256 of every document: a map without shuffle.

    Encoding depends on a text alone, so each task replays the merges over the distinct words of its
    slice of the corpus that its worker has not merged before. The ids are decoded again, and the bytes' hash is returned. A null
    text is empty: no ids. Repeated rows encode alike; of equal ranks the leftmost pair merges first.
    Other columns are not read, so
    their names cannot clash. A very long text is one row, handled alone. An empty table gives an empty result. The
    vocabulary file must be at ``path`` on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in bpe.slices(batches, 1):
            done = 0
            for ids, rows in encode_texts(texts, path):
                n = len(rows) - 1
                little, (data, starts) = ids.astype("<u4"), decode(ids, rows, path)
                r, s = rows.tolist(), starts.tolist()
                columns = [
                    batch.column(0).slice(done, n),
                    pa.array(np.diff(rows)),
                    pa.array([hashlib.sha256(little[a:b]).hexdigest() for a, b in zip(r, r[1:], strict=False)], pa.string()),
                    pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(s, s[1:], strict=False)], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                done += n
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return shared.texts(docs).mapInArrow(arrays.lean(run), schema + (", ids array<int>" if keep_ids else ""))


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); bytes that are not UTF-8 become the replacement sign; null ids are empty.

    Rows are independent, so repeated ones and null doc_ids do no harm; other columns are not read; a
    very long row is one row; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
            rows = np.zeros(len(size) + 1, np.int64)
            np.cumsum(size, out=rows[1:])
            data, starts = decode(np.asarray(lists.flatten()).astype(np.int64), rows, path)
            s = starts.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(s, s[1:], strict=False)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(arrays.lean(run), "doc_id long, text string")
