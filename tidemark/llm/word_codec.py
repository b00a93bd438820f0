"""BPE with word ends: exact encoding by longest matches and backtracking, decoding by an offset table.

A sequence of tokens is the encoding of its bytes exactly if each two neighbours are the encoding of
theirs. So the encoder walks from longest match to longest match, which one pass of an Aho-Corasick
automaton finds for every place, takes a token if it is compatible with the one before, else a
shorter prefix that is a token, and steps back where there is none. A place that has failed once is
never tried again, so the time is linear in the text, also for words without an end.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from tidemark.llm import arrays, bpe, shared, token_counts

# Fixed value of the vocabulary file: what the words are.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Words whose ids, and pairs whose verdicts, a worker keeps.
KEPT = 1 << 18

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point, as the installed library's patterns have it."""
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    text, out = points.astype("<u4").tobytes().decode("utf-32-le"), np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for _, (start, end) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            out[points[start:end]] = kind
    return out


@functools.cache
def _doubtful() -> np.ndarray:
    """Code points of which Python's Unicode tables may say something else than the library's, or say it by context."""
    out, lower = np.zeros(0x110000, bool), normalizers.Lowercase()
    out[0x3A3] = True
    for c in map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))):
        out[ord(c)] |= unicodedata.category(c) == "Cn" or (not c.isascii() and c != c.lower() and lower.normalize_str(c) != c.lower())
    return out


def normalised(text: str) -> str:
    """Composed and lower-cased, each character by itself."""
    if _doubtful()[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
        return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text)
    return unicodedata.normalize("NFC", text).lower()


def normalised_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for rows of UTF-8; rows of ASCII by a table."""
    low = arrays.lower(data)
    wide = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data > 127, out=wide[1:])
    rows = np.flatnonzero(wide[offsets[1:]] > wide[offsets[:-1]])
    if not len(rows):
        return low, offsets
    parts, size, last = [], np.diff(offsets), 0
    for r in rows.tolist():
        own = normalised(data[offsets[r] : offsets[r + 1]].tobytes().decode()).encode()
        parts += [low[last : offsets[r]], np.frombuffer(own, np.uint8)]
        size[r], last = len(own), offsets[r + 1]
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(size, out=out[1:])
    return np.concatenate([*parts, low[last:]]), out


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and lengths of the words that PATTERN finds, none across rows, and each row's first."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    point, at = bpe.code_points(data)
    kind, n = _classes()[point], len(point)
    row = np.zeros(n + 3, bool)
    row[np.searchsorted(at, offsets)] = True
    row[n:] = True
    cut = row.copy()
    cut[1:n] |= kind[1:] != kind[:-1]
    cut[:n] |= kind == _NUMBER
    # contractions: an apostrophe that begins a word, then letters of the same row
    a = np.flatnonzero((point == 0x27) & cut[:n])
    a = a[~row[a + 1]]
    one = point[a + 1]
    two = np.where(row[a + 2], 0, point[np.minimum(a + 2, n - 1)])
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
    size[(np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))] = 2
    a, size = a[size > 0], size[size > 0]
    cut[a + 1] = False
    cut[a + 1 + size] = True
    first = np.flatnonzero(cut[: n + 1])
    first, end = first[:-1], first[1:]
    word = kind[first] != _SPACE
    at = np.append(at, len(data))
    starts, ends = at[first[word]], at[end[word]]
    return starts, ends - starts, np.searchsorted(starts, offsets)


class Encoder:
    """The tokens of a vocabulary: symbols are bytes, and bytes that end a word (256 and more)."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        signs = {sign: chr(b) for sign, b in bpe.byte_signs().items()}

        def symbols(token: str) -> str:
            inner = token.removesuffix(suffix)
            out = "".join(signs[c] for c in inner)
            return out if inner == token else out[:-1] + chr(256 + ord(out[-1]))

        self.text = {i: symbols(t) for t, i in vocabulary.items()}
        top = max(self.text) + 1
        self.rank, self.split, self.pairs = [-1] * top, [(-1, -1)] * top, {}
        for r, (a, b) in enumerate(merges):
            left, right, made = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if self.rank[made] >= 0 or made in (left, right) or any(len(self.text[x]) > 1 and self.rank[x] < 0 for x in (left, right)):
                raise ValueError("each token must come of one merge, of tokens made before")
            self.rank[made], self.split[made], self.pairs[left * top + right] = r, (left, right), r
        self.top, self.verdicts = top, {}
        good = [len(self.text.get(i, "")) == 1 for i in range(top)]
        for made in sorted((i for i in self.text if self.rank[i] >= 0), key=self.rank.__getitem__):
            left, right = self.split[made]
            good[made] = good[left] and good[right] and self._apart(left, right, self.rank[made])
        reached = [i for i in self.text if good[i]]
        ids = {self.text[i]: i for i in reached}
        self.size = [len(self.text.get(i, "")) for i in range(top)]
        self.shorter = [-1] * top
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for s, i in ids.items():
            self.automaton.add_word(s, i)
            self.shorter[i] = next((ids[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in ids), -1)
        self.automaton.make_automaton()
        #: Words that are one token, and words met before.
        self.whole = {bytes(ord(c) & 255 for c in s): [i] for s, i in ids.items() if ord(s[-1]) >= 256}
        self.known: dict[bytes, list[int]] = {}

    def _apart(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge of a rank below the limit crosses the border, when both sides are made anew.

        The later one of the merges that made the two sides is undone first; of equal ranks the
        leftmost was earlier.
        """
        rank, split, pairs, top = self.rank, self.split, self.pairs, self.top
        while True:
            r = pairs.get(left * top + right)
            if r is not None and r < limit:
                return False
            if rank[left] > rank[right]:
                limit = rank[left]
                left = split[left][1]
            elif rank[right] >= 0:
                limit = rank[right] + 1
                right = split[right][0]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side are the encoding of their bytes."""
        key = left * self.top + right
        found = self.verdicts.get(key)
        if found is None:
            if len(self.verdicts) >= KEPT:
                self.verdicts.clear()
            found = self.verdicts[key] = self._apart(left, right, len(self.rank))
        return found

    def encode(self, word: bytes) -> list[int]:
        """The ids of a word, as merging by rank gives them."""
        found = self.whole.get(word) or self.known.get(word)
        if found is not None:
            return found
        text = word[:-1].decode("latin-1") + chr(256 + word[-1])
        size, shorter, n = self.size, self.shorter, len(text)
        longest = [-1] * n
        for end, token in self.automaton.iter(text):
            longest[end + 1 - size[token]] = token  # later ends are longer
        out: list[int] = []
        failed: set[int] = set()
        at, token = 0, longest[0]
        while at < n:
            while token >= 0 and (at + size[token] in failed or (out and not self.compatible(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            else:
                failed.add(at)
                token = out.pop()
                at -= size[token]
                token = shorter[token]
        if n <= 64:
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[word] = out
        return out


@functools.cache
def encoder(path: str) -> tuple[Encoder, dict[bytes, int]]:
    """The encoder of a vocabulary file, and its special strings."""
    with open(path, encoding="utf-8") as source:
        whole = json.load(source)
    model, cut = whole["model"], whole["pre_tokenizer"]["pretokenizers"][0]
    if model["type"] != "BPE" or not model["end_of_word_suffix"] or cut["pattern"] != {"Regex": PATTERN}:
        raise ValueError(f"{path} is not a BPE vocabulary with word ends and the known pattern")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return Encoder(model["vocab"], merges, model["end_of_word_suffix"]), {t["content"].encode(): t["id"] for t in whole["added_tokens"]}


@functools.cache
def _tables(path: str) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Offset tables: what each id is in the decoded text, and its decimal digits, each with a space."""
    with open(path, encoding="utf-8") as source:
        whole = json.load(source)
    names = {i: t for t, i in whole["model"]["vocab"].items()} | {t["id"]: t["content"] for t in whole["added_tokens"]}

    def table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(t) for t in texts], np.int64)
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size

    top = max(names) + 1
    return table([f"{names[i]} ".encode() if i in names else b"" for i in range(top)]), table([b"%d " % i for i in range(top)])


def joined(ids: np.ndarray, rows: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[memoryview]:
    """For each row the table's entries of its ids, without the last space."""
    data, start, size = table
    whole = memoryview(data[arrays.ragged(start[ids], size[ids])])
    total = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(size[ids], out=total[1:])
    at = total[rows].tolist()
    for a, b in itertools.pairwise(at):
        yield whole[a : max(a, b - 1)]


def encode_rows(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a block of texts, and where each row's start."""
    own, special = encoder(path)
    parts, is_special, first = token_counts.split_special(data, offsets, list(special))
    marks = np.flatnonzero(is_special)
    named = [special[data[parts[i] : parts[i + 1]].tobytes()] for i in marks.tolist()]
    if named:  # their strings go; the parts around them are normalised each by itself
        keep = np.ones(len(data), bool)
        keep[arrays.ragged(parts[marks], parts[marks + 1] - parts[marks])] = False
        gone = np.zeros(len(data) + 1, np.int64)
        np.cumsum(~keep, out=gone[1:])
        data, parts = data[keep], parts - gone[parts]
    data, parts = normalised_rows(data, parts)
    starts, lengths, words = spans(data, parts)
    where, which = arrays.distinct_spans(data, starts, lengths)
    raw = data.tobytes()
    lists = [own.encode(raw[a : a + n]) for a, n in zip(starts[where].tolist(), lengths[where].tolist(), strict=True)]
    count = np.array([len(x) for x in lists], np.int64)
    flat = np.array(list(itertools.chain.from_iterable(lists)), np.int64)
    ids = flat[arrays.ragged((np.cumsum(count) - count)[which], count[which])]
    total = np.zeros(len(which) + 1, np.int64)
    np.cumsum(count[which], out=total[1:])
    bounds = total[words]
    if named:
        ids = np.insert(ids, bounds[marks], named)
        bounds = bounds + np.searchsorted(marks, np.arange(len(bounds)))
    return ids, bounds[first]


def encode(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), ids_sha256, decoded_sha256 of every document: a map without shuffle.

    A null text is empty: no ids, and the hashes of the empty string. Repeated rows encode alike; of
    equal ranks the leftmost pair merges first. The file's special strings in a text are single ids.
    Other columns are not read, so their names cannot clash. A very long text is one row, handled
    alone, in linear time also without white space. An empty table gives an empty result. The
    vocabulary file must be at ``path`` on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in arrays.blocks(batch.column(1)):
                ids, rows = encode_rows(data, offsets, path)
                names, digits = _tables(path)
                columns = [
                    batch.column(0).slice(start, end - start),
                    pa.array(np.diff(rows)),
                    pa.array([hashlib.sha256(x).hexdigest() for x in joined(ids, rows, digits)], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in joined(ids, rows, names)], pa.string()),
                ]
                fields = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    fields.append("ids")
                yield pa.RecordBatch.from_arrays(columns, fields)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return shared.texts(docs).mapInArrow(arrays.lean(run), schema + (", ids array<int>" if keep_ids else ""))


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the tokens with a space between, as a file without a decoder has it.

    Null ids and no ids are an empty text. A null or unknown id is left out. Rows are independent, so
    repeated ones and null doc_ids do no harm; other columns are not read; a very long row is one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, _ = _tables(path)
        for batch in batches:
            lists = batch.column(1)
            rows = np.zeros(len(lists) + 1, np.int64)
            np.cumsum(np.asarray(lists.value_lengths().fill_null(0)), out=rows[1:])
            ids = np.asarray(lists.flatten().fill_null(-1)).astype(np.int64)
            good = (ids >= 0) & (ids < len(names[2]))
            kept = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(good, out=kept[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bytes(x).decode() for x in joined(ids[good], kept[rows], names)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(arrays.lean(run), "doc_id long, text string")
