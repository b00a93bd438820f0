"""Each operator against its contract by brute force, over copies, nulls, ties, odd and empty tables."""

import base64
import hashlib
import math
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tidemark.llm import arrays, bpe, codec, components, fingerprints, jaccard_join, katz, line_dedup, mixing, quality, sharding, substring_dedup, token_counts

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


# 1 ---------------------------------------------------------------------------------------------


def test_fingerprints(docs, rows):
    found = by_id(fingerprints.with_next(docs))
    assert len(found) == len(rows)
    errors = []
    for doc, chars, edited, near, following in brute.fingerprints(rows):
        r = found[doc]
        assert (r.n_chars, r.edited_sha256) == (chars, edited)
        errors += [abs(r.near_edited - near), abs(r.near_next - following)]
    assert max(errors) < 0.15 and sum(errors) / len(errors) < 0.02
    same = {}
    for doc, text in rows:
        assert same.setdefault(text or "", found[doc].fingerprint) == found[doc].fingerprint


def test_fingerprint_odd_tables(odd, empty, spark):
    assert fingerprints.with_next(odd).count() == 5 and fingerprints.with_next(empty).count() == 0
    alone = fingerprints.with_next(spark.createDataFrame([(7, "a b")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0


def test_sketch_estimates_and_merge(spark):
    rng = np.random.default_rng(4)
    one, other = rng.integers(0, 2**63, 4000).astype(np.uint64), rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = np.unique(np.concatenate([one, other[:2000]])), np.unique(other)
    sketch = lambda s: s[:256]
    assert abs(fingerprints.resemblance(sketch(a), sketch(b)) - 2000 / 8000) < 0.1
    assert abs(fingerprints.containment(sketch(b), sketch(a)) - 0.5) < 0.2
    whole = np.union1d(a, b)
    assert np.array_equal(fingerprints.merge(sketch(a), sketch(b)), whole[:256])
    parts = spark.createDataFrame([(1, fingerprints.encode(sketch(a))), (1, fingerprints.encode(sketch(b))), (2, fingerprints.encode(a[:3])), (3, "")], "k int, fingerprint string")
    merged = {r.k: fingerprints.decode(r.fingerprint) for r in fingerprints.merge_fingerprints(parts, "k").collect()}
    assert np.array_equal(merged[1], whole[:256]) and np.array_equal(merged[2], a[:3]) and len(merged[3]) == 0


# 2 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("batches", [1, 4, 5])
def test_line_dedup(docs, rows, batches):
    found = by_id(line_dedup.digest(docs, batches=batches))
    for doc, (n, dropped, kept) in brute.lines(rows).items():
        assert (found[doc].n_lines, found[doc].n_dropped, found[doc].kept_sha256) == (n, dropped, brute.sha(kept))
    assert any(r.n_dropped for r in found.values())


def test_line_runs_levels_and_unseen(spark):
    runs = line_dedup.LineRuns(spark)
    for k in range(5):
        batch = spark.createDataFrame([(k, f"{'x' * 45}{i}\n{'y' * 50}") for i in range(k, k + 2)], "doc_id long, text string")
        hashed = line_dedup.hashed_lines(batch, 40)
        new = runs.unseen(hashed).select("h1", "h2").distinct().count()
        assert new == (3 if k == 0 else 1)
        runs.add(hashed)
    assert [len(level) for level in runs.first.levels] == [1, 0, 1] and [len(level) for level in runs.again.levels] == [0, 0, 1]
    # runs lie in buckets: neither their merge nor the look-up of a batch that does so shuffles
    plan = runs.unseen(runs.again.runs()[0])._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "Exchange hashpartitioning" not in plan
    assert "Exchange hashpartitioning" not in runs.counts()._jdf.queryExecution().executedPlan().toString()
    assert runs.counts().agg(F.max("n_docs")).first()[0] == 10


def test_line_dedup_odd_tables(odd, empty):
    assert line_dedup.digest(odd).count() == 5 and line_dedup.digest(empty).count() == 0
    assert line_dedup.dedup(odd).columns == odd.columns


def clashing(spark, extra):
    """A table whose further columns have names that operators use inside."""
    line = "this line is longer than forty characters, surely"
    near = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"{line}\nown{i} words{i} of{i} number{i} that{i} differ{i}", "s", *[f"{c}{i}" for c in extra]) for i in range(6)] + [(10, near, "t", *extra), (11, near + " more", None, *extra)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in extra))


def test_clashing_names(spark):
    names = "drop drop_id drop_crc n_lines n_dropped row gone_id gone_text text_hash component node of size source_size target copies text_md5 first __id".split()
    table = clashing(spark, names)
    own = {r.doc_id: r for r in table.collect()}
    cut = line_dedup.dedup(table)
    assert cut.columns == table.columns
    for r in cut.collect():
        assert r[3:] == own[r.doc_id][3:]
        assert r.text == (own[r.doc_id].text if r.doc_id >= 5 else own[r.doc_id].text.split("\n")[1])
    kept = jaccard_join.keep_one(table)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 10] and all(r == own[r.doc_id] for r in kept.collect())
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns and all(r == own[r.doc_id] for r in mixed.collect())
    assert quality.keep(table).columns == table.columns
    for made in (mixing.copies(table), codec.encode(table, RANKS), token_counts.count_tokens(table, JSON), katz.score(table), fingerprints.with_next(table), substring_dedup.cut_repeats(table), sharding.shard_documents(table), jaccard_join.link_classes(table), quality.judge(table)):
        assert made.count() == 8
    with pytest.raises(ValueError, match="source"):
        mixing.mix(table.drop("source"))


# 3 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("length", "gram", "short", "hot"), [(400, 128, 256, 4096), (60, 30, 60, 4096), (60, 20, 44, 4)])
def test_substrings(docs, rows, monkeypatch, length, gram, short, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    found = by_id(substring_dedup.cut_repeats(docs, length, gram, short))
    under = brute.substrings(rows, short)
    for doc, wanted in brute.substrings(rows, length).items():
        r = found[doc]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == wanted and r.n_shared == under[doc][1]


def test_a_passage_that_most_documents_share(spark, monkeypatch):
    # whole, cut at either end, and at the edges of texts: more than a task may get of one gram
    monkeypatch.setattr(substring_dedup, "HOT", 6)
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = word(150)
    rows = [(i, word(rnd.randrange(0, 50)) + passage[rnd.choice([0, 0, 0, 30, 60]) : rnd.choice([150, 150, 120, 90])] + word(rnd.randrange(0, 50))) for i in range(60)]
    rows += [(100, passage), (101, passage), (102, "x" * 300), (103, "y" + "x" * 200)]
    found = by_id(substring_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 60, 20, 40))
    under = brute.substrings(rows, 40)
    for doc, wanted in brute.substrings(rows, 60).items():
        r = found[doc]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == wanted and r.n_shared == under[doc][1]


def test_substrings_of_few_letters(spark):
    rnd = random.Random(6)
    rows = [(i, "".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 60)))) for i in range(70)] + [(99, "ab" * 40)]
    found = by_id(substring_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 9, 4))
    for doc, wanted in brute.substrings(rows, 9).items():
        assert (found[doc].n_bytes, found[doc].n_removed, found[doc].n_spans, found[doc].kept_sha256) == wanted


def test_stretches_that_repeat_themselves(spark, monkeypatch):
    # periodic stretches of all lengths, alone, shared, cut, inside other text, and of two periods in a row
    rnd = random.Random(12)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    periods = [word(n) for n in (1, 3, 7, 12)]
    rows = [(i, word(rnd.randrange(0, 40)) + rnd.choice(periods) * rnd.randrange(1, 40) + rnd.choice(["", rnd.choice(periods) * rnd.randrange(1, 30)]) + word(rnd.randrange(0, 40))) for i in range(80)]
    rows += [(90 + i, (p * 300)[:n]) for i, (p, n) in enumerate((p, n) for p in periods for n in (44, 45, 60, 61, 72, 300))]
    for hot in (4096, 5):
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        found = by_id(substring_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 60, 20, 44))
        under = brute.substrings(rows, 44)
        for doc, wanted in brute.substrings(rows, 60).items():
            r = found[doc]
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == wanted and r.n_shared == under[doc][1]


def test_merge_of_front_coded_runs():
    rnd = random.Random(8)

    def coded(keys):
        last = b""
        for k in keys:
            same = substring_dedup.common(last, k, 0)
            yield same, k[same:], ()
            last = k

    for _ in range(200):
        runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 12))) for _ in range(rnd.randrange(0, 12))) for _ in range(rnd.randrange(0, 7))]
        merged = list(substring_dedup.merge_runs([coded(r) for r in runs]))
        assert [k for _, k, _ in merged] == sorted(sum(runs, []))
        last = b""
        for same, key, _ in merged:
            assert same == substring_dedup.common(last, key, 0)
            last = key


def test_large_groups_equal_small_ones(monkeypatch):
    rnd = random.Random(9)
    suffixes = sorted("".join(rnd.choice("ab") for _ in range(rnd.randrange(4, 9))).encode() for _ in range(40))
    before = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 5))) for _ in suffixes]
    right = [0] + [substring_dedup.common(a, b, 0) for a, b in zip(suffixes, suffixes[1:], strict=False)]
    flat = lambda found: [sorted({d for low, high in r for d in range(low, high + 1)}) for r in found]
    for low, high in ((0, 4), (1, 3), (2, 2)):
        monkeypatch.setattr(substring_dedup, "PAIRWISE", 48)
        one = flat(substring_dedup.repeated_offsets(right, before, 7, low, high))
        monkeypatch.setattr(substring_dedup, "PAIRWISE", 2)
        assert flat(substring_dedup.repeated_offsets(right, before, 7, low, high)) == one


def test_substrings_odd_tables(odd, empty):
    assert substring_dedup.cut_repeats(odd, 8, 4).count() == 5 and substring_dedup.cut_repeats(empty).count() == 0


# 4 ---------------------------------------------------------------------------------------------


def test_quality(docs, rows):
    found = by_id(quality.judge(docs))
    for doc, text in rows:
        r = found[doc]
        own = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
        assert own == brute.quality_by_windows(text) and (len(text or "") >= 4000 or own == brute.quality(text))
    assert quality.keep(docs).columns == docs.columns
    assert {r.doc_id for r in quality.keep(docs).collect()} == {d for d, r in found.items() if r.kept}


def test_suffix_repeats():
    rnd = random.Random(1)
    for _ in range(100):
        lines = [[rnd.randrange(rnd.choice([1, 2, 5])) for _ in range(rnd.randrange(0, 30))] for _ in range(5)]
        found = quality.repeats(np.array(sum(lines, []), np.int64), np.cumsum([0, *map(len, lines)]))
        assert found.tolist() == [x for line in lines for x in brute.longest_repeats(line)]


def twice(repeats, length, rest):
    """A text of so many passages, each twice, and other words between."""
    passages = [[f"p{k}w{i}" for i in range(length)] for k in range(repeats)]
    words = [w for k, p in enumerate(passages) for w in [*p, f"between{k}"]]
    return " ".join([*words, *[f"x{i}" for i in range(rest)], *[w for k, p in enumerate(passages) for w in [*p, f"after{k}"]]])


def test_each_limit_rejects_by_itself():
    texts = [twice(1, 60, 1200), twice(4, 30, 1500), twice(1, 1500, 17000), twice(1, 13, 200), twice(1, 30, 1500), twice(0, 0, 300)]
    m = quality.measure(pa.array(texts), quality.Rules())
    assert not m["base_failed"].any()
    n, covered, longest = m["n_words"], m["repeat_covered"], m["repeat_longest"]
    assert (covered > 0.10 * n).tolist() == [False, True, True, False, False, False]
    assert (longest > np.maximum(50, 0.04 * n)).tolist() == [True, False, True, False, False, False]
    assert m["kept"].tolist() == [False, False, False, True, True, True]
    assert m["kept"].tolist() == [brute.quality_by_windows(t)[-1] for t in texts]


def test_quality_odd_tables(odd, empty):
    assert quality.judge(odd).count() == 5 and quality.judge(empty).count() == 0 and quality.keep(empty).count() == 0


# 5, 8 ------------------------------------------------------------------------------------------


@pytest.fixture(scope="session")
def encoding():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec(docs, rows, encoding):
    found = by_id(codec.encode(docs, RANKS))
    for doc, text in rows:
        ids, r = encoding.encode_ordinary(text or ""), found[doc]
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == brute.sha(np.array(ids, "<u4").tobytes()) and r.decoded_sha256 == brute.sha(text or "")
    back = {r.doc_id: r.text for r in codec.decode_ids(codec.encode(docs, RANKS), RANKS).collect()}
    assert back == {d: t or "" for d, t in rows}


def test_token_counts(docs, rows):
    tokenizer = Tokenizer.from_file(JSON)
    found = by_id(token_counts.count_tokens(docs, JSON))
    for doc, text in rows:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert (found[doc].n_bytes, found[doc].n_tokens, found[doc].over_limit) == (len((text or "").encode()), n, n > 1024)


def test_tokens_of_all_kinds_of_signs(encoding):
    rnd = random.Random(3)
    pool = [*"  \n\t'''stmdrevl  abAZ09é.,!#<|>　\x85 ", "<|endoftext|>", "'re", "'ll", " '", "aaaa", "the ", "😀", "中", "ß", "٣", "\x1c", "​", "Ⅷ", "²"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 60))) for _ in range(1500)]
    texts += ["".join(chr(c) for c in (rnd.randrange(1, 0x110000) for _ in range(30)) if not 0xD800 <= c < 0xE000) for _ in range(300)]
    blocks = [(d, o) for _, _, d, o in bpe.arrays.blocks(pa.array(texts), 1 << 14)]
    found = [ids[a:b].tolist() for ids, at in codec.encode_texts(blocks, RANKS) for a, b in zip(at, at[1:], strict=False)]
    assert found == [encoding.encode_ordinary(t) for t in texts]
    tokenizer = Tokenizer.from_file(JSON)
    counts = np.concatenate(list(token_counts.count_texts(blocks, JSON))).tolist()
    assert counts == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_merges_out_of_order():
    # "abc" has a lower rank than "ab": merging a pair makes a pair that comes first
    ranks = {bytes([b]): b + 10 for b in range(256)} | {b"abc": 0, b"ab": 1, b"cd": 2}
    triples = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    left, right, rank = np.array(triples).T
    merges = bpe.Merges(np.arange(256, dtype=np.int32) + 10, left, right, rank, np.arange(300, dtype=np.int32))
    words = [b"abcd", b"abab", b"ababcd", b"x"]
    size = np.array(list(map(len, words)))
    ids, count, merged = merges.replay(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
    at = np.cumsum(count) - count
    assert [ids[a : a + n].tolist() for a, n in zip(at, count, strict=True)] == [[0, 110], [1, 1], [1, 0, 110], [130]]
    assert merged.tolist() == [2, 2, 3, 0]


def test_token_odd_tables(odd, empty):
    for table, n in ((odd, 5), (empty, 0)):
        assert codec.encode(table, RANKS).count() == n and token_counts.count_tokens(table, JSON).count() == n


def thue_morse():
    """Two words of 2,048 bytes that sums of powers modulo 2**64 cannot tell apart, whatever the base."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def undone_step():
    """Two words of 16 letters with one key: the second eight bytes undo what differs after the first eight."""
    key = lambda x: bpe.arrays._span_key(x.ravel(), np.arange(0, x.size, x.shape[1]), np.arange(0, x.size, x.shape[1]) + x.shape[1])
    rnd = np.random.default_rng(5)
    first = rnd.integers(97, 123, (1 << 20, 8), np.uint8)
    # the state after eight bytes, in a word of 16
    length = bpe.arrays.mix(np.array([16], np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    state = bpe.arrays.mix((length ^ first.view("<u8").ravel()) * np.uint64(0x9E3779B97F4A7C15))
    second = np.frombuffer(b"poumzgdh", "<u8") ^ state[0] ^ state
    letters = second.view(np.uint8).reshape(-1, 8)
    other = next(i for i in np.flatnonzero((letters > 32).all(1) & (letters < 127).all(1)).tolist() if i and not ((letters[i] > 64) & (letters[i] < 91)).any())
    words = np.array([[*first[0], *letters[0]], [*first[other], *letters[other]]], np.uint8)
    assert len(set(key(words).tolist())) == 1
    return words[0].tobytes().decode(), words[1].tobytes().decode()


def test_sip_hash():
    """Against the rounds written out on Python's integers."""
    mask = (1 << 64) - 1
    turn = lambda x, n: ((x << n) | (x >> (64 - n))) & mask

    def rounds(a, b, c, d, n):
        for _ in range(n):
            a = (a + b) & mask
            b = turn(b, 13) ^ a
            a = turn(a, 32)
            c = (c + d) & mask
            d = turn(d, 16) ^ c
            a = (a + d) & mask
            d = turn(d, 21) ^ a
            c = (c + b) & mask
            b = turn(b, 17) ^ c
            c = turn(c, 32)
        return a, b, c, d

    rows = np.random.default_rng(3).integers(0, 2**64, (5, 9000), np.uint64)
    found = bpe.arrays.sip_hash(list(rows))
    for i in (0, 1, 8191, 8192, 8999):
        a, b, c, d = 0x736F6D6570736575, 0x646F72616E646F6D ^ 1, 0x6C7967656E657261, 0x7465646279746573 ^ 1
        for m in [*rows[:, i].tolist(), 40 << 56]:
            a, b, c, d = rounds(a, b, c, d ^ m, 1)
            a ^= m
        a, b, c, d = rounds(a, b, c ^ 255, d, 3)
        assert int(found[i]) == a ^ b ^ c ^ d


@pytest.mark.parametrize("pair", [thue_morse, undone_step])
def test_hostile_words(spark, encoding, pair):
    one, other = pair()
    size = len(one)
    assert len(set(bpe.arrays.span_hash(np.frombuffer((one + other).encode(), np.uint8), np.array([0, size]), np.array([size, 2 * size])).tolist())) == 2
    rows = [(0, one), (1, other), (2, f"{one} {other} {one}"), (3, f"{one}\n{other}\n{one}"), (4, f"{other} {one} {other}")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({r.fingerprint for r in fingerprints.fingerprint(table).collect()}) == 4  # 2 and 3 have the same words
    judged = by_id(quality.judge(table))
    assert [judged[d].n_dup_lines for d in range(5)] == [0, 0, 0, 1, 0]
    for r in codec.encode(table, RANKS).collect():
        assert r.ids == encoding.encode_ordinary(dict(rows)[r.doc_id])
    tokenizer = Tokenizer.from_file(JSON)
    for r in token_counts.count_tokens(table, JSON).collect():
        assert r.n_tokens == len(tokenizer.encode(dict(rows)[r.doc_id], add_special_tokens=False).ids)
    assert {r.doc_id: r.component_id for r in jaccard_join.link_classes(table).collect()} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 4}
    long = spark.createDataFrame([(0, " ".join([one] * 7)), (1, " ".join([other] * 7))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.link_classes(long).collect()} == {0: 0, 1: 1} and jaccard_join.keep_one(long).count() == 2
    wanted = brute.scores(rows, katz.discounts)[0]
    for r in katz.score(table).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == wanted[r.doc_id][:4] and r.score == pytest.approx(wanted[r.doc_id][5], rel=1e-6)


def test_pieces_that_share_a_hash(monkeypatch):
    words = [b"one", b"two", b"six", b"one", b"seven", b"two"]
    size = np.array(list(map(len, words)))
    monkeypatch.setattr(bpe.arrays, "_span_key", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    where, which = bpe.arrays.distinct_spans(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
    assert where.tolist() == [0, 1, 2, 4] and which.tolist() == [0, 1, 2, 0, 3, 1]


# 6 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz(docs, rows, order):
    found = by_id(katz.score(docs, order=order))
    wanted, word, unknown, after, chance = brute.scores(rows, katz.discounts, order)
    for doc, (held, n, known, total, base, score) in wanted.items():
        r = found[doc]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-6) and r.score == pytest.approx(score, rel=1e-6)
    for longer in after[1:]:
        for history in list(longer)[:20]:  # each distribution adds up to one
            assert sum(chance(history, w) for w in word) + chance(history, "\x00") == pytest.approx(1, abs=1e-9)


def test_katz_by_hand(spark):
    # learnt from: a b a b a c (doc ids of the training fold), too few for Good-Turing, so half an event goes from each count
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1][:1] + [next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)]
    table = spark.createDataFrame([(ids[0], "a b a b a c"), (ids[1], "a b b")], "doc_id long, text string")
    # P(a) = 2.5/7, P(b) = 1.5/7, P(c) = P(end) = 0.5/7, unknown 2/7; pairs: start-a 1, a-b 2, b-a 2, a-c 1, c-end 1
    a, b, end = 2.5 / 7, 1.5 / 7, 0.5 / 7
    b_after_b, end_after_b = 0.5 / 2 / (1 - a) * b, 0.5 / 2 / (1 - a) * end
    held = by_id(katz.score(table, order=2))[ids[1]]
    assert 10**held.score == pytest.approx(0.5 / 1 * (1.5 / 3) * b_after_b * end_after_b)
    # triples: start-start-a 1, start-a-b 1, a-b-a 2, b-a-b 1, b-a-c 1, a-c-end 1; a b has only a after it, b b nothing
    held = by_id(katz.score(table, order=3))[ids[1]]
    a_after_b = 1.5 / 2
    assert 10**held.score == pytest.approx(0.5 * 0.5 * (0.5 / 2) / (1 - a_after_b) * b_after_b * end_after_b)
    with pytest.raises(ValueError, match="order"):
        katz.score(table, order=0)


def test_distinct_beyond_32_bits():
    rows = np.array([[5, 1 << 40, 5, 7, 1 << 40], [2, 3, 2, 1 << 33, 3]])
    first, which = katz._distinct(*rows)
    assert first.tolist() == [0, 3, 1] and which.tolist() == [0, 2, 0, 1, 2]
    small = np.array([[5, 9, 5, 7, 9], [2, 3, 2, 4, 3]])
    assert [x.tolist() for x in katz._distinct(*small)] == [[0, 3, 1], [0, 2, 0, 1, 2]]


@pytest.mark.parametrize("widths", [(3,), (40,), (3, 5), (20, 36), (20, 40), (40, 40), (2, 2, 2), (30, 30, 30)])
def test_distinct_by_one_key(widths, monkeypatch):
    """Columns of up to 64 bits together are sorted as one key, with the rows' numbers in it where they fit."""
    if sum(widths) <= 64:
        monkeypatch.setattr(np, "lexsort", None)
    rng = np.random.default_rng(1)
    for n in (0, 1, 300):
        columns = [rng.integers(0, 4, n) * ((1 << w) // 4 - 1) for w in widths]
        first, which = katz._distinct(*columns)
        rows = list(zip(*(c.tolist() for c in columns), strict=True))
        assert [rows[i] for i in first] == sorted(set(rows)) and [rows[first[i]] for i in which] == rows


@pytest.mark.parametrize("widths", [(40, 40), (30, 30, 30), (22, 22, 28)])
def test_wide_columns_are_sorted_by_their_ranks(widths, monkeypatch):
    """Numbers of words take more bits as a corpus grows; they are still sorted as keys with the rows' numbers in them."""
    monkeypatch.setattr(np, "lexsort", None)
    monkeypatch.setattr(np, "argsort", None)
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 4, 5000) * ((1 << w) // 4 - 1) for w in widths]
    first, which = katz._distinct(*columns)
    rows = list(zip(*(c.tolist() for c in columns), strict=True))
    assert [rows[i] for i in first] == sorted(set(rows)) and [rows[first[i]] for i in which] == rows


@pytest.mark.parametrize("alike", [False, True])
def test_a_slice_hashes_each_word_once(alike, monkeypatch):
    texts = ["Monday  tuesdays WEDNESDAY tuesdays", "", "a thursday-and-a-long-friday thursday-and-b-long-friday monday", "\x00 \x00\x00 tuesdays thursday-and-a-long-friday", " wednesday"]
    data, offsets = arrays.utf8(pa.array(texts))
    starts, ends, first = arrays.words(arrays.lower(data), offsets)
    wanted = np.insert(arrays.span_hash(arrays.lower(data), starts, ends), first[1:], katz.END)
    if alike:  # keys find equal words, their bytes decide
        monkeypatch.setattr(arrays, "_span_key", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    hashed, blake2b = [], hashlib.blake2b
    monkeypatch.setattr(hashlib, "blake2b", lambda x, **how: (hashed.append(x), blake2b(x, **how))[1])
    hashes, which, size = katz._vocabulary(data, offsets)
    assert np.array_equal(hashes[which], wanted) and len(set(hashes.tolist())) == len(hashes) and size.tolist() == [5, 1, 5, 5, 2]
    assert sorted(hashed) == sorted(w.encode() for w in {w for t in texts for w in t.lower().split(" ")} if len(w) > 7)


def test_values_that_share_their_high_bits():
    values = np.array([1 << 60, (1 << 60) + 1, 1 << 60, 7, (1 << 60) + 1, 3], np.uint64)
    first, which = katz._alike(values)
    assert np.array_equal(values[first][which], values) and len(first) == 4


def test_histories_come_as_kinds():
    """Most histories have the counts of many others, so slices get few rows of counts and unpack no column for each."""
    columns = [np.array([1, 500, 0, 1, 1, 500, 2]), np.array([1, 9, 0, 1, 1, 8, 0])]
    rows, kind = katz._kinds(columns)
    assert np.array_equal(rows[kind], np.stack(columns, axis=1)) and len(rows) == 5
    own, place = katz._only(rows, kind[[1, 3, 4]])
    assert len(own) == 2 and np.array_equal(own[place], [[500, 9], [1, 1], [1, 1]])


def test_katz_beats_words_alone_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = katz.score(docs).where("held_out").agg(F.sum("base_score").alias("base"), F.sum("score").alias("score")).first()
    assert held.score > held.base


def test_katz_odd_tables(odd, empty, spark):
    assert katz.score(odd).count() == 5 and katz.score(empty).count() == 0
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = katz.score(spark.createDataFrame([(only_held, "a b")], "doc_id long, text string")).first()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.score == 0


@pytest.mark.parametrize("order", [1, 2, 3])
def test_stored_model(docs, rows, odd, empty, tmp_path, order):
    """Trained on what score() trains on, a stored model gives all documents the same scores."""
    wanted, path = by_id(katz.score(docs, order=order)), f"file://{tmp_path}/model"
    katz.train(docs.where(~F.col("doc_id").isin([d for d, r in wanted.items() if r.held_out])), path, order)
    found = by_id(katz.score_with(docs, path))
    assert len(found) == len(rows)
    for d, r in found.items():
        w = wanted[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (w.n_tokens, w.n_known, w.train_tokens)
        assert (r.base_score, r.score) == pytest.approx((w.base_score, w.score), rel=1e-9)
    assert katz.score_with(odd, path).count() == 5 and katz.score_with(empty, path).count() == 0
    if order == 2:
        katz.train(empty, f"file://{tmp_path}/nothing", order)
        assert {r.n_known for r in katz.score_with(odd, f"file://{tmp_path}/nothing").collect()} == {0}


def test_discounts():
    d = katz.discounts([0, 1000, 300, 150, 90, 60, 45])
    # worked out by hand: (k + 1) n[k + 1] / n[1] is 0.27
    assert d[1:] == pytest.approx([0.33 / 0.73, 0.48 / 0.73, 0.53 / 0.73, (5 / 6 - 0.27) / 0.73, 0.63 / 0.73]) and katz.discounts([0, 5, 0, 0, 0, 0, 0])[1] == 0.5
    assert np.array_equal(katz.unpack(katz.pack(np.array([0, 1, 2**63, 255]))), np.array([0, 1, 2**63, 255], np.uint64)) and len(katz.unpack(katz.pack(np.zeros(0)))) == 0


# 7 ---------------------------------------------------------------------------------------------


def test_mix(docs, rows):
    found = by_id(mixing.copies(docs))
    sizes, source = {}, lambda d: None if d % 5 == 0 else f"s{d % 4}"
    for doc, text in rows:
        n = len(brute.WORD.findall(text or ""))
        assert found[doc]["size"] == n
        sizes[source(doc)] = sizes.get(source(doc), 0) + n
    wanted = brute.targets(sizes)
    for doc, r in found.items():
        assert r.source_size == sizes[source(doc)] and r.target == pytest.approx(wanted[source(doc)])
        rate = min(2.0, r.target / r.source_size) if r.source_size else 0.0
        assert int(rate) <= r["copies"] <= -int(-rate // 1)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in mixing.mix(docs.repartition(3)).collect())


def test_mix_comes_near_its_targets(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.pmod("id", F.lit(40)) + 5).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    got = mixing.copies(docs).groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert all(abs(r.taken - r.target) < 0.05 * r.target for r in got)


def test_mix_spreads_as_expected(spark):
    # few long documents carry some sources here: within four standard deviations of the draws
    got = mixing.copies(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        f = min(2.0, rows[0].target / rows[0].source_size) % 1
        taken = sum(r["size"] * r["copies"] for r in rows)
        assert abs(taken - rows[0].target) <= 4 * (f * (1 - f) * sum(r["size"] ** 2 for r in rows)) ** 0.5 + 1


def test_targets_of_extremes(spark):
    for sizes in ({"a": 1, "b": 1000, None: 5}, {"a": 0, "b": 10}, {"é": 3, "z": 3, "Z": 3, "aa": 90}):
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r.source: r.target for r in mixing.targets(table, (3, 1, 2), 1.5, 2.0).collect()}
        assert found == pytest.approx(brute.targets(sizes))


def test_mix_odd_tables(odd, empty):
    assert mixing.copies(odd).count() == 5 and mixing.copies(empty).count() == 0 and mixing.mix(empty).count() == 0


# 9 ---------------------------------------------------------------------------------------------


def test_shards(docs, rows):
    found = by_id(sharding.shard_documents(docs))
    for doc, text in rows:
        r = found[doc]
        assert r["size"] == len((text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text or "").encode())
        assert r.law == "key" and 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
    slots = {}
    for r in found.values():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_rendezvous_winner(spark):
    """The shard of the highest score, every score computed here."""

    def score(shard, key, weight):
        seed = xxhash.xxh64_intdigest(struct.pack("<i", shard), 42)
        bits = xxhash.xxh64_intdigest(struct.pack("<q", key), seed) >> 12
        return -weight / math.log((bits + 0.5) / 2**52)

    keys = [*range(-50, 300), 2**62, -(2**63)]
    table = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    for weights in ([1.0] * 16, [1.0] * 17, [1.0, 2.5, 0.5]):
        found = {r.doc_id: r.shard for r in sharding.assign(table, ["doc_id"], len(weights), weights).collect()}
        assert found == {k: max(range(len(weights)), key=lambda s: (score(s, k, weights[s]), -s)) for k in keys}
    whole = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard_documents(table.withColumn("text", F.lit("x"))).collect()}
    best = lambda k, n: max(range(n), key=lambda s: (score(s, k, 1.0), -s))
    assert whole == {k: (best(k, 16), best(k, 17)) for k in keys}


def test_large_ids_do_not_run_into_each_other():
    """Pairs of ids beyond 20 bits."""
    big = 1 << 20
    single = np.arange(256, dtype=np.int32)
    single[ord("b")], single[ord("c")] = big, 1
    merges = bpe.Merges(single, np.array([0, ord("a")]), np.array([5, big]), np.array([0, 1]), np.array([7, 8], np.int32))
    assert merges.lookup(np.array([ord("a"), ord("a") + 1]), np.array([big, 0])).tolist() == [1, -1]
    assert token_counts.Counter(merges).count(b"ab") == 1 and token_counts.Counter(merges).count(b"ac") == 2


def test_shard_weights(spark, tmp_path):
    keys = spark.range(20_000).withColumnRenamed("id", "k")
    count = {r.shard: r["count"] for r in sharding.assign(keys, ["k"], 3, [1, 2, 1]).groupBy("shard").count().collect()}
    assert abs(count[1] / 20_000 - 0.5) < 0.02 and abs(count[0] / 20_000 - 0.25) < 0.02
    sharding.write_shards(keys, str(tmp_path / "shards"), ["k"], 3)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 20_000


def test_shard_odd_tables(odd, empty):
    found = sharding.shard_documents(odd).collect()
    assert len(found) == 5 and len({(r.shard, r.slot) for r in found}) == 5 and sharding.shard_documents(empty).count() == 0


# 10 --------------------------------------------------------------------------------------------


def test_jaccard_classes(docs, rows):
    found = by_id(jaccard_join.link_classes(docs))
    wanted = brute.components(rows)
    assert {d: (r.n_shingles, r.component_id) for d, r in found.items()} == wanted
    kept = {r.doc_id for r in jaccard_join.keep_one(docs).collect()}
    assert kept == {d for d, (_, c) in wanted.items() if c == d}


def test_jaccard_chains_and_places_of_many(spark, monkeypatch):
    # chains: neighbours alike, ends not; and many that share much without being alike
    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 60])) for i in range(30)]
    shared = [f"s{i}" for i in range(30)]
    rows += [(100 + i, " ".join(shared + [f"o{i}x{rnd.randrange(12)}" for _ in range(7)])) for i in range(40)]
    rnd.shuffle(rows)
    found = by_id(jaccard_join.link_classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {d: (r.n_shingles, r.component_id) for d, r in found.items()} == brute.components(rows)


def test_count_tree_finds_all_within_its_bound():
    rng = np.random.default_rng(5)
    points = rng.poisson(2, (150, 64))
    points[100:] = points[:50] + rng.integers(0, 2, (50, 64)) * rng.integers(0, 2, (50, 1))
    sizes = points.sum(axis=1)
    q, p = jaccard_join.CountTree(points, sizes).search(points, sizes)
    bound = np.minimum(points[:, None], points[None]).sum(axis=2)
    wanted = np.argwhere(bound >= jaccard_join.least_overlap(sizes[:, None], sizes[None]))
    fits = [(a, b) for a, b in wanted.tolist() if 5 * min(sizes[a], sizes[b]) >= 4 * max(sizes[a], sizes[b])]
    assert sorted(fits) == sorted((a, b) for a, b in zip(q.tolist(), p.tolist(), strict=True) if 5 * min(sizes[a], sizes[b]) >= 4 * max(sizes[a], sizes[b]))


def test_components_of_paths(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 103), (103, 101), (7, 7), (200, 201)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(51)} | {100: 100, 101: 100, 103: 100, 200: 200, 201: 200}


def test_jaccard_odd_tables(odd, empty):
    assert jaccard_join.link_classes(odd).count() == 5 and jaccard_join.link_classes(empty).count() == 0
    assert jaccard_join.keep_one(empty).count() == 0


def test_sets_that_share_a_name():
    one, other = jaccard_join.names_of(np.array([1, 2], np.uint64)), jaccard_join.names_of(np.array([1, 3], np.uint64))
    assert len({*one, *other}) == 4
    assert jaccard_join.node_of(np.array([1, 2], np.uint64), frozenset([one[0]])) == one[1]


def test_keep_one_judges_rows_not_ids(spark, odd):
    kept = sorted(((r.doc_id, r.text) for r in jaccard_join.keep_one(odd).collect()), key=str)
    assert kept == sorted([(None, None), (1, "a b c d e f"), (1, "a b c d e f"), (1, "other words are here in this row")], key=str)
    near = [" ".join([f"n{i}" for i in range(60)] + [end]) for end in ("x", "y")]
    far = [" ".join(f"{c}{i}" for i in range(9)) for c in "pqr"]
    both = [" ".join([f"b{i}" for i in range(60)] + [end]) for end in ("x", "y")]
    same = [" ".join([f"m{i}" for i in range(60)] + [end]) for end in ("x", "y")]
    # a null id near an id, other null ids; an id with a linked and an unlinked text; a class of null ids; a class of one id
    rows = [(5, near[0]), (None, near[1]), (None, far[0]), (None, ""), (None, " "), (2, far[1]), (7, far[1]), (7, far[2]), (None, both[0]), (None, both[0]), (None, both[1]), (9, same[0]), (9, same[1])]
    found = [(r.doc_id, r.text) for r in jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    certain = [(5, near[0]), (None, far[0]), (None, ""), (None, " "), (2, far[1]), (7, far[2])]
    assert sorted((x for x in found if x[1] not in both + same), key=str) == sorted(certain, key=str)
    # of the others one text each, with the rows that repeat it
    left = [x for x in found if x[1] in both + same]
    assert sorted(left, key=str) in [sorted([(None, b)] * (1 + (b == both[0])) + [(9, m)], key=str) for b in both for m in same]
