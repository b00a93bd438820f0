"""A text longer than a block and a slice of every operator, beside short ones."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm import brute
from tests.llm.test_operators import JSON, RANKS, by_id, encoding  # noqa: F401
from tidemark.llm import codec, fingerprints, jaccard_join, katz, line_dedup, mixing, quality, sharding, substring_dedup, token_counts

SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def texts():
    """1: 4.4 MB of lines that do not repeat; 2: its last 500 bytes between other signs; 3: nearly 1; 5: short."""
    rnd = random.Random(5)
    lines = [" ".join(f"{rnd.randrange(10**6)}é" for _ in range(60)) for _ in range(8600)]
    whole = "\n".join(lines)
    end = whole.encode()[-500:].decode(errors="ignore")
    return {1: whole, 2: f"<{end}>", 3: "\n".join(lines[:-1]), 5: "a b c d e f g h i j k l"}


@pytest.fixture(scope="module")
def table(spark, texts):
    return spark.createDataFrame([(d, t, "s") for d, t in texts.items()], SCHEMA).repartition(2).cache()


def test_tokens(table, texts, encoding):  # noqa: F811
    found, counted, tokenizer = by_id(codec.encode(table, RANKS)), by_id(token_counts.count_tokens(table, JSON)), Tokenizer.from_file(JSON)
    for d, text in texts.items():
        ids = encoding.encode_ordinary(text)
        assert found[d].ids_sha256 == brute.sha(np.array(ids, "<u4").tobytes()) and found[d].decoded_sha256 == brute.sha(text)
        assert counted[d].n_tokens == len(tokenizer.encode(text, add_special_tokens=False).ids) and counted[d].n_bytes == len(text.encode())


def test_lines_words_and_sizes(table, texts):
    cut, judged, taken = by_id(line_dedup.digest(table)), by_id(quality.judge(table)), by_id(mixing.copies(table))
    placed, scored, sketched = by_id(sharding.shard_documents(table)), by_id(katz.score(table)), by_id(fingerprints.with_next(table))
    for d, text in texts.items():
        n = len(brute.WORD.findall(text))
        assert (cut[d].n_lines, cut[d].n_dropped, cut[d].kept_sha256) == (text.count("\n") + 1, 0, brute.sha(text))
        assert judged[d].n_words == taken[d].size == n and scored[d].n_tokens == n + 1
        assert judged[d].kept and placed[d].size == len(text.encode()) + 1 and sketched[d].n_chars == len(text)


def test_long_text_that_repeats(spark):
    """40,000 words: with a passage of 2,500 words twice it goes by the longest repeat, with one of 900 it stays."""
    rnd = random.Random(8)
    own = [f"{rnd.randrange(10**7)}é" for _ in range(40_000)]
    texts = {0: own, 1: [*own[:37_000], *own[:2_500]], 2: [*own[:38_000], *own[:900]]}
    made = {d: " ".join(w) for d, w in texts.items()}
    found = by_id(quality.judge(spark.createDataFrame(list(made.items()), "doc_id long, text string")))
    for d, t in made.items():
        r = found[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == brute.quality_by_windows(t)
    assert [found[d].kept for d in range(3)] == [True, False, True] and not found[1].base_failed


def test_links(table, texts):
    found = by_id(jaccard_join.link_classes(table))
    for d, text in texts.items():
        assert found[d].n_shingles == len(brute.shingles(text)) and found[d].component_id == (1 if d == 3 else d)


def test_substrings(spark, texts):
    pair = spark.createDataFrame([(d, texts[d]) for d in (1, 2)], "doc_id long, text string")
    for d, r in by_id(substring_dedup.cut_repeats(pair)).items():
        shared = len(texts[2].encode()) - 2
        left = texts[1].encode()[:-shared] if d == 1 else b"<>"
        assert (r.n_removed, r.n_spans, r.kept_sha256) == (shared, 1, brute.sha(left))
