"""BPE with word ends against the library, whose results it has to give."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from tokenizers.models import BPE

from tidemark.llm import catalog, word_codec

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, " \n", "<|endoftext|>", "a<|startoftext|>b<|endoftext|>", "<|endoftext|><|endoftext|>x", "don't we'll I'VE 're're 's' '", "'s's''s !'s", "a'\nt", "'r", "'l l", "''t",
    "ΑΣ Σ", "İstanbul", "café café", "12 345", "z" * 50_000, "ab" * 900, "😀" * 40, "a\x85b\x1cc​d", "Ɤ \U00016121\U00016121",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)), ids


def test_documents(spark, docs, rows, library):
    wanted = dict(rows)
    found = word_codec.encode(docs, PATH).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) == expected(library, wanted[r.doc_id])
    back = {r.doc_id: r.text for r in word_codec.decode_ids(word_codec.encode(docs, PATH), PATH).collect()}
    assert all(back[d] == library.decode(expected(library, t)[3], skip_special_tokens=False) for d, t in rows)


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = catalog.op13_word_bpe_codec(spark, folder).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found} == {d: expected(library, t)[:3] for d, t in texts.items()}


def test_odd_texts(spark, library, odd, empty):
    table = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").repartition(3)
    for r in word_codec.encode(table, PATH).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) == expected(library, ODD[r.doc_id])
    assert word_codec.encode(odd, PATH).count() == 5 and word_codec.encode(empty, PATH).count() == 0
    ids = spark.createDataFrame([(1, None), (1, []), (None, [3306, None, 999999, 49407])], "doc_id long, ids array<int>")
    assert sorted(r.text for r in word_codec.decode_ids(ids, PATH).collect()) == ["", "", "hello</w> <|endoftext|>"]


def test_few_letters_and_any_letters(library):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("anthers"[: 2 + i % 5]) for _ in range(rnd.randrange(200))) for i in range(150)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 0x3000), rnd.randrange(0x10000, 0x1FFF0)])) for _ in range(80)) for _ in range(150)]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    ids, at = word_codec.encode_rows(np.frombuffer(data, np.uint8), offsets, PATH)
    for t, a, b in zip(texts, at.tolist(), at[1:].tolist(), strict=False):
        assert ids[a:b].tolist() == expected(library, t)[3]


def test_vocabularies_with_ties_and_dead_ends():
    """Small vocabularies, where the longest match often fails, against merging by rank in the library."""
    rnd = random.Random(6)
    for _ in range(40):
        vocabulary = {t: i for i, t in enumerate([*"abc", *(f"{c}</w>" for c in "abc")])}
        merges, parts = [], list(vocabulary)
        while len(merges) < 14:
            a, b = rnd.choice([p for p in parts if not p.endswith("</w>")]), rnd.choice(parts)
            if a + b not in vocabulary:
                vocabulary[a + b] = len(vocabulary)
                merges.append((a, b))
                parts.append(a + b)
        own = word_codec.Encoder(vocabulary, merges, "</w>")
        theirs = Tokenizer(BPE(vocabulary, merges, end_of_word_suffix="</w>"))
        for _ in range(60):
            word = "".join(rnd.choice("aabc") for _ in range(rnd.randrange(1, 30)))
            assert own.encode(word.encode()) == theirs.encode(word).ids
    with pytest.raises(ValueError):
        word_codec.Encoder({"a": 0, "b": 1, "ab": 2, "aba": 3, "ba": 4}, [("ab", "a"), ("a", "b")], "</w>")
