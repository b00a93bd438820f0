"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import codec, fingerprints, jaccard_join, katz, line_dedup, mixing, prefix_trie, quality, sharding, substring_dedup, token_counts, vector_codes, word_codec

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(documents(spark, sf_dir))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.cut_repeats(documents(spark, sf_dir)).drop("kept")


def op4_suffix_array_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).drop("repeat_longest")


def op5_byte_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=False)


def op6_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(documents(spark, sf_dir))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.copies(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_classes(documents(spark, sf_dir))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_word_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_codec.encode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


def queries() -> dict[str, Query]:
    return {
        "op1_document_fingerprints": op1_document_fingerprints,
        "op2_line_dedup": op2_line_dedup,
        "op3_suffix_array_dedup": op3_suffix_array_dedup,
        "op4_suffix_array_quality": op4_suffix_array_quality,
        "op5_byte_bpe_codec": op5_byte_bpe_codec,
        "op6_katz_scores": op6_katz_scores,
        "op7_mix_sources": op7_mix_sources,
        "op8_token_counts": op8_token_counts,
        "op9_rendezvous_shards": op9_rendezvous_shards,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_vector_codes": op11_vector_codes,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_word_bpe_codec": op13_word_bpe_codec,
    }


_OP2_SQL = r"""
WITH lines AS (
    SELECT doc_id, pos, list_extract(parts, pos) AS line
    FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), keyed AS (
    SELECT doc_id, pos, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), hot AS (
    SELECT key, max(doc_id) AS max_doc FROM keyed WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AND k.doc_id <> h.max_doc AS gone
    FROM keyed k LEFT JOIN hot h ON k.key = h.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# a window of k words that stands twice in a text covers its words
_COVERED = """(
    SELECT doc_id, count(DISTINCT j) AS n FROM (
        SELECT doc_id, unnest(range(i, i + {k})) AS j FROM (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c
            FROM (SELECT doc_id, i, w[i:i + {k} - 1] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM docs)))
        WHERE c > 1) GROUP BY doc_id)"""

_OP4_SQL = f"""
WITH docs AS (SELECT doc_id, text, {_WORDS} AS w FROM documents
), five AS {_COVERED.format(k=5)}, long_repeat AS {_COVERED.format(k=20)}
, too_long AS (
    SELECT DISTINCT doc_id FROM (
        SELECT doc_id, count(*) OVER (PARTITION BY doc_id, win) AS c
        FROM (SELECT doc_id, w[i:i + k - 1] AS win FROM (
            SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT doc_id, w, floor(greatest(50, 0.04 * len(w)))::BIGINT + 1 AS k FROM docs))))
    WHERE c > 1
), line AS (
    SELECT doc_id, sum(n - 1)::BIGINT AS dup FROM (
        SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents)
        WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, x) GROUP BY doc_id
), base AS (
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
           (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))::BIGINT AS n_symbols,
           coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(five.n, 0)::BIGINT AS n_repeat_words, coalesce(long_repeat.n, 0)::BIGINT AS repeat_covered,
           too_long.doc_id IS NOT NULL AS long
    FROM docs d LEFT JOIN five USING (doc_id) LEFT JOIN long_repeat USING (doc_id) LEFT JOIN line USING (doc_id) LEFT JOIN too_long USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, repeat_covered,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND repeat_covered <= 0.1 * n_words AND NOT long AS kept
FROM base
"""

_OP7_SQL = f"""
WITH docs AS (SELECT doc_id, source, text, len({_WORDS})::BIGINT AS size FROM documents
), sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), weighted AS (
    SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM sizes
), filled AS (
    SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
           sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
    FROM weighted WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)
), levels AS (SELECT *, cap <= weight * (rest / open) AS is_full, rest / open AS level FROM filled
), targets AS (
    SELECT source, source_size, CASE WHEN is_full THEN cap ELSE least(cap, weight * max(CASE WHEN NOT is_full THEN level END) OVER ()) END AS target FROM levels
), rated AS (
    SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target / source_size) ELSE 0 END AS rate,
           (('0x' || substr(md5('7|' || doc_id || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS draw
    FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""

_OP10_SQL = f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, w[i:i + 4] AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, n
"""


_OP11_ROUND = """
, near{r} AS (
    SELECT key, label, p, any_value(x) AS x, min(d * 64 + e) AS best FROM (
        SELECT a.key, a.label, a.p, b.e, a.x, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(a.x, b.x)])::BIGINT AS d FROM parts a JOIN book{r} b ON a.p = b.p)
    GROUP BY key, label, p
), sums{r} AS (
    SELECT p, best % 64 AS e, j, sum(x[j]) AS s, count(*) AS n FROM (SELECT p, best, x, unnest(range(1, len(x) + 1)) AS j FROM near{r}) GROUP BY ALL
), book{next} AS (
    SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{r} b
    LEFT JOIN (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x FROM sums{r} GROUP BY p, e) m ON m.p = b.p AND m.e = b.e
)"""

_OP11_SQL = f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS key, vec_id, label, [floor(256::DOUBLE * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
    SELECT key, label, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x FROM (SELECT key, label, v, unnest(range(16)) AS p FROM kept)
), book0 AS (SELECT p, key - 1 AS e, x FROM parts WHERE key <= 64
){_OP11_ROUND.format(r=0, next=1)}{_OP11_ROUND.format(r=1, next=2)}{_OP11_ROUND.format(r=2, next=3)}
, coded AS (
    SELECT key, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM near2 GROUP BY key
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM kept JOIN coded USING (key)
"""


# crc32 of a short text, bit by bit
_CRC32 = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, [ascii(z)::UBIGINT FOR z IN string_split({text}, '')]),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda a, z: xor(a >> 1, (a & 1::UBIGINT) * 3988292384::UBIGINT))))"""

_OP12_SQL = f"""
WITH own AS (
    SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heirs AS (
    SELECT *, ({_CRC32.format(text="conv_id::VARCHAR")} % 4)::BIGINT AS h FROM own
), rebuilt AS (
    SELECT a.conv_id, list_concat(coalesce(b.ts[1:h], []), a.ts[h + 1:]) AS s FROM heirs a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20
), members AS (
    SELECT conv_id, d, s[1:d] AS k, len(s) = d AS ended FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT d, k, min(conv_id) AS conv_id, count(*) AS m, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ended), '') AS ends,
           CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(k[d].text, '[^\\x20\\x09-\\x0D]+')) END AS saved
    FROM members GROUP BY d, k
), kids AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), above AS (SELECT a AS d, k[1:a] AS k, saved, leaf FROM (
    SELECT n.k, n.saved, kids.n IS NULL AS leaf, unnest(range(n.d + 1)) AS a FROM nodes n LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k)
), sums AS (SELECT d, k, sum(saved) AS saved, count(*) FILTER (WHERE leaf) AS leaves FROM above GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.m AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, sums.leaves AS n_leaves,
       sums.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums ON sums.d = n.d AND sums.k = n.k LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k LEFT JOIN nodes p ON p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; the others are tested against brute force."""
    return {"op2_line_dedup": _OP2_SQL, "op4_suffix_array_quality": _OP4_SQL, "op7_mix_sources": _OP7_SQL, "op10_jaccard_join": _OP10_SQL, "op11_vector_codes": _OP11_SQL, "op12_prefix_trie": _OP12_SQL}
