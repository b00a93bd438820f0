"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard draws a score for a key; the highest score takes the record. A new shard only takes
records for itself, so growing from n to n + 1 shards moves about one record in n + 1, and no
record moves between old shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash values are cut to 52 bits, so that a double holds them exactly.
_BITS = 52


def rendezvous(key: Sequence[Column], weights: Sequence[float]) -> Column:
    """The shard (0, 1, ...) of a key: the largest ``-weight / ln(u)``, u uniform by key and shard.

    Null keys are a key like any other. The lower shard wins a tie of scores.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    draws = []
    for shard, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(shard), *key), 64 - _BITS)
        uniform = (bits.cast("double") + 0.5) / float(1 << _BITS)
        draws.append(F.struct((F.lit(-float(weight)) / F.ln(uniform)).alias("score"), F.lit(-shard).alias("shard")))
    best = draws[0] if len(draws) == 1 else F.greatest(*draws)
    return (-best["shard"]).cast("int")


def assign(rows: DataFrame, key: Sequence[str], shards: int, weights: Sequence[float] | None = None, into: str = "shard") -> DataFrame:
    """Add the shard of each row; equal keys share a shard. One projection, no shuffle. A column of the name ``into`` is replaced."""
    return rows.withColumn(into, rendezvous([F.col(k) for k in key], weights or [1.0] * shards))


def slots(rows: DataFrame, shard: str, order: Sequence[str], groups: int, into: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, ``groups`` tasks to a shard.

    A shard is cut into hash groups of the order columns; the groups' counts (shards x groups
    rows, whatever the input) give each group its first slot, and rows are numbered inside their
    group. Rows with equal order columns are interchangeable.
    """
    cut = rows.withColumn("__group", F.pmod(F.xxhash64(F.lit("slot"), *order), F.lit(groups)).cast("int"))
    count = cut.groupBy(shard, "__group").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(shard).orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    starts = count.select(F.col(shard).alias("__shard"), F.col("__group").alias("__of"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy(shard, "__group").orderBy(*order)
    numbered = cut.withColumn("__nth", F.row_number().over(inside) - 1)
    joined = numbered.join(F.broadcast(starts), (F.col(shard) == F.col("__shard")) & (F.col("__group") == F.col("__of")))
    return joined.withColumn(into, (F.col("__first") + F.col("__nth")).cast("long")).drop("__group", "__nth", "__shard", "__of", "__first")


def shard_documents(docs: DataFrame, shards: int = 16, groups: int = 64) -> DataFrame:
    """Shard documents by ``doc_id`` and number each shard's rows.

    A null text has size 1 and the checksum of the empty text; a null id is a key like any other;
    repeated rows share a shard and keep their own slots, in any order among themselves; of equal
    scores the lower shard wins. Other columns are not read, so their names cannot clash. A very long
    text is measured where it is read and goes no further. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = assign(assign(rows, ["doc_id"], shards), ["doc_id"], shards + 1, into="grown_shard")
    return slots(rows, "shard", ["doc_id", "text_crc32", "size"], groups)


def write_shards(rows: DataFrame, path: str, key: Sequence[str], shards: int, weights: Sequence[float] | None = None) -> None:
    """Write rows as Parquet, one folder to a shard, ``shard=N``; a column of that name is replaced by it."""
    assign(rows, key, shards, weights).write.partitionBy("shard").parquet(path)
