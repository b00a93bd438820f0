"""Mixing sources to target weights, in DataFrame functions alone.

Sizes are added up by source; targets follow the weights, no source above a number of epochs;
each document is emitted floor(rate) times, plus one more where a hash of its key falls under
the fraction of the rate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import shared

#: Sources up to this many are broadcast (about 10 MB); beyond it the join shuffles.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Maximal runs of characters other than 0x20 and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """From (source, source_size) the target of each source.

    Sources in code-point order, null last, take the weights in turn. Together they get ``share``
    of all sizes; a source stops at ``epochs`` times its size, and the excess goes to the others
    by weight. That fixed point is the level L with sum(min(cap, weight * L)) = total: in order of
    cap / weight, sources are full as long as what is left, spread over the remaining weight,
    would lift them above their cap; from the first source that is not full on, the level only falls,
    so it is the largest one there. One row a source, so these windows are small.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights))) + 1
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
    weighted = weighted.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = weighted.withColumn("__total", F.sum("source_size").over(whole) * F.lit(float(share)))
    level = level.withColumn("__left", F.col("__total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    level = level.withColumn("__weight", F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    level = level.withColumn("__level", F.col("__left") / F.col("__weight"))
    level = level.withColumn("__full", F.col("cap") <= F.col("weight") * F.col("__level"))
    level = level.withColumn("__last", F.max(F.when(~F.col("__full"), F.col("__level"))).over(whole))
    target = F.when(F.col("__full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("__last")))
    return level.select("source", "source_size", "weight", target.alias("target"))


def _drawn(docs: DataFrame, weights: Sequence[float], share: float, epochs: float, seed: int, row: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of each row, and the row itself where given."""
    own = [F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text_md5")]
    sized = docs.select(*own, *([] if row is None else [row.alias("row")]))
    by_source = shared.written(docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "sizes")
    table = targets(by_source, weights, share, epochs).select(F.col("source").alias("of"), "source_size", "target")
    few = by_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = sized.join(F.broadcast(table) if few else table, F.col("source").eqNullSafe(F.col("of")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(epochs)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("text_md5")).cast("binary"))
    draw = (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    whole = F.floor(rate)
    number = (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("int")
    return joined.select("doc_id", "source", "size", "source_size", "target", number.alias("copies"), *([] if row is None else ["row"]))


def copies(docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (how often the mix takes the document) of every row.

    Each document draws by itself, so a source's taken words are off its target by chance: the
    standard deviation is sqrt(f * (1 - f) * sum(size ** 2)), f the fraction of its rate. That is
    a small part of the target unless few long documents carry the source.

    A null or empty text has size 0; a null source is a source of its own, last in order; a source
    of size 0 has rate 0; repeated rows draw alike, because the draw hashes the id and the text;
    ties of sources have no effect on targets. Other columns are not read, so their names cannot
    clash; a table without ``source`` or ``text`` is refused. A very long text is one row. An empty
    table gives an empty result. Hot sources do not matter: sizes are added up before the shuffle,
    and the source rows are broadcast once their number is known to be small.
    """
    _check(docs)
    return _drawn(docs, weights, share, epochs, seed)


def mix(docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """The mix itself: each document as often as :func:`copies` says, with its own columns, whatever their names.

    A null source is one source, the last; a null or wordless text has size 0 and is drawn like
    others; a null id draws by its text. Rows that repeat id and text are drawn alike. A very long
    text is one row, moved with its copies. An empty table gives an empty result.
    """
    _check(docs)
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    taken = _drawn(docs, weights, share, epochs, seed, packed).where(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def _check(docs: DataFrame) -> None:
    if missing := {"doc_id", "text", "source"} - set(docs.columns):
        raise ValueError(f"mixing needs the columns {', '.join(sorted(missing))}")
