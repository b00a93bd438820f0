"""Line dedup with levelled sorted runs of line hashes.

A run is a table in sorted buckets of the line hash: the hash, in how many documents the line was
found, the largest id among them. Each batch of documents is counted by line (its one shuffle) and
meets the runs bucket by bucket: the lines that no run has, by anti-join, become a run of level 0;
counts of those that a run has go to the runs of recurrences. When a level holds ``fanout`` runs they
are merged, bucket by bucket, into one of the next level, so that n batches leave about log(n)
runs and each row is rewritten about log(n) times. A line is in one run only, so its counts are
that run's and its recurrences'.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import shared

_BLANK = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    """The lines of a text; null is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without blanks at its ends and with A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(_BLANK)), _UPPER, _UPPER.lower())


def hashed_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, text_crc, pos, h1, h2): the lines whose key is long enough, by 128 bits of hash."""
    plain = shared.texts(docs).select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = plain.select("doc_id", "text_crc", "pos", F.trim("line", F.lit(_BLANK)).alias("line")).where(F.char_length("line") >= least_chars)
    key = F.translate("line", _UPPER, _UPPER.lower())
    one, two = shared.names(key.cast("binary"))
    return keyed.select("doc_id", "text_crc", "pos", one.alias("h1"), two.alias("h2"))


def _summed(one: DataFrame, other: DataFrame, how: str = "full") -> DataFrame:
    """Two runs as one (of the lines of either, or with "left" of the first): counts of lines that both have are added up. Both lie in the same buckets, so nothing is shuffled."""
    other = other.select(*_HASH, F.col("n_docs").alias("more_docs"), F.col("max_doc").alias("other_doc"))
    both = one.join(other, _HASH, how)
    n = F.coalesce("n_docs", F.lit(0)) + F.coalesce("more_docs", F.lit(0))
    return both.select(*_HASH, n.cast("long").alias("n_docs"), F.greatest("max_doc", "other_doc").alias("max_doc"))


class Levels:
    """Runs in levels; a full level becomes one run of the next."""

    def __init__(self, name: str, fanout: int):
        self.name, self.fanout = name, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def push(self, run: DataFrame) -> DataFrame:
        """Write a run of level 0, and merge levels that are full."""
        level, written = 0, shared.bucketed(run, self.name, *_HASH)
        last = written
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(last)
            if len(self.levels[level]) < self.fanout:
                return written
            full, self.levels[level] = self.levels[level], []
            level, last = level + 1, shared.bucketed(reduce(_summed, full), self.name, *_HASH)


class LineRuns:
    """The runs so far. The driver keeps their places only, about log(batches) of them."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark = spark
        self.first, self.again = Levels("lines", fanout), Levels("recurring", fanout)

    def add(self, lines: DataFrame) -> None:
        """Add a batch of hashed lines. A document counts once, however often it has the line."""
        once = lines.groupBy(*_HASH, "doc_id", "text_crc").agg(F.lit(1).alias("one"))
        batch = shared.bucketed(once.groupBy(*_HASH).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc")), "batch", *_HASH)
        known = bool(self.first.runs())
        new = self.first.push(self.unseen(batch))
        if known:
            self.again.push(batch.join(new.select(*_HASH), _HASH, "left_anti"))

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The lines of a batch that no run has: an anti-join with each run."""
        return reduce(lambda left, run: left.join(run.select(*_HASH), _HASH, "left_anti"), self.first.runs(), lines)

    def counts(self) -> DataFrame:
        """Every line with its total count and largest id: each run with its recurrences, bucket by bucket."""
        return reduce(DataFrame.unionByName, [reduce(partial(_summed, how="left"), self.again.runs(), run) for run in self.first.runs()])


def drops(lines: DataFrame, runs: LineRuns, least_docs: int) -> DataFrame:
    """(doc_id, text_crc, drop): positions of the lines that go from each document that loses any.

    A hot line's rows are split over tasks by the adaptive join; the positions of one document are
    bounded by its own lines.
    """
    hot = runs.counts().where(F.col("n_docs") >= least_docs)
    gone = lines.join(hot, _HASH).where(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
    return gone.groupBy("doc_id", "text_crc").agg(F.collect_set("pos").alias("drop"))


def find_drops(docs: DataFrame, least_docs: int, least_chars: int, batches: int) -> DataFrame:
    """Hash all lines, add them to the runs batch by batch, and look every line up."""
    spark = docs.sparkSession
    path = shared.folder(spark, "hashed-lines")
    hashed_lines(docs, least_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(path)
    schema = "doc_id long, text_crc long, pos int, h1 long, h2 long, batch int"
    lines = spark.read.schema(schema).parquet(path)
    runs = LineRuns(spark)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch))
    return drops(lines.drop("batch"), runs, least_docs)


def _cut(docs: DataFrame, least_docs: int, least_chars: int, batches: int, row: Column | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped and text of each row, and the row itself where given."""
    found = find_drops(docs, least_docs, least_chars, batches)
    found = found.select(F.col("doc_id").alias("drop_id"), F.col("text_crc").alias("drop_crc"), "drop")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([] if row is None else [row.alias("row")]))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    joined = own.join(found, F.col("doc_id").eqNullSafe(F.col("drop_id")) & (crc == F.col("drop_crc")), "left")
    lines = lines_of(F.col("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
    left = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(left)
    dropped = F.coalesce(F.size("drop"), F.lit(0)).cast("long")
    return joined.select("doc_id", F.size(lines).cast("long").alias("n_lines"), dropped.alias("n_dropped"), text.alias("text"), *([] if row is None else ["row"]))


def dedup(docs: DataFrame, least_docs: int = 5, least_chars: int = 40, batches: int = 4) -> DataFrame:
    """The documents' own columns, whatever their names, text without the lines that go.

    A key of at least ``least_chars`` code points in at least ``least_docs`` documents loses all
    its lines but those of the largest doc_id that holds it; where ids tie, all their documents
    keep it. n_chars, where the table has it, follows a text that changed. Rows with equal id and
    text are one document. A null id counts as a document below all others; a null text is one
    empty line and stays null; an empty text stays empty. A very long text is one row with an array
    of its lines. An empty table gives an empty result.
    """
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"] or [F.lit(0)]
    cut = _cut(docs, least_docs, least_chars, batches, F.struct(*rest))
    changed = F.when(F.col("n_dropped") > 0, F.char_length("text"))
    kind = dict(docs.dtypes)
    own = lambda i, c: F.coalesce(changed.cast(kind[c]), F.col(f"row.c{i}")) if c == "n_chars" else F.col(f"row.c{i}")
    return cut.select(*[F.col("text") if c == "text" else own(i, c).alias(c) for i, c in enumerate(docs.columns)])


def digest(docs: DataFrame, least_docs: int = 5, least_chars: int = 40, batches: int = 4) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document, with the rules of :func:`dedup`."""
    cut = _cut(docs, least_docs, least_chars, batches)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
