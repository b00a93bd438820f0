"""The signal chain for series of any length: no task has a whole series.

Rows (series, idx, value columns) are dealt by (series, block of indices). What an operator needs
beyond a block's ends, a halo, is copied into it; what concerns a whole series is one row to a
series from partial aggregates, and comes back by (series, block). Results equal those of the
operators in ``signal``, which keep a series together and need fewer steps where series are short.
"""

from __future__ import annotations

import bisect
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import model
from tidemark.operators import signal
from tidemark.operators.tables import Scratch

#: Indices of a block.
BLOCK = 1 << 16
#: Counted buckets of a round of selection; so many values or fewer are sorted.
BUCKETS, SORTED = 1024, 4096
#: A block of suppression spans so many distances at least, and sees so many of its neighbours'.
SPAN, SEEN = 64, 8


def _halo(rows: DataFrame, block: int, reach: int) -> DataFrame:
    """Each row in its own block, and in those whose ends are within reach: (..., block)."""
    low, high = F.floor((F.col("idx") - reach) / block), F.floor((F.col("idx") + reach) / block)
    return rows.withColumn("block", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))


def _own(block: int) -> Column:
    return F.floor(F.col("idx") / block) == F.col("block")


def _by_block(facts: DataFrame, block: int) -> DataFrame:
    """Facts of a series (with its length n) for each of its blocks."""
    return facts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))))


def smoothed_novelty(rows: DataFrame, series: str, features: list[str], sigma: float, block: int = BLOCK) -> DataFrame:
    """(series, idx, n, features, novelty, smooth) from (series, idx, features): moments, gradients and smoothing in one exchange of rows.

    Indices of a series run from 0 without gaps; n is their number. Moments are merged from partial
    ones. A block's halo is the kernel's radius and one more, so that gradients are right within the
    radius; mirrored places are made inside the block. A series in which a feature is constant, or
    that has one row, has null novelty.
    """
    weights = signal.kernel(sigma)
    radius = len(weights) // 2
    if block <= 2 * radius:
        raise ValueError("a block must be longer than the kernel")
    facts = rows.groupBy(series).agg(F.count(F.lit(1)).alias("n"), *[F.stddev_pop(f).alias(f"__s_{f}") for f in features])
    dealt = _halo(rows.select(series, "idx", *features), block, radius + 1).join(_by_block(facts, block), [series, "block"])
    line = Window.partitionBy(series, "block").orderBy("idx")
    total = None
    for f in features:
        before, after = F.lag(f).over(line), F.lead(f).over(line)
        slope = F.when(F.col("idx") == 0, after - F.col(f)).when(F.col("idx") == F.col("n") - 1, F.col(f) - before).otherwise((after - before) / 2)
        term = F.abs(F.try_divide(slope, F.col(f"__s_{f}")))
        total = term if total is None else total + term
    dealt = dealt.withColumn("novelty", F.when(F.col("n") > 1, total)).drop(*[f"__s_{f}" for f in features])

    size = F.col("n").cast("long")
    turn = F.ceil(F.lit(radius) / (2 * size)) + 1
    places = F.flatten(F.transform(F.sequence(-turn, turn), lambda k: F.array(F.col("idx") + 2 * k * size, -1 - F.col("idx") + 2 * k * size)))
    low, high = F.col("block") * block - radius, F.least((F.col("block") + 1) * block, size) + radius
    spread = dealt.withColumn("__at", F.explode(F.filter(places, lambda j: (j >= low) & (j < high))))
    around = F.collect_list(F.coalesce("novelty", F.lit(float("nan")))).over(Window.partitionBy(series, "block").orderBy("__at").rowsBetween(-radius, radius))
    smooth = F.aggregate(F.zip_with(around, F.array(*[F.lit(w) for w in weights]), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    done = spread.withColumn("smooth", smooth).where((F.col("__at") == F.col("idx")) & _own(block))
    return done.withColumn("smooth", F.when(~F.isnan("smooth"), F.col("smooth"))).select(series, "idx", F.col("n").cast("long").alias("n"), *features, "novelty", "smooth")


def percentiles(rows: DataFrame, series: str, column: str, facts: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(series, height): the (1 - threshold) percentile, exact, interpolated, of rows (series, idx, column), a written table.

    facts: (series, threshold). Selection by rounds: values between a series' bounds are counted in
    buckets, and the bucket that holds the wanted rank gives the next bounds, its least and greatest
    value. What is left, at most SORTED values, is sorted. Nulls do not count; a series of nulls has
    no height.
    """
    threshold = F.col("threshold")
    p = F.when(threshold.between(0, 1), F.round(1 - threshold, 12)).otherwise(F.raise_error(F.lit("threshold must lie in [0, 1]")).cast("double"))
    values = rows.where(F.col(column).isNotNull()).select(series, F.floor(F.col("idx") / block).alias("block"), F.col(column).alias("__v"))
    blocks = rows.select(series, F.floor(F.col("idx") / block).alias("block")).distinct()
    whole = rows.where(F.col(column).isNotNull()).groupBy(series).agg(F.count(F.lit(1)).alias("size"), F.min(column).alias("low"), F.max(column).alias("high")).join(facts, series).withColumn("__p", p)
    place = (F.col("size") - 1) * F.col("__p")
    ranks = F.array_distinct(F.array(F.floor(place), F.ceil(place)))
    wanted = whole.select(series, place.alias("place"), "size", "low", "high", F.lit(0).cast("long").alias("before"), F.explode(ranks).alias("rank"))
    wanted, blocks = scratch.written(wanted, "wanted"), scratch.written(blocks, "blocks")
    while True:
        open_ones = wanted.where((F.col("size") > SORTED) & (F.col("low") < F.col("high")))
        if open_ones.isEmpty():
            break
        inside = values.join(open_ones.join(blocks, series), [series, "block"]).where(F.col("__v").between(F.col("low"), F.col("high")))
        bucket = F.least(F.floor((F.col("__v") - F.col("low")) / (F.col("high") - F.col("low")) * BUCKETS), F.lit(BUCKETS - 1))
        counted = inside.groupBy(series, "rank", "place", "before", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("size"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        so_far = F.sum("size").over(Window.partitionBy(series, "rank").orderBy("bucket"))  # a row to a bucket
        found = counted.withColumn("before", F.col("before") + so_far - F.col("size")).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("size")))
        closed = wanted.where((F.col("size") <= SORTED) | (F.col("low") == F.col("high")))
        last, wanted = wanted, scratch.written(closed.unionByName(found.select(*wanted.columns)), "wanted")
        scratch.drop(last)
    few = values.join(wanted.where(F.col("low") < F.col("high")).join(blocks, series), [series, "block"]).where(F.col("__v").between(F.col("low"), F.col("high")))
    nth = F.row_number().over(Window.partitionBy(series, "rank").orderBy("__v")) - 1 + F.col("before")
    sorted_out = few.withColumn("__nth", nth).where(F.col("__nth") == F.col("rank")).select(series, "place", "rank", "__v")
    values_at = sorted_out.unionByName(wanted.where(F.col("low") == F.col("high")).select(series, "place", "rank", F.col("low").alias("__v")))
    ends = values_at.groupBy(series).agg(F.min_by("__v", "rank").alias("__a"), F.max_by("__v", "rank").alias("__b"), F.max(F.col("place") - F.floor("place")).alias("__part"))
    return ends.select(series, (F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__part")).alias("height"))


def local_maxima(rows: DataFrame, series: str, column: str, block: int = BLOCK) -> DataFrame:
    """(series, idx, column): strict maxima; a plateau counts at its middle, rounded down; ends never.

    A plateau over the border of blocks is put together from its two ends, of which a block has one
    open at either side at most.
    """
    dealt = _halo(rows.where(F.col(column).isNotNull()).select(series, "idx", F.col(column).alias("__v")), block, 1)
    line = Window.partitionBy(series, "block").orderBy("idx")
    dealt = dealt.withColumn("__b", F.lag("__v").over(line)).withColumn("__a", F.lead("__v").over(line)).where(_own(block))
    starts, ends = F.coalesce(F.col("__b") != F.col("__v"), F.lit(True)), F.coalesce(F.col("__a") != F.col("__v"), F.lit(True))
    rises, falls = F.coalesce(F.col("__b") < F.col("__v"), F.lit(False)), F.coalesce(F.col("__a") < F.col("__v"), F.lit(False))
    marked = dealt.select(series, "block", "idx", "__v", starts.alias("__start"), ends.alias("__end"), rises.alias("__up"), falls.alias("__down")).where((F.col("__start") & F.col("__end") & F.col("__up") & F.col("__down")) | (F.col("__start") != F.col("__end")))
    single = marked.where(F.col("__start") & F.col("__end")).select(series, "idx", "__v")
    edges = marked.where(F.col("__start") != F.col("__end"))

    def paired(some: DataFrame, by: list[str]) -> DataFrame:
        line = Window.partitionBy(*by).orderBy("idx")
        return some.withColumn("__e", F.when(F.col("__start"), F.lead(F.struct("idx", "__down")).over(line))).withColumn("__s", F.when(F.col("__end"), F.lag("__start").over(line)))

    inside = paired(edges, [series, "block"])
    whole = inside.where(F.col("__start") & F.col("__e").isNotNull())
    # what has no other end in its block: two rows to a block at most
    torn = inside.where((F.col("__start") & F.col("__e").isNull()) | (F.col("__end") & F.col("__s").isNull())).select(*edges.columns)
    joined = paired(torn, [series]).where(F.col("__start") & F.col("__e").isNotNull())
    flat = whole.unionByName(joined).where(F.col("__up") & F.col("__e.__down")).select(series, F.floor((F.col("idx") + F.col("__e.idx")) / 2).alias("idx"), "__v")
    return single.withColumn("idx", F.col("idx").cast("long")).unionByName(flat).withColumnRenamed("__v", column)


def decide(idx: np.ndarray, height: np.ndarray, kept: np.ndarray, distance: float, low: float, high: float) -> np.ndarray:
    """For peaks by rising idx: 1 kept, 2 removed, 0 open, as far as what lies from low to high, all that is seen, decides.

    From the highest down (later first among equals): a peak is removed if one that is kept is nearer
    than the distance; else it is open if an open one is, or if it could be near one out of sight;
    else it is kept.
    """
    state = np.zeros(len(idx), np.int8)
    taken: list[float] = sorted(idx[kept].tolist())
    state[kept] = 1
    waiting: list[float] = []

    def near(places: list[float], x: float) -> bool:
        at = bisect.bisect_right(places, x - distance)
        return at < len(places) and places[at] < x + distance

    for i in np.lexsort((-idx, -height)).tolist():
        if kept[i]:
            continue
        x = float(idx[i])
        if near(taken, x):
            state[i] = 2
        elif near(waiting, x) or x - distance < low - 1 or x + distance > high:
            bisect.insort(waiting, x)
        else:
            bisect.insort(taken, x)
            state[i] = 1
    return state


def suppressed(peaks: DataFrame, series: str, height: str, scratch: Scratch, block: int = 1) -> DataFrame:
    """(series, idx, height, distance): of peaks (the same) those kept: highest first, later first among equals, none nearer than its series' distance.

    Rounds: blocks of many distances, and of ``block`` indices if that is more, decide each peak whose
    fate does not hang on one out of sight; the highest open peak never does, so each round decides some. As a rule two rounds are enough; a
    chain of ever higher peaks takes one for each block that it runs through.
    """
    left = peaks.select(series, F.col("idx").cast("long").alias("idx"), F.col(height).cast("double").alias("__h"), F.col("distance").cast("long").alias("distance"), F.lit(False).alias("kept"))
    left = scratch.written(left.where(F.col("__h").isNotNull()), "peaks")
    kind = left.schema[series].dataType.simpleString()

    def round_of(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx", kind="stable")
        idx, at, d = frame["idx"].to_numpy(), int(frame["__at"].iloc[0]), int(frame["distance"].iloc[0])
        span = max(SPAN, -(-block // d)) * d
        low, high = at * span, (at + 1) * span
        state = decide(idx, frame["__h"].to_numpy(), frame["kept"].to_numpy(), d, low - SEEN * d if at else -np.inf, high + SEEN * d)
        own = (idx >= low) & (idx < high) & (state != 2)
        return pd.DataFrame({series: frame[series][own], "idx": idx[own], "__h": frame["__h"][own], "distance": d, "kept": state[own] == 1})

    while not left.where(~F.col("kept")).isEmpty():
        size = F.col("distance") * F.greatest(F.ceil(F.lit(block) / F.col("distance")), F.lit(SPAN))
        reach = F.col("distance") * SEEN
        blocks = F.sequence(F.greatest(F.floor((F.col("idx") - reach) / size), F.lit(0)), F.floor((F.col("idx") + reach) / size))
        dealt = left.withColumn("__at", F.explode(blocks))
        last, left = left, scratch.written(dealt.groupBy(series, "__at").applyInPandas(round_of, f"{series} {kind}, idx long, __h double, distance long, kept boolean"), "peaks")
        scratch.drop(last)
    return left.select(series, "idx", F.col("__h").alias(height), "distance")


def _next(places: DataFrame, series: str, scratch: Scratch, span: int) -> DataFrame:
    """(series, pos, to): the first place at ``pos + gap`` or later; from (series, pos, gap), one row each.

    Windows run from the last place back, so that a row takes what was seen before it: a window
    that looks ahead is computed anew over all of the rest at each row.
    """
    asks = places.select(series, (F.col("pos") + F.col("gap")).alias("at"), F.col("pos").alias("__from"))
    every = asks.unionByName(places.select(series, F.col("pos").alias("at"), F.lit(None).cast("long").alias("__from"))).withColumn("part", F.floor(F.col("at") / span))
    back = Window.partitionBy(series, "part").orderBy(F.col("at").desc(), F.col("__from").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = every.withColumn("__to", F.min(F.when(F.col("__from").isNull(), F.col("at"))).over(back)).where(F.col("__from").isNotNull())
    # none left in its part: the first of the next part that has any; a row to a part
    parts = every.groupBy(series, "part").agg(F.min(F.when(F.col("__from").isNull(), F.col("at"))).alias("__first"))
    beyond = F.min("__first").over(Window.partitionBy(series).orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1))
    joined = found.join(parts.withColumn("__beyond", beyond).select(series, "part", "__beyond"), [series, "part"])
    return scratch.written(joined.select(series, F.col("__from").alias("pos"), F.coalesce("__to", "__beyond").alias("to")).where(F.col("to").isNotNull()), "next")


def boundaries(peaks: DataFrame, lengths: DataFrame, series: str, hop: int, sr: Column, min_duration: Column, scratch: Scratch) -> DataFrame:
    """(series, boundary): sample positions from 0 to the end, none nearer than the least duration to the last kept; the end replaces the last.

    peaks: (series, idx); lengths: (series, samples), one row to a series, over which the columns
    ``sr`` and ``min_duration`` are taken. Each candidate points to the first one that is far enough,
    and doubling the pointers marks those that are reached from 0: as many rounds as the logarithm
    of a series' boundaries.
    """
    rate, least = sr.cast("double"), min_duration.cast("double")
    near = F.ceil(least * rate).cast("long")
    gap = F.greatest(F.coalesce(*[F.when(g / rate >= least, g) for g in (near - 1, near, near + 1)]), F.lit(1))
    facts = lengths.select(series, F.col("samples").cast("long").alias("samples"), gap.alias("gap"))
    inner = peaks.select(series, (F.col("idx") * hop).alias("pos")).join(facts, series).select(series, "pos", "gap").where("pos > 0")
    ends = facts.select(series, F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), F.col("samples")))).alias("pos"), "gap")
    jump = _next(inner.unionByName(ends).distinct(), series, scratch, 1 << 24).where(F.col("to") > F.col("pos"))
    kept, more = scratch.written(facts.select(series, F.lit(0).cast("long").alias("pos")), "kept"), True
    while more:
        reached = kept.join(jump, [series, "pos"]).select(series, F.col("to").alias("pos"))
        last, kept = kept, scratch.written(kept.unionByName(reached).distinct(), "kept")
        twice = jump.join(jump.select(series, F.col("pos").alias("to"), F.col("to").alias("__to")), [series, "to"]).select(series, "pos", F.col("__to").alias("to"))
        jump = scratch.written(twice, "jump")
        scratch.drop(last)
        more = not jump.isEmpty()
    ending = kept.groupBy(series).agg(F.max("pos").alias("__last")).join(facts, series)
    inside = kept.join(ending.select(series, "__last"), series).where(F.col("pos") < F.col("__last")).select(series, "pos")
    # the last one stays only if it is the end, and else the end replaces it
    return inside.unionByName(facts.select(series, F.col("samples").alias("pos"))).withColumnRenamed("pos", "boundary")


def segments(found: DataFrame, series: str, rates: DataFrame) -> DataFrame:
    """(series, seg, start, stop, start_s) from (series, boundary) and (series, sr): far fewer rows than samples, by series."""
    line = Window.partitionBy(series).orderBy("boundary")
    pairs = found.withColumn("stop", F.lead("boundary").over(line)).withColumn("seg", (F.row_number().over(line) - 1).cast("int")).where(F.col("stop").isNotNull())
    return pairs.join(rates, series).select(series, "seg", F.col("boundary").alias("start"), "stop", (F.col("boundary") / F.col("sr").cast("double")).alias("start_s"))


def peaks(curve: DataFrame, series: str, column: str, facts: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(series, idx, column, distance): local maxima at or above the percentile, none nearer than the distance to a higher one.

    curve: (series, idx, column), a written table; facts: (series, threshold, distance).
    """
    heights = percentiles(curve, series, column, facts.select(series, "threshold"), scratch, block)
    high = scratch.written(heights.join(facts.select(series, "distance"), series), "heights")
    found = scratch.written(local_maxima(curve, series, column, block).withColumn("__part", F.floor(F.col("idx") / block)), "maxima")
    # by series and part, so that a long series' maxima meet its height in many tasks
    by_part = high.join(found.select(series, "__part").distinct(), series)
    above = found.join(by_part, [series, "__part"]).where(F.col(column) >= F.col("height"))
    return suppressed(above.select(series, "idx", column, "distance"), series, column, scratch, BLOCK)


def analyse(rows: DataFrame, series: str, features: list[str], how: model.Detection, block: int = BLOCK) -> DataFrame:
    """Segments (series, seg, start, stop, start_s) of feature rows (series, idx, samples, sr, features), whatever the length of a series.

    The same rules as ``plans.detect``: parameters by the signal's length, peaks of the smoothed
    novelty above the percentile, boundaries, and segments. The rows are read twice.
    """
    scratch = Scratch(rows.sparkSession, "long-series")
    least, threshold = signal.parameters(F.col("samples"), F.col("sr"), how.min_duration, how.threshold)
    distance = F.floor(least * F.col("sr") / how.hop).cast("long")
    distance = F.when(distance >= 1, distance).otherwise(F.raise_error(F.lit("the least duration is below one hop")).cast("long"))
    facts = rows.groupBy(series).agg(F.max("samples").alias("samples"), F.max("sr").alias("sr"))
    facts = scratch.written(facts.withColumns({"threshold": threshold, "distance": distance}), "facts")
    smooth = smoothed_novelty(rows, series, features, how.sigma, block)
    smooth = smooth.withColumn("smooth", F.round("smooth", how.digits)) if how.digits is not None else smooth
    curve = scratch.written(smooth.select(series, "idx", "smooth"), "curve")
    found = peaks(curve, series, "smooth", facts, scratch, block)
    bounds = boundaries(found, facts, series, how.hop, F.col("sr"), least, scratch)
    return scratch.result(segments(bounds, series, facts.select(series, "sr")))
