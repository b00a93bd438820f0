"""From a signal to segments.

Every operator takes rows (series, idx, value columns) and keeps one distribution: by series,
sorted by idx. Catalyst plans a single exchange for a whole chain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars


def _of(series: str):
    return Window.partitionBy(series)


def _ordered(series: str, idx: str = "idx"):
    return Window.partitionBy(series).orderBy(idx)


def ordered_series(rows: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """(series, idx, value): rows numbered from 0 in order."""
    nth = F.row_number().over(Window.partitionBy(series).orderBy(*order)) - 1
    return rows.select(series, nth.cast("int").alias("idx"), F.col(value).cast("double").alias("value"))


def zscore(rows: DataFrame, series: str, column: str, into: str) -> DataFrame:
    """(x - mean) / population deviation; null in a constant series, where the ratio has no value."""
    mean, deviation = F.avg(column).over(_of(series)), F.stddev_pop(column).over(_of(series))
    return rows.withColumn(into, F.try_divide(F.col(column) - mean, deviation))


def gradient(rows: DataFrame, series: str, column: str, into: str) -> DataFrame:
    """Central differences, one-sided at both ends; null in a series of one."""
    before, after = F.lag(column).over(_ordered(series)), F.lead(column).over(_ordered(series))
    last = F.max("idx").over(_of(series))
    value = F.when(F.col("idx") == 0, after - F.col(column)).when(F.col("idx") == last, F.col(column) - before).otherwise((after - before) / 2)
    return rows.withColumn(into, value)


def novelty(rows: DataFrame, series: str, features: list[str], into: str = "novelty") -> DataFrame:
    """Sum of the absolute gradients of the features' z-scores."""
    out, terms = rows, []
    for f in features:
        out = gradient(zscore(out, series, f, f"__z_{f}"), series, f"__z_{f}", f"__g_{f}")
        terms.append(F.abs(F.col(f"__g_{f}")))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return out.withColumn(into, total).drop(*[f"__{k}_{f}" for f in features for k in "zg"])


def kernel(sigma: float) -> list[float]:
    """Gaussian weights, cut at four deviations."""
    radius = int(4.0 * sigma + 0.5)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def gaussian_smooth(rows: DataFrame, series: str, column: str, sigma: float, into: str) -> DataFrame:
    """Gaussian smoothing with mirrored ends.

    Rows near an end are repeated at their mirrored places (more than once in a series shorter
    than the kernel), and each place takes the weighted sum of its neighbours: one window, no join.
    """
    weights = kernel(sigma)
    radius = len(weights) // 2
    n = F.count(F.lit(1)).over(_of(series))
    sized = rows.withColumn("__n", n.cast("int"))
    turns = F.sequence(-F.ceil(F.lit(radius) / (2 * F.col("__n"))).cast("int") - 1, F.ceil(F.lit(radius) / (2 * F.col("__n"))).cast("int") + 1)
    places = F.flatten(F.transform(turns, lambda k: F.array(F.col("idx") + 2 * k * F.col("__n"), -1 - F.col("idx") + 2 * k * F.col("__n"))))
    near = F.filter(places, lambda j: (j >= -radius) & (j < F.col("__n") + radius))
    spread = sized.withColumn("__at", F.explode(near))
    around = F.collect_list(F.coalesce(F.col(column).cast("double"), F.lit(float("nan")))).over(Window.partitionBy(series).orderBy("__at").rowsBetween(-radius, radius))
    held = F.array(*[F.lit(w) for w in weights])
    total = F.aggregate(F.zip_with(around, held, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    smooth = spread.withColumn(into, total).where((F.col("__at") == F.col("idx")))
    return smooth.withColumn(into, F.when(F.isnan(into), F.lit(None)).otherwise(F.col(into))).drop("__n", "__at")


def percentile_threshold(rows: DataFrame, series: str, column: str, threshold: Column, into: str = "height") -> DataFrame:
    """Add the (1 - threshold) percentile of each series, exact, interpolated. A higher threshold is a lower bar.

    Values are ranked by a window, which spills, so that no row holds a series; only the two values
    around the percentile go on. Their join meets rows that are distributed by series already. Nulls
    do not count. A threshold outside [0, 1] is an error.
    """
    threshold = F.when(threshold.between(0, 1), threshold).otherwise(F.raise_error(F.lit("threshold must lie in [0, 1]")).cast("double"))
    values = rows.select(series, F.col(column).alias("__value"), F.round(1 - threshold, 12).alias("__p")).where(F.col("__value").isNotNull())
    rank = F.row_number().over(_ordered(series, "__value")) - 1
    ranked = values.withColumn("__rank", rank).withColumn("__place", (F.count(F.lit(1)).over(_of(series)) - 1) * F.col("__p"))
    at = lambda nth: F.max(F.when(F.col("__rank") == nth("__place"), F.col("__value")))
    around = ranked.groupBy(series).agg(at(F.floor).alias("__low"), at(F.ceil).alias("__high"), F.max(F.col("__place") - F.floor("__place")).alias("__part"))
    heights = around.select(F.col(series).alias("__of"), (F.col("__low") + (F.col("__high") - F.col("__low")) * F.col("__part")).alias(into))
    return rows.join(heights, F.col(series) == F.col("__of"), "left").drop("__of")


def local_maxima(rows: DataFrame, series: str, column: str, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(series, idx, column, keep): strict maxima; a plateau counts at its middle, rounded down; ends never."""
    changed = F.coalesce((F.col(column) != F.lag(column).over(_ordered(series))).cast("int"), F.lit(0))
    marked = rows.where(F.col(column).isNotNull()).withColumn("__changed", changed)
    runs = marked.withColumn("__run", F.sum("__changed").over(_ordered(series)))
    flat = runs.groupBy(series, "__run").agg(F.min("idx").alias("__from"), F.max("idx").alias("__to"), F.first(column).alias(column), *[F.first(k).alias(k) for k in keep])
    by_run = Window.partitionBy(series).orderBy("__run")
    peaks = flat.withColumn("__before", F.lag(column).over(by_run)).withColumn("__after", F.lead(column).over(by_run))
    peaks = peaks.where((F.col(column) > F.col("__before")) & (F.col(column) > F.col("__after")))
    return peaks.select(series, F.floor((F.col("__from") + F.col("__to")) / 2).cast("int").alias("idx"), column, *keep)


def suppress(peaks: Column, distance: Column) -> Column:
    """Of peaks (array of struct(height, idx)) those kept: highest first, later first among equals, none nearer than distance."""
    far = lambda kept, x: F.forall(kept, lambda k: F.abs(k - x["idx"]) >= distance)
    ordered = F.sort_array(peaks, asc=False)
    return F.sort_array(F.aggregate(ordered, F.array().cast("array<int>"), lambda kept, x: F.when(far(kept, x), F.concat(kept, F.array(x["idx"]))).otherwise(kept)))


def peaks_of(rows: DataFrame, series: str, column: str, threshold: Column, distance: Column, samples: Column) -> DataFrame:
    """(series, samples, distance, peaks): the peak indices of each series; also of series without any.

    Percentile and maxima come from windows over the rows as they lie by series, and one aggregate
    takes all: no join, and no exchange beyond the one that brought a series together.
    """
    threshold = F.when(threshold.between(0, 1), threshold).otherwise(F.raise_error(F.lit("threshold must lie in [0, 1]")).cast("double"))
    v, known = F.col(column), F.col(column).isNotNull()
    marked = rows.withColumns({"__samples": samples, "__distance": distance, "__p": F.round(1 - threshold, 12)})
    marked = marked.withColumns({"__rank": F.row_number().over(Window.partitionBy(series).orderBy(v.asc_nulls_last())) - 1, "__place": (F.count(v).over(_of(series)) - 1) * F.col("__p")})
    at = lambda nth: F.max(F.when(known & (F.col("__rank") == nth("__place")), v)).over(_of(series))
    marked = marked.withColumns({"__low": at(F.floor), "__high": at(F.ceil), "__before": F.lag(column).over(_ordered(series)), "__after": F.lead(column).over(_ordered(series))})
    begins = known & (F.col("__before").isNull() | (F.col("__before") != v))
    marked = marked.withColumn("__run", F.sum(begins.cast("int")).over(_ordered(series)))
    run = Window.partitionBy(series, "__run")
    ends = known & (F.col("__after").isNull() | (F.col("__after") != v))
    marked = marked.withColumns({"__to": F.max(F.when(ends, F.col("idx"))).over(run), "__beyond": F.max(F.when(ends, F.col("__after"))).over(run)})
    height = F.col("__low") + (F.col("__high") - F.col("__low")) * (F.col("__place") - F.floor("__place"))
    is_peak = begins & (v > F.col("__before")) & (v > F.col("__beyond")) & (v >= height)
    middle = F.floor((F.col("idx") + F.col("__to")) / 2).cast("int")
    found = marked.groupBy(series).agg(F.first("__samples").alias("samples"), F.first("__distance").alias("distance"), F.collect_list(F.when(is_peak, F.struct(v.cast("double").alias("height"), middle.alias("idx")))).alias("__found"))
    return found.select(series, "samples", "distance", suppress(F.col("__found"), F.col("distance")).alias("peaks"))


def boundaries(peaks: Column, samples: Column, hop: int, sr: Column, min_duration: Column) -> Column:
    """Sample positions: 0, the peaks and the end, none nearer than the least duration to the last kept; the end replaces the last.

    A signal shorter than the least duration keeps its end alone, so it has no segment.
    """
    zero = F.lit(0).cast("long")
    candidates = F.concat(F.transform(peaks, lambda p: (p * hop).cast("long")), F.array(samples.cast("long")))
    kept = F.aggregate(candidates, F.array(zero), lambda acc, b: F.when((b - F.element_at(acc, -1)) / sr >= min_duration, F.concat(acc, F.array(b))).otherwise(acc))
    return F.when(F.element_at(kept, -1) == samples, kept).otherwise(F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(samples.cast("long"))))


def segments(rows: DataFrame, series: str, bounds: str, sr: Column) -> DataFrame:
    """(series, seg, start, stop, start_s): consecutive pairs of boundaries."""
    pairs = F.zip_with(F.slice(bounds, 1, F.greatest(F.size(bounds) - 1, F.lit(0))), F.slice(bounds, 2, F.greatest(F.size(bounds) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("start"), b.alias("stop")))
    flat = rows.select(series, sr.cast("double").alias("__sr"), F.posexplode(pairs).alias("seg", "__pair"))
    return flat.select(series, "seg", F.col("__pair.start").alias("start"), F.col("__pair.stop").alias("stop"), (F.col("__pair.start") / F.col("__sr")).alias("start_s"))


def parameters(samples: Column, sr: Column, min_duration: float | None, threshold: float | None) -> tuple[Column, Column]:
    """Least duration and threshold of a signal: the given ones, or by its length."""
    seconds = samples / sr
    least = scalars.override(F.lit(min_duration).cast("double"), scalars.auto_min_duration(seconds).cast("double"))
    return least, scalars.override(F.lit(threshold).cast("double"), scalars.auto_threshold(seconds))


def label(rows: DataFrame, found: DataFrame, series: str) -> DataFrame:
    """Rows (series, idx, ...) with the number of the segment that they lie in, if any.

    Segments' starts are mixed in among the rows, in order, and each row takes the last start: one
    exchange by series, no row for each sample of a segment.
    """
    own = F.struct(*[F.col(c) for c in rows.columns if c != series]).alias("__row")
    starts = found.select(F.col(series), F.col("start").cast("long").alias("__at"), F.col("seg").alias("__seg"), F.col("stop").alias("__stop"))
    every = rows.select(F.col(series), F.col("idx").cast("long").alias("__at"), own).unionByName(starts, allowMissingColumns=True)
    before = Window.partitionBy(series).orderBy("__at", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("__row").isNull(), F.struct("__seg", "__stop")), ignorenulls=True).over(before)
    marked = every.withColumn("__last", last).where(F.col("__row").isNotNull())
    return marked.select(series, "__row.*", F.when(F.col("__at") < F.col("__last.__stop"), F.col("__last.__seg")).alias("seg"))


def slice_segments(chunks: DataFrame, found: DataFrame, series: str = "series_id") -> DataFrame:
    """The samples of each segment, piece by piece: (series, seg, chunk, samples).

    A segment is expanded to the chunks that it touches, so this is an equality join.
    """
    size = F.size("samples")
    lengths = chunks.groupBy(series).agg(F.max(size).alias("__size"))
    touched = found.join(lengths, series).withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / F.col("__size")), F.floor((F.col("stop") - 1) / F.col("__size"))).cast("array<int>")))
    joined = touched.join(chunks.withColumnRenamed("start", "__first"), [series, "chunk"])
    start = F.greatest(F.col("start") - F.col("__first"), F.lit(0))
    stop = F.least(F.col("stop") - F.col("__first"), size)
    return joined.select(series, "seg", "chunk", F.slice("samples", (start + 1).cast("int"), (stop - start).cast("int")).alias("samples"))
