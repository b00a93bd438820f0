"""The queries of the signal engine over the supplied tables, each with its DuckDB SQL.

``events`` gives a signal per user (one value a second), ``embeddings`` short signals of 64
samples, ``part`` tracks, ``orders`` result files and requests, and so on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions import scalars
from tidemark.operators import long_series, results, signal, spectral, tasks, tracks
from tidemark.operators.tables import Scratch
from tidemark.plans import media, streams
from tidemark.sources import audio
from tidemark.streaming import tasks as task_stream

Query = Callable[[SparkSession, str], DataFrame]

SIGMA_SHORT, DISTANCE, GAP, THRESHOLD = 2.0, 5, 6, 0.3
N_FFT, HOP, RATE = 16, 4, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.ordered_series(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


def _r(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)


# --- signals -----------------------------------------------------------------------------------

_SERIES = """series AS (
    SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS idx, value FROM events
)"""


def signal_series(spark, sf_dir):
    return _series(spark, sf_dir)


def duration(spark, sf_dir):
    n = _series(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("samples"))
    return n.select("user_id", "samples", (F.col("samples") / F.lit(1)).alias("seconds"))


def auto_params(spark, sf_dir):
    seconds = F.col("value") * 50
    return table(spark, sf_dir, "events").select("event_id", scalars.auto_min_duration(seconds).alias("min_duration"), scalars.auto_threshold(seconds).alias("threshold"))


_AUTO = """CASE WHEN value * 50 < 3600 THEN 30 WHEN value * 50 < 7200 THEN 45 WHEN value * 50 < 10800 THEN 60 ELSE 90 END"""
_AUTO_T = """CASE WHEN value * 50 < 3600 THEN 0.30 WHEN value * 50 < 7200 THEN 0.25 WHEN value * 50 < 10800 THEN 0.20 ELSE 0.15 END"""


def param_override(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("manual", F.when(F.pmod("event_id", F.lit(3)) == 0, F.lit(None)).otherwise(F.pmod("event_id", F.lit(4)) * 10).cast("int"))
    return e.select("event_id", scalars.override(F.col("manual"), scalars.auto_min_duration(F.col("value") * 50)).alias("min_duration"))


def zscore(spark, sf_dir):
    return signal.zscore(_series(spark, sf_dir), "user_id", "value", "z").select("user_id", "idx", _r("z"))


_Z = _SERIES + """, z AS (
    SELECT *, (value - avg(value) OVER (PARTITION BY user_id)) / nullif(stddev_pop(value) OVER (PARTITION BY user_id), 0) AS z FROM series
)"""


def gradient(spark, sf_dir):
    rows = signal.zscore(_series(spark, sf_dir), "user_id", "value", "z")
    return signal.gradient(rows, "user_id", "z", "gradient").select("user_id", "idx", _r("gradient"))


_G = _Z + """, g AS (
    SELECT *, CASE WHEN idx = 0 THEN lead(z) OVER w - z
                   WHEN idx = max(idx) OVER (PARTITION BY user_id) THEN z - lag(z) OVER w
                   ELSE (lead(z) OVER w - lag(z) OVER w) / 2 END AS gradient
    FROM z WINDOW w AS (PARTITION BY user_id ORDER BY idx)
)"""


def _novel(spark, sf_dir):
    return signal.novelty(_series(spark, sf_dir), "user_id", ["value"])


def novelty(spark, sf_dir):
    return _novel(spark, sf_dir).select("user_id", "idx", _r("novelty"))


def gaussian_smooth(spark, sf_dir):
    return signal.gaussian_smooth(_novel(spark, sf_dir), "user_id", "novelty", 10.0, "smooth").select("user_id", "idx", _r("smooth"))


def _smooth_sql(sigma: float, source: str, key: str, name: str = "smooth") -> str:
    radius = int(4 * sigma + 0.5)
    return f"""kernel AS (
    SELECT d, exp(-0.5 * (d / {sigma}) ** 2) / sum(exp(-0.5 * (d / {sigma}) ** 2)) OVER () AS w FROM range(-{radius}, {radius + 1}) t(d)
), sized AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM {source}
), spots AS (
    SELECT s.{key}, s.idx, k.w, (((s.idx + k.d) % (2 * s.n)) + 2 * s.n) % (2 * s.n) AS m, s.n FROM sized s, kernel k
), {name} AS (
    SELECT p.{key}, p.idx, sum(p.w * s.novelty) AS smooth
    FROM spots p JOIN sized s ON s.{key} = p.{key} AND s.idx = CASE WHEN p.m < p.n THEN p.m ELSE 2 * p.n - 1 - p.m END
    GROUP BY p.{key}, p.idx
)"""


_N = _G + ", nov AS (SELECT user_id, idx, abs(gradient) AS novelty FROM g)"


def _curve(spark, sf_dir, sigma=SIGMA_SHORT):
    smooth = signal.gaussian_smooth(_novel(spark, sf_dir), "user_id", "novelty", sigma, "smooth")
    return smooth.select("user_id", "idx", "value", F.round("smooth", 9).alias("smooth"))


_CURVE = _N + ", " + _smooth_sql(SIGMA_SHORT, "nov", "user_id", "raw") + ", curve AS (SELECT user_id, idx, round(smooth, 9) AS smooth FROM raw)"


def percentile_threshold(spark, sf_dir):
    rows = signal.percentile_threshold(_curve(spark, sf_dir), "user_id", "smooth", F.lit(THRESHOLD))
    return rows.groupBy("user_id").agg(F.round(F.first("height"), 6).alias("height"))


_HIGH = _CURVE + f", high AS (SELECT user_id, quantile_cont(smooth, {1 - THRESHOLD}) AS height FROM curve GROUP BY user_id)"


def local_maxima(spark, sf_dir):
    return signal.local_maxima(_curve(spark, sf_dir), "user_id", "smooth").select("user_id", "idx", _r("smooth"))


_MAXIMA = """marked AS (
    SELECT *, CASE WHEN smooth <> lag(smooth) OVER (PARTITION BY {key} ORDER BY idx) THEN 1 ELSE 0 END AS changed FROM {source}
), runs AS (SELECT *, sum(changed) OVER (PARTITION BY {key} ORDER BY idx) AS run FROM marked
), flat AS (SELECT {key}, run, min(idx) AS a, max(idx) AS b, any_value(smooth) AS smooth FROM runs GROUP BY {key}, run
), sided AS (
    SELECT *, lag(smooth) OVER w AS before, lead(smooth) OVER w AS after FROM flat WINDOW w AS (PARTITION BY {key} ORDER BY run)
), maxima AS (
    SELECT {key}, ((a + b) // 2)::INT AS idx, smooth FROM sided WHERE smooth > before AND smooth > after
)"""
_MAX_EVENTS = _HIGH + ", " + _MAXIMA.format(key="user_id", source="curve")


def _peaks(spark, sf_dir, distance=DISTANCE):
    n = F.count(F.lit(1)).over(signal._of("user_id"))
    return signal.peaks_of(_curve(spark, sf_dir), "user_id", "smooth", F.lit(THRESHOLD), F.lit(distance), n)


def peaks_distance(spark, sf_dir):
    return _peaks(spark, sf_dir).select("user_id", F.explode("peaks").alias("idx"))


def _peaks_sql(key: str, distance: int, source: str) -> str:
    return f"""tall AS (
    SELECT m.{key}, m.idx, m.smooth FROM maxima m JOIN high h USING ({key}) WHERE m.smooth >= h.height
), kept AS (
    SELECT {key}, list_sort(list_reduce(list([idx] ORDER BY smooth DESC, idx DESC),
        lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: abs(k - x[1]) < {distance})) = 0 THEN list_concat(acc, x) ELSE acc END)) AS peaks
    FROM tall GROUP BY {key}
), sizes AS (SELECT {key}, count(*)::BIGINT AS samples FROM {source} GROUP BY {key}
), peaks AS (SELECT s.{key}, s.samples, coalesce(k.peaks, []) AS peaks FROM sizes s LEFT JOIN kept k USING ({key}))"""


_PEAKS = _MAX_EVENTS + ", " + _peaks_sql("user_id", DISTANCE, "curve")


def _bounds(spark, sf_dir, gap=GAP):
    found = _peaks(spark, sf_dir)
    return found.select("user_id", "samples", signal.boundaries(F.col("peaks"), F.col("samples"), 1, F.lit(1), F.lit(gap)).alias("bounds"))


def boundaries(spark, sf_dir):
    return _bounds(spark, sf_dir).select("user_id", F.posexplode("bounds").alias("pos", "boundary"))


def _bounds_sql(key: str, hop: int, gap: float) -> str:
    return f"""greedy AS (
    SELECT {key}, samples, list_reduce(
        list_concat([[0::BIGINT]], list_concat(list_transform(peaks, lambda p: [(p * {hop})::BIGINT]), [[samples]])),
        lambda acc, x: CASE WHEN x[1] - acc[len(acc)] >= {gap} THEN list_concat(acc, x) ELSE acc END) AS k
    FROM peaks
), bounds AS (
    SELECT {key}, samples, CASE WHEN k[len(k)] = samples THEN k ELSE list_concat(k[1:len(k) - 1], [samples]) END AS bounds FROM greedy
)"""


_BOUNDS = _PEAKS + ", " + _bounds_sql("user_id", 1, GAP)
_SEGMENTS = """segments AS (
    SELECT {key}, (i - 1)::INT AS seg, bounds[i] AS start, bounds[i + 1] AS stop, bounds[i]::DOUBLE AS start_s
    FROM (SELECT {key}, bounds, unnest(range(1, len(bounds))) AS i FROM bounds)
)"""
_SEG_EVENTS = _BOUNDS + ", " + _SEGMENTS.format(key="user_id")


def _segments(spark, sf_dir):
    return signal.segments(_bounds(spark, sf_dir), "user_id", "bounds", F.lit(1))


def segments(spark, sf_dir):
    return _segments(spark, sf_dir)


def auto_segments(spark, sf_dir):
    """Least duration, threshold and peak distance follow from each series' length."""
    n = F.count(F.lit(1)).over(signal._of("user_id"))
    least, threshold = signal.parameters(n, F.lit(1), None, None)
    found = signal.peaks_of(_curve(spark, sf_dir), "user_id", "smooth", threshold, F.floor(least).cast("int"), n)
    least, _ = signal.parameters(F.col("samples"), F.lit(1), None, None)
    bounds = found.select("user_id", signal.boundaries(F.col("peaks"), F.col("samples"), 1, F.lit(1), least).alias("bounds"))
    return signal.segments(bounds, "user_id", "bounds", F.lit(1))


# --- all events as one series, which no task has whole -----------------------------------------

#: Indices of a block of the long series.
LONG_BLOCK = 4096


def _long_curve(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.lit(0).cast("long").alias("user_id"), F.col("event_id").cast("int").alias("idx"), "value")
    smooth = long_series.smoothed_novelty(rows, "user_id", ["value"], SIGMA_SHORT, LONG_BLOCK)
    return smooth.withColumn("smooth", F.round("smooth", 9))


def long_smooth(spark, sf_dir):
    return _long_curve(spark, sf_dir).select("idx", _r("novelty"), _r("smooth"))


def _long(spark, sf_dir):
    scratch = Scratch(spark, "long-series")
    curve = scratch.written(_long_curve(spark, sf_dir), "curve")
    facts = curve.groupBy("user_id").agg(F.max("n").alias("samples")).withColumns({"threshold": F.lit(THRESHOLD), "distance": F.lit(DISTANCE).cast("long")})
    return scratch, curve, scratch.written(facts, "facts")


def long_threshold(spark, sf_dir):
    scratch, curve, facts = _long(spark, sf_dir)
    return scratch.result(long_series.percentiles(curve, "user_id", "smooth", facts, scratch, LONG_BLOCK).select(_r("height")))


def long_peaks(spark, sf_dir):
    scratch, curve, facts = _long(spark, sf_dir)
    return scratch.result(long_series.peaks(curve, "user_id", "smooth", facts, scratch, LONG_BLOCK).select("idx"))


def long_segments(spark, sf_dir):
    scratch, curve, facts = _long(spark, sf_dir)
    found = long_series.peaks(curve, "user_id", "smooth", facts, scratch, LONG_BLOCK)
    bounds = long_series.boundaries(found, facts, "user_id", 1, F.lit(1), F.lit(float(GAP)), scratch)
    rates = facts.select("user_id", F.lit(1).alias("sr"))
    return scratch.result(long_series.segments(bounds, "user_id", rates).drop("user_id"))


_ALL = "series AS (SELECT 0::BIGINT AS user_id, event_id::INT AS idx, value FROM events)"


def segment_stats(spark, sf_dir):
    joined = signal.label(_series(spark, sf_dir), _segments(spark, sf_dir), "user_id").where("seg is not null")
    return joined.groupBy("user_id", "seg").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


def short_series_quirk(spark, sf_dir):
    found = _peaks(spark, sf_dir)
    bounds = signal.boundaries(F.col("peaks"), F.col("samples"), 1, F.lit(1), F.lit(1000))
    return found.select("user_id", F.get(bounds, F.lit(0)).alias("first"), (F.size(bounds) - 1).alias("segments"))


def running_segment(spark, sf_dir):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("seg"))
    return _segments(spark, sf_dir).select("user_id", "seg", nth.alias("current"))


# --- frames ------------------------------------------------------------------------------------

_FRAMES = f"""padded AS (
    SELECT vec_id, list_concat(list_transform(range({N_FFT // 2}), lambda i: 0.0::DOUBLE), list_concat(embedding::DOUBLE[], list_transform(range({N_FFT // 2}), lambda i: 0.0::DOUBLE))) AS x
    FROM embeddings
), frames AS (
    SELECT vec_id, k::INT AS frame, x[k * {HOP} + 1:k * {HOP} + {N_FFT}] AS f FROM (SELECT vec_id, x, unnest(range(0, {64 // HOP + 1})) AS k FROM padded)
)"""


def _frames(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(spectral.frames(F.col("embedding"), N_FFT, HOP)).alias("frame", "f"))


def frames(spark, sf_dir):
    return _frames(spark, sf_dir).select("vec_id", "frame", F.posexplode("f").alias("pos", "x")).select("vec_id", "frame", "pos", _r("x"))


def frame_rms(spark, sf_dir):
    return _frames(spark, sf_dir).select("vec_id", "frame", F.round(spectral.rms(F.col("f")), 6).alias("rms"))


def stft_magnitude(spark, sf_dir):
    m = spectral.stft(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", N_FFT, HOP)
    return m.select("vec_id", "frame", "bin", _r("magnitude"))


_STFT = _FRAMES + f""", samples AS (
    SELECT vec_id, frame, i - 1 AS t, f[i] * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / {N_FFT})) AS x FROM (SELECT vec_id, frame, f, unnest(range(1, {N_FFT + 1})) AS i FROM frames)
), bins AS (
    SELECT vec_id, frame, b::INT AS bin,
           sqrt(sum(x * cos(2 * pi() * b * t / {N_FFT})) ** 2 + sum(x * sin(2 * pi() * b * t / {N_FFT})) ** 2) AS magnitude
    FROM samples, range(0, {N_FFT // 2 + 1}) r(b) GROUP BY vec_id, frame, b
)"""


def spectral_centroid(spark, sf_dir):
    c = spectral.spectral_centroid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", RATE, N_FFT, HOP)
    return c.select("vec_id", "frame", _r("centroid"))


_CENTROID = _STFT + f""", centroids AS (
    SELECT vec_id, frame, coalesce(sum(magnitude * bin * {RATE} / {N_FFT}) / nullif(sum(magnitude), 0), 0) AS centroid FROM bins GROUP BY vec_id, frame
)"""
_GAP2 = 12


def boundaries_2feature(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    rows = spectral.features(e, "vec_id", "embedding", RATE, N_FFT, HOP).withColumnRenamed("frame", "idx")
    smooth = signal.gaussian_smooth(signal.novelty(rows, "vec_id", ["centroid", "rms"]), "vec_id", "novelty", SIGMA_SHORT, "smooth")
    smooth = smooth.withColumn("smooth", F.round("smooth", 9))
    found = signal.peaks_of(smooth, "vec_id", "smooth", F.lit(THRESHOLD), F.lit(_GAP2 // HOP), F.lit(64).cast("long"))
    bounds = signal.boundaries(F.col("peaks"), F.col("samples"), HOP, F.lit(1), F.lit(_GAP2))
    return found.select("vec_id", F.posexplode(bounds).alias("pos", "boundary"))


_TWO = (
    _CENTROID
    + ", two AS (SELECT c.vec_id, c.frame AS idx, c.centroid, sqrt(list_sum(list_transform(f, lambda x: x * x)) / len(f)) AS rms FROM centroids c JOIN frames USING (vec_id, frame))"
    + """, zz AS (
    SELECT vec_id, idx, (centroid - avg(centroid) OVER p) / nullif(stddev_pop(centroid) OVER p, 0) AS c, (rms - avg(rms) OVER p) / nullif(stddev_pop(rms) OVER p, 0) AS r
    FROM two WINDOW p AS (PARTITION BY vec_id)
), nov AS (
    SELECT vec_id, idx,
        abs(CASE WHEN idx = 0 THEN lead(c) OVER w - c WHEN idx = max(idx) OVER (PARTITION BY vec_id) THEN c - lag(c) OVER w ELSE (lead(c) OVER w - lag(c) OVER w) / 2 END)
      + abs(CASE WHEN idx = 0 THEN lead(r) OVER w - r WHEN idx = max(idx) OVER (PARTITION BY vec_id) THEN r - lag(r) OVER w ELSE (lead(r) OVER w - lag(r) OVER w) / 2 END) AS novelty
    FROM zz WINDOW w AS (PARTITION BY vec_id ORDER BY idx)
), """
    + _smooth_sql(SIGMA_SHORT, "nov", "vec_id", "raw")
    + f""", curve AS (SELECT vec_id, idx, round(smooth, 9) AS smooth FROM raw)
, high AS (SELECT vec_id, quantile_cont(smooth, {1 - THRESHOLD}) AS height FROM curve GROUP BY vec_id), """
    + _MAXIMA.format(key="vec_id", source="curve")
    + ", "
    + _peaks_sql("vec_id", _GAP2 // HOP, "curve").replace("count(*)::BIGINT AS samples", "64::BIGINT AS samples")
    + ", "
    + _bounds_sql("vec_id", HOP, _GAP2)
)


def downmix(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    # two channels of 32 samples, one after the other
    mono = audio.mapped(e, "vec_id", "embedding", lambda x: audio.downmix(x.reshape(2, -1).T))
    return mono.select("vec_id", F.posexplode("signal").alias("pos", "x")).select("vec_id", "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


def resample(spark, sf_dir):
    out = audio.mapped(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda x: audio.resample(x, 48, 32))
    return out.select("vec_id", F.posexplode("signal").alias("pos", "x")).select("vec_id", "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


# weights of 48 inputs on either side of each output, a raised cosine times a sinc at two thirds of the band
_RESAMPLE = """WITH outs AS (SELECT i, i * 1.5::DOUBLE AS place FROM range(0, 43) t(i)
), raw AS (
    SELECT i, floor(place)::INT + r AS j, (place - floor(place)) - r AS d FROM outs, range(-47, 49) u(r)
), weighted AS (
    SELECT i, j, 2.0::DOUBLE / 3 * CASE WHEN d = 0 THEN 1 ELSE sin(pi() * d * 2 / 3) / (pi() * d * 2 / 3) END * cos(pi() * d / 98) ** 2 AS w FROM raw
), normed AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM weighted
), samples AS (SELECT vec_id, unnest(range(0, 64)) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, i::INT AS pos, round((sum(x * w)::FLOAT)::DOUBLE, 6) AS x FROM samples JOIN normed USING (j) GROUP BY vec_id, i"""


# --- scalars and tracks ------------------------------------------------------------------------


def hms_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.hms(F.col("value") * 500).alias("time"))


def frame_to_seconds(spark, sf_dir):
    return _series(spark, sf_dir).select("user_id", "idx", F.round(F.col("idx") * 512 / 22050, 6).alias("seconds"))


def _ids(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    wanted = F.when(k == "0", "").when(k.cast("int") % 10 == 9, F.lit(None)).otherwise(k)
    return table(spark, sf_dir, "events").select("user_id", wanted.alias("id"))


_IDS = """ids AS (
    SELECT user_id, CASE WHEN k = '0' THEN '' WHEN k::INT % 10 = 9 THEN NULL ELSE k END AS id FROM (SELECT user_id, json_extract_string(props, '$.k') AS k FROM events)
)"""


def match_count(spark, sf_dir):
    ids = _ids(spark, sf_dir).groupBy("user_id").agg(F.collect_list(F.struct("id")).alias("ids"))
    return ids.select("user_id", scalars.match_count(F.col("ids.id")).alias("match_count"))


def duplicate_ids(spark, sf_dir):
    ids = _ids(spark, sf_dir).groupBy("user_id").agg(F.collect_list(F.struct("id")).alias("ids"))
    return ids.select("user_id", scalars.duplicate_ids(F.col("ids.id")).alias("duplicates"))


def confidence_tier(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", "event_type", "n", scalars.confidence(F.col("n")).alias("tier"))


def json_get_default(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    body = F.when(F.pmod("event_id", F.lit(3)) == 0, F.lit("{}")).when(F.pmod("event_id", F.lit(3)) == 1, F.lit('{"k": null}')).otherwise(F.col("props"))
    return e.select("event_id", scalars.json_or(body, "k", "Unknown").alias("k"))


def recognized_segments(spark, sf_dir):
    found = _segments(spark, sf_dir)
    has = F.pmod(F.col("user_id") + F.col("seg"), F.lit(3)) != 0
    responses = found.where(has).select("user_id", "seg", F.concat(F.lit("t"), F.pmod(F.col("user_id") * 7 + F.col("seg"), F.lit(5)).cast("string")).alias("title"))
    return tracks.attach(found.select("user_id", "seg", "start_s"), responses, ["user_id", "seg"])


def _part_tracks(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.pmod("p_partkey", F.lit(10)).alias("file"), F.col("p_partkey").alias("pos"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"), F.col("p_size").alias("match_count"), F.concat(F.lit("u/"), F.col("p_partkey").cast("string")).alias("track_url"))


def dedup_tracks(spark, sf_dir):
    rows = _part_tracks(spark, sf_dir).withColumn("all", F.lit(0))
    return tracks.dedup(rows, ["all"], "pos").select("pos", "artist", "title")


def dedup_counts(spark, sf_dir):
    return tracks.counts(_part_tracks(spark, sf_dir), "file")


def _line(spark, sf_dir):
    p = _part_tracks(spark, sf_dir)
    count = F.when(F.pmod("pos", F.lit(4)) != 0, F.col("match_count"))
    return p.select("file", "pos", scalars.txt_line(scalars.hms(F.col("pos") * 7), F.col("title"), F.col("artist"), count).alias("line"))


_PART = """tracks AS (
    SELECT p_partkey % 10 AS file, p_partkey AS pos, p_brand AS artist, p_name AS title, p_size AS match_count, 'u/' || p_partkey AS track_url FROM part
)"""
_LINE = _PART + """, lines AS (
    SELECT file, pos, printf('%02d:%02d:%02d', (pos * 7) // 3600, ((pos * 7) % 3600) // 60, (pos * 7) % 60) || ' - ' || title || ' - ' || artist
        || CASE WHEN pos % 4 <> 0 THEN ' [' || match_count || ' matches]' ELSE '' END AS line
    FROM tracks
)"""
_PARSE = """parsed AS (
    SELECT file, pos, line, string_split(line, ' - ') AS p, array_to_string(string_split(line, ' - ')[3:], ' - ') AS rest FROM lines
), parts AS (
    SELECT file, pos, line, p[1] AS time, p[2] AS title, string_split(rest, ' [')[1] AS artist,
           CASE WHEN contains(rest, ' [') THEN ' [' || string_split(rest, ' [')[2] ELSE '' END AS confidence FROM parsed
)"""


def txt_line(spark, sf_dir):
    return _line(spark, sf_dir).select("pos", "line")


def txt_parse(spark, sf_dir):
    p = scalars.line_parts(F.col("line"))
    return _line(spark, sf_dir).select("pos", p["time"].alias("time"), p["title"].alias("title"), p["artist"].alias("artist"), p["confidence"].alias("confidence"))


def _linked(spark, sf_dir):
    known = _part_tracks(spark, sf_dir).where(F.pmod("pos", F.lit(3)) != 0)
    return tracks.link_lines(_line(spark, sf_dir), known, "file", "pos")


def link_join(spark, sf_dir):
    return _linked(spark, sf_dir).select("pos", "url")


_LINKED = _LINE + ", " + _PARSE + """, urls AS (
    SELECT file, title || ' - ' || artist AS key, max_by(track_url, pos) AS url FROM tracks WHERE pos % 3 <> 0 GROUP BY ALL
), linked AS (SELECT x.*, u.url FROM parts x LEFT JOIN urls u ON u.file = x.file AND u.key = x.title || ' - ' || x.artist)"""


def render_line(spark, sf_dir):
    return _linked(spark, sf_dir).select("pos", scalars.rendered(F.col("line"), F.col("url")).alias("html"))


# --- results and tasks -------------------------------------------------------------------------


def recent_results(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return results.recent(o, F.col("o_orderdate"), [F.col("o_orderkey")]).select("o_orderkey", "created")


def unique_name(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(".mp3")).alias("name"))
    return results.unique_names(d, "name", ["doc_id"]).select("doc_id", "json_name")


def free_name(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(".mp3")).alias("name"))
    n = F.pmod("doc_id", F.lit(30)).cast("string")
    there = table(spark, sf_dir, "documents").where(F.pmod("doc_id", F.lit(7)) == 0).select(F.concat("source", F.lit("_tracklist("), n, F.lit(").json")).alias("name"))
    return results.free_names(d, there, "name", ["doc_id"]).select("doc_id", "json_name")


_FREE = """asked AS (
    SELECT doc_id, source AS stem, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents
), taken AS (SELECT DISTINCT source AS stem, doc_id % 30 AS number FROM documents WHERE doc_id % 7 = 0 AND doc_id % 30 > 0
    UNION SELECT DISTINCT source, 0 FROM documents WHERE doc_id % 7 = 0 AND doc_id % 30 = 0
), numbers AS (
    SELECT stem, unnest(range(0, max(nth) + 31)) AS number FROM asked GROUP BY stem
), free AS (
    SELECT stem, number, row_number() OVER (PARTITION BY stem ORDER BY number) AS nth FROM numbers ANTI JOIN taken USING (stem, number)
)"""


def allowed_ext(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    kinds = F.array(*[F.lit(x) for x in ("mp3", "WAV", "html", "flac", "txt", "Ogg", "")])
    name = F.concat(F.element_at(F.split("url", "/"), -1), F.when(F.pmod("page_id", F.lit(8)) == 7, "").otherwise(F.concat(F.lit("."), F.get(kinds, F.pmod("page_id", F.lit(7)).cast("int")))))
    return p.select("page_id", name.alias("name")).where(scalars.allowed_extension(F.col("name")))


def size_guard(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 262144).alias("size"))
    return d.select("doc_id", scalars.too_large(F.col("size")).alias("too_large"))


def duration_guard(spark, sf_dir):
    seconds = F.when(F.pmod("event_id", F.lit(5)) == 0, F.lit(0.0)).otherwise(F.col("value") * 50)
    return table(spark, sf_dir, "events").select("event_id", scalars.too_long(seconds).alias("too_long"))


def http_route_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing").otherwise("error")
    key = F.col("o_orderkey")
    kind = F.get(F.array(F.lit("json"), F.lit("txt"), F.lit("csv")), F.pmod(key, F.lit(3)).cast("int"))
    return o.select("o_orderkey", scalars.download_status(F.pmod(key, F.lit(11)) != 0, status, kind, F.pmod(key, F.lit(7)) != 0).alias("http_status"))


_STATUS = ["pending", "downloading", "processing", "completed", "error"]


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kinds = F.array(*[F.lit(s) for s in _STATUS])
    return e.select("event_id", F.col("user_id").alias("task_id"), F.col("ts"), F.get(kinds, F.pmod("event_id", F.lit(5)).cast("int")).alias("status"), F.pmod("event_id", F.lit(101)).cast("int").alias("progress"))


_LOG = """log AS (
    SELECT event_id, user_id AS task_id, ts, ['pending', 'downloading', 'processing', 'completed', 'error'][event_id % 5 + 1] AS status, (event_id % 101)::INT AS progress FROM events
), latest AS (
    SELECT task_id, arg_max(status, event_id) AS status, arg_max(progress, event_id) AS progress FROM log GROUP BY task_id
)"""


def _latest(spark, sf_dir):
    return tasks.latest(_log(spark, sf_dir), "task_id", ["ts", "event_id"], ["status", "progress"])


def task_latest(spark, sf_dir):
    return _latest(spark, sf_dir)


def task_interrupted(spark, sf_dir):
    full = _latest(spark, sf_dir).withColumn("message", F.lit("m")).withColumn("error", F.lit(None).cast("string"))
    return tasks.interrupt(full)


def interrupted_count(spark, sf_dir):
    return tasks.interrupted_count(_latest(spark, sf_dir))


def stale_sweep(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return tasks.stale(e.select("event_id", "ts"), F.col("ts"), now).select("event_id")


def status_lookup(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    asked = c.select(F.col("c_custkey").alias("id"))
    memory = c.where(F.pmod("c_custkey", F.lit(3)) == 0).select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"))
    disk = o.groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"))
    return tasks.lookup(asked, memory, disk, "id", ["status"])


def _downloader_log(spark, sf_dir):
    kind = F.pmod("event_id", F.lit(5))
    pct = F.format_string("%.1f", F.pmod(F.col("event_id") * 7, F.lit(1000)) / 10)
    line = (
        F.when(kind == 0, F.concat(F.lit("[download] "), pct, F.lit("% of 3.00MiB at 1.0MiB/s")))
        .when(kind == 1, "[ExtractAudio] Destination: a.mp3")
        .when(kind == 2, "[download] Destination: a.webm")
        .when(kind == 3, "[download] n/a% of ~5%")
        .otherwise("[info] starting")
    )
    return table(spark, sf_dir, "events").select("event_id", "user_id", line.alias("line"))


_DL = """dl AS (
    SELECT event_id, user_id, CASE event_id % 5
        WHEN 0 THEN '[download] ' || printf('%.1f', (event_id * 7 % 1000) / 10) || '% of 3.00MiB at 1.0MiB/s'
        WHEN 1 THEN '[ExtractAudio] Destination: a.mp3' WHEN 2 THEN '[download] Destination: a.webm'
        WHEN 3 THEN '[download] n/a% of ~5%' ELSE '[info] starting' END AS line FROM events
)"""


def progress_parse(spark, sf_dir):
    pct = scalars.percent(F.col("line"))
    return _downloader_log(spark, sf_dir).select("event_id", scalars.log_kind(F.col("line")).alias("kind"), pct.alias("pct"), scalars.download_progress(pct).alias("progress"), scalars.percent_text(pct).alias("text"))


def progress_map(spark, sf_dir):
    found = _segments(spark, sf_dir)
    total = F.count(F.lit(1)).over(signal._of("user_id"))
    return found.select("user_id", "seg", scalars.recognition_progress(F.col("seg") + 1, total).alias("progress"))


def log_tail(spark, sf_dir):
    return tasks.tail(_downloader_log(spark, sf_dir), "user_id", "event_id").select("user_id", "event_id", "line")


def error_text(spark, sf_dir):
    return tasks.error_text(_downloader_log(spark, sf_dir), "user_id", "event_id", "line")


def drop_volatile(spark, sf_dir):
    return tasks.drop_volatile(_log(spark, sf_dir).withColumn("filepath", F.lit("/x")).withColumn("_analyzer", F.lit(1)))


def task_state_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    # a pattern, so that the table may be one file or a folder of them
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    kinds = F.array(*[F.lit(s) for s in _STATUS])
    log = source.select("event_id", F.col("user_id").alias("task_id"), "ts", F.get(kinds, F.pmod("event_id", F.lit(5)).cast("int")).alias("status"), F.pmod("event_id", F.lit(101)).cast("int").alias("progress"))
    states = task_stream.latest_stream(log, "task_id", ["ts", "event_id"], ["status", "progress"])
    return task_stream.run_available(states, "task_id", task_stream.state_root(spark))


# --- requests, files and events -----------------------------------------------------------------


def url_status(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    url = F.when(F.pmod("page_id", F.lit(4)) == 0, "").otherwise(F.col("url"))
    return p.select("page_id", scalars.url_status(url, F.pmod("page_id", F.lit(5)) != 0).alias("http_status"))


def upload_status(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kinds = F.array(*[F.lit(x) for x in ("a.mp3", "b.WAV", "c.txt", "", "noext")])
    name = F.get(kinds, F.pmod("p_partkey", F.lit(5)).cast("int"))
    return p.select("p_partkey", scalars.upload_status(name, F.col("p_size").cast("long") * 20_000_000).alias("http_status"))


def view_status(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.concat("p_name", F.when(F.pmod("p_partkey", F.lit(2)) == 0, ".txt").otherwise(".json"))
    there = F.pmod("p_partkey", F.lit(3)) != 0
    return p.select("p_partkey", scalars.view_status(there, name).alias("view"), scalars.served_status(there).alias("served"))


def stored_name(spark, sf_dir):
    name = F.concat("event_type", F.lit(".mp3"))
    return table(spark, sf_dir, "events").select("event_id", scalars.upload_name(name, F.col("ts")).alias("name"), scalars.iso_time(F.date_trunc("second", "ts")).alias("at"))


def path_names(spark, sf_dir):
    path = F.concat(F.lit("out/"), "p_name", F.lit("_tracklist.json"))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.txt_path(path).alias("txt"), scalars.display_name(path).alias("name"))


def too_long_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.too_long_text(F.col("value") * 50).alias("text"))


def first_match(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    prefix = F.format_string("20240101_%06d_", F.pmod("doc_id", F.lit(50)))
    files = d.select(F.concat(F.lit("in/"), prefix, F.col("doc_id").cast("string"), F.when(F.pmod("doc_id", F.lit(3)) == 0, ".webm").otherwise(".mp3")).alias("path"))
    wanted = d.select("doc_id", F.format_string("20240101_%06d_", F.pmod("doc_id", F.lit(60))).alias("prefix"))
    return results.first_match(files, wanted, "doc_id")


def swept_count(spark, sf_dir):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return tasks.swept_count(table(spark, sf_dir, "events"), F.col("ts"), now)


_KINDS = ["url", "upload", "start_download", "download", "destination", "convert", "downloaded", "load", "signal", "features", "novelty", "peaks", "segments", "recognise", "dedup", "done", "failed"]


def progress_events(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, _KINDS)), F.pmod("event_id", F.lit(len(_KINDS))).cast("int"))
    after = scalars.progress_event(kind, F.pmod("event_id", F.lit(101)).cast("double"), F.pmod("event_id", F.lit(9)), F.lit(9))
    return table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), after["progress"].alias("progress"), after["status"].alias("status"))


def parsed_responses(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    track = F.format_string('{"track": {"title": "%s", "url": "u%d"}, "matches": [{"id": "%d"}, {"id": ""}, {"id": "%d"}]}', "event_type", "event_id", F.pmod("event_id", F.lit(3)), F.pmod("event_id", F.lit(2)))
    body = F.when(F.pmod("event_id", F.lit(4)) == 0, '{"track": null}').otherwise(track)
    parsed = tracks.parse_responses(e.select("event_id", body.alias("response"), F.col("value").alias("start_s")))
    return parsed.select("event_id", "title", "artist", "track_url", "match_count", "start_time", "found")


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


_SQL = {
    "resample": _RESAMPLE,
    "url_status": "SELECT page_id, (CASE WHEN page_id % 5 = 0 THEN 422 WHEN page_id % 4 = 0 THEN 400 ELSE 200 END)::INT AS http_status FROM pages",
    "upload_status": "SELECT p_partkey, (CASE WHEN p_partkey % 5 >= 2 THEN 400 WHEN p_size * 20000000 > 500 * 1024 * 1024 THEN 413 ELSE 200 END)::INT AS http_status FROM part",
    "view_status": "SELECT p_partkey, (CASE WHEN p_partkey % 3 = 0 THEN 404 WHEN p_partkey % 2 = 1 THEN 400 ELSE 200 END)::INT AS view, (CASE WHEN p_partkey % 3 = 0 THEN 404 ELSE 200 END)::INT AS served FROM part",
    "stored_name": "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') || '_' || event_type || '.mp3' AS name, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events",
    "path_names": "SELECT p_partkey, 'out/' || p_name || '_tracklist.txt' AS txt, p_name AS name FROM part",
    "too_long_text": "SELECT event_id, CASE WHEN value * 50 > 7200 THEN printf('Audio too long for analysis: %d min (max 120 min). Please trim the file and retry.', floor(value * 50 / 60)::BIGINT) END AS text FROM events",
    "first_match": "WITH f AS (SELECT doc_id % 50 AS k, min('in/' || printf('20240101_%06d_', doc_id % 50) || doc_id || '.mp3') AS path FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1) SELECT doc_id, path FROM documents LEFT JOIN f ON k = doc_id % 60",
    "swept_count": "SELECT count(*)::BIGINT AS swept FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOURS",
    "progress_events": f"""WITH k AS (SELECT event_id, {_KINDS}[event_id % {len(_KINDS)} + 1] AS kind FROM events)
        SELECT event_id, kind, (CASE kind WHEN 'download' THEN 2 + trunc((event_id % 101) * 0.05) WHEN 'recognise' THEN 25 + trunc((event_id % 9) * 65 / 9)
            WHEN 'start_download' THEN 5 WHEN 'destination' THEN 3 WHEN 'convert' THEN 8 WHEN 'downloaded' THEN 10 WHEN 'load' THEN 12 WHEN 'signal' THEN 14 WHEN 'features' THEN 16
            WHEN 'novelty' THEN 18 WHEN 'peaks' THEN 20 WHEN 'segments' THEN 23 WHEN 'dedup' THEN 95 WHEN 'done' THEN 100 ELSE 0 END)::INT AS progress,
            CASE WHEN kind IN ('url', 'start_download', 'download', 'destination', 'convert') THEN 'downloading' WHEN kind = 'done' THEN 'completed' WHEN kind = 'failed' THEN 'error' ELSE 'processing' END AS status FROM k""",
    "parsed_responses": """SELECT event_id, CASE WHEN t THEN event_type END AS title, CASE WHEN t THEN 'Unknown' END AS artist, CASE WHEN t THEN 'u' || event_id END AS track_url,
            CASE WHEN t THEN len(list_distinct(list_filter([event_id % 3, event_id % 2], lambda x: x <> 0)))::INT END AS match_count,
            CASE WHEN t THEN printf('%02d:%02d:%02d', floor(value)::BIGINT // 3600, (floor(value)::BIGINT % 3600) // 60, floor(value)::BIGINT % 60) END AS start_time, t AS found
        FROM (SELECT *, event_id % 4 <> 0 AS t FROM events)""",
    "signal_series": _with(_SERIES, "SELECT user_id, idx, value FROM series"),
    "duration": "SELECT user_id, count(*)::BIGINT AS samples, count(*)::DOUBLE AS seconds FROM events GROUP BY user_id",
    "auto_params": f"SELECT event_id, ({_AUTO})::INT AS min_duration, ({_AUTO_T})::DOUBLE AS threshold FROM events",
    "param_override": f"SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 4 * 10)::INT END, 0), {_AUTO})::INT AS min_duration FROM events",
    "zscore": _with(_Z, "SELECT user_id, idx, round(z, 6) AS z FROM z"),
    "gradient": _with(_G, "SELECT user_id, idx, round(gradient, 6) AS gradient FROM g"),
    "novelty": _with(_N, "SELECT user_id, idx, round(novelty, 6) AS novelty FROM nov"),
    "gaussian_smooth": _with(_N + ", " + _smooth_sql(10.0, "nov", "user_id", "sm"), "SELECT user_id, idx, round(smooth, 6) AS smooth FROM sm"),
    "percentile_threshold": _with(_HIGH, "SELECT user_id, round(height, 6) AS height FROM high"),
    "local_maxima": _with(_MAX_EVENTS, "SELECT user_id, idx, round(smooth, 6) AS smooth FROM maxima"),
    "peaks_distance": _with(_PEAKS, "SELECT user_id, unnest(peaks) AS idx FROM peaks"),
    "boundaries": _with(_BOUNDS, "SELECT user_id, (i - 1)::INT AS pos, bounds[i] AS boundary FROM (SELECT user_id, bounds, unnest(range(1, len(bounds) + 1)) AS i FROM bounds)"),
    "segments": _with(_SEG_EVENTS, "SELECT user_id, seg, start, stop, start_s FROM segments"),
    "segment_stats": _with(_SEG_EVENTS, "SELECT g.user_id, g.seg, count(*)::BIGINT AS n, round(avg(s.value), 6) AS mean, min(s.value) AS low, max(s.value) AS high FROM segments g JOIN series s ON s.user_id = g.user_id AND s.idx >= g.start AND s.idx < g.stop GROUP BY ALL"),
    "short_series_quirk": _with(_PEAKS + ", " + _bounds_sql("user_id", 1, 1000), "SELECT user_id, bounds[1] AS first, (len(bounds) - 1)::INT AS segments FROM bounds"),
    "auto_segments": _with(_MAX_EVENTS + ", " + _peaks_sql("user_id", 30, "curve") + ", " + _bounds_sql("user_id", 1, 30) + ", " + _SEGMENTS.format(key="user_id"), "SELECT user_id, seg, start, stop, start_s FROM segments"),
    "long_smooth": _with(_CURVE, "SELECT idx, round(novelty, 6) AS novelty, round(c.smooth, 6) AS smooth FROM nov JOIN curve c USING (idx)").replace(_SERIES, _ALL),
    "long_threshold": _with(_HIGH, "SELECT round(height, 6) AS height FROM high").replace(_SERIES, _ALL),
    "long_peaks": _with(_PEAKS, "SELECT unnest(peaks)::BIGINT AS idx FROM peaks").replace(_SERIES, _ALL),
    "long_segments": _with(_SEG_EVENTS, "SELECT seg, start, stop, start_s FROM segments").replace(_SERIES, _ALL),
    "running_segment": _with(_SEG_EVENTS, "SELECT user_id, seg, (row_number() OVER (PARTITION BY user_id ORDER BY seg))::INT AS current FROM segments"),
    "frames": _with(_FRAMES, f"SELECT vec_id, frame, (i - 1)::INT AS pos, round(f[i], 6) AS x FROM (SELECT vec_id, frame, f, unnest(range(1, {N_FFT + 1})) AS i FROM frames)"),
    "frame_rms": _with(_FRAMES, "SELECT vec_id, frame, round(sqrt(list_sum(list_transform(f, lambda x: x * x)) / len(f)), 6) AS rms FROM frames"),
    "stft_magnitude": _with(_STFT, "SELECT vec_id, frame, bin, round(magnitude, 6) AS magnitude FROM bins"),
    "spectral_centroid": _with(_CENTROID, "SELECT vec_id, frame, round(centroid, 6) AS centroid FROM centroids"),
    "boundaries_2feature": _with(_TWO, "SELECT vec_id, (i - 1)::INT AS pos, bounds[i] AS boundary FROM (SELECT vec_id, bounds, unnest(range(1, len(bounds) + 1)) AS i FROM bounds)"),
    "downmix": "SELECT vec_id, (i - 1)::INT AS pos, round(((embedding[i] + embedding[i + 32])::FLOAT)::DOUBLE / 2, 6) AS x FROM (SELECT vec_id, embedding, unnest(range(1, 33)) AS i FROM embeddings)",
    "hms_format": "SELECT event_id, printf('%02d:%02d:%02d', floor(value * 500)::BIGINT // 3600, (floor(value * 500)::BIGINT % 3600) // 60, floor(value * 500)::BIGINT % 60) AS time FROM events",
    "frame_to_seconds": _with(_SERIES, "SELECT user_id, idx, round(idx * 512 / 22050, 6) AS seconds FROM series"),
    "match_count": _with(_IDS, "SELECT user_id, count(DISTINCT CASE WHEN id <> '' THEN id END)::INT AS match_count FROM ids GROUP BY user_id"),
    "duplicate_ids": _with(_IDS, "SELECT user_id, (count(CASE WHEN id <> '' THEN id END) - count(DISTINCT CASE WHEN id <> '' THEN id END))::INT AS duplicates FROM ids GROUP BY user_id"),
    "confidence_tier": "SELECT user_id, event_type, count(*)::BIGINT AS n, CASE WHEN count(*) <= 5 THEN 'high' WHEN count(*) <= 15 THEN 'medium' ELSE 'low' END AS tier FROM events GROUP BY user_id, event_type",
    "json_get_default": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Unknown' WHEN 1 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events",
    "recognized_segments": _with(_SEG_EVENTS, "SELECT user_id, seg, start_s, CASE WHEN (user_id + seg) % 3 <> 0 THEN 't' || ((user_id * 7 + seg) % 5) END AS title FROM segments"),
    "dedup_tracks": _with(_PART, "SELECT arg_min(pos, pos) AS pos, arg_min(artist, pos) AS artist, arg_min(title, pos) AS title FROM tracks GROUP BY lower(artist) || '_' || lower(title)"),
    "dedup_counts": _with(_PART, "SELECT file, count(*)::BIGINT AS total_segments, count(title)::BIGINT AS total_tracks_found, count(DISTINCT lower(artist) || '_' || lower(title))::BIGINT AS unique_tracks FROM tracks GROUP BY file"),
    "txt_line": _with(_LINE, "SELECT pos, line FROM lines"),
    "txt_parse": _with(_LINE + ", " + _PARSE, "SELECT pos, time, title, artist, confidence FROM parts"),
    "link_join": _with(_LINKED, "SELECT pos, url FROM linked"),
    "render_line": _with(
        _LINKED + ", esc AS (SELECT *, replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS safe FROM linked)",
        "SELECT pos, CASE WHEN coalesce(url, '') <> '' THEN time || ' - <a href=\"' || url || '\">' || replace(replace(title, '&', '&amp;'), '''', '&#x27;') || '</a> - ' || artist || confidence ELSE safe END AS html FROM esc",
    ),
    "recent_results": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS created FROM orders ORDER BY created DESC, o_orderkey LIMIT 10",
    "unique_name": "SELECT doc_id, source || '_tracklist' || CASE WHEN n = 0 THEN '' ELSE '(' || n || ')' END || '.json' AS json_name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)",
    "free_name": _with(_FREE, "SELECT doc_id, stem || '_tracklist' || CASE WHEN number = 0 THEN '' ELSE '(' || number || ')' END || '.json' AS json_name FROM asked JOIN free USING (stem, nth)"),
    "allowed_ext": "SELECT page_id, name FROM (SELECT page_id, string_split(url, '/')[-1] || CASE WHEN page_id % 8 = 7 THEN '' ELSE '.' || ['mp3', 'WAV', 'html', 'flac', 'txt', 'Ogg', ''][page_id % 7 + 1] END AS name FROM pages) WHERE contains(name, '.') AND lower(string_split(name, '.')[-1]) IN ('mp3', 'wav', 'flac', 'm4a', 'ogg', 'wma', 'aac')",
    "size_guard": "SELECT doc_id, n_chars * 262144 > 500 * 1024 * 1024 AS too_large FROM documents",
    "duration_guard": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN false ELSE value * 50 <> 0 AND value * 50 > 7200 END AS too_long FROM events",
    "http_route_status": "SELECT o_orderkey, (CASE WHEN o_orderkey % 11 = 0 THEN 404 WHEN o_orderstatus <> 'F' THEN 400 WHEN o_orderkey % 3 = 2 THEN 400 WHEN o_orderkey % 7 = 0 THEN 404 ELSE 200 END)::INT AS http_status FROM orders",
    "task_latest": _with(_LOG, "SELECT task_id, status, progress FROM latest"),
    "task_state_stream": _with(_LOG, "SELECT task_id, status, progress FROM latest"),
    "task_interrupted": _with(
        _LOG,
        f"SELECT task_id, CASE WHEN o THEN 'error' ELSE status END AS status, CASE WHEN o THEN 0 ELSE progress END::INT AS progress, CASE WHEN o THEN '{model.INTERRUPTED}' ELSE 'm' END AS message, CASE WHEN o THEN '{model.INTERRUPTED_ERROR}' END AS error FROM (SELECT *, status IN ('pending', 'downloading', 'processing') AS o FROM latest)",
    ),
    "interrupted_count": _with(_LOG, "SELECT count(*) FILTER (WHERE status IN ('pending', 'downloading', 'processing'))::BIGINT AS interrupted FROM latest"),
    "stale_sweep": "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOURS",
    "status_lookup": "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'memory' WHEN s IS NOT NULL THEN 'disk' END AS origin, (CASE WHEN c_custkey % 3 = 0 OR s IS NOT NULL THEN 200 ELSE 404 END)::INT AS http_status, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE s END AS status FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey",
    "progress_parse": _with(
        _DL,
        "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'progress' WHEN 1 THEN 'convert' WHEN 2 THEN 'destination' WHEN 3 THEN 'progress' ELSE 'other' END AS kind, p AS pct, (2 + trunc(p * 0.05))::INT AS progress, round_even(p, 0)::BIGINT || '%' AS text FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN try_cast(regexp_extract(string_split(line, '%')[1], '(\\S+)\\s*$', 1) AS DOUBLE) END AS p FROM dl)",
    ),
    "progress_map": _with(_SEG_EVENTS, "SELECT user_id, seg, (25 + trunc((seg + 1) * 65 / count(*) OVER (PARTITION BY user_id)))::INT AS progress FROM segments"),
    "log_tail": _with(_DL, "SELECT user_id, event_id, line FROM dl QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5"),
    "error_text": _with(_DL + ", t AS (SELECT * FROM dl QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5)", "SELECT user_id, string_agg(line, chr(10) ORDER BY event_id) AS error FROM t GROUP BY user_id"),
    "drop_volatile": _with(_LOG, "SELECT event_id, task_id, ts, status, progress FROM log"),
}

_ROWS_ONLY = ()


def queries() -> dict[str, Query]:
    return {name: globals()[name] for name in [*_SQL, *_ROWS_ONLY]} | media.QUERIES | streams.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | media.SQL | streams.SQL
