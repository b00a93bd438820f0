"""Queries of the audio path: signals that Spark makes of the tables, as WAV files inside data URLs and as chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import model
from tidemark.sources import audio

#: Samples of a chunk of the series of all events.
EVENTS_CHUNK = 1000


def _little(value: Column, size: int) -> Column:
    """A number as the hexadecimal digits of so many bytes, lowest first."""
    value = value.cast("long")
    return F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(value, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(size)])


def _text(name: str) -> Column:
    return F.lit(name.encode().hex())


def wav_url(samples: Column, rate: Column) -> Column:
    """Whole numbers of 16 bits as a mono WAV file in a data URL."""
    size = F.size(samples) * 2
    head = [_text("RIFF"), _little(size + 36, 4), _text("WAVEfmt "), _little(F.lit(16), 4), _little(F.lit(audio.PCM), 2), _little(F.lit(1), 2), _little(rate, 4), _little(rate * 2, 4), _little(F.lit(2), 2), _little(F.lit(16), 2)]
    data = F.array_join(F.transform(samples, lambda x: _little(x, 2)), "")
    return F.concat(F.lit("data:audio/wav;base64,"), F.base64(F.unhex(F.concat(*head, _text("data"), _little(size, 4), data))))


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, path, length): vectors as WAV files of 64 samples, at 1 to 4 samples a second."""
    numbers = F.transform("embedding", lambda x: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(x.cast("double") * 8192))))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", wav_url(numbers, F.col("vec_id") % 4 + 1).alias("path")).withColumn("length", F.lit(1 << 20).cast("long"))


def wav_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe, and the guard against long files (here 30 seconds), before anything is decoded."""
    clips = _clips(spark, sf_dir)
    found = audio.guarded(audio.headers(clips), 30.0)
    return clips.select("vec_id", "path").join(found, "path").select("vec_id", "rate", "frames", F.round("seconds", 6).alias("seconds"), "refused")


def wav_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoding by ranges, 25 samples to a range, of those that the guard lets pass."""
    clips = _clips(spark, sf_dir)
    parts = audio.chunks(clips, None, size=25, max_seconds=30.0)
    each = parts.select(F.col("series_id").alias("path"), "chunk", "start", F.posexplode("samples").alias("i", "x"))
    return clips.select("vec_id", "path").join(each, "path").select("vec_id", "chunk", (F.col("start") + F.col("i")).alias("pos"), F.round(F.col("x").cast("double"), 9).alias("x"))


def resample_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one long series, in chunks, from 48 to 32 samples a second; no task has the whole series."""
    place = F.floor(F.col("event_id") / EVENTS_CHUNK).cast("int")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(place.alias("chunk"), F.struct("event_id", F.col("value").cast("float").alias("value")).alias("e"))
    grouped = events.groupBy("chunk").agg(F.sort_array(F.collect_list("e")).alias("all"))
    parts = grouped.select(F.lit("events").alias("series_id"), "chunk", F.lit(48).alias("sr"), (F.col("chunk").cast("long") * EVENTS_CHUNK).alias("start"), F.col("all.value").alias("samples"))
    out = audio.resample_chunks(parts.select(*[f.name for f in model.CHUNK]), 32, size=EVENTS_CHUNK)
    return out.select("chunk", "start", F.posexplode("samples").alias("i", "x")).select("chunk", (F.col("start") + F.col("i")).alias("pos"), F.round(F.col("x").cast("double"), 3).alias("x"))


QUERIES = {"wav_headers": wav_headers, "wav_samples": wav_samples, "resample_series": resample_series}

SQL = {
    "wav_headers": """SELECT vec_id, rate, 64::BIGINT AS frames, round(64.0::DOUBLE / rate, 6) AS seconds,
            CASE WHEN 64.0 / rate > 30 THEN printf('Audio too long for analysis: %d min (max 0 min). Please trim the file and retry.', 64 // rate // 60) END AS refused
        FROM (SELECT vec_id, (vec_id % 4 + 1)::INT AS rate FROM embeddings)""",
    "wav_samples": """SELECT vec_id, (pos // 25)::INT AS chunk, pos, round((greatest(-32768, least(32767, floor(x::DOUBLE * 8192))) / 32768)::DOUBLE, 9) AS x
        FROM (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding) AS x FROM embeddings WHERE vec_id % 4 >= 2)""",
    # weights of 48 inputs on either side of each output, a raised cosine times a sinc at two thirds of the band
    "resample_series": """WITH outs AS (SELECT i, i * 1.5::DOUBLE AS place FROM range((SELECT round_even(count(*) * 32 / 48.0::DOUBLE, 0)::BIGINT FROM events)) t(i)
        ), raw AS (SELECT i, floor(place)::BIGINT + r AS j, (place - floor(place)) - r AS d FROM outs, range(-47, 49) u(r)
        ), weighted AS (
            SELECT i, j, 2.0::DOUBLE / 3 * CASE WHEN d = 0 THEN 1 ELSE sin(pi() * d * 2 / 3) / (pi() * d * 2 / 3) END * cos(pi() * d / 98) ** 2 AS w FROM raw
        ), normed AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM weighted)
        SELECT (i // 1000)::INT AS chunk, i AS pos, round((sum(value::FLOAT::DOUBLE * w)::FLOAT)::DOUBLE, 3) AS x FROM events JOIN normed ON event_id = j GROUP BY i""",
}
