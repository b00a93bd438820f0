"""Boundary detection from chunks to segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import model
from tidemark.operators import long_series, signal, spectral
from tidemark.operators.tables import Scratch
from tidemark.sources import audio


def detect(chunks: DataFrame, how: model.Detection = model.Detection()) -> DataFrame:
    """(series_id, sr, samples, bounds) of every signal held in chunks."""
    return detect_features(spectral.chunk_features(chunks, how.n_fft, how.hop), how)


def file_features(files: DataFrame, how: model.Detection = model.Detection(), target_sr: int | None = 22050, max_seconds: float | None = model.MAX_DURATION_S, size: int = audio.CHUNK_SAMPLES, opener: audio.Opener = audio.open_input) -> DataFrame:
    """Features of WAV files (path, length): each chunk is decoded once, with half a frame around it, and never leaves its task."""

    def build(r: dict, first: int, part: np.ndarray) -> pa.RecordBatch:
        return spectral.frame_rows(r["path"], r["sr"], r["total"], r["start"], r["stop"], first, part, how.n_fft, how.hop)

    planned = audio.plan_chunks(audio.guarded(audio.headers(files, opener), max_seconds).where("refused is null"), target_sr, size)
    return audio.decode_ranges(planned, opener, max(how.n_fft, 2048) // 2, build, spectral.FEATURES)


def detect_features(features: DataFrame, how: model.Detection = model.Detection()) -> DataFrame:
    """(series_id, sr, samples, bounds) of every signal of which there are FEATURES."""
    # one exchange: everything from here on is by series
    scored = signal.novelty(features, "series_id", ["centroid", "rms"])
    smooth = signal.gaussian_smooth(scored, "series_id", "novelty", how.sigma, "smooth")
    if how.digits is not None:
        smooth = smooth.withColumn("smooth", F.round("smooth", how.digits))
    least, threshold = signal.parameters(F.col("samples"), F.col("sr"), how.min_duration, how.threshold)
    distance = F.floor(least * F.col("sr") / how.hop).cast("int")
    distance = F.when(distance >= 1, distance).otherwise(F.raise_error(F.lit("the least duration is below one hop")).cast("int"))
    peaks = signal.peaks_of(smooth, "series_id", "smooth", threshold, distance, F.struct("samples", "sr")).select("series_id", "samples.*", "peaks")
    least, _ = signal.parameters(F.col("samples"), F.col("sr"), how.min_duration, how.threshold)
    return peaks.select("series_id", "sr", "samples", signal.boundaries(F.col("peaks"), F.col("samples"), how.hop, F.col("sr"), least).alias("bounds"))


def segments(chunks: DataFrame, how: model.Detection = model.Detection()) -> DataFrame:
    """(series_id, seg, start, stop, start_s) of every signal held in chunks."""
    return signal.segments(detect(chunks, how), "series_id", "bounds", F.col("sr"))


def analyse(files: DataFrame, how: model.Detection = model.Detection(), target_sr: int | None = 22050, max_seconds: float | None = model.MAX_DURATION_S, decoder: audio.Decoder | None = None) -> DataFrame:
    """Segments of files (path, length, and content for a decoder); files over the cap are not decoded."""
    if decoder is not None:
        return segments(audio.chunks(files, target_sr, decoder, max_seconds=max_seconds), how)
    return signal.segments(detect_features(file_features(files, how, target_sr, max_seconds), how), "series_id", "bounds", F.col("sr"))


def analyse_long(files: DataFrame, how: model.Detection = model.Detection(), target_sr: int | None = 22050, max_seconds: float | None = None, block: int = long_series.BLOCK) -> DataFrame:
    """The same segments of WAV files of any length: a file's features are never in one task. They are written once."""
    scratch = Scratch(files.sparkSession, "features")
    features = scratch.written(file_features(files, how, target_sr, max_seconds), "features")
    found = long_series.analyse(features, "series_id", ["centroid", "rms"], how, block)
    scratch.drop(features)
    return found


def refused(files: DataFrame, max_seconds: float = model.MAX_DURATION_S) -> DataFrame:
    """(path, error) of WAV files that :func:`analyse` leaves out: too long, or headers that can't be read."""
    found = audio.guarded(audio.headers(files), max_seconds)
    return found.select("path", F.coalesce("refused", "error").alias("error")).where(F.col("error").isNotNull())
