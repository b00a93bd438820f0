"""Frames and their features: root mean square natively, Fourier transforms in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frames(signal: Column, size: int, hop: int) -> Column:
    """Centred frames of a short signal (an array), zero beyond its ends: 1 + n / hop of them."""
    pad = F.array_repeat(F.lit(0.0), size // 2)
    padded = F.concat(pad, F.transform(signal, lambda x: x.cast("double")), pad)
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(signal) / hop).cast("int")), lambda k: F.slice(padded, k * hop + 1, size))


def rms(frame: Column) -> Column:
    """Root mean square of a frame."""
    return F.sqrt(F.aggregate(frame, F.lit(0.0), lambda s, x: s + x * x) / F.size(frame))


def magnitudes(signal: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Magnitudes of the Hann-windowed transform of a padded signal, frame by frame."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    cut = np.lib.stride_tricks.sliding_window_view(signal, size)[::hop]
    return np.abs(np.fft.rfft(cut * window, axis=1))


def centroid(magnitude: np.ndarray, sr: float, size: int) -> np.ndarray:
    """Mean frequency weighted by magnitude; 0 of a silent frame."""
    total = magnitude.sum(axis=1)
    weighted = magnitude @ (np.arange(magnitude.shape[1]) * sr / size)
    return np.divide(weighted, total, out=np.zeros_like(total), where=total > 0)


def _padded(values: pa.ListScalar, size: int) -> np.ndarray:
    half = np.zeros(size // 2)
    return np.concatenate([half, np.asarray(values.values, np.float64), half])


def stft(rows: DataFrame, key: str, signal: str, size: int, hop: int) -> DataFrame:
    """(key, frame, bin, magnitude) of short signals held in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, values in enumerate(batch.column(1)):
                if values.is_valid and len(values):
                    m = magnitudes(_padded(values, size), size, hop)
                    n, bins = m.shape
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n * bins, batch.column(0)[i].as_py())), pa.array(np.repeat(np.arange(n, dtype=np.int32), bins)), pa.array(np.tile(np.arange(bins, dtype=np.int32), n)), pa.array(m.ravel())], [key, "frame", "bin", "magnitude"]
                    )

    return rows.select(F.col(key).cast("long"), signal).mapInArrow(run, f"{key} long, frame int, bin int, magnitude double")


def spectral_centroid(rows: DataFrame, key: str, signal: str, sr: float, size: int, hop: int) -> DataFrame:
    """(key, frame, centroid) of short signals held in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, values in enumerate(batch.column(1)):
                if values.is_valid and len(values):
                    c = centroid(magnitudes(_padded(values, size), size, hop), sr, size)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), batch.column(0)[i].as_py())), pa.array(np.arange(len(c), dtype=np.int32)), pa.array(c)], [key, "frame", "centroid"])

    return rows.select(F.col(key).cast("long"), signal).mapInArrow(run, f"{key} long, frame int, centroid double")


def features(rows: DataFrame, key: str, signal: str, sr: float, size: int, hop: int) -> DataFrame:
    """(key, frame, centroid, rms) of short signals held in one row, from one pass over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, values in enumerate(batch.column(1)):
                if values.is_valid and len(values):
                    whole = _padded(values, size)
                    c = centroid(magnitudes(whole, size, hop), sr, size)
                    e = np.sqrt((np.lib.stride_tricks.sliding_window_view(whole, size)[::hop] ** 2).mean(axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), batch.column(0)[i].as_py())), pa.array(np.arange(len(c), dtype=np.int32)), pa.array(c), pa.array(e)], [key, "frame", "centroid", "rms"])

    return rows.select(F.col(key).cast("long"), signal).mapInArrow(run, f"{key} long, frame int, centroid double, rms double")


#: One row to a frame; samples is the signal's number of them.
FEATURES = "series_id string, idx int, centroid double, rms double, samples long, sr int"


def frame_rows(series: str, sr: int, total: int, start: int, stop: int, first: int, around: np.ndarray, n_fft: int, hop: int, rms_size: int = 2048) -> pa.RecordBatch:
    """FEATURES of the frames that are centred on samples start to stop; around: samples from ``first`` on, half a frame more on either side where the signal has it.

    Frames are centred on whole hops; the frame at the very end belongs to the last chunk. Zeros
    stand only beyond the true ends of the signal.
    """
    halo = max(n_fft, rms_size) // 2
    k = np.arange(-(-start // hop), (stop - 1) // hop + 1 if stop < total else total // hop + 1)
    at = k * hop - first + halo
    padded = np.concatenate([np.zeros(halo), around.astype(np.float64), np.zeros(max(halo, (int(at[-1]) if len(at) else 0) + halo - len(around) - halo))])
    view = lambda size: padded[(at - size // 2)[:, None] + np.arange(size)]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    c = centroid(np.abs(np.fft.rfft(view(n_fft) * window, axis=1)), sr, n_fft)
    e = np.sqrt((view(rms_size) ** 2).mean(axis=1))
    n = len(k)
    return pa.RecordBatch.from_arrays([pa.array([series] * n, pa.string()), pa.array(k.astype(np.int32)), pa.array(c), pa.array(e), pa.array(np.full(n, total, np.int64)), pa.array(np.full(n, sr, np.int32))], [f.split(" ")[0] for f in FEATURES.split(", ")])


def chunk_features(chunks: DataFrame, n_fft: int, hop: int, rms_size: int = 2048) -> DataFrame:
    """FEATURES of signals held in chunks of whole hops, a written table or one that is cheap to read again.

    A chunk owns the frames centred on its samples. It needs half a frame beyond both ends, which
    comes from its neighbours by an equality join on the chunk number.
    """
    halo = max(n_fft, rms_size) // 2
    last = chunks.groupBy("series_id").agg(F.max(F.col("start") + F.size("samples")).alias("total"))
    before = chunks.select("series_id", (F.col("chunk") + 1).alias("chunk"), F.slice("samples", -F.least(F.lit(halo), F.size("samples")), halo).alias("left"))
    after = chunks.select("series_id", (F.col("chunk") - 1).alias("chunk"), F.slice("samples", 1, halo).alias("right"))
    whole = chunks.join(before, ["series_id", "chunk"], "left").join(after, ["series_id", "chunk"], "left").join(last, "series_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = lambda column, i: np.asarray(column[i].values, np.float64) if column[i].is_valid else np.zeros(0)
        for batch in batches:
            for i in range(batch.num_rows):
                series, sr, start, total = (batch.column(j)[i].as_py() for j in range(4))
                own, left, right = (part(batch.column(j), i) for j in (4, 5, 6))
                yield frame_rows(series, sr, total, start, start + len(own), start - len(left), np.concatenate([left, own, right]), n_fft, hop, rms_size)

    return whole.select("series_id", "sr", "start", "total", "samples", "left", "right").mapInArrow(run, FEATURES)
