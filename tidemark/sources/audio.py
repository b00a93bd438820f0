"""Audio files as chunks of samples.

WAV files are read by ranges: tasks read the headers alone, the chunks of all files are planned from
those, and each chunk is then decoded by itself from the bytes that it needs. Other formats need a
decoder and are read whole.
"""

from __future__ import annotations

import base64
import contextlib
import functools
import io
import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import model
from tidemark.functions import scalars
from tidemark.sources import stores

#: bytes -> (samples as frames x channels in [-1, 1), rate)
Decoder = Callable[[bytes], tuple[np.ndarray, int]]
#: path -> an open binary file that can seek
Opener = Callable[[str], io.IOBase]

#: Samples of a chunk: a multiple of the hop, and longer than any frame.
CHUNK_SAMPLES = 64 * model.HOP * 8

# Fixed values of WAV files: kinds of samples.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def open_input(path: str) -> io.IOBase:
    """A file that can seek: of the local system, of a store that Arrow reads, or the data URL of a short one."""
    if path.startswith("data:"):
        return io.BytesIO(base64.b64decode(path.partition(",")[2]))
    return stores.open_input(path)


@dataclass(frozen=True)
class Layout:
    """Where the samples of a WAV file lie."""

    kind: int
    channels: int
    rate: int
    width: int
    start: int
    frames: int

    @property
    def block(self) -> int:
        return self.channels * self.width

    def samples(self, raw: bytes) -> np.ndarray:
        """Bytes of whole frames as frames x channels."""
        if self.kind == FLOAT:
            values = np.frombuffer(raw, {4: "<f4", 8: "<f8"}[self.width]).astype(np.float32)
        elif self.width == 1:
            values = np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
        elif self.width == 3:
            wide = np.zeros((len(raw) // 3, 4), np.uint8)
            wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
            values = wide.view("<i4").ravel().astype(np.float32) / 2**31
        else:
            values = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[self.width]).astype(np.float32) / 2 ** (8 * self.width - 1)
        return values.reshape(-1, self.channels)


def wav_layout(source: io.IOBase, length: int) -> Layout:
    """From the chunk headers, whatever stands before the data; sizes of 64 bits (RF64) and files cut short too.

    Reads the headers and seeks past the rest.
    """
    kind, _, form = struct.unpack("<4sI4s", _exactly(source, 12))
    if kind not in (b"RIFF", b"RF64") or form != b"WAVE":
        raise ValueError("no WAV file")
    at, long_size, shape = 12, None, None
    while True:
        source.seek(at)
        name, size = struct.unpack("<4sI", _exactly(source, 8))
        at += 8
        if name == b"ds64":
            long_size = struct.unpack("<QQ", _exactly(source, 16))[1]
        elif name == b"fmt ":
            own = _exactly(source, min(max(size, 16), 40))
            sample, channels, rate, _, block, bits = struct.unpack("<HHIIHH", own[:16])
            if sample == EXTENSIBLE and len(own) >= 26:
                sample = struct.unpack("<H", own[24:26])[0]
            width = block // max(channels, 1)
            if (sample, width) not in {(PCM, 1), (PCM, 2), (PCM, 3), (PCM, 4), (FLOAT, 4), (FLOAT, 8)} or not rate or (bits + 7) // 8 > width:
                raise ValueError(f"samples of kind {sample} with {width} bytes are not known")
            shape = (sample, channels, rate, width)
        elif name == b"data":
            if shape is None:
                raise ValueError("data before the format")
            if size == 0xFFFFFFFF and long_size is not None:
                size = long_size
            # a size of 0 or the most is that of a writer who could not go back
            size = length - at if size in (0, 0xFFFFFFFF) else min(size, length - at)
            return Layout(*shape, start=at, frames=max(size, 0) // (shape[1] * shape[3]))
        at += size + size % 2


def _exactly(source: io.IOBase, n: int) -> bytes:
    raw = source.read(n)
    if len(raw) < n:
        raise ValueError("the file ends within its headers")
    return raw


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """All samples of a WAV file: PCM of 8, 16, 24 and 32 bits, floats of 32 and 64."""
    layout = wav_layout(io.BytesIO(content), len(content))
    return layout.samples(content[layout.start : layout.start + layout.frames * layout.block]), layout.rate


def downmix(samples: np.ndarray) -> np.ndarray:
    """Mean of the channels."""
    return samples.mean(axis=1, dtype=np.float32)


@dataclass(frozen=True)
class Polyphase:
    """A windowed sinc for a ratio of rates: output i lies at input i * down / up, and has one of ``up`` phases."""

    up: int
    down: int
    half: int

    @classmethod
    def of(cls, rate: int, target: int, taps: int = 32) -> Polyphase:
        """Each output takes ``taps`` inputs on either side, low-passed at the lower of both rates."""
        common = math.gcd(rate, target)
        return cls(target // common, rate // common, math.ceil(taps / min(1.0, target / rate)))

    @functools.cached_property
    def weights(self) -> np.ndarray:
        """By phase, the weights of the inputs from half - 1 before to half after."""
        band = min(1.0, self.up / self.down)
        distance = (np.arange(self.up) / self.up)[:, None] - np.arange(-self.half + 1, self.half + 1)
        raw = band * np.sinc(band * distance) * np.cos(np.pi * distance / (2 * (self.half + 1))) ** 2
        return raw / raw.sum(axis=1, keepdims=True)

    def needs(self, start: int, stop: int) -> tuple[int, int]:
        """The inputs, from and to, that outputs from start to stop take; also beyond the signal's ends."""
        return start * self.down // self.up - self.half + 1, (stop - 1) * self.down // self.up + self.half + 1

    def outputs(self, x: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Outputs from start to stop; x: the inputs that they need, zeros beyond the signal's ends."""
        out = np.empty(stop - start, np.float32)
        windows = np.lib.stride_tricks.sliding_window_view(x.astype(np.float64), 2 * self.half)
        first = self.needs(start, stop)[0] + self.half - 1
        for i in range(start, min(start + self.up, stop)):
            whole, phase = divmod(i * self.down, self.up)
            out[i - start :: self.up] = windows[whole - first :: self.down][: -((i - stop) // self.up)] @ self.weights[phase]
        return out


@functools.lru_cache(16)
def polyphase(rate: int, target: int, taps: int = 32) -> Polyphase:
    return Polyphase.of(rate, target, taps)


def resampled_length(n: int, rate: int, target: int | None) -> int:
    """Samples of a signal of n at another rate; at least one, unless there are none."""
    return n if target is None or target == rate or not n else max(1, round(n * target / rate))


def resample_span(read: Callable[[int, int], np.ndarray], n: int, rate: int, target: int | None, start: int, stop: int, taps: int = 32) -> np.ndarray:
    """Samples start to stop of a resampled signal of n samples, of which ``read(from, to)`` gives a part.

    Phases follow from the place in the whole signal, so spans join without a seam.
    """
    if target is None or target == rate:
        return read(start, stop).astype(np.float32)
    if start >= stop:
        return np.zeros(0, np.float32)
    how = polyphase(rate, target, taps)
    a, b = how.needs(start, stop)
    inner = read(max(a, 0), min(b, n))
    return how.outputs(np.concatenate([np.zeros(max(0, -a)), inner, np.zeros(max(0, b - max(n, a)))]), start, stop)


def resample(signal: np.ndarray, rate: int, target: int | None, taps: int = 32) -> np.ndarray:
    """Windowed-sinc resampling to round(n * target / rate) samples; the rate itself where target is null."""
    n = len(signal)
    return resample_span(lambda a, b: signal[a:b], n, rate, target, 0, resampled_length(n, rate, target), taps)


def mapped(rows: DataFrame, key: str, signal: str, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(key, signal) of short signals held in one row, each changed; a null or empty one stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [change(np.asarray(v.values, np.float32)).tolist() if v.is_valid and len(v) else v.as_py() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float32()))], [key, "signal"])

    return rows.select(key, signal).mapInArrow(run, f"{key} long, signal array<float>")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length and content; a query that leaves content out does not read it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


HEADER = "path string, length long, kind int, channels int, rate int, width int, data_start long, frames long, seconds double, error string"


def headers(rows: DataFrame, opener: Opener = open_input) -> DataFrame:
    """HEADER of WAV files from their (path, length): what the headers say, else null and the error.

    Tasks open the files and read headers only; content is not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in HEADER.split(", ")]
        kinds = [pa.string(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int64(), pa.float64(), pa.string()]
        for batch in batches:
            out = []
            for path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    with contextlib.closing(opener(path)) as source:
                        w = wav_layout(source, length)
                    out.append((path, length, w.kind, w.channels, w.rate, w.width, w.start, w.frames, w.frames / w.rate, None))
                except ValueError as error:
                    out.append((path, length, *[None] * 7, str(error)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(names), kinds, strict=True)], names)

    return rows.select("path", "length").mapInArrow(run, HEADER)


def durations(rows: DataFrame, opener: Opener = open_input) -> DataFrame:
    """(path, seconds): from the headers of a WAV file alone; 0 where they can't be read."""
    return headers(rows, opener).select("path", F.coalesce("seconds", F.lit(0.0)).alias("seconds"))


def guarded(found: DataFrame, max_seconds: float | None = model.MAX_DURATION_S) -> DataFrame:
    """Headers with ``refused``: what a file that is too long is told, before anything of it is decoded; null for others."""
    return found.withColumn("refused", scalars.too_long_text(F.col("seconds"), max_seconds) if max_seconds else F.lit(None).cast("string"))


def plan_chunks(found: DataFrame, target_sr: int | None, size: int = CHUNK_SAMPLES) -> DataFrame:
    """A row (path, ..., sr, chunk, start, stop) for each chunk of the files with readable headers."""
    sr = F.lit(target_sr) if target_sr else F.col("rate")
    n = F.when(F.col("frames") == 0, F.lit(0)).when(F.lit(target_sr is None) | (F.col("rate") == sr), F.col("frames")).otherwise(F.greatest(F.lit(1), F.rint(F.col("frames") * sr / F.col("rate")).cast("long")))
    sized = found.where(F.col("error").isNull()).withColumn("sr", sr.cast("int")).withColumn("total", n.cast("long")).where("total > 0")
    each = sized.withColumn("chunk", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("total") / size) - 1).cast("int"))))
    return each.withColumn("start", F.col("chunk").cast("long") * size).withColumn("stop", F.least(F.col("start") + size, F.col("total")))


def decode_ranges(planned: DataFrame, opener: Opener = open_input, halo: int = 0, build: Callable[[dict, int, np.ndarray], pa.RecordBatch] | None = None, schema: T.StructType | str = model.CHUNK) -> DataFrame:
    """Chunks of mono samples from the bytes that each of them needs; chunks are spread over tasks.

    ``build`` makes the rows of a chunk: from its planned row, the place of the first sample, and the
    samples, with ``halo`` more of them on either side where the signal has them.
    """
    columns = ["path", "kind", "channels", "rate", "width", "data_start", "frames", "sr", "total", "chunk", "start", "stop"]
    build = build or (lambda r, first, part: _chunk(r["path"], r["chunk"], r["sr"], first, part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with contextlib.ExitStack() as stack:
            last, source = None, None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["path"] != last:
                        stack.close()
                        last, source = r["path"], stack.enter_context(contextlib.closing(opener(r["path"])))
                    layout = Layout(r["kind"], r["channels"], r["rate"], r["width"], r["data_start"], r["frames"])

                    def read(a: int, b: int, layout: Layout = layout, source: io.IOBase = source) -> np.ndarray:
                        source.seek(layout.start + a * layout.block)
                        return downmix(layout.samples(_exactly(source, max(0, b - a) * layout.block)))

                    first = max(r["start"] - halo, 0)
                    yield build(r, first, resample_span(read, r["frames"], r["rate"], r["sr"], first, min(r["stop"] + halo, r["total"])))

    # by number: planned rows are small, and would be put together into few tasks otherwise
    parts = int(planned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = planned.select(*columns).repartition(parts, "path", "chunk")
    return dealt.sortWithinPartitions("path", "chunk").mapInArrow(run, schema)


def _chunk(path: str, k: int, sr: int, start: int, part: np.ndarray) -> pa.RecordBatch:
    samples = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part))
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k], pa.int32()), pa.array([sr], pa.int32()), pa.array([start], pa.int64()), samples], [f.name for f in model.CHUNK])


def chunks(rows: DataFrame, target_sr: int | None = 22050, decoder: Decoder | None = None, size: int = CHUNK_SAMPLES, max_seconds: float | None = None, opener: Opener = open_input) -> DataFrame:
    """Mono chunks at the target rate of files (path, length, and content for a decoder).

    WAV files are decoded by ranges, many tasks to a file; those whose headers can't be read, and
    those longer than ``max_seconds``, have no chunks (``headers`` and ``guarded`` say why). With a
    decoder for another format a file is read whole, and a file that it raises ValueError on has none
    (``undecodable`` says why).
    """
    if decoder is None:
        return decode_ranges(plan_chunks(guarded(headers(rows, opener), max_seconds).where("refused is null"), target_sr, size), opener)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    samples, rate = decoder(content.as_py())
                except ValueError:
                    continue
                if max_seconds and len(samples) > max_seconds * rate:
                    continue
                signal = resample(downmix(samples), rate, target_sr)
                for k in range(0, -(-len(signal) // size)):
                    yield _chunk(path, k, target_sr or rate, k * size, signal[k * size : (k + 1) * size])

    return rows.select("path", "content").mapInArrow(run, model.CHUNK)


def undecodable(rows: DataFrame, decoder: Decoder = decode_wav) -> DataFrame:
    """(path, error) of the files (path, content) on which a decoder raises ValueError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    decoder(content.as_py())
                except ValueError as error:
                    out.append((path, str(error)))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())], ["path", "error"])

    return rows.select("path", "content").mapInArrow(run, "path string, error string")


def resample_chunks(parts: DataFrame, target_sr: int, taps: int = 32, size: int = CHUNK_SAMPLES) -> DataFrame:
    """Signals in chunks (CHUNK, without gaps, of any sizes) at another rate, in chunks of ``size`` samples.

    Each output chunk is planned from its signal's length and gets the input chunks that it needs by
    an equality join on blocks of input places: no signal is gathered. Series of different rates may
    stand together.
    """
    whole = parts.groupBy("series_id").agg(F.max(F.col("start") + F.size("samples")).alias("frames"), F.first("sr").alias("rate"))
    found = whole.select("series_id", F.col("series_id").alias("path"), "frames", "rate", F.lit(None).cast("string").alias("error"))
    planned = plan_chunks(found, target_sr, size).select("series_id", "frames", "rate", "chunk", F.col("start").alias("out_start"), F.col("stop").alias("out_stop"))
    # what an output chunk needs, generously; the samples themselves are cut in the task
    reach = F.ceil(F.lit(float(taps)) * F.greatest(F.lit(1.0), F.col("rate") / target_sr)) + 2
    low = F.greatest(F.floor(F.col("out_start") * F.col("rate") / target_sr) - reach, F.lit(0))
    high = F.least(F.ceil(F.col("out_stop") * F.col("rate") / target_sr) + reach, F.col("frames"))
    blocks = lambda a, b: F.explode(F.sequence(F.floor(a / size), F.floor((b - 1) / size)))
    wanted = planned.withColumn("block", blocks(low, high))
    held = parts.where(F.size("samples") > 0).select("series_id", F.col("start").alias("in_start"), "samples", blocks(F.col("start"), F.col("start") + F.size("samples")).alias("block"))
    # an input chunk over several blocks goes with the first that it shares with the output chunk
    first = F.greatest(F.floor(F.col("in_start") / size), F.floor(low / size)) == F.col("block")
    pieces = wanted.join(held, ["series_id", "block"]).where(first)
    gathered = pieces.groupBy("series_id", "chunk").agg(F.first("frames").alias("frames"), F.first("rate").alias("rate"), F.first("out_start").alias("out_start"), F.first("out_stop").alias("out_stop"), F.sort_array(F.collect_list(F.struct("in_start", "samples"))).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                series, chunk, frames, rate, start, stop = (batch.column(j)[i].as_py() for j in range(6))
                own = batch.column(6)[i].values
                begin = own.field(0)[0].as_py()
                x = np.asarray(own.field(1).flatten(), np.float32)
                part = resample_span(lambda a, b: x[a - begin : b - begin], frames, rate, target_sr, start, stop, taps)  # noqa: B023
                yield _chunk(series, chunk, target_sr, start, part)

    return gathered.select("series_id", "chunk", "frames", "rate", "out_start", "out_stop", "pieces").mapInArrow(run, model.CHUNK)
