"""Schemas and parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Fixed values of the service's behaviour.
MAX_FILE_BYTES = 500 * 1024 * 1024
EXTENSIONS = ("mp3", "wav", "flac", "m4a", "ogg", "wma", "aac")
MAX_DURATION_S = 7200.0
STALE_HOURS = 24
RECENT = 10
HOP = 512
SIGMA = 10.0
TERMINAL = ("completed", "error")
OPEN_STATUS = ("pending", "downloading", "processing")
START_STATUS = ("pending", "downloading")
#: From each status (none before the first) the statuses that may follow; repeated ones report progress.
TRANSITIONS = {
    None: ("pending", "downloading"),
    "pending": ("pending", "processing", "error"),
    "downloading": ("downloading", "processing", "error"),
    "processing": ("processing", "completed", "error"),
    "completed": (),
    "error": (),
}
#: Progress after each event of a task, in the usual order; downloads and recognised segments have their own rules.
PROGRESS = {
    "url": 0,
    "upload": 0,
    "start_download": 5,
    "destination": 3,
    "convert": 8,
    "downloaded": 10,
    "load": 12,
    "signal": 14,
    "features": 16,
    "novelty": 18,
    "peaks": 20,
    "segments": 23,
    "dedup": 95,
    "done": 100,
    "failed": 0,
}
VOLATILE_KEYS = ("filepath", "_analyzer")
INTERRUPTED = "Analysis interrupted"
INTERRUPTED_ERROR = "The analysis was interrupted because the server restarted (likely an out-of-memory on a very long audio). Please retry with a shorter file."
TOO_LONG = "Audio too long for analysis: %d min (max %d min). Please trim the file and retry."

TRACK = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("artist", T.StringType()),
        T.StructField("start_time", T.StringType()),
        T.StructField("start_time_seconds", T.DoubleType()),
        T.StructField("track_url", T.StringType()),
        T.StructField("match_count", T.IntegerType()),
    ]
)

TASK = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("progress", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("json_output", T.StringType()),
        T.StructField("txt_output", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("current_segment", T.IntegerType()),
        T.StructField("total_segments", T.IntegerType()),
        T.StructField("unique_tracks", T.IntegerType()),
        T.StructField("total_tracks_found", T.IntegerType()),
        T.StructField("results", T.ArrayType(TRACK)),
    ]
)

#: Samples of a chunk of a longer signal; no row holds a whole signal.
CHUNK = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField("chunk", T.IntegerType()),
        T.StructField("sr", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("samples", T.ArrayType(T.FloatType())),
    ]
)


@dataclass(frozen=True)
class Detection:
    """How boundaries are found. A zero or missing duration or threshold means: by the signal's length."""

    min_duration: float | None = None
    threshold: float | None = None
    sigma: float = SIGMA
    hop: int = HOP
    n_fft: int = 1024
    #: Catalog queries round the smoothed curve, so that engines agree on ties; the engine does not.
    digits: int | None = None

    def __post_init__(self) -> None:
        if self.threshold is not None and not 0 <= self.threshold <= 1:
            raise ValueError("threshold must lie in [0, 1]")
        if self.hop < 1 or self.sigma <= 0:
            raise ValueError("hop and sigma must be positive")
