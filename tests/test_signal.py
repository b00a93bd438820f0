"""Signals: the fixture of a tone that changes, peak and boundary rules, and features by chunk."""

import io
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions import scalars
from tidemark.operators import recognize, signal, spectral
from tidemark.plans import detect
from tidemark.sources import audio


def wav(samples: np.ndarray, rate: int, width: int = 2) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(samples.shape[1] if samples.ndim > 1 else 1)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes((samples * 32767).astype("<i2").tobytes())
    return out.getvalue()


@pytest.fixture(scope="session")
def tones(tmp_path_factory):
    rate, half = 48_000, 30
    t = np.arange(rate * half) / rate
    whole = np.concatenate([0.3 * np.sin(2 * np.pi * 440 * t), 0.3 * np.sin(2 * np.pi * 880 * t)])
    folder = tmp_path_factory.mktemp("audio")
    (folder / "tones.wav").write_bytes(wav(whole, rate))
    (folder / "broken.wav").write_bytes(b"no audio")
    return str(folder)


def test_resample_keeps_length_and_tone(spark, tones):
    chunks = audio.chunks(audio.files(spark, tones, "*.wav"), 22050)
    total = chunks.agg(F.sum(F.size("samples")).alias("n"), F.first("sr").alias("sr")).first()
    assert abs(total.n - 1_323_000) <= 1 and total.sr == 22050
    assert chunks.schema["samples"].dataType.elementType.simpleString() == "float"
    assert chunks.select("series_id").distinct().count() == 1  # the broken file has no chunks


def test_native_rate(spark, tones):
    chunks = audio.chunks(audio.files(spark, tones, "*.wav"), None)
    row = chunks.agg(F.sum(F.size("samples")).alias("n"), F.first("sr").alias("sr")).first()
    assert (row.n, row.sr) == (2_880_000, 48_000)


def test_probe(spark, tones):
    found = {r.path.rsplit("/", 1)[1]: r.seconds for r in audio.durations(audio.files(spark, tones)).collect()}
    assert abs(found["tones.wav"] - 60) < 1 and found["broken.wav"] == 0


def test_probe_skips_long_metadata(spark, tmp_path):
    plain = wav(np.zeros(24_000), 8000)
    at = plain.index(b"data")
    for n in (100, 4097, 200_000):  # odd sizes have a byte of padding
        listed = b"LIST" + n.to_bytes(4, "little") + b"i" * (n + n % 2)
        whole = plain[:at] + listed + plain[at:]
        (tmp_path / f"{n}.wav").write_bytes(b"RIFF" + (len(whole) - 8).to_bytes(4, "little") + whole[8:])
    found = [r.seconds for r in audio.durations(audio.files(spark, str(tmp_path))).collect()]
    assert found == [3.0, 3.0, 3.0]


def test_boundaries_of_tones(spark, tones):
    chunks = audio.chunks(audio.files(spark, tones, "tones.wav"), 22050)
    row = detect.detect(chunks, model.Detection(min_duration=10, threshold=0.3)).first()
    assert len(row.bounds) >= 2 and row.bounds[0] == 0 and row.bounds[-1] == row.samples
    assert any(abs(b - 1292 * 512) <= 512 for b in row.bounds)
    segments = detect.segments(chunks, model.Detection(min_duration=10, threshold=0.3)).orderBy("seg").collect()
    assert [s.start for s in segments] == row.bounds[:-1]


def test_features_by_chunk_equal_whole(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=20_000).astype(np.float32)
    size = 4096
    rows = [("a", k, 22050, k * size, x[k * size : (k + 1) * size].tolist()) for k in range(-(-len(x) // size))]
    found = spectral.chunk_features(spark.createDataFrame(rows, model.CHUNK), 1024, 512).orderBy("idx").collect()
    assert [r.idx for r in found] == list(range(1 + len(x) // 512))
    half = np.zeros(512)
    whole = spectral.centroid(spectral.magnitudes(np.concatenate([half, x.astype(float), half]), 1024, 512), 22050, 1024)
    assert np.allclose([r.centroid for r in found], whole[: len(found)], rtol=1e-9)
    padded = np.concatenate([np.zeros(1024), x.astype(float), np.zeros(1024)])
    energy = [math.sqrt((padded[k * 512 : k * 512 + 2048] ** 2).mean()) for k in range(len(found))]
    assert np.allclose([r.rms for r in found], energy, rtol=1e-9)


def test_downmix_and_widths():
    stereo = np.stack([np.full(10, 0.5), np.full(10, -0.25)], axis=1)
    samples, rate = audio.decode_wav(wav(stereo, 8000))
    assert rate == 8000 and np.allclose(audio.downmix(samples), 0.125, atol=1e-3)


def series(spark, *values):
    return spark.createDataFrame([(s, i, float(v)) for s, line in enumerate(values) for i, v in enumerate(line)], "s int, idx int, v double")


def test_constant_series_has_no_novelty(spark):
    rows = signal.novelty(series(spark, [1.0] * 5), "s", ["v"]).collect()
    assert all(r.novelty is None for r in rows)


def test_plateaus_and_ends(spark):
    found = signal.local_maxima(series(spark, [5, 1, 2, 2, 2, 1, 3, 3, 0, 9.0], [1.0, 1.0], [2.0]), "s", "v").orderBy("s", "idx").collect()
    assert [(r.s, r.idx) for r in found] == [(0, 3), (0, 6)]


def test_smoothing_mirrors_short_series(spark):
    x = [1.0, 5.0, 2.0]
    weights = signal.kernel(2.0)
    mirrored = [x[m if m < 3 else 5 - m] for m in [(i % 6) for i in range(-8, 11)]]
    wanted = [sum(w * v for w, v in zip(weights, mirrored[i : i + 17], strict=True)) for i in range(3)]
    found = [r.y for r in signal.gaussian_smooth(series(spark, x), "s", "v", 2.0, "y").orderBy("idx").collect()]
    assert np.allclose(found, wanted)


def kept(spark, peaks, distance):
    rows = spark.createDataFrame([([(float(h), i) for h, i in peaks],)], "p array<struct<height:double,idx:int>>")
    return rows.select(signal.suppress(F.col("p"), F.lit(distance)).alias("k")).first().k


def test_suppression(spark):
    assert kept(spark, [(1, 0), (3, 4), (2, 8)], 5) == [4]
    assert kept(spark, [(1, 0), (3, 5), (2, 10)], 5) == [0, 5, 10]  # exactly as far apart stays
    assert kept(spark, [(2, 3), (2, 5)], 5) == [5]  # the later of equals


def bounds(spark, peaks, samples, least, hop=1):
    row = spark.createDataFrame([(peaks, samples)], "p array<int>, n long")
    return row.select(signal.boundaries(F.col("p"), F.col("n"), hop, F.lit(1), F.lit(least)).alias("b")).first().b


def test_boundary_rules(spark):
    assert bounds(spark, [10, 12, 20], 40, 5) == [0, 10, 20, 40]
    assert bounds(spark, [10, 38], 40, 5) == [0, 10, 40]  # a short tail joins the segment before it
    assert bounds(spark, [], 20, 30) == [20]  # a short signal has no segment
    assert bounds(spark, [], 40, 30) == [0, 40]


def test_parameters(spark):
    rows = spark.createDataFrame([(3599.9,), (3600.0,), (7200.0,), (10800.0,)], "s double")
    assert [tuple(r) for r in rows.select(scalars.auto_min_duration(F.col("s")), scalars.auto_threshold(F.col("s"))).collect()] == [(30, 0.3), (45, 0.25), (60, 0.2), (90, 0.15)]
    with pytest.raises(ValueError):
        model.Detection(threshold=1.5)


def test_higher_threshold_gives_more_peaks(spark):
    rng = np.random.default_rng(3)
    rows = series(spark, rng.normal(size=400).tolist())
    count = lambda t: len(signal.peaks_of(rows, "s", "v", F.lit(t), F.lit(1), F.lit(400)).first().peaks)
    assert count(0.05) < count(0.3) < count(0.9)


def test_slices_and_recognizer(spark):
    chunks = spark.createDataFrame([("a", k, 10, k * 4, [float(i) for i in range(k * 4, k * 4 + 4)]) for k in range(3)], model.CHUNK)
    found = spark.createDataFrame([("a", 0, 0, 6, 0.0), ("a", 1, 6, 12, 0.6)], "series_id string, seg int, start long, stop long, start_s double")
    parts = signal.slice_segments(chunks, found).orderBy("seg", "chunk").collect()
    assert [(r.seg, list(r.samples)) for r in parts] == [(0, [0, 1, 2, 3]), (0, [4, 5]), (1, [6, 7]), (1, [8, 9, 10, 11])]
    rows = spark.createDataFrame([("a", 0, 0.0, [1.0]), ("a", 1, 1.0, [])], "series_id string, seg int, start_s double, samples array<float>")
    answers = recognize.recognize(rows, lambda samples, start: {"track": {"title": str(samples[0])}}).orderBy("seg").collect()
    assert answers[0].response == '{"track": {"title": "1.0"}}' and answers[1].response is None
