"""Files by ranges: headers, guard, planned chunks, and resampling without seams."""

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_signal import wav
from tidemark import model
from tidemark.operators import spectral
from tidemark.plans import detect
from tidemark.sources import audio


def riff(fmt: bytes, data: bytes, before: bytes = b"", size: int | None = None, name: bytes = b"RIFF") -> bytes:
    body = b"WAVE" + before + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data) if size is None else size) + data
    return name + struct.pack("<I", min(len(body), 0xFFFFFFFF)) + body


def fmt(kind, channels, rate, width, extra=b""):
    return struct.pack("<HHIIHH", kind, channels, rate, rate * channels * width, channels * width, 8 * width) + extra


def noise(n, channels=1, seed=1):
    return np.random.default_rng(seed).uniform(-0.9, 0.9, (n, channels)).astype(np.float32)


def whole(spark, folder, target, size=audio.CHUNK_SAMPLES, **more):
    """Samples of each file, joined from its chunks."""
    out: dict[str, list] = {}
    rows = audio.chunks(audio.files(spark, str(folder), "*.wav"), target, size=size, **more).orderBy("series_id", "chunk").collect()
    for r in rows:
        name = r.series_id.rsplit("/", 1)[1]
        assert r.start == sum(map(len, out.get(name, []))) and (r.chunk == len(out.get(name, [])))
        out.setdefault(name, []).append(np.array(r.samples, np.float32))
    return {k: np.concatenate(v) for k, v in out.items()}


@pytest.mark.parametrize("target", [None, 22050, 8000, 11025, 44100])
def test_ranges_equal_the_whole(spark, tmp_path, target):
    stereo = noise(30_011, 2)
    (tmp_path / "stereo.wav").write_bytes(wav(stereo, 16_000))
    (tmp_path / "mono.wav").write_bytes(wav(noise(9_999, seed=2), 22_050))
    found = whole(spark, tmp_path, target, size=4096)
    for name in ("stereo.wav", "mono.wav"):
        samples, rate = audio.decode_wav((tmp_path / name).read_bytes())
        assert np.array_equal(found[name], audio.resample(audio.downmix(samples), rate, target))


def test_kinds_of_samples(spark, tmp_path):
    x = noise(1000, 2)
    floats = riff(fmt(audio.FLOAT, 2, 8000, 4), x.astype("<f4").tobytes())
    doubles = riff(fmt(audio.FLOAT, 2, 8000, 8), x.astype("<f8").tobytes())
    extra = struct.pack("<HHIH", 22, 32, 3, audio.FLOAT) + b"\0" * 14
    extensible = riff(fmt(audio.EXTENSIBLE, 2, 8000, 4, extra), x.astype("<f4").tobytes())
    shorts = (x * 32767).astype("<i2").tobytes()
    streamed = riff(fmt(audio.PCM, 2, 8000, 2), shorts, size=0xFFFFFFFF)
    longer = riff(fmt(audio.PCM, 2, 8000, 2), shorts, before=b"ds64" + struct.pack("<IQQQI", 28, 0, len(shorts), 1000, 0), size=0xFFFFFFFF, name=b"RF64")
    cut = riff(fmt(audio.PCM, 2, 8000, 2), shorts[:1001], size=len(shorts))
    wide = riff(fmt(audio.PCM, 2, 8000, 3), np.frombuffer((x * (2**23 - 1)).astype("<i4").tobytes(), np.uint8).reshape(-1, 4)[:, :3].tobytes())
    names = {"floats": floats, "doubles": doubles, "extensible": extensible, "streamed": streamed, "longer": longer, "cut": cut, "wide": wide}
    for name, content in names.items():
        (tmp_path / f"{name}.wav").write_bytes(content)
    found = whole(spark, tmp_path, None)
    mean = x.mean(axis=1, dtype=np.float32)
    for name in set(names) - {"cut"}:
        assert np.allclose(found[f"{name}.wav"], mean, atol=1e-4), name
    assert len(found["cut.wav"]) == 1001 // 4


def test_errors_are_a_column(spark, tmp_path):
    (tmp_path / "none.wav").write_bytes(b"")
    (tmp_path / "text.wav").write_bytes(b"no audio at all")
    (tmp_path / "mulaw.wav").write_bytes(riff(fmt(7, 1, 8000, 1), b"xx"))
    (tmp_path / "headless.wav").write_bytes(riff(fmt(1, 1, 8000, 2), b"")[:30])
    (tmp_path / "early.wav").write_bytes(b"RIFF\0\0\0\0WAVEdata\0\0\0\0" + b"\0" * 40)
    (tmp_path / "empty.wav").write_bytes(riff(fmt(1, 1, 8000, 2), b""))
    rows = audio.files(spark, str(tmp_path))
    found = {r.path.rsplit("/", 1)[1]: r for r in audio.headers(rows).collect()}
    assert {n for n, r in found.items() if r.error is None} == {"empty.wav"} and all(found[n].frames is None for n in found if n != "empty.wav")
    assert found["empty.wav"].frames == 0 and audio.chunks(rows).count() == 0
    assert all(r.seconds == 0 for r in audio.durations(rows).collect())
    assert {r.path.rsplit("/", 1)[1] for r in audio.undecodable(rows).collect()} == set(found) - {"empty.wav"}


def test_probe_reads_headers_only_and_guard_comes_first(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "log").mkdir()
    (tmp_path / "in/long.wav").write_bytes(wav(np.zeros(80_000), 8000))
    (tmp_path / "in/short.wav").write_bytes(wav(np.zeros(16_000), 8000))
    log = str(tmp_path / "log")

    def opener(path):
        class Counted(io.FileIO):
            read_bytes = 0

            def read(self, n=-1):
                got = super().read(n)
                self.read_bytes += len(got)
                return got

            def close(self):
                if not self.closed:
                    with open(f"{log}/{path.rsplit('/', 1)[1]}", "a") as out:
                        out.write(f"{self.read_bytes}\n")
                super().close()

        return Counted(path.removeprefix("file:"))

    rows = audio.files(spark, str(tmp_path / "in"))
    assert sorted(r.seconds for r in audio.durations(rows, opener).collect()) == [2.0, 10.0]
    assert all(int((tmp_path / "log" / n).read_text()) <= 64 for n in ("long.wav", "short.wav"))
    parts = audio.chunks(rows, None, max_seconds=5.0, size=8192, opener=opener)
    assert parts.agg(F.sum(F.size("samples"))).first()[0] == 16_000
    assert sum(map(int, (tmp_path / "log/long.wav").read_text().split())) <= 64 * 4  # its headers, never its samples
    refused = audio.guarded(audio.headers(rows), 5.0).where("refused is not null").collect()
    assert len(refused) == 1 and refused[0].path.endswith("long.wav") and "content" not in rows.select("path", "length")._jdf.queryExecution().executedPlan().toString()


def test_one_file_is_many_tasks(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav(noise(200_000), 8000))
    parts = audio.chunks(audio.files(spark, str(tmp_path)), 4000, size=1024)
    assert parts.count() == 98 and parts.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_tone_keeps_its_height_and_length(spark, tmp_path):
    t = np.arange(96_000) / 48_000
    (tmp_path / "a.wav").write_bytes(wav(0.5 * np.sin(2 * np.pi * 440 * t), 48_000))
    x = whole(spark, tmp_path, 22_050, size=8192)["a.wav"]
    assert abs(len(x) - 44_100) <= 1
    inner = slice(200, -200)
    assert np.abs(x - 0.5 * np.sin(2 * np.pi * 440 * np.arange(len(x)) / 22_050))[inner].max() < 1e-3


@pytest.mark.parametrize(("rate", "target", "n", "size"), [(48, 32, 1000, 70), (32, 48, 311, 64), (44100, 22050, 5000, 512), (7, 5, 40, 6), (48, 32, 1, 9)])
def test_chunks_without_a_seam(spark, rate, target, n, size):
    """Input chunks of any sizes; a second series of another rate beside it."""
    x, other = noise(n)[:, 0], noise(90, seed=5)[:, 0]
    cuts = sorted({0, n, *np.random.default_rng(n).integers(0, n, 6).tolist()})
    rows = [("a", k, rate, a, x[a:b].tolist()) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))] + [("b", 0, target, 0, other.tolist()), ("c", 0, 9, 0, [])]
    found = audio.resample_chunks(spark.createDataFrame(rows, model.CHUNK).repartition(3), target, size=size).orderBy("series_id", "chunk").collect()
    got = {s: np.concatenate([np.array(r.samples, np.float32) for r in found if r.series_id == s]) for s in "ab"}
    assert np.array_equal(got["a"], audio.resample(x, rate, target)) and np.array_equal(got["b"], other)
    assert [r.chunk for r in found if r.series_id == "a"] == list(range(-(-len(got["a"]) // size))) and {r.sr for r in found} == {target}
    # against the weights written out
    how = audio.Polyphase.of(rate, target)
    for i in (0, len(got["a"]) // 2, len(got["a"]) - 1):
        at, phase = divmod(i * how.down, how.up)
        total = sum(w * x[j] for w, j in zip(how.weights[phase], range(at - how.half + 1, at + how.half + 1), strict=True) if 0 <= j < n)
        assert got["a"][i] == pytest.approx(total, abs=1e-6)


def test_files_to_segments(spark, tmp_path):
    t = np.arange(8000 * 20) / 8000
    tones = np.concatenate([0.3 * np.sin(2 * np.pi * 440 * t), 0.3 * np.sin(2 * np.pi * 1760 * t)])
    (tmp_path / "tones.wav").write_bytes(wav(tones, 8000))
    (tmp_path / "long.wav").write_bytes(wav(np.zeros(8000 * 60), 8000))
    how = model.Detection(min_duration=10, threshold=0.3)
    files = audio.files(spark, str(tmp_path))
    found = detect.analyse(files, how, target_sr=8000, max_seconds=50).orderBy("seg").collect()
    assert {r.series_id.rsplit("/", 1)[1] for r in found} == {"tones.wav"} and found[0].start == 0 and found[-1].stop == len(tones)
    assert any(abs(r.start - len(tones) // 2) <= 1024 for r in found)
    assert [tuple(r) for r in detect.refused(files, max_seconds=50).collect()] == [(f"file:{tmp_path}/long.wav", "Audio too long for analysis: 1 min (max 0 min). Please trim the file and retry.")]
    assert spectral.chunk_features(audio.chunks(files, 8000), 1024, 512).count() == 2 + (len(tones) // 512) + 480_000 // 512


def test_features_by_range_equal_those_by_chunk(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav(noise(30_000, 2), 16_000))
    (tmp_path / "b.wav").write_bytes(wav(noise(700, seed=3), 8_000))
    (tmp_path / "c.wav").write_bytes(wav(noise(4096, seed=4), 8_000))
    files = audio.files(spark, str(tmp_path))
    key = lambda r: (r.series_id, r.idx)
    wanted = sorted(spectral.chunk_features(audio.chunks(files, 8000, size=4096), 1024, 512).collect(), key=key)
    for size in (2048, 4096, 1 << 20):
        found = sorted(detect.file_features(files, target_sr=8000, size=size).collect(), key=key)
        assert [(key(r), r.samples, r.sr) for r in found] == [(key(r), r.samples, r.sr) for r in wanted]
        assert np.allclose([(r.centroid, r.rms) for r in found], [(r.centroid, r.rms) for r in wanted], rtol=1e-9)


def test_long_files(spark, tmp_path):
    t = np.arange(4000 * 60) / 4000
    parts = [0.3 * np.sin(2 * np.pi * f * t) for f in (300, 900, 500)]
    (tmp_path / "a.wav").write_bytes(wav(np.concatenate(parts) + noise(len(t) * 3)[:, 0] / 50, 4000))
    (tmp_path / "b.wav").write_bytes(wav(noise(4000 * 20, seed=8), 4000))
    files, how = audio.files(spark, str(tmp_path)), model.Detection(min_duration=20, threshold=0.3)
    wanted = sorted(map(tuple, detect.analyse(files, how, target_sr=None).collect()))
    assert sorted(map(tuple, detect.analyse_long(files, how, target_sr=None, block=128).collect())) == wanted and len(wanted) >= 3


def test_a_file_is_decoded_once(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav(noise(9000), 8000))
    plan = detect.analyse(audio.files(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join" not in plan  # headers, and the chunks planned from them
