"""Series dealt in blocks give what the operators give that keep a series together, and what a fold in Python gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import model
from tidemark.operators import long_series, signal, tables
from tidemark.operators.tables import Scratch

SCHEMA = "s int, idx int, x double, y double"


def lines():
    rnd = np.random.default_rng(4)
    wave = np.cumsum(rnd.normal(size=2500)) + 20 * np.sin(np.arange(2500) / 40)
    return [wave, rnd.normal(size=901), np.repeat(rnd.integers(0, 5, 130), 9)[:1000].astype(float), rnd.normal(size=7), np.array([1.0]), np.full(300, 2.5), np.array([1.0, 2.0]), rnd.integers(0, 3, 820).astype(float)]


@pytest.fixture(scope="module")
def rows(spark):
    table = [(s, i, float(v), float((v * 7 + i) % 11)) for s, line in enumerate(lines()) for i, v in enumerate(line)]
    return spark.createDataFrame(table, SCHEMA).repartition(4).cache()


@pytest.mark.parametrize(("sigma", "block"), [(2.0, 17), (2.0, 300), (10.0, 81), (10.0, 1 << 16)])
def test_smoothed_novelty(rows, sigma, block):
    short = signal.gaussian_smooth(signal.novelty(rows, "s", ["x", "y"]), "s", "novelty", sigma, "smooth")
    wanted = {(r.s, r.idx): (r.novelty, r.smooth) for r in short.collect()}
    found = long_series.smoothed_novelty(rows, "s", ["x", "y"], sigma, block).collect()
    assert len(found) == len(wanted) and all(r.n == len(lines()[r.s]) for r in found)
    for r in found:
        for a, b in zip((r.novelty, r.smooth), wanted[r.s, r.idx], strict=True):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=1e-12)), (r, wanted[r.s, r.idx])
    with pytest.raises(ValueError):
        long_series.smoothed_novelty(rows, "s", ["x"], 10.0, 80)


@pytest.mark.parametrize("few", [1, 5, 4096])
def test_percentiles(spark, rows, monkeypatch, few):
    monkeypatch.setattr(long_series, "SORTED", few)
    monkeypatch.setattr(long_series, "BUCKETS", 7)
    facts = spark.createDataFrame([(s, t) for s, t in enumerate([0.3, 0.0, 1.0, 0.25, 0.5, 0.1, 0.35, 0.9])], "s int, threshold double")
    found = {r.s: r.height for r in long_series.percentiles(rows, "s", "x", facts, Scratch(spark, "t"), 100).collect()}
    for s, (line, t) in enumerate(zip(lines(), [0.3, 0.0, 1.0, 0.25, 0.5, 0.1, 0.35, 0.9], strict=True)):
        assert found[s] == pytest.approx(np.percentile(line, (1 - t) * 100), rel=1e-12)


def test_percentiles_of_wild_numbers(spark, monkeypatch):
    monkeypatch.setattr(long_series, "SORTED", 2)
    x = [10.0**k for k in range(-150, 150, 3)] + [-(10.0**k) for k in range(-50, 50)] + [0.0] * 40
    table = spark.createDataFrame([(0, i, v) for i, v in enumerate(x)] + [(1, 0, None)], "s int, idx int, v double")
    facts = spark.createDataFrame([(0, 0.4), (1, 0.4)], "s int, threshold double")
    found = [tuple(r) for r in long_series.percentiles(table, "s", "v", facts, Scratch(spark, "t"), 16).collect()]
    assert found == [(0, pytest.approx(np.percentile(x, 60), rel=1e-12))]


@pytest.mark.parametrize("block", [1, 2, 7, 64, 1 << 16])
def test_local_maxima(rows, block):
    wanted = sorted((r.s, r.idx, r.x) for r in signal.local_maxima(rows, "s", "x").collect())
    assert sorted((r.s, r.idx, r.x) for r in long_series.local_maxima(rows, "s", "x", block).collect()) == wanted and len(wanted) > 100


def greedy(peaks, distance):
    kept = []
    for h, i in sorted(peaks, reverse=True):
        if all(abs(i - k) >= distance for k in kept):
            kept.append(i)
    return sorted(kept)


def test_suppression(spark, monkeypatch):
    monkeypatch.setattr(long_series, "SPAN", 3)
    monkeypatch.setattr(long_series, "SEEN", 1)
    rnd = random.Random(9)
    every = {
        0: (5, [(rnd.random(), i) for i in range(0, 900, 2)]),
        1: (11, [(float(rnd.randrange(4)), i) for i in sorted(rnd.sample(range(2000), 500))]),
        2: (4, [(float(i), i) for i in range(0, 150)]),  # ever higher: a chain through all blocks
        3: (1, [(1.0, i) for i in range(40)]),
        4: (1000, [(2.0, 3), (2.0, 5)]),
    }
    table = spark.createDataFrame([(s, i, h, d) for s, (d, peaks) in every.items() for h, i in peaks], "s int, idx int, h double, distance int")
    found = long_series.suppressed(table, "s", "h", Scratch(spark, "t")).collect()
    for s, (d, peaks) in every.items():
        assert sorted(r.idx for r in found if r.s == s) == greedy(peaks, d)
    assert long_series.suppressed(table.where("s > 9"), "s", "h", Scratch(spark, "t")).count() == 0


def kept(peaks, samples, sr, least):
    out = [0]
    for b in [*[p for p in peaks if p > 0], samples]:
        if (b - out[-1]) / sr >= least:
            out.append(b)
    if out[-1] != samples:
        out[-1] = samples
    return out


def test_boundaries(spark):
    rnd = random.Random(2)
    every = {0: ([], 20, 30.0), 1: ([], 40, 30.0), 2: ([10, 12, 20], 40, 5.0), 3: ([10, 38], 40, 5.0), 4: (sorted(rnd.sample(range(1, 6000), 700)), 6001, 17.3), 5: (list(range(0, 300, 3)), 300, 0.5), 6: (sorted(rnd.sample(range(1, 900), 400)), 900, 0.001)}
    peaks = spark.createDataFrame([(s, p) for s, (x, _, _) in every.items() for p in x], "s int, idx long")
    lengths = spark.createDataFrame([(s, n, m) for s, (_, n, m) in every.items()], "s int, samples long, least double")
    for sr, hop in ((1, 1), (3, 1)):
        found = long_series.boundaries(peaks, lengths, "s", hop, F.lit(sr), F.col("least"), Scratch(spark, "t")).collect()
        for s, (x, n, m) in every.items():
            assert sorted(r.boundary for r in found if r.s == s) == kept(x, n, sr, m)


def test_next_places(spark):
    """The first place at a gap or later, over parts without any; no window looks ahead, which takes the square of a part's rows."""
    rnd = random.Random(5)
    every = {0: (7, sorted(rnd.sample(range(3000), 400))), 1: (1, list(range(60))), 2: (50, [0, 9, 59, 700, 701, 5000])}
    table = spark.createDataFrame([(s, p, g) for s, (g, places) in every.items() for p in places], "s int, pos long, gap long")

    class Kept(Scratch):
        def written(self, frame, name):
            self.plan = frame._jdf.queryExecution().optimizedPlan().toString()
            return super().written(frame, name)

    scratch = Kept(spark, "t")
    for span in (16, 1 << 24):
        found = {(r.s, r.pos): r.to for r in long_series._next(table, "s", scratch, span).collect()}
        wanted = {(s, p): min(q for q in places if q >= p + g) for s, (g, places) in every.items() for p in places if p + g <= places[-1]}
        assert found == wanted and "unboundedfollowing" not in scratch.plan.lower() and "unboundedpreceding" in scratch.plan.lower()


def test_blocks_of_suppression(spark, monkeypatch):
    """Blocks of so many indices keep the same peaks, in fewer groups than blocks of so many distances."""
    monkeypatch.setattr(long_series, "SPAN", 3)
    monkeypatch.setattr(long_series, "SEEN", 1)
    rnd = random.Random(3)
    every = {0: (5, [(rnd.random(), i) for i in range(0, 900, 2)]), 1: (300, [(rnd.random(), i) for i in range(0, 4000, 7)]), 2: (4, [(float(i), i) for i in range(150)])}
    table = spark.createDataFrame([(s, i, h, d) for s, (d, peaks) in every.items() for h, i in peaks], "s int, idx int, h double, distance int")
    for block in (7, 100, 1 << 16):
        found = long_series.suppressed(table, "s", "h", Scratch(spark, "t"), block).collect()
        for s, (d, peaks) in every.items():
            assert sorted(r.idx for r in found if r.s == s) == greedy(peaks, d)


def test_whole_chain(spark, rows):
    """Segments by blocks and by whole series."""
    how = model.Detection(min_duration=12.0, threshold=0.3, sigma=2.0, hop=1)
    sized = rows.withColumn("sr", F.lit(1)).join(rows.groupBy("s").agg(F.count("*").alias("samples")), "s")
    smooth = signal.gaussian_smooth(signal.novelty(rows, "s", ["x", "y"]), "s", "novelty", 2.0, "smooth").join(sized.select("s", "samples").distinct(), "s")
    found = signal.peaks_of(smooth, "s", "smooth", F.lit(0.3), F.lit(12), F.col("samples"))
    bounds = found.select("s", signal.boundaries(F.col("peaks"), F.col("samples"), 1, F.lit(1), F.lit(12.0)).alias("bounds"))
    wanted = sorted(map(tuple, signal.segments(bounds, "s", "bounds", F.lit(1)).collect()))
    got = long_series.analyse(sized, "s", ["x", "y"], how, block=64)
    assert sorted(map(tuple, got.collect())) == wanted and len(wanted) > 60


def test_scratch_keeps_the_result_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "root", lambda spark: f"file://{tmp_path}")
    scratch = tables.Scratch(spark, "few")
    one = scratch.written(spark.range(3), "one")
    out = scratch.result(one.withColumn("two", F.col("id") * 2))
    assert out.count() == 3 and len([p for p in tmp_path.rglob("_SUCCESS")]) == 1


def test_no_window_over_a_series_of_rows(rows):
    """Rows of samples are dealt by series and block, never by series alone."""
    for frame in (long_series.smoothed_novelty(rows, "s", ["x"], 2.0, 64), long_series.smoothed_novelty(rows, "s", ["x", "y"], 2.0, 64)):
        plan = frame._jdf.queryExecution().executedPlan().toString().splitlines()
        windows = [line for line in plan if "Window" in line]
        assert len(windows) >= 2 and all("windowspecdefinition(s#" in w and ", block#" in w for w in windows)
