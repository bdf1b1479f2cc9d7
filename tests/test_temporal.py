"""Filters along time: per clip, of any order, over long series, and one frame at a time."""

import time
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_plans import clip, result
from undula.config import BABY, CPP
from undula.functions import coeffs
from undula.operators import arrays, clips, metrics, recursive, spectral, tiles
from undula.plans.magnify import magnify
from undula.streaming.frame_filter import coefficients, frame_stream, gains

SERIES = "video_id string, level int, tile int, t int, data array<double>"


def rows_of(df):
    return [np.array(r.data) for r in sorted(df.collect(), key=lambda r: (r.video_id, r.tile, r.t))]


def masked(x, fps, low, high, n=None):
    f = np.abs(np.fft.fftfreq(n or len(x), 1 / fps))
    return np.real(np.fft.ifft(np.fft.fft(x, n, axis=0) * ((f >= low) & (f <= high))[:, None], axis=0))[: len(x)]


def test_clips_of_their_own_rates_and_sizes(spark):
    """Each clip of a table comes out as it does alone with its own rate."""
    rnd = np.random.default_rng(4)
    made = {"a": (30.0, rnd.uniform(60, 200, (40, 8, 8, 3))), "b": (10.0, rnd.uniform(60, 200, (33, 7, 5, 3))), "c": (25.0, rnd.uniform(60, 200, (24, 1, 6, 3)))}
    tables = {k: clip(spark, np.rint(x), k).withColumn("fps", F.lit(fps)) for k, (fps, x) in made.items()}
    together = tables["a"].unionByName(tables["b"]).unionByName(tables["c"]).repartition(5)
    for config in (replace(CPP, levels=2, alpha=5.0, high_hz=3.0), replace(BABY, levels=3, high_hz=3.0)):
        both = magnify(together, config).collect()
        for k, (fps, x) in made.items():
            alone = magnify(tables[k].drop("fps"), replace(config, fps=fps)).orderBy("t").collect()
            own = sorted((r for r in both if r.video_id == k), key=lambda r: r.t)
            assert [(r.t, r.h, r.w, r.data) for r in own] == [(r.t, r.h, r.w, r.data) for r in alone] and len(own) == len(x)
        other = magnify(tables["b"].drop("fps"), replace(config, fps=30.0)).orderBy("t").collect()
        assert [r.data for r in other] != [r.data for r in sorted((r for r in both if r.video_id == "b"), key=lambda r: r.t)]


def test_a_clip_that_mixes_sizes_or_rates_fails_by_name(spark):
    x = np.full((4, 4, 4, 3), 9.0)
    good, odd = clip(spark, x, "good").withColumn("fps", F.lit(30.0)), clip(spark, x[:, :2], "odd").withColumn("fps", F.lit(30.0))
    mixed = odd.unionByName(clip(spark, x, "odd").withColumn("fps", F.lit(30.0)).withColumn("t", F.col("t") + 9))
    rates = odd.withColumn("fps", 20.0 + F.col("t"))
    for config in (replace(CPP, levels=1), replace(BABY, levels=1)):
        assert magnify(good.unionByName(odd), config).count() == 8
        with pytest.raises(Exception, match="clip odd: frames differ in h"):
            magnify(good.unionByName(mixed), config).collect()
        with pytest.raises(Exception, match="clip odd: frames differ in fps"):
            magnify(good.unionByName(rates), config).collect()
    with pytest.raises(Exception, match="clip odd: high_hz must be under half of fps"):
        magnify(good.unionByName(odd.withColumn("fps", F.lit(5.0))), replace(BABY, levels=1)).collect()


@pytest.mark.parametrize("n, mask, padding", [(1, "symmetric", "none"), (2, "onesided", "none"), (97, "symmetric", "none"), (97, "symmetric", "optimal"), (120, "onesided", "none"), (360, "symmetric", "none")])
def test_four_steps(spark, n, mask, padding):
    """Any length, primes too, and groups that hold a few columns or lines."""
    rnd = np.random.default_rng(n)
    x = {k: rnd.normal(size=(n, 3)) for k in (0, 3)}
    rows = [("v", 0, k, t + 7, x[k][t].tolist()) for k in x for t in range(n)] + [("v", 0, 0, 7, [9.0, 9.0, 9.0])][: int(n > 500)]
    series = spark.createDataFrame(rows, SERIES)
    for low, high in ((0.9, 1.4), (0.1, 4.9)):
        got = rows_of(spectral.ideal_bandpass(series, 10.0, low, high, mask, padding, group=64))
        want = np.concatenate([spectral.fft_bandpass(x[k], 10.0, low, high, mask, padding) for k in (0, 3)])
        assert np.allclose(got, want, atol=1e-9)


def test_four_steps_with_gaps_and_repeated_frames(spark):
    t = [k for k in range(300) if k % 7 and k not in range(100, 140)]
    x = np.random.default_rng(0).normal(size=(len(t), 2))
    rows = [("v", 0, 0, k, v.tolist()) for k, v in zip(t, x, strict=True)]
    series = spark.createDataFrame(rows + rows[5:9], SERIES).repartition(4)
    got = spectral.ideal_bandpass(series, 10.0, 0.5, 2.0, group=50)
    assert [r.t for r in got.orderBy("t").collect()] == t
    assert np.allclose(rows_of(got), masked(x, 10.0, 0.5, 2.0), atol=1e-9)


def test_short_and_long_clips_together(spark):
    x = {"long": np.random.default_rng(1).normal(size=(400, 2)), "short": np.random.default_rng(2).normal(size=(30, 2))}
    series = spark.createDataFrame([(v, 0, 0, t, x[v][t].tolist()) for v in x for t in range(len(x[v]))], SERIES)
    got = spectral.ideal_bandpass(series, 10.0, 0.5, 2.0, group=100)
    assert np.allclose(rows_of(got), np.concatenate([masked(x[v], 10.0, 0.5, 2.0) for v in ("long", "short")]), atol=1e-9)


def test_a_clip_of_a_million_frames(spark):
    n = 1_000_000
    series = spark.range(n).selectExpr("'v' as video_id", "0 as level", "0 as tile", "cast(id as int) as t", "array(sin(id * 0.21) + cast(id * 7919 % 101 as double)) as data")
    got = spectral.ideal_bandpass(series, 30.0, 0.8333, 1.0, group=1 << 16)
    t = np.arange(n)
    want = masked((np.sin(t * 0.21) + (t * 7919 % 101))[:, None], 30.0, 0.8333, 1.0)[:, 0]
    sample = {r.t: r.v for r in got.where("t % 997 = 3").selectExpr("t", "data[0] as v").collect()}
    assert len(sample) == len(range(3, n, 997)) and np.allclose([sample[k] for k in sorted(sample)], want[sorted(sample)], atol=1e-6)
    assert got.count() == n


def direct(x, sections):
    """Difference equations, started at rest on the first value."""
    for b0, b1, b2, a1, a2, first in sections:
        y = np.empty_like(x)
        for t in range(len(x)):
            past = lambda v, k, rest: v[t - k] if t >= k else rest  # noqa: B023, E731
            y[t] = b0 * x[t] + b1 * past(x, 1, x[0]) + b2 * past(x, 2, x[0]) - a1 * past(y, 1, first * x[0]) - a2 * past(y, 2, first * x[0])
        x = y
    return x


@pytest.mark.parametrize("order, low, high", [(1, None, 3.0), (2, None, 3.0), (3, 0.5, None), (4, 0.5, 3.0), (5, 0.5, 3.0)])
def test_filters_of_any_order(spark, monkeypatch, order, low, high):
    x = np.random.default_rng(order).normal(size=(90, 2)) + 3
    series = spark.createDataFrame([("v", 0, 0, t, x[t].tolist()) for t in range(90)], SERIES).repartition(3)
    want = direct(x, [s for hz, kind in ((low, "high"), (high, "low")) if hz for s in coeffs.sections(order, hz, kind, 30.0)])
    for block, radix, levels in ((1024, 128, 1), (7, 2, 3), (1, 4, 2), (2, 3, 0)):
        monkeypatch.setattr(recursive, "BLOCK", block)
        monkeypatch.setattr(recursive, "RADIX", radix)
        assert np.allclose(rows_of(recursive.butterworth(series, 30.0, order, low, high, levels)), want, atol=1e-8)


@pytest.mark.parametrize("order", [1, 2, 3, 6])
@pytest.mark.parametrize("kind", ["low", "high"])
def test_sections_are_the_polynomials(order, kind):
    b, a = np.ones(1), np.ones(1)
    for s in coeffs.sections(order, 2.0, kind, 30.0):
        b, a = np.polymul(b, s[:3]), np.polymul(a, (1.0, *s[3:5]))
    want_b, want_a = coeffs.butterworth(order, 2.0, kind, 30.0)
    assert np.allclose(a[: order + 1], want_a) and np.allclose(b[: order + 1], want_b)


def test_tasks_grow_with_the_blocks_of_one_series(spark, monkeypatch):
    """No stage of the scan holds a series: with maps folded four at a time, 256 blocks are 64 groups."""
    monkeypatch.setattr(recursive, "BLOCK", 4)
    monkeypatch.setattr(recursive, "RADIX", 4)
    n = 1024
    series = spark.range(n).selectExpr("'v' as video_id", "0 as level", "0 as tile", "cast(id as int) as t", "array(cast(id % 5 as double)) as data")
    made = recursive.iir_lowpass(series, 30.0, 0.4, levels=4)
    plan = made._jdf.queryExecution().toString()
    assert plan.count("FlatMapCoGroupsInArrow") and recursive.levels_of(series) == 3
    x = (np.arange(n) % 5.0)[:, None]
    assert np.allclose(rows_of(made), direct(x, coeffs.first_order_section(0.4, 30.0)), atol=1e-9)


def test_frames_are_numbered_by_runs(spark):
    rows = [(v, t, "x") for v, ts in (("a", [5, 6, 900, 901, 902, 5000, 5000]), ("b", [-3, 0]), (None, [7])) for t in ts]
    got = clips.numbered(spark.createDataFrame(rows, "video_id string, t int, other string"), ["video_id"], run=100)
    want = {("a", 5): 0, ("a", 6): 1, ("a", 900): 2, ("a", 901): 3, ("a", 902): 4, ("a", 5000): 5, ("b", -3): 0, ("b", 0): 1, (None, 7): 0}
    assert {(r.video_id, r.t): r.pos for r in got.collect()} == want and got.count() == len(want)


def test_moving_averages_over_gaps(spark, monkeypatch):
    monkeypatch.setattr(metrics, "RUN", 8)
    t = [k for k in range(60) if k not in (7, 8, 9, 23, 24, 40)]
    rows = [(v, k, float((k * 7) % 11)) for v in ("a", "b") for k in t]
    got = {(r.video_id, r.t): r.smooth for r in metrics.moving_average(spark.createDataFrame(rows, "video_id string, t int, psnr double"), 10).collect()}
    want = {(v, t[i]): np.mean([(k * 7) % 11 for k in t[i - 9 : i + 1]]) for v in ("a", "b") for i in range(9, len(t))}
    assert got == pytest.approx(want) and len(got) == 2 * (len(t) - 9)


def test_frame_at_a_time(spark, tmp_path):
    """Frames that come in batches, in disorder, late and repeated, against the difference equations."""
    rnd = np.random.default_rng(3)
    x = rnd.uniform(0, 255, (20, 5, 6, 3))
    frames = clip(spark, x).withColumn("fps", F.lit(30.0))
    order = [[0, 2, 1], [3, 4, 5, 5], [2, 6], [7, 8, 9, 10, 11, 12, 13, 14], [3, 4], list(range(15, 20))]
    for k, ts in enumerate(order):
        part = frames.where(F.col("t").isin(ts))
        part = part.unionByName(frames.where("t = 5")) if ts.count(5) > 1 else part
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = frame_stream(stream, 2, 0.4, 3.0, 12.0, 0.1, 0.5)
    run = made.writeStream.format("memory").queryName("at_a_time").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.table("at_a_time").collect()
    bands = {(r.level, r.t): np.array(r.data).reshape(r.h, r.w, r.c) for r in arrays.laplacian_frames(frames, 2, True, "reflect").collect()}
    sizes = coeffs.level_sizes(5, 6, 2)
    (b0, b1, a1), (c0, c1, d1) = coefficients(0.4, 3.0, 30.0)
    assert len(got) == 60 and {r.level for r in got} == {0, 1, 2}
    for level, gain in enumerate(gains(sizes, 12.0, 0.1)):
        series = np.array([bands[level, t] for t in range(20)])
        slow = fast = series[0]
        want = [np.zeros_like(series[0])]
        for t in range(1, 20):
            slow, fast = b0 * series[t] + b1 * series[t - 1] - a1 * slow, c0 * series[t] + c1 * series[t - 1] - d1 * fast
            want.append((fast - slow) * gain * np.array([1, 0.5, 0.5]))
        own = sorted((r for r in got if r.level == level), key=lambda r: r.t)
        assert np.allclose([r.data for r in own], np.array(want).reshape(20, -1), atol=1e-8)
        assert own[-1].late == 4  # 5 again, 2 after 5, 3 and 4 after 14


def test_a_clip_that_is_over_is_cleared(spark, tmp_path):
    """A timer gives the last count of late rows and clears the state, some time after the last frame."""
    frames = clip(spark, np.random.default_rng(3).uniform(0, 255, (2, 2, 2, 3))).withColumn("fps", F.lit(30.0))
    frames.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    made = frame_stream(stream, 1, 0.4, 3.0, 12.0, 0.1, idle=0.2)
    run = made.writeStream.format("memory").queryName("over").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    for _ in range(40):
        time.sleep(0.5)
        if not run.isActive or spark.table("over").where("t is null").count() == 2:
            break
    run.stop()
    got = spark.table("over").collect()
    assert sorted((r.level, r.t is None) for r in got) == [(0, False)] * 2 + [(0, True)] + [(1, False)] * 2 + [(1, True)]
    assert all(r.late == 0 and r.data is None for r in got if r.t is None)
