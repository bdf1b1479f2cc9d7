from dataclasses import replace

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from undula import cli
from undula.config import BABY, CPP, CUDA, PYTHON
from undula.functions import coeffs, color, stencils
from undula.operators import arrays, metrics, pixels, recursive, spectral, tiles
from undula.plans.magnify import magnify
from undula.sources import frames as fr
from undula.streaming.recursive import iir_stream, refuse_stream

SMALL = replace(CPP, levels=2, high_hz=3.0)


def clip(spark, values, video="v"):
    n, h, w, c = values.shape
    rows = [(video, t, h, w, c, values[t].ravel().tolist()) for t in range(n)]
    return spark.createDataFrame(rows, "video_id string, t int, h int, w int, c int, data array<double>")


def result(df):
    rows = sorted(df.collect(), key=lambda r: (r.video_id, r.t))
    return np.array([r.data for r in rows])


@pytest.fixture(scope="module")
def values():
    rnd = np.random.default_rng(1)
    t = np.arange(48)[:, None, None, None]
    return np.clip(120 + 30 * rnd.normal(size=(1, 7, 10, 3)) + 4 * np.sin(2 * np.pi * t / 24) * rnd.normal(size=(1, 7, 10, 3)), 0, 255)


def brute_gaussian(x, cfg):
    yiq = x @ np.array(color.YIQ).T
    m, k = stencils.gaussian(x.shape[1], cfg.levels, cfg.border, cfg.size_rule), stencils.gaussian(x.shape[2], cfg.levels, cfg.border, cfg.size_rule)
    band = np.einsum("ab,tbxc,dx->tadc", m, yiq, k)
    f = np.abs(np.fft.fftfreq(len(x), 1 / (cfg.fps or 30)))
    mask = (f >= cfg.low_hz) & (f <= cfg.high_hz)
    signal = np.real(np.fft.ifft(np.fft.fft(band, axis=0) * mask[:, None, None, None], axis=0)) * cfg.alpha * np.array([1, cfg.attenuation, cfg.attenuation])
    return np.rint(np.clip((yiq + signal) @ np.array(color.inverse()).T, 0, 255))


def test_gaussian_pipeline(spark, values):
    cfg = replace(SMALL, attenuation=0.3, alpha=8.0)
    want = brute_gaussian(values, cfg).reshape(48, -1)
    for optimize in (True, False):
        got = result(magnify(clip(spark, values), replace(cfg, optimize=optimize)))
        assert np.abs(got - want).max() <= 1 and (got != want).mean() < 0.001


@pytest.mark.parametrize("base", [BABY, PYTHON, CUDA])
def test_laplacian_optimised_is_the_same(spark, values, base):
    cfg = replace(base, mode="laplacian", levels=3, low_hz=0.4, high_hz=3.0, alpha=10.0)
    a, b = (result(magnify(clip(spark, values), replace(cfg, optimize=o))) for o in (True, False))
    assert np.abs(a - b).max() <= 1 and (a != b).mean() < 0.001 and a.shape == (48, 210)


def test_tile_size_does_not_matter(spark, values, monkeypatch):
    want = result(magnify(clip(spark, values), SMALL))
    monkeypatch.setattr(tiles, "TILE", 5)
    made = tiles.untile(tiles.tiles(clip(spark, values).selectExpr("video_id", "0 as level", "t", "data"), 5))
    assert {r.t: r.data for r in made.collect()} == {t: values[t].ravel().tolist() for t in range(48)}
    assert want.shape == (48, 210)


def test_filters_in_blocks_of_time_and_narrow_tiles(spark, values, monkeypatch):
    """Blocks that don't divide the clip, gaps, and repeated frames against one pass over each series."""
    t = [k for k in range(48) if k not in (9, 10, 11, 30)]
    rows = [("v", 0, 0, k, values[k].ravel().tolist()) for k in (*t, 5, 47)]
    series = spark.createDataFrame(rows, "video_id string, level int, tile int, t int, data array<double>")
    x = values[t].reshape(len(t), -1)
    for kind, first in (("butterworth", "raw"), ("halved", "zero")):
        want, slow, fast = np.empty_like(x), x[0], x[0]
        (l0, l1, la), (h0, h1, ha) = (coeffs.first_order(hz, 30.0, kind) for hz in (0.4, 3.0))
        want[0] = x[0] if first == "raw" else 0
        for k in range(1, len(x)):
            slow, fast = l0 * x[k] + l1 * x[k - 1] - la * slow, h0 * x[k] + h1 * x[k - 1] - ha * fast
            want[k] = fast - slow
        for block in (1, 7, 1024):
            monkeypatch.setattr(recursive, "BLOCK", block)
            got = sorted(recursive.iir_bandpass(series, 30.0, 0.4, 3.0, first, kind).collect(), key=lambda r: r.t)
            assert [r.t for r in got] == t and np.allclose([r.data for r in got], want, atol=1e-9)
    for base in (SMALL, replace(BABY, levels=3, high_hz=3.0)):
        monkeypatch.setattr(recursive, "BLOCK", 1024)
        monkeypatch.setattr(spectral, "GROUP", 1 << 22)
        whole = result(magnify(clip(spark, values), base))
        monkeypatch.setattr(recursive, "BLOCK", 7)
        monkeypatch.setattr(spectral, "GROUP", 48 * 4)
        assert (result(magnify(clip(spark, values), base)) == whole).mean() > 0.999


def test_long_clips_in_blocks_read_once(spark):
    series = spark.range(5000).selectExpr("'v' as video_id", "0 as level", "0 as tile", "cast(id as int) as t", "array(cast(id % 7 as double)) as data")
    made = recursive.iir_lowpass(series, 30.0, 0.4)
    assert made.count() == 5000


def test_constant_clip_is_unchanged(spark):
    x = np.full((32, 6, 6, 3), 90.0)
    assert (result(magnify(clip(spark, x), SMALL)) == 90).all()


def test_clips_do_not_mix(spark, values):
    alone = result(magnify(clip(spark, values), SMALL))
    both = magnify(clip(spark, values).union(clip(spark, 255 - values, "w")), SMALL)
    assert (result(both.where("video_id = 'v'")) == alone).all()


def test_bandpass_refuses_streams_and_gaps_are_held(spark, tmp_path):
    rows = [("v", 0, 0, t, [float(t % 5), 1.0]) for t in (0, 1, 2, 2, 3, 6, 7)]
    series = spark.createDataFrame(rows, "video_id string, level int, tile int, t int, data array<double>")
    series.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(series.schema).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        refuse_stream(stream)
    made = iir_stream(stream, 30.0, 0.4, 3.0).writeStream.format("memory").queryName("held").trigger(availableNow=True).start()
    made.awaitTermination()
    got = {r.t: r.data for r in spark.table("held").collect()}
    assert sorted(got) == list(range(8)) and got[4] == got[5] == got[3]


def test_images_round_trip(spark, values, tmp_path):
    whole = np.rint(values[:5])
    assert fr.write_images(clip(spark, whole), str(tmp_path / "out")) == 5
    back = fr.read_frames(spark, str(tmp_path / "out"), 2)
    assert (result(back) == whole.reshape(5, -1)).all() and back.rdd.getNumPartitions() == 3
    assert fr.write_avi(back, str(tmp_path / "a.avi"), 25.0) == 5
    raw = (tmp_path / "a.avi").read_bytes()
    assert raw[:4] == b"RIFF" and int.from_bytes(raw[4:8], "little") == len(raw) - 8 and raw[8:12] == b"AVI "
    with pytest.raises(AnalysisException, match="no frames"):
        fr.read_frames(spark, str(tmp_path / "none")).count()


def test_matrix_and_vector_files(spark, tmp_path):
    m = np.arange(24.0).reshape(4, 6) / 7
    rows = [(y, x // 3, x % 3, float(m[y, x])) for y in range(4) for x in range(6)]
    fr.write_matrix(spark.createDataFrame(rows, "y int, x int, ch int, v double"), str(tmp_path / "m"))
    part = next((tmp_path / "m").glob("part-*"))
    assert sorted(map(tuple, fr.read_matrix(spark, str(part)).collect())) == rows
    (tmp_path / "v.txt").write_text("1.5,2.5e-1\n")
    assert fr.read_vector(spark, str(tmp_path / "v.txt")) == [1.5, 0.25]
    (tmp_path / "w.txt").write_text("1\n2\n")
    with pytest.raises(ValueError):
        fr.read_vector(spark, str(tmp_path / "w.txt"))


def test_metrics_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Frame,PSNR,SSIM,MaxPixelDiff,MeanPixelDiff\n0,18.7,0.9,12,1.5\n")
    assert list(fr.read_metrics(spark, str(tmp_path / "m.csv")).first()) == [0, 18.7, 0.9, 12.0, 1.5]


def test_metrics(spark, tmp_path):
    a = fr.to_pixels(clip(spark, np.full((4, 2, 2, 3), 10.0))).drop("video_id")
    b = fr.to_pixels(clip(spark, np.full((3, 2, 2, 3), 12.0))).drop("video_id")
    both = metrics.aligned(a, b, ["t", "y", "x", "ch"])
    found = metrics.psnr_per_frame(both)
    assert {r.t: round(r.psnr, 6) for r in found.collect()} == {t: round(20 * np.log10(255 / 2), 6) for t in range(3)}
    assert {r.psnr for r in metrics.psnr_per_frame(metrics.aligned(a, a, ["t", "y", "x", "ch"])).collect()} == {100.0}
    assert metrics.histogram(found).collect()[0].n == 3 and metrics.moving_average(found, 2).count() == 2
    fr.write_report(found, str(tmp_path / "r"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*"))).splitlines()
    assert len(lines) == 1 + 3 + 3 and lines[0].startswith("mean 42.11")


def test_frames_that_do_not_match_fail_by_clip(spark):
    x = np.random.default_rng(5).uniform(0, 255, (4, 3, 2, 3))
    a, b = clip(spark, x, "a").unionByName(clip(spark, x, "b")), clip(spark, x + 2, "a").unionByName(clip(spark, x[:3], "b"))
    with pytest.raises(Exception, match="clip b, frame 3 is in one table only"):
        metrics.compared(a, b).collect()
    found = {(r.video_id, r.t): r for r in metrics.frame_quality(metrics.compared(a, b, cut=True), 1.0).collect()}
    assert set(found) == {("a", t) for t in range(4)} | {("b", t) for t in range(3)}
    assert {(round(r.psnr, 6), round(r.max_diff, 6), r.n_over) for k, r in found.items() if k[0] == "a"} == {(round(20 * np.log10(255 / 2), 6), 2.0, 18)}
    assert {(r.psnr, r.max_diff, r.place, r.n_over) for k, r in found.items() if k[0] == "b"} == {(100.0, 0.0, 0, 0)}
    with pytest.raises(Exception, match="clip a, frame 0: sizes differ"):
        metrics.compared(clip(spark, x[:1], "a"), clip(spark, x[:1, :2], "a")).collect()
    with pytest.raises(Exception, match="clip a, frame 0 lacks values"):
        metrics.compared(clip(spark, x[:1], "a"), clip(spark, x[:1], "a").withColumn("data", F.slice("data", 1, 5))).collect()
    assert metrics.assert_close(clip(spark, x), clip(spark, x + 0.5), 0.6).count() == 4
    with pytest.raises(Exception, match="clip v, frame 2: value 7 differs by 5"):
        y = x.copy()
        y[2].ravel()[7] += 5
        metrics.assert_close(clip(spark, x), clip(spark, y), 0.6).collect()
    summary = {r.video_id: r.n for r in metrics.psnr_summary(metrics.frame_quality(metrics.compared(a, b, cut=True))).collect()}
    assert summary == {"a": 4, "b": 3}


def test_command_line(spark, tmp_path, capsys):
    """Two clips of their own rates magnified to files, with the time of each stage, and a report of both."""
    x = np.rint(np.random.default_rng(5).uniform(50, 200, (12, 6, 6, 3)))
    both = clip(spark, x, "a").withColumn("fps", F.lit(30.0)).unionByName(clip(spark, x[:9, :5], "b").withColumn("fps", F.lit(20.0)))
    fr.write_clips(both, str(tmp_path / "in"))
    for mode, stages in (("gaussian", {"colour", "pyramid", "filter", "reconstruction"}), ("laplacian", {"colour", "pyramid", "filter", "filter, ends of blocks", "reconstruction"})):
        out = str(tmp_path / mode)
        cli.main(["magnify", str(tmp_path / "in"), out, "--mode", mode, "--levels", "2", "--high_hz", "3.0", "--alpha", "5", "--video", "--timing"])
        lines = [line for line in capsys.readouterr().out.splitlines() if "task seconds" in line]
        assert {line.split(":")[0] for line in lines} == stages
        rows = {line.split(":")[0]: int(line.split()[-7]) for line in lines}
        # each frame once; a recursive filter reads its bands for the blocks' states and for the result
        assert rows["reconstruction"] == 21 and rows["colour"] == rows["pyramid"] == (21 if mode == "gaussian" else 42)
        back = fr.read_frames(spark, out).where("video_id like '%.avi'")
        assert {(r.video_id, r.fps, r.n) for r in back.groupBy("video_id", "fps").agg(F.count("*").alias("n")).collect()} == {("a.avi", 30.0, 12), ("b.avi", 20.0, 9)}
    cli.main(["psnr", str(tmp_path / "in"), str(tmp_path / "in"), str(tmp_path / "report")])
    text = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*"))).splitlines()
    assert text[0].startswith("a: mean 100.00") and "b: Frame 8: 100.00 dB" in text and len(text) == 2 + 10 + 9 + 21


def test_plans_have_no_extra_exchange(spark, values):
    px = pixels.by_frame(fr.to_pixels(clip(spark, values)))
    plan = pixels.gaussian_blur(spark, px, 7, 10, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    blurred = arrays.gaussian_frames(clip(spark, values), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in blurred


def test_pixels_are_dealt_out_by_their_number_in_one_exchange(spark, values, monkeypatch):
    """Partitions follow the pixels, also of a clip whose name is a constant."""
    monkeypatch.setattr(pixels, "PART", 150)
    table = fr.to_pixels(clip(spark, values)).withColumn("video_id", F.lit("v"))
    px = pixels.by_frame(table)
    assert px.rdd.getNumPartitions() == -(-table.count() // 150) > 4
    assert max(spark.createDataFrame([(n,) for n in px.rdd.glom().map(len).collect()], "n int").toPandas()["n"]) < table.count() / 2
    for made in (pixels.pyr_up(spark, px, 7, 10), pixels.gaussian_blur(spark, px, 7, 10, 2)):
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
