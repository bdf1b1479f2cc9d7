"""Registered queries over several clips of their own rates, sizes and lengths, and filters of any order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from math import hypot

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import BABY, CPP, PYTHON
from .functions import coeffs, color
from .operators import arrays, clips, metrics, recursive, spectral, tiles
from .plans.magnify import magnify
from .queries import FPS, GREY, HIGH, LOW, ORACLE_SQL, QUERIES, SQL_BINS, TAPS, V, _dot_sql, _series, _untiled, fresh, grey_frames, out, query, r6, sql_of, vectors
from .shared import kept
from .sources import frames as fr
from .streaming.frame_filter import frame_stream

__all__ = ["ORACLE_SQL", "QUERIES"]

# --- two clips, by turns of the vectors: 4 x 4 at 30 frames a second, 7 x 3 at 25 ----------------------

SHAPES = {"a": (0, 4, 4, 30.0), "b": (1, 7, 3, 25.0)}  # remainder of vec_id, h, w, fps


def two_clips(spark, d) -> DataFrame:
    parts = []
    for name, (turn, h, w, fps) in SHAPES.items():
        own = vectors(spark, d).where(F.col("vec_id") % 2 == turn).select(F.expr("vec_id div 2").alias("vec_id"), "embedding")
        parts.append(fr.frames_from_vectors(own, "vec_id", "embedding", h, w, 3, name).withColumn("fps", F.lit(fps)))
    return parts[0].unionByName(parts[1])


def wide_frames(spark, d) -> DataFrame:
    """6 x 7 frames of two vectors each, large enough for three bands."""
    pairs = vectors(spark, d).groupBy(F.expr("vec_id div 2").cast("int").alias("t")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda p: p["embedding"])).alias("e")).where("size(e) = 128")
    return fr.frames_from_vectors(pairs, "t", "e", 6, 7, 3)


def _values(frames: DataFrame) -> DataFrame:
    rows = frames.select("video_id", "t", "w", F.posexplode("data").alias("i", "v"))
    return rows.select("video_id", "t", F.expr("i div (3 * w)").cast("int").alias("y"), F.expr("(i % (3 * w)) div 3").cast("int").alias("x"), F.expr("i % 3").cast("int").alias("ch"), F.col("v").cast("int").alias("v"))


SQL_CLIPS = "clips AS (SELECT s.video_id, s.h, s.w, s.fps, count(*) AS n FROM embeddings JOIN (VALUES {}) s(turn, video_id, h, w, fps) ON vec_id % 2 = turn GROUP BY ALL)".format(", ".join(f"({t}, '{k}', {h}, {w}, {fps!r}::DOUBLE)" for k, (t, h, w, fps) in SHAPES.items()))


# --- SQL of pipelines for one clip of any size -----------------------------------------------------------


def sql_fold(j: str, n: int) -> str:
    """The place that a place beyond the border mirrors, for any size."""
    if n == 1:
        return "0"
    m = f"(abs({j}) % {2 * (n - 1)})"
    return f"CASE WHEN {m} >= {n} THEN {2 * (n - 1)} - {m} ELSE {m} END"


def sql_down(name: str, n: int, size: int) -> str:
    return f"{name} AS (SELECT o::INT AS o, {sql_fold('2 * o + d', n)} AS i, sum(k) AS w FROM range({size}) r(o), taps GROUP BY ALL)"


def sql_up(name: str, n: int, size: int) -> str:
    return f"{name} AS (SELECT o::INT AS o, j // 2 AS i, sum(2 * k) AS w FROM (SELECT o, {sql_fold('o + d', size)} AS j, k FROM range({size}) r(o), taps) WHERE j % 2 = 0 AND j // 2 < {n} GROUP BY ALL)"


def sql_apply(name: str, source: str, rows: str, columns: str, key: str = "t, ch, ") -> str:
    return f"{name} AS (SELECT {key}a.o AS y, b.o AS x, sum(v * a.w * b.w) AS v FROM {source} JOIN {rows} a ON a.i = y JOIN {columns} b ON b.i = x GROUP BY ALL)"


def sql_low_pass(name: str, hz: float, fps: float) -> str:
    return f"{name} AS (SELECT k / (1 + k) AS b0, (k - 1) / (k + 1) AS a1 FROM (SELECT tan(pi() * {hz!r} / {fps!r}) AS k))"


def sql_clip(video: str, source: str, count: str, h: int, w: int, fps: float, config) -> str:
    """The whole pipeline of one clip whose frames are the CTE body `source` (t, y, x, ch, v)."""
    sizes = coeffs.level_sizes(h, w, config.levels)
    parts = [TAPS, f"rgb AS ({source})", "tri AS (SELECT t, y, x, max(v) FILTER (ch = 0) AS r, max(v) FILTER (ch = 1) AS g, max(v) FILTER (ch = 2) AS b FROM rgb GROUP BY ALL)"]
    parts.append("g0 AS ({})".format(" UNION ALL ".join(f"SELECT t, y, x, {k} AS ch, {_dot_sql(row, 'rgb')} AS v FROM tri" for k, row in enumerate(color.YIQ))))
    for i, ((a, b), (c, e)) in enumerate(zip(sizes[:-1], sizes[1:], strict=True)):
        parts += [sql_down(f"dy{i}", a, c), sql_down(f"dx{i}", b, e), sql_up(f"uy{i}", c, a), sql_up(f"ux{i}", e, b), sql_apply(f"g{i + 1}", f"g{i}", f"dy{i}", f"dx{i}")]
    last = config.levels
    if config.mode == "gaussian":
        parts += [
            f"n AS (SELECT ({count}) AS n)", f"bins AS (SELECT k::INT AS k, CASE WHEN k < (n + 1) // 2 THEN k ELSE k - n END * {fps!r}::DOUBLE / n AS hz FROM n, range((SELECT n FROM n)) r(k))",
            f"kept AS (SELECT k, CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END AS w FROM bins, n WHERE k <= n // 2 AND abs(hz) BETWEEN {config.low_hz!r} AND {config.high_hz!r})",
            f"coef AS (SELECT y, x, ch, k, w, sum(v * cos(2 * pi() * k * t / n)) AS a, sum(v * sin(2 * pi() * k * t / n)) AS b FROM g{last}, kept, n GROUP BY ALL)",
            "band AS (SELECT t, y, x, ch, sum(w / n * (a * cos(2 * pi() * k * t / n) + b * sin(2 * pi() * k * t / n))) AS v FROM (SELECT DISTINCT t FROM g0), coef, n GROUP BY ALL)",
            f"s{last} AS (SELECT t, y, x, ch, v * CASE WHEN ch = 0 THEN {config.alpha!r}::DOUBLE ELSE {config.alpha * config.attenuation!r}::DOUBLE END AS v FROM band)",
        ]
    else:
        delta = config.lambda_cutoff / (8 * (1 + config.alpha))
        n = config.levels + int(config.residual)
        added = {"inner": range(1, n - 1), "inner_residual": range(1, n)}[config.added_levels]
        bands = [f"SELECT {i} AS level, a.t, a.y, a.x, a.ch, a.v - b.v AS v FROM g{i} a JOIN (SELECT t, ch, p.o AS y, q.o AS x, sum(v * p.w * q.w) AS v FROM g{i + 1} JOIN uy{i} p ON p.i = y JOIN ux{i} q ON q.i = x GROUP BY ALL) b USING (t, y, x, ch)" if i < last else f"SELECT {i} AS level, t, y, x, ch, v FROM g{i}" for i in added]
        gains = " ".join(f"WHEN level = {i} THEN {min(config.alpha, hypot(*sizes[i]) / (8 * delta) - 1)!r}::DOUBLE * CASE WHEN ch = 0 THEN 1 ELSE {config.attenuation!r}::DOUBLE END" for i in added if 0 < i < n - 1)
        parts += [
            f"px AS ({' UNION ALL '.join(bands)})", sql_low_pass("lo", config.low_hz, fps), sql_low_pass("hi", config.high_hz, fps),
            "run(level, t, y, x, ch, v, slow, fast) AS (SELECT level, t, y, x, ch, v, v, v FROM px WHERE t = 0 UNION ALL SELECT p.level, p.t, p.y, p.x, p.ch, p.v, lo.b0 * (p.v + run.v) - lo.a1 * slow, hi.b0 * (p.v + run.v) - hi.a1 * fast FROM run JOIN px p ON p.level = run.level AND p.t = run.t + 1 AND p.y = run.y AND p.x = run.x AND p.ch = run.ch, lo, hi)",
            f"band AS (SELECT level, t, y, x, ch, CASE WHEN t = 0 THEN v ELSE (fast - slow) * CASE {gains} ELSE 1 END END AS v FROM run)",
        ]
        for i in range(last, -1, -1):
            grown = [f"SELECT t, y, x, ch, v FROM f{i}"] if i < last else []
            grown += [f"SELECT t, y, x, ch, v FROM band WHERE level = {i}"] if i in added else []
            parts.append(f"s{i} AS (SELECT t, y, x, ch, sum(v) AS v FROM ({' UNION ALL '.join(grown) or 'SELECT t, y, x, ch, v FROM g0 WHERE false'}) GROUP BY ALL)")
            if i:
                parts.append(sql_apply(f"f{i - 1}", f"s{i}", f"uy{i - 1}", f"ux{i - 1}"))
    if config.mode == "gaussian":
        parts += [sql_apply(f"s{i}", f"s{i + 1}", f"uy{i}", f"ux{i}") for i in range(last - 1, -1, -1)]
    cell = "max(g0.v + coalesce(s0.v, 0)) FILTER (ch = {})"
    parts.append(f"z AS (SELECT t, y, x, {', '.join(f'{cell.format(k)} AS z{k}' for k in range(3))} FROM g0 LEFT JOIN s0 USING (t, y, x, ch) GROUP BY ALL)")
    whole = "round_even({}, 0)" if config.rounding == "rint" else "floor({})"
    cells = " UNION ALL ".join(f"SELECT '{video}' AS video_id, t, y, x, {k} AS ch, {whole.format(f'least(greatest({_dot_sql(row, ("z0", "z1", "z2"))}, 0), 255)')}::INT AS v FROM z" for k, row in enumerate(color.inverse(config.inverse)))
    return f"SELECT * FROM ({sql_of(*parts, select=cells)})"


def _sql_two_clips(config, cell: str = "{}") -> str:
    one = []
    for name, (turn, h, w, fps) in SHAPES.items():
        source = f"SELECT (vec_id // 2)::INT AS t, (i // {3 * w})::INT AS y, ((i % {3 * w}) // 3)::INT AS x, (i % 3)::INT AS ch, {cell.format('127.5 * (1 + embedding[i + 1]::DOUBLE)')} AS v FROM embeddings, range({3 * h * w}) r(i) WHERE vec_id % 2 = {turn}"
        one.append(sql_clip(name, source, f"SELECT count(*) FROM embeddings WHERE vec_id % 2 = {turn}", h, w, fps, config))
    return " UNION ALL ".join(one)


TWO_GAUSSIAN, TWO_LAPLACIAN = replace(CPP, levels=1, attenuation=0.5), replace(BABY, levels=2)


@query(_sql_two_clips(TWO_GAUSSIAN))
def magnify_gaussian_clips(spark, d):
    """Clips of two rates and two sizes in one table, in one plan."""
    return _values(magnify(two_clips(spark, d), TWO_GAUSSIAN))


@query(_sql_two_clips(TWO_LAPLACIAN))
def magnify_laplacian_clips(spark, d):
    return _values(magnify(two_clips(spark, d), TWO_LAPLACIAN))


@query(_sql_two_clips(TWO_LAPLACIAN, "floor(least(greatest({}, 0), 255))"))
def magnify_laplacian_bytes(spark, d):
    """Frames that hold a byte for each value, from the table to the result."""
    return _values(arrays.numbers(magnify(arrays.to_bytes(two_clips(spark, d)), TWO_LAPLACIAN)))


@query(_sql_two_clips(TWO_GAUSSIAN, "floor(least(greatest({}, 0), 255))"))
def magnify_gaussian_bytes(spark, d):
    return _values(arrays.numbers(magnify(arrays.to_bytes(two_clips(spark, d)), TWO_GAUSSIAN)))


PYTHON_LAPLACIAN = replace(PYTHON, mode="laplacian", levels=3, low_hz=0.4, high_hz=3.0, alpha=20.0, lambda_cutoff=60.0, attenuation=0.5)
WIDE = "SELECT (vec_id // 2)::INT AS t, (j // 21)::INT AS y, ((j % 21) // 3)::INT AS x, (j % 3)::INT AS ch, v FROM (SELECT vec_id, (vec_id % 2) * 64 + i AS j, 127.5 * (1 + embedding[i + 1]::DOUBLE) AS v FROM embeddings, range(64) r(i)) WHERE j < 126 AND (vec_id // 2) * 2 + 1 < (SELECT count(*) FROM embeddings)"


@query(sql_clip("v", WIDE, "SELECT 0", 6, 7, FPS, PYTHON_LAPLACIAN))
def magnify_laplacian_python(spark, d):
    """Three bands without the coarsest image, of which the inner one is added; values are cut, not rounded."""
    return _values(magnify(wide_frames(spark, d), PYTHON_LAPLACIAN))


# --- what filters and pyramids need to know of each clip ------------------------------------------------------


def _by_clip(spark, d, kind: str, make: Callable[..., list[tuple]]) -> DataFrame:
    """Rows that `make` gives for (frames, h, w, fps) of each clip."""
    names = [c.split()[0] for c in kind.split(", ")]

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [(c.video_id, *row) for c in part.itertuples() for row in make(int(c.frames), int(c.h), int(c.w), float(c.fps))]
            yield pd.DataFrame(made, columns=["video_id", *names])

    return clips.described(two_clips(spark, d)).mapInPandas(work, f"video_id string, {kind}")


_SECTION = "b0 double, b1 double, b2 double, a1 double, a2 double"


def _section(spark, d, order: int, hz: float, kind: str, columns: str) -> DataFrame:
    rows = _by_clip(spark, d, _SECTION, lambda n, h, w, fps: [s[:5] for s in coeffs.sections(order, hz, kind, fps)])
    return rows.select("video_id", *[F.round(c, 12).alias(c) for c in columns.split()])


@query(sql_of(SQL_CLIPS, select="SELECT video_id, round(k / (1 + k), 12) AS b0, round(k / (1 + k), 12) AS b1, round((k - 1) / (k + 1), 12) AS a1 FROM (SELECT video_id, tan(pi() * 0.4 / fps) AS k FROM clips)"))
def butter1_low(spark, d):
    return _section(spark, d, 1, 0.4, "low", "b0 b1 a1")


@query(sql_of(SQL_CLIPS, select="SELECT video_id, round(1 / (1 + k), 12) AS b0, round(-1 / (1 + k), 12) AS b1, round((k - 1) / (k + 1), 12) AS a1 FROM (SELECT video_id, tan(pi() * 3.0 / fps) AS k FROM clips)"))
def butter1_high(spark, d):
    return _section(spark, d, 1, 3.0, "high", "b0 b1 a1")


@query(sql_of(SQL_CLIPS, select="SELECT video_id, round(k * k * m, 12) AS b0, round(2 * k * k * m, 12) AS b1, round(k * k * m, 12) AS b2, round(2 * (k * k - 1) * m, 12) AS a1, round((1 - sqrt(2.0) * k + k * k) * m, 12) AS a2 FROM (SELECT video_id, k, 1 / (1 + sqrt(2.0) * k + k * k) AS m FROM (SELECT video_id, tan(pi() * 3.0 / fps) AS k FROM clips))"))
def butter2_low(spark, d):
    return _section(spark, d, 2, 3.0, "low", "b0 b1 b2 a1 a2")


SQL_SIZES = SQL_CLIPS + ", sizes(video_id, level, h, w) AS (SELECT video_id, 0, h, w FROM clips UNION ALL SELECT video_id, level + 1, greatest(1, (h + 1) // 2), greatest(1, (w + 1) // 2) FROM sizes WHERE level < 4)"


@query(sql_of(SQL_SIZES, select="SELECT video_id, level::INT AS level, h::INT AS h, w::INT AS w FROM sizes"))
def level_dimensions(spark, d):
    return _by_clip(spark, d, "level int, h int, w int", lambda n, h, w, fps: [(k, *s) for k, s in enumerate(coeffs.level_sizes(h, w, 4))])


@query(sql_of(SQL_SIZES, select="SELECT video_id, level::INT AS level, round(CASE WHEN level > 0 AND level < 4 THEN least(a, sqrt(h * h + w * w) / (8 * (lc / (8 * (1 + a)))) - 1) ELSE 1 END, 6) AS gain, config FROM sizes, (VALUES ('cpp', 50.0::DOUBLE, 16.0::DOUBLE), ('python', 100.0, 1000.0)) c(config, a, lc)"))
def level_gain(spark, d):
    def make(n, h, w, fps):
        return [(k, round(g, 6), name) for name, c in (("cpp", CPP), ("python", PYTHON)) for k, g in enumerate(coeffs.level_gains(coeffs.level_sizes(h, w, 4), c.alpha, c.lambda_cutoff))]

    return _by_clip(spark, d, "level int, gain double, config string", make)


SQL_CLIP_BINS = SQL_CLIPS + ", bins AS (SELECT video_id, n, k::INT AS k, CASE WHEN k < (n + 1) // 2 THEN k ELSE k - n END * fps / n AS hz FROM (SELECT video_id, n, fps, unnest(range(n)) AS k FROM clips))"
SQL_NEAREST = f"nearest AS (SELECT video_id, arg_min(k, (abs(hz - {LOW}), k)) AS low_bin, arg_min(k, (abs(hz - {HIGH}), k)) AS high_bin FROM bins GROUP BY video_id)"


def _bins(spark, d) -> DataFrame:
    """(video_id, k, hz) of every bin of every clip."""
    n, k = F.col("frames"), F.col("k")
    rows = clips.described(two_clips(spark, d)).select("video_id", "frames", "fps", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
    return rows.select("video_id", k.cast("int").alias("k"), (F.when(k < F.expr("(frames + 1) div 2"), k).otherwise(k - n) * F.col("fps") / n).alias("hz"))


def _nearest(bins: DataFrame) -> DataFrame:
    return bins.groupBy("video_id").agg(*[F.min_by("k", F.struct(F.abs(F.col("hz") - hz), "k")).alias(f"{n}_bin") for n, hz in (("low", LOW), ("high", HIGH))])


@query(sql_of(SQL_CLIP_BINS, select="SELECT video_id, k, round(hz, 6) + 0.0 AS hz FROM bins"))
def fft_bins(spark, d):
    return _bins(spark, d).select("video_id", "k", r6("hz").alias("hz"))


@query(sql_of(SQL_CLIP_BINS, SQL_NEAREST, select="SELECT * FROM nearest"))
def nearest_bin(spark, d):
    return _nearest(_bins(spark, d))


@query(sql_of(SQL_CLIP_BINS, select=f"SELECT video_id, k FROM bins WHERE abs(hz) BETWEEN {LOW} AND {HIGH}"))
def band_mask_cpp(spark, d):
    return _bins(spark, d).where(F.abs("hz").between(LOW, HIGH)).select("video_id", "k")


@query(sql_of(SQL_CLIP_BINS, SQL_NEAREST, select="SELECT video_id, k FROM bins JOIN nearest USING (video_id) WHERE k >= low_bin AND k < high_bin"))
def band_mask_python(spark, d):
    bins = _bins(spark, d)
    return bins.join(_nearest(bins), "video_id").where("k between low_bin and high_bin - 1").select("video_id", "k")


# --- filters ---------------------------------------------------------------------------------------------------


def _sql_second_order(name: str, source: str, hz: float, high: bool) -> list[str]:
    """A Butterworth section of order 2 along t from rest, over `source` (t, y, x, v)."""
    b = ("m", "-2 * m", "m") if high else ("k * k * m", "2 * k * k * m", "k * k * m")
    start = "0.0::DOUBLE" if high else "v"
    return [
        f"c_{name} AS (SELECT {b[0]} AS b0, {b[1]} AS b1, {b[2]} AS b2, 2 * (k * k - 1) * m AS a1, (1 - sqrt(2.0::DOUBLE) * k + k * k) * m AS a2 FROM (SELECT k, 1 / (1 + sqrt(2.0::DOUBLE) * k + k * k) AS m FROM (SELECT tan(pi() * {hz!r} / 30) AS k)))",
        f"r_{name}(t, y, x, v, v1, v2, o, o1) AS (SELECT t, y, x, v, v, v, {start}, {start} FROM {source} WHERE t = 0 UNION ALL SELECT p.t, p.y, p.x, p.v, r.v, r.v1, b0 * p.v + b1 * r.v + b2 * r.v1 - a1 * r.o - a2 * r.o1, r.o FROM r_{name} r JOIN {source} p ON p.t = r.t + 1 AND p.y = r.y AND p.x = r.x, c_{name})",
        f"{name} AS (SELECT t, y, x, o AS v FROM r_{name})",
    ]


@query(sql_of(GREY, *_sql_second_order("over", "px", 0.4, True), *_sql_second_order("under", "over", 3.0, False), select=V + "under"))
def butterworth_band4(spark, d):
    """A band of order 4: a high-pass and a low-pass of order 2 after each other, in second-order sections."""
    return _untiled(recursive.butterworth(_series(spark, d), FPS, 2, 0.4, 3.0))


SQL_PADDED = SQL_BINS.replace("n AS (SELECT count(*) AS n FROM embeddings)", "n AS (SELECT min(2 ** a * 3 ** b * 5 ** c)::BIGINT AS n FROM range(24) p(a), range(16) q(b), range(12) s(c) WHERE 2 ** a * 3 ** b * 5 ** c >= (SELECT count(*) FROM embeddings))")


@query(
    sql_of(
        GREY, SQL_PADDED, f"kept AS (SELECT k, CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END AS w FROM bins, n WHERE k <= n // 2 AND abs(hz) BETWEEN {LOW} AND {HIGH})",
        "coef AS (SELECT y, x, k, w, sum(v * cos(2 * pi() * k * t / n)) AS a, sum(v * sin(2 * pi() * k * t / n)) AS b FROM px, kept, n GROUP BY ALL)",
        "band AS (SELECT t, y, x, sum(w / n * (a * cos(2 * pi() * k * t / n) + b * sin(2 * pi() * k * t / n))) AS v FROM (SELECT vec_id::INT AS t FROM embeddings), coef, n GROUP BY ALL)",
        select=V + "band",
    )
)
def ideal_bandpass_padded(spark, d):
    """Series are filled with zeros up to a length of small factors."""
    return _untiled(spectral.ideal_bandpass(_series(spark, d), FPS, LOW, HIGH, padding="optimal"))


def _sql_frame_stream(alpha: float, lam: float, low: float, high: float, attenuation: float) -> str:
    mid = min(alpha, hypot(2, 2) / (8 * lam) - 1)
    fold = lambda j, n: f"CASE WHEN {j} < 0 THEN -({j}) - 1 WHEN {j} >= {n} THEN {2 * n - 1} - ({j}) ELSE {j} END"
    down = lambda name, n, size: f"{name} AS (SELECT o::INT AS o, {fold('2 * o + d', n)} AS i, sum(k) AS w FROM range({size}) r(o), taps GROUP BY ALL)"
    up = lambda name, n, size: f"{name} AS (SELECT o::INT AS o, j // 2 AS i, sum(2 * k) AS w FROM (SELECT o, {fold('o + d', size)} AS j, k FROM range({size}) r(o), taps) WHERE j % 2 = 0 AND j // 2 < {n} GROUP BY ALL)"
    source = "g0 AS (SELECT vec_id::INT AS t, (i // 12)::INT AS y, ((i % 12) // 3)::INT AS x, (i % 3)::INT AS ch, 127.5 * (1 + embedding[i + 1]::DOUBLE) AS v FROM embeddings, range(48) r(i))"
    minus = lambda i: f"SELECT {i} AS level, a.t, a.y, a.x, a.ch, a.v - b.v AS v FROM g{i} a JOIN e{i} b USING (t, y, x, ch)"
    return sql_of(
        TAPS, source, down("d4", 4, 2), down("d2", 2, 1), up("u4", 2, 4), up("u2", 1, 2), sql_apply("g1", "g0", "d4", "d4"), sql_apply("g2", "g1", "d2", "d2"), sql_apply("e0", "g1", "u4", "u4"), sql_apply("e1", "g2", "u2", "u2"),
        f"px AS ({minus(0)} UNION ALL {minus(1)} UNION ALL SELECT 2, t, y, x, ch, v FROM g2)",
        f"c AS (SELECT s / (s + 2) AS b, 2 / (f + 2) AS c, (f - 2) / (f + 2) AS d FROM (SELECT 2 * pi() * {low!r} / 30 AS s, 2 * pi() * {high!r} / 30 AS f))",
        "run(level, t, y, x, ch, v, slow, fast) AS (SELECT level, t, y, x, ch, v, v, v FROM px WHERE t = 0 UNION ALL SELECT p.level, p.t, p.y, p.x, p.ch, p.v, b * (p.v + run.v) - (b - 1) * slow, c.c * (p.v - run.v) - d * fast FROM run JOIN px p ON p.level = run.level AND p.t = run.t + 1 AND p.y = run.y AND p.x = run.x AND p.ch = run.ch, c)",
        select=f"SELECT level, t, y, x, ch, round(CASE WHEN t = 0 THEN 0 ELSE (fast - slow) * CASE WHEN level = 1 THEN {mid!r}::DOUBLE ELSE {alpha!r}::DOUBLE END * CASE WHEN ch = 0 THEN 1 ELSE {attenuation!r}::DOUBLE END END, 6) + 0.0 AS v, CASE WHEN t >= (SELECT 3 * count(*) // 4 FROM embeddings) THEN 1 ELSE 0 END::BIGINT AS late FROM run",
    )


@query(_sql_frame_stream(12.0, 0.05, 0.4, 3.0, 0.5))
def frame_stream_batches(spark, d):
    """Frames one at a time through a stream: four batches, and a late row before the last one."""
    frames = kept(spark, fr.frames_from_vectors(vectors(spark, d), "vec_id", "embedding", 4, 4, 3), "stream-frames")
    n, folder = frames.count(), fresh(spark, "frame-stream")
    for k in range(4):
        part = frames.where((F.col("t") >= k * n // 4) & (F.col("t") < (k + 1) * n // 4))
        (part.unionByName(frames.where("t = 1")) if k == 3 else part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    made = frame_stream(stream, 2, 0.4, 3.0, 12.0, 0.05, 0.5)
    run = made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    size = F.when(F.col("level") == 0, 4).when(F.col("level") == 1, 2).otherwise(1)
    rows = spark.read.parquet(f"{folder}/out").select("level", "t", "late", size.alias("w"), F.posexplode("data").alias("i", "v"))
    return rows.select("level", "t", F.expr("i div (3 * w)").cast("int").alias("y"), F.expr("(i % (3 * w)) div 3").cast("int").alias("x"), F.expr("i % 3").cast("int").alias("ch"), r6("v").alias("v"), "late")


# --- shapes and quality -----------------------------------------------------------------------------------------


def sql_bilinear(name: str, n: int, size: int) -> str:
    at = f"least(greatest((o + 0.5::DOUBLE) * {n} / {size} - 0.5, 0), {n - 1})"
    low = f"least(floor({at}), {n - 2})::INT"
    return f"{name} AS (SELECT o::INT AS o, i::INT AS i, sum(w) AS w FROM (SELECT o, {low} AS i, 1 - ({at} - {low}) AS w FROM range({size}) r(o) UNION ALL SELECT o, {low} + 1, {at} - {low} FROM range({size}) r(o)) GROUP BY ALL)"


NINE = GREY.replace("range(64)", "range(63)").replace("i // 8", "i // 9").replace("i % 8", "i % 9")


@query(
    sql_of(
        NINE, TAPS, sql_down("dy0", 7, 3), sql_down("dx0", 9, 4), sql_down("dy1", 3, 1), sql_down("dx1", 4, 2), sql_up("uy1", 1, 2), sql_up("ux1", 2, 4), sql_up("uy0", 2, 3), sql_up("ux0", 4, 7), sql_bilinear("liny", 3, 7), sql_bilinear("linx", 7, 9),
        *[sql_apply(a, b, c, e, "t, ") for a, b, c, e in (("g1", "px", "dy0", "dx0"), ("g2", "g1", "dy1", "dx1"), ("e1", "g2", "uy1", "ux1"), ("e0", "e1", "uy0", "ux0"), ("fixed", "e0", "liny", "linx"))],
        select=V + "fixed",
    )
)
def gaussian_frames_repaired(spark, d):
    """Odd sides halved down and doubled again end short of 7 x 9; interpolation brings them there."""
    frames = fr.frames_from_vectors(vectors(spark, d), "vec_id", "embedding", 7, 9, 1)
    return out(fr.to_pixels(arrays.gaussian_frames(frames, 2, "reflect101", "floor", True, True), channels=False))


SQL_WINDOW = f"win AS (SELECT o::INT AS o, {sql_fold('o + d', 8)} AS i, sum(k) AS w FROM range(8) r(o), (SELECT d, exp(-0.5::DOUBLE * (d / 1.5::DOUBLE) * (d / 1.5::DOUBLE)) / sum(exp(-0.5::DOUBLE * (d / 1.5::DOUBLE) * (d / 1.5::DOUBLE))) OVER () AS k FROM (SELECT unnest(range(-5, 6)) AS d)) GROUP BY ALL)"


@query(
    sql_of(
        GREY, SQL_WINDOW, "pair AS (SELECT a.t, a.y, a.x, a.v, b.v AS o FROM px a JOIN px b ON b.t = a.t + 1 AND a.y = b.y AND a.x = b.x)",
        "m AS (SELECT t, p.o AS y, q.o AS x, sum(v * p.w * q.w) AS a, sum(pair.o * p.w * q.w) AS b, sum(v * v * p.w * q.w) AS aa, sum(pair.o * pair.o * p.w * q.w) AS bb, sum(v * pair.o * p.w * q.w) AS ab FROM pair JOIN win p ON p.i = y JOIN win q ON q.i = x GROUP BY ALL)",
        select="SELECT t, round(avg((2 * a * b + 6.5025) * (2 * (ab - a * b) + 58.5225) / ((a * a + b * b + 6.5025) * (aa - a * a + bb - b * b + 58.5225))), 6) + 0.0 AS ssim FROM m GROUP BY t",
    )
)
def ssim_local(spark, d):
    """Each frame and the next one under a Gaussian window of 11 x 11."""
    frames = grey_frames(spark, d)
    return metrics.local_ssim(frames, frames.withColumn("t", F.col("t") - 1)).select("t", r6("ssim").alias("ssim"))


# --- video files of several clips -------------------------------------------------------------------------------

SQL_FILES = " UNION ALL ".join(
    f"SELECT '{{}}{name}{{}}' AS video_id, {h} AS h, {w} AS w, {fps!r}::DOUBLE AS fps, (vec_id // 2)::INT AS t, i::INT AS i, floor(least(greatest(127.5 * (1 + embedding[i + 1]::DOUBLE), 0), 255))::INT AS v FROM embeddings, range({3 * h * w}) r(i) WHERE vec_id % 2 = {turn}"
    for name, (turn, h, w, fps) in SHAPES.items()
)


def _whole_values(spark, d) -> DataFrame:
    return two_clips(spark, d).withColumn("data", F.transform("data", lambda v: color.to_u8(v, "truncate").cast("double")))


def _listed(frames: DataFrame) -> DataFrame:
    return frames.select("video_id", "h", "w", "fps", "t", F.posexplode("data").alias("i", "v")).withColumn("v", F.col("v").cast("int"))


@query(SQL_FILES.format("", "", "", ""))
def source_clips(spark, d):
    """Two clips, each written in parts by several tasks, and read again."""
    folder = fresh(spark, "clips")
    fr.write_clips(_whole_values(spark, d), folder, segment=32)
    return _listed(fr.read_frames(spark, folder))


@query(SQL_FILES.format("", ".avi", "", ".avi"))
def source_joined_clips(spark, d):
    """Parts become one file for each clip, of several lists of frames."""
    folder = fresh(spark, "joined")
    fr.write_clips(_whole_values(spark, d), f"{folder}/parts", segment=32)
    fr.join_clips(spark, f"{folder}/parts", f"{folder}/whole")
    return _listed(fr.read_frames(spark, f"{folder}/whole"))


@query(SQL_FILES.format("", "", "", ""))
def source_stream(spark, d):
    """The frames of a folder as a stream, in two runs: the second goes on behind the first."""
    folder, whole = fresh(spark, "frame-source"), kept(spark, _whole_values(spark, d), "frame-source-rows")
    for k in range(2):
        fr.write_clips(whole.where(F.col("video_id") == "ab"[k]), f"{folder}/in", segment=32)
        run = fr.stream_frames(spark, f"{folder}/in").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return _listed(spark.read.parquet(f"{folder}/out"))


PAIR8 = GREY + ", pair AS (SELECT a.t, 8 * a.y + a.x AS i, abs(a.v - b.v) AS d FROM px a JOIN px b ON b.t = a.t + 1 AND a.y = b.y AND a.x = b.x)"


@query(sql_of(PAIR8, select="SELECT t, round(CASE WHEN avg(d * d) = 0 THEN 100 ELSE 20 * log10(255 / sqrt(avg(d * d))) END, 6) AS psnr, round(max(d), 6) AS max_diff, round(avg(d), 6) AS mean_diff, arg_min(i, (-d, i))::BIGINT AS place, count(*) FILTER (d > 40) AS n_over FROM pair GROUP BY t"))
def frame_tolerance(spark, d):
    """Each frame and the next one: quality, the place of the largest difference, and values beyond a tolerance."""
    frames = grey_frames(spark, d)
    found = metrics.frame_quality(metrics.compared(frames, frames.withColumn("t", F.col("t") - 1), cut=True), 40.0)
    return found.select("t", *[r6(c).alias(c) for c in ("psnr", "max_diff", "mean_diff")], F.col("place").cast("long").alias("place"), "n_over")
