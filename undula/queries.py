"""The registered queries of the signal operators, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from math import hypot

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import BABY, CPP, CUDA, PYTHON
from .functions import coeffs, color, stencils
from .operators import arrays, clips, metrics, recursive, spectral, tiles
from .operators import pixels as px
from .plans.magnify import magnify
from .shared import fresh
from .sources import frames as fr
from .streaming.recursive import iir_stream

FPS, LOW, HIGH = 30.0, 0.8333, 1.0
SMALL_GAUSSIAN, SMALL_LAPLACIAN = replace(CPP, levels=1), replace(BABY, levels=2)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def r6(v: Column | str) -> Column:
    return F.round(F.col(v) if isinstance(v, str) else v, 6) + 0.0


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def grey_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.frames_from_vectors(vectors(spark, sf_dir), "vec_id", "embedding", 8, 8, 1)


def rgb_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.frames_from_vectors(vectors(spark, sf_dir), "vec_id", "embedding", 4, 4, 3)


def grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.to_pixels(grey_frames(spark, sf_dir), channels=False)


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.to_pixels(rgb_frames(spark, sf_dir))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a pixel: t, y, x, r, g, b."""
    flat = rgb_frames(spark, sf_dir).select("t", F.posexplode(color.flat_to_struct(F.col("data"))).alias("i", "p"))
    return flat.select("t", F.expr("i div 4").cast("int").alias("y"), F.expr("i % 4").cast("int").alias("x"), F.col("p.r").alias("r"), F.col("p.g").alias("g"), F.col("p.b").alias("b"))


# --- SQL parts -------------------------------------------------------------------------------------

GREY = "px AS (SELECT vec_id::INT AS t, (i // 8)::INT AS y, (i % 8)::INT AS x, 127.5 * (1 + embedding[i + 1]::DOUBLE) AS v FROM embeddings, range(64) r(i))"
RGB = "px AS (SELECT vec_id::INT AS t, (i // 12)::INT AS y, ((i % 12) // 3)::INT AS x, (i % 3)::INT AS ch, 127.5 * (1 + embedding[i + 1]::DOUBLE) AS v FROM embeddings, range(48) r(i))"
TRIPLES = RGB + ", tri AS (SELECT t, y, x, max(v) FILTER (ch = 0) AS r, max(v) FILTER (ch = 1) AS g, max(v) FILTER (ch = 2) AS b FROM px GROUP BY ALL)"
TAPS = "taps(d, k) AS (VALUES (-2, 0.0625::DOUBLE), (-1, 0.25), (0, 0.375), (1, 0.25), (2, 0.0625))"


def sql_mirror(j: str, n: int, border: str = "reflect101") -> str:
    if border == "reflect101":
        return f"CASE WHEN {j} < 0 THEN -({j}) WHEN {j} >= {n} THEN {2 * (n - 1)} - ({j}) ELSE {j} END"
    return f"CASE WHEN {j} < 0 THEN -({j}) - 1 WHEN {j} >= {n} THEN {2 * n - 1} - ({j}) ELSE {j} END"


def sql_down(name: str, n: int, size: int, step: int, border: str = "reflect101") -> str:
    return f"{name} AS (SELECT o::INT AS o, {sql_mirror(f'{step} * o + d', n, border)} AS i, sum(k) AS w FROM range({size}) r(o), taps GROUP BY ALL)"


def sql_up(name: str, n: int, size: int, border: str = "reflect101") -> str:
    return f"{name} AS (SELECT o::INT AS o, j // 2 AS i, sum(2 * k) AS w FROM (SELECT o, {sql_mirror('o + d', size, border)} AS j, k FROM range({size}) r(o), taps) WHERE j % 2 = 0 AND j // 2 < {n} GROUP BY ALL)"


def sql_apply(name: str, source: str, matrix: str, extra: str = "") -> str:
    """The matrix along both axes of a square raster; extra: further key columns."""
    key = f"t, {extra}" if extra else "t, "
    return f"{name} AS (SELECT {key} a.o AS y, b.o AS x, sum(v * a.w * b.w) AS v FROM {source} JOIN {matrix} a ON a.i = y JOIN {matrix} b ON b.i = x GROUP BY ALL)"


def sql_of(*parts: str, select: str) -> str:
    return f"WITH RECURSIVE {', '.join(parts)} {select}"


V = "SELECT t, y, x, round(v, 6) + 0.0 AS v FROM "
BLUR2 = [TAPS, sql_down("d8", 8, 4, 2), sql_down("d4", 4, 2, 2), sql_up("u2", 2, 4), sql_up("u4", 4, 8), sql_apply("g1", "px", "d8"), sql_apply("g2", "g1", "d4"), sql_apply("e1", "g2", "u2"), sql_apply("e0", "e1", "u4")]


def out(df: DataFrame) -> DataFrame:
    return df.select("t", "y", "x", r6("v").alias("v"))


# --- scans and projections -------------------------------------------------------------------------


@query(sql_of(GREY, select=V + "px"))
def frame_scan(spark, d):
    return out(grey(spark, d))


@query(sql_of(GREY, select="SELECT t, y, x, round(v / 255, 6) + 0.0 AS v FROM px"))
def scale_255_to_1(spark, d):
    return out(grey(spark, d).withColumn("v", color.scale_down(F.col("v"))))


@query(sql_of(GREY, select="SELECT t, y, x, round(v / 255 * 255, 6) + 0.0 AS v FROM px"))
def scale_1_to_255(spark, d):
    return out(grey(spark, d).withColumn("v", color.scale_up(color.scale_down(F.col("v")))))


@query(sql_of(RGB, select="SELECT t, y, x, (2 - ch)::INT AS ch, round(v, 6) + 0.0 AS v FROM px"))
def bgr_to_rgb(spark, d):
    return fr.to_pixels(rgb_frames(spark, d), channel_order="bgr").select("t", "y", "x", "ch", r6("v").alias("v"))


def _dot_sql(row, names) -> str:
    return " + ".join(f"({w!r}::DOUBLE) * {n}" for w, n in zip(row, names, strict=True))


@query(sql_of(TRIPLES, select=f"SELECT t, y, x, round({_dot_sql(color.YIQ[0], 'rgb')}, 6) + 0.0 AS c0, round({_dot_sql(color.YIQ[1], 'rgb')}, 6) + 0.0 AS c1, round({_dot_sql(color.YIQ[2], 'rgb')}, 6) + 0.0 AS c2 FROM tri"))
def rgb_to_yiq(spark, d):
    made = color.rgb_to_yiq(F.col("r"), F.col("g"), F.col("b"))
    return triples(spark, d).select("t", "y", "x", *[r6(c).alias(f"c{k}") for k, c in enumerate(made)])


def _sql_back(kind: str, wrap: str) -> str:
    inner = f"SELECT t, y, x, {_dot_sql(color.YIQ[0], 'rgb')} AS c0, {_dot_sql(color.YIQ[1], 'rgb')} AS c1, {_dot_sql(color.YIQ[2], 'rgb')} AS c2 FROM tri"
    cells = ", ".join(f"round({wrap.format(_dot_sql(row, ('c0', 'c1', 'c2')))}, 6) + 0.0 AS {n}" for row, n in zip(color.inverse(kind), "rgb", strict=True))
    return sql_of(TRIPLES, select=f"SELECT t, y, x, {cells} FROM ({inner})")


def _back(spark, d, kind: str, scale: float = 1.0) -> list[Column]:
    yiq = color.rgb_to_yiq(F.col("r") / scale, F.col("g") / scale, F.col("b") / scale)
    return color.yiq_to_rgb(*yiq, kind)


@query(_sql_back("exact", "{}"))
def yiq_to_rgb(spark, d):
    return triples(spark, d).select("t", "y", "x", *[r6(c).alias(n) for c, n in zip(_back(spark, d, "exact"), "rgb", strict=True)])


@query(_sql_back("constants", "least(greatest(({}) / 200, 0), 1)"))
def yiq_to_rgb_clamped(spark, d):
    return triples(spark, d).select("t", "y", "x", *[r6(color.clamp(c / 200, 0.0, 1.0)).alias(n) for c, n in zip(_back(spark, d, "constants"), "rgb", strict=True)])


@query(_sql_back("constants", "{}"))
def yiq_to_rgb_constants(spark, d):
    return triples(spark, d).select("t", "y", "x", *[r6(c).alias(n) for c, n in zip(_back(spark, d, "constants"), "rgb", strict=True)])


@query(sql_of(TRIPLES, select="SELECT t, y, x, round(r, 6) + 0.0 AS r, round(g, 6) + 0.0 AS g, round(b, 6) + 0.0 AS b FROM tri"))
def flat_to_struct(spark, d):
    return triples(spark, d).select("t", "y", "x", *[r6(c).alias(c) for c in "rgb"])


@query(sql_of(RGB, select="SELECT t, (y * 12 + x * 3 + ch)::INT AS i, round(v, 6) + 0.0 AS v FROM px"))
def struct_to_flat(spark, d):
    flat = rgb_frames(spark, d).select("t", color.struct_to_flat(color.flat_to_struct(F.col("data"))).alias("data"))
    return flat.select("t", F.posexplode("data").alias("i", "v")).select("t", "i", r6("v").alias("v"))


# --- stencils and pyramids --------------------------------------------------------------------------


@query(sql_of(GREY, TAPS, sql_down("m", 8, 8, 1), sql_apply("o1", "px", "m"), select=V + "o1"))
def stencil_reflect101(spark, d):
    return out(px.blur(spark, px.by_frame(grey(spark, d)), 8, 8))


@query(sql_of(GREY, TAPS, sql_down("m", 8, 8, 1, "reflect"), sql_apply("o1", "px", "m"), select=V + "o1"))
def stencil_reflect(spark, d):
    return out(px.blur(spark, px.by_frame(grey(spark, d)), 8, 8, "reflect"))


def _cut(spark, d, n: int) -> DataFrame:
    """The top left n x n of the grey frames, for odd sizes."""
    return grey(spark, d).where((F.col("y") < n) & (F.col("x") < n))


GREY7 = GREY.replace("px AS", "all8 AS") + ", px AS (SELECT * FROM all8 WHERE y < 7 AND x < 7)"


@query(sql_of(GREY7, TAPS, sql_down("m", 7, 4, 2), sql_apply("o1", "px", "m"), select=V + "o1"))
def pyr_down_ceil(spark, d):
    return out(px.pyr_down(spark, px.by_frame(_cut(spark, d, 7)), 7, 7))


@query(sql_of(GREY7, TAPS, sql_down("m", 7, 3, 2), sql_apply("o1", "px", "m"), select=V + "o1"))
def pyr_down_floor(spark, d):
    return out(px.pyr_down(spark, px.by_frame(_cut(spark, d, 7)), 7, 7, "floor"))


@query(sql_of(GREY, TAPS, sql_up("m", 8, 16), sql_apply("o1", "px", "m"), select=V + "o1"))
def pyr_up(spark, d):
    return out(px.pyr_up(spark, px.by_frame(grey(spark, d)), 8, 8))


@query(sql_of(GREY, TAPS, sql_up("m", 8, 15), sql_apply("o1", "px", "m"), select=V + "o1"))
def pyr_up_odd(spark, d):
    return out(px.pyr_up(spark, px.by_frame(grey(spark, d)), 8, 8, (15, 15)))


@query(sql_of(GREY, TAPS, sql_up("m", 8, 16, "reflect"), sql_apply("o1", "px", "m"), select=V + "o1"))
def pyr_up_reflect(spark, d):
    return out(px.pyr_up(spark, px.by_frame(grey(spark, d)), 8, 8, border="reflect"))


@query(sql_of(GREY, TAPS, sql_down("m", 8, 4, 2, "reflect"), sql_apply("o1", "px", "m"), select=V + "o1"))
def pyr_down_reflect(spark, d):
    return out(px.pyr_down(spark, px.by_frame(grey(spark, d)), 8, 8, border="reflect"))


@query(sql_of(GREY7, TAPS, sql_down("m", 7, 3, 2, "reflect"), sql_apply("o1", "px", "m"), select=V + "o1"))
def pyr_down_reflect_floor(spark, d):
    return out(px.pyr_down(spark, px.by_frame(_cut(spark, d, 7)), 7, 7, "floor", "reflect"))


@query(sql_of(GREY, TAPS, *[f(*a, "reflect") for f, a in ((sql_down, ("d8", 8, 4, 2)), (sql_down, ("d4", 4, 2, 2)), (sql_up, ("u2", 2, 4)), (sql_up, ("u4", 4, 8)))], sql_apply("g1", "px", "d8"), sql_apply("g2", "g1", "d4"), sql_apply("e1", "g2", "u2"), sql_apply("e0", "e1", "u4"), select=V + "e0"))
def gaussian_frames_reflect(spark, d):
    return out(fr.to_pixels(arrays.gaussian_frames(grey_frames(spark, d), 2, "reflect", "floor"), channels=False))


@query(sql_of(GREY, *BLUR2, select=V + "e0"))
def gaussian_blur_l2(spark, d):
    return out(px.gaussian_blur(spark, px.by_frame(grey(spark, d)), 8, 8, 2))


@query(sql_of(GREY, *BLUR2, select=V + "e0"))
def gaussian_frames_l2(spark, d):
    """The same blur in the array tier: frame-local, no exchange."""
    made = arrays.gaussian_frames(grey_frames(spark, d), 2)
    return out(fr.to_pixels(made, channels=False))


def _sql_levels(residual: bool, border: str = "reflect101") -> str:
    parts = [GREY, TAPS, sql_down("d8", 8, 4, 2, border), sql_down("d4", 4, 2, 2, border), sql_up("u2", 2, 4, border), sql_up("u4", 4, 8, border), sql_apply("g1", "px", "d8"), sql_apply("g2", "g1", "d4"), sql_apply("e1", "g2", "u2"), sql_apply("e0", "g1", "u4")]
    select = "SELECT 0 AS level, t, y, x, round(px.v - e0.v, 6) + 0.0 AS v FROM px JOIN e0 USING (t, y, x) UNION ALL SELECT 1, t, y, x, round(g1.v - e1.v, 6) + 0.0 FROM g1 JOIN e1 USING (t, y, x)"
    return sql_of(*parts, select=select + (" UNION ALL SELECT 2, t, y, x, round(v, 6) + 0.0 FROM g2" if residual else ""))


@query(_sql_levels(False))
def laplacian_levels(spark, d):
    return px.laplacian(spark, grey(spark, d), 8, 8, 2).select("level", "t", "y", "x", r6("v").alias("v"))


@query(_sql_levels(True, "reflect"))
def laplacian_levels_reflect(spark, d):
    made = arrays.laplacian_frames(grey_frames(spark, d), 2, True, "reflect")
    rows = made.select("level", "t", "w", F.posexplode("data").alias("i", "v"))
    return rows.select("level", "t", F.expr("i div w").cast("int").alias("y"), F.expr("i % w").cast("int").alias("x"), r6("v").alias("v"))


@query(_sql_levels(True))
def laplacian_levels_residual(spark, d):
    made = arrays.laplacian_frames(grey_frames(spark, d), 2, True)
    rows = made.select("level", "t", "w", F.posexplode("data").alias("i", "v"))
    return rows.select("level", "t", F.expr("i div w").cast("int").alias("y"), F.expr("i % w").cast("int").alias("x"), r6("v").alias("v"))


# --- layout ----------------------------------------------------------------------------------------


@query(sql_of(GREY, select="SELECT y, x, len(data)::INT AS n, round(data[1], 6) + 0.0 AS first_v, round(data[len(data)], 6) + 0.0 AS last_v, round(list_sum(list_transform(range(1, len(data) + 1), lambda i: data[i] * (i % 7))), 4) + 0.0 AS checksum FROM (SELECT y, x, list(v ORDER BY t) AS data FROM px GROUP BY ALL)"))
def frame_to_pixel(spark, d):
    check = F.expr("aggregate(transform(data, (v, i) -> v * ((i + 1) % 7)), 0D, (a, v) -> a + v)")
    return px.to_series(grey(spark, d)).select("y", "x", F.size("data").alias("n"), r6(F.col("data")[0]).alias("first_v"), r6(F.element_at("data", -1)).alias("last_v"), (F.round(check, 4) + 0.0).alias("checksum"))


@query(sql_of(GREY, select=V + "px"))
def pixel_to_frame(spark, d):
    return out(px.from_series(px.to_series(grey(spark, d))))


# --- frequency domain ------------------------------------------------------------------------------

SQL_BINS = "n AS (SELECT count(*) AS n FROM embeddings), bins AS (SELECT k::INT AS k, CASE WHEN k < (n + 1) // 2 THEN k ELSE k - n END * 30.0::DOUBLE / n AS hz FROM n, range((SELECT n FROM n)) r(k))"
SQL_SYMMETRIC = f"kept AS (SELECT k, CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END AS w FROM bins, n WHERE k <= n // 2 AND abs(hz) BETWEEN {LOW} AND {HIGH})"
SQL_ONESIDED = f"kept AS (SELECT k, 1 AS w FROM bins WHERE k >= (SELECT arg_min(k, (abs(hz - {LOW}), k)) FROM bins) AND k < (SELECT arg_min(k, (abs(hz - {HIGH}), k)) FROM bins))"


def _count(spark, d) -> int:
    return vectors(spark, d).count()


def _sql_bandpass(kept: str, source: str = GREY, key: str = "y, x") -> list[str]:
    return [
        source, SQL_BINS, kept,
        f"coef AS (SELECT {key}, k, w, sum(v * cos(2 * pi() * k * t / n)) AS a, sum(v * sin(2 * pi() * k * t / n)) AS b FROM px, kept, n GROUP BY ALL)",
        f"band AS (SELECT t, {key}, sum(w / n * (a * cos(2 * pi() * k * t / n) + b * sin(2 * pi() * k * t / n))) AS v FROM (SELECT vec_id::INT AS t FROM embeddings), coef, n GROUP BY ALL)",
    ]


#: Values in a group of the long-series queries: a series of a few hundred frames already goes the four steps.
SMALL_GROUP = 1 << 10


@query(sql_of(*_sql_bandpass(SQL_SYMMETRIC), select=V + "band"))
def ideal_bandpass_symmetric(spark, d):
    """Transformed in four steps, as a series is that no group can hold."""
    return _untiled(spectral.ideal_bandpass(_series(spark, d), FPS, LOW, HIGH, group=SMALL_GROUP))


@query(sql_of(*_sql_bandpass(SQL_ONESIDED), select=V + "band"))
def ideal_bandpass_onesided(spark, d):
    return _untiled(spectral.ideal_bandpass(_series(spark, d), FPS, LOW, HIGH, "onesided", group=SMALL_GROUP))


def _series(spark, d, width: int = tiles.TILE) -> DataFrame:
    return tiles.tiles(grey_frames(spark, d).select("video_id", F.lit(0).alias("level"), "t", "data"), width)


def _untiled(series: DataFrame) -> DataFrame:
    rows = series.select("t", "tile", F.posexplode("data").alias("i", "v")).withColumn("i", F.col("i") + F.col("tile"))
    return rows.select("t", F.expr("i div 8").cast("int").alias("y"), F.expr("i % 8").cast("int").alias("x"), r6("v").alias("v"))


@query(sql_of(*_sql_bandpass(SQL_SYMMETRIC), select=V + "band"))
def ideal_bandpass_tiles(spark, d):
    """The array tier's filter over tiles."""
    return _untiled(spectral.ideal_bandpass(_series(spark, d), FPS, LOW, HIGH))


# --- recursive filters -----------------------------------------------------------------------------

def _sql_first(name: str, hz: float, kind: str = "butterworth") -> str:
    if kind == "halved":
        return f"{name} AS (SELECT k / (1 + k) AS b0, -(1 - k / (1 + k)) AS a1 FROM (SELECT tan(pi() * {hz} / 30) AS k))"
    return f"{name} AS (SELECT tan(pi() * {hz} / 30) / (1 + tan(pi() * {hz} / 30)) AS b0, (tan(pi() * {hz} / 30) - 1) / (tan(pi() * {hz} / 30) + 1) AS a1)"


SQL_IIR = [GREY, _sql_first("lo", LOW), _sql_first("hi", HIGH), "run(t, y, x, v, slow, fast) AS (SELECT t, y, x, v, v, v FROM px WHERE t = 0 UNION ALL SELECT p.t, p.y, p.x, p.v, lo.b0 * (p.v + run.v) - lo.a1 * slow, hi.b0 * (p.v + run.v) - hi.a1 * fast FROM run JOIN px p ON p.t = run.t + 1 AND p.y = run.y AND p.x = run.x, lo, hi)"]


@query(sql_of(*SQL_IIR, select="SELECT t, y, x, round(slow, 6) + 0.0 AS v FROM run"))
def iir_lowpass(spark, d):
    return _untiled(recursive.iir_lowpass(_series(spark, d), FPS, LOW))


@query(sql_of(*SQL_IIR, select="SELECT t, y, x, round(CASE WHEN t = 0 THEN v ELSE fast - slow END, 6) + 0.0 AS v FROM run"))
def iir_bandpass(spark, d):
    return _untiled(recursive.iir_bandpass(_series(spark, d), FPS, LOW, HIGH))


@query(sql_of(SQL_IIR[0], _sql_first("lo", LOW, "halved"), _sql_first("hi", HIGH, "halved"), SQL_IIR[3], select="SELECT t, y, x, round(CASE WHEN t = 0 THEN v ELSE fast - slow END, 6) + 0.0 AS v FROM run"))
def iir_bandpass_halved(spark, d):
    return _untiled(recursive.iir_bandpass(_series(spark, d), FPS, LOW, HIGH, kind="halved"))


@query(sql_of(*SQL_IIR, select="SELECT t, y, x, round(CASE WHEN t = 0 THEN 0 ELSE fast - slow END, 6) + 0.0 AS v FROM run"))
def iir_bandpass_zero_first(spark, d):
    return _untiled(recursive.iir_bandpass(_series(spark, d), FPS, LOW, HIGH, first_frame="zero"))


@query(sql_of(*SQL_IIR, select="SELECT t, y, x, round(CASE WHEN t = 0 THEN v ELSE fast - slow END, 6) + 0.0 AS v FROM run"))
def iir_stream_batches(spark, d):
    """The stateful stream over files of frames, one micro-batch a file, as its rows come out."""
    folder = fresh(spark, "stream")
    series = _series(spark, d)
    n = _count(spark, d)
    for k in range(4):
        series.where((F.col("t") >= k * n // 4) & (F.col("t") < (k + 1) * n // 4)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(series.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    made = iir_stream(stream, FPS, LOW, HIGH)
    run = made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return _untiled(spark.read.parquet(f"{folder}/out"))


@query(sql_of(*_sql_bandpass(SQL_ONESIDED, RGB, "y, x, ch"), select="SELECT t, y, x, ch, round(v * CASE WHEN ch = 0 THEN 100 ELSE 50 END, 6) + 0.0 AS v FROM band"))
def gaussian_filter_attenuated(spark, d):
    """One-sided band, gain 100, chroma at half of it."""
    series = tiles.tiles(rgb_frames(spark, d).select("video_id", F.lit(0).alias("level"), "t", "data"))
    band = spectral.ideal_bandpass(series, FPS, LOW, HIGH, "onesided", group=SMALL_GROUP)
    rows = band.select("t", "tile", F.posexplode("data").alias("i", "v")).withColumn("i", F.col("i") + F.col("tile"))
    gained = rows.withColumn("v", F.col("v") * F.when(F.col("i") % 3 == 0, 100.0).otherwise(50.0))
    return gained.select("t", F.expr("i div 12").cast("int").alias("y"), F.expr("(i % 12) div 3").cast("int").alias("x"), F.expr("i % 3").cast("int").alias("ch"), r6("v").alias("v"))


# --- gains and reconstruction ----------------------------------------------------------------------


@query(sql_of(RGB, select="SELECT t, y, x, ch, round(v * CASE WHEN ch = 0 THEN 50 ELSE 5 END, 6) + 0.0 AS v FROM px"))
def amplify_chroma(spark, d):
    gain = F.when(F.col("ch") == 0, F.lit(50.0)).otherwise(F.lit(50.0 * 0.1))
    return rgb(spark, d).select("t", "y", "x", "ch", r6(F.col("v") * gain).alias("v"))


def _recon(spark, d, rounding: str, how: str = "inner", keep: Column | None = None) -> DataFrame:
    """Each frame with the next one's half-weight change as its signal, in YIQ."""
    now = triples(spark, d)
    signal = now.select((F.col("t") - 1).alias("t"), "y", "x", *[(0.5 * (c)).alias(f"s{k}") for k, c in enumerate(color.rgb_to_yiq(F.col("r"), F.col("g"), F.col("b")))])
    if keep is not None:
        signal = signal.where(keep)
    both = now.join(signal, ["t", "y", "x"], how)
    yiq = [c + F.coalesce(F.col(f"s{k}"), F.lit(0.0)) for k, c in enumerate(color.rgb_to_yiq(F.col("r"), F.col("g"), F.col("b")))]
    made = color.yiq_to_rgb(*yiq)
    return both.select("t", "y", "x", *[color.to_u8(F.round(c, 6), rounding).alias(n) for c, n in zip(made, "rgb", strict=True)])


def _sql_recon(rounding: str, join: str = "JOIN", where: str = "") -> str:
    f = "round_even({}, 0)" if rounding == "rint" else "floor({})"
    yiq = ", ".join(f"{_dot_sql(row, 'rgb')} AS c{k}" for k, row in enumerate(color.YIQ))
    cells = ", ".join(f"{f.format(f'least(greatest(round({_dot_sql(row, ("z0", "z1", "z2"))}, 6), 0), 255)')}::INT AS {n}" for row, n in zip(color.inverse(), "rgb", strict=True))
    return sql_of(
        TRIPLES, f"yiq AS (SELECT t, y, x, {yiq} FROM tri)", f"sig AS (SELECT t - 1 AS t, y, x, 0.5 * c0 AS s0, 0.5 * c1 AS s1, 0.5 * c2 AS s2 FROM yiq {where})",
        f"z AS (SELECT t, y, x, c0 + coalesce(s0, 0) AS z0, c1 + coalesce(s1, 0) AS z1, c2 + coalesce(s2, 0) AS z2 FROM yiq {join} sig USING (t, y, x))",
        select=f"SELECT t, y, x, {cells} FROM z",
    )


@query(_sql_recon("rint"))
def recon_gaussian_u8_round(spark, d):
    return _recon(spark, d, "rint")


@query(_sql_recon("floor"))
def recon_gaussian_u8_trunc(spark, d):
    return _recon(spark, d, "truncate")


@query(_sql_recon("rint", "LEFT JOIN", "WHERE (t - 1) % 3 <> 0"))
def recon_left_fallback(spark, d):
    """Frames without a signal come out as they were."""
    return _recon(spark, d, "rint", "left", F.col("t") % 3 != 0)


@query(sql_of(GREY, TAPS, sql_down("d8", 8, 4, 2), sql_down("d4", 4, 2, 2), sql_up("u2", 2, 4), sql_up("u4", 4, 8), sql_apply("g1", "px", "d8"), sql_apply("g2", "g1", "d4"), sql_apply("e1", "g2", "u2"), "l1 AS (SELECT t, y, x, g1.v - e1.v AS v FROM g1 JOIN e1 USING (t, y, x))", sql_apply("f1", "l1", "u4"), select="SELECT t, y, x, round(least(greatest(px.v + 3 * f1.v, 0), 255), 6) + 0.0 AS v FROM px JOIN f1 USING (t, y, x)"))
def recon_laplacian(spark, d):
    """Band 1, tripled, grown back and added to the frame."""
    bands = px.laplacian(spark, grey(spark, d), 8, 8, 2).where("level = 1").drop("level")
    grown = px.pyr_up(spark, bands, 4, 4, (8, 8)).withColumnRenamed("v", "s")
    both = grey(spark, d).join(grown, ["video_id", "t", "y", "x"])
    return out(both.withColumn("v", color.clamp(F.col("v") + 3 * F.col("s"), 0.0, 255.0)))


# --- metrics ---------------------------------------------------------------------------------------

KEY = ["t", "y", "x", "ch"]
PAIR = RGB + ", pair AS (SELECT a.t, a.y, a.x, a.ch, a.v, b.v AS other FROM px a JOIN px b ON b.t = a.t + 1 AND a.y = b.y AND a.x = b.x AND a.ch = b.ch)"
PSNR = PAIR + ", mse AS (SELECT t, avg((v - other) * (v - other)) AS m FROM pair GROUP BY t), q AS (SELECT t, CASE WHEN m = 0 THEN 100 ELSE 20 * log10(255 / sqrt(m)) END AS psnr FROM mse)"


def _pair(spark, d) -> DataFrame:
    """Each frame with the next one."""
    clip = rgb(spark, d).drop("video_id")
    return metrics.aligned(clip, clip.withColumn("t", F.col("t") - 1), KEY)


def _psnr(spark, d) -> DataFrame:
    return metrics.psnr_per_frame(_pair(spark, d))


@query(sql_of(PSNR, select="SELECT t, round(psnr, 6) AS psnr FROM q"))
def psnr_per_frame(spark, d):
    return _psnr(spark, d).select("t", r6("psnr").alias("psnr"))


@query(sql_of(PSNR, select="SELECT round(avg(psnr), 6) AS mean_psnr, round(min(psnr), 6) AS min_psnr, round(max(psnr), 6) AS max_psnr, round(stddev_pop(psnr), 6) AS sd_psnr, arg_min(t, (psnr, t)) AS worst_t, count(*) AS n FROM q"))
def psnr_summary(spark, d):
    s = metrics.psnr_summary(_psnr(spark, d))
    return s.select(*[r6(c).alias(c) for c in ("mean_psnr", "min_psnr", "max_psnr", "sd_psnr")], "worst_t", "n")


@query(sql_of(PSNR, select="SELECT t, round(psnr, 6) AS psnr FROM q ORDER BY q.psnr, t LIMIT 10"))
def psnr_lowest10(spark, d):
    return metrics.lowest(_psnr(spark, d)).select("t", r6("psnr").alias("psnr"))


@query(sql_of(PSNR, select="SELECT t, round(s, 6) AS smooth FROM (SELECT t, avg(psnr) OVER w AS s, count(*) OVER w AS n FROM q WINDOW w AS (ORDER BY t ROWS 9 PRECEDING)) WHERE n = 10"))
def psnr_moving_avg10(spark, d):
    return metrics.moving_average(_psnr(spark, d)).select("t", r6("smooth").alias("smooth"))


@query(sql_of(PSNR, select="SELECT least(floor((psnr - lo) / (hi - lo) * 50), 49)::INT AS bin, count(*) AS n FROM q, (SELECT min(psnr) AS lo, max(psnr) AS hi FROM q) GROUP BY 1"))
def psnr_hist50(spark, d):
    return metrics.histogram(_psnr(spark, d))


@query(sql_of(PSNR, select="SELECT threshold, count(*) FILTER (psnr < threshold) AS n_below FROM q, (VALUES (25.0::DOUBLE), (30.0), (35.0)) h(threshold) GROUP BY 1"))
def psnr_thresholds(spark, d):
    return metrics.thresholds(_psnr(spark, d))


@query(sql_of(PSNR, select="SELECT t, round(t / 30.0::DOUBLE, 6) AS seconds, round(psnr, 6) AS psnr FROM q"))
def psnr_over_time(spark, d):
    return _psnr(spark, d).select("t", r6(F.col("t") / FPS).alias("seconds"), r6("psnr").alias("psnr"))


@query(sql_of(PAIR, select="SELECT t, round(max(abs(v - other)), 6) AS max_diff, round(avg(abs(v - other)), 6) AS mean_diff FROM pair GROUP BY t"))
def diff_stats(spark, d):
    return metrics.diff_stats(_pair(spark, d)).select("t", r6("max_diff").alias("max_diff"), r6("mean_diff").alias("mean_diff"))


@query(sql_of(PAIR, select="SELECT t, round((2 * avg(v) * avg(other) + 6.5025) * (2 * covar_pop(v, other) + 58.5225) / ((avg(v) * avg(v) + avg(other) * avg(other) + 6.5025) * (var_pop(v) + var_pop(other) + 58.5225)), 6) + 0.0 AS ssim FROM pair GROUP BY t"))
def ssim_per_frame(spark, d):
    return metrics.ssim(_pair(spark, d)).select("t", r6("ssim").alias("ssim"))


@query(sql_of(PAIR, select="SELECT t, y, x, ch, round(abs(v - other), 6) AS diff FROM pair ORDER BY abs(v - other) DESC, t, y, x, ch LIMIT 1"))
def max_diff_location(spark, d):
    return metrics.max_diff_location(_pair(spark, d), KEY).select(*KEY, r6("diff").alias("diff"))


@query("SELECT round(avg(value), 6) AS mean_v, round(stddev_pop(value), 6) AS sd_v, round(100 * stddev_pop(value) / avg(value), 6) AS cv_pct, min(value) AS min_v, max(value) AS max_v FROM events WHERE event_id >= 10")
def bench_stats(spark, d):
    """Statistics of measured values, the first ten left out as warm-up."""
    runs = spark.read.parquet(f"{d}/events.parquet").where("event_id >= 10")
    s = metrics.bench_stats(runs, "value")
    return s.select(*[r6(c).alias(c) for c in ("mean_v", "sd_v", "cv_pct")], "min_v", "max_v")


@query("SELECT user_id, hour::INT AS hour, round(avg(s), 6) AS value FROM (SELECT user_id, date_diff('hour', min(ts) OVER (), ts) AS hour, value AS s FROM events) GROUP BY ALL")
def event_series(spark, d):
    """A second clock: hourly means for each user."""
    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "value")
    start = F.broadcast(events.agg(F.min("ts").alias("start")))  # one row
    hour = F.floor(F.unix_timestamp(F.date_trunc("hour", "ts")) / 3600) - F.floor(F.unix_timestamp(F.date_trunc("hour", "start")) / 3600)
    return events.join(start).groupBy("user_id", hour.cast("int").alias("hour")).agg(r6(F.avg("value")).alias("value"))


# --- whole pipelines -------------------------------------------------------------------------------


def _values(frames: DataFrame) -> DataFrame:
    rows = frames.select("t", F.posexplode("data").alias("i", "v"))
    return rows.select("t", F.expr("i div 12").cast("int").alias("y"), F.expr("(i % 12) div 3").cast("int").alias("x"), F.expr("i % 3").cast("int").alias("ch"), F.col("v").cast("int").alias("v"))


def _sql_pipeline(kind: str, border: str = "reflect101", kept: str = SQL_SYMMETRIC, gain_of_chroma: float = 1.0, alpha: float = 50.0, inverse: str = "exact", rounding: str = "rint") -> str:
    yiq = " UNION ALL ".join(f"SELECT t, y, x, {k} AS ch, {_dot_sql(row, 'rgb')} AS v FROM tri" for k, row in enumerate(color.YIQ))
    base = [TRIPLES.replace("px AS", "rgb AS", 1).replace("FROM px", "FROM rgb"), f"yiq AS ({yiq})", TAPS, sql_down("d4", 4, 2, 2, border), sql_up("u2", 2, 4, border)]
    if kind == "gaussian":
        parts = [*base, sql_apply("px", "yiq", "d4", "ch, "), *_sql_bandpass(kept, "one AS (SELECT 1)", "y, x, ch"), f"gained AS (SELECT t, y, x, ch, v * CASE WHEN ch = 0 THEN {alpha!r}::DOUBLE ELSE {alpha * gain_of_chroma!r}::DOUBLE END AS v FROM band)", sql_apply("sig", "gained", "u2", "ch, ")]
    elif kind == "outer":  # level 0 as it is, level 1 with its gain, no residual
        delta = CUDA.lambda_cutoff / (8 * (1 + BABY.alpha))
        gain = min(BABY.alpha, hypot(2, 2) / (8 * delta) - 1)
        parts = [
            *base, sql_down("d2", 2, 1, 2, border), "u1 AS (SELECT o::INT AS o, 0 AS i, sum(2 * k) AS w FROM (SELECT o, CASE WHEN o + d < 0 THEN -(o + d) - 1 WHEN o + d >= 2 THEN 3 - (o + d) ELSE o + d END AS j, k FROM range(2) r(o), taps) WHERE j = 0 GROUP BY ALL)",
            sql_apply("g1", "yiq", "d4", "ch, "), sql_apply("g2", "g1", "d2", "ch, "), sql_apply("e0", "g1", "u2", "ch, "), sql_apply("e1", "g2", "u1", "ch, "),
            "px AS (SELECT 0 AS level, t, y, x, ch, yiq.v - e0.v AS v FROM yiq JOIN e0 USING (t, y, x, ch) UNION ALL SELECT 1, t, y, x, ch, g1.v - e1.v FROM g1 JOIN e1 USING (t, y, x, ch))", _sql_first("lo", BABY.low_hz, "halved"), _sql_first("hi", BABY.high_hz, "halved"),
            "run(level, t, y, x, ch, v, slow, fast) AS (SELECT level, t, y, x, ch, v, v, v FROM px WHERE t = 0 UNION ALL SELECT p.level, p.t, p.y, p.x, p.ch, p.v, lo.b0 * (p.v + run.v) - lo.a1 * slow, hi.b0 * (p.v + run.v) - hi.a1 * fast FROM run JOIN px p ON p.level = run.level AND p.t = run.t + 1 AND p.y = run.y AND p.x = run.x AND p.ch = run.ch, lo, hi)",
            f"band AS (SELECT level, t, y, x, ch, CASE WHEN t = 0 THEN v ELSE (fast - slow) * CASE WHEN level = 0 THEN 1 WHEN ch = 0 THEN {gain!r}::DOUBLE ELSE {gain * BABY.attenuation!r}::DOUBLE END END AS v FROM run)",
            "b1 AS (SELECT t, y, x, ch, v FROM band WHERE level = 1)", sql_apply("f1", "b1", "u2", "ch, "), "sig AS (SELECT t, y, x, ch, sum(v) AS v FROM (SELECT t, y, x, ch, v FROM band WHERE level = 0 UNION ALL SELECT t, y, x, ch, v FROM f1) GROUP BY ALL)",
        ]
    else:
        low, high = BABY.low_hz, BABY.high_hz
        delta = BABY.lambda_cutoff / (8 * (1 + BABY.alpha))
        gain = min(BABY.alpha, hypot(2, 2) / (8 * delta) - 1)
        parts = [
            *base, sql_down("d2", 2, 1, 2).replace(sql_mirror("2 * o + d", 2), "(abs(2 * o + d) % 2)"), sql_up("u1", 1, 2).replace(sql_mirror("o + d", 2), "(abs(o + d) % 2)"),
            sql_apply("g1", "yiq", "d4", "ch, "), sql_apply("g2", "g1", "d2", "ch, "), sql_apply("e1", "g2", "u1", "ch, "),
            "px AS (SELECT 1 AS level, t, y, x, ch, g1.v - e1.v AS v FROM g1 JOIN e1 USING (t, y, x, ch) UNION ALL SELECT 2, t, y, x, ch, v FROM g2)", _sql_first("lo", low), _sql_first("hi", high),
            "run(level, t, y, x, ch, v, slow, fast) AS (SELECT level, t, y, x, ch, v, v, v FROM px WHERE t = 0 UNION ALL SELECT p.level, p.t, p.y, p.x, p.ch, p.v, lo.b0 * (p.v + run.v) - lo.a1 * slow, hi.b0 * (p.v + run.v) - hi.a1 * fast FROM run JOIN px p ON p.level = run.level AND p.t = run.t + 1 AND p.y = run.y AND p.x = run.x AND p.ch = run.ch, lo, hi)",
            f"band AS (SELECT level, t, y, x, ch, CASE WHEN t = 0 THEN v ELSE (fast - slow) * CASE WHEN level = 2 THEN 1 WHEN ch = 0 THEN {gain!r}::DOUBLE ELSE {gain * BABY.attenuation!r}::DOUBLE END END AS v FROM run)",
            "b2 AS (SELECT t, y, x, ch, v FROM band WHERE level = 2)", sql_apply("f2", "b2", "u1", "ch, "), "f1 AS (SELECT t, y, x, ch, v FROM band WHERE level = 1 UNION ALL SELECT t, y, x, ch, v FROM f2)", "s1 AS (SELECT t, y, x, ch, sum(v) AS v FROM f1 GROUP BY ALL)", sql_apply("sig", "s1", "u2", "ch, "),
        ]
    total = "z AS (SELECT t, y, x, max(yiq.v + coalesce(sig.v, 0)) FILTER (ch = 0) AS z0, max(yiq.v + coalesce(sig.v, 0)) FILTER (ch = 1) AS z1, max(yiq.v + coalesce(sig.v, 0)) FILTER (ch = 2) AS z2 FROM yiq LEFT JOIN sig USING (t, y, x, ch) GROUP BY ALL)"
    whole = "round_even({}, 0)" if rounding == "rint" else "floor({})"
    cells = " UNION ALL ".join(f"SELECT t, y, x, {k} AS ch, {whole.format(f'least(greatest({_dot_sql(row, ("z0", "z1", "z2"))}, 0), 255)')}::INT AS v FROM z" for k, row in enumerate(color.inverse(inverse)))
    return sql_of(*parts, total, select=cells)


@query(_sql_pipeline("gaussian"))
def magnify_gaussian(spark, d):
    return _values(magnify(rgb_frames(spark, d), SMALL_GAUSSIAN))


@query(_sql_pipeline("laplacian"))
def magnify_laplacian(spark, d):
    return _values(magnify(rgb_frames(spark, d), SMALL_LAPLACIAN))


SMALL_PYTHON = replace(PYTHON, levels=1, low_hz=LOW, attenuation=0.5)


@query(_sql_pipeline("gaussian", kept=SQL_ONESIDED, alpha=PYTHON.alpha, gain_of_chroma=0.5, rounding="truncate"))
def magnify_gaussian_python(spark, d):
    return _values(magnify(rgb_frames(spark, d), SMALL_PYTHON))


@query(_sql_pipeline("gaussian", border="reflect", inverse="constants"))
def magnify_gaussian_cuda(spark, d):
    return _values(magnify(rgb_frames(spark, d), replace(CUDA, levels=1, size_rule="floor")))


@query(_sql_pipeline("outer", border="reflect", inverse="constants"))
def magnify_laplacian_cuda(spark, d):
    return _values(magnify(rgb_frames(spark, d), replace(CUDA, mode="laplacian", levels=2, alpha=BABY.alpha, low_hz=BABY.low_hz, high_hz=BABY.high_hz, attenuation=BABY.attenuation)))


# --- files: written, and read again ----------------------------------------------------------------


SQL_U8 = sql_of(RGB, select="SELECT t, y, x, ch, floor(least(greatest(v, 0), 255))::INT AS v, {} AS fps FROM px")


def _u8_frames(spark, d) -> DataFrame:
    frames = rgb_frames(spark, d)
    return frames.withColumn("data", F.transform("data", lambda v: color.to_u8(v, "truncate").cast("double")))


def _read_back(frames: DataFrame) -> DataFrame:
    values = fr.to_pixels(frames).select("t", "y", "x", "ch", F.col("v").cast("int").alias("v"))
    return values.withColumn("fps", F.lit(frames.select(fr.effective_fps(F.col("fps")).alias("fps")).first().fps))


@query(SQL_U8.format("30.0::DOUBLE"))
def source_images(spark, d):
    folder = fresh(spark, "images")
    fr.write_images(_u8_frames(spark, d), folder)
    return _read_back(fr.read_frames(spark, folder))


@query(SQL_U8.format("25.0::DOUBLE"))
def source_avi(spark, d):
    path = fresh(spark, "clip") + ".avi"
    fr.write_avi(_u8_frames(spark, d), path, 25.0)
    return _read_back(fr.read_frames(spark, path))


@query(sql_of(RGB, select="SELECT t * 4 + y AS y, x, ch, v FROM px"))
def matrix_text(spark, d):
    """All frames under each other as one matrix of text."""
    path = fresh(spark, "matrix")
    fr.write_matrix(rgb(spark, d).select((F.col("t") * 4 + F.col("y")).alias("y"), "x", "ch", "v"), path)
    return fr.read_matrix(spark, path)


@query("SELECT (i - 1)::INT AS i, embedding[i]::DOUBLE AS v FROM (SELECT arg_min(embedding, vec_id) AS embedding FROM embeddings), range(1, 65) r(i)")
def vector_text(spark, d):
    path = fresh(spark, "vector")
    first = vectors(spark, d).orderBy("vec_id").limit(1)
    first.select(F.array_join(F.transform("embedding", lambda v: v.cast("double").cast("string")), ",").alias("value")).coalesce(1).write.text(path)
    return spark.createDataFrame(list(enumerate(fr.read_vector(spark, path))), "i int, v double")


@query(sql_of(PSNR, "s AS (SELECT t, max(abs(v - other)) AS a, avg(abs(v - other)) AS b, (2 * avg(v) * avg(other) + 6.5025) * (2 * covar_pop(v, other) + 58.5225) / ((avg(v) * avg(v) + avg(other) * avg(other) + 6.5025) * (var_pop(v) + var_pop(other) + 58.5225)) AS i FROM pair GROUP BY t)", select="SELECT t AS frame, round(psnr, 6) AS psnr, round(i, 6) + 0.0 AS ssim, round(a, 6) AS max_diff, round(b, 6) AS mean_diff FROM q JOIN s USING (t)"))
def metric_csv(spark, d):
    path = fresh(spark, "metrics")
    both = _pair(spark, d)
    rows = metrics.psnr_per_frame(both).join(metrics.diff_stats(both), "t").join(metrics.ssim(both), "t").select(F.col("t").alias("frame"), r6("psnr").alias("psnr"), r6("ssim").alias("ssim"), r6("max_diff").alias("max_diff"), r6("mean_diff").alias("mean_diff"))
    rows.write.csv(path, header=True)
    return fr.read_metrics(spark, path)


@query(sql_of(PSNR, select="SELECT printf('Frame %d: %.2f dB', t, psnr) AS line, count(*) AS n FROM (SELECT t, psnr FROM q UNION ALL (SELECT t, psnr FROM q ORDER BY q.psnr, t LIMIT 10)) GROUP BY 1"))
def psnr_report(spark, d):
    """The report's lines: each frame once, the ten lowest twice."""
    path = fresh(spark, "report")
    fr.write_report(_psnr(spark, d), path)
    return spark.read.text(path).where("value like 'Frame %'").groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))
