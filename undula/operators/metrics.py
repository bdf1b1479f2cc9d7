"""Frame quality and benchmark statistics: joins, aggregates and windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stencils
from . import clips

#: Consecutive frames in a task of a moving average.
RUN = 4096


def psnr(mse: Column) -> Column:
    """Decibels; equal frames are 100."""
    return F.when(mse == 0, F.lit(100.0)).otherwise(20 * F.log10(F.lit(255.0) / F.sqrt(mse)))


def aligned(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Values of two clips at the same place; the longer clip is cut by the inner join."""
    return a.join(b.withColumnRenamed("v", "other"), key)


def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])


def compared(a: DataFrame, b: DataFrame, cut: bool = False) -> DataFrame:
    """Rows (video_id, t, h, w, c, data, other) of the frames of two tables.  Frames of different sizes or
    channels, without all their values, or (unless `cut`, which leaves them out) in one table only, fail by
    their clip and t, in the job that reads the rows."""
    pairs = a.alias("a").join(b.alias("b"), F.col("a.video_id").eqNullSafe(F.col("b.video_id")) & (F.col("a.t") == F.col("b.t")), "inner" if cut else "full")
    clip, t = F.coalesce("a.video_id", "b.video_id"), F.coalesce("a.t", "b.t")
    fail = lambda why: F.raise_error(_said("clip ", clip, ", frame ", t, why)).cast("array<double>")
    shape = lambda s: F.struct(*[F.col(f"{s}.{c}") for c in ("h", "w", "c")])
    whole = lambda s: F.size(f"{s}.data") == F.col(f"{s}.h") * F.col(f"{s}.w") * F.col(f"{s}.c")
    other = F.when(F.col("a.t").isNull() | F.col("b.t").isNull(), fail(" is in one table only")).when(shape("a") != shape("b"), fail(": sizes differ")).when(whole("a") & whole("b"), F.col("b.data").cast("array<double>")).otherwise(fail(" lacks values"))
    return pairs.select(clip.alias("video_id"), t.alias("t"), *[F.col(f"a.{c}").alias(c) for c in ("h", "w", "c")], F.col("a.data").cast("array<double>").alias("data"), other.alias("other"))


def frame_quality(pairs: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Rows (video_id, t, psnr, max_diff, mean_diff, place, n_over) of compared frames: values are taken in whole
    arrays, so no pixel is a row.  place is the first of the largest difference, n_over how many values
    differ by more than the tolerance."""
    d = F.zip_with("data", "other", lambda x, y: F.abs(x - y))
    n = F.size("d")
    total = lambda f: F.aggregate("d", F.lit(0.0), lambda s, x: s + f(x)) / n
    found = pairs.select("video_id", "t", d.alias("d"))
    most = F.array_max("d")
    return found.select("video_id", "t", psnr(total(lambda x: x * x)).alias("psnr"), most.alias("max_diff"), total(lambda x: x).alias("mean_diff"), (F.array_position("d", most) - 1).alias("place"), F.size(F.filter("d", lambda x: x > tolerance)).cast("long").alias("n_over"))


def assert_close(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """The rows of frame_quality; a frame that differs by more than the tolerance fails with its place."""
    found = frame_quality(compared(a, b), tolerance)
    said = _said("clip ", F.col("video_id"), ", frame ", F.col("t"), ": value ", F.col("place"), " differs by ", F.col("max_diff"))
    return found.withColumn("max_diff", F.when(F.col("n_over") > 0, F.raise_error(said).cast("double")).otherwise(F.col("max_diff")))


def frame_key(df: DataFrame) -> list[str]:
    """What names a frame: its clip, where the rows have one, and t."""
    return [c for c in ("video_id", "t") if c in df.columns]


def psnr_per_frame(both: DataFrame) -> DataFrame:
    d, key = F.col("v") - F.col("other"), frame_key(both)
    return both.groupBy(*key).agg(F.avg(d * d).alias("mse")).select(*key, psnr(F.col("mse")).alias("psnr"))


def psnr_summary(frames: DataFrame) -> DataFrame:
    """One row for each clip, or for all frames where rows have no video_id."""
    low = F.min_by("t", F.struct("psnr", "t"))
    return frames.groupBy(*frame_key(frames)[:-1]).agg(F.avg("psnr").alias("mean_psnr"), F.min("psnr").alias("min_psnr"), F.max("psnr").alias("max_psnr"), F.stddev_pop("psnr").alias("sd_psnr"), low.alias("worst_t"), F.count("*").alias("n"))


def lowest(frames: DataFrame, k: int = 10) -> DataFrame:
    """The k worst frames: a top-k, not a sort of all."""
    return frames.orderBy("psnr", *frame_key(frames)).limit(k)


def moving_average(frames: DataFrame, width: int = 10, by: str | None = None) -> DataFrame:
    """Means of full windows only, of consecutive rows by t, whatever gaps t has.  Rows are numbered within
    their clip (or `by`) and dealt into runs of RUN numbers, each with the width - 1 rows before it, so that
    no clip is one task."""
    key = [by] if by else [c for c in ("video_id",) if c in frames.columns]
    placed = frames.join(clips.numbered(frames, key), [*key, "t"]) if key else frames.join(clips.numbered(frames, []), "t")
    block = F.floor(F.col("pos") / RUN)
    # a row also goes to the later runs whose windows reach back to it
    dealt = placed.withColumn("_run", F.explode(F.sequence(block, F.floor((F.col("pos") + width - 1) / RUN))))
    w = Window.partitionBy(*key, "_run").orderBy("t").rowsBetween(1 - width, 0)
    out = dealt.withColumn("smooth", F.avg("psnr").over(w)).withColumn("_n", F.count("*").over(w))
    return out.where((F.col("_n") == width) & (F.col("_run") == block)).select(*frames.columns, "smooth")


def histogram(frames: DataFrame, bins: int = 50) -> DataFrame:
    """Counts in equal bins from the least to the greatest; the last bin is closed."""
    ends = frames.agg(F.min("psnr").alias("low"), F.max("psnr").alias("high"))  # one row
    place = F.least(F.floor((F.col("psnr") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
    place = F.when(F.col("high") > F.col("low"), place).otherwise(0)
    return frames.join(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def thresholds(frames: DataFrame, at: tuple[float, ...] = (25.0, 30.0, 35.0)) -> DataFrame:
    """Frames under each threshold: one pass, one row."""
    stacked = ", ".join(f"{x!r}D, n{i}" for i, x in enumerate(at))
    counts = frames.agg(*[F.count_if(F.col("psnr") < x).alias(f"n{i}") for i, x in enumerate(at)])
    return counts.selectExpr(f"stack({len(at)}, {stacked}) as (threshold, n_below)")


def diff_stats(both: DataFrame) -> DataFrame:
    d = F.abs(F.col("v") - F.col("other"))
    return both.groupBy(*frame_key(both)).agg(F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff"))


def ssim(both: DataFrame) -> DataFrame:
    """The global form of the published index for each frame (one window over the frame, range 255)."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    a, b = F.avg("v"), F.avg("other")
    va, vb, cov = F.var_pop("v"), F.var_pop("other"), F.covar_pop("v", "other")
    index = ((2 * a * b + c1) * (2 * cov + c2)) / ((a * a + b * b + c1) * (va + vb + c2))
    return both.groupBy(*frame_key(both)).agg(index.alias("ssim"))


def local_ssim(frames: DataFrame, other: DataFrame, size: int = 11, sigma: float = 1.5) -> DataFrame:
    """The mean over a frame of the published index under a Gaussian window (range 255), for frames of two
    clips with one (video_id, t).  Moments are separable stencils, within each frame.  Frames of different
    sizes fail by their clip and t."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for clip, t, h, w, c, a, b in zip(*(batch.column(k) for k in range(7)), strict=True):
                h, w, c = h.as_py(), w.as_py(), c.as_py()
                x, y = (v.values.to_numpy(zero_copy_only=False).astype(float).reshape(h, w, c) for v in (a, b))
                rows, columns = stencils.window(h, size, sigma), stencils.window(w, size, sigma)
                mean = lambda v: stencils.along(stencils.along(v, rows, 0), columns, 1)  # noqa: B023, E731
                mx, my = mean(x), mean(y)
                vx, vy, both = mean(x * x) - mx * mx, mean(y * y) - my * my, mean(x * y) - mx * my
                found.append(float((((2 * mx * my + c1) * (2 * both + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["video_id", "t", "ssim"])

    size_of = lambda s: F.struct(*[F.col(f"{s}.{c}") for c in ("h", "w", "c")], F.size(f"{s}.data"))
    said = F.concat(F.lit("clip "), F.coalesce("a.video_id", F.lit("null")), F.lit(", frame "), F.col("a.t").cast("string"), F.lit(": sizes differ"))
    pairs = frames.alias("a").join(other.alias("b"), F.col("a.video_id").eqNullSafe(F.col("b.video_id")) & (F.col("a.t") == F.col("b.t")))
    same = F.when(size_of("a") == size_of("b"), F.col("b.data")).otherwise(F.raise_error(said).cast("array<double>"))
    return pairs.select("a.video_id", "a.t", "a.h", "a.w", "a.c", F.col("a.data").cast("array<double>"), same.alias("other")).mapInArrow(work, "video_id string, t int, ssim double")


def max_diff_location(both: DataFrame, key: list[str]) -> DataFrame:
    """Where the clips differ most; ties go to the first place."""
    d = F.abs(F.col("v") - F.col("other"))
    return both.select(*key, d.alias("diff")).orderBy(F.desc("diff"), *key).limit(1)


def bench_stats(runs: DataFrame, value: str) -> DataFrame:
    """Mean, population deviation, CV in percent, least and greatest of measured times."""
    sd = F.stddev_pop(value)
    return runs.agg(F.avg(value).alias("mean_v"), sd.alias("sd_v"), (100 * sd / F.avg(value)).alias("cv_pct"), F.min(value).alias("min_v"), F.max(value).alias("max_v"))
