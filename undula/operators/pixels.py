"""The relational tier: spatial and temporal operators as joins and aggregates over pixel rows.

Rows are (video_id, t, y, x[, ch], v).  A spatial operator is a small matrix table per axis; both axes
and chains of operators run within one exchange by frame, which satisfies every group-by below it: the
column `frame` that by_frame adds stays among the keys.  Matrix tables have a few entries per line of one
frame and are broadcast only up to MAX_ENTRIES.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stencils

MAX_ENTRIES = 1_000_000
#: Pixels of a partition of whole frames, about.
PART = 1 << 18


def matrix_table(spark: SparkSession, matrix: np.ndarray, name: str) -> DataFrame:
    """Rows (<name>_out, <name>_in, <name>_w)."""
    entries = stencils.entries(matrix)
    table = spark.createDataFrame(entries, f"{name}_out int, {name}_in int, {name}_w double")
    return F.broadcast(table) if len(entries) <= MAX_ENTRIES else table


def by_frame(pixels: DataFrame) -> DataFrame:
    """The one exchange that spatial operators need, with a column `frame` to group by: video_id alone is no key of an
    exchange where it is a constant.  A partition's sums are in memory at once, so pixels are counted and the number
    of partitions follows them."""
    parts = max(pixels.sparkSession.sparkContext.defaultParallelism, -(-pixels.count() // PART))
    return pixels.withColumn("frame", F.xxhash64("video_id", "t")).repartition(parts, "frame")


def separable(spark: SparkSession, pixels: DataFrame, rows: np.ndarray, columns: np.ndarray) -> DataFrame:
    """rows applied along y and columns along x."""
    key = [c for c in ("frame", "video_id", "t", "ch") if c in pixels.columns]
    over_y = pixels.join(matrix_table(spark, rows, "r"), F.col("y") == F.col("r_in")).groupBy(*key, F.col("r_out").alias("y"), "x").agg(F.sum(F.col("v") * F.col("r_w")).alias("v"))
    over_x = over_y.join(matrix_table(spark, columns, "c"), F.col("x") == F.col("c_in")).groupBy(*key, "y", F.col("c_out").alias("x")).agg(F.sum(F.col("v") * F.col("c_w")).alias("v"))
    return over_x.select(*pixels.columns)


def blur(spark: SparkSession, pixels: DataFrame, h: int, w: int, border: str = "reflect101") -> DataFrame:
    return separable(spark, pixels, stencils.blur(h, border), stencils.blur(w, border))


def pyr_down(spark: SparkSession, pixels: DataFrame, h: int, w: int, rule: str = "ceil", border: str = "reflect101") -> DataFrame:
    size = [max(1, (n + 1) // 2 if rule == "ceil" else n // 2) for n in (h, w)]
    return separable(spark, pixels, stencils.down(h, size[0], 2, border), stencils.down(w, size[1], 2, border))


def pyr_up(spark: SparkSession, pixels: DataFrame, h: int, w: int, target: tuple[int, int] | None = None, border: str = "reflect101") -> DataFrame:
    size = [stencils.up_size(n, None if target is None else target[k]) for k, n in enumerate((h, w))]
    return separable(spark, pixels, stencils.up(h, size[0], border), stencils.up(w, size[1], border))


def gaussian_blur(spark: SparkSession, pixels: DataFrame, h: int, w: int, levels: int, border: str = "reflect101", rule: str = "ceil") -> DataFrame:
    """`levels` halvings and doublings: one matrix per axis."""
    return separable(spark, pixels, stencils.gaussian(h, levels, border, rule), stencils.gaussian(w, levels, border, rule))


def laplacian(spark: SparkSession, pixels: DataFrame, h: int, w: int, levels: int, residual: bool = False) -> DataFrame:
    """Rows with `level` and `frame`: each band, and with residual the coarsest image as level `levels`."""
    image = by_frame(pixels)
    bands, key = [], [c for c in ("frame", "video_id", "t", "ch", "y", "x") if c in image.columns]
    for level in range(levels):
        small = pyr_down(spark, image, h, w)
        back = pyr_up(spark, small, (h + 1) // 2, (w + 1) // 2, (h, w)).withColumnRenamed("v", "back")
        bands.append(image.join(back, key).select(F.lit(level).alias("level"), *key, (F.col("v") - F.col("back")).alias("v")))
        image, h, w = small, (h + 1) // 2, (w + 1) // 2
    if residual:
        bands.append(image.select(F.lit(levels).alias("level"), *key, "v"))
    out = bands[0]
    for band in bands[1:]:
        out = out.unionByName(band)
    return out


def to_series(pixels: DataFrame) -> DataFrame:
    """Frame layout to pixel layout, the transpose: rows (video_id, y, x[, ch], data by t)."""
    key = [c for c in ("video_id", "y", "x", "ch") if c in pixels.columns]
    ordered = F.array_sort(F.collect_list(F.struct("t", "v")))
    return pixels.groupBy(*key).agg(F.transform(ordered, lambda p: p["v"]).alias("data"))


def from_series(series: DataFrame) -> DataFrame:
    """Pixel layout back to rows of frames."""
    key = [c for c in series.columns if c != "data"]
    return series.select(*key, F.posexplode("data").alias("t", "v"))
