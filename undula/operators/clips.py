"""What is known of whole clips: rates, sizes, lengths, and the place of each frame in its clip.

A clip's description is one short row.  Descriptions are joined to frames by broadcast up to MAX_CLIPS of
them, which is checked; beyond that Spark joins the tables as it sees fit.
"""

from __future__ import annotations

from math import isqrt

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coeffs

MAX_CLIPS = 100_000
#: Consecutive frames that are numbered in one task.
RUN = 4096
RATE = 30.0


def rated(frames: DataFrame, fps: float | None = None) -> DataFrame:
    """Frames with `fps`: the given rate for all of them, else their own, else 30."""
    own = F.when(F.col("fps") > 0, F.col("fps").cast("double")) if "fps" in frames.columns else F.lit(None).cast("double")
    return frames.withColumn("fps", F.coalesce(F.lit(fps).cast("double"), own, F.lit(RATE)))


def _one(name: str):
    """A value that all frames of a clip share; the job fails where they don't."""
    said = F.concat(F.lit("clip "), F.coalesce("video_id", F.lit("null")), F.lit(f": frames differ in {name}"))
    return F.when(F.min(name) == F.max(name), F.min(name)).when(F.count(name) > 0, F.raise_error(said).cast("double")).alias(name)


def described(frames: DataFrame) -> DataFrame:
    """Rows (video_id, frames, first_t, dense[, h, w, c, fps]) of rows (video_id, t, ...): how many frames a
    clip has, from which t on, and whether t has no gaps.  Only short columns are read."""
    given = [c for c in ("h", "w", "c", "fps") if c in frames.columns]
    n = F.count_distinct("t")
    return frames.groupBy("video_id").agg(n.alias("frames"), F.min("t").alias("first_t"), (n == F.max("t") - F.min("t") + 1).alias("dense"), *[_one(c) for c in given])


def factors(n: int) -> tuple[int, int]:
    """(a, b) with a * b = n, a <= b, as near to each other as n has divisors."""
    return next((a, n // a) for a in range(isqrt(n), 0, -1) if n % a == 0)


def with_lengths(frames: DataFrame, clips: DataFrame, padding: str = "none") -> tuple[DataFrame, int, int, bool]:
    """(frames with size, rows and lines: the length of a clip's transform and its two factors; the least and
    the greatest length; whether all clips are dense).  Fetches up to MAX_CLIPS descriptions."""
    spark = clips.sparkSession

    def split(parts):
        for part in parts:
            size = [coeffs.smooth_length(n) if padding == "optimal" else n for n in part["frames"]]
            lines = [factors(max(1, n)) for n in size]
            yield pd.DataFrame({"video_id": part["video_id"], "frames": part["frames"], "first_t": part["first_t"], "dense": part["dense"], "size": size, "lines": [a for a, _ in lines], "columns": [b for _, b in lines]})

    kind = "video_id string, frames long, first_t int, dense boolean, size long, lines long, columns long"
    table = clips.select("video_id", "frames", F.col("first_t").cast("int").alias("first_t"), "dense").mapInPandas(split, kind)
    known = table.limit(MAX_CLIPS + 1).collect()
    least, most = min((r["size"] for r in known), default=0), max((r["size"] for r in known), default=0)
    if len(known) <= MAX_CLIPS:
        table, dense = F.broadcast(spark.createDataFrame(known, kind)), all(r.dense for r in known)
    else:
        least, most, dense = 0, 1 << 62, False
    return frames.join(table.drop("dense"), "video_id"), least, most, dense


def numbered(frames: DataFrame, key: list[str], by: str = "t", run: int | None = None) -> DataFrame:
    """Distinct (key, by) with `pos`: 0, 1, 2, ... in order of `by` within a key.  Runs of `by` are counted,
    the counts are summed along a key, and each run is numbered by itself, so that no key is one task."""
    rows = frames.select(*key, by).distinct().withColumn("_run", F.floor(F.col(by) / (run or RUN)))
    counts = rows.groupBy(*key, "_run").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*key, "_run", before.alias("_before"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*key, "_run")]
    both = rows.alias("a").join(starts.alias("b"), same)
    place = F.row_number().over(Window.partitionBy(*[F.col(f"a.{c}") for c in (*key, "_run")]).orderBy(f"a.{by}")) - 1
    return both.select(*[F.col(f"a.{c}").alias(c) for c in (*key, by)], (F.col("b._before") + place).alias("pos"))


