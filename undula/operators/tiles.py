"""Series in tiles: runs of a frame's values, so that groups are bounded whatever the resolution."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of a frame in a tile.
TILE = 2048
#: `tile` is the place of a tile's first value in its frame.
SERIES = "video_id string, level int, tile int, t int, data array<double>"


def tiles(bands: DataFrame, tile: int | None = None) -> DataFrame:
    """Rows (video_id, level, tile, t, data[, fps, gain]) of frames' values."""
    width = tile or TILE
    more = [c for c in ("fps", "gain") if c in bands.columns]
    starts = F.sequence(F.lit(0), F.greatest(F.size("data") - 1, F.lit(0)), F.lit(width))
    cut = F.explode(F.transform(starts, lambda i: F.struct(i.alias("tile"), F.slice("data", i + 1, F.lit(width)).alias("data"))))
    return bands.select("video_id", "level", "t", *more, cut.alias("cut")).select("video_id", "level", "cut.tile", "t", "cut.data", *more)


def untile(series: DataFrame) -> DataFrame:
    """Rows (video_id, level, t, data) from tiles."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("tile", "data"))), lambda p: p["data"])
    return series.groupBy("video_id", "level", "t").agg(F.flatten(parts).alias("data"))


def own_values(table: pa.Table) -> dict:
    """What all rows of a group share, from its first one."""
    return {c: table[c][0].as_py() for c in table.column_names if c != "data"}


def ordered(table: pa.Table, by: str = "t") -> tuple[np.ndarray, np.ndarray]:
    """(t, values by t): duplicates of a t keep the first."""
    table = table.select([by, "data"]).sort_by(by).combine_chunks()
    t = table[by].to_numpy()
    x = table["data"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
    keep = np.append(True, t[1:] != t[:-1])
    return t[keep], x[keep]


def series_rows(table: pa.Table, t: np.ndarray, y: np.ndarray, by: str = "t") -> pa.Table:
    """Rows of the group's tile with new values."""
    n = len(t)
    same = lambda name, kind: pa.array([table[name][0].as_py()] * n, kind)
    data = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * y.shape[1], pa.int32()), pa.array(np.ascontiguousarray(y).ravel()))
    return pa.table({"video_id": same("video_id", pa.string()), "level": same("level", pa.int32()), "tile": same("tile", pa.int32()), by: pa.array(t, pa.int32()), "data": data})
