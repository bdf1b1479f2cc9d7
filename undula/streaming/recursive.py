"""The recursive band-pass as a stateful stream: state is the previous input and both outputs.

Rows are series tiles (video_id, level, tile, t, data).  Within a batch a tile's rows are ordered by t;
rows at or before the last t are dropped as duplicates; after a gap the policy either repeats the
previous output for the missing t without touching the state (hold, for gaps of at most longest_gap) or
fails (error).  The frequency path needs all frames and refuses streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import coeffs

OUT = "video_id string, level int, tile int, t int, data array<double>"
STATE = "t int, x array<double>, slow array<double>, fast array<double>, out array<double>"


def iir_stream(series: DataFrame, fps: float, low: float, high: float, first_frame: str = "raw", gaps: str = "hold", longest_gap: int = 100_000) -> DataFrame:
    l0, l1, la = coeffs.first_order(low, fps)
    h0, h1, ha = coeffs.first_order(high, fps)

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # a batch's rows of one bounded tile, to be put in order
        rows = pd.concat(list(parts)).sort_values("t", kind="stable")
        last, x0, slow, fast, out = (state.get[0], *map(np.array, state.get[1:])) if state.exists else (None, None, None, None, None)
        made = []
        for t, data in zip(rows["t"], rows["data"], strict=True):
            if last is not None and t <= last:
                continue
            x = np.asarray(data, float)
            if last is None:
                slow = fast = x
                out = x if first_frame == "raw" else np.zeros_like(x)
            else:
                if t > last + 1:
                    if gaps == "error" or t - last > longest_gap:
                        raise ValueError(f"frames {last + 1}..{t - 1} are missing")
                    made += [(k, out) for k in range(last + 1, t)]
                slow = l0 * x + l1 * x0 - la * slow
                fast = h0 * x + h1 * x0 - ha * fast
                out = fast - slow
            made.append((t, out))
            last, x0 = int(t), x
        if last is not None:
            state.update((last, x0.tolist(), slow.tolist(), fast.tolist(), out.tolist()))
        yield pd.DataFrame({"video_id": key[0], "level": key[1], "tile": key[2], "t": [int(t) for t, _ in made], "data": [y.tolist() for _, y in made]})

    return series.groupBy("video_id", "level", "tile").applyInPandasWithState(work, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def refuse_stream(df: DataFrame) -> DataFrame:
    """For operators that need every frame of a clip."""
    if df.isStreaming:
        raise ValueError("a frequency-domain filter needs all frames; use the recursive one on streams")
    return df
