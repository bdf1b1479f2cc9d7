"""A fixed-size bitmap of 64-bit hashes, built by a Spark job and broadcast.

The bitmap has 2 ** bits bits whatever the input, so the broadcast has a proven bound (2 ** 28 bits
are 32 MiB).  It only ever lets a task skip work that can't matter: when it fills up, more rows pass
and results stay the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textops

SCHEMA = "segment int, places binary"
_ARROW = pa.schema([("segment", pa.int32()), ("places", pa.binary())])
_HELD = 1 << 22


def places(hashes: Iterable[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Packs the bit places of hashes into rows by segment of the bitmap (inside a task)."""
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        at = textops.distinct(np.concatenate(held))
        held.clear()
        per = bits - segment_bits(bits)
        segment = (at >> np.uint32(per)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(segment)) + 1
        parts = np.split(at & np.uint32((1 << per) - 1), cuts)
        first = segment[np.concatenate([[0], cuts])]
        return pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary())], schema=_ARROW)

    for h in hashes:
        if len(h):
            held.append(textops.distinct((h >> np.uint64(64 - bits)).astype(np.uint32)))
            if sum(map(len, held)) > _HELD:
                yield flush()
    if held:
        yield flush()


def segment_bits(bits: int) -> int:
    return min(8, bits - 3)


def build(spark: SparkSession, rows: DataFrame, bits: int) -> np.ndarray:
    """ORs the rows of `places` into one bitmap: bytes, least significant bit first."""
    per = bits - segment_bits(bits)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bitmap = maps.setdefault(segment, np.zeros(1 << per, bool))
                bitmap[np.frombuffer(at, "<u4")] = True
        for segment, bitmap in maps.items():
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(bitmap, bitorder="little").tobytes()], pa.binary())], schema=_ARROW)

    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in rows.repartition("segment").mapInArrow(textops.tidied(fold), SCHEMA).toLocalIterator():
        at = row.segment << (per - 3)
        out[at : at + (1 << (per - 3))] = np.frombuffer(row.places, np.uint8)
    return out


def has(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = hashes >> np.uint64(64 - bits)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def marks(spark: SparkSession, ids: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of one column of 64-bit keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return places((textops.mix(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) for b in batches), bits)

    return build(spark, ids.mapInArrow(textops.tidied(work), SCHEMA), bits)


def split(spark: SparkSession, df: DataFrame, key: str, bitmap: np.ndarray, bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is certainly not in the bitmap, rows whose key may be), without an exchange.
    Null keys are certainly not in it."""
    shared = spark.sparkContext.broadcast(bitmap)
    at = df.columns.index(key)

    def half(wanted: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(at)
                held = has(shared.value, textops.mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)), bits)
                yield batch.filter(pa.array((held & ids.is_valid().to_numpy(zero_copy_only=False)) == wanted))

        return df.mapInArrow(textops.tidied(work), df.schema)

    return half(False), half(True)


def without(spark: SparkSession, df: DataFrame, key: str, ids: DataFrame, bits: int) -> DataFrame:
    """An anti-join of wide rows: only rows that the bitmap marks are shuffled."""
    ids = ids.select(ids[ids.columns[0]].alias(key))
    clear, maybe = split(spark, df, key, marks(spark, ids, bits), bits)
    return clear.unionByName(maybe.join(ids, key, "left_anti").select(*df.columns))
