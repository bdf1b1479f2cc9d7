"""Frames of bytes: the same results as frames of numbers, through plans, files and the stream."""

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from undula.config import BABY, CPP
from undula.operators import arrays
from undula.plans.magnify import magnify
from undula.sources import frames as fr

KIND = "video_id string, t int, h int, w int, c int, data array<double>"


@pytest.fixture(scope="module")
def clips(spark):
    rnd = np.random.default_rng(3)
    rows = [(v, t, h, w, 3, np.rint(rnd.uniform(0, 255, h * w * 3)).tolist()) for v, h, w in (("a", 7, 9), ("b", 12, 5)) for t in range(12)]
    return spark.createDataFrame(rows, KIND).repartition(3)


def rows_of(df):
    return {(r.video_id, r.t): (r.h, r.w, r.c, list(r.data)) for r in df.collect()}


def test_values_of_arrow_columns():
    lists = pa.array([[1.0, 2.0], None, [], [3.0]])
    for column in (pa.array([b"\1\2", None, b"", b"\3"], pa.binary()), pa.array([b"\1\2", None, b"", b"\3"], pa.large_binary()), lists):
        for part, want, ends in ((column, [1, 2, 3], [0, 2, 2, 2, 3]), (column.slice(1), [3], [0, 0, 0, 1]), (column.slice(4), [], [0])):
            flat, at = arrays.values_of(part)
            assert flat.tolist() == want and at.tolist() == ends
    assert arrays.byte_rows(np.array([1, 2, 3]), np.array([0, 2, 2, 3])).to_pylist() == [b"\1\2", b"", b"\3"]


def test_plans_over_bytes(spark, clips):
    held = arrays.to_bytes(clips)
    assert rows_of(held) == rows_of(clips) == rows_of(arrays.numbers(held))
    for config in (replace(CPP, levels=2, high_hz=3.0), replace(BABY, levels=2)):
        made = magnify(held, config)
        assert dict(made.dtypes)["data"] == "binary" and rows_of(made) == rows_of(magnify(clips, config))
    # no signal: a frame that is empty or null; a size that the bytes don't have fails by no other frame
    odd = spark.createDataFrame([("a", 12, 7, 9, 3, b""), ("a", 13, 7, 9, 3, None)], KIND.replace("array<double>", "binary"))
    made = {k: v[3] for k, v in rows_of(magnify(held.unionByName(odd), replace(CPP, levels=1, high_hz=3.0))).items()}
    assert len(made) == 26 and made["a", 12] == made["a", 13] == []


def test_files_of_bytes(spark, clips, tmp_path):
    held = arrays.to_bytes(clips)
    fr.write_clips(held, str(tmp_path / "clips"), 25.0)
    back = fr.read_frames(spark, str(tmp_path / "clips"), 5, "byte")
    assert dict(back.dtypes)["data"] == "binary" and rows_of(back) == rows_of(clips)
    assert fr.write_images(held.where("video_id = 'b'"), str(tmp_path / "images")) == 12
    images = fr.read_frames(spark, str(tmp_path / "images"), values="byte")
    assert rows_of(images) == rows_of(clips.where("video_id = 'b'"))
    stream = fr.stream_frames(spark, str(tmp_path / "clips"), values="byte").writeStream.format("memory").queryName("bytes").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert spark.table("bytes").where(F.length("data") == F.expr("h * w * c")).count() == 24
