"""Video files written and read by tasks, as tables and as a stream."""

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_plans import clip
from undula.sources import avi
from undula.sources import frames as fr


def shown(df):
    return {(r.video_id, r.t): (r.h, r.w, r.fps, list(map(int, r.data))) for r in df.collect()}


@pytest.fixture(scope="module")
def clips(spark):
    rnd = np.random.default_rng(8)
    made = {"a": (25.0, rnd.integers(0, 256, (37, 4, 6, 3))), "b": (12.5, rnd.integers(0, 256, (9, 3, 5, 3)))}
    table = None
    for name, (fps, x) in made.items():
        own = clip(spark, x.astype(float), name).withColumn("fps", F.lit(fps))
        table = own if table is None else table.unionByName(own)
    want = {(v, t): (*x.shape[1:3], fps, x[t].ravel().tolist()) for v, (fps, x) in made.items() for t in range(len(x))}
    return table.repartition(6), want


def test_clips_are_written_by_several_tasks(spark, clips, tmp_path):
    table, want = clips
    fr.write_clips(table, str(tmp_path / "out"), segment=5)
    parts = sorted(p.name for p in (tmp_path / "out" / "a.clip").iterdir())
    assert len(parts) >= 8 and parts[0] == "0000000000.avi"
    back = fr.read_frames(spark, str(tmp_path / "out"))
    assert shown(back) == want and back.rdd.getNumPartitions() == len(parts) + len(list((tmp_path / "out" / "b.clip").iterdir()))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.clip", "b.clip"]
    made = {r.video_id: r.frames for r in fr.join_clips(spark, f"file://{tmp_path}/out").collect()}
    assert made == {"a": 37, "b": 9}
    for name in made:
        one = shown(fr.read_frames(spark, str(tmp_path / "out" / f"{name}.avi")))
        assert {(name, t): v for (_, t), v in one.items()} == {k: v for k, v in want.items() if k[0] == name}


def test_gaps_odd_frames_and_lost_attempts(spark, clips, tmp_path):
    """Frames are numbered on; a table that can't be a clip, or a task that fails, leaves nothing."""
    table, want = clips
    odd = table.where("t % 3 <> 1").withColumn("data", F.when((F.col("video_id") == "b") & (F.col("t") == 3), F.array(F.lit(1.0))).otherwise(F.col("data")))
    fr.write_clips(odd, str(tmp_path / "out"), segment=4)
    kept = {v: [t for t in range(n) if t % 3 != 1 and (v, t) != ("b", 3)] for v, n in (("a", 37), ("b", 9))}
    assert shown(fr.read_frames(spark, str(tmp_path / "out"))) == {(v, k): want[v, t] for v in kept for k, t in enumerate(kept[v])}
    twice = table.unionByName(table.where("t = 4"))
    broken = table.withColumn("t", F.when(F.col("t") == 30, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("t")))
    mixed = table.withColumn("fps", 20.0 + F.col("t"))
    for k, bad in enumerate((twice, broken, mixed)):
        with pytest.raises(Exception, match="come twice|lost"):
            fr.write_clips(bad, str(tmp_path / f"bad{k}"), segment=4)
        assert not list((tmp_path / f"bad{k}").glob("**/*.avi")) if (tmp_path / f"bad{k}").exists() else True


def test_large_files_go_on_in_further_lists(tmp_path):
    """With lists of three frames: all frames are found, and both levels of the index point at them."""
    rnd = np.random.default_rng(1)
    frames = [avi.encode(rnd.integers(0, 256, 5 * 3 * 3), 5, 3) for _ in range(11)]
    out = io.BytesIO()
    avi.write(out, frames, 11, 5, 3, 24.0, 3 * (8 + len(frames[0])))
    raw = out.getvalue()
    found = avi.layout(io.BytesIO(raw), len(raw))
    assert (found.h, found.w, found.fps, found.frames) == (5, 3, 24.0, 11) and len(found.starts) == 4
    assert [raw[found.place(k) : found.place(k) + found.size] for k in range(11)] == frames
    at, riffs = 0, []
    while at < len(raw):
        tag, n, kind = struct.unpack("<4sI4s", raw[at : at + 12])
        riffs.append((tag, kind))
        at += 8 + n
    assert at == len(raw) and riffs == [(b"RIFF", b"AVI ")] + [(b"RIFF", b"AVIX")] * 3
    top = raw.index(b"indx")
    entries = struct.unpack("<I", raw[top + 12 : top + 16])[0]
    seen = []
    for k in range(entries):
        place, size, count = struct.unpack("<QII", raw[top + 32 + 16 * k : top + 48 + 16 * k])
        assert raw[place : place + 4] == b"ix00" and size == 32 + 8 * count
        base = struct.unpack("<Q", raw[place + 20 : place + 28])[0]
        for j in range(count):
            offset, n = struct.unpack("<II", raw[place + 32 + 8 * j : place + 40 + 8 * j])
            seen.append(raw[base + offset : base + offset + n])
    assert seen == frames


def test_cut_off_empty_and_other_chunks(tmp_path):
    frames = [bytes([k]) * 24 for k in range(4)]
    out = io.BytesIO()
    avi.write(out, frames, 4, 2, 3, 30.0)
    raw = out.getvalue()
    body = raw.index(b"movi") + 4
    odd = raw[:body] + b"".join([raw[body : body + 32], b"00db\0\0\0\0", b"JUNK\3\0\0\0abc\0", raw[body + 32 : body + 96], raw[body + 96 : -3]])
    found = avi.layout(io.BytesIO(odd), len(odd))
    assert found.frames == 3 and [odd[found.place(k) : found.place(k) + 24] for k in range(3)] == frames[:3]
    with pytest.raises(ValueError, match="no frames"):
        avi.layout(io.BytesIO(raw[: body + 10]), body + 10)


def test_large_files_are_dealt_out_by_ranges(spark, clips, tmp_path, monkeypatch):
    table, want = clips
    assert fr.write_avi(table.where("video_id = 'a'"), str(tmp_path / "a.avi"), 25.0) == 37
    monkeypatch.setattr(fr, "LARGE", 1)
    parts = fr.clip_parts(str(tmp_path), 10)
    assert [(p.clip, p.first, p.last) for p in parts] == [("a.avi", 0, 10), ("a.avi", 10, 20), ("a.avi", 20, 30), ("a.avi", 30, 37)]
    rows = [r for p in parts for b in fr.read_part(p) for r in b.to_pylist()]
    assert [list(map(int, r["data"])) for r in rows] == [want["a", t][3] for t in range(37)]


def test_frames_as_a_stream(spark, clips, tmp_path):
    """Images and parts that come between batches; a restart goes on behind the last batch."""
    table, want = clips
    source = str(tmp_path / "in")
    images = table.where("video_id = 'b'").drop("fps")

    def batch():
        stream = fr.stream_frames(spark, source, 4)
        made = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        made.awaitTermination()

    fr.write_images(images.where("t < 4"), source)
    fr.write_clips(table.where("video_id = 'a' and t < 20"), source, segment=8)
    batch()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 24
    batch()  # nothing new
    fr.write_images(images.where("t >= 4"), source)
    batch()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert shown(found) == {k: (*v[:2], 25.0 if k[0] == "a" else None, v[3]) for k, v in want.items() if k[0] == "b" or k[1] < 20}
    assert found.count() == 29


def test_many_small_frames_are_read_and_joined_in_stretches(spark, tmp_path, monkeypatch):
    """Reads, ranges and writes don't grow with the number of frames of a few bytes, and hold the same frames: of
    padded lines, and over the ends of lists."""
    rnd = np.random.default_rng(3)
    x = rnd.integers(0, 256, (3000, 5, 3, 3)).astype(np.uint8)
    stored = [avi.encode(f.ravel(), 5, 3) for f in x]
    out, blocks = io.BytesIO(), io.BytesIO()
    avi.write(out, stored, 3000, 5, 3, 24.0, 700 * (8 + 60))
    avi.write(blocks, (b"".join(stored[k : k + 900]) for k in range(0, 3000, 900)), 3000, 5, 3, 24.0, 700 * (8 + 60))
    raw = blocks.getvalue()
    assert raw == out.getvalue()
    (tmp_path / "small.avi").write_bytes(raw)

    class Counted:
        def __init__(self, store):
            self.store, self.get_file_info = store, store.get_file_info

        def open_input_file(self, path):
            f = self.store.open_input_file(path)

            class File:
                __enter__, __exit__ = (lambda s: s), (lambda s, *e: f.close())
                seek, read = f.seek, f.read
                read_at = lambda s, *a: reads.append(a) or f.read_at(*a)

            return File()

    reads: list[tuple] = []
    opened = fr.open_store
    monkeypatch.setattr(fr, "open_store", lambda path: (Counted(opened(path)[0]), opened(path)[1]))
    monkeypatch.setattr(fr, "LARGE", 1 << 16)
    parts = fr.clip_parts(str(tmp_path), 5)
    assert len(parts) == 4 and [p.first for p in parts] == [0, 963, 1926, 2889]
    for kind in fr.KINDS:
        rows = [r for p in parts for b in fr.read_part(p, kind) for r in b.to_pylist()]
        assert [r["t"] for r in rows] == list(range(3000)) and [list(r["data"]) for r in rows] == [f.ravel().tolist() for f in x]
    assert len(reads) <= 2 * 12
    monkeypatch.undo()
    table = spark.createDataFrame([("c", t, 5, 3, 3, 24.0, f.ravel().astype(float).tolist()) for t, f in enumerate(x)], "video_id string, t int, h int, w int, c int, fps double, data array<double>")
    fr.write_clips(table, str(tmp_path / "parts"), segment=500)
    fr.join_clips(spark, str(tmp_path / "parts"), str(tmp_path / "whole"))
    assert [p.name for p in (tmp_path / "whole").iterdir()] == ["c.avi"]
    assert (tmp_path / "whole" / "c.avi").read_bytes()[-3000 * 68 :] == b"".join(b"00db" + struct.pack("<I", 60) + f for f in stored)
