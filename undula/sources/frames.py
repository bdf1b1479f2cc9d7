"""Frame sources and sinks.

`frames_from_vectors` reads rasters out of array columns.  The Python data source `frames` reads
binary PPM/PGM images (one file a frame), uncompressed AVI (one file a clip) and folders NAME.clip of AVI
parts, all by ranges of frames in the tasks, as Arrow batches, through the path's own file system.  A clip's
frame rate is a column: the AVI header's, or what a file `fps` beside the images says, else null
(`effective_fps` makes that 30).  The same source writes clips: tasks write parts of a bounded number of
frames, the commit numbers them, and what isn't committed goes.  As a stream the source gives the frames
that came since the last batch.  Canonical storage is Parquet partitioned by video_id.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from ..functions.color import swap_channels
from ..operators.arrays import byte_rows, is_bytes, number_rows, values_of
from ..schemas import METRICS
from ..shared import kept, open_store
from . import avi


def frames_from_vectors(df: DataFrame, key: str, vector: str, h: int, w: int, c: int, video_id: str = "v") -> DataFrame:
    """One frame per row: the first h*w*c values of a vector in -1..1, scaled to 0..255."""
    data = F.transform(F.slice(vector, 1, h * w * c), lambda e: 127.5 * (1 + e.cast("double")))
    return df.select(F.lit(video_id).alias("video_id"), F.col(key).cast("int").alias("t"), F.lit(h).alias("h"), F.lit(w).alias("w"), F.lit(c).alias("c"), data.alias("data"))


def to_pixels(frames: DataFrame, channels: bool = True, channel_order: str = "rgb") -> DataFrame:
    """One row for each value of a frame.  channel_order says what the frames hold; rows are RGB."""
    rows = frames.select("video_id", "t", "w", "c", F.posexplode("data").alias("i", "v"))
    row = F.col("w") * F.col("c")
    ch = F.expr("i % c")
    columns = [F.expr("i div (w * c)").cast("int").alias("y"), F.floor((F.col("i") % row) / F.col("c")).cast("int").alias("x")]
    if channels:
        columns.append((swap_channels(ch) if channel_order == "bgr" else ch).cast("int").alias("ch"))
    return rows.select("video_id", "t", *columns, "v")


def effective_fps(fps):
    """A clip's frame rate, 30 where the file has none."""
    return F.coalesce(F.when(fps > 0, fps), F.lit(30.0))


def read_image(path: str) -> tuple[int, int, int, bytes]:
    """(h, w, c, values) of a binary PGM or PPM file of 8-bit values."""
    store, at = open_store(path)
    with store.open_input_file(at) as f:
        raw = f.read()
    m = re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", raw)
    if not m or int(m[4]) != 255:
        raise ValueError(f"not an 8-bit PGM or PPM file: {path}")
    w, h, c = int(m[2]), int(m[3]), 3 if m[1] == b"6" else 1
    return h, w, c, raw[m.end() : m.end() + h * w * c]


@dataclass
class _Part(InputPartition):
    """Frames of one clip: images with their numbers, or frames first to last of an AVI file, the first of
    which has number t."""

    clip: str
    fps: float | None
    images: list[tuple[int, str]]
    avi: str | None = None
    t: int = 0
    first: int = 0
    last: int | None = None


#: What frames are in tables: arrays of doubles, or a byte for each value.
KINDS = {"double": ("array<double>", pa.list_(pa.float64())), "byte": ("binary", pa.binary())}
ARROW = pa.schema([("video_id", pa.string()), ("t", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("c", pa.int32()), ("fps", pa.float64()), ("data", pa.list_(pa.float64()))])
#: Values in an Arrow batch; bytes of an AVI file from which on a head is read to deal it out, in ranges of about as many.
BATCH, LARGE = 1 << 20, 1 << 22


def clip_parts(path: str, per_task: int) -> list[_Part]:
    """The parts of all clips in a folder (or of one file).  The driver lists files; of large AVI files it reads
    the heads of their lists, and no frames."""
    store, root = open_store(path)
    info = store.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    files = sorted((f for f in found if f.type == fs.FileType.File and not os.path.basename(f.path).startswith("_") and "/_" not in f.path[len(root) :]), key=lambda f: f.path)
    at = lambda f: path if f is info else path.rstrip("/") + f.path[len(root.rstrip("/")) :]
    images: dict[str, list[str]] = {}
    rates: dict[str, float] = {}
    parts = []
    for f in files:
        inner = os.path.basename(f.path) if f is info else f.path[len(root.rstrip("/")) + 1 :]
        folder, name = os.path.dirname(inner), os.path.basename(inner)
        if name.lower().endswith((".ppm", ".pgm")):
            images.setdefault(folder or ".", []).append(at(f))
        elif name == "fps":
            with store.open_input_file(f.path) as rate:
                rates[folder or "."] = float(rate.read())
        elif name.lower().endswith(".avi"):
            clip, start = (folder[:-5], int(name[:-4])) if folder.endswith(".clip") else (inner, 0)
            if f.size < LARGE:
                parts.append(_Part(clip, None, [], at(f), start))
                continue
            with store.open_input_file(f.path) as whole:
                found = avi.layout(whole, f.size)
            n, some = found.frames, max(per_task, LARGE // found.step)
            parts += [_Part(clip, None, [], at(f), start, k, min(n, k + some)) for k in range(0, n, some)]
    for clip, own in images.items():
        numbered = list(enumerate(own))
        parts += [_Part(clip, rates.get(clip), numbered[k : k + per_task]) for k in range(0, len(own), per_task)]
    return parts


def read_part(part: _Part, kind: str = "double") -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH values.  A cut-off frame is skipped."""
    schema = ARROW.set(6, pa.field("data", KINDS[kind][1]))

    def batch(rows: list[tuple], flat: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        data = byte_rows(flat, ends) if kind == "byte" else number_rows(flat.astype(np.float64), ends)
        return pa.RecordBatch.from_arrays([*(pa.array([row[k] for row in rows], own) for k, own in enumerate(ARROW.types[:-1])), data], schema=schema)

    held: list[tuple] = []
    ends = [0]
    for t, path in part.images:
        h, w, c, raw = read_image(path)
        if len(raw) == h * w * c:
            held.append((part.clip, t, h, w, c, part.fps, np.frombuffer(raw, np.uint8)))
            ends.append(ends[-1] + len(raw))
        if ends[-1] >= BATCH:
            yield batch(held, np.concatenate([x for *_, x in held]), np.array(ends))
            held, ends = [], [0]
    if held:
        yield batch(held, np.concatenate([x for *_, x in held]), np.array(ends))
    if part.avi:
        store, at = open_store(part.avi)
        with store.open_input_file(at) as f:
            try:
                found = avi.layout(f, store.get_file_info(at).size)
            except ValueError as e:
                raise ValueError(f"{e}: {part.avi}") from e
            size = abs(found.h) * found.w * 3
            for first, last in found.runs(part.first, found.frames if part.last is None else part.last, max(1, BATCH // size)):
                flat = avi.decode_rows(avi.read_stored(f, found, first, last), found.h, found.w).ravel()
                rows = [(part.clip, part.t + k, abs(found.h), found.w, 3, found.fps) for k in range(first, last)]
                yield batch(rows, flat, np.arange(last - first + 1) * size)


class _FramesReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.per_task, self.kind = options["path"], int(options.get("frames_per_task", 64)), options.get("values", "double")

    def partitions(self) -> list[InputPartition]:
        parts = clip_parts(self.path, self.per_task)
        if not parts:
            raise ValueError(f"no frames in {self.path}")
        return parts

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        return read_part(partition, self.kind)


class _FramesStream(DataSourceStreamReader):
    """Frames by batches.  An offset is how many frames of each clip have been given, and frames of a clip are
    numbered from there, so a restart goes on where the last committed batch ended."""

    def __init__(self, options):
        self.path, self.per_task, self.kind = options["path"], int(options.get("frames_per_task", 64)), options.get("values", "double")

    def initialOffset(self) -> dict:
        return {"clips": "{}"}

    def _available(self) -> dict[str, int]:
        ends: dict[str, int] = {}
        for part in clip_parts(self.path, self.per_task):
            if part.images:
                end = part.images[-1][0] + 1
            elif part.last is not None:
                end = part.t + part.last
            else:
                store, at = open_store(part.avi)
                with store.open_input_file(at) as f:
                    end = part.t + avi.layout(f, store.get_file_info(at).size).frames
            ends[part.clip] = max(end, ends.get(part.clip, 0))
        return ends

    def latestOffset(self) -> dict:
        return {"clips": json.dumps(self._available(), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        given, until = json.loads(start["clips"]), json.loads(end["clips"])
        out = []
        for part in clip_parts(self.path, self.per_task):
            low, high = given.get(part.clip, 0), until.get(part.clip, 0)
            images = [x for x in part.images if low <= x[0] < high]
            if images:
                out.append(replace(part, images=images))
            elif part.avi:
                first = max(part.first, low - part.t)
                last = min(high - part.t, part.last) if part.last is not None else high - part.t
                store, at = open_store(part.avi)
                with store.open_input_file(at) as f:
                    last = min(last, avi.layout(f, store.get_file_info(at).size).frames)
                if first < last:
                    out.append(replace(part, first=first, last=last))
        return out

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        return read_part(partition, self.kind)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class _Written(WriterCommitMessage):
    """Parts of a task: (clip, first t, last t, frames, h, w, fps, file)."""

    parts: list[tuple]


class _ClipsWriter(DataSourceArrowWriter):
    """Tasks write AVI parts of runs of `segment` numbers under a folder of their own, the commit numbers a clip's parts by the frames before
    them and moves them to NAME.clip; the rest of that folder goes, and with it what lost attempts left."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.segment, self.fps = int(options.get("segment", 64)), float(options["fps"]) if "fps" in options else None
        self.scratch = f"{self.path}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, folder = open_store(self.scratch)
        store.create_dir(folder, recursive=True)
        done: list[tuple] = []
        held: list[tuple[int, bytes]] = []
        own: tuple | None = None

        def flush() -> None:
            if held:
                name = f"{folder}/{uuid.uuid4().hex}.avi"
                clip, h, w, fps = own
                with store.open_output_stream(name) as out:
                    avi.write(out, (raw for _, raw in held), len(held), h, w, fps)
                done.append((clip, held[0][0], held[-1][0], len(held), h, w, fps, name))
                held.clear()

        for batch in iterator:
            clip, t, h, w, data = (batch.column(batch.schema.get_field_index(c)) for c in ("video_id", "t", "h", "w", "data"))
            rates = batch.column(batch.schema.get_field_index("fps")).to_pylist() if "fps" in batch.schema.names else [None] * len(batch)
            flat, ends = values_of(data)
            for i, key in enumerate(zip(clip.to_pylist(), h.to_pylist(), w.to_pylist(), rates, strict=True)):
                values = flat[ends[i] : ends[i + 1]]
                if not key[1] or not key[2] or len(values) != key[1] * key[2] * 3:
                    continue  # an empty frame, or one of a wrong size, is skipped
                key = (key[0] or "null", *key[1:3], self.fps or (key[3] if key[3] and key[3] > 0 else 30.0))
                number = t[i].as_py()
                if key != own or held and (number // self.segment != held[0][0] // self.segment or number <= held[-1][0]):
                    flush()
                    own = key
                held.append((number, avi.encode(values, key[1], key[2])))
        flush()
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        store, folder = open_store(self.path)
        parts = sorted(p for m in messages if m for p in m.parts)
        for a, b in zip(parts[:-1], parts[1:], strict=True):
            if a[0] == b[0] and (a[2] >= b[1] or a[4:7] != b[4:7]):
                self.abort(messages)
                raise ValueError(f"clip {a[0]}: frames {b[1]} to {b[2]} come twice, or differ in size or rate")
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if old.type == fs.FileType.Directory and old.path.endswith(".clip"):
                    store.delete_dir(old.path)
        before: dict[str, int] = {}
        for clip, _, _, n, *_, name in parts:
            start = before.get(clip, 0)
            store.create_dir(f"{folder}/{clip}.clip", recursive=True)
            store.move(name, f"{folder}/{clip}.clip/{start:010d}.avi")
            before[clip] = start + n
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, folder = open_store(self.scratch)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class FramesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return f"video_id string, t int, h int, w int, c int, fps double, data {KINDS[self.options.get('values', 'double')][0]}"

    def reader(self, schema) -> DataSourceReader:
        return _FramesReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FramesStream(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _ClipsWriter(self.options, overwrite)


def read_frames(spark: SparkSession, path: str, frames_per_task: int = 64, values: str = "double") -> DataFrame:
    spark.dataSource.register(FramesSource)
    return spark.read.format("frames").option("path", path).option("frames_per_task", str(frames_per_task)).option("values", values).load()


def stream_frames(spark: SparkSession, path: str, frames_per_task: int = 64, values: str = "double") -> DataFrame:
    """A stream of the frames that come into a folder: images in order of name, and AVI files or parts."""
    spark.dataSource.register(FramesSource)
    return spark.readStream.format("frames").option("path", path).option("frames_per_task", str(frames_per_task)).option("values", values).load()


def write_clips(frames: DataFrame, folder: str, fps: float | None = None, segment: int = 64) -> None:
    """Every clip as a folder NAME.clip of AVI parts of up to `segment` frames, written by the tasks.  Frames
    are numbered from 0 in order of t.  Frames of a wrong size are skipped; a clip of several sizes or rates, or
    with a t twice, fails and leaves nothing."""
    frames.sparkSession.dataSource.register(FramesSource)
    columns = ["video_id", "t", "h", "w", "c", *(["fps"] if "fps" in frames.columns else [])]
    rows = frames.select(*columns, "data" if is_bytes(frames) else F.col("data").cast("array<double>").alias("data"))
    # runs of `segment` numbers are dealt out by a hash: ranges would ask for a first pass over the frames
    out = rows.repartition("video_id", F.floor(F.col("t") / segment)).sortWithinPartitions("video_id", "t").write.format("frames").mode("append").option("path", folder).option("segment", str(segment))
    (out if fps is None else out.option("fps", str(fps))).save()


def join_clips(spark: SparkSession, folder: str, into: str | None = None) -> DataFrame:
    """Makes one file NAME.avi of each NAME.clip in a folder, there or in the folder `into`, a task for each, part by
    part; rows (video_id, frames) of what was written."""
    store, root = open_store(folder)
    clips = [os.path.basename(f.path)[:-5] for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".clip")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        target = open_store(into)[1] if into else root
        store.create_dir(target, recursive=True)
        for batch in batches:
            for clip in batch.column(0).to_pylist():
                files = sorted(store.get_file_info(fs.FileSelector(f"{root}/{clip}.clip")), key=lambda f: f.path)
                layouts = []
                for f in files:
                    with store.open_input_file(f.path) as part:
                        layouts.append(avi.layout(part, f.size))

                def frames(files=files, layouts=layouts) -> Iterator[bytes]:
                    for f, found in zip(files, layouts, strict=True):
                        with store.open_input_file(f.path) as part:
                            for first, last in found.runs(0, found.frames, max(1, BATCH // found.size)):
                                yield avi.read_stored(part, found, first, last).tobytes()

                n, one = sum(x.frames for x in layouts), layouts[0]
                name = f"{target}/_{uuid.uuid4().hex}"
                with store.open_output_stream(name) as out:
                    avi.write(out, frames(), n, one.h, one.w, one.fps)
                store.move(name, f"{target}/{clip}.avi")
                yield pa.RecordBatch.from_arrays([pa.array([clip]), pa.array([n], pa.int64())], names=["video_id", "frames"])

    table = spark.createDataFrame([(c,) for c in clips], "video_id string").repartition(max(1, len(clips)))
    return kept(spark, table.mapInArrow(work, "video_id string, frames long"), "joined")


def write_avi(frames: DataFrame, path: str, fps: float) -> int:
    """One clip as one uncompressed AVI file, its frames in order of t.  Parts are written by the tasks and joined
    by one, none by the driver.  Returns the number of frames."""
    spark, folder = frames.sparkSession, f"{os.path.dirname(path) or '.'}/_parts-{uuid.uuid4().hex}"
    write_clips(frames.withColumn("video_id", F.lit("clip")), folder, fps)
    store, root = open_store(folder)
    try:
        made = join_clips(spark, folder).first()
        if made is None:
            raise ValueError("no frames")
        store.move(f"{root}/clip.avi", open_store(path)[1])
    finally:
        if store.get_file_info(root).type == fs.FileType.Directory:
            store.delete_dir(root)
    return made.frames


def write_images(frames: DataFrame, folder: str) -> int:
    """One PPM/PGM file a frame, written by the tasks; frames of a wrong size are skipped.  The folder
    must be one that all executors share.  Returns the number of files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for batch in batches:
            n = 0
            flat, ends = values_of(batch.column(5))
            for row, (clip, t, h, w, c) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)):
                values = flat[ends[row] : ends[row + 1]]
                if h > 0 and w > 0 and len(values) == h * w * c:
                    store.create_dir(f"{root}/{clip}", recursive=True)
                    name = f"{root}/{clip}/{t:08d}.{'ppm' if c == 3 else 'pgm'}"
                    hidden = f"{root}/{clip}/_{uuid.uuid4().hex}"
                    with store.open_output_stream(hidden) as f:
                        f.write(b"P%d\n%d %d\n255\n" % (6 if c == 3 else 5, w, h) + values.astype(np.uint8).tobytes())
                    store.move(hidden, name)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return frames.select("video_id", "t", "h", "w", "c", "data").mapInArrow(work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_matrix(spark: SparkSession, path: str, channels: int = 3) -> DataFrame:
    """A comma-separated matrix of H lines with W * channels values, as rows (y, x, ch, v)."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")).alias("y", "line"))
    cells = lines.select("y", F.split("line", ",").alias("cells"))
    sizes = cells.agg(F.min(F.size("cells")).alias("low"), F.max(F.size("cells")).alias("high")).first()
    if sizes.low is None or sizes.low != sizes.high or sizes.low % channels:
        raise ValueError("lines must have the same number of values, a multiple of channels")
    each = cells.select("y", F.posexplode("cells").alias("i", "cell"))
    return each.select("y", F.expr(f"i div {channels}").cast("int").alias("x"), F.expr(f"i % {channels}").cast("int").alias("ch"), F.trim("cell").cast("double").alias("v"))


def write_matrix(pixels: DataFrame, path: str) -> None:
    """Rows (y, x, ch, v) as lines of comma-separated values in exponent form."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "ch", "v"))), lambda p: F.format_string("%.18e", p["v"])), ",")
    pixels.groupBy("y").agg(line.alias("value")).orderBy("y").select("value").coalesce(1).write.mode("overwrite").text(path)


def read_vector(spark: SparkSession, path: str) -> list[float]:
    """The values of a file that holds exactly one comma-separated line."""
    lines = [r.value for r in spark.read.text(path).where("trim(value) <> ''").limit(2).collect()]
    if len(lines) != 1:
        raise ValueError("exactly one line is needed")
    return [float(v) for v in lines[0].split(",")]


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of frame metrics with a header, under the explicit METRICS schema."""
    return spark.read.csv(path, header=True, schema=METRICS)


def write_report(frames: DataFrame, path: str) -> None:
    """The quality report as text: for each clip (or for all frames where rows have no video_id) a summary, the
    ten lowest, then every frame in order.  Lines name the clip."""
    from ..operators import metrics

    own = "video_id" in frames.columns
    key, clip = (["video_id"], F.concat(F.coalesce("video_id", F.lit("null")), F.lit(": "))) if own else ([], F.lit(""))
    first = F.col("video_id") if own else F.lit("").alias("video_id")
    text = F.format_string("mean %.2f min %.2f max %.2f sd %.2f dB, lowest at frame %d of %d", "mean_psnr", "min_psnr", "max_psnr", "sd_psnr", "worst_t", "n")
    s = metrics.psnr_summary(frames).select(first, F.concat(clip, text).alias("value"), F.lit(0).alias("part"), F.lit(0).alias("k"))
    line = F.concat(clip, F.format_string("Frame %d: %.2f dB", "t", "psnr")).alias("value")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("psnr", "t"))
    low = frames.withColumn("k", place).where("k <= 10").select(first, line, F.lit(1).alias("part"), "k") if own else metrics.lowest(frames).select(first, line, F.lit(1).alias("part"), place.alias("k"))
    every = frames.select(first, line, F.lit(2).alias("part"), F.col("t").alias("k"))
    s.unionByName(low).unionByName(every).orderBy("video_id", "part", "k").select("value").write.mode("overwrite").text(path)
