"""WARC 1.1 archives: writing with revisit records, and reading by boundary-chain verification.

Writing.  Equal payloads of at least `least` bytes are found by digest; the smallest page_id's record
is a response, the others are revisits without a body that name it.  Each task streams its records to
one archive in the shared folder; the manifest row it returns names the file, so files of attempts
that were lost are never read.

Reading.  Archives are cut into byte ranges, one task row each.  A task finds every place in its range
where a record could begin (the magic, also inside payloads), parses the header there and takes the
place just behind its block as the successor.  Within the range it follows successors to the first
place outside.  Pointer jumping over those exits, from offset 0 of each file, doubles the distance
every round and leaves the entry of each range that is truly reached; a magic inside a payload is on
no such chain.  Ranges are then read from their entries.

Defined cases: a null html is an empty payload; payloads under `least` bytes are always responses;
ties go to the smallest page_id; further columns are ignored; an empty table gives an empty table.
URLs and payloads have any length; control characters of a URL are left out.  page_id must be unique
(rows that share one give a record each, all with that id); rows without one are left out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitfilter, textops
from ..shared import fresh
from .shared import kept, open_store, scratch

MAGIC = b"WARC/1.1\r\n"
RANGE = 8 << 20
#: What is read behind a range for headers that begin in it, and again where they are longer.
HEAD = 1 << 16
#: Ranges that one reading task has at least, where there are more than shuffle partitions.
PER_TASK = 16
MARK_BITS = 24
DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def decisions(pages: DataFrame, least: int = 100) -> DataFrame:
    """Rows (page_id, refers_to) of the pages whose payload an earlier page has."""
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", F.sha2(payload, 256).alias("digest")).where(F.octet_length(payload) >= least)
    first = keyed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(first, "digest").where("page_id <> refers_to").select("page_id", "refers_to")


def _clean(url: str | None) -> str:
    """The URL in one header line, of any length, without control characters."""
    return "".join(c for c in url or "" if c >= " ")


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record.  A revisit has no block; its header keeps the payload's size and digest."""
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head += [f"Content-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8"]
    return MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def write(spark: SparkSession, pages: DataFrame, least: int = 100) -> DataFrame:
    """Writes the archives; the manifest, rows (path, size, records).

    Payloads of responses are written where they are read.  Only pages that a bitmap of fixed size
    marks as possible revisits meet their decision in a join.
    """
    with scratch(spark):
        return _write_all(spark, pages, least)


def _write_all(spark: SparkSession, pages: DataFrame, least: int) -> DataFrame:
    folder = fresh(spark, "warc")
    pages = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    decided = kept(spark, decisions(pages, least), "decisions")

    clear, possible = bitfilter.split(spark, pages, "page_id", bitfilter.marks(spark, decided.select("page_id"), MARK_BITS), MARK_BITS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _write(folder, batches)

    schema = "path string, size long, records long"
    return kept(spark, clear.mapInArrow(textops.tidied(work), schema).union(possible.join(decided, "page_id", "left").mapInArrow(textops.tidied(work), schema)), "manifest", stays=True)


def _write(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows (page_id, url, html[, refers_to]) to one archive, inside a task."""
    out = path = None
    size = count = 0
    for batch in batches:
        if not len(batch):
            continue
        if out is None:
            path = f"{folder}/{uuid.uuid4().hex}.warc"
            store, at = open_store(path)
            store.create_dir(at.rpartition("/")[0], recursive=True)
            out = store.open_output_stream(at, buffer_size=1 << 20)
        refers = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * len(batch)
        for page_id, url, html, refers_to in zip(*(batch.column(i) for i in range(3)), refers, strict=True):
            payload = bytes(html.as_buffer()) if html.is_valid else b""
            made = record(page_id.as_py(), url.as_py(), payload, hashlib.sha256(payload).hexdigest(), refers_to)
            out.write(made)
            size += len(made)
            count += 1
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([count])], names=["path", "size", "records"])


def _header(f, raw: bytes, base: int, place: int, total: int) -> tuple[bytes, tuple[dict[str, str], int] | None]:
    """The bytes from base on, with more of them where a header goes on, and (fields, place of the block)
    of the record header at `place`, or None."""
    seen = place
    while (end := raw.find(b"\r\n\r\n", max(place, seen - 3) - base)) < 0 and base + len(raw) < total:
        seen = base + len(raw)
        raw += f.read_at(min(max(HEAD, len(raw)), total - seen), seen)
    if end < 0:
        return raw, None
    fields = {}
    for line in raw[place - base + len(MAGIC) : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return raw, None
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return raw, None
    return raw, (fields, base + end + 4)


def ranges(manifest: DataFrame, size: int = RANGE) -> DataFrame:
    """Rows (path, size, start): the byte ranges of the archives."""
    return manifest.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(size))).alias("start"))


def reading_tasks(spark: SparkSession, parts: DataFrame) -> int:
    """How many tasks read the ranges: their rows are few and small, what they name is not, so the number
    is not left to the rows' size."""
    n = parts.count()
    return max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PER_TASK))))


def candidates(parts: DataFrame, size: int = RANGE) -> DataFrame:
    """Rows (path, start, place, leaves): every place in a range where a record could begin, and where
    the chain from it leaves the range (null where it breaks off)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, total, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                store, at = open_store(path)
                end = min(start + size, total)
                with store.open_input_file(at) as f:
                    raw = f.read_at(min(end + HEAD, total) - start, start)
                    places, follows = [], []
                    found = raw.find(MAGIC)
                    while 0 <= found < end - start:
                        raw, head = _header(f, raw, start, start + found, total)
                        if head:
                            places.append(start + found)
                            follows.append(head[1] + int(head[0]["content-length"]) + 4)
                        found = raw.find(MAGIC, found + 1)
                leaves: dict[int, int | None] = {}
                for place, follow in zip(reversed(places), reversed(follows), strict=True):
                    leaves[place] = follow if follow >= end else leaves.get(follow)
                n = len(places)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array(places, pa.int64()), pa.array([leaves[p] for p in places], pa.int64())], names=["path", "start", "place", "leaves"])

    return parts.mapInArrow(textops.tidied(work), "path string, start long, place long, leaves long")


def entries(spark: SparkSession, found: DataFrame) -> DataFrame:
    """Rows (path, start, place): the first record that begins in each range, by pointer jumping from
    each file's start."""
    found = kept(spark, found, "candidates")
    reached = found.where("place = 0").select("path", "start", "place")
    jumps = found.where("leaves is not null").select("path", F.col("place").alias("here"), F.col("leaves").alias("there"))
    known = found.select("path", "start", "place")
    count = 0
    while True:
        ahead = reached.select("path", F.col("place").alias("here")).join(jumps, ["path", "here"]).select("path", F.col("there").alias("place"))
        reached = kept(spark, reached.union(ahead.join(known, ["path", "place"]).select("path", "start", "place")).distinct(), "reached")
        n = reached.count()
        if n == count:
            return reached
        count = n
        second = jumps.select("path", F.col("here").alias("mid"), F.col("there").alias("end"))
        jumps = kept(spark, jumps.withColumnRenamed("there", "mid").join(second, ["path", "mid"]).select("path", "here", F.col("end").alias("there")), "jumps")


def read(spark: SparkSession, manifest: DataFrame, size: int = RANGE) -> DataFrame:
    """The archives' records.  A response's size and digest are those of its payload as read."""
    with scratch(spark):
        parts = ranges(manifest, size)
        tasks = reading_tasks(spark, parts)
        found = entries(spark, candidates(parts.repartition(tasks, "path", "start"), size))
        start = kept(spark, parts.join(found, ["path", "start"]).select("path", "size", "start", "place"), "starts", stays=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, total, begin, place in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                store, at = open_store(path)
                end = min(begin + size, total)
                rows = []
                with store.open_input_file(at) as f:
                    raw, base = f.read_at(min(end + HEAD, total) - place, place), place
                    while place < end:
                        raw, head = _header(f, raw, base, place, total)
                        if head is None or not raw.startswith(MAGIC, place - base):
                            raise ValueError(f"no record at {place} of {path}")
                        fields, block = head
                        n = int(fields["content-length"])
                        payload = raw[block - base : block - base + n] if block + n <= base + len(raw) else f.read_at(n, block)
                        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response":
                            if hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"damaged record at {place} of {path}")
                            length = len(payload)
                        else:
                            length = int(fields["x-payload-length"])
                        number = lambda x: int(x.rpartition(":")[2].rstrip(">"))
                        refers = number(fields["warc-refers-to"]) if kind == "revisit" else None
                        rows.append((number(fields["warc-record-id"]), fields.get("warc-target-uri"), length, digest, kind, refers))
                        place = block + n + 4
                types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return start.repartition(tasks, "path", "start").mapInArrow(textops.tidied(work), RECORD)
