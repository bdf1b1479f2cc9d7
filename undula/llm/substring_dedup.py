"""Exact substring deduplication over whole documents by fixed-block anchors.

A repeated run of `window` words always covers one whole block of `block` = window // 2 words that
starts at a multiple of `block` in the earlier document, wherever the run starts.  So:

1. index: every document's non-overlapping blocks are hashed into a fixed-size bitmap;
2. probe: every rolling block-long window of every document is looked up; those that pass are
   counted by hash, and the hashes of blocks that occur at a second place become anchors;
3. extend: each window of `window` words around an anchor is hashed as a whole.  A task keeps only
   the earliest place of each, so a passage that many documents share is one row per task, and one
   shuffle by window hash finds the earliest place of all.  Runs of windows that aren't the earliest
   are the maximal exact repeats;
4. the runs return to their documents and the words they cover are removed.

Window hashes have 64 bits of well mixed state; equal hashes count as equal word sequences.

Documents are named by doc_id and a hash of the text, and ordered by both; rows without a doc_id come
after all others.  So rows that repeat whole (same id, same text) are one document and keep the same
words, and rows that share an id but not the text are documents after each other.

Defined cases: a null or empty text has no words and keeps an empty text; texts of fewer than
`window` words are untouched; texts of any length are windowed whole; further columns, whatever their
names, are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bitfilter, textops

#: A task hands on what it has found after so many windows, which bounds its memory.
HELD = 1 << 21

#: What names a document: its place in order (doc_id, the greatest number where there is none) and a hash.
NAME = ["doc", "own"]


def named(docs: DataFrame, *columns: str) -> DataFrame:
    """(doc, own, the given columns)."""
    return docs.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("own"), *columns)


def _words(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(names as rows of two numbers, first word of each row, word hashes) of each slice of (doc, own, text)."""
    names = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1)
    for lo, hi, buf, offsets in textops.slices(batch.column(2)):
        starts, ends, first = textops.words(buf, offsets)
        yield names[lo:hi], first, textops.hashes(buf, starts, ends)


def _earliest(h: np.ndarray, name: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct places sorted by (hash, document, place), with a mark on the first of each hash."""
    order = np.lexsort((at, name[:, 1], name[:, 0], h))
    h, name, at = h[order], name[order], at[order]
    first = np.append(True, h[1:] != h[:-1])
    new = np.append(True, (name[1:] != name[:-1]).any(1) | (at[1:] != at[:-1])) | first
    return h[new], name[new], at[new], first[new]


def _runs_of(name: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, list[bytes]]:
    """(names of documents, their windows as merged [start, end) runs of words)."""
    if not len(at):
        return name, []
    order = np.lexsort((at, name[:, 1], name[:, 0]))
    name, at = name[order], at[order]
    begin = np.append(True, (name[1:] != name[:-1]).any(1) | (at[1:] > at[:-1] + n))
    last = np.append(np.flatnonzero(begin)[1:], len(at)) - 1
    owner, run = name[begin], np.stack([at[begin], at[last] + n], 1).astype("<i4")
    cuts = np.flatnonzero((owner[1:] != owner[:-1]).any(1)) + 1
    return owner[np.append(0, cuts)], [r.tobytes() for r in np.split(run, cuts)]


def repeated_runs(spark: SparkSession, docs: DataFrame, window: int = 20, filter_bits: int = 28) -> DataFrame:
    """Rows (doc, own, at, runs): the starts of windows that repeat an earlier place, and word ranges
    that do, as little-endian int32 pairs.  Together they are what a document repeats."""
    block, bits = window // 2, filter_bits
    docs = named(docs, "text")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[np.ndarray]:
            for batch in batches:
                for _, first, word in _words(batch):
                    valid, row = textops.window_rows(first, block)
                    yield textops.windows(word, block)[valid & ((np.arange(len(row)) - first[row]) % block == 0)]

        return bitfilter.places(blocks(), bits)

    indexed = spark.sparkContext.broadcast(bitfilter.build(spark, docs.mapInArrow(textops.tidied(index), bitfilter.SCHEMA), bits))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, first, word in _words(batch):
                valid, row = textops.window_rows(first, block)
                h = textops.windows(word, block)
                keep = np.flatnonzero(valid & bitfilter.has(indexed.value, h, bits))
                whole = (keep - first[row[keep]]) % block == 0
                h, back, n = np.unique(h[keep], return_inverse=True, return_counts=True)
                anchor = np.zeros(len(h), bool)
                anchor[back[whole]] = True
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8)), pa.array(anchor)], names=["h", "n", "anchor"])

    hits = docs.mapInArrow(textops.tidied(probe), "h long, n byte, anchor boolean").groupBy("h").agg(F.sum("n").alias("n"), F.max("anchor").alias("anchor")).where("n > 1 and anchor").select("h")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return bitfilter.places((b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches), bits)

    anchors = spark.sparkContext.broadcast(bitfilter.build(spark, hits.mapInArrow(textops.tidied(hashed), bitfilter.SCHEMA), bits))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        columns = ["h", *NAME, "at", "runs"]

        def flush() -> Iterator[pa.RecordBatch]:
            h, name, at, first = _earliest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            owner, runs = _runs_of(name[~first], at[~first], window)
            yield pa.RecordBatch.from_arrays([pa.array(textops.mix(owner[:, 1].astype(np.uint64)).view(np.int64)), pa.array(owner[:, 0]), pa.array(owner[:, 1]), pa.nulls(len(runs), pa.int32()), pa.array(runs, pa.binary())], names=columns)
            name = name[first]
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array(at[first].astype(np.int32)), pa.nulls(len(name), pa.binary())], names=columns)

        for batch in batches:
            for names, first, word in _words(batch):
                near = np.concatenate([[0], np.cumsum(bitfilter.has(anchors.value, textops.windows(word, block), bits))])
                valid, row = textops.window_rows(first, window)
                start = np.flatnonzero(valid)
                start = start[near[start + window - block + 1] > near[start]]
                if len(start):
                    held.append((textops.windows(word, window)[start], names[row[start]], start - first[row[start]]))
                if sum(len(x[0]) for x in held) > HELD:
                    yield from flush()
        if held:
            yield from flush()

    found = docs.mapInArrow(textops.tidied(extend), "h long, doc long, own long, at int, runs binary")
    # What a task settled by itself travels with its windows, under a hash of the document.  A row that is
    # in the table twice has one place twice: equal places have one rank.
    order = Window.partitionBy("h").orderBy(F.col("at").isNull(), *NAME, "at")
    late = found.withColumn("place", F.rank().over(order)).where("at is null or place > 1")
    return late.groupBy(*NAME).agg(F.collect_list("at").alias("at"), F.collect_list("runs").alias("runs"))


def dedup_substrings(spark: SparkSession, docs: DataFrame, window: int = 20, filter_bits: int = 28) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, text): each document with its later repeats removed; the
    words that stay are joined by one space."""
    both = named(docs, "doc_id", "text").join(repeated_runs(spark, docs, window, filter_bits), NAME, "left").select("doc_id", "text", "at", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in textops.slices(batch.column(1)):
                starts, ends, first = textops.words(buf, offsets)
                mark = np.zeros(int(first[-1]) + 1, np.int32)
                single, runs = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in (2, 3))
                for i in range(hi - lo):
                    at = np.array(single[i] or [], np.int64)
                    run = np.frombuffer(b"".join(runs[i] or []), "<i4").reshape(-1, 2)
                    np.add.at(mark, first[i] + np.concatenate([at, run[:, 0]]), 1)
                    np.subtract.at(mark, first[i] + np.concatenate([at + window, run[:, 1]]), 1)
                gone = np.cumsum(mark)[:-1] > 0
                kept = np.flatnonzero(~gone)
                lens = ends[kept] - starts[kept]
                # each kept word with one byte after it, which becomes the space
                out = np.full(int(lens.sum()) + len(kept), 0x20, np.uint8)
                base = np.cumsum(lens + 1) - (lens + 1)
                out[textops.spans(base, lens)] = buf[textops.spans(starts[kept], lens)]
                row_first = np.searchsorted(kept, first)
                edge = np.append(base, len(out))
                raw = out.tobytes()
                texts = [raw[edge[a] : max(edge[a], edge[b] - 1)].decode("utf-8", "replace") for a, b in zip(row_first[:-1], row_first[1:], strict=True)]
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(n - np.diff(row_first)), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    return both.mapInArrow(textops.tidied(cut), "doc_id long, n_words long, n_removed long, text string")
