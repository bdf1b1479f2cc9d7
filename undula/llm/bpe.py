"""Byte-level BPE encoding and decoding of whole tables.

1. Every task counts all its pretokens and hands on its most frequent ones (LISTED, a bounded table);
   the most frequent of all become the lexicon, a minimal acyclic transducer with the words' ids
   (lexicon.py), which Spark ships to the executors as a file and workers memory-map.
2. Tasks cut each slice of documents into pretokens, look the distinct ones up in the transducer,
   merge those it doesn't know exactly (bytebpe.py), and gather the documents' ids.

The lexicon only decides how ids are found, never which: any lexicon gives the same ids.

Defined cases: a null text is encoded as an empty one, to no ids; the special token's text becomes
its id, as in the tokenizers library; texts and words of any length are encoded whole, a word in time
of its length times its logarithm; rows that share a doc_id are encoded each; further columns are ignored;
empty tables give empty tables.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, lexicon, textops

#: Words a task hands on, and words of the lexicon.
LISTED, LEXICON = 1 << 14, 1 << 16
SLICE = 1 << 20


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _pretokens(column, limit: int = SLICE):
    """(first row, row after the last, bytes, starts, ends, first word of each row, distinct starts,
    distinct ends, which of them each word is)."""
    for lo, hi, buf, offsets in textops.slices(column, limit):
        starts, ends, first = bytebpe.pretokens(buf, offsets)
        at, which = textops.distinct_words(buf, starts, ends)
        yield lo, hi, buf, starts, ends, first, starts[at], ends[at], which


def frequent_words(docs: DataFrame) -> list[bytes]:
    """The LEXICON most frequent pretokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for batch in batches:
            for _, _, buf, _, _, _, starts, ends, which in _pretokens(batch.column(0)):
                times = np.bincount(which, minlength=len(starts))
                again = np.flatnonzero(times > 1)  # one-offs of a slice are the long tail
                raw = buf.tobytes()
                for a, b, n in zip(starts[again].tolist(), ends[again].tolist(), times[again].tolist(), strict=True):
                    word = raw[a:b]
                    total[word] = total.get(word, 0) + n
            if len(total) > 16 * LISTED:
                total = dict(sorted(total.items(), key=lambda x: -x[1])[: 4 * LISTED])
        best = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:LISTED]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.binary()), pa.array([n for _, n in best], pa.int64())], names=["word", "n"])

    top = docs.select("text").mapInArrow(textops.tidied(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(LEXICON)
    return [bytes(r.word) for r in top.select("word").collect()]


def build_lexicon(spark: SparkSession, docs: DataFrame, path: str) -> str:
    """Compiles the lexicon and ships it; returns the name that executors know it by."""
    words = sorted(frequent_words(docs))
    lens = np.array([len(w) for w in words], np.int64)
    ids, first = bytebpe.merger(path).encode(np.frombuffer(b"".join(words), np.uint8), np.cumsum(lens) - lens, np.cumsum(lens))
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    file = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)  # the driver serves it from here
    lexicon.write(file, words, [ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)])
    spark.sparkContext.addFile(file)
    return name


@cache
def _lexicon(name: str) -> lexicon.Lexicon:
    return lexicon.Lexicon(SparkFiles.get(name))


def encode_slices(column, path: str, name: str | None):
    """(first row, row after the last, ids, first): row i of the slice has ids first[i] to first[i + 1]."""
    merge = bytebpe.merger(path)
    known = _lexicon(name) if name else None
    for lo, hi, buf, _, _, row_first, starts, ends, which in _pretokens(column):
        number = known.find(buf, starts, ends) if known else np.full(len(starts), -1, np.int64)
        new = np.flatnonzero(number < 0)
        ids, first = merge.encode(buf, starts[new], ends[new])
        begin, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        begin[new], size[new] = first[:-1], np.diff(first)
        if known:
            old = np.flatnonzero(number >= 0)
            begin[old] = known.first[number[old]] + len(ids)
            size[old] = known.first[number[old] + 1] - known.first[number[old]]
            ids = np.concatenate([ids, known.ids])
        n = size[which]
        yield lo, hi, ids[textops.spans(begin[which], n)], np.concatenate([[0], np.cumsum(n)])[row_first]


def encode(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (doc_id, ids): ids as little-endian unsigned 32-bit integers."""
    path = path or vocabulary()
    name = build_lexicon(spark, docs, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ids, first in encode_slices(batch.column(1), path, name):
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([raw[4 * a : 4 * b] for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(textops.tidied(work), "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (doc_id, ids, text) of rows (doc_id, ids)."""
    path = path or vocabulary()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = bytebpe.merger(path)
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                rows = [np.frombuffer(x or b"", "<u4") for x in part.column(1).to_pylist()]
                first = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
                text = merge.decode(np.concatenate([*rows, np.zeros(0, "<u4")]).astype(np.int64), first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.decode() for x in text], pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(textops.tidied(work), "doc_id long, ids binary, text string")
