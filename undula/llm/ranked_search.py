"""Ranked lexical search over a sharded index by Block-Max WAND.

1. one pass counts the documents with terms (N) and all terms (L), which fix a document's length factor m;
2. tasks write shards of about SHARD bytes of text to the shared folder: postings in bit-packed blocks of
   fixed size, each with its last document and its greatest impact (blockmax.py);
3. a query's document frequencies are summed over the shards; they give its terms' weights;
4. every shard is searched for every query: pointers move over the blocks' ends, intervals whose bound is
   under the k-th best score so far are passed over before any of their blocks is decompressed, and the k
   best of a shard go on.  A rank by query keeps k of each task before the exchange.

Queries are broadcast in bundles of about BUNDLE terms, so what a task holds is one shard and one bundle.
Words are known by 64-bit hashes; equal hashes count as equal words.

Defined cases: a null or empty text, and one without terms, is in no result and not in N; a query without
terms has no result; rows that share a doc_id are documents each and are reported each, rows without one
come last among equals; queries that repeat are answered each; texts of any length are indexed whole;
further columns are ignored; empty tables give an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import fresh
from . import textops
from .blockmax import Shard, encode
from .shared import kept, open_store, passing

#: Bytes of text in a shard, terms in a bundle of queries, tasks of a search.
SHARD, BUNDLE, TASKS = 1 << 25, 1 << 18, 1 << 15
_FOUND = "query long, doc_id long, score long"


@dataclass(frozen=True)
class Index:
    """Shards as rows (file, start, size), and the counts that scores need."""

    shards: DataFrame
    documents: int
    terms: int


def _counts(docs: DataFrame) -> tuple[int, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for _, _, buf, offsets in textops.slices(batch.column(0)):
                size = np.diff(textops.words(buf, offsets, textops.ALNUM_WORD)[2])
                n, total = n + int((size > 0).sum()), total + int(size.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])

    row = docs.select("text").mapInArrow(textops.tidied(count), "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return row.n or 0, row.total or 0


def _postings(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(size of each row in terms, term, row, occurrences) of a slice."""
    starts, ends, first = textops.words(buf, offsets, textops.ALNUM_WORD)
    size = np.diff(first)
    h, row = textops.hashes(buf, starts, ends, lower=True), np.repeat(np.arange(len(size)), size)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    begin = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, np.int64)
    return size, h[begin], row[begin], np.diff(np.append(begin, len(h)))


def build(spark: SparkSession, docs: DataFrame) -> Index:
    """Writes the index of rows (doc_id, text).  Its files go with the `scratch` around it."""
    n, total = _counts(docs)
    folder = passing(fresh(spark, "index"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = None
        held: list[tuple[np.ndarray, ...]] = []
        documents, size, rows = 0, 0, 0
        places: list[tuple[int, int]] = []

        def flush() -> None:
            nonlocal out, name, documents, size
            if out is None:
                name = f"{folder}/{uuid.uuid4().hex}.index"
                store, at = open_store(name)
                store.create_dir(at.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(at)
            ids, none, m, term, doc, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            raw = encode(ids, none, m, term, doc, tf)
            out.write(raw)
            places.append((sum(x[1] for x in places), len(raw)))
            documents = size = 0

        for batch in batches:
            key = batch.column(0)
            none, ids = key.is_null().to_numpy(zero_copy_only=False), key.fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi, buf, offsets in textops.slices(batch.column(1)):
                length, term, doc, tf = _postings(buf, offsets)
                m = 75 + 25 * length * n // total if total else length
                held.append((ids[lo:hi], none[lo:hi], m, term, doc + documents, tf))
                documents, size, rows = documents + hi - lo, size + len(buf), rows + hi - lo
                if size >= SHARD:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(places)), pa.array([a for a, _ in places], pa.int64()), pa.array([b for _, b in places], pa.int64())], names=["file", "start", "size"])

    shards = kept(spark, docs.select("doc_id", "text").mapInArrow(textops.tidied(write), "file string, start long, size long"), "shards")
    return Index(shards, n, total)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for file, start, size in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            store, at = open_store(file)
            with store.open_input_file(at) as f:
                yield Shard(f.read_at(size, start))


def _queries(items: DataFrame) -> DataFrame:
    """Rows (query, item_id, terms, times) of items with terms, numbered."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, hi, buf, offsets in textops.slices(batch.column(1)):
                _, term, row, times = _postings(buf, offsets)
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                own = np.flatnonzero(np.diff(first))
                lists = lambda v, kind: pa.array([v[first[i] : first[i + 1]] for i in own], pa.list_(kind))
                yield pa.RecordBatch.from_arrays([pa.array(number + own), batch.column(0).take(pa.array(lo + own)), lists(term.view(np.int64), pa.int64()), lists(times, pa.int64())], names=["query", "item_id", "terms", "times"])
                number += hi - lo

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(textops.tidied(work), "query long, item_id long, terms array<long>, times array<long>")


def _searched(spark: SparkSession, index: Index, shards: DataFrame, bundle: DataFrame, k: int) -> DataFrame:
    """Rows (query, doc_id, score): the best of every shard for the queries of one bundle."""
    table = bundle.select("query", "terms", "times").toArrow()  # about BUNDLE terms
    size = table["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    first = np.append(0, np.cumsum(size))
    term, times = (table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("terms", "times"))
    term = term.view(np.uint64)
    query, asked = table["query"].to_numpy(), textops.distinct(term)
    known = spark.sparkContext.broadcast(asked)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.value), np.int64)
        for shard in _read(batches):
            total += shard.frequencies(known.value)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["at", "df"])

    found = shards.mapInArrow(textops.tidied(frequencies), "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(asked), np.int64)
    df[found["at"].to_numpy()] = found["df"].to_numpy()
    weight = np.floor(1000 * np.log((2 * index.documents + 2) / (2 * df + 1).astype(np.float64))).astype(np.int64)
    weight[df == 0] = 0
    known.unpersist()
    plan = spark.sparkContext.broadcast((query, first, term, times * weight[np.searchsorted(asked, term)]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, first, term, weight = plan.value
        for shard in _read(batches):
            rows = [(q, *shard.search(term[a:b], weight[a:b], k)) for q, a, b in zip(query.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True)]
            doc, score = (np.concatenate([r[c] for r in rows]) for c in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query, [len(r[1]) for r in rows])), pa.array(shard.ids[doc], mask=shard.none[doc]), pa.array(score)], names=["query", "doc_id", "score"])

    return shards.mapInArrow(textops.tidied(search), _FOUND)


def search(spark: SparkSession, index: Index, items: DataFrame, k: int = 20) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the k best documents of each item."""
    queries = kept(spark, _queries(items), "queries")
    sums = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    bundles = -(-sums // BUNDLE)
    shards = index.shards.repartition(max(1, min(index.shards.count(), TASKS)))
    parts = [_searched(spark, index, shards, queries.where(F.pmod(F.xxhash64("query"), F.lit(bundles)) == b), k) for b in range(bundles)]
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(queries.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
