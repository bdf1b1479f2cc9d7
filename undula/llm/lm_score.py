"""Scores of whole texts under a language model that is learned from a part of them.

The model is context-tree weighting over bytes (context_tree.py): estimates of contexts of 0 to DEPTH bytes
are mixed by their weights, which gives a text's code length byte by byte.  A unigram model of words stands
beside it for comparison.

1. tasks count every (context, byte) and every word of all texts, and how often it occurs in those learned
   from; Spark sums the counts by key;
2. counts are dealt by their contexts' nearest SPLIT bytes, a run of at most 2^24 keys whatever the corpus.
   Each run is weighted from its deepest contexts up; sums by shorter context go to the driver, a table of
   at most 255 * (1 + 2^8 + 2^16) nodes, which is mixed from the root down and broadcast;
3. each run is mixed further down, which gives one probability for each (context, byte) of the corpus;
4. the most frequent keys (at most FREQUENT and WORDS of them) are broadcast; tasks sum what they know of a
   text and hand on its other keys with their numbers, which are joined with their values by key.

The counts grow with the input, and no task holds more than a run, the bounded tables and a slice of text.
Words are known by 64-bit hashes; equal hashes count as equal words.

Defined cases: a null text is scored as an empty one, which has an end only; rows that share a doc_id are
scored each and learned from each; rows without a doc_id are scored, marked as held out and never learned
from; with nothing to learn from, every byte has 2^-8; texts of any length are learned and scored whole;
further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_tree, textops
from .shared import kept

DEPTH = 5
#: Keys of contexts and of words whose values are broadcast.
FREQUENT, WORDS = 1 << 20, 1 << 19
#: Distinct keys that a task holds before it hands them on; rows of a batch.
HELD, ROWS = 1 << 21, 1 << 18
GRAM, WORD, END = 0, 1, 2


def held_out() -> Column:
    """Rows that are scored but not learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(True))


def _slices(column, depth: int):
    """(first row, row after the last, pairs (keys, rows) of bytes, (hashes, rows) of words) of each slice."""
    for lo, hi, buf, offsets in textops.slices(column):
        starts, ends, first = textops.words(buf, offsets)
        words = textops.hashes(buf, starts, ends, lower=True), np.repeat(np.arange(hi - lo), np.diff(first))
        yield lo, hi, context_tree.keys(textops.LOWER[buf], offsets, depth), words


class _Tally:
    """Counts of keys, in all rows and in those learned from, until HELD distinct ones are there."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.size = kind, [], 0

    def add(self, key: np.ndarray, learned: np.ndarray) -> Iterator[pa.RecordBatch]:
        for mask in (True, False):
            own, times = np.unique(key[learned == mask], return_counts=True)
            self.parts.append((own, times * int(mask), times))
            self.size += len(own)
        if self.size > 2 * HELD:
            part = self.merged()
            self.parts, self.size = [part], len(part[0])
            if self.size > HELD:
                yield from self.flush()

    def merged(self) -> tuple[np.ndarray, ...]:
        return context_tree.summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            key, n, times = self.merged()
            self.parts, self.size = [], 0
            for lo in range(0, len(key), ROWS):
                part = slice(lo, lo + ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[part]), self.kind, np.int8)), pa.array(key[part].view(np.int64)), pa.array(n[part]), pa.array(times[part])], names=["kind", "key", "n", "times"])


def counts(docs: DataFrame, depth: int) -> DataFrame:
    """Rows (kind, key, n, times) of rows (held_out, text): occurrences in texts learned from, and in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words, ends = (_Tally(kind) for kind in (GRAM, WORD, END))
        for batch in batches:
            learned = ~batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, pairs, (h, row) in _slices(batch.column(1), depth):
                own = learned[lo:hi]
                for key, at in pairs:
                    yield from grams.add(key, own[at])
                yield from words.add(h, own[row])
                yield from ends.add(np.zeros(hi - lo, np.uint64), own)
        for tally in (grams, words, ends):
            yield from tally.flush()

    rows = docs.mapInArrow(textops.tidied(count), "kind byte, key long, n long, times long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))


def _runs(batches: Iterator[pa.RecordBatch], depth: int, work: Callable[..., pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hands sorted rows (key, n, times) on in whole runs of equal first bytes."""
    shift = 8 * (depth - context_tree.SPLIT) + 8
    held: list[np.ndarray] = []

    for batch in batches:
        held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]))
        if sum(x.shape[1] for x in held) >= ROWS:
            rows = np.concatenate(held, 1)
            end = int(np.searchsorted(rows[0] >> shift, rows[0, -1] >> shift))  # the last run may go on
            held = [rows[:, end:]]
            if end:
                yield work(*rows[:, :end])
    if held:
        rows = np.concatenate(held, 1)
        if rows.shape[1]:
            yield work(*rows)


def values(spark: SparkSession, counted: DataFrame, depth: int) -> DataFrame:
    """Rows (kind, key, times, value): log10 of the probability of a context's byte; a word's count."""
    shift = 8 * (depth - context_tree.SPLIT) + 8
    run = F.shiftright("key", shift)
    grams = counted.where(F.col("kind") == GRAM).select("key", "n", "times").repartition(run).sortWithinPartitions("key")

    def up(key: np.ndarray, n: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        parts = [context_tree.levels(key, n, depth, decision)[0].shorter() for decision in range(8)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["id", "zeros", "ones", "longer"])

    sums = grams.mapInArrow(textops.tidied(lambda b: _runs(b, depth, up)), "id long, zeros long, ones long, longer double")
    short = sums.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "longer")]).toArrow()
    mixture = spark.sparkContext.broadcast(context_tree.Mixture(*(short[c].to_numpy() for c in short.column_names)))

    def down(key: np.ndarray, n: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        value = context_tree.log10_probabilities(key, n, depth, mixture.value)
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(key), np.int8)), pa.array(key), pa.array(times), pa.array(value)], names=["kind", "key", "times", "value"])

    made = grams.mapInArrow(textops.tidied(lambda b: _runs(b, depth, down)), "kind byte, key long, times long, value double")
    return made.unionByName(counted.where(F.col("kind") == WORD).select("kind", "key", "times", F.col("n").cast("double").alias("value")))


class Lookup:
    """Values of known keys.  A slot of a table names one key, the most frequent that falls there; others
    are searched."""

    BITS = 22

    def __init__(self, key: np.ndarray, value: np.ndarray, times: np.ndarray):
        order = np.argsort(key)
        self.key, self.value = key[order], value[order]
        self.slot = np.zeros(1 << self.BITS, np.int32)
        by_times = np.argsort(times[order], kind="stable")
        self.slot[self._of(self.key[by_times])] = by_times

    def _of(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether known)."""
        if not len(self.key):
            return np.zeros(len(key)), np.zeros(len(key), bool)
        at = self.slot[self._of(key)]
        known = self.key[at] == key
        rest = np.flatnonzero(~known)
        at[rest] = np.minimum(np.searchsorted(self.key, key[rest]), len(self.key) - 1)
        known[rest] = self.key[at[rest]] == key[rest]
        return self.value[at], known


def _frequent(table: DataFrame, kind: int, limit: int) -> tuple[np.ndarray, ...]:
    """(key, value, times) of the keys of a kind that occur at least 2^e times, e the least for which they
    are no more than limit."""
    power = F.floor(F.log2("times")).cast("int")
    sizes = dict(table.where(F.col("kind") == kind).groupBy(power.alias("e")).count().collect())  # at most 63 rows
    total, least = 0, max(sizes, default=0) + 1
    for e in sorted(sizes, reverse=True):
        total += sizes[e]
        if total > limit:
            break
        least = e
    found = table.where((F.col("kind") == kind) & (F.col("times") >= F.lit(2**least))).select("key", "value", "times").toArrow()
    return found["key"].to_numpy().view(np.uint64), found["value"].to_numpy(), found["times"].to_numpy()


def score(spark: SparkSession, docs: DataFrame, held: Column | None = None, depth: int = DEPTH, frequent: int = FREQUENT, words: int = WORDS) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of rows (doc_id, text);
    held says which rows are not learned from.  Run inside `scratch`."""
    docs = docs.select("doc_id", (held_out() if held is None else held).alias("held_out"), "text")
    counted = kept(spark, counts(docs.select("held_out", "text"), depth), "counts")
    tokens = counted.where(F.col("kind") != GRAM).agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v"), F.sum(F.when(F.col("kind") == END, F.col("n"))).alias("ends")).first()
    n, v, ends = tokens.n or 0, tokens.v, tokens.ends or 0
    table = kept(spark, values(spark, counted, depth), "values")
    shared = spark.sparkContext.broadcast((_frequent(table, GRAM, frequent), _frequent(table, WORD, words)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_grams, of_words = (Lookup(*part) for part in shared.value)
        number = TaskContext.get().partitionId() << 33
        names = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "kind", "key", "times"]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int8(), pa.int64(), pa.int64()]

        def made(size: int, **given) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(size, t) for c, t in zip(names, kinds, strict=True)], names=names)

        def others(kind: int, row: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Keys of rows that are not broadcast, each once with its number."""
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            begin = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]))) if len(row) else row
            if len(begin):
                yield made(len(begin), row=number + row[begin].astype(np.int64), kind=np.full(len(begin), kind, np.int8), key=key[begin].view(np.int64), times=np.diff(np.append(begin, len(row))))

        for batch in batches:
            for lo, hi, pairs, (h, row) in _slices(batch.column(2), depth):
                size = hi - lo
                total = np.zeros(size)
                for key, at in pairs:
                    value, known = of_grams.find(key)
                    total += np.bincount(at[known], weights=value[known], minlength=size)
                    yield from others(GRAM, at[~known], key[~known])
                count, known = of_words.find(h)
                base = np.bincount(row[known], weights=np.log10(count[known] + 0.5), minlength=size) + np.log10(ends + 0.5)
                seen = np.bincount(row[known], weights=count[known] > 0, minlength=size).astype(np.int64) + int(ends > 0)
                yield from others(WORD, row[~known], h[~known])
                yield made(size, row=number + np.arange(size), doc_id=batch.column(0).slice(lo, size), held_out=batch.column(1).slice(lo, size), n_tokens=np.bincount(row, minlength=size) + 1, known=seen, base=base, score=total)
                number += size

    parts = kept(spark, docs.mapInArrow(textops.tidied(look), "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, kind byte, key long, times long"), "parts")
    times, value = F.col("parts.times"), F.col("value")
    rest = parts.where("kind is not null").select("row", "kind", "key", "times").alias("parts").join(table.select("kind", "key", "value"), ["kind", "key"])
    of = lambda kind, v: F.coalesce(F.sum(F.when(F.col("kind") == kind, v)), F.lit(0))
    rest = rest.groupBy("row").agg(of(GRAM, times * value).alias("more_score"), of(WORD, times * F.log10(value + 0.5)).alias("more_base"), of(WORD, F.when(value > 0, times)).alias("more_known"))
    whole = parts.where("kind is null").join(rest, "row", "left").na.fill(0, ["more_score", "more_base", "more_known"])
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more_base") - F.col("n_tokens") * F.log10(F.lit(n + 0.5 * (v + 1)))).alias("base_score"), (F.col("score") + F.col("more_score")).alias("score"),
    )
