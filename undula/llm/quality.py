"""Quality selection by importance resampling.

Two bag-of-n-grams models over hashed words and word pairs, one of target texts and one of all texts,
give each document its log importance: the sum over its n-grams of log p_target / p_raw.  Sampling k
documents without replacement with probabilities in proportion is adding Gumbel noise to the log
weights and keeping the k largest (Gumbel top-k).  The noise is a hash of doc_id and seed, so a rerun of
a lost task draws the same.

Counts cover every whole text; the target model is fitted on a bounded sample of labelled rows (SAMPLE).
The k-th largest key is found by histograms of fixed size over ever smaller ranges, so no more than a
few thousand rows reach the driver.

Defined cases: null and empty texts have log weight 0; texts of any length count whole; rows that share a
doc_id are weighed each, with the same noise; ties in the key go to the smaller doc_id;
null labels aren't used; without target rows all weights are 0 and the sample is uniform; further
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops
from .shared import kept

BITS = 16
SAMPLE = 50_000
#: Occurrences added to what is seen and to what is expected: rare n-grams weigh little.
SMOOTHING = 1.0
BINS, FEW = 1024, 2048


def _grams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, buckets, first): the n-grams of row i are buckets[first[i]:first[i + 1]]."""
    for lo, hi, buf, offsets in textops.slices(column):
        starts, ends, first = textops.words(buf, offsets)
        word = textops.hashes(buf, starts, ends, lower=True)
        valid, row = textops.window_rows(first, 2)
        both = np.concatenate([word, textops.windows(word, 2)[valid]])
        rows = np.concatenate([np.repeat(np.arange(hi - lo), np.diff(first)), row[valid]])
        order = np.argsort(rows, kind="stable")
        yield lo, hi, (both >> np.uint64(64 - BITS)).astype(np.int64)[order], np.searchsorted(rows[order], np.arange(hi - lo + 1))


def fit(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """log p_target / p_raw of every bucket; target holds the doc_id of target texts."""
    target = target.where("doc_id is not null").select("doc_id").distinct()
    n = target.count()
    chosen = target if n <= SAMPLE else target.where(F.pmod(F.xxhash64("doc_id", F.lit("target")), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / n))
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen.withColumn("is_target", F.lit(True))), "doc_id", "left").select("text", F.coalesce("is_target", F.lit(False)).alias("is_target"))  # bounded by SAMPLE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, own = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            is_target = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, buckets, first in _grams(batch.column(0)):
                raw += np.bincount(buckets, minlength=1 << BITS)
                own += np.bincount(buckets[np.repeat(is_target[lo:hi], np.diff(first))], minlength=1 << BITS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(own[at])], names=["bucket", "raw", "own"])

    raw, own = np.zeros(1 << BITS), np.zeros(1 << BITS)
    # one row for each of 2 ** BITS buckets
    for r in marked.mapInArrow(textops.tidied(count), "bucket int, raw long, own long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("own").alias("own")).collect():
        raw[r.bucket], own[r.bucket] = r.raw, r.own
    if not own.sum():
        return np.zeros(1 << BITS)
    return np.log((own + SMOOTHING) / (raw * (own.sum() / raw.sum()) + SMOOTHING))


def weigh(spark: SparkSession, docs: DataFrame, log_ratio: np.ndarray) -> DataFrame:
    """Rows (doc_id, n_grams, log_weight)."""
    shared = spark.sparkContext.broadcast(log_ratio)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buckets, first in _grams(batch.column(1)):
                total = np.concatenate([[0.0], np.cumsum(shared.value[buckets])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(total[first[1:]] - total[first[:-1]])], names=["doc_id", "n_grams", "log_weight"])

    return docs.select("doc_id", "text").mapInArrow(textops.tidied(work), "doc_id long, n_grams long, log_weight double")


def kth_largest(df: DataFrame, key: Column, k: int):
    """(value, wanted): the k-th largest key, and how many of the rows that hold it are among the k."""
    n, low, high = df.agg(F.count("*"), F.min(key), F.max(key)).first()
    rows = df
    while n > FEW and high > low:  # rows hold keys from low to high, of which the k largest are wanted
        place = F.least(F.lit(BINS - 1), F.floor((key - low) / (high - low) * BINS))
        bins = {r["place"]: r for r in rows.groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()}
        for p in sorted(bins, reverse=True):
            if k <= bins[p]["n"]:
                break
            k -= bins[p]["n"]
        n, low, high = bins[p]["n"], bins[p]["low"], bins[p]["high"]
        rows = df.where(key.between(low, high))
    if high == low:
        return low, k
    keys = sorted((r[0] for r in rows.select(key).collect()), reverse=True)
    return keys[k - 1], k - sum(x > keys[k - 1] for x in keys)


def largest(df: DataFrame, key: Column, tie: Column, k: int) -> Column:
    """Holds for the k rows of largest key, ties to the smaller `tie`."""
    if k <= 0:
        return F.lit(False)
    value, wanted = kth_largest(df, key, k)
    least, _ = kth_largest(df.where(key == value), -tie, wanted)
    return (key > value) | ((key == value) & (-tie >= least))


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, share: float, seed: int = 3) -> DataFrame:
    """Rows (doc_id, n_grams, log_weight, key, kept) of all documents; round(share * n) are kept."""
    weighed = weigh(spark, docs, fit(docs, target))
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = kept(spark, weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))), "weighed")
    return keyed.withColumn("kept", largest(keyed, F.col("key"), F.col("doc_id"), round(share * keyed.count())))
