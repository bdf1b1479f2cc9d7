"""Benchmark decontamination with DataFrame functions only.

Words are the lower-cased runs of ASCII letters, digits and non-ASCII characters.  A benchmark item
gives its windows of `window` words (an item of fewer words is one window).  Windows are hashed over
their words' hashes, and the distinct ones are broadcast as a hash set.  A scan hashes each document's
words once, rolls over its windows of every size that the benchmark has, probes the set, and verifies
each hit in the document's own words, so that it is always an exact occurrence.

A broadcast holds at most MAX_WINDOWS windows of MAX_CHARACTERS; a larger benchmark is dealt by hash
into several, each probed by a scan of its own.

Defined cases: null and empty texts have no words and no hits; items without words are never found;
equal windows of several items count for each of them; texts of any length are scanned whole; rows with
a null doc_id are dropped from the result; rows that share a doc_id are one row of the result, with the
hits of all and the words of the longest; further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_WINDOWS, MAX_CHARACTERS = 500_000, 64 << 20


def words(text: str | Column) -> Column:
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.array_remove(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), SEPARATORS), "")


def hashed(run: str) -> str:
    """The hash of an array of word hashes (SQL)."""
    return f"xxhash64({run})"


def windows(bench: DataFrame, window: int = 10) -> DataFrame:
    """Rows (h, size, run, items): the distinct windows of words, with their hash and the items that hold them."""
    item = bench.select("item_id", words("text").alias("words")).where("size(words) > 0")
    cut = item.select("item_id", F.explode(F.expr(f"transform(sequence(0, greatest(size(words) - {window}, 0)), s -> slice(words, s + 1, {window}))")).alias("run"))
    runs = cut.groupBy("run").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    return runs.select(F.expr(hashed("transform(run, w -> xxhash64(w))")).alias("h"), F.size("run").alias("size"), "run", "items")


def hits(docs: DataFrame, known: DataFrame, sizes: list[int], how: str) -> DataFrame:
    """Rows (doc_id, n_words, hit): occurrences of known windows as (start, end, items); with how = left
    also a row without hit for each document."""
    each = docs.where("doc_id is not null").select("doc_id", words("text").alias("words"))
    each = each.select("doc_id", "words", F.expr("transform(words, w -> xxhash64(w))").alias("wh"))
    each = each.select("doc_id", "words", "wh", F.explode_outer(F.expr("if(size(words) > 0, sequence(0, size(words) - 1), null)")).alias("at"))
    # indices beyond the end give nulls, which hash like absent words; the verification rejects them
    rolling = [hashed(f"array({', '.join(f'get(wh, at + {k})' for k in range(n))})") for n in sizes]
    if len(rolling) == 1:
        each = each.withColumn("key", F.expr(rolling[0]))
    else:
        each = each.withColumn("key", F.explode(F.expr(f"array({', '.join(rolling)})")))
    near = each.join(F.broadcast(known), F.col("key") == F.col("h"), how)
    good = "h is not null and slice(words, at + 1, size) = run"
    near = near.where(good if how == "inner" else f"({good}) or at = 0 or at is null")
    return near.select("doc_id", F.size("words").alias("n_words"), F.expr(f"if({good}, struct(at as start, at + size as end, items), null)").alias("hit"))


def scan(docs: DataFrame, bench: DataFrame, window: int = 10) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, items, spans) of all documents: n_hit words lie inside
    occurrences of windows of items (sorted strings); spans are the occurrences (start, end)."""
    known = windows(bench, window)
    # at most `window` rows
    found = known.groupBy("size").agg(F.count("*").alias("n"), F.sum(F.expr("aggregate(run, 0L, (n, w) -> n + length(w))")).alias("characters")).collect()
    sizes = sorted(r["size"] for r in found) or [window]
    parts = max(1, -(-sum(r.n for r in found) // MAX_WINDOWS), -(-sum(r.characters for r in found) // MAX_CHARACTERS))
    near = None
    for k in range(parts):
        part = hits(docs, known if parts == 1 else known.where(F.pmod("h", F.lit(parts)) == k), sizes, "inner" if k else "left")
        near = part if near is None else near.unionByName(part)
    per_doc = near.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.collect_list("hit").alias("hits"))
    covered = F.expr(
        "aggregate(array_sort(transform(hits, x -> struct(x.start as start, x.end as end))), struct(0 as n, 0 as reach),"
        " (acc, x) -> struct(acc.n + greatest(0, x.end - greatest(acc.reach, x.start)) as n, greatest(acc.reach, x.end) as reach), acc -> acc.n)"
    )
    return per_doc.select("doc_id", F.col("n_words").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.expr("transform(hits, x -> x.items)")))).alias("items"), F.expr("transform(hits, x -> struct(x.start, x.end))").alias("spans"))


def remove_documents(docs: DataFrame, bench: DataFrame, window: int = 10) -> DataFrame:
    """Documents without any hit, with all their columns."""
    return docs.join(scan(docs, bench, window).where("n_hit > 0").select("doc_id"), "doc_id", "left_anti")


def remove_spans(docs: DataFrame, bench: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, text): words of documents with hits lose the hit spans and are joined by spaces;
    other documents keep their text."""
    found = scan(docs, bench, window).where("n_hit > 0").select("doc_id", "spans")
    left = F.expr("filter(words, (w, i) -> not exists(spans, s -> i >= s.start and i < s.end))")
    return docs.select("doc_id", "text").join(found, "doc_id", "left").withColumn("words", words("text")).select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(left, " ")).alias("text"))
