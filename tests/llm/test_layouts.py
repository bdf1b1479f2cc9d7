"""Every operator over one partition, over a partition for each row, and with every row twice."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from undula.llm import bpe, decontamination, embedding_dedup, lm_score, ngram_join, quality, ranked_search, secret_scan, substring_dedup, token_files, toxicity, warc
from undula.llm.divergence import divergences
from undula.llm.shared import kept, scratch

LINE = " ".join(f"word{k}" for k in range(60))
KEY = 'token = "0123456789abcdef0123456789abcdef01234567"'
TEXTS = [LINE, LINE, f"{LINE} more", None, "", "some words only", f"text with {KEY} in it", f"start {LINE[:200]} end", "an !diot wrote this", "idiot again", "a fine day", "a good day"]
DOCS = [(i, t, ("en", "de", None)[i % 3], f"s{i % 2}", 1) for i, t in enumerate(TEXTS)]
ITEMS = [(7, " ".join(f"word{k}" for k in range(5, 20))), (8, "some words only")]
VECTORS = [(i, [1.0, 0.01 * (i % 4), 0.0] if i % 5 else [0.0, 0.0, 1.0], 1) for i in range(12)]
PAGES = [(i, f"u{i}", "<p>" + "x" * (200 if i % 3 else i) + "</p>") for i in range(12)]


def op1(spark, docs):
    return ngram_join.join(spark, docs).select("doc_id", "n_shingles", "component_id")


def op2(spark, docs):
    return bpe.decode(bpe.encode(spark, docs)).select("doc_id", "ids", "text")


def op3(spark, docs):
    labels = spark.createDataFrame([(i, int(i in (8, 9))) for i in range(12)], "doc_id long, toxic int")
    return toxicity.score(spark, docs.select("doc_id", "text"), toxicity.train(docs.dropDuplicates(), labels)).select("doc_id", F.round("score", 6).alias("score"))


def op5(spark, docs):
    return secret_scan.findings(spark, docs).where("is_secret").select("doc_id", "start", "end", "value", "score")


def op6(spark, docs):
    return decontamination.scan(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).select("doc_id", "n_words", "n_hit", "items")


def op8(spark, docs):
    found = quality.resample(spark, docs, spark.createDataFrame([(0,), (10,), (11,)], "doc_id long"), 1.0)
    return found.select(*[c for c in found.columns if c in ("doc_id", "weight", "kept")])


def op9(spark, docs):
    return token_files.read(token_files.write(spark, docs))


def op10(spark, docs):
    return substring_dedup.dedup_substrings(spark, docs, filter_bits=16)


def op11(spark, docs):
    return lm_score.score(spark, docs).select("doc_id", "held_out", "n_tokens", "n_known", F.round("score", 6).alias("score"))


def op12(spark, docs):
    return ranked_search.search(spark, ranked_search.build(spark, docs), spark.createDataFrame(ITEMS, "item_id long, text string"))


def op13(spark, docs):
    return divergences(spark, docs)


#: What a row that is in the table twice gives: both rows, one row for the document, or counts of its own.
TWICE = {op1: None, op2: "each", op3: None, op5: None, op6: "one", op8: None, op9: None, op10: "each", op11: None, op12: None, op13: None}


def found(spark, make, rows, partitions, kind="doc_id long, text string, lang string, source string, h int"):
    table = spark.createDataFrame(spark.sparkContext.parallelize(rows, partitions), kind)
    with scratch(spark):
        return sorted(map(repr, kept(spark, make(spark, table), "layout").collect()))


@pytest.mark.parametrize("make", TWICE, ids=lambda f: f.__name__)
def test_documents(spark, make):
    one = found(spark, make, DOCS, 1)
    assert one == found(spark, make, DOCS[::-1], len(DOCS)) and one
    twice = found(spark, make, DOCS * 2, 2 * len(DOCS))
    assert twice == found(spark, make, DOCS * 2, 1)
    if TWICE[make] == "each":
        assert twice == sorted(one * 2)
    if TWICE[make] == "one":
        assert len(twice) == len(one)


def test_vectors_and_pages(spark):
    vectors = lambda spark, df: embedding_dedup.near_duplicates(spark, df)
    kind = "vec_id long, embedding array<float>, label int"
    assert found(spark, vectors, VECTORS, 1, kind) == found(spark, vectors, VECTORS[::-1], 12, kind)
    pages = lambda spark, df: warc.read(spark, warc.write(spark, df)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    kind = "page_id long, url string, html string"
    assert found(spark, pages, PAGES, 1, kind) == found(spark, pages, PAGES[::-1], 12, kind)
