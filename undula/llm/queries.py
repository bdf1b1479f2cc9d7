"""The queries opN_<name> of this subpackage: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import join

    return join(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import decode, encode

    found = decode(encode(spark, table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.expr("length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(spark, docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read, write

    return read(spark, write(spark, table(spark, sf_dir, "pages"))).drop("url")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import findings

    found = findings(spark, table(spark, sf_dir, "documents"))
    return found.where("is_secret").select("doc_id", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), F.sha2("value", 256).alias("value_sha256"), "score")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import scan

    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import resample

    labels = table(spark, sf_dir, "labels").where("quality is not null")
    share = labels.agg(F.avg("quality")).first()[0] or 0.0
    return resample(spark, table(spark, sf_dir, "documents"), labels.where("quality = 1").select("doc_id"), share)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read, write

    return read(write(spark, table(spark, sf_dir, "documents")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    return dedup_substrings(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm_score
    from .shared import kept, scratch

    with scratch(spark):
        return kept(spark, lm_score.score(spark, table(spark, sf_dir, "documents")), "scores", stays=True)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ranked_search
    from .shared import kept, scratch

    with scratch(spark):
        index = ranked_search.build(spark, table(spark, sf_dir, "documents"))
        return kept(spark, ranked_search.search(spark, index, table(spark, sf_dir, "benchmark")), "ranked", stays=True)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergences

    return divergences(spark, table(spark, sf_dir, "documents"))


OPERATORS = (op1_ngram_jaccard_join, op2_bpe, op3_toxicity, op4_warc, op5_secret_scan, op6_decontamination, op7_embedding_dedup, op8_quality, op9_token_files, op10_substring_dedup, op11_lm_score, op12_ranked_search, op13_source_divergence)
QUERIES = {f.__name__: f for f in OPERATORS}
ORACLE_SQL = {
    "op1_ngram_jaccard_join": oracle.OP1,
    "op4_warc": oracle.OP4,
    "op6_decontamination": oracle.OP6,
    "op7_embedding_dedup": oracle.OP7,
    "op10_substring_dedup": oracle.OP10,
    "op12_ranked_search": oracle.OP12,
    "op13_source_divergence": oracle.OP13,
}
