"""The registered query of each operator, over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswalk.llm import centroids, importance, katz, language, mixing, quality, toxicity, transport
from crosswalk.llm.boilerplate import main_text
from crosswalk.llm.common import table, train_rows, written
from crosswalk.llm.fingerprint import LEAST, fingerprints
from crosswalk.llm.near_dup import near_duplicates
from crosswalk.llm.packing import pack_documents
from crosswalk.llm.token_index import read_shards, write_shards


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = katz.scores(table(spark, sf_dir, "documents"), train_rows("doc_id", 7, 2), order=3)
    return rows.select("doc_id", (~F.col("trained_on")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"), least=LEAST)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), train_rows("doc_id", 5, 0))
    return toxicity.score(docs, model).select("doc_id", (~train_rows("doc_id", 5, 0)).alias("held_out"), "score", "predicted", "distance")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"),
        F.round("__weight", 6).alias("weight"), F.round("__probability", 6).alias("probability"), F.col("__sampled").alias("sampled"),
    )


def op6_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.digests(written(transport.store(table(spark, sf_dir, "documents")), "media"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0, capacity=2048)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = train_rows("doc_id", 3, 1)
    rows = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable)
    return rows.select("doc_id", (~usable).alias("held_out"), "score", "predicted")


def op10_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path, usable = table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), train_rows("doc_id", 3, 1)
    return language.identify(docs, language.fit(docs, usable, path), path).select("doc_id", (~usable).alias("held_out"), "lang_pred", "score")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return centroids.clustered(vectors, centroids.fit(vectors))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_katz": op1_katz,
    "op2_fingerprint": op2_fingerprint,
    "op3_toxicity": op3_toxicity,
    "op4_main_text": op4_main_text,
    "op5_mixing": op5_mixing,
    "op6_transport": op6_transport,
    "op7_packing": op7_packing,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_quality": op9_quality,
    "op10_token_index": op10_token_index,
    "op11_language": op11_language,
    "op12_centroids": op12_centroids,
    "op13_importance": op13_importance,
}
ORACLE: dict[str, str] = {"op5_mixing": mixing.sql(), "op12_centroids": centroids.sql(), "op13_importance": importance.sql()}
