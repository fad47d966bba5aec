"""The corpus pipeline: five stages over the table documents, each of which works on all that the one before it kept.

Columns of ``documents`` pass through unchanged; the last stage returns packed pieces. A stage keeps rows whose text is null or
empty unless its decision is against them, and treats rows that share an id as its operator says. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosswalk.llm import mixing, quality, toxicity
from crosswalk.llm.common import table, train_rows, written
from crosswalk.llm.near_dup import near_duplicates
from crosswalk.llm.packing import pack_documents
from crosswalk.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the compression-distance classifier calls toxic; it learns from the labels that op3 learns from."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), train_rows("doc_id", 5, 0))
    return toxicity.score(docs, model, carry=True).where("predicted = 0").select("row.*")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier scores below 0.5; it learns from the labels that op9 learns from."""
    return quality.classify(docs, table(spark, sf_dir, "labels"), train_rows("doc_id", 3, 1), carry=True).where("predicted = 1").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the smallest id, once. Rows without an id stay.

    Rows that share an id are one group, whatever their texts; the one whose text is first in order stays, so a lost executor changes nothing.
    """
    kept = near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("key"))
    of_id = Window.partitionBy("key").orderBy(F.col("row.text").asc_nulls_last(), F.xxhash64(F.to_json("row")))
    once = rows.where("key is not null").join(kept, F.col("key") == F.col("kept_id"), "left_semi").withColumn("n", F.row_number().over(of_id)).where("n = 1")
    return once.select("row.*").unionByName(rows.where("key is null").select("row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents with the probabilities that raking to source, language and topic shares gives them."""
    return mixing.select_mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of what is left into sequences of 2048."""
    return pack_documents(docs, tokenizer_path(), end_id=0, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: Trained classifiers and a tokenizer have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage-" + name.replace(" ", "-"))
    return docs
