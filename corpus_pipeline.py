"""From raw documents to a sharded training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs of
the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.llm.decontamination import drop_contaminated
from chronopanel.llm.kd_shards import kd_shards
from chronopanel.llm.minhash import drop_near_duplicates
from chronopanel.llm.mixing import mixed_copies
from chronopanel.llm.quality_classifier import fit_on_labels, score_documents
from chronopanel.llm.registry import prepare, table
from chronopanel.session import materialize

N_SHARDS = 40


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, takes for good."""
    prepare(spark)
    model = fit_on_labels(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model, score_col="__score").filter(F.col("__score") >= 0.5).drop("__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingle sets are alike to 0.8 or more."""
    prepare(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a ``benchmark`` item."""
    prepare(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: none to three times."""
    prepare(spark)
    return mixed_copies(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document: doc_id, size, text_crc32, shard, slot."""
    prepare(spark)
    return kd_shards(docs, n_shards=N_SHARDS)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mixing", mixing),
    ("sharding", sharding),
]

# A trained model and hashed draws have no counterpart in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
