"""From raw documents to packed training sequences: quality, toxicity, near-duplicates, repeated passages, packing.

Every stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of ``documents``. A stage called by itself leaves the session
with small Arrow batches (``small_batches``), which its table needs when it is written.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulake.llm import packing, quality, simhash, substring, toxicity
from emulake.llm.common import fresh, same_batches, small_batches, store


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more; without labels all stay."""
    small_batches(spark)
    model = quality.fit_quality(quality.document_statistics(docs), _labels(spark, sf_dir))
    return quality.keep_good(docs, model)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; without labels all stay."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, _labels(spark, sf_dir)))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints link (3-word shingles, at most 2 differing bits), the one with the smallest doc_id."""
    small_batches(spark)
    return simhash.drop_near_duplicates(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier one has; n_chars follows the text where it is known."""
    small_batches(spark)
    out = substring.drop_repeated(docs, spans=fresh(docs, "removed"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("simhash near-dedup", one_of_near_copies),
    ("substring dedup", without_repeats),
    ("best-fit packing", packed),
]

#: No stage but the last two has a form in SQL, so the pipeline is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with same_batches(spark):
        for name, stage in STAGES:
            docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
