"""A training-corpus pipeline: quality, exact dedup, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the
next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborframe.llm import exact_dedup, neardup, packing, pii, quality
from arborframe.llm.common import few, written
from arborframe.llm.queries import vocabulary
from arborframe.session import prepare

#: Dropped rows that are broadcast at most, by id and digest; more are joined by a shuffle.
FEW_ROWS = 1_000_000


def _without(docs: DataFrame, rows: DataFrame, digest: Column) -> DataFrame:
    """docs without those of rows (doc_id, kept, text_sha256) that are not kept; digest: the same of docs' texts.

    An id alone does not tell rows apart: it may be null or repeated. Rows alike in id and digest are kept or not alike.
    """
    dropped = rows.where("NOT kept").select(F.col("doc_id").alias("gone"), F.unhex("text_sha256").alias("gone_sha256")).distinct()
    gone = few(written(dropped, "gone"), FEW_ROWS)
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")) & (F.unhex(digest) == F.col("gone_sha256")), "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    prepare(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id stays."""
    prepare(spark)
    return _without(docs, exact_dedup.exact_dedup(docs), exact_dedup.digest_of())


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8), the document with the smallest id stays."""
    prepare(spark)
    return _without(docs, neardup.near_duplicates(docs, digest=True), neardup.text_digest())


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become their kind in angle brackets; every document stays."""
    prepare(spark)
    return pii.mask(docs, pii.trained())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: where each document's pieces lie."""
    prepare(spark)
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("personal data", mask_personal_data),
    ("packing", pack_sequences),
]

#: Not expressible in SQL: a classifier, sketches, a network and packing. Tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result over the documents in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
