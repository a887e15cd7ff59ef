"""The corpus pipeline: documents -> toxicity filter -> exact dedup -> near dedup -> mix -> packed batches.

Every stage takes (spark, docs, folder of the tables) and returns a DataFrame;
all but the last keep the columns of ``documents``. ``run`` writes what a stage
returns as Parquet in the shared scratch folder and hands the reread table on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm import buckets, dedup, jaccard, mixing, toxicity
from pointweave.llm.common import table
from pointweave.session import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the clause grammar rejects go; it learns from the labels outside the held-out fold."""
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    return jaccard.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sources come to their target shares; a document occurs as often as the mix takes it."""
    return mixing.mix(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row per document of the mix with its bucket, batch and slot."""
    return buckets.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: the first stage learns a model, which SQL cannot express; tests hold the run against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
