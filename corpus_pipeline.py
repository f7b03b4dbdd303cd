"""A corpus pipeline: stages over the table of documents, each applying one text operator.

Each stage works on all documents that the one before kept. Run as a whole, every
stage is written to the shared checkpoint folder and read back, so a lost executor
costs at most one stage.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marquee.llm import decontamination, language, near_duplicates, packing, secrets
from marquee.llm.common import documents, shipped
from marquee.session import cut


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, as no language can be said of them; the others stay as they are, whatever theirs is."""
    shipped(spark)
    return language.accepted(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that are linked by shared shingles of five words (Jaccard of 0.8), the one with the smallest id stays."""
    shipped(spark)
    return near_duplicates.deduplicated(docs, near_duplicates.NEAR)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets masked."""
    shipped(spark)
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents left, packed into sequences."""
    shipped(spark)
    return packing.best_fit_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Learned models and tokenization are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
