"""The corpus pipeline: five operators, each on what the one before kept.

``run(spark, sf_dir)`` applies the stages to ``documents``; each stage's rows are
written to the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import Workspace
from tarn.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter in them, whose language the classifier names."""
    from tarn.llm.language import keep_known_language

    return keep_known_language(docs, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tarn.llm.exact_dedup import drop_exact_copies

    return drop_exact_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more.

    SimHash fingerprints are linked through covering masks; prefixes add what
    lies beyond their radius, and the shingle sets decide.
    """
    from tarn.llm.similar import drop_near

    return drop_near(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tarn.llm.decontaminate import drop_contaminated

    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tarn.llm.packing import pack_documents

    pieces = pack_documents(docs, tokenizer_path())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: SQL cannot express the language model, covering hashes or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Workspace(spark) as ws:
        for _, stage in STAGES[:-1]:
            docs = ws.table(stage(spark, docs, sf_dir))
        return ws.deliver(STAGES[-1][1](spark, docs, sf_dir))
