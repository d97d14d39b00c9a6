"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes the session, the documents its predecessor kept, and the folder of the
input tables, and returns a DataFrame; ``run`` writes what each returns and reads it again
for the next. Only the last stage's columns differ from those of ``documents``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagepulse.llm import mixing, packing, pii, quality_rules, simhash
from usagepulse.llm.common import file_position, materialise, prepare


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose posterior is that of good ones."""
    return quality_rules.judge(docs).where("_rules.kept").drop("_rules")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest id."""
    return simhash.deduplicate(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; ``n_chars`` follows the new text."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents as the mix takes them, in training order."""
    return mixing.training_order(mixing.mix(docs, size=mixing.word_count(F.col("text"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of packed sequences; a repeated document is packed each time.

    The order of ``docs`` as written is the training order: it numbers the copies of a
    document, and sequences sorted by ``sequence_position`` follow it. Documents that are
    not files yet are written first.
    """
    try:
        position = file_position(docs)
    except AnalysisException:
        docs = materialise(docs, "ordered")
        position = file_position(docs)
    return packing.pack(docs, position=position)


STAGES = [
    ("quality_rules", keep_good),
    ("near_dedup", keep_one_of_each),
    ("pii", sanitise),
    ("mixing", mix_sources),
    ("packing", pack),
]

# Weak supervision, connected components and packing have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
