"""Documents to a training mix, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and
reads it again as the next stage's documents. All stages but the last return the columns of
documents; the last adds the words taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlab.llm import leaks, mixing, near, rules, substrings
from planlab.llm.common import free_name, table
from planlab.llm.pipeline import written

NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id."""
    return near.without_copies(docs, percent=NEAR_PERCENT)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with repeated passages cut out of the text; texts without one stay as they are, and
    a document of which nothing is left goes."""
    kept = free_name(docs, "__kept")
    joined = substrings.cut_texts(docs, kept)
    new = F.coalesce(kept, "text")
    columns = [
        new.alias(c) if c == "text" else F.when(F.col(kept).isNull(), F.col(f"`{c}`")).otherwise(F.length(kept)).cast(t).alias(c)
        if c == "n_chars" else F.col(f"`{c}`")
        for c, t in docs.dtypes
    ]
    return joined.where(F.coalesce(F.col(kept) != "", F.lit(True))).select(*columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, with their words taken and their source's target."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
]

#: SQL cannot say what near-duplicate components or draws by hash are; tests hold the stages
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
