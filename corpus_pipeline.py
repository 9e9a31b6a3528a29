"""A corpus pipeline of five operators; each stage reads what the one before it kept.

Each function takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offramp.llm.common import stored, table
from offramp.llm.line_dedup import dedup_lines
from offramp.llm.minhash import drop_near_duplicates
from offramp.llm.mixing import mix_documents
from offramp.llm.packing import pack_documents
from offramp.llm.quality_rules import keep_documents
from offramp.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the rules, unchanged."""
    return keep_documents(docs, "v2")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts (and from ``n_chars``). A document that consisted of
    repeats only has nothing left and goes; one that had no text before stays."""
    deduped = dedup_lines(docs)
    lost = (F.col("n_exact") + F.col("n_near") > 0) & ~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))
    left = deduped.where(~lost | F.col("text").isNull())
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_exact") + F.col("n_near") > 0, F.length("text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; copies of a document are packed one by one."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("mix_sources", mix_sources), ("pack", pack)]
#: Packing reads a tokenizer file, which SQL cannot.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each stored in the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
