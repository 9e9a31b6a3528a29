"""One query per operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from offramp.llm.bestfit import pack_best_fit
from offramp.llm.common import table
from offramp.llm.fingerprints import fingerprints
from offramp.llm.hard_negatives import hard_negative_query
from offramp.llm.html_extract import extract_text
from offramp.llm.language_id import language_query
from offramp.llm.line_dedup import dedup_lines
from offramp.llm.lm_score import lm_query
from offramp.llm.minhash import near_duplicates
from offramp.llm.mixing import mix_query
from offramp.llm.packing import pack_documents
from offramp.llm.quality_model import quality_model_query
from offramp.llm.quality_rules import quality_query
from offramp.llm.spelling import spelling_query


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model_query(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_query(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_query(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_query(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_query(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_query(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negative_query(table(spark, sf_dir, "embeddings"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_line_dedup": op2_line_dedup,
    "op3_minhash": op3_minhash,
    "op4_quality_model": op4_quality_model,
    "op5_language_id": op5_language_id,
    "op6_packing": op6_packing,
    "op7_lm_score": op7_lm_score,
    "op8_mixing": op8_mixing,
    "op9_fingerprints": op9_fingerprints,
    "op10_quality_rules": op10_quality_rules,
    "op11_spelling": op11_spelling,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_best_fit": op13_best_fit,
}
