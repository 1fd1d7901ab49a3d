"""One registered query per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termlens.llm import (
    conversations,
    decontaminate,
    extraction,
    fingerprints,
    language,
    lines,
    middle,
    minhash,
    mixing,
    quality,
    simhash,
    suffixes,
    token_store,
)
from termlens.sources.workspace import new_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_page_lines(_table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.duplicated_spans(_table(spark, sf_dir, "documents")))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-store")
    token_store.write_tokens(_table(spark, sf_dir, "documents"), path)
    return token_store.read_tokens(spark, path, with_ids=False)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = quality.train(documents, _table(spark, sf_dir, "labels"))
    return quality.scored(documents, model)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints_with_edits(_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = language.train(documents.where(~language.held_out()).select("doc_id", "lang", "text"))
    rows = documents.select("doc_id", "text", language.held_out().alias("held_out"))
    return language.identify(rows, model, ["doc_id", "held_out"])


def op7_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), copy_column="copy")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digest(middle.fill_in_middle(_table(spark, sf_dir, "documents")))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(_table(spark, sf_dir, "conversations"))
    return conversations.digest(conversations.repair(rows))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_token_store": op3_token_store,
    "op4_quality": op4_quality,
    "op5_fingerprints": op5_fingerprints,
    "op6_language": op6_language,
    "op7_extraction": op7_extraction,
    "op8_simhash": op8_simhash,
    "op9_decontaminate": op9_decontaminate,
    "op10_mixing": op10_mixing,
    "op11_minhash": op11_minhash,
    "op12_middle": op12_middle,
    "op13_conversations": op13_conversations,
}
