"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embedding_dedup, language_id, main_text, minhash_dedup, mixing, personal_data, shards, site_lines, spelling, substring_dedup, toxicity, vector_codes
from .frames import prepare


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"), window=20))


#: Share of tokens of documents labelled as good quality and as poor.
QUALITY_MIX = {"1": 0.95, "0": 0.05}


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), QUALITY_MIX, "quality")
    return mixed.select("doc_id", "n_tokens", F.try_element_at("post", F.lit("1")).alias("p_good"), "rate", "copies")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_read(spark, sf_dir, "embeddings"), cosine=0.95)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language_id.fit_languages(docs, language_id.fold() != 2)
    return language_id.identify(docs, model).withColumn("held_out", language_id.fold() == 2).select("doc_id", "held_out", "lang_pred", "score", "bits", "rejected")


#: The chain's categories in order.
TOXIC_CHAIN = ["low_quality", "toxic"]


def chain_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit_chain(docs, chain_labels(_read(spark, sf_dir, "labels")), TOXIC_CHAIN)
    return toxicity.score(docs, model, TOXIC_CHAIN)


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return main_text.digest(main_text.main_text(pages, main_text.fit_weights(pages)))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, percent=85)


def op8_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return site_lines.digest(site_lines.drop_site_lines(pages, site_lines.html_lines(F.col("html")), site_lines.host_of(F.col("url"))))


def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.with_law(shards.shard(_read(spark, sf_dir, "documents"), 40))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=10))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(_read(spark, sf_dir, "documents")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_read(spark, sf_dir, "embeddings"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return personal_data.find(docs, personal_data.fit(personal_data.examples(docs)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_substring_dedup, op2_mixing, op3_embedding_dedup, op4_language_id, op5_toxicity, op6_main_text, op7_minhash_dedup, op8_site_lines, op9_kd_shards, op10_decontaminate, op11_spelling, op12_vector_codes, op13_personal_data)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op8_site_lines": site_lines.oracle(), "op10_decontaminate": decontaminate.ORACLE}
