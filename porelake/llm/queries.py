"""The queries opN_<name> of this subpackage over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from porelake.llm import decontaminate, html, langid, licences, packing, quality, simhash, store, tokencount, warc
from porelake.llm.common import few_files, table


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file; the package that holds them isn't part of this library."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(simhash.near_duplicates(spark.read.parquet(table(sf_dir, "documents"))))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(spark.read.parquet(table(sf_dir, "documents")), spark.read.parquet(table(sf_dir, "benchmark")))
    return few_files(decontaminate.report(found))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(langid.identify(spark.read.parquet(table(sf_dir, "documents"))))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(html.extract(spark.read.parquet(table(sf_dir, "pages"))))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(packing.packed(spark.read.parquet(table(sf_dir, "documents")), vocabulary("word_bpe_49k.json")))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(warc.round_trip(spark.read.parquet(table(sf_dir, "pages"))))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(tokencount.count_tokens(spark.read.parquet(table(sf_dir, "documents")), vocabulary("piece_bpe_32k.model")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(quality.quality(spark.read.parquet(table(sf_dir, "documents"))))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(licences.scan(spark.read.parquet(table(sf_dir, "documents"))))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(store.round_trip(spark.read.parquet(table(sf_dir, "documents")), vocabulary("byte_bpe_50k.json")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_decontamination,
        op3_language_id,
        op4_html_extraction,
        op5_best_fit_packing,
        op6_warc_round_trip,
        op7_token_counts,
        op8_quality_rules,
        op9_licence_scan,
        op10_token_store,
    )
}
ORACLES: dict[str, str] = {
    "op2_decontamination": decontaminate.ORACLE,
    "op6_warc_round_trip": warc.ORACLE,
    "op8_quality_rules": quality.ORACLE,
    "op9_licence_scan": licences.oracle_sql(),
}
