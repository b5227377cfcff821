"""The registered queries of the corpus operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import classifier, decontam, langid, linededup, packing, pii, quality, rans, simhash, tokencount
from kinfold.llm.common import load

#: Key of the registered query's pseudonyms; a real run brings its own.
DEMO_KEY = "kinfold-demo-key"


def _held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(load(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(load(spark, sf_dir, "documents"), DEMO_KEY)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = classifier.learn(docs, load(spark, sf_dir, "labels").where(~_held_out()))
    return classifier.score(docs, model).select("doc_id", _held_out().alias("held_out"), "score", "predicted")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    sample = langid.learn(docs.where(~_held_out()))
    return langid.predict(docs, sample).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicate(load(spark, sf_dir, "documents"), counts=True).select("doc_id", "n_lines", "n_removed", "text")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(load(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(load(spark, sf_dir, "documents")).drop("ids")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("spans")


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = rans.write(load(spark, sf_dir, "documents"))
    return rans.read(spark, path).drop("ids")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_quality_rules, op2_pii, op3_quality_classifier, op4_language_id, op5_simhash_near_dedup,
        op6_line_dedup, op7_token_counts, op8_packing, op9_decontamination, op10_token_binary,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from kinfold.llm.oracle import ORACLES

    return dict(ORACLES)
