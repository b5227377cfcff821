"""A training corpus from raw documents, stage by stage: clean, thin out, decontaminate, pack.

Each stage reads the rows its predecessor wrote. All but the last return the columns of
``documents``; the last one returns the boundary records of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import decontam, linededup, packing, quality, resemblance
from kinfold.llm.common import load, save, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and with them documents that the rules reject."""
    return quality.apply(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines stay in one document each."""
    return linededup.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose texts share 80 % of their five-word shingles: SimHash and
    BK-trees find the pairs, measured then, and an exact way those further apart than the trees reach."""
    return resemblance.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents that are mostly such passages go."""
    return decontam.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1,024 ids, as boundary records."""
    return packing.pieces(docs).drop("ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Fingerprints, components and token ids are beyond SQL; tests/llm holds run() to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next one."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def export(spark: SparkSession, sf_dir: str, out: str) -> None:
    """Write :func:`run`'s rows to ``out`` and remove all that was written on the way, also if a stage fails."""
    with scratch(spark):
        run(spark, sf_dir).write.parquet(out)
