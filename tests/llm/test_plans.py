"""Native operators run without Python, and no operator joins across."""

import re

import pytest

from kinfold.llm import pii, quality, queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_operators_stay_in_the_engine(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (quality.assess(docs), quality.apply(docs), pii.pseudonymise(docs, "k"), pii.apply(docs, "k")):
        assert not re.search("Python|Pandas|Arrow|Exchange", plan(df))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_no_cross_join(spark, sf_dir, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(queries.queries()[name](spark, sf_dir)))
