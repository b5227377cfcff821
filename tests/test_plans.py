"""Physical plans: what must be pushed down, and what must not be there."""

import re

from kinfold import queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_searches_need_no_cross_join(spark, sf_dir):
    text = plan(queries.cosine_topk(spark, sf_dir))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)
    assert "WindowGroupLimit" in text


def test_scans_read_only_what_is_used(spark, sf_dir):
    text = plan(queries.path_basename(spark, sf_dir))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in text
    labels = plan(queries.missing_label_check(spark, sf_dir))
    assert "text" not in labels and "html" not in labels


def test_prefix_filter_reaches_the_scan(spark, sf_dir):
    from kinfold.operators.splits import prefix_filter

    text = plan(prefix_filter(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["src1", "src2"], "source"))
    assert re.search(r"PushedFilters: \[.*StringStartsWith\(source,src1\)", text)


def test_reports_are_partial_aggregates(spark, sf_dir):
    text = plan(queries.per_class_report(spark, sf_dir))
    assert "partial_sum" in text and "CartesianProduct" not in text


def test_confusion_needs_no_cross_join(spark, sf_dir):
    for q in (queries.confusion_matrix, queries.most_confused):
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(q(spark, sf_dir)))


def test_query_blocks_leave_one_scan_of_what_they_found(spark):
    from kinfold.operators import retrieve

    rows = spark.range(40).selectExpr("cast(id as string) as image_id", "array(cast(id as double), 1D, 2D) as fv")
    text = plan(retrieve.top_k(rows, rows, 3, block_bytes=256))
    assert len(re.findall(r"FileScan|Scan parquet", text)) == 1
    assert "Union" not in text and "MapInArrow" not in text
