"""The physical plans that the operators are meant to have."""

import re

import pytest

import __spark_entry__ as entry_module
from tableprofile.operators import cleaning, documents, profile, quality, report, sampling

QUERIES = entry_module.queries()
PYTHON_QUERIES = {"extract_pages", "extract_documents", "batch_answers", "gather_answers"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _final_plan(df):
    df.collect()
    return _plan(df).split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins_and_python_only_where_injected(spark, folder, name):
    plan = _plan(QUERIES[name](spark, folder))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert bool(re.search("MapInPandas|EvalPython|FlatMapGroups", plan)) == (name in PYTHON_QUERIES)


def test_cleaning_needs_no_shuffle(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    assert "Exchange" not in _plan(cleaning.clean_dataset(orders, drop_any=True))


def test_filters_and_columns_reach_the_scan(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    complete = _plan(cleaning.drop_any_null_rows(lines.select("l_orderkey", "l_returnflag")))
    assert "PushedFilters: [IsNotNull(l_orderkey), IsNotNull(l_returnflag)]" in complete
    plan = _plan(profile.value_counts(lines, "l_returnflag"))
    assert "PushedFilters: [IsNotNull(l_returnflag)]" in plan
    assert "ReadSchema: struct<l_returnflag:string>" in plan
    pages = spark.read.parquet(f"{folder}/conversations.parquet")
    plan = _plan(documents.assemble_pages(pages, "conv_id", "turn"))
    assert re.search(r"ReadSchema: struct<conv_id:bigint,turn:\w+>", plan)  # which part is the last is found without texts
    texts = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "_page" in line]
    assert all("hashpartitioning(conv_id" in line and "part_no" in line for line in texts)


def test_one_scan_for_all_columns(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    known = profile.quartiles(lines)
    for df in (
        profile.completeness(lines),
        profile.null_percent(lines),
        profile.describe_numeric(lines, known),
        profile.numeric_stats(lines, known),
        profile.column_bytes(lines),
        quality.iqr_outliers(lines, known),
        cleaning.retention_report(lines),
    ):
        plan = _plan(df)
        assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Join" not in plan


def test_duplicates_take_one_scan_and_one_shuffle_of_digests(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    plan = _plan(spark.range(1).select(quality.duplicate_count(orders)))
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert "partial_count" in plan and "Join" not in plan


def test_each_value_type_is_scanned_for_its_own_columns(spark, folder):
    plan = _plan(profile.distinct_counts(spark.read.parquet(f"{folder}/orders.parquet")))
    assert plan.count("FileScan") == 4
    assert "ReadSchema: struct<o_totalprice:double>" in plan
    near = _plan(profile.distinct_counts(spark.read.parquet(f"{folder}/orders.parquet"), exact=False))
    assert "Expand" not in near and near.count("Exchange") == 1


def test_top_values_are_cut_before_the_shuffle(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    assert _plan(profile.categorical_top_k(lines)).count("WindowGroupLimit") >= 2
    assert "TakeOrderedAndProject" in _plan(profile.top_k(lines, "l_returnflag", 3))
    sample = _plan(sampling.stratified_sample(lines, "l_orderkey", "l_returnflag"))
    assert sample.count("WindowGroupLimit") == 4


def test_assembled_parts_are_shuffled_once_for_their_contexts(spark, folder):
    pages = spark.read.parquet(f"{folder}/conversations.parquet")
    parts = documents.assemble_pages(pages, "conv_id", "turn")
    plan = _final_plan(documents.document_context(parts, 100, "conv_id"))
    assert "ReusedExchange" in plan


def test_report_shuffles_text_values_once(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    known = profile.quartiles(orders)
    df = report.dataset_report(orders, known)
    df.collect()
    plan = _plan(df)
    assert "ReusedExchange [column" in plan
    assert len(set(re.findall(r"Subquery subquery#\d+", plan))) == 3  # distinct values, top values, duplicates
