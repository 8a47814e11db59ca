"""Plans that must hold at scale: what is shuffled, joined and limited, and where."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from occupipe.operators import blocks as B
from occupipe.operators import groups as G

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["title_search", "similarity_costs", "nested_result", "others_fallback", "stratified_split"])
def test_no_pairwise_join(spark, name):
    plan = plan_of(queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_extraction_is_one_narrow_stage(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "html")
    plan = plan_of(B.extract_tasks(pages, "html", ["the"]))
    assert "Exchange" not in plan and "ReadSchema: struct<page_id:bigint,html:string>" in plan


def test_titles_are_probed_without_a_shuffle(spark):
    df = spark.range(100).select("id", F.split(F.concat(F.col("id").cast("string"), F.lit(" b")), " ").alias("codes"))
    table = spark.createDataFrame([("a", 1)], "code string, v int")
    plan = plan_of(G.lookup_each(df, F.col("codes"), table, "code", "v", "out"))
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_converted_arrays_are_made_once_and_only_their_codes_go_to_python(spark):
    plan = plan_of(queries()["others_fallback"](spark, FOLDER))
    assert plan.count("zip_with(") == 1 and plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan


def test_ranks_are_limited_before_the_shuffle(spark):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    plan = plan_of(G.keep_one(orders, ["o_custkey"], [F.asc("o_orderkey")]))
    assert plan.count("WindowGroupLimit") == 2


def test_full_rows_are_not_shuffled_by_a_split(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    flagged = G.first_by_hash(docs, ["lang"], ["doc_id"], F.floor(F.col("n") * 0.5), 1)
    assert "hashpartitioning" not in plan_of(flagged)


def test_filters_and_columns_reach_the_scan(spark):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    from occupipe.operators import evaluate as E

    plan = plan_of(E.counts_at_level(orders.filter("o_orderstatus = 'F'"), "o_orderpriority", 1))
    assert "EqualTo(o_orderstatus,F)" in plan and "ReadSchema: struct<o_orderstatus:string,o_orderpriority:string>" in plan


def test_registry_is_consistent(spark):
    assert set(oracle_sql()) <= set(queries())
    result = entry(spark)
    assert result.columns == ["page_id", "tasks"] and result.count() > 0
