"""The driver contract, streams and physical plans."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vinculo.operators import linkage
from vinculo.operators.scale import materialize
from vinculo.plans.tables import receipt_pages
from vinculo.streaming import incremental

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_checks_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", ["name_fold", "registry_merge", "single_page", "dashboard_kpis", "text_metrics", "stream_merge"])
def test_queries_run(spark, name):
    assert entry.queries()[name](spark, SF).count() >= 0


@needs_data
def test_filters_and_columns_reach_the_scan(spark):
    text = plan(entry.queries()["registry_search"](spark, SF))
    assert "PushedFilters" in text and "c_acctbal" in text and "c_mktsegment" not in text


@needs_data
def test_no_pairwise_join_on_pages(spark):
    pages = materialize(linkage.prepare_pages(receipt_pages(spark, SF)), "t")
    for df in (linkage.first_copies(pages), linkage.resolve_conflicts(
            pages.select("page_ord", F.col("page_ord").alias("emp_ord"), F.lit(1.0).alias("score")))):
        assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)


def test_first_seen_over_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "norm string, entry_ord long"
    spark.createDataFrame([("A", 2), ("A", 1), ("B", 3)], schema).coalesce(1).write.parquet(f"{src}/p=1")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
        q = incremental.first_seen_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
        return sorted(tuple(r) for r in incremental.current_rows(spark, str(tmp_path / "out"), stream.schema).collect())

    assert run() == [("A", 1), ("B", 3)]
    spark.createDataFrame([("B", 0), ("C", 9)], schema).coalesce(1).write.parquet(f"{src}/p=2")
    # Started again it goes on with the new file only, whose smaller number wins.
    assert run() == [("A", 1), ("B", 0), ("C", 9)]
