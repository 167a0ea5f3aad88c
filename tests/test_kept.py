"""Tables kept by trace: what is asked of them needs no shuffle, and queries of many branches derive their events once."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.plans import all_queries
from tracewright.tables import durable_by


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_shuffle_by_trace(spark):
    d = durable_by(spark.range(100).select(F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("trace_id"), "id"), "trace_id")
    last = d.groupBy("trace_id").agg(F.max("id").alias("last"))
    each = d.withColumn("n", F.row_number().over(Window.partitionBy("trace_id").orderBy("id"))).join(last, "trace_id").join(d.withColumnRenamed("id", "last").distinct(), ["trace_id", "last"])
    assert "Exchange" not in plan(each)
    assert each.count() == 100 and each.agg(F.max("n")).first()[0] == 15


@pytest.mark.parametrize("name", ["e1_gt_evaluation", "io17_score_payloads", "t24_hypothesis_merge", "v1_target_selection", "t25_candidate_is_symptom"])
def test_events_are_derived_once(spark, name):
    files = all_queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any("events.parquet" in f for f in files)
