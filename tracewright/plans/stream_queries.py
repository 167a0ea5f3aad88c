"""The streamed import as a query."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.plans.registry import trace_query
from tracewright.streaming.ingest import ingest
from tracewright.tables import shared_folder


@trace_query("u_streamed_traces", """q AS (SELECT *, CASE WHEN kind = 'TOOL_RESULT' THEN ref END AS up FROM ev), w AS (SELECT *, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY coalesce(up, idx), idx) - 1 AS INT) AS place FROM q)
SELECT w.trace_id, w.place AS idx, w.kind, w.agent, w.action, w.content, 'e' || lpad(CAST(p.place AS VARCHAR), 3, '0') AS parent FROM w LEFT JOIN w p ON p.trace_id = w.trace_id AND p.idx = w.up""")
def streamed(events, traces):
    """Events as spans (results below their calls) in a file of any order for each core (three at least), a fifth of them twice; the traces of every other user have a completion marker, the others close by silence when time goes on."""
    spark, folder = events.sparkSession, shared_folder(events.sparkSession)
    name = lambda i: F.concat(F.lit("s"), i.cast("string"))
    parent = F.when(F.col("kind") == "TOOL_RESULT", F.concat(F.lit("s"), F.regexp_replace(F.get("refs", F.lit(0)), "^e0*(?=[0-9])", "")))
    marked = (F.col("idx") == F.col("n") - 1) & (F.regexp_extract("trace_id", r"^u(\d+)w", 1).cast("int") % 2 == 0)
    spans = events.withColumn("n", F.count("*").over(Window.partitionBy("trace_id"))).select(
        "trace_id", name(F.col("idx")).alias("span_id"), parent.alias("parent_span_id"), F.col("idx").cast("long").alias("ordinal"), "kind", "agent", "action", "phase", "ts", F.to_json(F.struct("content", "query", "doc_id", "answer")).alias("payload"), F.timestamp_seconds("ts").alias("at"), F.when(marked, F.col("n")).alias("expected"),
    )
    twice = F.explode(F.sequence(F.lit(0), (F.col("ordinal") % 5 == 1).cast("int")))
    spans = spans.withColumn("_copy", twice).drop("_copy")
    spans.repartition(max(3, spark.sparkContext.defaultParallelism), F.xxhash64("trace_id", "span_id")).write.json(f"{folder}/in")
    options = {"delay": "400 days", "silence_ms": 3_600_000}
    ingest(spark, f"{folder}/in", folder, **options)
    end = spark.range(1).select(F.lit("end").alias("trace_id"), F.lit("s").alias("span_id"), F.lit("SPAN").alias("kind"), F.lit("a").alias("agent"), F.timestamp_seconds(F.lit(4_000_000_000)).alias("at"))
    end.write.mode("append").json(f"{folder}/in")
    out = ingest(spark, f"{folder}/in", folder, **options).where("trace_id <> 'end'")
    return out.select("trace_id", "idx", "kind", "agent", "action", "content", "parent")
