"""Traces, message histories and span trees that Spark derives from the given tables, for queries and bench."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FIELDS = ("kind", "agent", "action", "phase", "content", "query", "doc_id", "answer", "to_agent", "ref_rule")


def _row(**fields) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(*((fields[f] if isinstance(fields.get(f), Column) else F.lit(fields[f]) if f in fields else null).cast("string").alias(f) for f in _FIELDS))


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVENT_SCHEMA rows: each source event becomes one to three trace events; one shuffle by trace_id numbers them and finds their refs."""
    src = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    src = src.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"), F.floor((F.dayofmonth("ts") - 1) / 3).cast("int").alias("w"))
    src = src.withColumn("trace_id", F.format_string("u%dw%d", "user_id", "w"))
    c = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    s = lambda e: F.expr(e).cast("string")
    made = {
        "signup": [_row(kind="LLM_CALL", agent="planner", phase="plan", content=F.when(F.expr("k % 8 = 0"), "plan: recall from memory; submit directly").otherwise(c("plan: step ", s("k % 5"))))],
        "click": [
            _row(kind="TOOL_CALL", agent="searcher", action="search", phase="search", query=c("topic ", s("k % 5"))),
            _row(kind="TOOL_RESULT", agent="env", action="search", phase="search", content=c("search results for topic ", s("k % 5"), ": 2 docs [d", s("k % 9"), ", d", s("(k + 2) % 9"), "]"), ref_rule="previous"),
        ],
        "view": [
            _row(kind="TOOL_CALL", agent="searcher", action="read_doc", phase="search", doc_id=c("d", s("k % 9"))),
            _row(kind="TOOL_RESULT", agent="env", action="read_doc", phase="search", content=F.when(F.expr("k % 10 = 0"), "error: invalid doc_id").otherwise(F.expr("repeat('document text ', 1 + k % 20)")), ref_rule="previous"),
        ],
        "purchase": [
            _row(kind="LLM_CALL", agent="reporter", phase="report", content=c("based on d", s("k % 9"), " the answer is a", s("k % 3")), ref_rule="result"),
            _row(kind="TOOL_CALL", agent="reporter", action="submit", phase="report", answer=c("a", s("k % 3")), ref_rule="previous"),
            _row(kind="VERIFIER", agent="verifier", content=F.when(F.expr("value >= 35"), "passed: ok").when(F.expr("k % 2 = 0"), "failed: answer missing required citation").otherwise("failed: wrong answer"), ref_rule="previous"),
        ],
        "error": [_row(kind="HANDOFF", agent="searcher", phase="report", to_agent="reporter", content=F.when(F.expr("k % 4 = 0"), "no relevant documents were found").otherwise(c("see d", s("k % 9"))), ref_rule="result")],
    }
    rows = F.lit(None)
    for kind, parts in made.items():
        rows = F.when(F.col("event_type") == kind, F.array(*parts)).otherwise(rows)
    ev = src.select("trace_id", "ts", "event_id", "value", "k", F.posexplode(rows).alias("j", "r")).select("trace_id", "ts", "event_id", "j", "k", "r.*")
    order = Window.partitionBy("trace_id").orderBy("ts", "event_id", "j")
    ev = ev.withColumn("idx", F.row_number().over(order) - 1)
    last_result = F.last(F.when(F.col("kind") == "TOOL_RESULT", F.col("idx")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ref = F.when(F.col("ref_rule") == "previous", F.col("idx") - 1).when(F.col("ref_rule") == "result", last_result)
    ev = ev.withColumn("ref", ref)
    name = lambda i: F.format_string("e%03d", i)
    return ev.select(
        "trace_id", F.col("idx").cast("int").alias("idx"), name(F.col("idx")).alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("ts"), "kind", "agent", "action", "phase", "content", "query", "doc_id", "answer", "to_agent",
        F.when(F.col("ref").isNull(), F.array().cast("array<string>")).otherwise(F.array(name(F.col("ref")))).alias("refs"), F.lit(None).cast("string").alias("parent"), "k",
    )


def traces(events: DataFrame) -> DataFrame:
    """TRACE_SCHEMA rows from trace events: one aggregation, on the partitioning of the events."""
    order = Window.partitionBy("trace_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    llm = F.last(F.when(F.col("kind") == "LLM_CALL", F.struct("idx", "agent", "k")), ignorenulls=True).over(order)
    e = events.withColumn("llm", llm).withColumn("verdict", F.when(F.col("kind") == "VERIFIER", F.col("content").startswith("passed")))
    t = e.groupBy("trace_id").agg(
        F.coalesce(F.max_by("verdict", F.when(F.col("verdict").isNotNull(), F.col("idx"))), F.lit(False)).alias("success"),
        F.max_by("llm", F.when(~F.col("verdict") & F.col("llm").isNotNull(), F.col("idx"))).alias("g"),
    )
    user = F.regexp_extract("trace_id", r"^u(\d+)w", 1).cast("int")
    gt = ~F.col("success") & F.col("g").isNotNull()
    doc = lambda d: F.concat(F.lit("d"), (user % 7 + d).cast("string"))
    when = lambda c: F.when(gt, c)
    return t.select(
        "trace_id", F.concat(F.lit("task t"), (user % 7).cast("string")).alias("task"), "success", F.concat(F.lit("t"), (user % 7).cast("string")).alias("task_id"),
        F.concat(F.lit("m"), (user % 2).cast("string")).alias("model_version"), F.concat(F.lit("p"), (F.floor(user / 2) % 2).cast("string")).alias("prompt_version"),
        F.concat(F.lit("w"), F.regexp_extract("trace_id", r"w(\d+)$", 1)).alias("time_window"), F.array(doc(0), doc(1), doc(2)).alias("evidence"), F.array(doc(0), doc(1)).alias("gold"),
        when(F.col("g.idx")).alias("gt_step"), when(F.col("g.agent")).alias("gt_agent"), when(F.lit("FM-1.1")).alias("gt_code"), when(F.concat(F.lit("k"), (F.col("g.k") % 2).cast("string"))).alias("gt_kind"),
    )


#: The same tables for the SQL engine: ev (ref is the index that refs names) and tr.
BASE_SQL = r"""
src AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(floor((day(ts) - 1) / 3) AS INT) AS w FROM events),
s0 AS (SELECT *, 'u' || user_id || 'w' || w AS trace_id FROM src),
x AS (
  SELECT trace_id, ts, event_id, 0 AS j, k, 'LLM_CALL' AS kind, 'planner' AS agent, NULL AS action, 'plan' AS phase, CASE WHEN k % 8 = 0 THEN 'plan: recall from memory; submit directly' ELSE 'plan: step ' || k % 5 END AS content, NULL AS query, NULL AS doc_id, NULL AS answer, NULL AS to_agent, NULL AS rule FROM s0 WHERE event_type = 'signup'
  UNION ALL SELECT trace_id, ts, event_id, 0, k, 'TOOL_CALL', 'searcher', 'search', 'search', NULL, 'topic ' || k % 5, NULL, NULL, NULL, NULL FROM s0 WHERE event_type = 'click'
  UNION ALL SELECT trace_id, ts, event_id, 1, k, 'TOOL_RESULT', 'env', 'search', 'search', 'search results for topic ' || k % 5 || ': 2 docs [d' || k % 9 || ', d' || (k + 2) % 9 || ']', NULL, NULL, NULL, NULL, 'previous' FROM s0 WHERE event_type = 'click'
  UNION ALL SELECT trace_id, ts, event_id, 0, k, 'TOOL_CALL', 'searcher', 'read_doc', 'search', NULL, NULL, 'd' || k % 9, NULL, NULL, NULL FROM s0 WHERE event_type = 'view'
  UNION ALL SELECT trace_id, ts, event_id, 1, k, 'TOOL_RESULT', 'env', 'read_doc', 'search', CASE WHEN k % 10 = 0 THEN 'error: invalid doc_id' ELSE repeat('document text ', 1 + k % 20) END, NULL, NULL, NULL, NULL, 'previous' FROM s0 WHERE event_type = 'view'
  UNION ALL SELECT trace_id, ts, event_id, 0, k, 'LLM_CALL', 'reporter', NULL, 'report', 'based on d' || k % 9 || ' the answer is a' || k % 3, NULL, NULL, NULL, NULL, 'result' FROM s0 WHERE event_type = 'purchase'
  UNION ALL SELECT trace_id, ts, event_id, 1, k, 'TOOL_CALL', 'reporter', 'submit', 'report', NULL, NULL, NULL, 'a' || k % 3, NULL, 'previous' FROM s0 WHERE event_type = 'purchase'
  UNION ALL SELECT trace_id, ts, event_id, 2, k, 'VERIFIER', 'verifier', NULL, NULL, CASE WHEN value >= 35 THEN 'passed: ok' WHEN k % 2 = 0 THEN 'failed: answer missing required citation' ELSE 'failed: wrong answer' END, NULL, NULL, NULL, NULL, 'previous' FROM s0 WHERE event_type = 'purchase'
  UNION ALL SELECT trace_id, ts, event_id, 0, k, 'HANDOFF', 'searcher', NULL, 'report', CASE WHEN k % 4 = 0 THEN 'no relevant documents were found' ELSE 'see d' || k % 9 END, NULL, NULL, NULL, 'reporter', 'result' FROM s0 WHERE event_type = 'error'),
y AS (SELECT *, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY ts, event_id, j) - 1 AS INT) AS idx FROM x),
z AS (SELECT *, last_value(CASE WHEN kind = 'TOOL_RESULT' THEN idx END IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_result FROM y),
ev AS (SELECT trace_id, idx, 'e' || lpad(CAST(idx AS VARCHAR), 3, '0') AS id, CAST(floor(epoch(ts)) AS DOUBLE) AS ts, kind, agent, action, phase, content, query, doc_id, answer, to_agent,
         CASE rule WHEN 'previous' THEN idx - 1 WHEN 'result' THEN last_result END AS ref, k FROM z),
g0 AS (SELECT *, last_value(CASE WHEN kind = 'LLM_CALL' THEN idx END IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS llm FROM ev),
g1 AS (SELECT trace_id, coalesce(max_by(content LIKE 'passed%', idx) FILTER (kind = 'VERIFIER'), false) AS success,
         max_by(llm, idx) FILTER (kind = 'VERIFIER' AND content NOT LIKE 'passed%' AND llm IS NOT NULL) AS g, CAST(regexp_extract(trace_id, '^u(\d+)w', 1) AS INT) AS u, regexp_extract(trace_id, 'w(\d+)$', 1) AS w FROM g0 GROUP BY trace_id),
tr AS (SELECT g1.trace_id, 'task t' || u % 7 AS task, success, 't' || u % 7 AS task_id, 'm' || u % 2 AS model_version, 'p' || (u // 2) % 2 AS prompt_version, 'w' || w AS time_window,
         ['d' || u % 7, 'd' || (u % 7 + 1), 'd' || (u % 7 + 2)] AS evidence, ['d' || u % 7, 'd' || (u % 7 + 1)] AS gold,
         CASE WHEN NOT success THEN g END AS gt_step, CASE WHEN NOT success THEN ev.agent END AS gt_agent, CASE WHEN NOT success AND g IS NOT NULL THEN 'FM-1.1' END AS gt_code, CASE WHEN NOT success THEN 'k' || ev.k % 2 END AS gt_kind
       FROM g1 LEFT JOIN ev ON ev.trace_id = g1.trace_id AND ev.idx = g1.g)
"""
