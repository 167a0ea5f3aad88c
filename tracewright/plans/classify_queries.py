"""Queries of rules, symptoms and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.model import MODES
from tracewright.operators import analyze as a
from tracewright.operators import classify as c
from tracewright.operators import represent as r
from tracewright.plans.analyze_queries import LOOP_SQL, SYM_SQL
from tracewright.tables import durable
from tracewright.plans.registry import trace_query

RULE_SQL = LOOP_SQL + r""",
b0 AS (SELECT ev.*, last_value(CASE WHEN ev.kind = 'LLM_CALL' THEN ev.idx END IGNORE NULLS) OVER w AS di, last_value(CASE WHEN ev.kind = 'LLM_CALL' THEN ev.agent END IGNORE NULLS) OVER w AS da, res.content AS rc,
   max(CAST(coalesce(ev.action = 'read_doc' AND ev.kind = 'TOOL_CALL' AND NOT regexp_matches(res.content, '(?i)^\s*(error|exception|traceback|fatal|failed)\b'), false) AS INT)) OVER w AS okread
   FROM ev LEFT JOIN res ON res.trace_id = ev.trace_id AND res.ref = ev.idx WINDOW w AS (PARTITION BY ev.trace_id ORDER BY ev.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c1 AS (SELECT trace_id, 'malformed_tool_call' AS rule, idx AS step, agent, 'FM-2.6' AS code FROM b0 WHERE kind = 'TOOL_CALL' AND regexp_matches(rc, '(?i)^\s*(error|exception|traceback|fatal|failed)\b')),
c2 AS (SELECT trace_id, 'premature_success_claim' AS rule, coalesce(di, idx) AS step, coalesce(da, agent) AS agent, 'FM-3.1' AS code FROM b0 WHERE action = 'submit' AND coalesce(okread, 0) = 0),
c3 AS (SELECT trace_id, 'invalid_output' AS rule, min_by(di, idx) AS step, min_by(da, idx) AS agent, 'FM-1.1' AS code FROM b0 WHERE kind = 'VERIFIER' AND content LIKE 'failed%' AND regexp_matches(content, '(?i)missing|required|format|citation|invalid') AND di IS NOT NULL GROUP BY trace_id),
rp AS (SELECT trace_id, idx, agent, count(*) OVER (PARTITION BY trace_id, signature) AS n, row_number() OVER (PARTITION BY trace_id, signature ORDER BY idx) AS nth FROM sg WHERE action_class = 'FILE_READ'),
c4 AS (SELECT h.trace_id, 'no_progress_loop' AS rule, h.step, sg.agent, 'FM-1.3' AS code FROM (SELECT trace_id, coalesce(onset, start_idx) AS step FROM lo UNION ALL SELECT trace_id, start_idx FROM rs) h LEFT JOIN sg ON sg.trace_id = h.trace_id AND sg.idx = h.step UNION ALL SELECT trace_id, 'no_progress_loop', idx, agent, 'FM-1.3' FROM rp WHERE n >= 3 AND nth = 1)
"""


def loops_of(events):
    s = r.sign_actions(events)
    return s, a.search_loops(s, 3), a.redundant_searches(s)


@trace_query("c1_malformed_tool_call", RULE_SQL + "SELECT * FROM c1")
def c1(events, traces):
    return c.malformed_calls(events)


@trace_query("c2_premature_success", RULE_SQL + "SELECT * FROM c2")
def c2(events, traces):
    return c.premature_success(events)


@trace_query("c3_invalid_output", RULE_SQL + "SELECT * FROM c3")
def c3(events, traces):
    return c.invalid_outputs(events)


@trace_query("c4_no_progress_loop", RULE_SQL + "SELECT * FROM c4")
def c4(events, traces):
    return c.no_progress(*loops_of(events))


@trace_query("c4_without_loop_tables", RULE_SQL + "SELECT trace_id, 'no_progress_loop' AS rule, min(idx) AS step, min_by(agent, idx) AS agent, 'FM-1.3' AS code FROM sg WHERE action_class IN ('SEARCH', 'FILE_READ') GROUP BY trace_id, signature HAVING count(*) >= 3")
def c4_alone(events, traces):
    return c.no_progress(r.sign_actions(events))


@trace_query("c5_rule_findings", RULE_SQL + "SELECT *, 0 AS rule_order, 0.9::DOUBLE AS confidence FROM c1 UNION ALL SELECT *, 1, 0.9 FROM c2 UNION ALL SELECT *, 2, 0.9 FROM c3 UNION ALL SELECT *, 3, 0.9 FROM c4")
def c5(events, traces):
    return c.rule_findings(events, *loops_of(events))


@trace_query("c6_symptoms", SYM_SQL + "SELECT * FROM sy")
def c6(events, traces):
    return c.symptoms(events)


@trace_query("c6_primary_symptom", SYM_SQL + "SELECT trace_id, min_by(fault, rule_no) AS fault, min_by(step, rule_no) AS step, min_by(agent, rule_no) AS agent, min_by(code, rule_no) AS code FROM sy GROUP BY trace_id")
def c6_primary(events, traces):
    return c.primary_symptom(c.symptoms(events))


SEG_EV = "halfs AS (SELECT trace_id, max(idx) // 2 AS mid FROM ev GROUP BY ALL), full_ev AS (SELECT * FROM ev), "


@trace_query("c7_segment_symptoms", r"hf AS (SELECT trace_id, max(idx) // 2 AS mid FROM ev GROUP BY ALL), sv AS (SELECT ev.* FROM ev JOIN hf USING (trace_id) WHERE idx <= mid), " + SYM_SQL.replace("FROM ev ", "FROM sv ") + r", hh AS (SELECT *, max(CAST(coalesce(kind = 'TOOL_RESULT' AND (action = 'search' OR (action = 'read_doc' AND NOT regexp_matches(content, '(?i)^\s*error'))), false) AS INT)) OVER (PARTITION BY trace_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS shown FROM sv) SELECT trace_id FROM sy0 UNION SELECT trace_id FROM hh WHERE kind IN ('LLM_CALL', 'HANDOFF') AND shown = 1 AND regexp_matches(content, '(?i)no (relevant|results|documents)|nothing found') UNION SELECT trace_id FROM sv WHERE kind = 'LLM_CALL' AND regexp_matches(content, '(?i)recall|from memory|submit directly')")
def c7(events, traces):
    half = F.floor(F.max("idx").over(Window.partitionBy("trace_id")) / 2)
    return c.segment_symptoms(events.withColumn("mid", half).where("idx <= mid").drop("mid"))


def sample_labels(events):
    """Label verdicts of each trace from its symptoms, with an unknown code for every seventh rule pair and a novel label."""
    s = c.symptoms(events).withColumn("code", F.when((F.col("step") % 7) == 3, "FM-9.9").when((F.col("step") % 5) == 4, "novel").otherwise(F.col("code")))
    label = F.struct("code", F.when((F.col("step") % 2) == 0, F.col("fault")).alias("symptom"), "step")
    return s.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_no", label.alias("l")))), lambda x: x["l"]).alias("labels"))


@trace_query("c8_checked_labels", SYM_SQL + ", lb AS (SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY rule_no) - 1 AS INT) AS pos, CASE WHEN step % 7 = 3 THEN 'FM-9.9' WHEN step % 5 = 4 THEN 'novel' ELSE code END AS code, CASE WHEN step % 2 = 0 THEN fault END AS symptom FROM sy), l2 AS (SELECT *, CASE WHEN code = 'FM-9.9' THEN false WHEN code = 'novel' THEN symptom IS NOT NULL ELSE true END AS ok FROM lb), l3 AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY trace_id ORDER BY pos) AS nth FROM l2) SELECT trace_id, pos, code, CASE WHEN NOT ok THEN 'invalid' WHEN nth <= 2 THEN 'kept' ELSE 'overflow' END AS status FROM l3")
def c8(events, traces):
    modes = events.sparkSession.createDataFrame([(m,) for m in MODES], "code string")
    return c.checked_labels(sample_labels(events), modes, most=2)


@trace_query("c10_novel_symptoms", "n AS (SELECT trace_id, content, count(*) AS n, min(idx) AS step FROM ev WHERE kind = 'HANDOFF' AND content <> '' GROUP BY ALL HAVING count(*) >= 2), o AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY n DESC, content) AS rn FROM n), l AS (SELECT trace_id, max_by(content, idx) AS content, max(idx) AS idx FROM ev WHERE kind = 'LLM_CALL' GROUP BY ALL) SELECT coalesce(l.trace_id, o.trace_id) AS trace_id, coalesce(o.content, substr(l.content, 1, 100)) AS symptom, coalesce(o.step, l.idx) AS step FROM l FULL JOIN (SELECT * FROM o WHERE rn = 1) o ON o.trace_id = l.trace_id")
def c10(events, traces):
    return c.novel_symptoms(events)


@trace_query("c12_trigram_jaccard", r"t AS (SELECT DISTINCT task AS a, 'task report ' || time_window AS b FROM tr), g AS (SELECT a, b, list_distinct(list_transform(range(1, length(a) - 1), lambda i: substr(a, i, 3))) AS x, list_distinct(list_transform(range(1, length(b) - 1), lambda i: substr(b, i, 3))) AS y FROM t) SELECT a, b, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS similarity FROM g")
def c12(events, traces):
    t = traces.select(F.col("task").alias("a"), F.concat(F.lit("task report "), "time_window").alias("b")).distinct()
    x, y = c.trigrams(F.col("a")), c.trigrams(F.col("b"))
    return t.select("a", "b", (F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).alias("similarity"))


def symptom_texts(events):
    """Distinct messages and novel symptoms, in order of their text, each with its number of candidates (trace, symptom)."""
    texts = c.novel_symptoms(events).select(F.regexp_replace("symptom", r"^\s+|\s+$", "").alias("symptom")).where("symptom <> ''").groupBy("symptom").agg(F.count("*").alias("n"))
    return durable(texts.select(F.col("symptom").alias("ord"), "symptom", "n"))


#: The greedy pass itself: texts in order, each with all leaders so far.
CLUSTER_SQL = r"""
nv AS (SELECT trace_id, content, count(*) AS n, min(idx) AS step FROM ev WHERE kind IN ('HANDOFF', 'AGENT_MESSAGE') AND content <> '' GROUP BY ALL HAVING count(*) >= 2),
nw AS (SELECT trace_id, content FROM nv QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY n DESC, content) = 1),
nl AS (SELECT trace_id, arg_max(content, idx) AS content FROM ev WHERE kind = 'LLM_CALL' GROUP BY ALL),
tx AS (SELECT symptom, count(*) AS n FROM (SELECT trim(coalesce(nw.content, substr(nl.content, 1, 100))) AS symptom FROM nl FULL JOIN nw ON nw.trace_id = nl.trace_id) WHERE symptom <> '' GROUP BY symptom),
tg AS (SELECT symptom, n, row_number() OVER (ORDER BY symptom) AS i, trim(regexp_replace(regexp_replace(lower(symptom), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) AS m FROM tx),
th AS (SELECT symptom, n, i, CASE WHEN length(m) >= 3 THEN list_distinct(list_transform(range(1, length(m) - 1), lambda j: substr(m, j, 3))) ELSE [m] END AS g FROM tg),
lc AS (WITH RECURSIVE gr AS (
    SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS symptom, CAST(NULL AS VARCHAR) AS leader, CAST([] AS STRUCT(t VARCHAR, g VARCHAR[])[]) AS leaders
    UNION ALL SELECT th.i, th.symptom, coalesce(hit, th.symptom), CASE WHEN hit IS NULL THEN list_append(leaders, {'t': th.symptom, 'g': th.g}) ELSE leaders END
    FROM (SELECT gr.*, th.i AS j, th.symptom AS s2, list_filter(leaders, lambda l: len(list_intersect(l.g, th.g)) / len(list_distinct(list_concat(l.g, th.g))) >= 0.35)[1].t AS hit FROM gr JOIN th ON th.i = gr.i + 1) x JOIN th ON th.i = x.j)
  SELECT symptom, leader FROM gr WHERE i > 0)
"""


@trace_query("c13_leader_clusters", CLUSTER_SQL + "SELECT symptom AS ord, leader FROM lc")
def c13(events, traces):
    nodes = symptom_texts(events)
    return c.leader_clusters(nodes, c.similar_pairs(nodes))


@trace_query("c15_cluster_sizes", CLUSTER_SQL + "SELECT leader, CAST(sum(n) AS BIGINT) AS size FROM lc JOIN tx USING (symptom) GROUP BY leader")
def c15(events, traces):
    nodes = symptom_texts(events)
    return c.cluster_sizes(c.leader_clusters(nodes, c.similar_pairs(nodes)), nodes)
