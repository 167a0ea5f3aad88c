"""Queries of the representation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import represent as r
from tracewright.plans.registry import query, trace_query
from tracewright.sources.fixtures import table

SIG_SQL = r"""
res AS (SELECT trace_id, ref, min_by(content, idx) AS content FROM ev WHERE kind = 'TOOL_RESULT' AND ref IS NOT NULL GROUP BY ALL),
ver AS (SELECT trace_id, ref, min_by(content, idx) AS content FROM ev WHERE kind = 'VERIFIER' AND ref IS NOT NULL GROUP BY ALL),
ac AS (SELECT *, CASE WHEN kind = 'TOOL_CALL' AND action = 'search' THEN 'SEARCH' WHEN kind = 'TOOL_CALL' AND action = 'read_doc' THEN 'FILE_READ' WHEN kind IN ('TOOL_CALL', 'VERIFIER') THEN 'COMMAND' WHEN kind = 'HANDOFF' THEN 'AGENT_SPAWN'
     WHEN kind = 'LLM_CALL' AND phase = 'plan' THEN 'PLAN' WHEN kind = 'LLM_CALL' THEN 'REASON' END AS action_class,
   CASE WHEN action = 'search' THEN lower(trim(query)) WHEN action = 'read_doc' THEN doc_id WHEN action = 'submit' THEN 'submit' WHEN kind = 'VERIFIER' THEN 'verify' WHEN kind = 'HANDOFF' THEN to_agent WHEN phase = 'plan' THEN substr(lower(content), 1, 60) END AS target
   FROM ev WHERE kind IN ('TOOL_CALL', 'VERIFIER', 'HANDOFF', 'LLM_CALL')),
sg AS (SELECT ac.trace_id, ac.idx, ac.id, ac.kind, ac.agent, action_class, target, CASE WHEN target IS NULL THEN action_class ELSE action_class || '(' || target || ')' END AS signature,
   CASE WHEN action_class = 'REASON' THEN 'REASONING' WHEN action_class IN ('PLAN', 'AGENT_SPAWN') THEN 'RECORDED' WHEN kind = 'VERIFIER' THEN 'JUSTIFIED' WHEN action = 'submit' THEN CASE WHEN ver.content LIKE 'passed%' THEN 'SURVIVED' ELSE 'FAILED' END
     WHEN coalesce(regexp_matches(res.content, '(?i)^\s*(error|exception|traceback|fatal|failed)\b'), false) THEN 'FAILED' WHEN action_class = 'FILE_READ' THEN 'JUSTIFIED' ELSE 'RECORDED' END AS effect,
   CASE WHEN kind = 'VERIFIER' THEN ac.content LIKE 'passed%' END AS passed, res.content AS result
   FROM ac LEFT JOIN res ON res.trace_id = ac.trace_id AND res.ref = ac.idx LEFT JOIN ver ON ver.trace_id = ac.trace_id AND ver.ref = ac.idx),
anc AS (SELECT task_id, list_sort(list(DISTINCT target)) AS anchor FROM sg JOIN tr USING (trace_id) WHERE success AND action_class = 'FILE_READ' AND effect <> 'FAILED' GROUP BY task_id),
sa AS (SELECT sg.* EXCLUDE (effect), anchor, CASE WHEN anchor IS NOT NULL AND action_class IN ('SEARCH', 'FILE_READ') AND effect <> 'FAILED' THEN
     CASE WHEN CASE WHEN action_class = 'FILE_READ' THEN list_contains(anchor, target) ELSE coalesce(list_has_any(regexp_extract_all(result, 'd\d+'), anchor), false) END THEN 'JUSTIFIED' ELSE 'OFF-ANCHOR' END ELSE effect END AS effect
   FROM sg JOIN tr USING (trace_id) LEFT JOIN anc USING (task_id))
"""


def anchored(events, traces):
    signed = r.sign_actions(events)
    return r.judge_by_anchor(signed, r.anchor_documents(signed, traces), traces)


def order_spans(spark, sf_dir):
    """Span tree customer > order > line; lines number by (line, part, supplier)."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    trace = F.col("o_custkey").cast("string")
    orders = o.select(trace.alias("trace_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderkey").alias("ordinal"))
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    lines = li.join(o.select("o_orderkey", "o_custkey"), li["l_orderkey"] == o["o_orderkey"]).select(trace.alias("trace_id"), key.alias("span_id"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("parent_span_id"), F.col("l_orderkey").cast("string").alias("k"), F.col("l_linenumber").cast("long").alias("ordinal"))
    return orders.unionByName(lines)


SPAN_SQL = """
sp AS (SELECT CAST(o_custkey AS VARCHAR) AS trace_id, 'o' || o_orderkey AS span_id, NULL AS parent, CAST(o_orderkey AS BIGINT) AS a, NULL AS b, NULL AS c FROM orders
  UNION ALL SELECT CAST(o_custkey AS VARCHAR), l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'o' || l_orderkey, CAST(o_orderkey AS BIGINT), CAST(l_linenumber AS BIGINT), l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
fl AS (SELECT *, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY a, b NULLS FIRST, c NULLS FIRST) - 1 AS INT) AS idx FROM sp)"""


@query("r1_span_flatten", f"WITH {SPAN_SQL} SELECT f.trace_id, f.span_id, f.idx, 'e' || lpad(CAST(f.idx AS VARCHAR), CAST(greatest(3, length(CAST(f.idx AS VARCHAR))) AS INT), '0') AS id, CASE WHEN f.parent IS NULL THEN 1 ELSE 2 END AS depth, 'e' || lpad(CAST(p.idx AS VARCHAR), CAST(greatest(3, length(CAST(p.idx AS VARCHAR))) AS INT), '0') AS parent_id FROM fl f LEFT JOIN fl p ON p.trace_id = f.trace_id AND p.span_id = f.parent")
def r1(spark, sf_dir):
    return r.flatten_spans(order_spans(spark, sf_dir), max_depth=3)


RAW_KIND = "CASE event_type WHEN 'click' THEN 'tool_call' WHEN 'view' THEN ' span ' WHEN 'purchase' THEN 'GENERATION' WHEN 'signup' THEN 'LLM_CALL' ELSE 'mystery' END"


@query("r2_kind_admission", f"WITH e AS (SELECT upper(trim({RAW_KIND})) AS k FROM events) SELECT CASE WHEN k IN ('TASK_START','LLM_CALL','TOOL_CALL','TOOL_RESULT','AGENT_MESSAGE','HANDOFF','VERIFIER','TASK_END') THEN k WHEN k = 'GENERATION' THEN 'LLM_CALL' ELSE 'AGENT_MESSAGE' END AS kind, k NOT IN ('TASK_START','LLM_CALL','TOOL_CALL','TOOL_RESULT','AGENT_MESSAGE','HANDOFF','VERIFIER','TASK_END') AS remapped, count(*) AS n FROM e GROUP BY ALL")
def r2(spark, sf_dir):
    kind, remapped = r.admit_kind(F.expr(RAW_KIND))
    return table(spark, sf_dir, "events").select(kind.alias("kind"), remapped.alias("remapped")).groupBy("kind", "remapped").agg(F.count("*").alias("n"))


@trace_query("r3_ts_fallback", "SELECT trace_id, idx, CASE WHEN k % 3 = 0 THEN CAST(idx AS DOUBLE) ELSE ts END AS ts FROM ev")
def r3(events, traces):
    ts = F.when(F.col("k") % 3 == 0, F.lit(None)).otherwise(F.col("ts"))
    return events.select("trace_id", "idx", r.time_or_index(ts).alias("ts"))


@query("r4_ref_remap", f"WITH {SPAN_SQL} SELECT f.trace_id, f.span_id, coalesce(p.id, '') AS refs, CAST(1 AS BIGINT) + CASE WHEN p.id IS NULL THEN 1 ELSE 0 END AS dropped FROM fl f LEFT JOIN (SELECT trace_id, span_id, 'e' || lpad(CAST(min(idx) AS VARCHAR), CAST(greatest(3, length(CAST(min(idx) AS VARCHAR))) AS INT), '0') AS id FROM fl GROUP BY ALL) p ON p.trace_id = f.trace_id AND p.span_id = f.parent WHERE f.parent IS NOT NULL")
def r4(spark, sf_dir):
    spans = order_spans(spark, sf_dir)
    lines = spans.where("parent_span_id is not null").select("trace_id", "span_id", F.array("parent_span_id", F.lit("gone")).alias("refs"))
    out = r.remap_refs(lines, r.flatten_spans(spans, max_depth=3))
    return out.select("trace_id", "span_id", F.array_join("refs", ",").alias("refs"), "dropped")


@trace_query("r5_flat_normalize", "SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY idx) - 1 AS INT) AS idx, 'e' || lpad(CAST(CASE WHEN k % 2 = 0 THEN row_number() OVER (PARTITION BY trace_id ORDER BY idx) - 1 ELSE idx END AS VARCHAR), 3, '0') AS id, CASE WHEN k % 5 = 0 THEN CAST(row_number() OVER (PARTITION BY trace_id ORDER BY idx) - 1 AS DOUBLE) ELSE ts END AS ts FROM ev WHERE kind <> 'VERIFIER'")
def r5(events, traces):
    e = events.where("kind <> 'VERIFIER'").withColumns({"id": F.when(F.col("k") % 2 == 0, "").otherwise(F.col("id")), "ts": F.when(F.col("k") % 5 == 0, -1.0).otherwise(F.col("ts"))})
    return r.normalize_flat(e).select("trace_id", "idx", "id", "ts")


@trace_query("r6_canonical_stats", "a AS (SELECT trace_id, agent, min(idx) AS first_at, count(*) AS n, count(ref) AS refs FROM ev GROUP BY ALL) SELECT trace_id, CAST(sum(n) AS BIGINT) AS n_events, CAST(sum(refs) AS BIGINT) AS n_refs, string_agg(agent, ',' ORDER BY first_at) AS agents FROM a GROUP BY trace_id")
def r6(events, traces):
    return r.canonical_stats(events)


@trace_query("r6_kind_histogram", "SELECT trace_id, kind, count(*) AS n FROM ev GROUP BY ALL")
def r6_kinds(events, traces):
    return events.groupBy("trace_id", "kind").agg(F.count("*").alias("n"))


FOLD_SQL = r"""
fd AS (SELECT *, CASE WHEN regexp_matches(content, '(?i)^\s*(error|exception|traceback|fatal|failed)\b') THEN 'keep_error' WHEN length(content) <= 120 THEN 'keep_short' ELSE 'fold' END AS decision FROM ev WHERE kind = 'TOOL_RESULT' AND content <> ''),
fn AS (SELECT trace_id, idx, decision, content, CASE WHEN decision = 'fold' THEN 'F' || sum(CAST(decision = 'fold' AS INT)) OVER (PARTITION BY trace_id ORDER BY idx) END AS fid FROM fd)"""
#: Long results of every kind: with failure words inside, with a diff, with an extra keyword, plain; and empty ones.
RESULT_WORLD = """
fw AS (SELECT trace_id, idx, CASE k % 6 WHEN 0 THEN 'the import failed: ' || repeat('x ', 80) WHEN 1 THEN repeat('y ', 70) || chr(10) || '@@ -1,2 +3 @@' WHEN 2 THEN 'Quota Reached ' || repeat('z ', 80) WHEN 3 THEN '' WHEN 4 THEN ' ERROR: gone ' || repeat('w ', 80) ELSE repeat('plain ', 40) END AS content FROM ev WHERE kind = 'TOOL_RESULT'),
"""
_DECIDE = "CASE WHEN regexp_matches(content, '(?i)^\\s*(error|exception|traceback|fatal|failed)\\b') OR {more} THEN 'keep_error' WHEN regexp_matches(content, '@@ -1') THEN 'keep_patch' WHEN length(content) <= 120 THEN 'keep_short' ELSE 'fold' END"


def result_world(events):
    k, x = F.col("k"), lambda c: F.repeat(F.lit(c), 80)
    text = F.when(k % 6 == 0, F.concat(F.lit("the import failed: "), x("x "))).when(k % 6 == 1, F.concat(F.repeat(F.lit("y "), 70), F.lit("\n@@ -1,2 +3 @@"))).when(k % 6 == 2, F.concat(F.lit("Quota Reached "), x("z "))).when(k % 6 == 3, "").when(k % 6 == 4, F.concat(F.lit(" ERROR: gone "), x("w "))).otherwise(F.repeat(F.lit("plain "), 40))
    return events.withColumn("content", F.when(F.col("kind") == "TOOL_RESULT", text).otherwise(F.col("content")))


@trace_query("r7_saliency_fold", FOLD_SQL + " SELECT trace_id, idx, decision, fid, '⟦folded:' || fid || ' | ' || substr(trim(regexp_replace(content, '\\s+', ' ', 'g')), 1, 100) || '⟧' AS placeholder FROM fn")
def r7(events, traces):
    return r.fold(events).drop("content")


@trace_query("r7_fold_modes", RESULT_WORLD + f"fm AS (SELECT trace_id, idx, {_DECIDE.format(more='false')} AS strict, {_DECIDE.format(more=chr(39) + 'x' + chr(39) + ' = ' + chr(39) + chr(39) + ' OR regexp_matches(content, ' + chr(39) + '(?i)failed' + chr(39) + ')')} AS loose, {_DECIDE.format(more='contains(lower(content), ' + chr(39) + 'quota reached' + chr(39) + ')')} AS extra FROM fw WHERE content <> '') SELECT * FROM fm")
def r7_modes(events, traces):
    e = result_world(events)
    key = ["trace_id", "idx"]
    one = lambda name, **how: r.fold(e, **how).select(*key, F.col("decision").alias(name))
    return one("strict").join(one("loose", loose=True), key).join(one("extra", extra=("quota REACHED",)), key)


@trace_query("r7_fold_ratio", RESULT_WORLD + f"fm AS (SELECT trace_id, content, {_DECIDE.format(more='false')} AS d FROM fw) SELECT t.trace_id, count(content) AS n_tool_results, count(*) FILTER (content <> '' AND d = 'fold') AS n_folded, count(*) FILTER (content <> '' AND d = 'keep_error') AS n_kept_error, count(*) FILTER (content <> '' AND d = 'keep_patch') AS n_kept_patch, count(*) FILTER (content <> '' AND d = 'keep_short') AS n_kept_short, coalesce(round(count(*) FILTER (content <> '' AND d = 'fold') / nullif(count(content), 0), 4), 0.0)::DOUBLE AS fold_ratio FROM tr t LEFT JOIN fm USING (trace_id) GROUP BY t.trace_id")
def r7_ratio(events, traces):
    e = result_world(events)
    return r.fold_stats(e, r.fold(e))


@trace_query("r8_unfold", FOLD_SQL + " SELECT trace_id, idx, 'obs ' || content AS line, false AS missing FROM fn")
def r8(events, traces):
    folds = r.fold(events)
    return r.unfold(folds.select("trace_id", "idx", F.concat(F.lit("obs "), F.coalesce("placeholder", "content")).alias("line")), folds)


@trace_query("r9_action_classify", SIG_SQL + " SELECT trace_id, idx, action_class, target, signature FROM sg")
def r9(events, traces):
    return r.classify_actions(events).select("trace_id", "idx", "action_class", "target", "signature")


@trace_query("r10_effects", SIG_SQL + " SELECT trace_id, idx, signature, effect, passed FROM sa")
def r10(events, traces):
    return anchored(events, traces).select("trace_id", "idx", "signature", "effect", "passed")


@trace_query("r11_anchor_sets", SIG_SQL + " SELECT task_id, array_to_string(anchor, ',') AS anchor FROM anc")
def r11(events, traces):
    return r.anchor_sets(r.sign_actions(events), traces).select("task_id", F.array_join("anchor", ",").alias("anchor"))


@trace_query("r12_anchor_hits", SIG_SQL + " SELECT trace_id, idx, action_class, effect = 'JUSTIFIED' AS hit FROM sa WHERE anchor IS NOT NULL AND action_class IN ('SEARCH', 'FILE_READ') AND effect <> 'FAILED'")
def r12(events, traces):
    return anchored(events, traces).where("n_anchor is not null and action_class in ('SEARCH', 'FILE_READ') and effect <> 'FAILED'").select("trace_id", "idx", "action_class", (F.col("effect") == "JUSTIFIED").alias("hit"))


@trace_query("r13_reference_traces", "n AS (SELECT trace_id, count(*) AS n_events FROM ev GROUP BY ALL), o AS (SELECT task_id, trace_id, n_events, row_number() OVER (PARTITION BY task_id ORDER BY n_events, trace_id) AS rn FROM tr JOIN n USING (trace_id) WHERE success) SELECT task_id, trace_id, n_events FROM o WHERE rn = 1")
def r13(events, traces):
    return r.reference_traces(events, traces)


@trace_query("r14_milestones", SIG_SQL + ", fr AS (SELECT trace_id, target, min(idx) AS first_at FROM sa WHERE action_class = 'FILE_READ' AND effect <> 'FAILED' AND list_contains(anchor, target) GROUP BY ALL), f2 AS (SELECT trace_id, count(*) AS n, max(first_at) AS last_at, min(first_at) AS m1 FROM fr GROUP BY ALL) "
    "SELECT sa.trace_id, min(m1) AS m1, min(idx) FILTER (action_class = 'SEARCH' AND effect = 'JUSTIFIED') AS m2, min(CASE WHEN n = len(anchor) THEN last_at END) AS m3, min(idx) FILTER (passed) AS m4, min(idx) FILTER (effect = 'JUSTIFIED') AS m5 FROM sa LEFT JOIN f2 USING (trace_id) WHERE anchor IS NOT NULL GROUP BY sa.trace_id")
def r14(events, traces):
    return r.milestones(anchored(events, traces))


@trace_query("r17_signature_stats", SIG_SQL + " SELECT trace_id, action_class, effect, count(*) AS n FROM sa GROUP BY ALL")
def r17(events, traces):
    return r.signature_stats(anchored(events, traces))


EDGE_SQL = "ed AS (SELECT DISTINCT e.trace_id, s.id AS src, e.id AS dst, s.idx AS src_idx, e.idx AS dst_idx FROM ev e JOIN ev s ON s.trace_id = e.trace_id AND s.idx = e.ref WHERE s.idx < e.idx)"


@trace_query("r18_graph_nodes", "SELECT trace_id, id, idx, kind FROM ev WHERE coalesce(content, query, doc_id, answer, to_agent) IS NOT NULL OR ref IS NOT NULL")
def r18(events, traces):
    return r.graph_nodes(events)


@trace_query("r19_graph_edges", EDGE_SQL + " SELECT * FROM ed")
def r19(events, traces):
    return r.graph_edges(events)


@trace_query("r20_graph_stats", EDGE_SQL + ", n AS (SELECT trace_id, count(*) AS n FROM ev GROUP BY ALL), e AS (SELECT trace_id, count(*) AS m, count(DISTINCT dst) AS d FROM ed GROUP BY ALL) SELECT trace_id, n AS n_nodes, coalesce(m, 0) AS n_edges, n - coalesce(d, 0) AS n_sources, 1.0::DOUBLE AS node_ratio, coalesce(m, 0) / n AS edges_per_node FROM n LEFT JOIN e USING (trace_id)")
def r20(events, traces):
    return r.graph_stats(events)


@trace_query("r21_ancestors", EDGE_SQL + ", last AS (SELECT trace_id, max(idx) AS idx FROM ev GROUP BY ALL), anc_walk AS (SELECT l.trace_id, e.idx, e.ref, 0 AS depth FROM last l JOIN ev e USING (trace_id, idx)), a1 AS (SELECT w.trace_id, e.idx, e.ref, w.depth + 1 AS depth FROM anc_walk w JOIN ev e ON e.trace_id = w.trace_id AND e.idx = w.ref) "
    ", " + ", ".join(f"a{k} AS (SELECT w.trace_id, e.idx, e.ref, w.depth + 1 AS depth FROM a{k - 1} w JOIN ev e ON e.trace_id = w.trace_id AND e.idx = w.ref)" for k in range(2, 9)) + " SELECT trace_id, id, depth FROM (SELECT * FROM anc_walk " + " ".join(f"UNION ALL SELECT * FROM a{k}" for k in range(1, 9)) + ") u JOIN ev USING (trace_id, idx)")
def r21(events, traces):
    return r.ancestors(events)


TREE_SQL = """
st AS (SELECT *, NOT coalesce(kind = 'TOOL_CALL' AND action IN ('search', 'read_doc'), false) AS state FROM ev WHERE kind IN ('LLM_CALL', 'TOOL_CALL', 'HANDOFF')),
s1 AS (SELECT *, lag(id) OVER (PARTITION BY trace_id ORDER BY idx) AS prev, sum(CAST(state AS INT)) OVER (PARTITION BY trace_id ORDER BY idx) AS n_state, first_value(state) OVER (PARTITION BY trace_id ORDER BY idx) AS first_state FROM st),
s2 AS (SELECT *, last_value(CASE WHEN state THEN coalesce(prev, '-') END IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY idx) AS p FROM s1),
tree AS (SELECT trace_id, idx, id, nullif(p, '-') AS parent_step, CAST(1 + n_state - CAST(first_state AS INT) AS INT) AS depth, CASE WHEN state THEN 'state' ELSE 'explore' END AS step_class, phase FROM s2),
os AS (SELECT *, last_value(CASE WHEN kind IN ('LLM_CALL', 'TOOL_CALL', 'HANDOFF') THEN idx END IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY idx) AS step FROM ev),
sm0 AS (SELECT trace_id, step, substr(max(CASE WHEN idx = step THEN concat_ws(' ', agent, coalesce(action, lower(kind)), coalesce('query=' || substr(query, 1, 30), 'doc_id=' || substr(doc_id, 1, 30), 'answer=' || substr(answer, 1, 30), 'to=' || substr(to_agent, 1, 30), 'content=' || substr(content, 1, 30))) END), 1, 60) AS head,
  coalesce(string_agg(substr(content, 1, 40), ' | ' ORDER BY idx) FILTER (idx <> step AND content <> ''), '') AS outcome FROM os WHERE step IS NOT NULL GROUP BY ALL),
sm AS (SELECT trace_id, step, CASE WHEN outcome <> '' THEN substr(head || ' -> ' || outcome, 1, 100) ELSE head END AS summary, outcome FROM sm0)"""


@trace_query("r22_step_tree", TREE_SQL + " SELECT trace_id, idx, parent_step, depth, step_class FROM tree")
def r22(events, traces):
    return r.step_tree(events).select("trace_id", "idx", "parent_step", "depth", "step_class")


@trace_query("r23_step_summaries", TREE_SQL + " SELECT trace_id, step, summary, outcome FROM sm")
def r23(events, traces):
    return r.step_summaries(events)


@trace_query("r24_stage_ranges", "p AS (SELECT *, CASE WHEN lag(phase) OVER (PARTITION BY trace_id ORDER BY idx) = phase THEN 0 ELSE 1 END AS c FROM ev WHERE phase IS NOT NULL), q AS (SELECT *, CAST(sum(c) OVER (PARTITION BY trace_id ORDER BY idx) AS BIGINT) AS stage_no FROM p) SELECT trace_id, stage_no, min(phase) AS phase, min(idx) AS start_idx, max(idx) AS end_idx FROM q GROUP BY trace_id, stage_no")
def r24(events, traces):
    return r.stage_ranges(events)


@trace_query("r25_tree_markdown", TREE_SQL + ", l AS (SELECT tree.*, summary, outcome, lag(phase) OVER (PARTITION BY tree.trace_id ORDER BY idx) IS DISTINCT FROM phase AS mark FROM tree JOIN sm ON sm.trace_id = tree.trace_id AND sm.step = tree.idx) SELECT trace_id, string_agg(CASE WHEN mark THEN '## ' || coalesce(phase, '?') || chr(10) ELSE '' END || repeat('  ', depth - 1) || '- [' || idx || '] ' || summary || CASE WHEN outcome <> '' THEN ' => ' || outcome ELSE '' END, chr(10) ORDER BY idx) AS markdown FROM l GROUP BY trace_id")
def r25(events, traces):
    return r.tree_markdown(events)


SUB_SQL = """
c0 AS (SELECT *, last_value(phase IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_phase FROM ev),
su AS (SELECT * EXCLUDE (last_phase), CAST(greatest(1, sum(CASE WHEN phase IS NOT NULL AND (last_phase IS NULL OR last_phase <> phase) THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY idx)) - 1 AS INT) AS subtask FROM c0)"""


@trace_query("r26_subtasks", SUB_SQL + " SELECT trace_id, subtask, coalesce(min_by(phase, idx) FILTER (phase IS NOT NULL), 'task') AS phase, min(idx) AS start_idx, max(idx) AS end_idx FROM su GROUP BY trace_id, subtask")
def r26(events, traces):
    return r.subtasks(events)


@trace_query("r27_agent_nodes", SUB_SQL + ", w AS (SELECT su.*, CASE WHEN su.kind IN ('TOOL_RESULT', 'VERIFIER') THEN o.agent ELSE su.agent END AS owner FROM su LEFT JOIN ev o ON o.trace_id = su.trace_id AND o.idx = su.ref) SELECT trace_id, subtask, owner AS agent, min(idx) FILTER (kind = 'TOOL_RESULT') AS observation, min(idx) FILTER (kind = 'LLM_CALL') AS thought, min(idx) FILTER (kind = 'TOOL_CALL') AS action, min(idx) FILTER (kind = 'VERIFIER') AS result, string_agg(idx, ',' ORDER BY idx) AS steps FROM w WHERE owner NOT IN ('env', 'verifier') AND kind IN ('TOOL_RESULT', 'VERIFIER', 'LLM_CALL', 'TOOL_CALL') GROUP BY ALL")
def r27(events, traces):
    return r.agent_nodes(events)


@trace_query("r28_hcg_edges", SUB_SQL + ", " + EDGE_SQL + ", k AS (SELECT DISTINCT trace_id, subtask FROM su), l AS (SELECT *, lead(subtask) OVER (PARTITION BY trace_id ORDER BY subtask) AS nxt FROM k) SELECT trace_id, 'subtask' AS level, 'S' || subtask AS src, 'S' || nxt AS dst, NULL AS subtask, NULL AS step FROM l WHERE nxt IS NOT NULL UNION ALL SELECT trace_id, 'agent', agent, to_agent, 'S' || subtask, CAST(idx AS INT) FROM su WHERE kind = 'HANDOFF' UNION ALL SELECT trace_id, 'step', src, dst, NULL, NULL FROM ed")
def r28(events, traces):
    return r.hcg_edges(events)


@trace_query("r12_signed_ids", SIG_SQL + " SELECT trace_id, idx, action_class, effect = 'JUSTIFIED' AS hit FROM sa WHERE anchor IS NOT NULL AND action_class IN ('SEARCH', 'FILE_READ') AND effect <> 'FAILED'")
def r12_signed(events, traces):
    """The same hits when documents are called d-1.x in place of d1."""
    named = events.withColumns({"doc_id": F.regexp_replace("doc_id", r"^d(\d+)$", r"d-$1.x"), "content": F.regexp_replace("content", r"\bd(\d+)\b", r"d-$1.x")})
    return r12(named, traces)


def claim_world(events, traces):
    """The traces with every kind of claim in them: half of the answers cite a document, some reports are from memory, and the tasks of every other window ask for a citation."""
    k = F.col("k")
    e = events.withColumn("answer", F.when((F.col("action") == "submit") & (k % 2 == 0), F.concat("answer", F.lit(" [d"), (k % 9).cast("string"), F.lit("]"))).otherwise(F.col("answer")))
    e = e.withColumn("content", F.when((F.col("kind") == "LLM_CALL") & (F.col("agent") == "reporter") & (k % 13 == 0), "answer: unknown").otherwise(F.col("content")))
    must = F.substring("time_window", 2, 9).cast("int") % 2 == 0
    return e, traces.withColumn("task", F.when(must, F.concat("task", F.lit(": the answer must cite a document"))).otherwise(F.col("task")))


CLAIM_SQL = """
ec AS (SELECT * REPLACE (CASE WHEN action = 'submit' AND k % 2 = 0 THEN answer || ' [d' || k % 9 || ']' ELSE answer END AS answer, CASE WHEN kind = 'LLM_CALL' AND agent = 'reporter' AND k % 13 = 0 THEN 'answer: unknown' ELSE content END AS content) FROM ev),
k0 AS (SELECT *, first_value(CASE WHEN kind IN ('HANDOFF', 'LLM_CALL', 'TOOL_CALL') THEN idx END IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS effective FROM ec),
k1 AS (
  SELECT trace_id, idx, effective, 0 AS late, 'the answer is already known from memory' AS text, 'entity' AS claim_type, 'finalized' AS status FROM k0 WHERE kind = 'LLM_CALL' AND starts_with(content, 'plan:') AND regexp_matches(content, '(?i)recall|from memory|submit directly')
  UNION ALL SELECT trace_id, idx, effective, 0, 'the task will be solved by search-read-report', 'process', 'consequential' FROM k0 WHERE kind = 'LLM_CALL' AND starts_with(content, 'plan:') AND NOT regexp_matches(content, '(?i)recall|from memory|submit directly')
  UNION ALL SELECT trace_id, idx, effective, 0, 'no relevant documents were found', 'evidence', 'consequential' FROM k0 WHERE kind = 'HANDOFF' AND contains(to_agent, 'reporter') AND regexp_matches(content, '(?i)no (relevant|usable|documents)|nothing found')
  UNION ALL SELECT trace_id, idx, effective, 0, substr(content, 1, 120), 'evidence', 'consequential' FROM k0 WHERE kind = 'HANDOFF' AND contains(to_agent, 'reporter') AND content <> '' AND NOT regexp_matches(content, '(?i)no (relevant|usable|documents)|nothing found')
  UNION ALL SELECT trace_id, idx, effective, 0, substr(content, 1, 120), 'evidence', 'finalized' FROM k0 WHERE kind = 'LLM_CALL' AND NOT starts_with(content, 'plan:') AND regexp_matches(content, '(?i)based on|answer:|proposes')
  UNION ALL SELECT trace_id, min(idx), min_by(effective, idx), 1, 'the final answer must cite a document actually read', 'constraint', 'consequential' FROM k0 JOIN tr USING (trace_id) WHERE action = 'submit' AND CAST(substr(time_window, 2) AS INT) % 2 = 0 GROUP BY trace_id),
k2 AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY late, idx) AS n FROM k1),
cl AS (SELECT trace_id, 'c' || n AS claim_id, text, claim_type, status, idx AS introduced, effective, n FROM k2 WHERE n <= 5)"""


@trace_query("r30_rule_claims", CLAIM_SQL + " SELECT trace_id, claim_id, text, claim_type, status, introduced, effective, coalesce(CAST(effective AS VARCHAR), '') AS reuse FROM cl")
def r30(events, traces):
    return r.rule_claims(*claim_world(events, traces)).withColumn("reuse", F.array_join(F.col("reuse").cast("array<string>"), ","))


LINE_SQL = r"""
js AS (SELECT *, nullif('{' || concat_ws(',', '"query":"' || query || '"', '"doc_id":"' || doc_id || '"', '"answer":"' || answer || '"', '"to":"' || to_agent || '"') || '}', '{}') AS load FROM ev),
ln AS (SELECT trace_id, idx, trim(regexp_replace(concat_ws(' ', '[' || idx || ']', kind, agent, action, load) || CASE WHEN coalesce(content, '') <> '' THEN ' :: ' || content ELSE '' END, '\s+', ' ', 'g')) AS l FROM js),
li AS (SELECT trace_id, idx, CASE WHEN length(l) > 400 THEN substr(l, 1, 397) || '...' ELSE l END AS line FROM ln)"""


@trace_query("r31_render_lines", LINE_SQL + " SELECT * FROM li")
def r31(events, traces):
    return r.render_lines(events)


@trace_query("r32_render_traces", LINE_SQL + " SELECT trace_id, 'TASK: ' || min(task) || chr(10) || '=== TRACE BEGIN ===' || chr(10) || string_agg(line, chr(10) ORDER BY idx) || chr(10) || '=== TRACE END ===' AS view FROM li JOIN tr USING (trace_id) GROUP BY trace_id")
def r32(events, traces):
    return r.render_traces(events, traces)
