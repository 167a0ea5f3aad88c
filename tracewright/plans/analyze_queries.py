"""Queries of loop and drift analysis."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tracewright.operators import analyze as a
from tracewright.operators import classify as c
from tracewright.operators import represent as r
from tracewright.plans.represent_queries import SIG_SQL
from tracewright.plans.noise import dressed
from tracewright.plans.registry import trace_query

LOOP_SQL = SIG_SQL + """,
l0 AS (SELECT *, sum(CAST(action_class = 'FILE_WRITE' OR (action_class = 'COMMAND' AND target = 'verify') AS INT)) OVER (PARTITION BY trace_id ORDER BY idx) AS run, row_number() OVER (PARTITION BY trace_id ORDER BY idx) AS pos FROM sg),
l1 AS (SELECT *, row_number() OVER (PARTITION BY trace_id, run, signature ORDER BY idx) AS nth FROM l0 WHERE action_class IN ('SEARCH', 'FILE_READ')),
lo AS (SELECT trace_id, min(idx) AS start_idx, max(idx) AS end_idx, count(*) AS length, min(idx) FILTER (nth = 2) AS onset, coalesce(string_agg(DISTINCT signature, ',' ORDER BY signature) FILTER (nth = 2), '') AS repeated FROM l1 GROUP BY trace_id, run HAVING count(*) >= 3),
rs0 AS (SELECT *, count(*) OVER w AS repeats, max(idx) OVER w AS end_idx FROM l0 WHERE action_class = 'SEARCH' WINDOW w AS (PARTITION BY trace_id, target ORDER BY pos RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING)),
rs AS (SELECT trace_id, target, min_by(idx, pos) AS start_idx, min_by(end_idx, pos) AS end_idx, min_by(repeats, pos) AS repeats FROM rs0 WHERE repeats >= 2 GROUP BY ALL)
"""


@trace_query("a1_search_loop", LOOP_SQL + "SELECT * FROM lo")
def a1(events, traces):
    """Runs of three or more: the fixture holds few of ten."""
    return a.search_loops(r.sign_actions(events), 3)


@trace_query("a2_reread_churn", LOOP_SQL + ", rr0 AS (SELECT *, count(*) OVER w AS repeats, max(idx) OVER w AS end_idx FROM l0 WHERE action_class = 'FILE_READ' WINDOW w AS (PARTITION BY trace_id, target ORDER BY pos RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING)) SELECT trace_id, target, min_by(idx, pos) AS start_idx, min_by(end_idx, pos) AS end_idx, min_by(repeats, pos) AS repeats FROM rr0 WHERE repeats >= 2 GROUP BY trace_id, target")
def a2(events, traces):
    return a.reread_churn(r.sign_actions(events), repeat=2)


@trace_query("a3_redundant_search", LOOP_SQL + "SELECT * FROM rs")
def a3(events, traces):
    return a.redundant_searches(r.sign_actions(events))


OSC = "CASE WHEN action_class = 'SEARCH' THEN 'FILE_WRITE' ELSE action_class END"


@trace_query("a4_tool_oscillation", SIG_SQL + ", o0 AS (SELECT trace_id, idx, CASE WHEN action_class = 'SEARCH' THEN 'FILE_WRITE' ELSE action_class END AS action_class, 'all' AS target, CASE WHEN action_class = 'SEARCH' THEN 'FAILED' ELSE effect END AS effect FROM sg WHERE action_class IN ('SEARCH', 'FILE_READ')), o1 AS (SELECT *, lead(action_class) OVER w AS c1, lead(effect) OVER w AS e1, lead(action_class, 2) OVER w AS c2, lead(idx, 2) OVER w AS i2 FROM o0 WINDOW w AS (PARTITION BY trace_id, target ORDER BY idx)) SELECT trace_id, target, min(idx) AS start_idx, max(i2) AS end_idx, count(*) AS cycles FROM o1 WHERE action_class = 'FILE_READ' AND c1 = 'FILE_WRITE' AND c2 = 'FILE_READ' AND e1 = 'FAILED' GROUP BY trace_id, target HAVING count(*) >= 2")
def a4(events, traces):
    """The event table has no writes: a search stands for a failed write of one common target."""
    s = r.sign_actions(events).where("action_class in ('SEARCH', 'FILE_READ')").withColumn("effect", F.when(F.col("action_class") == "SEARCH", "FAILED").otherwise(F.col("effect")))
    return a.oscillations(s.withColumns({"target": F.lit("all"), "action_class": F.expr(OSC)}))


FEAT_SQL = """
ft0 AS (SELECT trace_id, idx, CAST(concat_ws('|', agent, action, coalesce('q' || query, 'd' || doc_id, 'a' || answer)) = lag(concat_ws('|', agent, action, coalesce('q' || query, 'd' || doc_id, 'a' || answer))) OVER (PARTITION BY trace_id ORDER BY idx) AS INT) AS again FROM ev WHERE kind = 'TOOL_CALL'),
ft1 AS (SELECT trace_id, count(*) AS n_calls, coalesce(sum(again), 0) AS n_repeat FROM ft0 GROUP BY ALL),
ft2 AS (SELECT trace_id, count(*) AS n_events FROM ev GROUP BY ALL),
ft AS (SELECT tr.trace_id, model_version, prompt_version, time_window, task_id, n_events, CASE WHEN n_events <= 9 THEN 'len[0-9]' WHEN n_events <= 13 THEN 'len[10-13]' WHEN n_events <= 17 THEN 'len[14-17]' ELSE 'len[18-+]' END AS length_bin, NOT success AS failed, CAST(coalesce(n_calls, 0) AS BIGINT) AS n_calls, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat FROM tr JOIN ft2 USING (trace_id) LEFT JOIN ft1 USING (trace_id))"""
DIST_SQL = FEAT_SQL + """,
fam AS (SELECT trace_id, 'version' AS family, prompt_version AS fixed, model_version AS grp FROM tr UNION ALL SELECT trace_id, 'behavior', model_version || '/' || prompt_version, time_window FROM tr UNION ALL SELECT trace_id, 'data', model_version || '/' || prompt_version, time_window FROM tr),
cn AS (SELECT trace_id, 'kind_hist' AS feature, kind AS bin, count(*) AS n FROM ev GROUP BY ALL UNION ALL SELECT trace_id, 'action_hist', agent || ':' || coalesce(action, kind), count(*) FROM ev GROUP BY ALL UNION ALL SELECT trace_id, 'length_bin', length_bin, 1 FROM ft
  UNION ALL SELECT trace_id, 'failure', CASE WHEN failed THEN 'fail' ELSE 'ok' END, 1 FROM ft UNION ALL SELECT trace_id, 'repeat', 'repeat', n_repeat FROM ft UNION ALL SELECT trace_id, 'repeat', 'clean', n_calls - n_repeat FROM ft UNION ALL SELECT trace_id, 'task_composition', task_id, 1 FROM ft),
d0 AS (SELECT family, fixed, grp, feature, bin, CAST(sum(n) AS DOUBLE) AS n FROM fam JOIN cn USING (trace_id) WHERE (family = 'data') = (feature = 'task_composition') GROUP BY ALL HAVING sum(n) > 0),
di AS (SELECT *, n / sum(n) OVER (PARTITION BY family, fixed, grp, feature) AS p FROM d0),
gs AS (SELECT family, fixed, grp, count(*) AS n_traces FROM fam GROUP BY ALL)"""


@trace_query("a5_drift_features", FEAT_SQL + " SELECT * FROM ft")
def a5(events, traces):
    return a.trace_features(events, traces)


PAIR_SQL = DIST_SQL + """,
pa AS (SELECT x.family, x.fixed, x.grp AS a, y.grp AS b FROM gs x JOIN gs y ON x.family = y.family AND x.fixed = y.fixed AND x.grp < y.grp WHERE x.n_traces >= 5 AND y.n_traces >= 5),
bi AS (SELECT DISTINCT family, fixed, feature, bin FROM di),
jn AS (SELECT pa.*, bi.feature, bi.bin, x.p AS p, y.p AS q FROM pa JOIN bi USING (family, fixed) LEFT JOIN di x ON x.family = pa.family AND x.fixed = pa.fixed AND x.grp = a AND x.feature = bi.feature AND x.bin = bi.bin LEFT JOIN di y ON y.family = pa.family AND y.fixed = pa.fixed AND y.grp = b AND y.feature = bi.feature AND y.bin = bi.bin),
ps AS (SELECT family, fixed, a, b, feature, sum(CASE WHEN p > 0 AND q > 0 THEN (q - p) * ln(q / p) ELSE 0 END) AS psi, sum(CASE WHEN q IS NULL AND p IS NOT NULL THEN p ELSE 0 END) AS mismatch_a, sum(CASE WHEN p IS NULL AND q IS NOT NULL THEN q ELSE 0 END) AS mismatch_b FROM jn GROUP BY ALL)"""


@trace_query("a6_psi", PAIR_SQL + " SELECT family, fixed, a, b, feature, round(psi, 9) AS psi FROM ps")
def a6(events, traces):
    return a.drift_pairs(events, traces).select("family", "fixed", "a", "b", "feature", F.round("psi", 9).alias("psi"))


@trace_query("a7_support_mismatch", PAIR_SQL + " SELECT family, fixed, a, b, feature, round(mismatch_a, 9) AS mismatch_a, round(mismatch_b, 9) AS mismatch_b FROM ps")
def a7(events, traces):
    return a.drift_pairs(events, traces).select("family", "fixed", "a", "b", "feature", F.round("mismatch_a", 9).alias("mismatch_a"), F.round("mismatch_b", 9).alias("mismatch_b"))


@trace_query("a8_distributions", DIST_SQL + " SELECT family, fixed, grp, feature, bin, n, round(p, 9) AS p FROM di")
def a8(events, traces):
    return a.distributions(events, traces).withColumn("p", F.round("p", 9))


@trace_query("a9_drift_alerts", PAIR_SQL + " SELECT family, fixed, a, b, string_agg(feature, ',' ORDER BY feature) AS firing FROM ps WHERE psi > 0.2 OR greatest(mismatch_a, mismatch_b) > 0.1 GROUP BY ALL")
def a9(events, traces):
    d = a.drift_pairs(events, traces).where("alert")
    return d.groupBy("family", "fixed", "a", "b").agg(F.array_join(F.sort_array(F.collect_set("feature")), ",").alias("firing"))


@trace_query("a10_independent_alerts", PAIR_SQL + ", al AS (SELECT family, fixed, a, b, feature FROM ps WHERE psi > 0.2 OR greatest(mismatch_a, mismatch_b) > 0.1), ln AS (SELECT x.* FROM al x JOIN al y ON y.family = x.family AND y.fixed = x.fixed AND y.a = x.a AND y.b = x.b WHERE x.feature = 'repeat' AND y.feature = 'kind_hist') SELECT al.family, al.fixed, al.a, al.b, string_agg(CASE al.feature WHEN 'task_composition' THEN 'task_id' ELSE al.feature END, ',' ORDER BY CASE al.feature WHEN 'task_composition' THEN 'task_id' ELSE al.feature END) AS firing, coalesce(string_agg(CASE al.feature WHEN 'task_composition' THEN 'task_id' ELSE al.feature END, ',' ORDER BY CASE al.feature WHEN 'task_composition' THEN 'task_id' ELSE al.feature END) FILTER (ln.feature IS NULL), '') AS independent FROM al LEFT JOIN ln ON ln.family = al.family AND ln.fixed = al.fixed AND ln.a = al.a AND ln.b = al.b AND ln.feature = al.feature GROUP BY ALL")
def a10_alerts(events, traces):
    """The corpus-wide aliases of the data, with repeat declared one of kind_hist, so that a later alias drops out where both fire."""
    own = a.feature_aliases(a.trace_features(events, traces))
    declared = events.sparkSession.createDataFrame([("kind_hist", "repeat", True)], "a string, b string, alias boolean")
    return a.independent_alerts(a.drift_pairs(events, traces), own.unionByName(declared))


def collinear(events, traces):
    """A world where length and failure are one in the first windows, and not in the corpus: early traces end before the fourteenth event, and fail if they have ten or more."""
    early = F.regexp_extract("trace_id", r"w(\d+)$", 1).cast("int") < 5
    e = events.where(~early | (F.col("idx") < 13))
    n = e.groupBy("trace_id").agg(F.count("*").alias("_n"))
    return e, traces.join(n, "trace_id").withColumn("success", F.when(early, F.col("_n") < 10).otherwise(F.col("success"))).drop("_n")


WORLD_SQL = "ew AS (SELECT * FROM ev WHERE CAST(regexp_extract(trace_id, 'w(\\d+)$', 1) AS INT) >= 5 OR idx < 13), nw AS (SELECT trace_id, count(*) AS n FROM ew GROUP BY ALL), tw AS (SELECT tr.* REPLACE (CASE WHEN CAST(regexp_extract(trace_id, 'w(\\d+)$', 1) AS INT) < 5 THEN nw.n < 10 ELSE success END AS success) FROM tr JOIN nw USING (trace_id)), "
_IN_WORLD = re.sub(r"\b(FROM|JOIN) tr\b", r"\1 tw AS tr", re.sub(r"\b(FROM|JOIN) ev\b", r"\1 ew AS ev", PAIR_SQL))


@trace_query("a10_pair_alerts", WORLD_SQL + _IN_WORLD + """, al AS (SELECT family, fixed, a, b, feature FROM ps WHERE psi > 0.2 OR greatest(mismatch_a, mismatch_b) > 0.1),
fg AS (SELECT family, fixed, grp, length_bin AS l, failed AS f FROM (
  SELECT 'version' AS family, prompt_version AS fixed, model_version AS grp, length_bin, failed FROM ft UNION ALL SELECT unnest(['behavior', 'data']), model_version || '/' || prompt_version, time_window, length_bin, failed FROM ft)),
fired AS (SELECT al.family, al.fixed, al.a, al.b FROM al GROUP BY ALL), alike AS (SELECT fired.*, count(DISTINCT l) = count(DISTINCT (l, f)) AND count(DISTINCT f) = count(DISTINCT (l, f)) AS same FROM fired JOIN fg ON fg.family = fired.family AND fg.fixed = fired.fixed AND fg.grp IN (fired.a, fired.b) GROUP BY fired.family, fired.fixed, fired.a, fired.b)
SELECT al.family, al.fixed, al.a, al.b, string_agg(feature, ',' ORDER BY feature) AS firing, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (NOT (feature = 'failure' AND same AND EXISTS (SELECT 1 FROM al x WHERE x.family = al.family AND x.fixed = al.fixed AND x.a = al.a AND x.b = al.b AND x.feature = 'length_bin'))), '') AS independent
FROM al JOIN alike pc ON pc.family = al.family AND pc.fixed = al.fixed AND pc.a = al.a AND pc.b = al.b GROUP BY ALL""")
def a10_pairs(events, traces):
    return a.drift_alerts(*collinear(events, traces))


@trace_query("a9_skipped_groups", DIST_SQL + " SELECT family, fixed, grp, n_traces FROM gs WHERE n_traces < 38")
def a9_skipped(events, traces):
    return a.group_sizes(traces).where("n_traces < 38")


@trace_query("a10_feature_aliases", FEAT_SQL + ", f AS (SELECT length_bin AS l, failed AS f, task_id AS t FROM ft) SELECT 'length_bin' AS a, 'failure' AS b, count(DISTINCT l) = count(DISTINCT (l, f)) AND count(DISTINCT f) = count(DISTINCT (l, f)) AS alias FROM f UNION ALL SELECT 'length_bin', 'task_id', count(DISTINCT l) = count(DISTINCT (l, t)) AND count(DISTINCT t) = count(DISTINCT (l, t)) FROM f UNION ALL SELECT 'failure', 'task_id', count(DISTINCT f) = count(DISTINCT (f, t)) AND count(DISTINCT t) = count(DISTINCT (f, t)) FROM f")
def a10(events, traces):
    return a.feature_aliases(a.trace_features(events, traces))


@trace_query("a11_group_census", "SELECT model_version, prompt_version, time_window, count(*) AS n_traces FROM tr GROUP BY ALL")
def a11(events, traces):
    return a.group_census(traces)


def sample_verdicts(events):
    """Verdict JSON of each trace: score from its length, a severity word from its last event; some out of range or unknown."""
    t = events.groupBy("trace_id").agg(F.count("*").alias("n"), F.max_by("k", "idx").alias("k"))
    word = F.element_at(F.array(*map(F.lit, ("low", "Medium", "severe", "odd"))), F.col("k") % 4 + 1)
    return t.select("trace_id", F.to_json(F.struct((F.col("n") % 12).cast("double").alias("score"), F.array(F.struct(word.alias("severity"), F.lit("x").alias("note"))).alias("findings"))).alias("response"))


@trace_query("a12_quality_verdicts", "v AS (SELECT trace_id, count(*) % 12 AS s, max_by(k, idx) % 4 AS w FROM ev GROUP BY trace_id) SELECT trace_id, CASE WHEN s <= 10 AND w < 3 THEN CAST(s AS DOUBLE) END AS score, CAST(w = 0 AS BIGINT) AS minor, CAST(w = 1 AS BIGINT) AS major, CAST(w = 2 AS BIGINT) AS critical, CASE WHEN s > 10 THEN 'score' WHEN w = 3 THEN 'severity' END AS rejected FROM v")
def a12(events, traces):
    return a.quality_verdicts(sample_verdicts(events).withColumn("response", dressed(F.col("response"), F.col("trace_id"))))


SYM_SQL = r"""
y0 AS (SELECT *, last_value(CASE WHEN kind = 'TOOL_CALL' THEN idx END IGNORE NULLS) OVER w AS call_i, last_value(CASE WHEN kind = 'TOOL_CALL' THEN agent END IGNORE NULLS) OVER w AS call_a, last_value(CASE WHEN kind = 'LLM_CALL' THEN idx END IGNORE NULLS) OVER w AS llm_i, last_value(CASE WHEN kind = 'LLM_CALL' THEN agent END IGNORE NULLS) OVER w AS llm_a,
   coalesce(max(CAST(kind = 'TOOL_RESULT' AND action = 'search' AS INT)) OVER w, 0) AS hit, coalesce(max(CAST(coalesce(kind = 'TOOL_CALL' AND action = 'read_doc', false) AS INT)) OVER w, 0) AS readd FROM ev WINDOW w AS (PARTITION BY trace_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y2 AS (SELECT *, concat_ws('|', agent, action, coalesce('q' || query, 'd' || doc_id, 'a' || answer)) AS s FROM ev WHERE kind = 'TOOL_CALL'),
y3 AS (SELECT *, lag(s) OVER (PARTITION BY trace_id ORDER BY idx) AS s1, lead(s) OVER (PARTITION BY trace_id ORDER BY idx) AS s2 FROM y2),
rd AS (SELECT trace_id, doc_id AS doc, min(idx) AS read_at FROM ev WHERE kind = 'TOOL_CALL' AND action = 'read_doc' GROUP BY ALL),
ci AS (SELECT trace_id, idx, agent, unnest(list_distinct(regexp_extract_all(content, '\bd\d+\b'))) AS doc FROM ev WHERE kind = 'LLM_CALL' AND regexp_matches(content, '(?i)cite|cited|according to|based on')),
ll AS (SELECT trace_id, max(idx) AS step, max_by(agent, idx) AS agent FROM ev WHERE kind = 'LLM_CALL' GROUP BY ALL),
sy0 AS (SELECT trace_id, 1 AS rule_no, 'malformed_tool_call' AS fault, min_by(call_i, idx) AS step, min_by(call_a, idx) AS agent, 'FM-2.6' AS code FROM y0 WHERE kind = 'TOOL_RESULT' AND regexp_matches(content, '(?i)^\s*(error|exception|traceback|fatal|failed)\b') GROUP BY ALL
  UNION ALL SELECT trace_id, 2, 'step_repetition', min(idx), min_by(agent, idx), 'FM-1.3' FROM y3 WHERE s = s1 AND s = s2 GROUP BY trace_id
  UNION ALL SELECT trace_id, 3, 'info_withholding', min(idx), min_by(agent, idx), 'FM-2.4' FROM y0 WHERE kind IN ('LLM_CALL', 'HANDOFF') AND hit = 1 AND regexp_matches(content, '(?i)no (relevant|results|documents)|nothing found') GROUP BY trace_id
  UNION ALL SELECT trace_id, 4, 'premature_termination', min_by(coalesce(llm_i, idx), idx), min_by(coalesce(llm_a, agent), idx), 'FM-3.1' FROM y0 WHERE action = 'submit' AND readd = 0 GROUP BY trace_id
  UNION ALL SELECT trace_id, 5, 'ungrounded_citation', min(idx), min_by(agent, idx), 'FM-3.3' FROM ci LEFT JOIN rd USING (trace_id, doc) WHERE read_at IS NULL OR read_at > idx GROUP BY trace_id
  UNION ALL SELECT trace_id, 6, 'disobey_task_spec', step, agent, 'FM-1.1' FROM ll WHERE trace_id IN (SELECT trace_id FROM ev WHERE kind = 'VERIFIER' AND regexp_matches(content, '(?i)missing|required|format'))),
sy AS (SELECT * FROM sy0 UNION ALL SELECT trace_id, 7, 'unknown', step, agent, 'FM-2.6' FROM ll WHERE trace_id NOT IN (SELECT trace_id FROM sy0))
"""


@trace_query("a13_rule_quality", SYM_SQL + "SELECT tr.trace_id, CASE WHEN success THEN 9.0 WHEN n > 0 THEN 2.5 ELSE 4.0 END::DOUBLE AS score, CAST(CASE WHEN success THEN 0 ELSE coalesce(n, 0) END AS BIGINT) AS critical FROM tr LEFT JOIN (SELECT trace_id, count(*) AS n FROM sy0 GROUP BY ALL) s USING (trace_id)")
def a13(events, traces):
    return a.rule_quality(traces, c.symptoms(events))
