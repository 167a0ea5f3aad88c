"""Queries of attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.model import MODES, SYMPTOM_FIX
from tracewright.operators import attribute as t
from tracewright.operators import classify as c
from tracewright.operators import represent as r
from tracewright.plans.analyze_queries import SYM_SQL
from tracewright.plans.noise import dressed
from tracewright.plans.registry import trace_query
from tracewright.plans.represent_queries import CLAIM_SQL, SIG_SQL, SUB_SQL, TREE_SQL, claim_world
from tracewright.tables import durable_by

EP_SQL = r"""
p0 AS (SELECT *, coalesce(kind = 'TOOL_CALL' AND action = 'search', false) AS is_search, coalesce(kind = 'TOOL_CALL' AND action = 'read_doc', false) AS is_read, sum(CAST(coalesce(kind = 'TOOL_CALL' AND action = 'search', false) AS INT)) OVER (PARTITION BY trace_id ORDER BY idx) AS n FROM ev),
p1 AS (SELECT *, max(CAST(is_read AND n = 0 AS INT)) OVER (PARTITION BY trace_id) AS early FROM p0),
p2 AS (SELECT * EXCLUDE (k), n - 1 + early AS k FROM p1 WHERE n > 0 OR (early = 1 AND is_read)),
p3 AS (SELECT trace_id, k, min(idx) AS start_idx, min_by(agent, idx) AS agent FROM p2 WHERE is_search OR (is_read AND n = 0) GROUP BY ALL),
p4 AS (SELECT DISTINCT trace_id, k, unnest(CASE WHEN is_read THEN [doc_id] ELSE string_split(regexp_extract(content, 'docs\s*\[([^\]]*)\]', 1), ', ') END) AS doc FROM p2 WHERE is_read OR (kind = 'TOOL_RESULT' AND action = 'search')),
p5 AS (SELECT p4.*, gold, min(k) OVER (PARTITION BY trace_id, doc) = k AS is_first FROM p4 JOIN tr USING (trace_id) WHERE list_contains(evidence, doc)),
p6 AS (SELECT trace_id, k, count(*) AS found, CAST(sum(CAST(is_first AS INT)) AS BIGINT) AS new, bool_or(list_contains(gold, doc)) AS gold_hit FROM p5 GROUP BY ALL),
ep AS (SELECT p3.trace_id, CAST(p3.k AS BIGINT) AS k, start_idx, agent, coalesce(found, 0) AS found, coalesce(new, 0) AS new, coalesce(gold_hit, false) AS gold_hit, CASE WHEN new > 0 THEN 'productive' WHEN found > 0 THEN 'redundant' ELSE 'unproductive' END AS utility FROM p3 LEFT JOIN p6 USING (trace_id, k)),
cm AS (SELECT trace_id, count(DISTINCT doc) AS n_c, count(DISTINCT doc) FILTER (list_contains(gold, doc)) AS n_g FROM p5 GROUP BY ALL),
ea AS (SELECT trace_id, count(*) AS m, max(k) FILTER (new > 0) AS k_star, min(start_idx) FILTER (gold_hit) AS first_gold_hit FROM ep GROUP BY ALL),
vp AS (SELECT trace_id, avg(CAST(list_contains(evidence, doc_id) AS DOUBLE)) AS visit_precision FROM ev JOIN tr USING (trace_id) WHERE kind = 'TOOL_CALL' AND action = 'read_doc' GROUP BY ALL),
gl AS (SELECT tr.trace_id, CASE WHEN success THEN 'correct' WHEN coalesce(n_g, 0) = 0 THEN CASE WHEN coalesce(n_c, 0) = 0 THEN 'RG_directional' ELSE 'RG_last_hop' END WHEN n_g = 2 THEN 'UG_true_extraction' ELSE 'UG_boundary' END AS label, coalesce(m, 0) AS m, k_star, CASE WHEN k_star IS NULL THEN coalesce(m, 0) ELSE m - 1 - k_star END AS wasted_tail, visit_precision, first_gold_hit FROM tr LEFT JOIN cm USING (trace_id) LEFT JOIN ea USING (trace_id) LEFT JOIN vp USING (trace_id)),
fi AS (SELECT trace_id, min(idx) FILTER (kind = 'TOOL_CALL' AND action = 'search') AS s, min(idx) FILTER (kind = 'LLM_CALL') AS l, min(idx) AS e, max(idx) FILTER (agent <> 'env' AND kind <> 'VERIFIER') AS a FROM ev GROUP BY ALL),
sd AS (SELECT ev.* FROM ev JOIN gl USING (trace_id) WHERE label LIKE 'UG%' AND kind IN ('HANDOFF', 'LLM_CALL') AND (first_gold_hit IS NULL OR idx > first_gold_hit)),
rd2 AS (SELECT trace_id, doc_id AS doc, min(idx) AS read_at FROM ev WHERE kind = 'TOOL_CALL' AND action = 'read_doc' GROUP BY ALL),
wr AS (SELECT trace_id, min(idx) AS w FROM (SELECT trace_id, idx FROM sd WHERE regexp_matches(content, '(?i)no (relevant|results|documents)|nothing found') UNION ALL SELECT u.trace_id, idx FROM (SELECT trace_id, idx, unnest(regexp_extract_all(content, '\bd\d+\b')) AS doc FROM sd WHERE regexp_matches(content, '(?i)cite|cited|according to|based on')) u LEFT JOIN rd2 USING (trace_id, doc) WHERE read_at IS NULL OR read_at > idx) GROUP BY ALL),
ld AS (SELECT trace_id, max(idx) AS d FROM sd WHERE kind = 'LLM_CALL' GROUP BY ALL),
gh AS (SELECT gl.trace_id, label, CASE WHEN label LIKE 'RG%' THEN coalesce(s, l, e) ELSE coalesce(w, d, a, e) END AS step FROM gl JOIN fi USING (trace_id) LEFT JOIN wr USING (trace_id) LEFT JOIN ld USING (trace_id) WHERE label <> 'correct'),
rgh AS (SELECT gh.trace_id, 'rg_ug' AS algo, 1 AS rank, agent, step, CASE WHEN label LIKE 'RG%' THEN 'retrieval_gap' ELSE 'utilization_gap' END AS code, 1.0::DOUBLE AS confidence FROM gh JOIN ev ON ev.trace_id = gh.trace_id AND ev.idx = step)
"""


@trace_query("t1_episodes", EP_SQL + "SELECT * FROM ep")
def t1(events, traces):
    return t.episodes(events, traces).drop("docs").withColumn("k", F.col("k").cast("long"))


@trace_query("t2_gap_labels", EP_SQL + "SELECT * REPLACE (round(visit_precision, 4) AS visit_precision), CASE WHEN label LIKE 'RG%' THEN 'switch query formulation' WHEN label LIKE 'UG%' THEN 'stop at saturation / enforce grounded citation' END AS prescription FROM gl")
def t2(events, traces):
    return t.gap_labels(events, traces).withColumn("k_star", F.col("k_star").cast("long"))


@trace_query("t3_t4_gap_hypotheses", EP_SQL + "SELECT * FROM rgh")
def t3(events, traces):
    return t.gap_hypotheses(events, traces)


SBFL_SQL = SIG_SQL + """,
su0 AS (SELECT trace_id, agent, action_class, coalesce(target, '') AS target, idx FROM sg WHERE agent NOT IN ('verifier', 'env')),
sf AS (SELECT su0.trace_id, agent, action_class, target, count(*) AS f, task_id, success FROM su0 JOIN tr USING (trace_id) GROUP BY ALL),
un AS (SELECT task_id, agent, action_class, target, sum(CASE WHEN success THEN 0 ELSE pow(0.9, f - 1) END) AS n_cf, sum(CASE WHEN success THEN pow(0.9, f - 1) ELSE 0 END) AS n_cs, count(*) FILTER (NOT success) AS fails, count(*) AS nc, sum(f) AS fu FROM sf GROUP BY ALL),
agt AS (SELECT task_id, agent, count(DISTINCT trace_id) AS nc_agent, sum(f) AS f_agent FROM sf GROUP BY ALL),
nf AS (SELECT task_id, count(*) FILTER (NOT success) AS n_failed FROM tr GROUP BY ALL),
s1 AS (SELECT un.*, n_failed - fails AS n_uf, nc / nc_agent AS gamma, fu / f_agent AS beta FROM un JOIN agt USING (task_id, agent) JOIN nf USING (task_id)),
sp AS (SELECT task_id, agent, action_class, target, n_cf, n_cs, n_uf, 0.5 * (CASE WHEN n_cf + n_uf > 0 THEN n_cf / (n_cf + n_uf) ELSE 0 END + CASE WHEN n_cf + n_cs > 0 THEN n_cf / (n_cf + n_cs) ELSE 0 END) AS kul, gamma, beta FROM s1),
sc AS (SELECT *, kul * (1 + beta) * (1 + gamma) AS base FROM sp),
oc AS (SELECT *, row_number() OVER (PARTITION BY trace_id, agent, action_class, target ORDER BY idx) AS nth FROM su0),
fr AS (SELECT trace_id, agent, action_class, target, count(*) AS f, min(idx) AS first_at, min(idx) FILTER (nth = 2) AS second_at FROM oc GROUP BY ALL),
rk AS (SELECT fr.*, (1 + ln(f) / ln(1 / 0.9)) * base AS score FROM fr JOIN tr USING (trace_id) JOIN sc USING (task_id, agent, action_class, target) WHERE NOT success),
sr AS (SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY round(score, 9) DESC, first_at) AS INT) AS rank, agent, action_class, target, coalesce(second_at, first_at) AS step, round(score, 6) AS score FROM rk)
"""
ROUND = ("n_cf", "n_cs", "kul", "gamma", "beta", "base")


@trace_query("t5_spectrum", SBFL_SQL + "SELECT task_id, agent, action_class, target, n_uf, " + ", ".join(f"round({n}, 6) AS {n}" for n in ROUND) + " FROM sc")
def t5(events, traces):
    return t.spectrum(r.sign_actions(events), traces).withColumns({n: F.round(n, 6) for n in ROUND})


@trace_query("t6_spectrum_ranking", SBFL_SQL + "SELECT * FROM sr WHERE rank <= 5")
def t6(events, traces):
    return t.spectrum_ranking(r.sign_actions(events), traces).withColumn("score", F.round("score", 6))


@trace_query("t6_group_notes", """g AS (SELECT regexp_extract(trace_id, '^(u\\d+)w', 1) AS task_id, count(*) AS n_traces, count(*) FILTER (success) AS n_passed FROM tr GROUP BY ALL) SELECT *, concat_ws('; ', CASE WHEN n_passed = 0 THEN 'no successful trajectory in the group: the spectrum is degenerate' END, CASE WHEN n_traces = 1 THEN 'only 1 trajectory in the group: the spectrum is degenerate' END) AS notes FROM g""")
def t6_notes(events, traces):
    """Users stand for tasks, so that some have one trace, and some none that succeeded."""
    return t.spectrum_notes(traces.withColumn("task_id", F.regexp_extract("trace_id", r"^(u\d+)w", 1)))


def sample_pass(events):
    """Verdict JSON from primary symptoms, with steps out of range, unknown agents and codes put in by rule."""
    p = c.primary_symptom(c.symptoms(events))
    bad = lambda n: F.col("step") % 11 == n
    v = F.struct(F.when(bad(3), "nobody").otherwise(F.col("agent")).alias("agent"), F.when(bad(5), F.col("step") + 1000).otherwise(F.col("step")).alias("step"), F.when(bad(7), "FM-9.9").otherwise(F.col("code")).alias("code"), F.lit(0.7).alias("confidence"))
    return p.select("trace_id", dressed(F.to_json(v), F.col("trace_id")).alias("response"))


@trace_query("t7_single_pass_verdicts", SYM_SQL + ", pr AS (SELECT trace_id, min_by(step, rule_no) AS step, min_by(agent, rule_no) AS agent, min_by(code, rule_no) AS code FROM sy GROUP BY ALL), n AS (SELECT trace_id, max(idx) AS last, min_by(agent, idx) AS fa FROM ev GROUP BY ALL) SELECT trace_id, CASE WHEN step % 11 = 3 THEN fa ELSE agent END AS agent, CASE WHEN step % 11 = 5 THEN last ELSE step END AS step, CASE WHEN step % 11 <> 7 THEN code END AS code, 0.7::DOUBLE AS confidence, CASE step % 11 WHEN 3 THEN 'agent unknown' WHEN 5 THEN 'step clamped' WHEN 7 THEN 'code unknown' ELSE '' END AS notes FROM pr JOIN n USING (trace_id)")
def t7(events, traces):
    return t.clamp_verdicts(sample_pass(events), events, events.sparkSession.createDataFrame([(m,) for m in MODES], "code string"))


@trace_query("t8_single_pass_rules", SYM_SQL + "SELECT trace_id, 'single_pass' AS algo, 1 AS rank, min_by(agent, rule_no) AS agent, min_by(step, rule_no) AS step, min_by(code, rule_no) AS code, CASE WHEN min(rule_no) = 7 THEN 0.3 ELSE 0.7 END::DOUBLE AS confidence FROM sy GROUP BY trace_id")
def t8(events, traces):
    return t.single_pass(events)


#: What shows a symptom, as rows (lo_min, lo_max, hi_min): a segment [lo, mid] shows it if lo_min <= lo <= lo_max and mid >= hi_min.
WITNESS_SQL = r"""
b0 AS (SELECT *, kind = 'TOOL_RESULT' AND regexp_matches(content, '(?i)^\s*(error|exception|traceback|fatal|failed)\b') AS is_err, kind = 'TOOL_RESULT' AND action = 'search' AS is_hit, coalesce(kind = 'TOOL_CALL' AND action = 'read_doc', false) AS is_read, kind IN ('LLM_CALL', 'HANDOFF') AND regexp_matches(content, '(?i)no (relevant|results|documents)|nothing found') AS denies FROM ev),
b1 AS (SELECT *, max(CASE WHEN is_err THEN idx END) OVER w AS err_before, max(CASE WHEN kind = 'TOOL_CALL' THEN idx END) OVER w AS call_before, max(CASE WHEN is_hit OR (kind = 'TOOL_RESULT' AND action = 'read_doc' AND NOT is_err) THEN idx END) OVER w AS shown_before, max(CASE WHEN is_read THEN idx END) OVER w AS read_before FROM b0 WINDOW w AS (PARTITION BY trace_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b2 AS (SELECT *, concat_ws('|', agent, action, 'q' || query, 'd' || doc_id, 'a' || answer) AS s, lag(idx) OVER c AS i1, lead(idx) OVER c AS i2, lag(concat_ws('|', agent, action, 'q' || query, 'd' || doc_id, 'a' || answer)) OVER c AS s1, lead(concat_ws('|', agent, action, 'q' || query, 'd' || doc_id, 'a' || answer)) OVER c AS s2 FROM ev WHERE kind = 'TOOL_CALL' WINDOW c AS (PARTITION BY trace_id ORDER BY idx)),
b3 AS (SELECT trace_id, idx, unnest(list_distinct(regexp_extract_all(content, '\bd\d+\b'))) AS doc FROM ev WHERE kind = 'LLM_CALL' AND regexp_matches(content, '(?i)cite|cited|according to|based on')),
wi AS (
  SELECT trace_id, coalesce(err_before + 1, 0) AS lo_min, call_before AS lo_max, idx AS hi_min FROM b1 WHERE is_err AND call_before IS NOT NULL
  UNION ALL SELECT trace_id, 0, i1, i2 FROM b2 WHERE s = s1 AND s = s2
  UNION ALL SELECT trace_id, 0, shown_before, idx FROM b1 WHERE denies AND shown_before IS NOT NULL
  UNION ALL SELECT trace_id, coalesce(read_before + 1, 0), idx, idx FROM b1 WHERE action = 'submit'
  UNION ALL SELECT b3.trace_id, coalesce((SELECT max(x.idx) + 1 FROM b0 x WHERE x.trace_id = b3.trace_id AND x.is_read AND x.doc_id = b3.doc AND x.idx < b3.idx), 0), b3.idx, b3.idx FROM b3
  UNION ALL SELECT v.trace_id, 0, least(v.idx, l.idx), greatest(v.idx, l.idx) FROM ev v JOIN ev l USING (trace_id) WHERE v.kind = 'VERIFIER' AND l.kind = 'LLM_CALL' AND regexp_matches(v.content, '(?i)missing|required|format')
  UNION ALL SELECT trace_id, 0, idx, idx FROM ev WHERE kind = 'LLM_CALL' AND regexp_matches(content, '(?i)recall|from memory|submit directly')),
fz AS (SELECT tr.trace_id, max(idx) AS last FROM ev JOIN tr USING (trace_id) WHERE NOT success GROUP BY ALL),
sgm AS (SELECT DISTINCT fz.trace_id, a.i AS lo, b.i AS mid FROM fz JOIN generate_series(0, 100) a(i) ON a.i <= last JOIN generate_series(0, 100) b(i) ON b.i BETWEEN a.i AND last JOIN wi ON wi.trace_id = fz.trace_id AND a.i BETWEEN lo_min AND lo_max AND b.i >= hi_min),
bi AS (WITH RECURSIVE bs AS (SELECT trace_id, CAST(0 AS BIGINT) AS lo, CAST(last AS BIGINT) AS hi FROM fz UNION ALL SELECT bs.trace_id, CASE WHEN sgm.trace_id IS NULL THEN (bs.lo + hi) // 2 + 1 ELSE bs.lo END, CASE WHEN sgm.trace_id IS NULL THEN hi ELSE (bs.lo + hi) // 2 END FROM bs LEFT JOIN sgm ON sgm.trace_id = bs.trace_id AND sgm.lo = bs.lo AND sgm.mid = (bs.lo + hi) // 2 WHERE bs.lo < hi) SELECT * FROM bs)
"""


@trace_query("t9_bisection", WITNESS_SQL + ", w AS (SELECT *, last_value(CASE WHEN kind IN ('LLM_CALL', 'TOOL_CALL', 'HANDOFF') THEN agent END IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY idx) AS a FROM ev) SELECT bi.trace_id, CAST(lo AS INT) AS step, coalesce(a, agent) AS agent FROM bi JOIN w ON w.trace_id = bi.trace_id AND idx = lo WHERE lo = hi")
def t9(events, traces):
    return t.walk_back(events, t.bisect(events, traces))


@trace_query("t11_agent_walk_back", "s AS (SELECT trace_id, max(idx) AS step FROM ev GROUP BY ALL), w AS (SELECT *, last_value(CASE WHEN kind IN ('LLM_CALL', 'TOOL_CALL', 'HANDOFF') THEN agent END IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY idx) AS a FROM ev) SELECT s.trace_id, step, coalesce(a, agent) AS agent FROM s JOIN w ON w.trace_id = s.trace_id AND idx = step")
def t11(events, traces):
    return t.walk_back(events, events.groupBy("trace_id").agg(F.max("idx").alias("step")))


SUPPORT_SQL = CLAIM_SQL + r""",
cr AS (SELECT trace_id, doc_id AS doc, min(idx) AS read_at FROM ec WHERE kind = 'TOOL_CALL' AND action = 'read_doc' GROUP BY ALL),
ch AS (SELECT DISTINCT trace_id FROM ec WHERE kind = 'TOOL_RESULT' AND action = 'search' AND regexp_matches(content, '\bd\d+\b')),
cs AS (SELECT trace_id, min(idx) AS at_, min_by(list_distinct(regexp_extract_all(answer, '\bd\d+\b')), idx) AS cites FROM ec WHERE action = 'submit' GROUP BY trace_id),
cy AS (SELECT u.trace_id, bool_and(read_at IS NOT NULL) AS met FROM (SELECT trace_id, unnest(cites) AS doc FROM cs) u LEFT JOIN cr USING (trace_id, doc) GROUP BY ALL),
cx AS (SELECT cs.trace_id, at_, coalesce(met, false) AS met, (SELECT max(idx) FROM ec WHERE ec.trace_id = cs.trace_id AND kind = 'LLM_CALL' AND idx < at_) AS decided FROM cs LEFT JOIN cy USING (trace_id)),
cm1 AS (SELECT trace_id, claim_id, introduced, unnest(list_distinct(regexp_extract_all(text, '\bd\d+\b'))) AS doc FROM cl),
cm2 AS (SELECT trace_id, claim_id, bool_or(coalesce(read_at < introduced, false)) AS grounded FROM cm1 LEFT JOIN cr USING (trace_id, doc) GROUP BY ALL),
c7 AS (SELECT cl.*, at_, met, decided, grounded, ch.trace_id IS NOT NULL AS shown, regexp_matches(text, '(?i)no (relevant|usable|documents)|nothing found') AS denies FROM cl LEFT JOIN cx USING (trace_id) LEFT JOIN cm2 USING (trace_id, claim_id) LEFT JOIN ch ON ch.trace_id = cl.trace_id),
c8 AS (SELECT *, CASE WHEN claim_type = 'process' THEN 'fine' WHEN claim_type = 'constraint' THEN CASE WHEN met THEN 'fine' ELSE 'broken' END WHEN denies THEN CASE WHEN shown THEN 'denied' ELSE 'fine' END WHEN grounded = false THEN 'bare' WHEN grounded IS NULL AND regexp_matches(text, '(?i)memory|recall|unknown') THEN 'bare' ELSE 'fine' END AS w FROM c7),
sup AS (SELECT trace_id, claim_id, claim_type, introduced, CASE w WHEN 'fine' THEN 'DIRECT' WHEN 'bare' THEN 'MISSING' ELSE 'CONFLICTING' END AS support_status, CASE w WHEN 'fine' THEN 'supported' WHEN 'bare' THEN 'harmful_unsupported_commitment' ELSE 'conflicting_support' END AS verdict, CASE WHEN w = 'broken' THEN coalesce(decided, at_) WHEN w <> 'fine' THEN introduced END AS responsible_step FROM c8)
"""


def supported(events, traces):
    e, tr = claim_world(events, traces)
    claims = r.rule_claims(e, tr)
    return claims, t.claim_support(claims, e)


@trace_query("t13_claim_support", SUPPORT_SQL + "SELECT * FROM sup")
def t13(events, traces):
    return supported(events, traces)[1]


def judged_records(support):
    """Records as a judge may give them: by rule some have unknown words, unknown claims or steps outside the trace."""
    i = F.col("introduced")
    return support.select("trace_id", F.when(i % 9 == 4, "c99").otherwise(F.col("claim_id")).alias("claim_id"), F.when(i % 7 == 3, "STRONG").otherwise(F.col("support_status")).alias("support_status"), "verdict", F.when(i % 5 == 2, F.col("responsible_step") + 500).otherwise(F.col("responsible_step")).alias("responsible_step"), "introduced")


AUDIT_SQL = SUPPORT_SQL + """,
la AS (SELECT trace_id, max(idx) AS last FROM ev GROUP BY ALL),
ar AS (SELECT trace_id, claim_id, support_status, verdict, introduced, CASE WHEN introduced % 7 = 3 OR introduced % 9 = 4 THEN 1 ELSE 0 END AS bad, CASE WHEN introduced % 5 = 2 AND responsible_step IS NOT NULL THEN last ELSE responsible_step END AS step, introduced % 5 = 2 AND responsible_step IS NOT NULL AS clamped FROM sup JOIN la USING (trace_id)),
ag AS (SELECT trace_id, count(*) FILTER (bad = 0) AS n_valid, count(*) FILTER (bad = 1) AS n_invalid, count(*) FILTER (bad = 0 AND clamped) AS n_clamped FROM ar GROUP BY trace_id),
ah AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY step, claim_id) AS o FROM ar WHERE bad = 0 AND verdict IN ('harmful_unsupported_commitment', 'conflicting_support')),
am AS (SELECT trace_id, min(step) AS first_, CAST(count(*) AS INT) AS many FROM ah GROUP BY trace_id)
"""


@trace_query("t14_claim_audit", AUDIT_SQL + "SELECT ag.trace_id, CASE WHEN am.trace_id IS NULL THEN 'no_harmful_claim' ELSE 'harmful' END AS status, ev.idx AS step, ev.agent, coalesce(many % 2 = 1 AND first_ < least(first_ + 1, last), false) AS reconciled, ah.claim_id, ah.support_status, ah.verdict, n_valid, n_invalid, n_clamped, CASE WHEN am.trace_id IS NOT NULL THEN 0.7 END::DOUBLE AS confidence FROM ag JOIN la USING (trace_id) LEFT JOIN am USING (trace_id) LEFT JOIN ah ON ah.trace_id = ag.trace_id AND ah.o = 1 LEFT JOIN ev ON ev.trace_id = ag.trace_id AND ev.idx = am.first_")
def t14(events, traces):
    """Traces with an odd number of harmful claims have a first error a step after the earliest of their steps, which the audit mends; others one as by rule."""
    claims, support = supported(events, traces)
    records = judged_records(support)
    valid = t.check_records(records, claims, events).where("invalid is null")
    traced = t.earliest_harmful(valid).withColumn("first_error_step", F.when(F.size("error_steps") % 2 == 1, F.col("first_error_step") + 1).otherwise(F.col("first_error_step")))
    return t.claim_audit(records, claims, events, traced)


#: A third of the decisions speak of an error, so that stages show one.
STAGE_SQL = (SUB_SQL + ", " + TREE_SQL).replace("FROM ev", "FROM es").replace("c0 AS", "es AS (SELECT * REPLACE (CASE WHEN kind = 'LLM_CALL' AND k % 3 = 0 THEN 'retry: it failed' ELSE content END AS content) FROM ev),\nc0 AS") + r""",
sr0 AS (SELECT *, CASE WHEN lag(phase) OVER (PARTITION BY trace_id ORDER BY idx) = phase THEN 0 ELSE 1 END AS c FROM es WHERE phase IS NOT NULL),
sr1 AS (SELECT trace_id, n, min(phase) AS phase, min(idx) AS a, max(idx) AS b FROM (SELECT *, sum(c) OVER (PARTITION BY trace_id ORDER BY idx) AS n FROM sr0) GROUP BY ALL),
sx AS (SELECT tree.trace_id, tree.idx, summary, coalesce(sr1.phase, '?') AS stage FROM tree JOIN sm ON sm.trace_id = tree.trace_id AND sm.step = tree.idx LEFT JOIN sr1 ON sr1.trace_id = tree.trace_id AND tree.idx BETWEEN a AND b),
sy1 AS (SELECT *, sum(CAST(d AS INT)) OVER (PARTITION BY trace_id ORDER BY idx) AS section FROM (SELECT *, lag(stage) OVER (PARTITION BY trace_id ORDER BY idx) IS DISTINCT FROM stage AS d FROM sx)),
sl1 AS (SELECT trace_id, stage, section, 0 AS o FROM sy1 GROUP BY trace_id, stage, section, string_split(summary, ' ')[1:3] HAVING count(*) >= 2 UNION ALL SELECT trace_id, stage, section, 1 FROM sy1 WHERE regexp_matches(summary, '(?i)\berror|failed|exhausted\b')),
sk AS (SELECT trace_id, stage, min(o) AS o, arg_min(section, (o, section)) AS section FROM sl1 GROUP BY ALL),
ss1 AS (SELECT trace_id, stage, CASE o WHEN 0 THEN 'loop' ELSE 'error' END AS why, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY o, section) AS INT) AS rank FROM sk)
"""


def stage_world(events):
    return events.withColumn("content", F.when((F.col("kind") == "LLM_CALL") & (F.col("k") % 3 == 0), "retry: it failed").otherwise(F.col("content")))


@trace_query("t16_suspicious_stages", STAGE_SQL + "SELECT * FROM ss1 WHERE rank <= 3")
def t16(events, traces):
    return t.suspicious_stages(stage_world(events))


@trace_query("t17_drill_range", STAGE_SQL + r", pk AS (SELECT trace_id, arg_min(stage, rank) AS chosen FROM (SELECT ss1.* FROM ss1 WHERE rank <= 3 AND stage IN (SELECT phase FROM sr1 WHERE sr1.trace_id = ss1.trace_id)) GROUP BY trace_id), lt AS (SELECT trace_id, arg_max(phase, n) AS last_stage FROM sr1 GROUP BY ALL), er AS (SELECT trace_id, coalesce(min(idx) FILTER (regexp_matches(content, '(?i)^\s*(error|exception|traceback|fatal|failed)\b')), max(idx)) AS at_ FROM es GROUP BY ALL), x2 AS (SELECT sr1.*, CASE WHEN at_ BETWEEN a AND b THEN 0 ELSE 1 END AS miss FROM sr1 JOIN lt USING (trace_id) LEFT JOIN pk USING (trace_id) JOIN er USING (trace_id) WHERE phase = coalesce(chosen, last_stage)), x3 AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY miss, CASE WHEN miss = 0 THEN a ELSE -a END) AS rn FROM x2) SELECT trace_id, phase AS stage, greatest(0, a - 3) AS lo, b AS hi FROM x3 WHERE rn = 1")
def t17(events, traces):
    e = stage_world(events)
    return t.drill_range(e, t.suspicious_stages(e))


RESULT_SQL = SUB_SQL + r""",
sq AS (SELECT trace_id, subtask, coalesce(concat_ws('|', agent, action, 'q' || query, 'd' || doc_id, 'a' || answer) = lag(concat_ws('|', agent, action, 'q' || query, 'd' || doc_id, 'a' || answer)) OVER (PARTITION BY trace_id, subtask ORDER BY idx), false) AS again FROM su WHERE kind = 'TOOL_CALL'),
sg2 AS (SELECT trace_id, subtask, bool_or(again) AS again FROM sq GROUP BY ALL),
lv AS (SELECT trace_id, arg_max(content LIKE 'passed%', idx) AS lastv FROM ev WHERE kind = 'VERIFIER' GROUP BY ALL),
sa2 AS (SELECT trace_id, subtask, coalesce(min_by(phase, idx) FILTER (phase IS NOT NULL), 'task') AS phase, bool_or(kind = 'TOOL_RESULT' AND action = 'read_doc' AND NOT regexp_matches(content, '(?i)^\s*(error|exception|traceback|fatal|failed)\b')) AS readd, bool_or(kind = 'LLM_CALL' AND regexp_matches(content, '(?i)recall|from memory|submit directly')) AS memory FROM su GROUP BY ALL),
sr2 AS (SELECT trace_id, subtask, phase, CASE phase WHEN 'search' THEN coalesce(readd, false) AND NOT coalesce(again, false) WHEN 'plan' THEN NOT coalesce(memory, false) ELSE coalesce(lastv, false) END AS passed FROM sa2 LEFT JOIN sg2 USING (trace_id, subtask) LEFT JOIN lv USING (trace_id))
"""


@trace_query("t18_subtask_results", RESULT_SQL + "SELECT * FROM sr2")
def t18(events, traces):
    return t.subtask_results(events)


@trace_query("t19_failing_subtask", RESULT_SQL + "SELECT trace_id, coalesce(max(subtask) FILTER (NOT passed), max(subtask)) AS subtask, bool_and(passed) AS all_passed FROM sr2 GROUP BY trace_id")
def t19(events, traces):
    return t.failing_subtask(t.subtask_results(events))


@trace_query("t21_mechanisms", SYM_SQL + ", pr AS (SELECT trace_id, min_by(fault, rule_no) AS fault FROM sy GROUP BY ALL) SELECT trace_id, CASE fault WHEN 'step_repetition' THEN 'executor_loop' WHEN 'info_withholding' THEN 'dataflow_first_pollution' WHEN 'premature_termination' THEN 'planning_error' ELSE 'local_error' END AS mechanism, CASE WHEN fault = 'unknown' THEN 0.4 ELSE 0.7 END::DOUBLE AS confidence FROM pr")
def t21(events, traces):
    return t.mechanisms(events)


def all_hypotheses(events, traces):
    """Kept by trace: those who ask read them more than once."""
    rank = t.spectrum_ranking(r.classify_actions(events), traces)  # effects of actions aren't asked
    sb = t.hypotheses(rank, "sbfl", F.lit(None), F.lit(0.35), F.col("rank"))
    failed = traces.where("not success").select("trace_id")
    return durable_by(t.single_pass(events).join(failed, "trace_id", "left_semi").unionByName(t.gap_hypotheses(events, traces)).unionByName(sb), "trace_id")


HYP_SQL = EP_SQL + ", " + SBFL_SQL + ", " + SYM_SQL + """,
hy AS (SELECT trace_id, 'single_pass' AS algo, 1 AS rank, min_by(agent, rule_no) AS agent, min_by(step, rule_no) AS step, min_by(code, rule_no) AS code, CASE WHEN min(rule_no) = 7 THEN 0.3 ELSE 0.7 END::DOUBLE AS confidence FROM sy JOIN tr USING (trace_id) WHERE NOT success GROUP BY trace_id UNION ALL SELECT * FROM rgh UNION ALL SELECT trace_id, 'sbfl', rank, agent, step, NULL, 0.35 FROM sr WHERE rank <= 5),
h1 AS (SELECT *, row_number() OVER (PARTITION BY trace_id, agent, step ORDER BY algo, rank) AS o FROM hy),
h2 AS (SELECT trace_id, algo, rank, agent, step, code, confidence, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY confidence DESC, step, agent) AS INT) AS place FROM h1 WHERE o = 1)
"""


@trace_query("t22_replay_candidates", HYP_SQL + "SELECT * FROM h2 WHERE place <= 3", kept=True)
def t22(events, traces):
    return t.replay_candidates(all_hypotheses(events, traces))


def sample_outcomes(candidates):
    """Replay outcomes by rule: steps divisible by three turned, other even ones did not, the rest were not tried."""
    return candidates.where("step % 3 = 0 or step % 2 = 0").select("trace_id", "agent", "step", (F.col("step") % 3 == 0).alias("flipped"))


@trace_query("t23_replay_adjust", HYP_SQL + "SELECT trace_id, agent, step, CASE WHEN step % 3 = 0 THEN least(1.0, confidence + 0.2) WHEN step % 2 = 0 THEN greatest(0.0, confidence - 0.3) ELSE confidence END::DOUBLE AS confidence, CASE WHEN step % 3 = 0 THEN 'validated' WHEN step % 2 = 0 THEN 'refuted' ELSE 'untested' END AS status FROM h2 WHERE place <= 3", kept=True)
def t23(events, traces):
    cand = t.replay_candidates(all_hypotheses(events, traces))
    return t.adjust_by_replay(cand, sample_outcomes(cand))


@trace_query("t24_hypothesis_merge", HYP_SQL + ", sp2 AS (SELECT DISTINCT trace_id, agent, step FROM hy WHERE algo = 'rg_ug') SELECT *, algo AS source FROM hy WHERE algo = 'rg_ug' UNION ALL SELECT hy.*, algo FROM hy ANTI JOIN sp2 USING (trace_id, agent, step) WHERE algo <> 'rg_ug'", kept=True)
def t24(events, traces):
    return t.merge_hypotheses([all_hypotheses(events, traces)], superseding=("rg_ug",))


FIX_SQL = "CASE fault " + " ".join(f"WHEN '{k}' THEN replace('{v}', '{{}}', CAST(step AS VARCHAR))" for k, v in SYMPTOM_FIX.items()) + " ELSE 'Re-examine the reasoning behind step ' || step || ' before continuing.' END"


@trace_query("t25_candidate_is_symptom", HYP_SQL + ", ss AS (SELECT trace_id, step, min_by(fault, rule_no) AS fault FROM sy0 GROUP BY ALL) SELECT trace_id, agent, step, fault, fault IS NOT NULL AS is_symptom, " + FIX_SQL + " AS edit_text FROM h2 LEFT JOIN ss USING (trace_id, step) WHERE place <= 3", kept=True)
def t25(events, traces):
    cand = t.replay_candidates(all_hypotheses(events, traces))
    return t.symptom_at(cand.select("trace_id", "agent", "step"), events)
