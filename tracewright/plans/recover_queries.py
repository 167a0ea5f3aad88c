"""Queries of recovery and evaluation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tracewright.operators import classify as c
from tracewright.operators import evaluate as e
from tracewright.operators import quarantine as q
from tracewright.operators import recover as v
from tracewright.operators import represent as r
from tracewright.plans.analyze_queries import SYM_SQL
from tracewright.plans.attribute_queries import FIX_SQL, HYP_SQL, all_hypotheses
from tracewright.plans.registry import query, trace_query
from tracewright.plans.represent_queries import CLAIM_SQL, LINE_SQL, claim_world
from tracewright.plans.source_queries import pick, pick_sql
from tracewright.sources.fixtures import table


@trace_query("v1_target_selection", HYP_SQL + ", b AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY confidence DESC, step, algo DESC) AS rn FROM hy) SELECT tr.trace_id, CASE WHEN success THEN 'skipped' WHEN b.step IS NULL THEN 'skipped_no_hypothesis' ELSE 'selected' END AS status, b.step, b.agent, b.confidence FROM tr LEFT JOIN b ON b.trace_id = tr.trace_id AND rn = 1", kept=True)
def v1(events, traces):
    return v.select_target(all_hypotheses(events, traces), traces).drop("code")


def reruns_of(traces):
    """The next window's trace of the same user stands for a rerun of a failed one."""
    key = lambda t: t.withColumns({"u": F.regexp_extract("trace_id", r"^(u\d+)w", 1), "w": F.regexp_extract("trace_id", r"w(\d+)$", 1).cast("int")})
    t = key(traces.select("trace_id", "success"))
    a, b = t.where("not success").select(F.col("trace_id").alias("rerun_of"), "u", F.col("w").alias("w0")), t
    return a.join(b, "u").where("w > w0 and w <= w0 + 4").select("rerun_of", "trace_id", F.col("w").alias("seq"), "success")


RERUN_SQL = r"ru AS (SELECT a.trace_id AS rerun_of, b.trace_id, CAST(substr(b.time_window, 2) AS INT) AS seq, b.success FROM tr a JOIN tr b ON regexp_extract(a.trace_id, '^(u\d+)w', 1) = regexp_extract(b.trace_id, '^(u\d+)w', 1) AND CAST(substr(b.time_window, 2) AS INT) BETWEEN CAST(substr(a.time_window, 2) AS INT) + 1 AND CAST(substr(a.time_window, 2) AS INT) + 4 WHERE NOT a.success)"


@trace_query("v3_attempt_ledger", RERUN_SQL + ", n AS (SELECT *, CAST(row_number() OVER (PARTITION BY rerun_of ORDER BY seq, trace_id) AS INT) AS round FROM ru) SELECT rerun_of AS trace_id, count(*) AS attempts, min(round) FILTER (success) AS first_success, count(*) FILTER (success) > 0 AS recovered FROM n WHERE round <= 3 GROUP BY rerun_of")
def v3(events, traces):
    return v.attempt_ledger(reruns_of(traces))


@trace_query("v4_closed_loop", RERUN_SQL + " SELECT rerun_of AS trace_id, max_by(trace_id, seq) AS rerun_id, max_by(success, seq) AS improved FROM ru GROUP BY rerun_of")
def v4(events, traces):
    return v.verify_closed_loop(reruns_of(traces))


@trace_query("v4_judge_evidence", RERUN_SQL + """, l AS (SELECT rerun_of AS trace_id, max_by(trace_id, seq) AS rerun_id, max_by(success, seq) AS improved FROM ru GROUP BY rerun_of), n AS (SELECT trace_id AS rerun_id, count(*) AS n FROM ev GROUP BY ALL)
SELECT trace_id, rerun_id, improved, CASE WHEN n % 3 = 0 THEN (n % 11)::DOUBLE END AS judge_score, CASE WHEN n % 3 = 0 THEN 'seen ' || n END AS judge_summary, n % 3 = 0 AS judge_available FROM l JOIN n USING (rerun_id)""")
def v4_judge(events, traces):
    """A third of the traces has a judge's score, a third an error in its place, the rest nothing."""
    n = events.groupBy("trace_id").agg(F.count("*").alias("n")).where("n % 3 <> 2")
    judge = n.select("trace_id", F.when(F.col("n") % 3 == 1, "error").alias("status"), (F.col("n") % 11).cast("double").alias("score"), F.concat(F.lit("seen "), F.col("n").cast("string")).alias("summary"))
    return v.verify_closed_loop(reruns_of(traces), judge)


TRIAL_SQL = "pl AS (SELECT trace_id, idx, lead(idx) OVER (PARTITION BY trace_id ORDER BY idx) AS nxt, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY idx) - 1 AS INT) AS trial FROM ev WHERE kind = 'LLM_CALL' AND content LIKE 'plan:%'), la AS (SELECT trace_id, max(idx) AS last FROM ev GROUP BY ALL), ti AS (SELECT trace_id, trial, idx AS lo, coalesce(nxt - 1, last) AS hi FROM pl JOIN la USING (trace_id) UNION ALL SELECT trace_id, 0, 0, last FROM la WHERE trace_id NOT IN (SELECT trace_id FROM pl))"


@trace_query("v5_trials", TRIAL_SQL + " SELECT * FROM ti")
def v5(events, traces):
    return v.trials(events)


@trace_query("v6_trial_logs", TRIAL_SQL + ", sl AS (SELECT trace_id, trial, count(*) AS n_events, count(*) FILTER (kind = 'TOOL_CALL') AS n_calls FROM ev JOIN ti USING (trace_id) WHERE idx BETWEEN lo AND hi GROUP BY ALL) SELECT *, coalesce(string_agg('trial ' || trial || ': ' || n_events || ' events', '; ') OVER (PARTITION BY trace_id ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prior FROM sl")
def v6(events, traces):
    return v.trial_logs(events)


@trace_query("v7_intervention_votes", TRIAL_SQL + ", vo AS (SELECT trace_id, trial, idx - lo AS run, (idx + k) % 3 = 0 AS success FROM ev JOIN ti USING (trace_id) WHERE idx BETWEEN lo AND least(hi, lo + 2) AND (lo + hi) % 4 <> 0), vc AS (SELECT trace_id, trial, count(*) FILTER (success) AS ok, count(*) AS n, arg_max(success, run) AS last FROM vo GROUP BY ALL), vj AS (SELECT ti.trace_id, ti.trial, hi % 2 = 0 AS removed, coalesce(ok, 0) AS ok, coalesce(n, 0) AS n, coalesce(last, false) AS last FROM ti LEFT JOIN vc USING (trace_id, trial)), vl AS (SELECT *, CASE WHEN 2 * ok > n THEN 'Validated' WHEN removed THEN 'Partially' WHEN n > 0 THEN 'Refuted' ELSE 'Inconclusive' END AS label FROM vj) SELECT trace_id, trial, removed, ok, n, label, label IN ('Validated', 'Partially') AND last AS recovered FROM vl")
def v7(events, traces):
    """Up to three replays a trial by rule, none for every fourth; the fault is gone where the trial ends at an even step."""
    t = v.trials(events)
    o = events.join(t, "trace_id").where("idx between lo and least(hi, lo + 2) and (lo + hi) % 4 <> 0").select("trace_id", "trial", (F.col("idx") - F.col("lo")).alias("run"), ((F.col("idx") + F.col("k")) % 3 == 0).alias("success"))
    return v.intervention_votes(o, t.select("trace_id", "trial", (F.col("hi") % 2 == 0).alias("removed")))


#: Labels as judges write them, and what they mean.
LABELS = {"Validated": "Validated", " REFUTED ": "Refuted", "partially": "Partially", "Partially Valid": "Partially", "partially-validated": "Partially", "partially_valided": "Partially", "Partially__Validated": "Partially", "inconclusive": "Inconclusive", "fixed": None, "": None}


@trace_query("v7_vote_labels", f"SELECT trace_id, idx, {pick_sql(tuple(LABELS.values()), 'idx + k')} AS label FROM ev")
def v7_labels(events, traces):
    return events.select("trace_id", "idx", v.vote_label(pick(tuple(LABELS), F.col("idx") + F.col("k"))).alias("label"))


_NAMES = ("malformed_tool_call", "step_repetition", "info_withholding", "premature_termination", "ungrounded_citation", "disobey_task_spec", "retrieval_detour", "agent_deadlock", "no_progress_loop", "invalid_output")


@trace_query("v8_fault_redaction", f"n AS (SELECT trace_id, idx, {pick_sql(_NAMES, 'idx + k')} AS name, k FROM ev) SELECT trace_id, idx, 'saw ' || CASE WHEN name IN ('no_progress_loop', 'invalid_output') THEN replace(name, '_', ['_', ' - ', '-', '  '][k % 4 + 1]) ELSE '<edited>' END || ' here' AS text FROM n")
def v8(events, traces):
    """All eight names in four spellings, and two names that aren't faults and stay."""
    sep = F.element_at(F.array(*map(F.lit, ("_", " - ", "-", "  "))), (F.col("k") % 4 + 1).cast("int"))
    name = F.replace(pick(_NAMES, F.col("idx") + F.col("k")), F.lit("_"), sep)
    return events.select("trace_id", "idx", v.redact_faults(F.concat(F.lit("saw "), name, F.lit(" here"))).alias("text"))


#: Symptoms within trials: the rules over events renamed by trial.
TRIAL_SYM_SQL = TRIAL_SQL + ", evt AS (SELECT ev.* REPLACE (trace_id || '#' || trial AS trace_id), trace_id AS own_trace, trial FROM ev JOIN ti USING (trace_id) WHERE idx BETWEEN lo AND hi), " + SYM_SQL.replace("FROM ev", "FROM evt").strip() + """,
tl AS (SELECT trace_id, min(own_trace) AS own_trace, min(trial) AS trial, arg_max(idx, (kind = 'LLM_CALL', idx)) AS l_step, arg_max(agent, (kind = 'LLM_CALL', idx)) AS l_agent FROM evt GROUP BY trace_id),
tf AS (SELECT trace_id, arg_min(step, rule_no) AS step, arg_min(agent, rule_no) AS agent, arg_min(fault, rule_no) AS fault FROM sy0 WHERE step IS NOT NULL GROUP BY trace_id),
tfl AS (SELECT own_trace AS trace_id, trial, coalesce(step, l_step) AS step, CASE WHEN step IS NULL THEN l_agent ELSE tf.agent END AS agent, fault FROM tl LEFT JOIN tf USING (trace_id))
"""


@trace_query("v11_interventions", TRIAL_SYM_SQL + ", " + re.sub(r"\b(y0|y2|y3|rd|ci|ll|sy0|sy)\b", r"\1w", SYM_SQL).strip() + ", ws AS (SELECT trace_id, step, arg_min(fault, rule_no) AS fault FROM sy0w GROUP BY ALL) SELECT tfl.trace_id, trial, step, tfl.agent, CASE WHEN tfl.agent = 'planner' THEN 'orchestrator_instruction' ELSE 'subagent_instruction' END AS category, " + FIX_SQL.replace("CASE fault", "CASE ws.fault").replace("|| ' before continuing.'", "|| ', then continue per the task requirements.'") + " AS replacement FROM tfl LEFT JOIN ws USING (trace_id, step)")
def v11(events, traces):
    return v.interventions(v.trial_failures(events), events)


SCORE_SQL = HYP_SQL + ", " + RERUN_SQL + """,
top AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY confidence DESC, algo, rank) AS rn FROM hy),
lf AS (SELECT trace_id, CASE CAST(regexp_extract(trace_id, '^u(\\d+)w', 1) AS INT) % 3 WHEN 0 THEN min_by(code, rule_no) WHEN 1 THEN max_by(code, rule_no) END AS code FROM sy GROUP BY trace_id),
rec AS (SELECT trace_id, bool_or(success) AS recovered FROM (SELECT rerun_of AS trace_id, success, row_number() OVER (PARTITION BY rerun_of ORDER BY seq, ru.trace_id) AS round FROM ru) WHERE round <= 3 GROUP BY trace_id),
imp AS (SELECT rerun_of AS trace_id, max_by(success, seq) AS improved FROM ru GROUP BY rerun_of),
sco AS (SELECT tr.trace_id, gt_kind, coalesce(top.step = gt_step, false) AS step_hit, coalesce(top.agent = gt_agent, false) AS agent_hit, coalesce(lf.code = gt_code, false) AS code_hit, coalesce(recovered, false) AS recovered, coalesce(improved, false) AS improved
  FROM tr LEFT JOIN top ON top.trace_id = tr.trace_id AND rn = 1 LEFT JOIN lf ON lf.trace_id = tr.trace_id LEFT JOIN rec ON rec.trace_id = tr.trace_id LEFT JOIN imp ON imp.trace_id = tr.trace_id WHERE gt_step IS NOT NULL)"""


def judged(events, traces):
    """Labels of every third user's traces in order of rules, findings of those and of the next in reverse order, none of the others; recoveries and closed loops of reruns."""
    s = c.symptoms(events).withColumn("u", F.regexp_extract("trace_id", r"^u(\d+)w", 1).cast("int") % 3)
    reruns = reruns_of(traces)
    return {"labels": s.where("u = 0").select("trace_id", F.col("rule_no").alias("pos"), "code"), "findings": s.where("u < 2").select("trace_id", (-F.col("rule_no")).alias("pos"), "code"), "recovered": v.attempt_ledger(reruns), "improved": v.verify_closed_loop(reruns)}


@trace_query("e1_gt_evaluation", SCORE_SQL + " SELECT * FROM sco", kept=True)
def e1(events, traces):
    return e.score_hypotheses(all_hypotheses(events, traces), traces, **judged(events, traces))


@trace_query("e2_kind_rollup", SCORE_SQL + " SELECT coalesce(gt_kind, 'total') AS kind, count(*) AS total, count(*) FILTER (step_hit) AS step_hits, count(*) FILTER (agent_hit) AS agent_hits, count(*) FILTER (code_hit) AS code_hits, count(*) FILTER (recovered) AS recovered, count(*) FILTER (improved) AS improved FROM sco GROUP BY ROLLUP (gt_kind)", kept=True)
def e2(events, traces):
    return e.rollup_by_kind(e.score_hypotheses(all_hypotheses(events, traces), traces, **judged(events, traces)))


@trace_query("e3_stack_comparison", SCORE_SQL + """, st AS (SELECT 'rules' AS config, * FROM hy WHERE algo = 'single_pass' UNION ALL SELECT 'spectrum', * FROM hy WHERE algo = 'sbfl'), tp AS (SELECT *, row_number() OVER (PARTITION BY config, trace_id ORDER BY confidence DESC, algo, rank) AS rn FROM st), cf AS (SELECT unnest(['rules', 'spectrum']) AS config)
SELECT cf.config, count(*) AS total, count(*) FILTER (tp.step = gt_step) AS step_hits, count(*) FILTER (tp.agent = gt_agent) AS agent_hits, count(*) FILTER (cf.config = 'rules' AND code_hit) AS code_hits, count(*) FILTER (cf.config = 'rules' AND recovered) AS recovered, count(*) FILTER (cf.config = 'rules' AND improved) AS improved,
  CASE WHEN cf.config = 'rules' THEN (SELECT count(*) FROM ev) ELSE 0 END AS n_calls, CASE WHEN cf.config = 'rules' THEN (SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) FROM (SELECT kind, count(*) AS n FROM ev GROUP BY kind)) ELSE '' END AS calls_by_tag, CASE WHEN cf.config = 'rules' THEN (SELECT count(*) FROM ev WHERE k % 50 = 0) ELSE 0 END AS errors
FROM tr JOIN sco USING (trace_id) CROSS JOIN cf LEFT JOIN tp ON tp.trace_id = tr.trace_id AND tp.config = cf.config AND rn = 1 GROUP BY cf.config""", kept=True)
def e3(events, traces):
    """Two stacks; the calls of the first are tagged by the kinds of events, its errors are of every fiftieth kind."""
    h = all_hypotheses(events, traces)
    rules = {"hyps": h.where("algo = 'single_pass'"), "calls": events.select(F.col("kind").alias("tag")), "errors": events.where("k % 50 = 0"), "traces": traces, **judged(events, traces)}
    return e.compare_stacks({"rules": rules, "spectrum": h.where("algo = 'sbfl'")}, traces)


@trace_query("e5_run_rounds", HYP_SQL + ", " + RERUN_SQL + """, rnd AS (SELECT trace_id, success, CAST(time_window >= 'w5' AS INT) AS round FROM tr), al AS (SELECT unnest([0, 1]) AS round),
sm AS (SELECT al.round, (SELECT count(*) FROM rnd WHERE rnd.round = al.round) AS n_traces, (SELECT count(*) FROM rnd WHERE rnd.round = al.round AND NOT success) AS n_failed, (SELECT count(DISTINCT trace_id) FROM hy JOIN rnd USING (trace_id) WHERE rnd.round = al.round) AS n_attributed,
  (SELECT count(*) FROM ru JOIN rnd ON rnd.trace_id = ru.rerun_of WHERE rnd.round = al.round) AS n_reruns, (SELECT count(*) FROM ru JOIN rnd ON rnd.trace_id = ru.rerun_of WHERE rnd.round = al.round AND ru.success) AS n_rerun_ok, (SELECT count(DISTINCT trace_id) FROM ev JOIN rnd USING (trace_id) WHERE rnd.round = al.round AND k % 50 = 0) AS n_errors FROM al)
SELECT round, CAST(sum(n_traces) AS BIGINT) AS n_traces, CAST(sum(n_failed) AS BIGINT) AS n_failed, CAST(sum(n_attributed) AS BIGINT) AS n_attributed, CAST(sum(n_reruns) AS BIGINT) AS n_reruns, CAST(sum(n_rerun_ok) AS BIGINT) AS n_rerun_ok, CAST(sum(n_errors) AS BIGINT) AS n_errors FROM sm GROUP BY ROLLUP (round)""", kept=True)
def e5_rounds(events, traces):
    """Windows from the fifth on are the second round; a trace with an event of every fiftieth kind is an error."""
    second = lambda d, key="trace_id": d.withColumn("_r", F.regexp_extract(key, r"w(\d+)$", 1).cast("int") >= 5)
    split = q.quarantine(events, "represent", "canonical_events", [(F.col("k") % 50 == 0, "bad event")])
    tables = [second(traces), second(all_hypotheses(events, traces)), second(reruns_of(traces), "rerun_of"), second(split.errors)]
    return e.run_rounds({k: tuple(t.where(F.col("_r") == bool(k)) for t in tables) for k in (0, 1)})


@trace_query("e13_stage_log", """b AS (SELECT 'represent' AS stage, 'canonical_events' AS name, trace_id, 'a span without an id' AS error FROM ev WHERE k % 50 = 0 UNION ALL SELECT 'import', 'observations', trace_id, 'observation without an id, named ' || coalesce(action, 'nothing') FROM ev WHERE k % 40 = 1
  UNION ALL SELECT 'analyze', 'judge_eval', trace_id, CASE WHEN k % 2 = 0 THEN 'unclosed' ELSE 'no object' END FROM ev WHERE idx = 0 AND k % 7 = 3 UNION ALL SELECT 'recover', 'score_writer', trace_id, n || ' source spans for ' || (n + 1) || ' events' FROM (SELECT trace_id, count(*) - 1 AS n FROM ev GROUP BY trace_id HAVING count(*) % 4 = 1)),
f AS (SELECT stage, name, trace_id, min(error) AS error FROM b GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY stage, name ORDER BY trace_id) AS o FROM f),
h AS (SELECT stage, name, count(*) AS failed, string_agg(trace_id || ': ' || error, '; ' ORDER BY o) FILTER (o <= 3) AS said FROM g GROUP BY ALL), n AS (SELECT count(DISTINCT trace_id) AS processed FROM ev)
SELECT stage, name, processed, failed, processed - failed AS ok, stage || '/' || name || ' -> ' || (processed - failed) || '/' || processed || ' traces; ' || failed || ' isolated: ' || said AS line FROM h CROSS JOIN n""")
def e13_log(events, traces):
    """Spans and observations without ids, answers without an object, lists that are too short: each keeps its trace out of its step alone."""
    splits = [q.span_faults(heap_spans(events)), q.checked_observations(observed(events))[1], q.checked_answers(answered(events), "judge_eval"), q.checked_sources(events, listed(events))[1]]
    return e.stage_log([s.log for s in splits], [s.errors for s in splits])


def heap_spans(events):
    span_id = F.when(F.col("k") % 50 != 0, F.concat(F.lit("s"), F.col("idx").cast("string")))
    parent = F.when(F.col("idx") > 0, F.concat(F.lit("s"), F.floor((F.col("idx") - 1) / 2).cast("string")))
    return events.select("trace_id", span_id.alias("span_id"), parent.alias("parent_span_id"), F.col("idx").alias("ordinal"))


def observed(events):
    none = F.lit(None).cast("string")
    return events.select("trace_id", F.when(F.col("k") % 40 != 1, F.col("id")).otherwise(F.lit("")).alias("id"), F.col("action").alias("name"), F.lit("SPAN").alias("type"), *(none.alias(c) for c in ("parent_id", "start_time", "input", "output", "level", "metadata", "top")))


def answered(events):
    return events.where("idx = 0").select("trace_id", F.when(F.col("k") % 7 != 3, '{"score": 1}').when(F.col("k") % 2 == 0, '{"score": 1').otherwise("I can't say").alias("response"))


def listed(events):
    ids = F.transform(F.array_sort(F.collect_list("idx")), lambda i: F.concat(F.lit("s"), i.cast("string")))
    return events.groupBy("trace_id").agg(ids.alias("s")).select("trace_id", F.when(F.size("s") % 4 == 1, F.slice("s", F.lit(1), F.size("s") - 1)).otherwise(F.col("s")).alias("source_span_ids"))


@trace_query("x6_quarantined_spans", """bad AS (SELECT trace_id, count(*) AS n_rows FROM ev WHERE k % 50 = 0 GROUP BY ALL) SELECT ev.trace_id, 'whole' AS status, count(*) AS n, CAST(max(CAST(floor(log2(idx + 1)) AS INT)) + 1 AS INT) AS depth FROM ev WHERE trace_id NOT IN (SELECT trace_id FROM bad) GROUP BY ev.trace_id UNION ALL SELECT trace_id, 'a span without an id', n_rows, NULL FROM bad""")
def x6(events, traces):
    """Heap-shaped span trees, some of whose spans have no id: these traces give error rows, all others are flattened."""
    flat, split = q.checked_spans(heap_spans(events))
    whole = flat.groupBy("trace_id").agg(F.count("*").alias("n"), F.max("depth").alias("depth")).select("trace_id", F.lit("whole").alias("status"), "n", "depth")
    return whole.unionByName(split.errors.select("trace_id", F.col("error").alias("status"), F.col("n_rows").alias("n"), F.lit(None).cast("int").alias("depth")))


@trace_query("e5_run_summary", HYP_SQL + ", " + RERUN_SQL + " SELECT (SELECT count(*) FROM tr) AS n_traces, (SELECT count(*) FROM tr WHERE NOT success) AS n_failed, (SELECT count(DISTINCT trace_id) FROM hy) AS n_attributed, (SELECT count(*) FROM ru) AS n_reruns, (SELECT count(*) FROM ru WHERE success) AS n_rerun_ok")
def e5(events, traces):
    return e.run_summary(traces, all_hypotheses(events, traces), reruns_of(traces))


def calls_of(spark, sf_dir):
    """Call log of the event table: one call an event."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.col("event_type").alias("tag"), F.round(F.col("value") * 10).cast("long").alias("latency_ms"), (F.col("event_type") != "error").alias("ok"), F.when(k % 10 == 0, 2).otherwise(1).alias("http_requests"), (k * 7).cast("long").alias("tokens"))


CALL_SQL = "WITH ca AS (SELECT event_id AS call_id, event_type AS tag, CAST(round(value * 10) AS BIGINT) AS latency_ms, event_type <> 'error' AS ok, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 10 = 0 THEN 2 ELSE 1 END AS http_requests, CAST(json_extract_string(props, '$.k') AS BIGINT) * 7 AS tokens FROM events)"


@query("e6_call_metrics", CALL_SQL + ", p AS (SELECT *, count(*) OVER (PARTITION BY tag) AS n, row_number() OVER (PARTITION BY tag ORDER BY latency_ms, call_id) - 1 AS place FROM ca) SELECT tag, count(*) AS n_calls, avg(CAST(ok AS DOUBLE)) AS ok_rate, avg(http_requests) AS http_per_call, avg(CAST(http_requests > 1 AS DOUBLE)) AS repair_rate, max(latency_ms) FILTER (place = floor(0.5 * n)) AS p50, max(latency_ms) FILTER (place = floor(0.95 * n)) AS p95, max(latency_ms) AS latest, CAST(sum(tokens) AS BIGINT) AS tokens FROM p GROUP BY tag")
def e6(spark, sf_dir):
    return e.call_metrics(calls_of(spark, sf_dir))


@query("e6_sparse_calls", CALL_SQL + """, s AS (SELECT tag, ok, CASE WHEN call_id % 7 = 3 THEN 1 ELSE http_requests END AS http, CASE WHEN call_id % 11 = 5 THEN 0 ELSE latency_ms END AS lat, CASE WHEN call_id % 5 = 2 THEN 0 ELSE tokens END AS tokens, CASE WHEN call_id % 5 = 2 THEN 0 ELSE tokens // 3 END AS prompt, CASE WHEN call_id % 5 <> 1 THEN 0 ELSE tokens - tokens // 3 END AS completion FROM ca)
SELECT tag, count(*) AS n_calls, sum(http) / count(*) AS http_per_call, min(lat) AS least, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(prompt) AS BIGINT) AS prompt_tokens, CAST(sum(completion) AS BIGINT) AS completion_tokens FROM s GROUP BY tag""")
def e6_sparse(spark, sf_dir):
    """Calls without requests, latencies or tokens, by rule."""
    none = lambda when, c: F.when(~when, c)
    i, t = F.col("call_id"), F.col("tokens")
    third = F.expr("tokens div 3")
    c_ = calls_of(spark, sf_dir).withColumns({"http_requests": none(i % 7 == 3, F.col("http_requests")), "latency_ms": none(i % 11 == 5, F.col("latency_ms")), "prompt_tokens": none(i % 5 == 2, third), "completion_tokens": none(i % 5 != 1, t - third), "tokens": none(i % 5 == 2, t)})
    m = e.call_metrics(c_)
    least = c_.groupBy("tag").agg(F.min(F.coalesce("latency_ms", F.lit(0))).alias("least"))
    return m.join(least, "tag").select("tag", "n_calls", "http_per_call", "least", "tokens", "prompt_tokens", "completion_tokens")


@query("e7_tag_drift", CALL_SQL + ", n AS (SELECT tag, count(*) AS n_calls FROM ca GROUP BY ALL), p AS (SELECT event_type AS tag, count(DISTINCT user_id) * 20 AS planned FROM events WHERE event_type <> 'error' GROUP BY ALL) SELECT tag, coalesce(n_calls, 0) AS n_calls, planned, coalesce(abs(n_calls - planned) > 0.15 * planned, true) AS drifts FROM n FULL JOIN p USING (tag)")
def e7(spark, sf_dir):
    plan = table(spark, sf_dir, "events").where("event_type <> 'error'").groupBy(F.col("event_type").alias("tag")).agg((F.countDistinct("user_id") * 20).alias("planned"))
    return e.tag_drift(calls_of(spark, sf_dir), plan)


@trace_query("e8_leak_scan", "w AS (SELECT unnest(['malformed_tool_call', 'step_repetition', 'info_withholding', 'premature_termination', 'ungrounded_citation', 'disobey_task_spec', 'retrieval_detour', 'agent_deadlock', 'injected_fault', 'ground_truth', 'qrels']) AS word), " + f"p AS (SELECT kind AS tag, concat_ws(' ', kind, agent, action, query, doc_id, answer, to_agent, content, {pick_sql((*_NAMES, 'qrels', 'Ground_Truth', None), 'idx + k')}) AS prompt, {pick_sql((None, 'agent_deadlock'), 'k')} AS response FROM ev), h AS (SELECT CASE WHEN tag = 'HANDOFF' THEN 'environment' ELSE 'prompt' END AS place, tag, word FROM p JOIN w ON contains(prompt, word) UNION ALL SELECT 'response', tag, word FROM p JOIN w ON contains(response, word)) SELECT place, tag, word, count(*) AS n_calls FROM h GROUP BY ALL")
def e8(events, traces):
    """Calls whose prompts or responses hold names of faults and of ground truth: a prompt is all texts of its event and a name by rule, and where there is no name the rest is still scanned. Handoffs stand for the environment's own tag."""
    calls = events.select(F.col("kind").alias("tag"), F.concat_ws(" ", "kind", "agent", "action", "query", "doc_id", "answer", "to_agent", "content", pick((*_NAMES, "qrels", "Ground_Truth", None), F.col("idx") + F.col("k"))).alias("prompt"), pick((None, "agent_deadlock"), F.col("k")).alias("response"))
    return e.leak_scan(calls, environment=("HANDOFF",))


@trace_query("e9_claim_coverage", CLAIM_SQL + " SELECT tr.trace_id, coalesce(bool_or(gt_step BETWEEN introduced AND coalesce(effective, gt_step)), false) AS covered FROM tr LEFT JOIN cl c USING (trace_id) WHERE gt_step IS NOT NULL GROUP BY tr.trace_id")
def e9(events, traces):
    return e.claim_coverage(r.rule_claims(*claim_world(events, traces)), traces)


@trace_query("e11_cost_estimate", LINE_SQL + """, vw AS (SELECT trace_id, length('TASK: ' || min(task) || '=== TRACE BEGIN ===' || '=== TRACE END ===' || string_agg(line, chr(10))) + 3 AS len, count(*) AS n FROM li JOIN tr USING (trace_id) GROUP BY trace_id), t AS (SELECT greatest(1, len // 4) AS tokens, CAST(greatest(1, ceil(log2(n))) AS BIGINT) AS rounds FROM vw),
m AS (SELECT 'single_pass' AS method, count(*) AS n_calls, CAST(sum(tokens + 1200) AS BIGINT) AS in_tokens, CAST(count(*) * 150 AS BIGINT) AS out_tokens FROM t UNION ALL SELECT 'bisection', CAST(sum(rounds) AS BIGINT), CAST(sum(2 * tokens + 130 * rounds) AS BIGINT), CAST(sum(rounds) * 10 AS BIGINT) FROM t),
p AS (SELECT unnest(['cheap', 'frontier']) AS preset, unnest([0.15, 2.5]) AS a, unnest([0.6, 10.0]) AS b) SELECT method, preset, n_calls, in_tokens, out_tokens, round(in_tokens / 1e6 * a + out_tokens / 1e6 * b, 6)::DOUBLE AS usd FROM m, p""")
def e11(events, traces):
    return e.cost_estimate(r.render_traces(events, traces), events)


@trace_query("e12_trace_summaries", HYP_SQL + ", hl AS (SELECT trace_id, string_agg(substr(concat_ws(' ', algo, agent, step, code), 1, 160), chr(10) ORDER BY concat_ws(' ', algo, agent, step, code)) AS lines FROM hy WHERE rank = 1 GROUP BY ALL), n AS (SELECT trace_id, count(*) AS n_events FROM ev GROUP BY ALL) SELECT tr.trace_id, success, n_events, coalesce(lines, '') AS lines FROM tr JOIN n USING (trace_id) LEFT JOIN hl USING (trace_id)")
def e12(events, traces):
    return e.trace_summaries(events, traces, all_hypotheses(events, traces))


@trace_query("e8_leaking_records", f"p AS (SELECT kind AS tag, coalesce(content, '') || ' ' || {pick_sql((*_NAMES, 'qrels', 'Ground_Truth', None), 'idx + k')} AS prompt, trace_id || '/' || lpad(CAST(idx AS VARCHAR), 5, '0') AS record FROM ev), h AS (SELECT tag, record, row_number() OVER (PARTITION BY tag ORDER BY record) AS n FROM p WHERE contains(prompt, 'qrels')) SELECT tag, count(*) AS n_calls, string_agg(record, ',' ORDER BY record) FILTER (n <= 10) AS records FROM h GROUP BY tag")
def e8_records(events, traces):
    calls = events.select(F.col("kind").alias("tag"), F.concat_ws("/", "trace_id", F.lpad(F.col("idx").cast("string"), 5, "0")).alias("record"), F.concat(F.coalesce("content", F.lit("")), F.lit(" "), pick((*_NAMES, "qrels", "Ground_Truth", None), F.col("idx") + F.col("k"))).alias("prompt"), F.lit(None).cast("string").alias("response"))
    found = e.leak_scan(calls, environment=("HANDOFF",)).where("word = 'qrels'")
    return found.select("tag", "n_calls", F.array_join("records", ",").alias("records"))


@trace_query("e12_bundle_summaries", RERUN_SQL + """, n AS (SELECT trace_id, count(*) AS n FROM ev GROUP BY ALL),
ar AS (SELECT trace_id, 0 AS o, CASE WHEN kind = 'VERIFIER' THEN 5 WHEN kind = 'TOOL_CALL' THEN 2 ELSE 1 END AS k, kind AS by_, '  artifact ' || CASE WHEN kind = 'VERIFIER' THEN 'recover' WHEN kind = 'TOOL_CALL' THEN 'analyze' ELSE 'represent' END || '/' || kind || ': ' || substr('{"n":' || count(*) || ',"pad":"' || repeat('x', 200) || '"}', 1, 160) AS line FROM ev GROUP BY trace_id, kind
  UNION ALL SELECT rerun_of, 1, 0, trace_id, '  rerun ' || trace_id || ': ' || CASE WHEN success THEN 'success' ELSE 'FAILURE' END FROM ru),
al AS (SELECT trace_id, string_agg(line, chr(10) ORDER BY o, k, by_) AS lines FROM ar GROUP BY trace_id)
SELECT tr.trace_id, 'trace=' || tr.trace_id || ' task=''' || substr(task, 1, 60) || '''' || chr(10) || 'outcome=(' || CASE WHEN success THEN 'success' ELSE 'FAILURE' END || ') events=' || n || chr(10) || lines AS summary FROM tr JOIN n USING (trace_id) JOIN al USING (trace_id)""")
def e12_bundles(events, traces):
    stage = F.when(F.col("kind") == "VERIFIER", "recover").when(F.col("kind") == "TOOL_CALL", "analyze").otherwise("represent")
    artifacts = events.groupBy("trace_id", "kind").agg(F.count("*").alias("n")).select("trace_id", stage.alias("stage"), F.col("kind").alias("name"), F.to_json(F.struct("n", F.repeat(F.lit("x"), 200).alias("pad"))).alias("json"))
    return e.bundle_summaries(events, traces, artifacts, reruns_of(traces))
