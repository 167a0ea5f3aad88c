"""Queries of alignment, verdict handling and the remaining formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.model import MODES
from tracewright.operators import align
from tracewright.operators import attribute as t
from tracewright.operators import classify as c
from tracewright.operators import evaluate as e
from tracewright.operators import recover as v
from tracewright.operators import represent as r
from tracewright.plans.attribute_queries import HYP_SQL, SUPPORT_SQL, all_hypotheses, supported
from tracewright.plans.analyze_queries import SYM_SQL
from tracewright.plans.classify_queries import CLUSTER_SQL, symptom_texts
from tracewright.plans.noise import dressed
from tracewright.plans.registry import trace_query
from tracewright.plans.recover_queries import SCORE_SQL, TRIAL_SYM_SQL, judged
from tracewright.plans.represent_queries import CLAIM_SQL, SIG_SQL, anchored, claim_world
from tracewright.plans.source_queries import pick, pick_sql
from tracewright.sources import formats as f
from tracewright.sources import imports as im
from tracewright.tables import durable


#: The walk of the definition: lengths row by row from the end, then one step a round for all traces.
ALIGN_SQL = SIG_SQL.strip() + r""",
ln0 AS (SELECT trace_id, count(*) AS n_events FROM ev GROUP BY ALL),
rf AS (SELECT task_id, trace_id AS reference FROM tr JOIN ln0 USING (trace_id) WHERE success QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY n_events, trace_id) = 1),
sn AS (SELECT sa.trace_id, idx, action_class, target, effect, signature, row_number() OVER (PARTITION BY sa.trace_id ORDER BY idx) AS k FROM sa),
pr AS (SELECT o.trace_id, rf.reference, r.k AS r, o.k AS k, o.action_class = r.action_class AND o.target IS NOT DISTINCT FROM r.target AND (o.effect = r.effect OR 'OFF-ANCHOR' IN (o.effect, r.effect) OR (o.effect IN ('SURVIVED', 'JUSTIFIED') AND r.effect IN ('SURVIVED', 'JUSTIFIED'))) AS fit FROM sn o JOIN tr USING (trace_id) JOIN rf USING (task_id) JOIN sn r ON r.trace_id = rf.reference),
fl AS (SELECT trace_id, reference, r, list(fit ORDER BY k) AS f FROM pr GROUP BY ALL),
lv AS (WITH RECURSIVE le AS (
    SELECT trace_id, max(r) + 1 AS r, list_transform(range(CAST(any_value(len(f)) AS BIGINT) + 1), lambda x: CAST(0 AS BIGINT)) AS v FROM fl GROUP BY trace_id
    UNION ALL SELECT trace_id, r, list_append(list_transform(range(1, len(h) + 1), lambda k: list_max(h[k:])), 0) FROM (SELECT le.trace_id, fl.r, list_transform(range(1, len(f) + 1), lambda k: greatest(v[k], CASE WHEN f[k] THEN v[k + 1] + 1 ELSE 0 END)) AS h FROM le JOIN fl ON fl.trace_id = le.trace_id AND fl.r = le.r - 1))
  SELECT * FROM le),
wk AS (WITH RECURSIVE st AS (
    SELECT trace_id, CAST(1 AS BIGINT) AS r, CAST(1 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS hit FROM fl GROUP BY trace_id
    UNION ALL SELECT st.trace_id, CASE WHEN f[st.k] OR b.v[st.k] >= a.v[st.k + 1] THEN st.r + 1 ELSE st.r END, CASE WHEN f[st.k] OR b.v[st.k] < a.v[st.k + 1] THEN st.k + 1 ELSE st.k END, CASE WHEN f[st.k] THEN st.k END
    FROM st JOIN fl ON fl.trace_id = st.trace_id AND fl.r = st.r JOIN lv a ON a.trace_id = st.trace_id AND a.r = st.r JOIN lv b ON b.trace_id = st.trace_id AND b.r = st.r + 1 WHERE st.k <= len(f))
  SELECT trace_id, hit AS k, CAST(r - 2 AS INT) AS ref_place FROM st WHERE hit IS NOT NULL),
ali AS (SELECT sn.trace_id, rf.reference, idx, signature, ref_place FROM sn JOIN tr USING (trace_id) JOIN rf USING (task_id) LEFT JOIN wk ON wk.trace_id = sn.trace_id AND wk.k = sn.k)
"""


@trace_query("r15_reference_alignment", ALIGN_SQL + "SELECT * FROM ali")
def r15(events, traces):
    return align.align_to_reference(anchored(events, traces), traces, r.reference_traces(events, traces))


@trace_query("r16_divergence_spans", ALIGN_SQL + ", g AS (SELECT *, count(ref_place) OVER (PARTITION BY trace_id ORDER BY idx) AS run FROM ali) SELECT trace_id, min(idx) AS start_idx, max(idx) AS end_idx, count(*) AS length FROM g WHERE ref_place IS NULL GROUP BY trace_id, run")
def r16(events, traces):
    return align.divergence_spans(r15(events, traces))


@trace_query("r16_alignment_stats", ALIGN_SQL + ", h AS (SELECT trace_id, round(count(ref_place) / count(*), 4) AS coverage, count(*) - count(ref_place) AS n_added FROM ali GROUP BY trace_id), o AS (SELECT trace_id, round(avg(CAST(effect = 'OFF-ANCHOR' AS INT)), 4) AS off_anchor_ratio FROM sa GROUP BY trace_id) SELECT * FROM h JOIN o USING (trace_id)")
def r16_stats(events, traces):
    sigs = anchored(events, traces)
    return align.alignment_stats(align.align_to_reference(sigs, traces, r.reference_traces(events, traces)), sigs)


def claim_json(claims):
    """Claims of each trace as a judge may give them: twice, with unknown types and statuses, steps outside the trace and unsorted reuse put in by rule."""
    i = F.col("introduced")
    one = F.struct(
        F.col("claim_id").alias("id"), "text", F.when(i % 7 == 3, "rumour").otherwise(F.col("claim_type")).alias("type"), F.when(i % 11 == 5, "sure").otherwise(F.col("status")).alias("status"), F.when(i % 5 == 2, i + 500).otherwise(i).alias("introduced_step"),
        F.when(i % 3 != 0, i - 1).alias("first_effective_step"), F.array(i + 2, i - 3, i + 2, F.lit(9999)).alias("reuse_steps"),
    )
    each = F.transform(F.array_sort(F.collect_list(F.struct("claim_id", one.alias("c")))), lambda x: x["c"])
    return claims.groupBy("trace_id").agg(each.alias("claims")).select("trace_id", dressed(F.to_json(F.struct(F.concat("claims", "claims").alias("claims"))), F.col("trace_id")).alias("response"))


@trace_query("r29_claim_verdicts", CLAIM_SQL + """, la AS (SELECT trace_id, max(idx) AS last FROM ev GROUP BY ALL), xc AS (SELECT cl.*, last, rep, introduced % 7 <> 3 AND introduced % 11 <> 5 AS valid, CASE WHEN introduced % 5 = 2 THEN last ELSE introduced END AS i FROM cl JOIN la USING (trace_id), (SELECT unnest([0, 1]) AS rep)),
xn AS (SELECT *, sum(CAST(valid AS INT)) OVER (PARTITION BY trace_id ORDER BY rep, n) AS nth FROM xc)
SELECT trace_id, claim_id, text, CASE WHEN introduced % 7 = 3 THEN 'rumour' ELSE claim_type END AS claim_type, CASE WHEN introduced % 11 = 5 THEN 'sure' ELSE status END AS status, valid, CASE WHEN valid THEN i END AS introduced, CASE WHEN valid AND introduced % 3 <> 0 THEN i END AS effective, CASE WHEN valid THEN array_to_string(list_sort(list_distinct([i, least(greatest(introduced + 2, i), last), last])), ',') END AS reuse FROM xn WHERE NOT valid OR nth <= 6""")
def r29(events, traces):
    e, tr = claim_world(events, traces)
    return r.claim_ledger(claim_json(r.rule_claims(e, tr)), e).withColumn("reuse", F.array_join(F.col("reuse").cast("array<string>"), ","))


@trace_query("c9_extended_modes", "p AS (SELECT DISTINCT 'X-' || substr(md5(content), 1, 4) AS code, content AS name, CASE WHEN length(content) % 2 = 0 THEN content ELSE '' END AS definition FROM ev WHERE kind = 'HANDOFF') SELECT *, CASE WHEN definition = '' THEN 'skipped' ELSE 'accepted' END AS status FROM p")
def c9(events, traces):
    text = events.where("kind = 'HANDOFF'").select("content").distinct()
    p = text.select(F.concat(F.lit("X-"), F.substring(F.md5("content"), 1, 4)).alias("code"), F.col("content").alias("name"), F.when(F.length("content") % 2 == 0, F.col("content")).otherwise("").alias("definition"))
    return c.extended_modes(p, events.sparkSession.createDataFrame([(m,) for m in MODES], "code string"))


@trace_query("c11_mode_match", SYM_SQL + ", s AS (SELECT trace_id || '/' || rule_no AS id, replace(fault, '_', ' ') AS symptom FROM sy) SELECT id, CASE symptom WHEN 'step repetition' THEN 'FM-1.3' WHEN 'info withholding' THEN NULL WHEN 'premature termination' THEN 'FM-3.1' END AS code, CAST(2 AS BIGINT) AS overlap FROM s WHERE symptom IN ('step repetition', 'premature termination')")
def c11(events, traces):
    s = c.symptoms(events).select(F.concat("trace_id", F.lit("/"), F.col("rule_no").cast("string")).alias("id"), F.regexp_replace("fault", "_", " ").alias("symptom"))
    return c.match_modes(s, events.sparkSession.createDataFrame(list(MODES.items()), "code string, name string"))


_STOP = ", ".join(f"'{w}'" for w in c.STOP_WORDS)
PROPOSAL_SQL = CLUSTER_SQL + f""",
pw0 AS (SELECT leader, symptom, n, list_filter(regexp_extract_all(lower(symptom), '[a-z]{{3,}}'), lambda w: w NOT IN ({_STOP})) AS ws FROM lc JOIN tx USING (symptom)),
pw AS (SELECT leader, symptom, n, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM pw0),
pg AS (SELECT leader, word, sum(n) AS k, min((symptom, pos)) AS seen FROM pw GROUP BY ALL),
pn AS (SELECT leader, string_agg(word, ' ' ORDER BY k DESC, seen) AS name FROM (SELECT * FROM pg QUALIFY row_number() OVER (PARTITION BY leader ORDER BY k DESC, seen) <= 3) GROUP BY leader),
mo AS (SELECT * FROM (VALUES {", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in MODES.items())}) m(code, mode)),
mw AS (SELECT code, unnest(list_distinct(list_filter(regexp_extract_all(lower(mode), '[a-z]{{3,}}'), lambda w: w NOT IN ({_STOP})))) AS word FROM mo),
pk AS (SELECT leader, code, count(*) AS common FROM pg JOIN mw USING (word) GROUP BY leader, code QUALIFY row_number() OVER (PARTITION BY leader ORDER BY count(*) DESC, code) = 1),
pz AS (SELECT leader, CAST(sum(n) AS BIGINT) AS support FROM lc JOIN tx USING (symptom) GROUP BY leader HAVING sum(n) >= 3),
pq AS (SELECT pz.leader, support, coalesce(name, 'unclassified residual') AS name, code AS kin, round(common / (SELECT count(*) FROM pg WHERE pg.leader = pz.leader), 4) AS overlap FROM pz LEFT JOIN pn USING (leader) LEFT JOIN pk USING (leader))
"""


@trace_query("c14_proposals", PROPOSAL_SQL + "SELECT 'NM-' || row_number() OVER (ORDER BY leader) AS mode_id, name, support, leader, kin, overlap FROM pq WHERE coalesce(overlap, 0) < 0.8 ORDER BY leader LIMIT 5")
def c14(events, traces):
    nodes = symptom_texts(events)
    return c.proposals(c.leader_clusters(nodes, c.similar_pairs(nodes)), nodes, events.sparkSession.createDataFrame(list(MODES.items()), "code string, name string"))


#: Answers of a judge: bare, denied in the naming clause, denied elsewhere, and unreadable ones.
ANSWERS = (
    "lower half", "Upper Half", "The error is in the Upper half.", "not in the lower half", "No error in the lower half", "the lower half looks clean", "the lower half is correct", "nothing wrong in the lower half", "none of it is upper half", "without doubt the upper half",
    "the upper half doesn't contain the error", "There is no doubt: the error is in the upper half", "Nothing conclusive; lower half", "I cannot be fully certain, but the error is in the lower half", "cannot be upper\nlet me think", "maybe in the middle", "between the lower half and the upper half", "", None,
)


@trace_query("t10_half_answers", f"a AS (SELECT trace_id, idx, lower({pick_sql(ANSWERS, 'idx + k')}) AS s FROM ev), w AS (SELECT *, CASE WHEN contains(s, 'lower') <> contains(s, 'upper') THEN CASE WHEN contains(s, 'lower') THEN 'lower' ELSE 'upper' END END AS word FROM a), c AS (SELECT *, (SELECT min_by(u.part, u.o) FROM (SELECT unnest(p) AS part, unnest(generate_series(1, len(p))) AS o FROM (SELECT regexp_split_to_array(s, '[,;:.!?\n]') AS p)) u WHERE contains(u.part, word)) AS part FROM w) SELECT trace_id, idx, CASE WHEN regexp_matches(part, '(^|[^a-z0-9_])(not|no|nothing|none|without|cannot|clean|correct)([^a-z0-9_]|$)|[a-z0-9_]n''t') THEN CASE word WHEN 'lower' THEN 'upper' ELSE 'lower' END ELSE word END AS half FROM c")
def t10(events, traces):
    return events.select("trace_id", "idx", t.parse_half(pick(ANSWERS, F.col("idx") + F.col("k"))).alias("half"))


@trace_query("t10_half_trail", f"a AS (SELECT trace_id, idx, lower({pick_sql(ANSWERS, 'idx + k')}) AS s FROM ev), w AS (SELECT *, CASE WHEN contains(s, 'lower') <> contains(s, 'upper') THEN CASE WHEN contains(s, 'lower') THEN 'lower' ELSE 'upper' END END AS word FROM a), c AS (SELECT *, (SELECT min_by(u.part, u.o) FROM (SELECT unnest(p) AS part, unnest(generate_series(1, len(p))) AS o FROM (SELECT regexp_split_to_array(s, '[,;:.!?\\n]') AS p)) u WHERE contains(u.part, word)) AS part FROM w) SELECT trace_id, idx, CASE WHEN word IS NOT NULL THEN regexp_matches(part, '(^|[^a-z0-9_])(not|no|nothing|none|without|cannot|clean|correct)([^a-z0-9_]|$)|[a-z0-9_]n''t') END AS negated, CASE WHEN word IS NULL THEN 'unparseable' END AS fault FROM c")
def t10_trail(events, traces):
    return events.select("trace_id", "idx", t.half_answer(pick(ANSWERS, F.col("idx") + F.col("k"))).alias("h")).select("trace_id", "idx", "h.negated", "h.fault")


@trace_query("t12_refined_fields", HYP_SQL + " SELECT trace_id, algo, rank, step, coalesce(CASE WHEN step % 2 = 0 THEN 'refined at ' || step END, 'step ' || step || ' by ' || agent || ' decided the failure') AS root_cause, CASE WHEN step % 2 = 0 THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM hy", kept=True)
def t12(events, traces):
    h = all_hypotheses(events, traces)
    refined = h.where("step % 2 = 0").select("trace_id", "step", F.concat(F.lit("refined at "), F.col("step").cast("string")).alias("root_cause"), F.lit(0.8).alias("confidence")).distinct()
    return t.refine(h.select("trace_id", "algo", "rank", "agent", "step"), refined).drop("agent")


@trace_query("t15_earliest_harmful", SUPPORT_SQL + "SELECT trace_id, min(responsible_step) AS first_error_step, string_agg(responsible_step, ',' ORDER BY responsible_step) AS error_steps FROM sup WHERE verdict IN ('harmful_unsupported_commitment', 'conflicting_support') GROUP BY trace_id")
def t15(events, traces):
    return t.earliest_harmful(supported(events, traces)[1]).withColumn("error_steps", F.array_join(F.col("error_steps").cast("array<string>"), ","))


#: Mechanisms as judges write them, and what each is clamped to.
SAID = {"local_error": "local_error", "Local_Eror": "local_error", "upstream propagation": "upstream_propagation", "executor_lop": "executor_loop", "loop": "unknown", "planning error": "planning_error", "dataflow_first_polution": "dataflow_first_pollution", "weather": "unknown", "": "unknown"}


@trace_query("t20_mechanism_clamp", f"l AS (SELECT trace_id, max(idx) AS last, list(DISTINCT agent) AS agents FROM ev GROUP BY ALL), v AS (SELECT ev.trace_id, ev.idx, k, last, agents, CASE WHEN k % 4 = 1 THEN last WHEN k % 4 = 2 THEN 0 ELSE ev.idx END AS step, k % 4 IN (1, 2) AS moved, k % 3 = 0 AS stranger FROM ev JOIN l USING (trace_id) WHERE ev.idx = 0) SELECT v.trace_id, CASE WHEN stranger THEN e.agent ELSE o.agent END AS agent, v.step, {pick_sql(tuple(SAID.values()), 'v.k')} AS mechanism, 0.6::DOUBLE AS confidence, concat_ws(',', CASE WHEN moved THEN 'step' END, CASE WHEN stranger THEN 'agent' END, CASE WHEN {pick_sql(tuple(SAID.values()), 'v.k')} <> {pick_sql(tuple(SAID), 'v.k')} THEN 'mechanism' END) AS clamped FROM v JOIN ev e ON e.trace_id = v.trace_id AND e.idx = v.step JOIN ev o ON o.trace_id = v.trace_id AND o.idx = v.idx")
def t20(events, traces):
    """Verdicts by rule: steps past the end or before the start, agents that aren't in the trace, and mechanisms in many spellings."""
    k = F.col("k")
    first = events.where("idx = 0").join(events.groupBy("trace_id").agg(F.max("idx").alias("last")), "trace_id")
    said = F.struct(F.when(k % 3 == 0, "stranger").otherwise(F.col("agent")).alias("responsible_agent"), F.when(k % 4 == 1, F.col("last") + 9).when(k % 4 == 2, F.lit(-3)).otherwise(F.col("idx")).alias("step"), pick(tuple(SAID), k).alias("mechanism"), F.lit(0.6).alias("confidence"))
    return t.localize(first.select("trace_id", dressed(F.to_json(said), F.col("trace_id")).alias("response")), events)


@trace_query("v2_feedback_text", HYP_SQL + """, vt AS (SELECT trace_id, idx, row_number() OVER (PARTITION BY trace_id ORDER BY idx) AS round FROM ev WHERE kind = 'VERIFIER'), nt AS (SELECT vt.trace_id, step, string_agg(chr(10) || '(attempt ' || round || ' failed: at ' || vt.idx || ' -- give a more specific correction targeting the earliest decisive error at step ' || step || '.)', '' ORDER BY round) AS notes FROM vt JOIN (SELECT DISTINCT trace_id, step FROM hy) h USING (trace_id) GROUP BY ALL)
SELECT trace_id, algo, rank, CASE WHEN step % 2 = 0 THEN 'fix ' || step ELSE 'cause ' || step END || coalesce(notes, '') AS feedback, 'Attribution reflection on the previous failed solve:' || chr(10) || 'cause ' || step || CASE WHEN step % 2 = 0 THEN chr(10) || 'Fix suggestion: fix ' || step ELSE '' END || chr(10) || '(responsible party ' || agent || ', decisive error at step ' || step || ')' AS reflection FROM hy LEFT JOIN nt USING (trace_id, step)""", kept=True)
def v2(events, traces):
    """Attempts by rule: one for each verdict of the trace."""
    h = all_hypotheses(events, traces)
    s = F.col("step").cast("string")
    n = F.row_number().over(r.by_trace())
    attempts = events.where("kind = 'VERIFIER'").select("trace_id", n.alias("round"), F.concat(F.lit("at "), F.col("idx").cast("string")).alias("note"))
    targets = h.select("trace_id", "algo", "rank", "agent", "step", F.when(F.col("step") % 2 == 0, F.concat(F.lit("fix "), s)).otherwise(" ").alias("fix"), F.concat(F.lit("cause "), s).alias("root_cause"))
    return v.feedback_text(targets, attempts).select("trace_id", "algo", "rank", "feedback", "reflection")


@trace_query("v9_feedback_match", SYM_SQL + "SELECT trace_id, rule_no, step % 2 = 0 OR fault IN ('step_repetition', 'premature_termination') AS matches FROM sy")
def v9(events, traces):
    s = c.symptoms(events)
    words = F.regexp_replace("fault", "_", " ")
    first, second = F.substring_index(words, " ", 1), F.substring_index(words, " ", -1)
    text = F.when(F.col("step") % 2 == 0, F.concat(F.lit("the "), words)).when(F.col("fault").isin("step_repetition", "premature_termination"), F.concat(second, F.lit(" of a "), first)).otherwise(F.lit("try again"))
    return s.select("trace_id", "rule_no", v.feedback_matches(text, F.col("fault"), words).alias("matches"))


@trace_query("v10_trial_failures", TRIAL_SYM_SQL + "SELECT trace_id, trial, step, agent, fault FROM tfl")
def v10(events, traces):
    return v.trial_failures(events)


@trace_query("e4_baseline_gate", SCORE_SQL + """, tp AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY confidence DESC, algo, rank) AS rn FROM hy WHERE algo = 'single_pass'), n AS (SELECT count(*) FILTER (tp.step = gt_step) AS s, count(*) FILTER (tp.agent = gt_agent) AS a, count(*) FILTER (code_hit) AS c, count(*) AS t FROM tr JOIN sco USING (trace_id) LEFT JOIN tp ON tp.trace_id = tr.trace_id AND rn = 1), er AS (SELECT count(*) AS x FROM ev WHERE k % 50 = 0)
SELECT 'rules' AS config, 'step_hits' AS metric, s AS value, t // 2 AS least, s >= t // 2 AS ok FROM n UNION ALL SELECT 'rules', 'agent_hits', a, t // 2, a >= t // 2 FROM n UNION ALL SELECT 'rules', 'code_hits', c, t // 2, c >= t // 2 FROM n UNION ALL SELECT 'rules', 'errors', x, 0, x = 0 FROM er UNION ALL SELECT 'extra', 'errors', 0, 0, true FROM er""")
def e4(events, traces):
    """One stack with a baseline and errors of every fiftieth kind, one that the baseline doesn't know."""
    rows = durable(e.compare_stacks({"rules": {"hyps": all_hypotheses(events, traces).where("algo = 'single_pass'"), **judged(events, traces)}}, traces).drop("errors"))  # a row for each stack, read three times
    half = F.floor(F.col("total") / 2)
    errors = events.where("k % 50 = 0").agg(F.count("*").alias("errors")).withColumn("config", F.lit("rules"))
    more = rows.select(F.lit("extra").alias("config"), *(c for c in rows.columns if c != "config"))
    rows = rows.join(errors, "config").unionByName(more.withColumn("errors", F.lit(0).cast("long")))
    return e.baseline_gate(rows, rows.where("config = 'rules'").select("config", *(half.alias(m) for m in ("step_hits", "agent_hits", "code_hits"))))


@trace_query("e10_scorecard", HYP_SQL + """, top AS (SELECT trace_id, algo, step, agent, code, row_number() OVER (PARTITION BY trace_id, algo ORDER BY confidence DESC, rank) AS rn FROM hy), g AS (SELECT top.*, gt_step, gt_agent, gt_code FROM top JOIN tr USING (trace_id) WHERE rn = 1 AND gt_step IS NOT NULL),
lb AS (SELECT trace_id, list(code ORDER BY rule_no) AS codes FROM sy GROUP BY ALL), lg AS (SELECT codes, gt_code FROM lb JOIN tr USING (trace_id) WHERE gt_step IS NOT NULL),
m AS (SELECT algo || ' step' AS metric, step = gt_step AS hit FROM g UNION ALL SELECT algo || ' agent', agent = gt_agent FROM g UNION ALL SELECT algo || ' code', code = gt_code FROM g WHERE code IS NOT NULL UNION ALL SELECT 'labels primary', codes[1] = gt_code FROM lg UNION ALL SELECT 'labels any', list_contains(codes, gt_code) FROM lg)
SELECT metric, count(*) FILTER (hit) AS hits, count(*) AS total FROM m GROUP BY metric""")
def e10(events, traces):
    labels = c.symptoms(events).groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_no", "code"))), lambda x: x["code"]).alias("codes"))
    return e.scorecard(all_hypotheses(events, traces), traces, labels=labels)


@trace_query("e13_error_tally", "xe AS (SELECT 'represent' AS stage, kind AS name, trace_id FROM ev WHERE k % 10 = 0) SELECT stage, name, count(*) AS n_errors, count(DISTINCT trace_id) AS n_traces FROM xe GROUP BY ALL")
def e13(events, traces):
    return e.error_tally(events.where("k % 10 = 0").select(F.lit("represent").alias("stage"), F.col("kind").alias("name"), "trace_id", F.lit("bad row").alias("error")))


@trace_query("io5_io6_batch_round_trip", "SELECT trace_id, idx, id, kind, agent, action, phase, content, query, doc_id, answer, to_agent, coalesce('e' || lpad(CAST(ref AS VARCHAR), 3, '0'), '') AS refs FROM ev", kept=True)
def io5(events, traces):
    spans, _ = im.from_batches(im.to_batches(events, traces, records_a_batch=5))
    return im.events_of_spans(spans).select("trace_id", "idx", "id", "kind", "agent", "action", "phase", "content", "query", "doc_id", "answer", "to_agent", F.array_join("refs", ",").alias("refs"))


@trace_query("io14_pull_window", "xt AS (SELECT trace_id, max(ts) AS timestamp FROM ev GROUP BY ALL) SELECT trace_id FROM tr JOIN xt USING (trace_id) WHERE model_version = 'm1' AND prompt_version = 'p0' AND timestamp >= 1000000")
def io14(events, traces):
    ts = events.groupBy("trace_id").agg(F.max("ts").alias("timestamp"))
    rows = traces.join(ts, "trace_id").select("trace_id", "timestamp", F.array("model_version", "prompt_version").alias("tags"))
    return f.pull_window(rows, ["m1", "p0"], 1_000_000.0).select("trace_id")
