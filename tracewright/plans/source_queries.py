"""Queries of sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.plans.attribute_queries import HYP_SQL, all_hypotheses
from tracewright.operators.payload import json_string
from tracewright.plans.registry import query, trace_query
from tracewright.sources import formats as f
from tracewright.sources import imports as im
from tracewright.sources.fixtures import table
from tracewright.tables import durable, shared_folder


@trace_query("io1_trace_lines_round_trip", "SELECT trace_id, idx, id, kind, agent, action, content, coalesce('e' || lpad(CAST(ref AS VARCHAR), 3, '0'), '') AS refs FROM ev")
def io1(events, traces):
    lines = f.trace_lines(events, traces).select(F.to_json(F.struct("trace_id", "task", "events", "outcome", "meta")).alias("line"))
    parsed = lines.select(F.from_json("line", f.TRACE_LINE).alias("t")).select("t.*")
    return f.flat_events(parsed).select("trace_id", "idx", "id", "kind", "agent", "action", "content", F.array_join("refs", ",").alias("refs"))


_EV = "SELECT trace_id, idx, id, kind, agent, action, content, coalesce('e' || lpad(CAST(ref AS VARCHAR), 3, '0'), '') AS refs FROM ev"


@trace_query("io2_trace_file_append", _EV)
def io2(events, traces):
    """Lines of failed traces are appended to a file of the others, and both are read from it."""
    path = shared_folder(events.sparkSession) + "/traces"
    for part in (traces.where("success"), traces.where("not success")):
        f.append_traces(f.trace_lines(events, part).select("trace_id", "task", "events", "outcome", "meta"), path)
    return f.flat_events(f.read_traces(events.sparkSession, path)).select("trace_id", "idx", "id", "kind", "agent", "action", "content", F.array_join("refs", ",").alias("refs"))


@trace_query("io3_artifact_sink", "SELECT trace_id, kind, count(*) AS n, 'r1' AS run_id FROM ev GROUP BY ALL UNION ALL SELECT trace_id, kind, count(*), 'r2' FROM ev WHERE k % 2 = 0 GROUP BY ALL")
def io3(events, traces):
    """The second run is written twice; the first stays as it is."""
    root, n = shared_folder(events.sparkSession), lambda e: e.groupBy("trace_id", "kind").agg(F.count("*").alias("n"))
    for rows, run in ((events, "r1"), (events.where("k % 3 = 0"), "r2"), (events.where("k % 2 = 0"), "r2")):
        path = f.write_artifact(n(rows), root, "represent", "kinds", run)
    return events.sparkSession.read.schema("trace_id string, kind string, n long, run_id string").parquet(path)


@trace_query("io1_bad_lines", """l AS (SELECT trace_id, CAST(regexp_extract(trace_id, '^u(\\d+)w', 1) AS INT) AS u FROM tr), n AS (SELECT *, u % 3 AS file, 2 * row_number() OVER (PARTITION BY u % 3 ORDER BY trace_id) AS line FROM l)
SELECT CAST(file AS VARCHAR) AS file, line, CASE u % 4 WHEN 1 THEN 'no json' WHEN 2 THEN '{"task":"' || trace_id || '"}' ELSE '{"trace_id":' END AS text FROM n WHERE u % 4 <> 0 UNION ALL SELECT 'good', count(*), CAST(count(DISTINCT trace_id) AS VARCHAR) FROM n WHERE u % 4 = 0""")
def io1_bad(events, traces):
    """Three files, a blank line before every trace; of four users' traces one can be read, the others are no JSON, have no trace_id, or break off. The last row counts those that can."""
    spark, folder = events.sparkSession, shared_folder(events.sparkSession)
    u = F.regexp_extract("trace_id", r"^u(\d+)w", 1).cast("int")
    said = F.when(u % 4 == 0, F.to_json(F.struct("trace_id", "task"))).when(u % 4 == 1, "no json").when(u % 4 == 2, F.concat(F.lit('{"task":"'), "trace_id", F.lit('"}'))).otherwise('{"trace_id":')
    rows = traces.select("trace_id", (u % 3).alias("file"), F.concat(F.lit("\n"), said).alias("value"))
    for k in range(3):
        rows.where(F.col("file") == k).orderBy("trace_id").coalesce(1).select("value").write.text(f"{folder}/{k}")
    good, faults = f.checked_traces(spark, f"{folder}/*")
    bad = faults.select(F.regexp_extract("file", r"/(\d)/[^/]*$", 1).alias("file"), "line", "text")
    return bad.unionByName(good.agg(F.lit("good").alias("file"), F.count("*").alias("line"), F.countDistinct("trace_id").cast("string").alias("text")))


@trace_query("io7_io8_otlp_round_trip", "SELECT trace_id, idx, id, ts, kind, agent, action, phase, content, query, doc_id, answer, to_agent, coalesce('e' || lpad(CAST(ref AS VARCHAR), 3, '0'), '') AS refs FROM ev", kept=True)
def io7(events, traces):
    return im.events_of_spans(im.from_otlp(im.to_otlp(events, traces, spans_a_document=5))[0]).select("trace_id", "idx", "id", "ts", "kind", "agent", "action", "phase", "content", "query", "doc_id", "answer", "to_agent", F.array_join("refs", ",").alias("refs"))


@trace_query("io8_otlp_ids", "SELECT substr(sha256(trace_id), 1, 32) AS trace_hash, substr(sha256(trace_id || ':' || id), 1, 16) AS span_hash FROM ev")
def io8(events, traces):
    spans = im.to_otlp(events).select(F.explode(F.from_json("document", im.OTLP)["resourceSpans"][0]["scopeSpans"][0]["spans"]).alias("s"))
    return spans.select(F.col("s.traceId").alias("trace_hash"), F.col("s.spanId").alias("span_hash"))


#: Names, metadata and levels of third-party observations, by rule from the number of an event.
NAMES = ("Handoff to B", "HAND_OVER", "handover now", "transfer", "delegated", "Escalate", "verify it", "Evaluator", "llm-judge", "guardrail", "critic", "assertion", "checker", "validator", "search", "step", None)
TYPES = ("GENERATION", "generation", "EVENT", "SPAN", None)
METADATA = ('{"agent":"a1","agent_name":"x"}', '{"agent_name":"a2","llm.app":"x"}', '{"gen_ai.agent.name":"a3"}', '{"llm.app":"a4"}', '{"agent":null,"name":"no","role":"no"}', None)
TOP = ('{"agent_name":"t1"}', '{"llm.app":"t2"}', "{}")
INPUTS = ('{"query":"q","content":"c0"}', '"plain"', '{"doc_id":"d1"}', "[1,2]", None)
OUTPUTS = ('"said"', '{"a":1}', "7", None)
LEVELS = ("ERROR", "error", "DEFAULT", None)


def pick(values, by) -> F.Column:
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (by % len(values) + 1).cast("int"))


def pick_sql(values, by: str) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"][({by}) % {len(values)} + 1]"


_KIND_SQL = "CASE WHEN regexp_matches(lower(coalesce(name, '')), 'handoff|hand_over|handover|transfer|delegate|escalate') THEN 'HANDOFF' WHEN regexp_matches(lower(coalesce(name, '')), 'verif|evaluat|judge|guardrail|critic|assert') THEN 'VERIFIER' WHEN upper(type) = 'GENERATION' THEN 'LLM_CALL' WHEN upper(type) = 'EVENT' THEN 'AGENT_MESSAGE' WHEN kids THEN 'AGENT_MESSAGE' ELSE 'TOOL_CALL' END"
_AGENT_SQL = "coalesce(" + ", ".join(f"""json_extract_string({c}, '$."{k}"')""" for c in ("metadata", "top") for k in ("agent", "agent_name", "gen_ai.agent.name", "llm.app")) + ", 'unknown')"


@trace_query("io10_kind_heuristic", f"n AS (SELECT trace_id, idx, {pick_sql(NAMES, 'idx * 7 + k')} AS name, {pick_sql(TYPES, 'idx + k')} AS type, EXISTS (SELECT 1 FROM ev c WHERE c.trace_id = e.trace_id AND c.ref = e.idx) AS kids FROM ev e) SELECT trace_id, idx, {_KIND_SQL} AS guessed FROM n")
def io10(events, traces):
    parents = events.select("trace_id", F.explode("refs").alias("id")).distinct().withColumn("_c", F.lit(True))
    e = events.join(parents, ["trace_id", "id"], "left")
    kind = f.kind_of_observation(pick(NAMES, F.col("idx") * 7 + F.col("k")), pick(TYPES, F.col("idx") + F.col("k")), F.coalesce("_c", F.lit(False)))
    return e.select("trace_id", "idx", kind.alias("guessed"))


@trace_query("io11_agent_chain", f"n AS (SELECT trace_id, idx, {pick_sql(METADATA, 'idx + k')} AS metadata, {pick_sql(TOP, 'k')} AS top FROM ev) SELECT trace_id, idx, {_AGENT_SQL} AS agent FROM n")
def io11(events, traces):
    return events.select("trace_id", "idx", f.agent_of(pick(METADATA, F.col("idx") + F.col("k")), pick(TOP, F.col("k"))).alias("agent"))


_MERGE_SQL = """
py0 AS (SELECT *, input LIKE '{%' AS obj, CASE WHEN output IS NULL THEN CASE WHEN input LIKE '{%' THEN json_extract_string(input, '$.content') END WHEN output LIKE '"%' THEN json_extract_string(output, '$') ELSE output END AS said FROM pin),
py AS (SELECT *, CASE WHEN upper(coalesce(level, '')) = 'ERROR' THEN 'error: ' || coalesce(said, '') ELSE said END AS content, CASE WHEN obj THEN json_extract_string(input, '$.query') END AS query, CASE WHEN obj THEN json_extract_string(input, '$.doc_id') END AS doc_id, CASE WHEN NOT obj THEN CASE WHEN input LIKE '"%' THEN json_extract_string(input, '$') ELSE input END END AS plain FROM py0)"""


@trace_query("io12_payload_merge", f"pin AS (SELECT trace_id, idx, {pick_sql(INPUTS, 'idx + k')} AS input, {pick_sql(OUTPUTS, 'k')} AS output, {pick_sql(LEVELS, 'idx')} AS level FROM ev)," + _MERGE_SQL + " SELECT trace_id, idx, content, query, doc_id, plain AS input FROM py")
def io12(events, traces):
    p = f.observation_payload(pick(INPUTS, F.col("idx") + F.col("k")), pick(OUTPUTS, F.col("k")), pick(LEVELS, F.col("idx")))
    return events.select("trace_id", "idx", p.alias("p")).select("trace_id", "idx", *(F.try_element_at("p", F.lit(c)).alias(c) for c in ("content", "query", "doc_id", "input")))


def observations_of(events):
    """Third-party and own observations: an event is a child of its reference; every third carries our own fields, every fifth has a parent that isn't there."""
    k, i = F.col("k"), F.col("idx")
    own = F.to_json(F.struct(F.struct("id", "kind", "agent", "action", "phase", "refs", "ts").alias("own")))
    parent = F.when(k % 5 == 0, "gone").otherwise(F.concat(F.lit("o"), F.get("refs", F.lit(0))))
    start = F.when(k % 11 == 0, F.lit(None)).when(k % 2 == 0, F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(F.timestamp_seconds(F.col("ts") + 7200), "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
    return events.select("trace_id", F.concat(F.lit("o"), "id").alias("id"), pick(NAMES, i * 7 + k).alias("name"), pick(TYPES, i + k).alias("type"), parent.alias("parent_id"), start.alias("start_time"), pick(INPUTS, i + k).alias("input"), pick(OUTPUTS, k).alias("output"), pick(LEVELS, i).alias("level"), F.when(k % 3 == 0, own).otherwise(pick(METADATA, i + k)).alias("metadata"), pick(TOP, k).alias("top"))


OBS_SQL = f"""
ob0 AS (SELECT trace_id, 'o' || id AS id, {pick_sql(NAMES, 'idx * 7 + k')} AS name, {pick_sql(TYPES, 'idx + k')} AS type, CASE WHEN k % 5 <> 0 AND ref IS NOT NULL THEN 'oe' || lpad(CAST(ref AS VARCHAR), 3, '0') END AS parent_id, CASE WHEN k % 11 <> 0 THEN ts END AS at_, ts, k % 3 = 0 AS mine, kind AS own_kind, agent AS own_agent, action AS own_action, phase AS own_phase, id AS own_id, CASE WHEN ref IS NOT NULL THEN 'e' || lpad(CAST(ref AS VARCHAR), 3, '0') END AS own_ref,
  {pick_sql(INPUTS, 'idx + k')} AS input, {pick_sql(OUTPUTS, 'k')} AS output, {pick_sql(LEVELS, 'idx')} AS level, {pick_sql(METADATA, 'idx + k')} AS metadata, {pick_sql(TOP, 'k')} AS top FROM ev),
ob1 AS (SELECT *, EXISTS (SELECT 1 FROM ob0 c WHERE c.trace_id = o.trace_id AND c.parent_id = o.id) AS kids, row_number() OVER (PARTITION BY trace_id, parent_id ORDER BY coalesce(at_, 0), id) - 1 AS ordinal FROM ob0 o),
pin AS (SELECT * FROM ob1),""" + _MERGE_SQL + f""",
osp AS (SELECT trace_id, id AS span_id, parent_id AS parent_span_id, CAST(ordinal AS INT) AS ordinal, CASE WHEN mine THEN own_kind ELSE {_KIND_SQL} END AS kind, CASE WHEN mine THEN own_agent ELSE {_AGENT_SQL} END AS agent, CASE WHEN mine THEN own_action ELSE name END AS action, CASE WHEN mine THEN own_phase END AS phase,
  CASE WHEN mine AND own_ref IS NOT NULL THEN CASE WHEN EXISTS (SELECT 1 FROM ob1 r WHERE r.trace_id = py.trace_id AND r.mine AND r.own_id = py.own_ref) THEN 'o' || own_ref ELSE own_ref END ELSE '' END AS refs, CASE WHEN mine THEN ts ELSE at_ END AS ts, content FROM py)"""


@trace_query("io9_observation_spans", OBS_SQL + " SELECT * FROM osp")
def io9(events, traces):
    s = f.observation_spans(observations_of(events))
    return s.select("trace_id", "span_id", "parent_span_id", "ordinal", "kind", "agent", "action", "phase", F.array_join("refs", ",").alias("refs"), "ts", F.try_element_at("payload", F.lit("content")).alias("content"))


@trace_query("io16_export_guard", "m AS (SELECT trace_id, idx, ['injected_fault', 'origin_fault', 'fault_removed', 'qrels', 'gt_step', 'gt_agent', 'gt_code', 'gt_kind', 'evidence', 'gold', 'task_id', 'model_version'][(idx + k) % 12 + 1] AS a, ['task_id', 'qrels', 'note'][k % 3 + 1] AS b, k % 2 = 0 AS outside FROM ev), u AS (SELECT trace_id, idx, outside, unnest(list_distinct([a, b])) AS key FROM m) SELECT trace_id, idx, outside, coalesce(string_agg(key, ',' ORDER BY key) FILTER (key NOT IN ('injected_fault', 'origin_fault', 'fault_removed', 'gt_step', 'gt_agent', 'gt_code', 'gt_kind') AND NOT (outside AND key IN ('qrels', 'evidence', 'gold'))), '') AS keys FROM u GROUP BY ALL")
def io16(events, traces):
    """Maps of two keys, so that every key meets both ways of export."""
    a = pick(("injected_fault", "origin_fault", "fault_removed", "qrels", "gt_step", "gt_agent", "gt_code", "gt_kind", "evidence", "gold", "task_id", "model_version"), F.col("idx") + F.col("k"))
    keys = F.array_distinct(F.array(a, pick(("task_id", "qrels", "note"), F.col("k"))))
    meta = F.map_from_entries(F.transform(keys, lambda x: F.struct(x, F.lit("v"))))
    outside = F.col("k") % 2 == 0
    kept = F.when(outside, F.map_keys(f.guard_export(meta, external=True))).otherwise(F.map_keys(f.guard_export(meta)))
    return events.select("trace_id", "idx", outside.alias("outside"), F.array_join(F.array_sort(kept), ",").alias("keys"))


@trace_query("io19_source_spans", "SELECT trace_id, idx AS step, 's' || idx AS span_id FROM ev WHERE k % 4 <> 0")
def io19(events, traces):
    span = F.when(F.col("k") % 4 == 0, "").otherwise(F.concat(F.lit("s"), F.col("idx").cast("string")))
    artifact = events.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", span.alias("s")))), lambda x: x["s"]).alias("source_span_ids"))
    return f.source_spans(events, artifact)


@trace_query("io20_accept_proposal", "p AS (SELECT 'NM-' || row_number() OVER (ORDER BY agent) AS mode_id, agent FROM (SELECT DISTINCT agent FROM ev)) SELECT mode_id AS code, agent AS name, 'seen by ' || agent AS definition, CASE WHEN mode_id = 'NM-2' THEN 'FM-1.1' END AS kinship FROM p WHERE mode_id IN ('NM-1', 'NM-2')")
def io20(events, traces):
    """Of the proposals by agent the first is accepted already; it is accepted again, then the second."""
    names = events.select("agent").distinct()
    before = names.alias("a").join(names.alias("b"), F.col("a.agent") >= F.col("b.agent")).groupBy(F.col("a.agent").alias("agent")).agg(F.count("*").alias("n"))  # a handful of agents
    p = before.select(F.concat(F.lit("NM-"), F.col("n").cast("string")).alias("mode_id"), F.col("agent").alias("name"), F.concat(F.lit("seen by "), "agent").alias("definition"), F.lit("FM-1.1").alias("kinship"))
    accepted = p.where("mode_id = 'NM-1'").select(F.col("mode_id").alias("code"), "name", "definition", F.lit(None).cast("string").alias("kinship"))
    return f.accept_proposal(p, f.accept_proposal(p, accepted, "NM-1"), "NM-2")


@trace_query("io21_flatten_missing", "n AS (SELECT *, CAST(regexp_extract(trace_id, '^u(\\d+)w', 1) AS INT) % 3 = 0 AS lost, CASE WHEN kind = 'TOOL_RESULT' THEN ref END AS up FROM ev), q AS (SELECT *, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY coalesce(up, idx), idx) - 1 AS INT) AS place FROM n) SELECT q.trace_id, CASE WHEN q.lost THEN q.place ELSE q.idx END AS idx, CASE WHEN q.lost THEN 'e' || lpad(CAST(q.place AS VARCHAR), 3, '0') ELSE q.id END AS id, q.kind, q.agent, q.action, CASE WHEN q.lost THEN 'e' || lpad(CAST(p.place AS VARCHAR), 3, '0') END AS parent FROM q LEFT JOIN q p ON p.trace_id = q.trace_id AND p.idx = q.up".replace("\\\\", "\\"))
def io21(events, traces):
    """Traces of every third user have spans only; a result is a child of its call."""
    lost = F.regexp_extract("trace_id", r"^u(\d+)w", 1).cast("int") % 3 == 0
    parent = F.when(F.col("kind") == "TOOL_RESULT", F.concat(F.lit("s"), F.get("refs", F.lit(0))))
    spans = events.where(lost).select("trace_id", F.concat(F.lit("s"), "id").alias("span_id"), parent.alias("parent_span_id"), F.col("idx").alias("ordinal"), "kind", "agent", "action")
    return f.flatten_missing(events.where(~lost), spans)


@trace_query("io4_run_report", """r AS (SELECT CAST(time_window = 'w9' AS INT) AS round, count(*) AS n_traces, count(*) FILTER (NOT success) AS n_failures, count(gt_step) AS n_attributed FROM tr GROUP BY ALL)
SELECT CAST(sum(n_traces) AS BIGINT) AS n_traces, CAST(sum(n_failures) AS BIGINT) AS n_failures, CAST(sum(n_attributed) AS BIGINT) AS n_attributed, string_agg(n_traces, ',' ORDER BY round) AS n_traces_by_round, string_agg(n_failures, ',' ORDER BY round) AS n_failures_by_round FROM r""")
def io4(events, traces):
    """The last window stands for the verification round."""
    n = lambda c: F.sum(c.cast("long"))
    rounds = traces.groupBy((F.col("time_window") == "w9").cast("int").alias("round")).agg(F.count("*").alias("n_traces"), n(~F.col("success")).alias("n_failures"), F.count("gt_step").alias("n_attributed"), *(F.lit(0).cast("long").alias(c) for c in ("n_reruns", "n_rerun_success", "n_errors")))
    r = f.run_report(rounds)
    return r.select("n_traces", "n_failures", "n_attributed", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("n_traces_by_round", "n_failures_by_round")))


@trace_query("io13_outcome_from_scores", "SELECT trace_id, coalesce(max_by(k >= 50, idx), false) AS success FROM ev GROUP BY trace_id")
def io13(events, traces):
    scores = events.select("trace_id", F.lit("quality").alias("name"), F.col("k").cast("string").alias("value"), F.col("idx").alias("timestamp"))
    return f.outcome_from_scores(traces, scores, "quality", ">=", "50")


#: Speakers of a benchmark's messages, by rule: people, terminals, routing in brackets and outside of them, experts, nobody.
SPEAKERS = ("human", "User", "Computer_terminal", "Orchestrator (-> WebSurfer)", "Orchestrator -> Coder", "Excel_Expert", "(thought)", "", None)
WHO = pick_sql(SPEAKERS, "turn + conv_id")
IO15_SQL = f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, {WHO} AS who FROM conversations),
g AS (SELECT conv_id, max(idx) AS last FROM m GROUP BY conv_id),
s AS (SELECT 'ag-' || m.conv_id AS trace_id, CAST(idx AS INT) AS idx, 'name' AS split, coalesce(nullif(who, ''), nullif(role, ''), 'unknown') AS raw, text, last, m.conv_id FROM m JOIN g ON m.conv_id = g.conv_id WHERE m.conv_id % 5 <> 3
  UNION ALL SELECT 'hc-' || m.conv_id, CAST(idx AS INT), 'role', coalesce(nullif(role, ''), nullif(who, ''), 'unknown'), text, last, m.conv_id FROM (SELECT conv_id, turn, idx, text, role AS who, who AS role FROM m) m JOIN g ON m.conv_id = g.conv_id WHERE m.conv_id % 5 <> 3),
a AS (SELECT *, CASE WHEN split = 'role' THEN coalesce(nullif(trim(regexp_replace(raw, '\\s*\\([^()]*\\)\\s*$', '')), ''), raw) ELSE raw END AS agent FROM s)
SELECT trace_id, idx, agent, CASE WHEN regexp_matches(lower(agent), 'terminal|computer') THEN 'TOOL_RESULT' WHEN contains(agent, '->') THEN 'HANDOFF' WHEN lower(agent) IN ('human', 'user') THEN CASE WHEN idx = 0 THEN 'TASK_START' ELSE 'AGENT_MESSAGE' END ELSE 'LLM_CALL' END AS kind, coalesce(text, '') AS content, CAST(last // 2 AS INT) AS gt_step, 'Orchestrator' AS gt_agent, conv_id % 2 = 0 AS success FROM a"""


@query("io15_message_histories", IO15_SQL)
def io15(spark, sf_dir):
    """Conversations as records of both splits; every fifth has no gold and is left out."""
    c = table(spark, sf_dir, "conversations")
    who = pick(SPEAKERS, F.col("turn") + F.col("conv_id"))
    out = None
    for split, (name, role) in {"Algorithm-Generated": (who, F.col("role")), "Hand-Crafted": (F.col("role"), who)}.items():
        m = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.struct(name.alias("name"), role.alias("role"), F.col("text").alias("content")).alias("m")))), lambda x: x["m"]).alias("history"))
        step = F.when(F.col("conv_id") % 5 != 3, F.floor((F.size("history") - 1) / 2))
        record = F.to_json(F.struct(F.lit("q").alias("question"), "history", step.alias("mistake_step"), F.lit("Orchestrator").alias("mistake_agent"), (F.col("conv_id") % 2 == 0).alias("is_correct")))
        events, traces = im.messages_of_records(m.select(F.col("conv_id").alias("record_id"), record.alias("record")), split)
        rows = events.join(traces.select("trace_id", "gt_step", "gt_agent", "success"), "trace_id").select("trace_id", "idx", "agent", "kind", "content", "gt_step", "gt_agent", "success")
        out = rows if out is None else out.unionByName(rows)
    return out


#: Foreign spans: a heap-shaped tree in a document order that is no time order, with parents that aren't there, own attributes on every third span, tool-call aliases, references of all sorts, and payloads with unknown keys or none.
FOREIGN_SQL = """
fo AS (SELECT *, (idx * 7 + 3) % 10 AS place, CASE WHEN idx > 0 AND idx % 7 <> 5 THEN (idx - 1) // 2 END AS up FROM ev),
fn AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY place, idx) - 1 AS ordinal FROM fo),
ft AS (WITH RECURSIVE w AS (
    SELECT trace_id, idx, [ordinal] AS path, CAST(NULL AS BIGINT) AS up FROM fn WHERE up IS NULL
    UNION ALL SELECT fn.trace_id, fn.idx, list_append(w.path, fn.ordinal), fn.up FROM fn JOIN w ON w.trace_id = fn.trace_id AND w.idx = fn.up)
  SELECT * FROM w),
fx AS (SELECT *, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY path) - 1 AS INT) AS n FROM ft),
"""
FOREIGN_OUT = """
SELECT ev.trace_id, fx.n AS idx, 's' || fx.idx AS source_span_id, 'e' || lpad(CAST(p.n AS VARCHAR), 3, '0') AS parent, {kind} AS kind, {agent} AS agent, {payload} AS payload, coalesce((SELECT string_agg('e' || lpad(CAST(r.n AS VARCHAR), 3, '0'), ',' ORDER BY u.o) FROM (VALUES {refs}) u(o, i) JOIN fx r ON r.trace_id = ev.trace_id AND r.idx = u.i), '') AS refs
FROM ev JOIN fx USING (trace_id, idx) LEFT JOIN fx p ON p.trace_id = fx.trace_id AND p.idx = fx.up
"""


def foreign(events):
    """place, parent and payload of foreign spans."""
    i = F.col("idx")
    up = F.when((i > 0) & (i % 7 != 5), F.floor((i - 1) / 2).cast("int"))
    payload = F.when(i % 5 == 0, "{}").when(i % 5 == 1, F.lit(None)).when(i % 5 == 2, "plain text").otherwise(F.concat(F.lit('{"content":"c'), i.cast("string"), F.lit('","seen":['), i.cast("string"), F.lit(",2.5]}")))
    return events.withColumns({"place": (i * 7 + 3) % 10, "up": F.when(i % 7 == 5, "gone").otherwise(F.concat(F.lit("s"), up.cast("string"))), "sent": payload})


def _payload_sql(name: str) -> str:
    return f"""CASE ev.idx % 5 WHEN 0 THEN '{{}}' WHEN 2 THEN '{{"{name}":"plain text"}}' WHEN 1 THEN NULL ELSE '{{"content":"c' || ev.idx || '","seen":[' || ev.idx || ',2.5]}}' END"""


IO7_SQL = FOREIGN_SQL + "fy AS (SELECT 1)" + FOREIGN_OUT.format(
    kind="CASE WHEN ev.idx % 3 = 0 THEN CASE WHEN kind IN ('LLM_CALL','TOOL_CALL','TOOL_RESULT','AGENT_MESSAGE','HANDOFF','VERIFIER') THEN kind END WHEN kind = 'LLM_CALL' THEN 'LLM_CALL' WHEN kind = 'TOOL_CALL' THEN 'TOOL_CALL' ELSE 'AGENT_MESSAGE' END", agent="CASE WHEN ev.idx % 3 = 0 THEN agent ELSE 'unknown' END", payload=_payload_sql("raw"),
    refs="(0, CASE WHEN ev.idx > 0 THEN ev.idx - 1 END), (1, CASE WHEN EXISTS (SELECT 1 FROM ev t WHERE t.trace_id = ev.trace_id AND t.idx = 0 AND t.kind = 'TOOL_CALL') THEN 0 END)",
)


@trace_query("io7_foreign_spans", IO7_SQL)
def io7_foreign(events, traces):
    """A span refers to the one before (by its event id on every third, else by span id), to the call id of the first, and to nothing that is there."""
    e = foreign(events)
    i, own = F.col("idx"), F.col("idx") % 3 == 0
    span_id = lambda n: F.concat(F.lit("s"), n.cast("string"))
    op = F.when(F.col("kind") == "LLM_CALL", "chat").when((F.col("kind") == "TOOL_CALL") & (i % 2 == 0), "retrieval").when(F.col("kind") == "TOOL_CALL", "execute_tool").when(F.col("kind") == "HANDOFF", "invoke_agent").when(F.col("kind") == "VERIFIER", "other")
    before = F.when((i - 1) % 3 == 0, F.concat(F.lit("ev-"), (i - 1).cast("string"))).otherwise(span_id(i - 1))
    refs = F.to_json(F.array(before, F.lit("call-0"), F.lit("nowhere")))
    call = F.when(F.col("kind") == "TOOL_CALL", F.concat(F.lit("call-"), i.cast("string")))
    pairs = {"gen_ai.operation.name": op, "gen_ai.tool.call.id": call, "trace.kind": F.when(own, F.col("kind")), "trace.agent": F.when(own, F.col("agent")), "trace.event_id": F.when(own, F.concat(F.lit("ev-"), i.cast("string"))), "trace.payload": F.col("sent"), "trace.refs": refs, "trace.id": F.when(i == 0, F.col("trace_id"))}
    span = F.struct(F.md5("trace_id").alias("traceId"), span_id(i).alias("spanId"), F.col("up").alias("parentSpanId"), F.lit("n").alias("name"), F.lit(1).alias("kind"), F.lit("5").alias("startTimeUnixNano"), im._attributes(pairs).alias("attributes"))
    spans = e.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "idx", span.alias("s")))), lambda x: x["s"]).alias("spans"))
    documents = spans.select(F.to_json(F.struct(F.array(F.struct(F.array(F.struct("spans")).alias("scopeSpans"))).alias("resourceSpans"))).alias("document"))
    return im.events_of_spans(im.from_otlp(documents)[0]).select("trace_id", "idx", "source_span_id", "parent", "kind", "agent", F.to_json("payload").alias("payload"), F.array_join("refs", ",").alias("refs"))


IO5_SQL = FOREIGN_SQL + "fy AS (SELECT 1)" + FOREIGN_OUT.format(
    kind="CASE WHEN ev.idx % 3 = 0 THEN kind WHEN kind = 'LLM_CALL' THEN 'LLM_CALL' ELSE 'AGENT_MESSAGE' END", agent="CASE WHEN ev.idx % 3 = 0 THEN agent ELSE 'unknown' END", payload=_payload_sql("input"), refs="(0, CASE WHEN ev.idx % 3 = 0 THEN 0 END), (1, CASE WHEN ev.idx % 3 = 0 AND ev.idx > 2 THEN ev.idx - 3 END)",
) + " WHERE CAST(regexp_extract(ev.trace_id, '^u(\\d+)w', 1) AS INT) % 4 <> 3"


@trace_query("io5_foreign_batches", IO5_SQL)
def io5_foreign(events, traces):
    """Records of all types, old ones among them; users with 3 modulo 4 have observations without a trace record, which don't count."""
    e = foreign(events)
    i, own = F.col("idx"), F.col("idx") % 3 == 0
    ev = lambda n: F.concat(F.lit("ev-"), n.cast("string"))
    old, llm = i % 4 == 1, F.col("kind") == "LLM_CALL"
    kind = F.when(old, "observation-create").when(llm, "generation-create").when(F.col("kind") == "HANDOFF", "event-create").otherwise("span-create")
    metadata = F.when(own, F.struct(F.struct(ev(i).alias("id"), "kind", "agent", F.array(F.lit("ev-0"), ev(i - 3), F.lit("ev-none")).alias("refs")).alias("own")))
    sent = F.coalesce(F.try_parse_json("sent"), F.try_parse_json(json_string(F.col("sent"))))
    record = F.to_json(F.struct(kind.alias("type"), F.struct(F.concat(F.lit("s"), i.cast("string")).alias("id"), F.col("trace_id").alias("traceId"), F.col("up").alias("parentObservationId"), sent.alias("input"), F.when(old, F.when(llm, "GENERATION").otherwise("SPAN")).alias("type"), metadata.alias("metadata")).alias("body")))
    each = e.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "idx", record.alias("r")))), lambda x: x["r"]).alias("r"))
    head = F.when(F.regexp_extract("trace_id", r"^u(\d+)w", 1).cast("int") % 4 != 3, F.to_json(F.struct(F.lit("trace-create").alias("type"), F.struct(F.col("trace_id").alias("id")).alias("body"))))
    noise = F.lit('{"type":"score-create","body":{"id":"x"}}')
    batch = each.select(F.concat(F.lit('{"batch":['), F.array_join(F.concat("r", F.array(noise), F.filter(F.array(head), lambda x: x.isNotNull())), ","), F.lit("]}")).alias("batch"))
    return im.events_of_spans(im.from_batches(batch)[0]).select("trace_id", "idx", "source_span_id", "parent", "kind", "agent", F.to_json("payload").alias("payload"), F.array_join("refs", ",").alias("refs"))


PAY_SQL = HYP_SQL + """,
hs AS (SELECT trace_id, agent, step, code, confidence, 's' || step AS span_id FROM hy), o1_ AS (SELECT *, row_number() OVER (PARTITION BY trace_id, span_id ORDER BY confidence DESC, step, agent) AS n, row_number() OVER (PARTITION BY trace_id ORDER BY confidence DESC, step, agent) AS b FROM hs),
pay AS (SELECT trace_id, span_id AS observation_id, 'blamed-step' AS name, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY confidence DESC, step, agent) AS INT) AS emit_order FROM o1_ WHERE n = 1 UNION ALL SELECT trace_id, NULL, 'confidence', 1000000 FROM o1_ WHERE b = 1 UNION ALL SELECT trace_id, NULL, 'root-cause', 1000001 FROM o1_ WHERE b = 1)"""


def payloads(events, traces):
    spans = events.select("trace_id", F.col("idx").alias("step"), F.concat(F.lit("s"), F.col("idx").cast("string")).alias("span_id"))
    return f.score_payloads(all_hypotheses(events, traces).drop("algo", "rank"), spans)


@trace_query("io17_score_payloads", PAY_SQL + " SELECT * FROM pay", kept=True)
def io17(events, traces):
    return payloads(events, traces).select("trace_id", "observation_id", "name", "emit_order")


@trace_query("io18_incremental_skip", PAY_SQL + ", d AS (SELECT trace_id, CASE WHEN time_window IN ('w1', 'w2') THEN 'skipped' WHEN trace_id NOT IN (SELECT trace_id FROM pay) THEN 'no-hypotheses' ELSE 'written' END AS decision FROM tr) SELECT decision, count(*) AS n FROM d GROUP BY decision", kept=True)
def io18(events, traces):
    old = traces.where("time_window in ('w1', 'w2')").select("trace_id", F.lit("root-cause").alias("name"))
    return f.skip_scored(traces, payloads(events, traces), old).groupBy("decision").agg(F.count("*").alias("n"))


@trace_query("io17_score_details", PAY_SQL + """, o2_ AS (SELECT hy.*, 's' || step AS span_id, 'cause ' || step AS why, row_number() OVER (PARTITION BY trace_id, step ORDER BY confidence DESC, agent) AS n, row_number() OVER (PARTITION BY trace_id ORDER BY confidence DESC, step, agent) AS b FROM hy)
SELECT trace_id, span_id AS observation_id, 'blamed-step' AS name, coalesce(code, 'blamed') AS value, 'CATEGORICAL' AS data_type, substr(agent || ' @ step ' || step || ': ' || why, 1, 25) AS comment, agent AS by_agent, CAST(step AS VARCHAR) AS at_step, 'r7' AS run FROM o2_ WHERE n = 1
UNION ALL SELECT trace_id, NULL, 'confidence', CAST(round(confidence, 4) AS VARCHAR), 'NUMERIC', substr('confidence of the top hypothesis (by rules, run r7)', 1, 25), agent, CAST(step AS VARCHAR), 'r7' FROM o2_ WHERE b = 1
UNION ALL SELECT trace_id, NULL, 'root-cause', coalesce(code, 'unlabeled'), 'CATEGORICAL', substr(agent || ' @ step ' || step || ': ' || why || ' (run r7)', 1, 25), agent, CAST(step AS VARCHAR), 'r7' FROM o2_ WHERE b = 1""")
def io17_details(events, traces):
    spans = events.select("trace_id", F.col("idx").alias("step"), F.concat(F.lit("s"), F.col("idx").cast("string")).alias("span_id"))
    h = all_hypotheses(events, traces).drop("rank").withColumns({"algo": F.lit("rules"), "root_cause": F.concat(F.lit("cause "), F.col("step").cast("string"))})
    m = lambda k: F.try_element_at("metadata", F.lit(k))
    return f.score_payloads(h, spans, run_id="r7", longest=25).select("trace_id", "observation_id", "name", "value", "data_type", "comment", m("agent").alias("by_agent"), m("step").alias("at_step"), m("run_id").alias("run"))


@trace_query("io18_dry_run_tally", PAY_SQL + """, d AS (SELECT trace_id, CASE WHEN time_window IN ('w1', 'w2') THEN 'skipped' WHEN trace_id NOT IN (SELECT trace_id FROM pay) THEN 'no-hypotheses' ELSE 'dry-run' END AS decision FROM tr)
SELECT CAST(0 AS BIGINT) AS written, count(*) FILTER (decision = 'dry-run') AS dry_run, count(*) FILTER (decision = 'skipped') AS skipped, count(*) FILTER (decision = 'no-hypotheses') AS no_hypotheses, (SELECT count(*) FROM pay JOIN d USING (trace_id) WHERE decision = 'dry-run') AS n_scores FROM d""")
def io18_tally(events, traces):
    p = durable(payloads(events, traces))  # read twice
    old = traces.where("time_window in ('w1', 'w2')").select("trace_id", F.lit("root-cause").alias("name"))
    return f.score_tally(f.skip_scored(traces, p, old, dry_run=True), p)
