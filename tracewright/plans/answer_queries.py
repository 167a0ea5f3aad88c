"""Queries of noisy answers, and the noise in which other queries give theirs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.model import MODES
from tracewright.operators import answers as a
from tracewright.operators import attribute as t
from tracewright.operators import classify as c
from tracewright.operators import represent as r
from tracewright.operators.payload import payload_json, with_fields
from tracewright.plans.analyze_queries import SYM_SQL
from tracewright.plans.attribute_queries import AUDIT_SQL, judged_records, stage_world, supported
from tracewright.plans.classify_queries import sample_labels
from tracewright.plans.registry import trace_query
from tracewright.plans.noise import dressed

THOUGHT = "Let me think... the schema needs {\"score\"} maybe { 'x': 1 }.\nAfter analysis: "
FENCE = a.FENCE

#: Scans as windows: depth is the running sum of braces, lifted by its own least value below zero; a block opens where it leaves zero.
F12_SQL = rf"""
an0 AS (SELECT trace_id, idx, k % 13 AS s, (idx + k) % 10 AS shape, coalesce(content, '') || ' }} {{ "q" \' AS said FROM ev),
an1 AS (SELECT *, to_json({{'score': s, 'summary': said}})::VARCHAR AS body FROM an0),
an AS (SELECT trace_id, idx, CASE shape WHEN 0 THEN body WHEN 1 THEN '{THOUGHT.replace("'", "''")}' || body WHEN 2 THEN 'was {{"score": 99}}' || chr(10) || '```json' || chr(10) || body || chr(10) || '```' WHEN 3 THEN '{{''score'': ' || s || ', ''summary'': None}}'
    WHEN 4 THEN 'no object at all' WHEN 5 THEN '{{"score": 3, "summary": "never closed' WHEN 6 THEN '{{"score": -1, "summary": "first"}} or ' || body WHEN 7 THEN '}} stray ' || body || ' {{ open' WHEN 9 THEN body || '```' || body || '```' END AS answer FROM an1),
fp AS (SELECT trace_id, idx, unnest(string_split(answer, '```')) AS part, unnest(generate_series(0, len(string_split(answer, '```')) - 1)) AS p FROM an),
sc AS (SELECT trace_id, idx, p AS src, CASE WHEN starts_with(ltrim(part, chr(10) || ' '), 'json') THEN substr(ltrim(part, chr(10) || ' '), 5) ELSE part END AS txt FROM fp WHERE p % 2 = 1 UNION ALL SELECT trace_id, idx, 1000000, answer FROM an WHERE answer IS NOT NULL),
tk0 AS (SELECT trace_id, idx, src, regexp_extract_all(txt, '(?s)"(?:[^"\\]|\\.)*"?|[{{}}]|[^"{{}}]+') AS ts FROM sc),
tk AS (SELECT trace_id, idx, src, unnest(ts) AS tok, unnest(generate_series(1, len(ts))) AS pos FROM tk0),
dp0 AS (SELECT *, sum(CASE tok WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY trace_id, idx, src ORDER BY pos) AS s FROM tk),
dp1 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY trace_id, idx, src ORDER BY pos)) AS d FROM dp0),
dp AS (SELECT *, coalesce(lag(d) OVER (PARTITION BY trace_id, idx, src ORDER BY pos), 0) AS d0 FROM dp1),
bk0 AS (SELECT *, count(*) FILTER (d = 1 AND d0 = 0) OVER (PARTITION BY trace_id, idx, src ORDER BY pos) AS b FROM dp),
bk AS (SELECT trace_id, idx, src, b, string_agg(tok, '' ORDER BY pos) AS block FROM bk0 WHERE d > 0 OR d0 > 0 GROUP BY trace_id, idx, src, b HAVING bool_or(d = 0)),
bu AS (SELECT trace_id, idx, block, min((src, b)) AS o FROM bk GROUP BY trace_id, idx, block),
bj AS (SELECT trace_id, idx, o, CASE WHEN json_valid(block) THEN block WHEN json_valid(replace(replace(block, '''', '"'), 'None', 'null')) THEN replace(replace(block, '''', '"'), 'None', 'null') END AS j FROM bu),
bv AS (SELECT *, CAST(json_extract_string(j, '$.score') AS DOUBLE) AS score, json_extract_string(j, '$.summary') AS summary FROM bj WHERE j IS NOT NULL AND json_type(j) = 'OBJECT'),
bf AS (SELECT trace_id, idx, count(*) AS n_objects, min_by({{'s': score, 'm': summary}}, o) FILTER (score BETWEEN 0 AND 10) AS best FROM bv GROUP BY trace_id, idx)
SELECT an.trace_id, an.idx, coalesce(n_objects, 0) AS n_objects, best.s AS score, best.m AS summary,
  CASE WHEN coalesce(n_objects, 0) = 0 THEN CASE WHEN contains(answer, '{{') THEN 'unclosed' ELSE 'no object' END WHEN best IS NULL THEN 'score' END AS fault
FROM an LEFT JOIN bf USING (trace_id, idx)
"""


def noisy_answers(events):
    """Answers of every shape, by rule: bare, after thoughts with braces, fenced, in single quotes, without or with unclosed objects, after an invalid one, among stray braces, missing, repeated."""
    s, said = F.col("k") % 13, F.concat(F.coalesce("content", F.lit("")), F.lit(' } { "q" \\'))
    body, text = F.to_json(F.struct(s.alias("score"), said.alias("summary"))), F.lit
    shapes = [
        body, F.concat(text(THOUGHT), body), F.concat(text(f'was {{"score": 99}}\n{FENCE}json\n'), body, text(f"\n{FENCE}")), F.concat(text("{'score': "), s.cast("string"), text(", 'summary': None}")), text("no object at all"),
        text('{"score": 3, "summary": "never closed'), F.concat(text('{"score": -1, "summary": "first"} or '), body), F.concat(text("} stray "), body, text(" { open")), text(None).cast("string"), F.concat(body, text(FENCE), body, text(FENCE)),
    ]
    return events.select("trace_id", "idx", F.element_at(F.array(*shapes), ((F.col("idx") + F.col("k")) % 10 + 1).cast("int")).alias("answer"))


@trace_query("f12_noisy_answers", F12_SQL)
def f12(events, traces):
    fits = lambda v: v["score"].between(0, 10)
    n = noisy_answers(events).select("trace_id", "idx", "answer", F.size(a.json_objects(F.col("answer"))).cast("long").alias("n_objects"), a.first_valid(F.col("answer"), "score double, summary string", fits).alias("v"))
    good = F.coalesce(fits(F.col("v")), F.lit(False))
    return n.select("trace_id", "idx", "n_objects", F.when(good, F.col("v.score")).alias("score"), F.when(good, F.col("v.summary")).alias("summary"), F.coalesce(a.unparsed(F.col("answer")), F.when(~good, "score")).alias("fault"))


LABEL_SQL = SYM_SQL + ", lb AS (SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY rule_no) - 1 AS INT) AS pos, CASE WHEN step % 7 = 3 THEN 'FM-9.9' WHEN step % 5 = 4 THEN 'novel' ELSE code END AS code, CASE WHEN step % 2 = 0 THEN fault END AS symptom, step FROM sy) "


@trace_query("c8_labels_of_answers", LABEL_SQL + "SELECT * FROM lb")
def c8_answers(events, traces):
    said = sample_labels(events).select("trace_id", F.to_json(F.struct("labels")).alias("j"))
    found = c.labels_of_answers(said.select("trace_id", dressed(F.col("j"), F.col("trace_id")).alias("response")))
    return found.select("trace_id", F.posexplode("labels").alias("pos", "l")).select("trace_id", "pos", "l.*")


@trace_query("t14_records_of_answers", AUDIT_SQL + "SELECT ar.trace_id, CASE WHEN introduced % 9 = 4 THEN 'c99' ELSE claim_id END AS claim_id, CASE WHEN introduced % 7 = 3 THEN 'STRONG' ELSE support_status END AS support_status, verdict, CASE WHEN introduced % 5 = 2 THEN sup.responsible_step + 500 ELSE sup.responsible_step END AS responsible_step FROM ar JOIN sup USING (trace_id, claim_id, introduced, support_status, verdict)")
def t14_answers(events, traces):
    records = judged_records(supported(events, traces)[1])
    one = F.struct("claim_id", "support_status", "verdict", "responsible_step")
    said = records.groupBy("trace_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(one)).alias("records"))).alias("j"))
    return t.records_of_answers(said.select("trace_id", dressed(F.col("j"), F.col("trace_id")).alias("response")))


def stage_verdicts(events) -> tuple:
    """A world in which some traces have no stages, and verdicts by rule: steps outside the drilled range, unknown agents and modes, answers without an object."""
    e = stage_world(events)
    user = F.crc32(F.col("trace_id").cast("binary"))
    e = e.withColumn("phase", F.when(user % 6 == 0, F.lit(None)).otherwise(F.col("phase")))
    n = e.groupBy("trace_id").agg(F.max("idx").alias("last"), F.max_by("agent", "idx").alias("agent"))
    u = user % 30
    said = F.struct(F.when(u % 5 == 1, "nobody").otherwise(F.col("agent")).alias("responsible_agent"), F.when(u % 3 == 1, F.lit(0)).when(u % 3 == 2, F.col("last") + 50).otherwise(F.col("last")).cast("int").alias("step"), F.lit("r").alias("reason"), F.lit("f").alias("fix_suggestion"), F.lit(0.8).alias("confidence"), F.when(u % 4 == 1, "FM-9.9").when(u % 4 == 2, "FM-1.3").alias("failure_mode"))
    answer = F.when(u == 29, "no idea").otherwise(dressed(F.to_json(said), F.col("trace_id")))
    return e, n.select("trace_id", answer.alias("response"))


@trace_query("t17_stage_diagnosis")
def t17_diagnosis(events, traces):
    e, answers = stage_verdicts(events)
    return t.diagnose_stages(t.suspicious_stages(e), answers, e, events.sparkSession.createDataFrame([(m,) for m in MODES], "code string"))


# --- open payloads -----------------------------------------------------------


def open_events(events):
    """events with open payloads by rule: an unknown nested key beside the known ones, an empty object, or none."""
    known = payload_json(events)
    more = F.concat(F.lit('{"extra":{"n":'), F.col("idx").cast("string"), F.lit('},'), F.substring(known, 2, 100_000))
    more = F.regexp_replace(more, r",\}$", "}")
    sent = F.when(F.col("k") % 7 == 3, "{}").when(F.col("k") % 7 == 5, F.lit(None)).when(F.col("k") % 7 == 1, known).otherwise(more)
    return with_fields(events.withColumn("payload", F.try_parse_json(sent)))


OPEN_SQL = """
op0 AS (SELECT *, k % 7 AS m, CASE WHEN k % 7 IN (3, 5) THEN 0 ELSE 1 END AS given FROM ev),
op AS (SELECT trace_id, idx, id, kind, agent, action, ref, m, given, CASE WHEN given = 1 THEN content END AS content, CASE WHEN given = 1 THEN query END AS query, CASE WHEN given = 1 THEN doc_id END AS doc_id, CASE WHEN given = 1 THEN answer END AS answer, CASE WHEN given = 1 THEN to_agent END AS to_agent,
  CASE WHEN given = 1 AND m <> 1 THEN '"extra":{"n":' || idx || '}' END AS extra FROM op0),
"""


@trace_query("c1_open_payloads", OPEN_SQL + """rs AS (SELECT trace_id, ref, min_by(coalesce(content, ''), idx) AS content FROM op WHERE kind = 'TOOL_RESULT' GROUP BY ALL)
SELECT op.trace_id, op.idx, CASE WHEN m = 3 THEN 'empty' WHEN m = 5 OR coalesce(op.content, query, doc_id, answer, to_agent, extra) IS NULL THEN CASE WHEN m = 5 THEN 'missing' ELSE 'empty' END ELSE 'error' END AS reason FROM op LEFT JOIN rs ON rs.trace_id = op.trace_id AND rs.ref = op.idx
WHERE kind = 'TOOL_CALL' AND (m IN (3, 5) OR coalesce(op.content, query, doc_id, answer, to_agent, extra) IS NULL OR regexp_matches(rs.content, '(?i)^\\s*(error|exception|traceback|fatal|failed)\\b'))""")
def c1_open(events, traces):
    return c.malformed_reasons(open_events(events)).select("trace_id", "idx", "reason")


@trace_query("r31_open_payloads", OPEN_SQL + """ln AS (SELECT *, concat_ws(',', '"answer":"' || answer || '"', '"doc_id":"' || doc_id || '"', extra, '"query":"' || query || '"', '"to":"' || to_agent || '"') AS load FROM op),
tx AS (SELECT trace_id, idx, concat_ws(' ', '[' || idx || ']', kind, agent, action, CASE WHEN load <> '' THEN '{' || load || '}' END) || CASE WHEN coalesce(content, '') <> '' THEN ' :: ' || content ELSE '' END AS s FROM ln), ty AS (SELECT trace_id, idx, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS s FROM tx)
SELECT trace_id, idx, CASE WHEN length(s) > 400 THEN substr(s, 1, 397) || '...' ELSE s END AS line FROM ty""")
def r31_open(events, traces):
    return r.render_lines(open_events(events))
