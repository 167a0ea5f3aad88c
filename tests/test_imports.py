"""Foreign span trees, batches and message histories, and open payloads, as rows."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tracewright.operators import classify as c
from tracewright.operators import payload as p
from tracewright.operators import represent as r
from tracewright.sources import imports as im

EVENTS = "trace_id string, idx int, id string, ts double, kind string, agent string, action string, phase string, content string, query string, doc_id string, answer string, to_agent string, refs array<string>, parent string"
TRACES = "trace_id string, task string, success boolean, score double, note string, task_id string, model_version string, evidence array<string>, gold array<string>, gt_step int, gt_agent string"


def world(spark):
    e = lambda i, kind, agent, refs=(), parent=None, action=None, phase=None, **x: ("t1", i, f"e{i:03d}", float(i) + 0.5, kind, agent, action, phase, x.get("content"), x.get("query"), None, None, x.get("to"), [f"e{k:03d}" for k in refs], parent)
    events = [e(0, "LLM_CALL", "planner", content="plan: é", phase="plan"), e(1, "TOOL_CALL", "searcher", query="q", action="search", parent="e000"), e(2, "TOOL_RESULT", "env", refs=(1,), parent="e999", content="error: x"), e(3, "HANDOFF", "searcher", to="writer", refs=(2, 1))]
    return spark.createDataFrame(events, EVENTS), spark.createDataFrame([("t1", "find it", True, 0.25, "well", "k1", "m1", ["d1"], ["d2"], 3, "searcher")], TRACES)


def same(spark, spans, traces, events):
    got = {tuple(x) for x in im.events_of_spans(spans).select("idx", "id", "ts", "kind", "agent", "action", "phase", "content", "query", "to_agent", F.array_join("refs", ",")).collect()}
    want = {tuple(x) for x in events.select("idx", "id", "ts", "kind", "agent", "action", "phase", "content", "query", "to_agent", F.array_join("refs", ",")).collect()}
    assert got == want
    t = traces.first()
    assert (t.trace_id, t.task, t.success, t.score, t.note, t.task_id) == ("t1", "find it", True, 0.25, "well", "k1")
    assert "outcome" not in t.meta and not {"gt_step", "gt_agent", "injected_fault"} & set(t.meta) and t.meta["model_version"] == "m1"
    return t


@pytest.mark.parametrize("size", [1000, 2])
def test_round_trips_keep_all(spark, size):
    events, traces = world(spark)
    t = same(spark, *im.from_otlp(im.to_otlp(events, traces, size)), events)
    assert json.loads(t.meta["gold"]) == ["d2"]
    t = same(spark, *im.from_batches(im.to_batches(events, traces, records_a_batch=size)), events)
    assert json.loads(t.meta["evidence"]) == ["d1"]
    _, t = im.from_batches(im.to_batches(events, traces, external=True))
    t = t.first()
    assert t.note == "" and t.success and not {"evidence", "gold"} & set(t.meta) and t.meta["model_version"] == "m1"


def test_span_documents_meet_the_format(spark):
    events, traces = world(spark)
    doc = json.loads(im.to_otlp(events, traces).first().document)
    spans = doc["resourceSpans"][0]["scopeSpans"][0]["spans"]
    attrs = [{a["key"]: a["value"]["stringValue"] for a in s["attributes"]} for s in spans]
    assert len(spans) == 4 and all(re.fullmatch(r"[0-9a-f]{32}", s["traceId"]) and re.fullmatch(r"[0-9a-f]{16}", s["spanId"]) for s in spans)
    assert ["parentSpanId" in s for s in spans] == [False, True, False, False] and spans[1]["parentSpanId"] == spans[0]["spanId"]
    assert [a["gen_ai.operation.name"] for a in attrs] == ["chat", "execute_tool", "other", "other"] and [s["kind"] for s in spans] == [2, 1, 1, 1]
    assert [s["name"] for s in spans] == ["chat planner", "execute_tool search", "other env", "other searcher"]
    assert "trace.task" in attrs[0] and "trace.task" not in attrs[1] and attrs[0]["gen_ai.request.model"] == "m1" and "gt_" not in json.dumps(doc)
    records = [x for b in im.to_batches(events, traces).orderBy("doc").collect() for x in json.loads(b.batch)["batch"]]
    assert [x["type"] for x in records] == ["trace-create", "generation-create", "span-create", "span-create", "span-create"] and all("type" not in x["body"] for x in records)
    assert records[2]["body"]["parentObservationId"] == "obs-t1-e000" and "parentObservationId" not in records[3]["body"] and records[2]["body"]["metadata"]["own"]["ts"] == 1.5


def test_foreign_spans_are_in_preorder(spark):
    """a > (b > d), c with c started before b: order is the tree's, not time's; ids of calls and events are aliases; the last trace-level value counts."""
    attr = lambda **x: [{"key": k.replace("__", "."), "value": {"stringValue": v} if isinstance(v, str) else {"intValue": v}} for k, v in x.items()]
    span = lambda i, parent, start, **x: {"traceId": "T", "spanId": i, "startTimeUnixNano": start, "attributes": attr(**x)} | ({"parentSpanId": parent} if parent is not None else {})
    spans = [
        span("a", None, "9000000000", gen_ai__operation__name="invoke_agent", trace__task="first", trace__meta='{"injected_fault":{"step":1},"x":1}'), span("d", "b", "1", gen_ai__operation__name="execute_tool", gen_ai__tool__call__id="call-7", trace__payload="not json"),
        span("b", "a", "bad", gen_ai__operation__name="chat", trace__refs='["call-7","c","zz"]', trace__payload='{"content":"hi","deep":{"k":[1,2]}}'), span("c", "a", "2", gen_ai__operation__name="strange", trace__kind="VERIFIER", trace__refs="nope", trace__agent=7, trace__task="second", trace__outcome='{"success":true,"score":1.5}'), span("o", "lost", "3"),
    ]
    docs = [{"resourceSpans": [{"scopeSpans": [{"spans": spans[:2]}]}]}, {"resourceSpans": [{"scopeSpans": [{"spans": spans[2:4]}, {"spans": spans[4:]}]}, {"scopeSpans": None}]}]
    s, t = im.from_otlp(spark.createDataFrame([(json.dumps(d), k) for k, d in enumerate(docs)], "document string, doc int"))
    rows = {x.source_span_id: x for x in im.events_of_spans(s).withColumn("j", F.to_json("payload")).collect()}
    assert [k for k, _ in sorted(rows.items(), key=lambda kv: kv[1].idx)] == ["a", "b", "d", "c", "o"]
    assert {k: x.kind for k, x in rows.items()} == {"a": "AGENT_MESSAGE", "b": "LLM_CALL", "c": "VERIFIER", "d": "TOOL_CALL", "o": "AGENT_MESSAGE"}
    assert rows["b"].refs == ["e002", "e003"] and rows["c"].refs == [] and rows["b"].ts == 1.0 and rows["a"].ts == 9.0 and rows["d"].parent == "e001" and rows["o"].parent is None
    assert rows["b"].content == "hi" and json.loads(rows["b"].j)["deep"] == {"k": [1, 2]} and json.loads(rows["d"].j) == {"raw": "not json"} and rows["a"].j is None and rows["c"].agent == "unknown"
    t = t.first()
    assert (t.trace_id, t.task, t.success, t.score, t.task_id) == ("T", "second", True, 1.5, "T") and t.meta == {"x": "1"}


def test_foreign_batches(spark):
    body = lambda i, parent=None, own=None, **x: {"id": i, "traceId": "T", "parentObservationId": parent} | ({"metadata": {"own": own}} if own else {}) | x
    batch = [
        {"type": "span-create", "body": body("x", "y", {"id": "e9", "refs": ["e1", "gone"]}, input={"z": 1, "content": "c"})}, {"type": "trace-create", "body": {"id": "T", "name": "N", "metadata": {"outcome": {"success": True, "note": "n"}, "k": "v"}}}, {"type": "score-create", "body": {"id": "s"}},
        {"type": "observation-create", "body": body("y", "nobody", {"id": "e1", "kind": "HANDOFF", "agent": "A"}, type="GENERATION")}, {"type": "observation-create", "body": body("g", type="GENERATION", input="text")}, {"type": "span-create", "body": {"id": "lost", "traceId": "other"}},
    ]
    s, t = im.from_batches(spark.createDataFrame([(json.dumps({"batch": batch}),)], "batch string"))
    rows = {x.source_span_id: x for x in im.events_of_spans(s).withColumn("j", F.to_json("payload")).collect()}
    assert {k: (x.idx, x.kind, x.agent, x.refs) for k, x in rows.items()} == {"y": (0, "HANDOFF", "A", []), "x": (1, "AGENT_MESSAGE", "unknown", ["e000"]), "g": (2, "LLM_CALL", "unknown", [])}
    assert json.loads(rows["x"].j) == {"content": "c", "z": 1} and json.loads(rows["g"].j) == {"input": "text"}
    t = t.first()
    assert (t.task, t.success, t.note, t.task_id, t.meta) == ("N", True, "n", "N", {"k": "v"})


def test_messages_of_both_splits(spark):
    history = [{"name": "human", "role": "human", "content": "go"}, {"name": "Excel_Expert", "role": "Orchestrator (thought)", "content": "hm"}, {"name": "Computer_terminal", "role": "Orchestrator (-> WebSurfer)", "content": "exit 0"}, {"name": "", "role": "user"}, {"role": "Orchestrator -> Coder", "content": {"a": 1}}]
    record = json.dumps({"question": "why?", "history": history, "mistake_step": "1", "mistake_agent": "Orchestrator", "is_correct": False, "level": 2})
    rows = spark.createDataFrame([(1, record), (2, json.dumps({"history": history, "mistake_step": "1"})), (3, json.dumps({"history": history, "mistake_agent": "x"}))], "record_id int, record string")
    e, t = im.messages_of_records(rows, "Hand-Crafted")
    got = [(x.agent, x.kind, x.content) for x in e.orderBy("idx").collect()]
    assert got == [("human", "TASK_START", "go"), ("Orchestrator", "LLM_CALL", "hm"), ("Orchestrator", "LLM_CALL", "exit 0"), ("user", "AGENT_MESSAGE", ""), ("Orchestrator -> Coder", "HANDOFF", '{"a":1}')]
    assert [(x.trace_id, x.task, x.success, x.gt_step, x.gt_agent, x.gt_kind, x.gt_code) for x in t.collect()] == [("hc-1", "why?", False, 1, "Orchestrator", "messages:hc", None)]
    e, _ = im.messages_of_records(rows, "Algorithm-Generated")
    assert [(x.agent, x.kind) for x in e.orderBy("idx").collect()] == [("human", "TASK_START"), ("Excel_Expert", "LLM_CALL"), ("Computer_terminal", "TOOL_RESULT"), ("user", "AGENT_MESSAGE"), ("Orchestrator -> Coder", "HANDOFF")]
    with pytest.raises(ValueError):
        im.messages_of_records(rows, "other")
    assert not {"gt_step", "gt_agent", "ground_truth", "reason"} & set(e.columns)


def test_observations_keep_unknown_keys(spark):
    cols = "trace_id string, id string, name string, type string, parent_id string, start_time string, input string, output string, level string, metadata string, top string"
    rows = [("T", "b", "search", "SPAN", "a", "2024-01-01T00:00:02Z", '{"query":"q","filters":{"year":2020}}', '"found"', None, None, "{}"), ("T", "a", "root", "SPAN", None, "2024-01-01T00:00:09Z", None, None, None, None, "{}"), ("T", "c", "late", "GENERATION", "a", "2024-01-01T00:00:01Z", None, '"x"', "ERROR", None, "{}")]
    e = im.events_of_observations(spark.createDataFrame([*rows, rows[0]], cols))  # one comes twice
    assert e.count() == 3
    lines = {x.idx: x.line for x in r.render_lines(e).collect()}
    assert lines[1].startswith("[1] LLM_CALL unknown late :: error: x") and lines[2].startswith("[2] TOOL_CALL unknown search {") and '"year' in lines[2].replace("\\", "") and '"query":"q"' in lines[2] and lines[2].endswith(":: found")


def test_payload_states(spark):
    sent = ['{"content":null}', "{}", None, '{"q":{"a":1}}', "[1]", "no json"]
    e = spark.createDataFrame([("t", i, f"e{i}", "TOOL_CALL", "a", "act", s, []) for i, s in enumerate(sent)], "trace_id string, idx int, id string, kind string, agent string, action string, s string, refs array<string>")
    e = p.with_fields(e.withColumn("payload", p.as_object(F.col("s"))))
    assert [x.s for x in e.select(p.payload_state(e).alias("s")).collect()] == ["given", "empty", "missing", "given", "given", "given"]
    assert {(x.idx, x.reason) for x in c.malformed_reasons(e).collect()} == {(1, "empty"), (2, "missing")}
    assert {x.idx: x.line for x in r.render_lines(e).collect()}[3] == '[3] TOOL_CALL a act {"q":{"a":1}}'
    assert [x.idx for x in r.graph_nodes(e).orderBy("idx").collect()] == [0, 3, 4, 5]
