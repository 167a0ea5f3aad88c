"""Traces from and to foreign span trees: span documents, observation batches, and message histories with gold.

Imports give spans (trace_id, span_id, parent_span_id, ordinal, name, kind, agent, action, phase, refs: span ids, ts, payload: VARIANT) and traces (trace_id, task, success, score, note, task_id, meta: map of JSON values). events_of_spans() makes events of them. Nothing is ordered by time: children come in the order of their document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.payload import as_object, json_string, payload_json, with_fields
from tracewright.operators.represent import admit_kind, flatten_spans, remap_refs, time_or_index
from tracewright.sources.formats import GUARDED, guard_export, observation_spans
from tracewright.tables import durable_by, durable_long

STRINGS = "array<string>"
OUTCOME = "success boolean, score double, note string"


def _none(type_: str) -> Column:
    return F.lit(None).cast(type_)


def events_of_spans(spans: DataFrame) -> DataFrame:
    """Events of span trees: pre-order numbers, admitted kinds, time or else number, references to event ids (dangling ones dropped), the parent's event id, the payload and its known fields. Of spans of one id the first among its siblings stays."""
    first = F.row_number().over(Window.partitionBy("trace_id", "span_id").orderBy("ordinal", "parent_span_id"))
    s = durable_by(spans.repartition("trace_id").withColumn("_n", first).where("_n = 1").drop("_n"), "trace_id")
    flat = durable_by(flatten_spans(s), "trace_id")
    refs = remap_refs(s.select("trace_id", "span_id", "refs").where(F.size("refs") > 0), flat)  # most spans name none
    e = s.join(flat, ["trace_id", "span_id"]).join(refs.select("trace_id", "span_id", F.col("refs").alias("_refs")), ["trace_id", "span_id"], "left")
    e = with_fields(e.withColumn("_ts", time_or_index(F.col("ts"))))
    return e.select(
        "trace_id", "idx", "id", F.col("_ts").alias("ts"), admit_kind(F.col("kind"))[0].alias("kind"), "agent", "action", "phase", "content", "query", "doc_id", "answer", "to_agent", F.coalesce("_refs", F.array().cast(STRINGS)).alias("refs"), F.col("parent_id").alias("parent"), "payload",
        F.col("span_id").alias("source_span_id"),
    )


def _last(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """The last non-empty value by `at` of each trace."""
    return rows.groupBy(key).agg(F.max_by(value, F.when(F.coalesce(value, F.lit("")) != "", F.col("at"))).alias(name))


def _merged(rows: DataFrame, key: str, json: Column) -> DataFrame:
    """(key, meta): JSON objects of a trace laid over each other in order of `at`; ground truth stays out."""
    each = rows.select(key, "at", F.explode(F.from_json(json, "map<string,string>")).alias("k", "v"))
    each = each.where(~F.col("k").isin(*GUARDED)).groupBy(key, "k").agg(F.max_by("v", "at").alias("v"))
    return each.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("meta"))


# --- span documents ----------------------------------------------------------

#: Kinds of operations, and operations of kinds.
SPAN_KIND = {"chat": "LLM_CALL", "execute_tool": "TOOL_CALL", "retrieval": "TOOL_CALL", "invoke_agent": "AGENT_MESSAGE"}
OPERATION = {"LLM_CALL": "chat", "TOOL_CALL": "execute_tool", "AGENT_MESSAGE": "invoke_agent"}
OTLP = "resourceSpans array<struct<scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:array<struct<key:string,value:struct<stringValue:string>>>>>>>>>"


def from_otlp(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, traces) of span documents (document; doc: their order, 0 if absent).

    Own attributes (trace.*) win over what operations suggest; other operations are SPAN. References are event ids, tool-call ids or span ids, those of no span are dropped. A later span of the same id replaces the earlier one in its place. Trace-level attributes may stand on any span, the last one counts; injected faults stay out. Only string attributes are read.
    """
    doc = F.col("doc") if "doc" in documents.columns else F.lit(0)
    d = documents.select(doc.cast("long").alias("doc"), F.from_json("document", OTLP).alias("d")).select("doc", F.posexplode("d.resourceSpans").alias("a", "r"))
    d = d.select("doc", "a", F.posexplode("r.scopeSpans").alias("b", "s")).select("doc", "a", "b", F.posexplode("s.spans").alias("c", "p")).select(F.struct("doc", "a", "b", "c").alias("at"), "p.*")
    own = F.map_from_entries(F.filter(F.transform("attributes", lambda x: F.struct(x["key"], x["value"]["stringValue"])), lambda e: e["stringValue"].isNotNull()))
    d = durable_by(d.where("spanId is not null").withColumn("m", F.when(F.size("attributes") > 0, own)).withColumn("traceId", F.coalesce("traceId", F.lit(""))).drop("attributes"), "traceId")
    m = lambda k: F.nullif(F.try_element_at("m", F.lit(k)), F.lit(""))
    cell = F.struct("at", "parentSpanId", "name", "startTimeUnixNano", "m")
    s = d.groupBy("traceId", "spanId").agg(F.max(cell["at"]).alias("_last"), F.min("at").alias("first"), F.max_by(cell.dropFields("at"), "at").alias("p")).select("traceId", "spanId", "first", "p.*")
    named = [d.select("traceId", F.coalesce(m("trace.event_id"), F.col("spanId")).alias("ref"), "spanId", "at", F.lit(0).alias("o")), d.select("traceId", m("gen_ai.tool.call.id").alias("ref"), "spanId", "at", F.lit(1).alias("o"))]
    alias = reduce(DataFrame.unionByName, named).where("ref is not null").groupBy("traceId", "ref").agg(F.max_by("spanId", F.struct("at", "o")).alias("target"))
    refs = s.select("traceId", "spanId", F.posexplode(F.from_json(m("trace.refs"), STRINGS)).alias("pos", "ref")).join(alias, ["traceId", "ref"])
    refs = refs.groupBy("traceId", "spanId").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "target"))), lambda x: x["target"]).alias("refs"))
    ids = _last(d, "traceId", m("trace.id"), "trace_id")
    kinds = F.create_map(*[F.lit(x) for kv in SPAN_KIND.items() for x in kv])
    kind = F.coalesce(m("trace.kind"), F.try_element_at(kinds, m("gen_ai.operation.name")), F.lit("SPAN"))
    s = s.join(refs, ["traceId", "spanId"], "left").join(ids, "traceId")
    ordinal = F.row_number().over(Window.partitionBy("traceId").orderBy("first")) - 1
    spans = s.select(
        F.coalesce("trace_id", "traceId").alias("trace_id"), F.col("spanId").alias("span_id"), F.nullif("parentSpanId", F.lit("")).alias("parent_span_id"), ordinal.alias("ordinal"), F.coalesce(F.nullif("name", F.lit("")), kind).alias("name"), kind.alias("kind"),
        F.coalesce(F.try_element_at("m", F.lit("trace.agent")), F.lit("unknown")).alias("agent"), m("trace.action").alias("action"), m("trace.phase").alias("phase"), F.coalesce("refs", F.array().cast(STRINGS)).alias("refs"), (F.col("startTimeUnixNano").try_cast("long") / 1e9).alias("ts"),
        as_object(m("trace.payload")).alias("payload"),
    )
    outcome = F.from_json("outcome", OUTCOME)
    t = ids.join(_last(d, "traceId", m("trace.task"), "task"), "traceId").join(_last(d, "traceId", m("trace.outcome"), "outcome"), "traceId").join(_merged(d, "traceId", m("trace.meta")), "traceId", "left").withColumn("o", outcome)
    task_id = F.coalesce(F.try_element_at("meta", F.lit("task_id")), F.col("traceId"))
    traces = t.select(F.coalesce("trace_id", "traceId").alias("trace_id"), F.coalesce("task", task_id).alias("task"), F.coalesce("o.success", F.lit(False)).alias("success"), "o.score", F.coalesce("o.note", F.lit("")).alias("note"), task_id.alias("task_id"), F.coalesce("meta", F.create_map().cast("map<string,string>")).alias("meta"))
    return spans, traces


def _attributes(pairs: dict[str, Column]) -> Column:
    each = [F.struct(F.lit(k).alias("key"), F.struct(v.cast("string").alias("stringValue")).alias("value")) for k, v in pairs.items()]
    return F.filter(F.array(*each), lambda a: a["value"]["stringValue"].isNotNull())


def trace_meta(traces: DataFrame, external: bool = False) -> Column:
    """Metadata of a trace for export as a map of variants, without ground truth; for external readers without relevance judgements either."""
    fields = [c for c in ("task_id", "model_version", "prompt_version", "time_window", "evidence", "gold") if c in traces.columns]
    meta = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(c).alias("k"), F.parse_json(F.to_json(F.col(c)) if c in ("evidence", "gold") else json_string(F.col(c))).alias("v")) for c in fields)), lambda e: e["v"].isNotNull()))
    return guard_export(meta, external)


def _outcome(traces: DataFrame, external: bool = False) -> Column:
    score = F.col("score") if "score" in traces.columns else _none("double")
    note = F.coalesce("note", F.lit("")) if "note" in traces.columns and not external else F.lit("")
    return F.struct("success", score.alias("score"), note.alias("note"))


def to_otlp(events: DataFrame, traces: DataFrame | None = None, spans_a_document: int = 1000) -> DataFrame:
    """Span documents (trace_id, doc, document), each of at most `spans_a_document` spans of one trace, so that no row grows with a trace.

    Ids are SHA-256 prefixes. The parent is the event's, left out where the trace has no such event; a span lasts a second. Task, outcome and metadata without ground truth stand on the trace's first event. Events without a payload column send their typed fields.
    """
    hash_ = lambda c, n: F.substring(F.sha2(c, 256), 1, n)
    e = events if "parent" in events.columns else events.withColumn("parent", _none("string"))
    load = F.to_json("payload") if "payload" in events.columns else payload_json(events)
    there = e.select("trace_id", F.col("id").alias("parent"), F.lit(True).alias("_there")).distinct()
    e = e.withColumn("_load", load).join(there, ["trace_id", "parent"], "left")
    op = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in OPERATION.items()), F.lit("other"))
    attrs = {"gen_ai.operation.name": op, "gen_ai.provider.name": F.lit("tracewright"), "trace.kind": F.col("kind"), "trace.agent": F.col("agent"), "trace.event_id": F.col("id"), "trace.id": F.col("trace_id"), "trace.payload": F.col("_load"), "trace.refs": F.to_json("refs"), "trace.action": F.col("action"), "trace.phase": F.col("phase")}
    if traces is not None:
        first = lambda c: F.when(F.col("idx") == 0, c)
        model = F.col("model_version") if "model_version" in traces.columns else _none("string")
        e = e.join(traces.select("trace_id", F.col("task").alias("_task"), F.to_json(_outcome(traces)).alias("_outcome"), F.to_json(trace_meta(traces)).alias("_meta"), model.alias("_model")), "trace_id", "left")
        attrs |= {"trace.meta": first(F.col("_meta")), "trace.task": first(F.col("_task")), "trace.outcome": first(F.col("_outcome")), "gen_ai.request.model": F.when(op == "chat", F.col("_model"))}
    nano = (F.col("ts") * 1_000_000_000).cast("long")
    span = F.struct(
        "idx", hash_(F.col("trace_id"), 32).alias("traceId"), hash_(F.concat_ws(":", "trace_id", "id"), 16).alias("spanId"), F.when(F.col("_there"), hash_(F.concat_ws(":", "trace_id", "parent"), 16)).alias("parentSpanId"), F.concat_ws(" ", op, F.coalesce("action", "agent")).alias("name"),
        F.when(op == "chat", 2).otherwise(1).alias("kind"), nano.cast("string").alias("startTimeUnixNano"), (nano + 1_000_000_000).cast("string").alias("endTimeUnixNano"), _attributes(attrs).alias("attributes"),
    )
    spans = e.groupBy("trace_id", F.expr(f"idx div {spans_a_document}").alias("doc")).agg(F.array_sort(F.collect_list(span)).alias("s"))
    doc = F.struct(F.array(F.struct(F.array(F.struct(F.transform("s", lambda x: x.dropFields("idx")).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    return spans.select("trace_id", "doc", F.to_json(doc).alias("document"))


# --- observation batches -----------------------------------------------------

#: Observation types of record types.
RECORD_TYPE = {"span-create": "SPAN", "generation-create": "GENERATION", "event-create": "EVENT"}


def from_batches(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, traces) of ingestion batches (batch: JSON {batch: [{type, body}]}; doc: their order, 0 if absent).

    Older records (observation-create) have the type in their body; records of other types are not read, nor are observations of traces without a record. metadata.own wins over names and types: generations are decisions, all others SPAN. References by original event id become observation ids, dangling ones are dropped; parents that aren't there make roots. A trace's outcome leaves its metadata; its task is its input, else its task_id, which is its name by default.
    """
    doc = F.col("doc") if "doc" in batches.columns else F.lit(0)
    record = F.from_json(F.get_json_object("batch", "$.batch"), "array<string>")
    b = batches.select(doc.cast("long").alias("doc"), F.posexplode(record).alias("pos", "x"))
    field = lambda path: F.get_json_object("x", path)
    b = durable_long(b.select(F.struct("doc", "pos").alias("at"), field("$.type").alias("type"), *(field(f"$.body.{f}").alias(f) for f in ("id", "traceId", "name", "parentObservationId", "input", "metadata")), field("$.body.type").alias("said")))
    heads = b.where("type = 'trace-create'").groupBy(F.col("id").alias("traceId")).agg(F.max_by(F.struct("name", "input", "metadata"), "at").alias("t")).select("traceId", "t.*")
    types = F.create_map(*[F.lit(x) for kv in RECORD_TYPE.items() for x in kv])
    o = b.withColumn("is", F.coalesce(F.try_element_at(types, F.col("type")), F.when(F.col("type") == "observation-create", F.col("said")))).where("`is` is not null")
    o = o.join(heads.select("traceId"), "traceId", "left_semi").withColumn("own", F.from_json(F.get_json_object("metadata", "$.own"), f"id string, kind string, agent string, action string, phase string, refs {STRINGS}, ts double"))
    o = durable_by(o.groupBy("traceId", "id").agg(F.min("at").alias("first"), F.max_by(F.struct("name", "parentObservationId", "input", "is", "own"), "at").alias("p")).select("traceId", "id", "first", "p.*"), "traceId")
    alias = o.where("own.id <> ''").groupBy("traceId", F.col("own.id").alias("ref")).agg(F.max_by("id", "first").alias("target"))
    refs = o.select("traceId", "id", F.posexplode("own.refs").alias("pos", "ref")).join(alias, ["traceId", "ref"])
    refs = refs.groupBy("traceId", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "target"))), lambda x: x["target"]).alias("refs"))
    text = lambda c: F.nullif(c, F.lit(""))
    ordinal = F.row_number().over(Window.partitionBy("traceId").orderBy("first")) - 1
    spans = o.join(refs, ["traceId", "id"], "left").select(
        F.col("traceId").alias("trace_id"), F.col("id").alias("span_id"), F.col("parentObservationId").alias("parent_span_id"), ordinal.alias("ordinal"), F.coalesce(text(F.col("name")), text(F.col("own.kind")), F.lit("step")).alias("name"),
        F.coalesce(text(F.col("own.kind")), F.when(F.col("is") == "GENERATION", "LLM_CALL").otherwise("SPAN")).alias("kind"), F.coalesce("own.agent", F.lit("unknown")).alias("agent"), F.col("own.action").alias("action"), F.col("own.phase").alias("phase"),
        F.coalesce("refs", F.array().cast(STRINGS)).alias("refs"), F.col("own.ts").alias("ts"), as_object(F.col("input"), "input").alias("payload"),
    )
    meta = F.map_filter(F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: k != "outcome")
    t = heads.withColumn("o", F.from_json(F.get_json_object("metadata", "$.outcome"), OUTCOME)).withColumn("meta", meta)
    task_id = F.coalesce(F.try_element_at("meta", F.lit("task_id")), "name", "traceId")
    return spans, t.select(F.col("traceId").alias("trace_id"), F.coalesce(text(F.col("input")), task_id).alias("task"), F.coalesce("o.success", F.lit(False)).alias("success"), "o.score", F.coalesce("o.note", F.lit("")).alias("note"), task_id.alias("task_id"), "meta")


def to_batches(events: DataFrame, traces: DataFrame, external: bool = False, records_a_batch: int = 1000) -> DataFrame:
    """Ingestion batches (trace_id, doc, batch): a trace record, then one observation per event in order, decisions as generations, at most `records_a_batch` events in a batch. Ids follow from trace and event. For external readers relevance judgements stay out and the outcome's note is empty; ground truth never leaves."""
    own = F.struct("id", "kind", "agent", "action", "phase", "refs", F.col("idx").alias("index"), "ts")
    e = events if "parent" in events.columns else events.withColumn("parent", _none("string"))
    load = F.to_json("payload") if "payload" in events.columns else payload_json(events)
    name = lambda *parts: F.concat_ws("-", *parts)
    still = F.lit("1970-01-01T00:00:00Z")
    there = e.select("trace_id", F.col("id").alias("parent"), F.lit(True).alias("_there")).distinct()
    e = e.withColumn("_load", F.from_json(load, "variant")).join(there, ["trace_id", "parent"], "left")
    body = F.struct(name(F.lit("obs"), "trace_id", "id").alias("id"), F.col("trace_id").alias("traceId"), F.coalesce("action", "kind").alias("name"), F.when(F.col("_there"), name(F.lit("obs"), "trace_id", "parent")).alias("parentObservationId"), F.col("_load").alias("input"), F.struct(own.alias("own")).alias("metadata"))
    record = F.to_json(F.struct(name(F.lit("evt"), "trace_id", "id").alias("id"), F.when(F.col("kind") == "LLM_CALL", "generation-create").otherwise("span-create").alias("type"), still.alias("timestamp"), body.alias("body")))
    each = e.groupBy("trace_id", F.expr(f"idx div {records_a_batch}").alias("doc")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", record.alias("r")))), lambda x: x["r"]).alias("r"))
    meta = F.map_concat(trace_meta(traces, external), F.create_map(F.lit("outcome"), F.parse_json(F.to_json(_outcome(traces, external)))))
    head = F.struct(name(F.lit("evt"), "trace_id", F.lit("trace")).alias("id"), F.lit("trace-create").alias("type"), still.alias("timestamp"), F.struct(F.col("trace_id").alias("id"), F.coalesce("task_id", "trace_id").alias("name"), F.col("task").alias("input"), meta.alias("metadata")).alias("body"))
    heads = traces.select("trace_id", F.lit(-1).cast("long").alias("doc"), F.array(F.to_json(head)).alias("r"))
    return heads.unionByName(each).select("trace_id", "doc", F.concat(F.lit('{"batch":['), F.array_join("r", ","), F.lit("]}")).alias("batch"))


def events_of_observations(observations: DataFrame, namespace: str = "own") -> DataFrame:
    """Events of pulled observations (see observation_spans()), with all keys of their payloads."""
    spans = observation_spans(observations, namespace)
    return events_of_spans(spans.withColumn("payload", F.to_variant_object("payload")))


# --- message histories with gold ---------------------------------------------

#: Who speaks by which field, and the short names of the two splits.
SPLITS = {"Algorithm-Generated": ("name", "ag"), "Hand-Crafted": ("role", "hc")}


def message_kind(agent: Column, idx: Column) -> Column:
    """Kind of a message by who says it: tool output of terminals and computers, routing arrows as handoffs, people start the task or speak, all others decide."""
    a = F.lower(agent)
    return F.when(a.contains("terminal") | a.contains("computer"), "TOOL_RESULT").when(agent.contains("->"), "HANDOFF").when(a.isin("human", "user"), F.when(idx == 0, "TASK_START").otherwise("AGENT_MESSAGE")).otherwise("LLM_CALL")


def messages_of_records(records: DataFrame, split: str) -> tuple[DataFrame, DataFrame]:
    """(events, traces) of benchmark records (record_id, record: JSON {question, history: [{name, role, content}], mistake_step, mistake_agent, is_correct, ...}) of one split.

    In the hand-crafted split a routing note in brackets at the end of a role is not part of the agent's name; so arrows inside it make no handoff there. Records without gold (mistake_step, mistake_agent) are left out: they can't be scored. Gold goes to the traces alone. An unknown split is an error.
    """
    if split not in SPLITS:
        raise ValueError(f"unknown split {split}; one of {', '.join(SPLITS)}")
    key, short = SPLITS[split]
    get = lambda f: F.get_json_object("record", f"$.{f}")
    r = records.select(F.concat(F.lit(f"{short}-"), F.col("record_id").cast("string")).alias("trace_id"), get("question").alias("task"), F.coalesce(get("is_correct") == "true", F.lit(False)).alias("success"), get("mistake_step").cast("int").alias("gt_step"), get("mistake_agent").alias("gt_agent"), get("level").alias("level"), get("ground_truth").alias("ground_truth"), get("mistake_reason").alias("reason"), F.from_json(get("history"), "array<string>").alias("history"))
    r = r.where("gt_step is not null and gt_agent is not null")
    e = r.select("trace_id", F.posexplode("history").alias("idx", "m"))
    said = lambda f: F.nullif(F.get_json_object("m", f"$.{f}"), F.lit(""))
    agent = F.coalesce(said(key), said("name"), said("role"), F.lit("unknown"))
    if split == "Hand-Crafted":
        agent = F.coalesce(F.nullif(F.trim(F.regexp_replace(agent, r"\s*\([^()]*\)\s*$", "")), F.lit("")), agent)
    e = e.withColumn("agent", agent)
    content = F.coalesce(F.get_json_object("m", "$.content"), F.lit(""))
    events = e.select("trace_id", "idx", F.format_string("e%03d", "idx").alias("id"), F.col("idx").cast("double").alias("ts"), message_kind(F.col("agent"), F.col("idx")).alias("kind"), "agent", content.alias("content"))
    traces = r.select("trace_id", F.coalesce("task", F.lit("")).alias("task"), "success", F.col("trace_id").alias("task_id"), "gt_step", "gt_agent", _none("string").alias("gt_code"), F.lit(f"messages:{short}").alias("gt_kind"), "level", "ground_truth", "reason")
    return events, traces
