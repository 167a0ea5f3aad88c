"""Trace formats as DataFrames: JSON lines, nested span documents, observation batches, message histories, and score payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.model import EVENT_SCHEMA
from tracewright.operators.represent import admit_kind, flatten_spans
from tracewright.tables import durable, durable_by

TRACE_LINE = f"trace_id string, task string, events array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in EVENT_SCHEMA.replace('trace_id string, ', '').split(','))}>>, outcome struct<success:boolean,score:double,note:string>, meta string"
#: Keys of ground truth that never leave through an export, and those that stay on this machine.
GUARDED = ("injected_fault", "origin_fault", "fault_removed")
LOCAL_ONLY = ("qrels",)
#: The same as columns of TRACE_SCHEMA.
FLAT_GUARDED, FLAT_LOCAL_ONLY = ("gt_step", "gt_agent", "gt_code", "gt_kind"), ("evidence", "gold")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces from JSON lines under a strict schema: a bad line fails the job, blank lines are skipped."""
    return spark.read.schema(TRACE_LINE).option("mode", "FAILFAST").json(path)


def checked_traces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(traces, faults) of JSON lines: rows of read_traces() for all lines that can be read, and (file, line: its number from 1, text) of those that can't: no JSON object of the schema, or one without a trace_id. Blank lines are skipped, but counted.

    Files are split like any others. A line's number is its place in its split, after the lines of all earlier splits of the file; only one count per split is summed up. What the lines hold is written once.
    """
    said = "_corrupt_record"
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    parsed = F.from_json("value", f"{TRACE_LINE}, {said} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": said})
    rows = durable(lines.withColumn("t", F.when(F.trim("value") != "", parsed)).withColumn("bad", (F.trim("value") != "") & (F.col(f"t.{said}").isNotNull() | F.col("t.trace_id").isNull())).withColumn("value", F.when(F.col("bad"), F.col("value"))))
    splits = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    faults = rows.where("bad").join(splits.withColumn("before", before), ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), F.col("value").alias("text"))
    return rows.where("t is not null and not bad").select("t.*").drop(said), faults


def require_traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces of checked_traces(); a bad line is an error that names its file and number (the first by both)."""
    traces, faults = checked_traces(spark, path)
    first = faults.orderBy("file", "line").first()
    if first is not None:
        raise ValueError(f"{first['file']}:{first['line']}: not a trace: {first['text'][:200]}")
    return traces


def trace_lines(events: DataFrame, traces: DataFrame) -> DataFrame:
    """Nested rows of read_traces() from the flat tables; events in order."""
    fields = [c.strip().split(" ")[0] for c in EVENT_SCHEMA.split(",")][1:]
    nested = events.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("events"))
    return traces.join(nested, "trace_id").select("trace_id", "task", "events", F.struct("success", F.lit(None).cast("double").alias("score"), F.lit("").alias("note")).alias("outcome"), F.to_json(F.struct("task_id", "model_version", "prompt_version", "time_window")).alias("meta"))


def append_traces(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").json(path)


def flat_events(lines: DataFrame) -> DataFrame:
    return lines.select("trace_id", F.explode("events").alias("e")).select("trace_id", "e.*")


def write_artifact(df: DataFrame, root: str, stage: str, name: str, run_id: str | None = None) -> str:
    """One table per stage and operator, replaced as a whole; with a run_id only that run's partition is replaced. Running again gives the same table. Returns its path."""
    for part in (stage, name, *([run_id] if run_id is not None else [])):
        if not part or part in (".", "..") or any(c in part for c in "/\\"):
            raise ValueError("stage, name and run_id must each be one path component")
    path = f"{root}/{stage}__{name}"
    if run_id is None:
        df.write.mode("overwrite").parquet(path)
    else:
        df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    return path


def guard_export(meta: Column, external: bool = False) -> Column:
    """A metadata map without the keys of ground truth, nested or as flat columns; for external readers without relevance judgements too."""
    hidden = F.array(*map(F.lit, GUARDED + FLAT_GUARDED + ((LOCAL_ONLY + FLAT_LOCAL_ONLY) if external else ())))
    return F.map_filter(meta, lambda k, v: ~F.array_contains(hidden, k))


def to_otlp(events: DataFrame) -> DataFrame:
    """Span documents of events alone; see tracewright.sources.imports for those with trace-level fields."""
    from tracewright.sources import imports

    return imports.to_otlp(events)


def from_otlp(documents: DataFrame) -> DataFrame:
    """Events of span documents, flattened."""
    from tracewright.sources import imports

    return imports.events_of_spans(imports.from_otlp(documents)[0])


#: Parts of names that tell a handoff or a check, and metadata keys that name the agent.
HANDOFF_HINTS = ("handoff", "hand_over", "handover", "transfer", "delegate", "escalate")
VERIFIER_HINTS = ("verif", "evaluat", "judge", "guardrail", "critic", "assert")
AGENT_KEYS = ("agent", "agent_name", "gen_ai.agent.name", "llm.app")


def kind_of_observation(name: Column, type_: Column, has_children: Column) -> Column:
    """Kind of an observation by its name, then its type in any case; other types are calls, or messages where they have children."""
    n, t = F.lower(F.coalesce(name, F.lit(""))), F.upper(F.coalesce(type_, F.lit("")))
    holds = lambda hints: n.rlike("|".join(hints))
    return F.when(holds(HANDOFF_HINTS), "HANDOFF").when(holds(VERIFIER_HINTS), "VERIFIER").when(t == "GENERATION", "LLM_CALL").when(t == "EVENT", "AGENT_MESSAGE").when(has_children, "AGENT_MESSAGE").otherwise("TOOL_CALL")


def agent_of(metadata: Column, top: Column | None = None, keys: tuple[str, ...] = AGENT_KEYS) -> Column:
    """The first key that a metadata JSON has, else the first that the observation's own JSON `top` has, else 'unknown'."""
    return F.coalesce(*(F.get_json_object(c, f"$['{k}']") for c in (metadata, top) if c is not None for k in keys), F.lit("unknown"))


def json_text(value: Column) -> Column:
    """A JSON string without its quotes; other JSON values as compact text."""
    return F.get(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>"), F.lit(0))


def observation_payload(input_: Column, output: Column, level: Column) -> Column:
    """Payload map of an observation from JSON values: the fields of an object given as input, else `input`; the output as `content`; errors say so at its start."""
    fields = F.when(F.ltrim(input_).startswith("{"), F.from_json(input_, "map<string,string>")).when(input_.isNotNull(), F.create_map(F.lit("input"), json_text(input_)))
    fields = F.coalesce(fields, F.create_map().cast("map<string,string>"))
    said = F.coalesce(json_text(output), F.try_element_at(fields, F.lit("content")))
    said = F.when(F.upper(F.coalesce(level, F.lit(""))) == "ERROR", F.concat(F.lit("error: "), F.coalesce(said, F.lit("")))).otherwise(said)
    return F.map_concat(F.map_filter(fields, lambda k, v: k != "content"), F.when(said.isNotNull(), F.create_map(F.lit("content"), said)).otherwise(F.create_map().cast("map<string,string>")))


def epoch(iso: Column) -> Column:
    """Seconds of an ISO 8601 time; without a zone it is UTC; null if it can't be read."""
    zoned = F.when(iso.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), iso).otherwise(F.concat(iso, F.lit("Z")))
    return F.unix_micros(F.try_to_timestamp(zoned)) / 1e6


def observation_spans(observations: DataFrame, namespace: str = "own", keys: tuple[str, ...] = AGENT_KEYS) -> DataFrame:
    """observations (trace_id, id, name, type, parent_id, start_time: ISO, input, output, level, metadata, top: JSON) -> spans (trace_id, span_id, parent_span_id, ordinal, name, kind, agent, action, phase, refs, ts, payload map) for flatten_spans().

    Siblings are in order of (start or 0, id); a parent that isn't there makes a root. Fields under metadata.<namespace>, written by our own exports, win over what names and types suggest, and references by original event id become observation ids. A null or empty id is an error.
    """
    own = F.from_json(F.get_json_object("metadata", f"$['{namespace}']"), "id string, kind string, agent string, action string, phase string, refs array<string>, ts double")
    known = F.coalesce(F.col("id"), F.lit("")) != ""
    o = observations.withColumns({"own": own, "id": F.when(known, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("observation without an id in trace "), F.coalesce("trace_id", F.lit("null"))))), "at": epoch(F.col("start_time"))})
    o = durable_by(o, "trace_id")
    ids = o.select("trace_id", F.col("id").alias("parent_id"), F.lit(True).alias("_there")).distinct()
    parents = o.select("trace_id", F.col("parent_id").alias("id"), F.lit(True).alias("_kids")).where("id is not null").distinct()
    o = o.join(ids, ["trace_id", "parent_id"], "left").join(parents, ["trace_id", "id"], "left").withColumn("parent_id", F.when(F.col("_there"), F.col("parent_id")))
    ordinal = F.row_number().over(Window.partitionBy("trace_id", "parent_id").orderBy(F.coalesce("at", F.lit(0.0)), "id")) - 1
    kids = F.coalesce("_kids", F.lit(False))
    alias = o.where("own.id is not null").groupBy("trace_id", F.col("own.id").alias("ref")).agg(F.max_by("id", F.struct(F.coalesce("at", F.lit(0.0)), "id")).alias("target"))
    refs = o.select("trace_id", "id", F.posexplode("own.refs").alias("pos", "ref")).join(alias, ["trace_id", "ref"], "left")
    refs = refs.groupBy("trace_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("target", "ref").alias("r")))), lambda x: x["r"]).alias("refs"))
    text = lambda c: F.when(c != "", c)
    s = o.withColumn("ordinal", ordinal).join(refs, ["trace_id", "id"], "left")
    return s.select(
        "trace_id", F.col("id").alias("span_id"), F.col("parent_id").alias("parent_span_id"), "ordinal", F.coalesce(text(F.col("name")), "own.kind", F.lit("step")).alias("name"),
        F.coalesce(text(F.col("own.kind")), kind_of_observation(F.col("name"), F.col("type"), kids)).alias("kind"), F.coalesce(text(F.col("own.agent")), agent_of(F.col("metadata"), F.col("top"), keys)).alias("agent"),
        F.when(F.col("own").isNotNull(), F.col("own.action")).otherwise(F.col("name")).alias("action"), F.col("own.phase").alias("phase"), F.coalesce("refs", F.array().cast("array<string>")).alias("refs"), F.coalesce("own.ts", "at").alias("ts"),
        observation_payload(F.col("input"), F.col("output"), F.col("level")).alias("payload"),
    )


def source_spans(events: DataFrame, artifact: DataFrame) -> DataFrame:
    """events (trace_id, idx) and artifact (trace_id, source_span_ids: one for each event in order) -> (trace_id, step, span_id) of events that have one. Lists of another length than the trace are an error; traces without a list give nothing."""
    n = events.groupBy("trace_id").agg(F.count("*").alias("n"))
    j = artifact.join(n, "trace_id")
    wrong = F.raise_error(F.concat(F.lit("source_span_ids of trace "), "trace_id", F.lit(" don't match its events")))
    ids = F.when(F.size("source_span_ids") == F.col("n"), F.col("source_span_ids")).otherwise(wrong.cast("array<string>"))
    return j.select("trace_id", F.posexplode(ids).alias("step", "span_id")).where("coalesce(span_id, '') <> ''")


def flatten_missing(events: DataFrame, spans: DataFrame) -> DataFrame:
    """events, with those of traces that only have spans (SPAN columns: trace_id, span_id, parent_span_id, ordinal, kind, agent, action) flattened from them, so that no trace leaves without its events."""
    lost = spans.join(events.select("trace_id").distinct(), "trace_id", "left_anti")
    flat = flatten_spans(lost).join(lost.select("trace_id", "span_id", "kind", "agent", "action").dropDuplicates(["trace_id", "span_id"]), ["trace_id", "span_id"])
    made = flat.select("trace_id", "idx", "id", admit_kind(F.col("kind"))[0].alias("kind"), "agent", "action", F.col("parent_id").alias("parent"))
    return events.select(*made.columns).unionByName(made)


def accept_proposal(proposals: DataFrame, accepted: DataFrame, mode_id: str) -> DataFrame:
    """accepted (code, name, definition, kinship) with the proposal (mode_id, name, definition, kinship) of that id, unless its code is there. An unknown id is an error."""
    found = proposals.where(F.col("mode_id") == mode_id).limit(1)
    if found.isEmpty():
        raise ValueError(f"no proposal {mode_id}")
    new = found.select(F.col("mode_id").alias("code"), "name", "definition", "kinship").join(accepted.select("code"), "code", "left_anti")
    return accepted.unionByName(new)


def run_report(rounds: DataFrame) -> DataFrame:
    """rounds (round, n_traces, n_failures, n_attributed, n_reruns, n_rerun_success, n_errors), one row a round -> one row: totals over rounds, traces and failures by round in order, and all that as JSON."""
    totals = ("n_traces", "n_failures", "n_attributed", "n_reruns", "n_rerun_success", "n_errors")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("round", c))), lambda x: x[c])
    r = rounds.agg(*(F.sum(c).alias(c) for c in totals), in_order("n_traces").alias("n_traces_by_round"), in_order("n_failures").alias("n_failures_by_round"))
    return r.withColumn("report", F.to_json(F.struct(*r.columns)))


def outcome_from_scores(traces: DataFrame, scores: DataFrame, name: str, op: str, wanted: str) -> DataFrame:
    """(trace_id, success): the latest score of that name compared with wanted; numbers as numbers where both are, ordered comparisons of anything else fail, and so does having none."""
    if op not in ("==", "!=", ">=", "<=", ">", "<"):
        raise ValueError(f"unknown operator {op}")
    last = scores.where(F.col("name") == name).groupBy("trace_id").agg(F.max_by(F.col("value").cast("string"), "timestamp").alias("v"))
    a, b = F.col("v").try_cast("double"), F.lit(wanted).try_cast("double")
    numeric = a.isNotNull() & b.isNotNull()
    compare = {"==": a == b, "!=": a != b, ">=": a >= b, "<=": a <= b, ">": a > b, "<": a < b}[op]
    text = {"==": F.col("v") == wanted, "!=": F.col("v") != wanted}.get(op, F.lit(False))
    return traces.select("trace_id").join(last, "trace_id", "left").select("trace_id", F.coalesce(F.when(numeric, compare).otherwise(text), F.lit(False)).alias("success"))


def pull_window(traces: DataFrame, tags: list[str], since, limit: int | None = None) -> DataFrame:
    """Traces that have all tags and are not before since, newest first up to the asked limit."""
    t = traces.where((F.size(F.array_except(F.array(*map(F.lit, tags)).cast("array<string>"), "tags")) == 0) & (F.col("timestamp") >= F.lit(since)))
    return t if limit is None else t.orderBy(F.col("timestamp").desc(), "trace_id").limit(limit)


def score_payloads(hyps: DataFrame, spans: DataFrame, run_id: str = "", longest: int = 500) -> DataFrame:
    """hyps with trace_id, agent, step, code, confidence (and algo, root_cause, if known) and spans (trace_id, step, span_id) -> payload rows in order: each blamed span once (highest confidence), then the confidence, and the root cause last: it is the marker that a trace is done.

    Columns: trace_id, observation_id, name, value, data_type, comment (cut at `longest`), metadata (agent, step, confidence, algo, run_id), emit_order.
    """
    known = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in hyps.columns else F.lit(default)
    h = hyps.withColumns({"_algo": known("algo", "tracewright"), "_why": known("root_cause", "")}).join(spans, ["trace_id", "step"], "left")
    text = lambda c: F.col(c).cast("string")
    said = F.concat("agent", F.lit(" @ step "), text("step"), F.lit(": "), "_why")
    run = f", run {run_id}" if run_id else ""
    meta = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in {"agent": F.col("agent"), "step": text("step"), "confidence": text("confidence"), "algo": F.col("_algo"), "run_id": F.lit(run_id or None).cast("string")}.items())), lambda e: e["v"].isNotNull()))
    row = lambda name, value, kind, comment, order, span=None: (
        "trace_id", (F.lit(None).cast("string") if span is None else span).alias("observation_id"), F.lit(name).alias("name"), value.alias("value"), F.lit(kind).alias("data_type"), F.substring(comment, 1, longest).alias("comment"), meta.alias("metadata"), order.alias("emit_order"))
    best = Window.partitionBy("trace_id").orderBy(F.col("confidence").desc(), "step", "agent")
    once = Window.partitionBy("trace_id", "span_id").orderBy(F.col("confidence").desc(), "step", "agent")
    blamed = h.where("span_id is not null").withColumn("_n", F.row_number().over(once)).where("_n = 1").withColumn("_o", F.row_number().over(best))
    blamed = blamed.select(*row("blamed-step", F.coalesce("code", F.lit("blamed")), "CATEGORICAL", said, F.col("_o"), F.col("span_id")))
    top = h.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    by = F.concat(F.lit("confidence of the top hypothesis (by "), "_algo", F.lit(f"{run})"))
    conf = top.select(*row("confidence", F.round("confidence", 4).cast("string"), "NUMERIC", by, F.lit(1_000_000)))
    root = top.select(*row("root-cause", F.coalesce("code", F.lit("unlabeled")), "CATEGORICAL", F.concat(said, F.lit(f" ({run[2:]})" if run else "")), F.lit(1_000_001)))
    return blamed.unionByName(conf).unionByName(root)


def skip_scored(traces: DataFrame, payloads: DataFrame, scores: DataFrame, force: bool = False, dry_run: bool = False) -> DataFrame:
    """(trace_id, decision): skipped where the marker is written already (unless forced), else no-hypotheses, else dry-run or written."""
    has = payloads.select("trace_id", F.lit(True).alias("_has")).distinct()
    done = scores.where("name = 'root-cause'").select("trace_id", F.lit(True).alias("_done")).distinct()
    j = traces.select("trace_id").join(has, "trace_id", "left").join(done, "trace_id", "left")
    return j.select("trace_id", F.when(F.col("_done") & F.lit(not force), "skipped").when(F.col("_has").isNull(), "no-hypotheses").otherwise("dry-run" if dry_run else "written").alias("decision"))


def score_tally(decisions: DataFrame, payloads: DataFrame) -> DataFrame:
    """One row: traces by decision (written, dry_run, skipped, no_hypotheses), and n_scores: payloads of the written or tried ones."""
    kinds = ("written", "dry-run", "skipped", "no-hypotheses")
    n = decisions.agg(*(F.count_if(F.col("decision") == k).alias(k.replace("-", "_")) for k in kinds))
    sent = payloads.join(decisions.where("decision in ('written', 'dry-run')"), "trace_id", "left_semi").agg(F.count("*").alias("n_scores"))
    return n.crossJoin(sent)  # one row each
