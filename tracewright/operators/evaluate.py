"""Evaluation against ground truth, run summaries, and audits of judge calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.model import FAULTS
from tracewright.operators.represent import collapse

#: Fields of ground truth that must not stand in a prompt.
TRUTH_FIELDS = ("injected_fault", "ground_truth", "qrels")


def first_codes(labels: DataFrame | None, findings: DataFrame | None) -> DataFrame | None:
    """(trace_id, code): the first of a trace's labels (trace_id, pos, code), else of its findings (trace_id, pos, code)."""
    parts = [d.select("trace_id", F.lit(k).alias("_k"), "pos", "code") for k, d in enumerate((labels, findings)) if d is not None]
    if not parts:
        return None
    return reduce(DataFrame.unionByName, parts).groupBy("trace_id").agg(F.min_by("code", F.struct("_k", "pos")).alias("label_code"))


def score_hypotheses(hyps: DataFrame, traces: DataFrame, labels: DataFrame | None = None, findings: DataFrame | None = None, recovered: DataFrame | None = None, improved: DataFrame | None = None) -> DataFrame:
    """Per trace with ground truth: the first hypothesis of highest confidence (algorithm, then rank; no tie break by step) against step and agent, and the first label's code, or without labels the first finding's, against the code; whether any recovery recovered it (trace_id, recovered), and whether its closed loop improved it (trace_id, improved). What isn't given is no hit."""
    w = Window.partitionBy("trace_id").orderBy(F.col("confidence").desc(), "algo", "rank")
    top = hyps.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("trace_id", "agent", "step")
    j = traces.where("gt_step is not null").select("trace_id", "gt_step", "gt_agent", "gt_code", "gt_kind").join(top, "trace_id", "left")
    codes = first_codes(labels, findings)
    j = j.withColumn("label_code", F.lit(None).cast("string")) if codes is None else j.join(codes, "trace_id", "left")
    for flag, given in (("recovered", recovered), ("improved", improved)):
        j = j.withColumn(flag, F.lit(False)) if given is None else j.join(given.groupBy("trace_id").agg(F.max(flag).alias(flag)), "trace_id", "left")
    hit = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("recovered", "improved")]
    return j.select("trace_id", "gt_kind", hit("step", "gt_step").alias("step_hit"), hit("agent", "gt_agent").alias("agent_hit"), hit("label_code", "gt_code").alias("code_hit"), *flags)


def rollup_by_kind(scores: DataFrame) -> DataFrame:
    """Hits and recoveries per kind of fault, and in total."""
    n = lambda c: F.sum(F.col(c).cast("long"))
    hits = {"step_hits": "step_hit", "agent_hits": "agent_hit", "code_hits": "code_hit", "recovered": "recovered", "improved": "improved"}
    r = scores.rollup("gt_kind").agg(F.count("*").alias("total"), *(n(c).alias(name) for name, c in hits.items()), F.grouping("gt_kind").alias("_g"))
    return r.select(F.when(F.col("_g") == 1, "total").otherwise(F.col("gt_kind")).alias("kind"), "total", *hits)


def compare_stacks(stacks: dict[str, DataFrame | dict[str, DataFrame]], traces: DataFrame) -> DataFrame:
    """One row per configuration on the same traces: totals of rollup_by_kind(), n_calls, calls_by_tag (tag=n, by tag) and errors.

    A stack is its hypotheses, or a dict of hyps and any of labels, findings, recovered, improved (as for score_hypotheses()), calls (tag), errors (a row each), and traces. A stack whose own traces are not the given ones is an error: hits would not compare.
    """
    out = []
    for name, stack in sorted(stacks.items()):
        given = {"hyps": stack} if isinstance(stack, DataFrame) else dict(stack)
        own, calls, errors = (given.pop(k, None) for k in ("traces", "calls", "errors"))
        if own is not None:
            a, b = own.select("trace_id"), traces.select("trace_id")
            if not a.join(b, "trace_id", "left_anti").isEmpty() or not b.join(a, "trace_id", "left_anti").isEmpty():
                raise ValueError(f"stack {name} ran on other traces")
        row = rollup_by_kind(score_hypotheses(traces=traces, **given)).where("kind = 'total'").drop("kind").withColumn("config", F.lit(name))
        tags = None if calls is None else calls.groupBy("tag").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_calls"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tag", "n"))), lambda t: F.concat(t["tag"], F.lit("="), t["n"].cast("string"))), ",").alias("calls_by_tag"))
        row = row.withColumns({"n_calls": F.lit(0).cast("long"), "calls_by_tag": F.lit("")}) if tags is None else row.crossJoin(tags)  # one row each
        row = row.withColumn("errors", F.lit(0).cast("long")) if errors is None else row.crossJoin(errors.agg(F.count("*").alias("errors")))
        out.append(row)
    return reduce(DataFrame.unionByName, out)


def baseline_gate(rows: DataFrame, baseline: DataFrame, metrics: tuple[str, ...] = ("step_hits", "agent_hits", "code_hits")) -> DataFrame:
    """(config, metric, value, least, ok) of configurations that both have; metrics of others are ignored. Where rows have a column errors, each row must have none, with a baseline or without."""
    long = lambda d, c: d.select("config", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias(c)) for m in metrics))).alias("m")).select("config", "m.*")
    out = long(rows, "value").join(long(baseline, "least"), ["config", "metric"])
    if "errors" in rows.columns:
        out = out.unionByName(rows.select("config", F.lit("errors").alias("metric"), F.coalesce(F.col("errors").cast("long"), F.lit(0)).alias("value"), F.lit(0).cast("long").alias("least")))
    return out.withColumn("ok", F.when(F.col("metric") == "errors", F.col("value") == 0).otherwise(F.col("value") >= F.col("least")))


def run_summary(traces: DataFrame, hyps: DataFrame, reruns: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row: traces, failures, traces with a hypothesis, reruns and those that succeeded, and, if given, error rows."""
    t = traces.agg(F.count("*").alias("n_traces"), F.sum((~F.col("success")).cast("long")).alias("n_failed"))
    h = hyps.agg(F.countDistinct("trace_id").alias("n_attributed"))
    r = reruns.agg(F.count("*").alias("n_reruns"), F.coalesce(F.sum(F.col("success").cast("long")), F.lit(0)).alias("n_rerun_ok"))
    out = t.join(h).join(r)  # one row each
    return out if errors is None else out.join(errors.agg(F.count("*").alias("n_errors")))


def run_rounds(rounds: dict[int, tuple[DataFrame, DataFrame, DataFrame, DataFrame]]) -> DataFrame:
    """run_summary() of every round (traces, hypotheses, reruns, errors), and their sum with round null."""
    each = reduce(DataFrame.unionByName, [run_summary(*tables).withColumn("round", F.lit(k)) for k, tables in sorted(rounds.items())])
    names = [c for c in each.columns if c != "round"]
    return each.rollup("round").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))


def call_metrics(calls: DataFrame) -> DataFrame:
    """calls (tag, ok, http_requests, latency_ms, tokens, and prompt_tokens, completion_tokens if known) -> per tag: rates, positional latency percentiles sorted[int(q n)], token sums. A call without a count of requests made one, one without a latency took none, one without tokens used none. Calls are counted by latency first, so what is ordered within a tag are its different latencies."""
    parts = [c for c in ("prompt_tokens", "completion_tokens") if c in calls.columns]
    some = lambda c, least: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, least).otherwise(F.col(c))
    calls = calls.withColumns({"http_requests": some("http_requests", 1), "latency_ms": some("latency_ms", 0), "ok": F.coalesce("ok", F.lit(False)), **{c: F.coalesce(c, F.lit(0)) for c in ("tokens", *parts)}})
    per = calls.groupBy("tag", "latency_ms").agg(*(F.sum(c).alias(c) for c in parts), F.count("*").alias("k"), F.sum(F.col("ok").cast("long")).alias("ok"), F.sum("http_requests").alias("http"), F.sum((F.col("http_requests") > 1).cast("long")).alias("repaired"), F.sum("tokens").alias("tokens"))
    tag = Window.partitionBy("tag")
    per = per.withColumns({"upto": F.sum("k").over(tag.orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "n": F.sum("k").over(tag)})
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.floor(q * F.col("n")), F.col("n") - 1), F.col("latency_ms")))
    n = F.sum("k")
    return per.groupBy("tag").agg(n.alias("n_calls"), (F.sum("ok") / n).alias("ok_rate"), (F.sum("http") / n).alias("http_per_call"), (F.sum("repaired") / n).alias("repair_rate"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("latency_ms").alias("latest"), F.sum("tokens").alias("tokens"), *(F.sum(c).alias(c) for c in parts))


def tag_drift(calls: DataFrame, plan: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """Calls per tag against plan (tag, planned); a tag outside the tolerance, or unplanned, drifts."""
    n = calls.groupBy("tag").agg(F.count("*").alias("n_calls"))
    j = n.join(plan, "tag", "full_outer").fillna(0, ["n_calls"])
    return j.select("tag", "n_calls", "planned", F.coalesce(F.abs(F.col("n_calls") - F.col("planned")) > tolerance * F.col("planned"), F.lit(True)).alias("drifts"))


def leak_scan(calls: DataFrame, words: tuple[str, ...] = (*FAULTS, *TRUTH_FIELDS), environment: tuple[str, ...] = ("feedback_match",), shown: int = 10) -> DataFrame:
    """calls (tag, prompt, response, and record: its number or name, if known) -> (place, tag, word, n_calls, and records: the first few of them) of forbidden words, as they are written: place is prompt, environment for the prompts of tags that the environment itself sends, or response. Only prompt counts against a run."""
    found = lambda c: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))
    known = [c for c in ("record",) if c in calls.columns]
    asked = calls.select(*known, F.when(F.col("tag").isin(*environment), "environment").otherwise("prompt").alias("place"), "tag", F.explode(found("prompt")).alias("word"))
    said = calls.select(*known, F.lit("response").alias("place"), "tag", F.explode(found("response")).alias("word"))
    key = ["place", "tag", "word"]
    hits = asked.unionByName(said)
    out = hits.groupBy(*key).agg(F.count("*").alias("n_calls"))
    if not known:
        return out
    few = hits.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("record"))).where(F.col("_n") <= shown).groupBy(*key).agg(F.sort_array(F.collect_list("record")).alias("records"))
    return out.join(few, key)


def claim_coverage(claims: DataFrame, traces: DataFrame) -> DataFrame:
    """Whether a claim of the trace spans its ground-truth step, from where it is introduced to where it first takes effect (to the end if it never does)."""
    gt = traces.where("gt_step is not null").select("trace_id", "gt_step")
    j = gt.join(claims.select("trace_id", "introduced", "effective"), "trace_id", "left")
    return j.groupBy("trace_id").agg(F.coalesce(F.max(F.col("gt_step").between(F.col("introduced"), F.coalesce("effective", "gt_step"))), F.lit(False)).alias("covered"))


#: Dollars for a million tokens in and out, and what a call of each method costs beside the trace: preamble in, answer out.
PRICES = {"cheap": (0.15, 0.60), "frontier": (2.50, 10.00)}
CALL_TOKENS = {"single_pass": (1200, 150), "bisection": (130, 10)}


def cost_estimate(views: DataFrame, events: DataFrame, prices: dict[str, tuple[float, float]] = PRICES) -> DataFrame:
    """(method, preset, n_calls, in_tokens, out_tokens, usd) of a single pass and of bisection over rendered traces (trace_id, view). A token is four characters, at least one a trace; bisection reads each trace twice over in ceil(log2 n) calls, at least one."""
    n = events.groupBy("trace_id").agg(F.count("*").alias("n"))
    j = views.join(n, "trace_id").select(F.greatest(F.lit(1), F.floor(F.length("view") / 4)).alias("tokens"), F.greatest(F.lit(1), F.ceil(F.log2("n"))).alias("rounds"))
    single, halves = CALL_TOKENS["single_pass"], CALL_TOKENS["bisection"]
    row = lambda name, calls, into, out: F.struct(F.lit(name).alias("method"), calls.cast("long").alias("n_calls"), into.cast("long").alias("in_tokens"), out.cast("long").alias("out_tokens"))
    all_ = j.agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.sum("rounds").alias("r"))
    both = F.array(row("single_pass", F.col("n"), F.col("t") + single[0] * F.col("n"), single[1] * F.col("n")), row("bisection", F.col("r"), 2 * F.col("t") + halves[0] * F.col("r"), halves[1] * F.col("r")))
    priced = F.array(*(F.struct(F.lit(k).alias("preset"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in prices.items()))
    out = all_.select(F.explode(both).alias("m")).select("m.*", F.explode(priced).alias("p"))
    return out.select("method", "p.preset", "n_calls", "in_tokens", "out_tokens", F.round(F.col("in_tokens") / 1e6 * F.col("p.a") + F.col("out_tokens") / 1e6 * F.col("p.b"), 6).alias("usd"))


def trace_summaries(events: DataFrame, traces: DataFrame, hyps: DataFrame) -> DataFrame:
    """One line per trace: outcome, events, and what each algorithm says (cut at 160)."""
    n = events.groupBy("trace_id").agg(F.count("*").alias("n_events"))
    line = F.substring(collapse(F.concat_ws(" ", "algo", "agent", F.col("step").cast("string"), "code")), 1, 160)
    h = hyps.where("rank = 1").groupBy("trace_id").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"))
    return traces.select("trace_id", "success").join(n, "trace_id").join(h, "trace_id", "left").withColumn("lines", F.coalesce("lines", F.lit("")))


STAGES = ("represent", "analyze", "classify", "attribute", "recover")


def bundle_summaries(events: DataFrame, traces: DataFrame, artifacts: DataFrame, reruns: DataFrame) -> DataFrame:
    """(trace_id, summary): the trace and the start of its task, its outcome and number of events, one line per artifact (trace_id, stage, name, json; by stage and name, 160 characters of it), one per rerun (rerun_of, trace_id, success)."""
    n = events.groupBy("trace_id").agg(F.count("*").alias("n"))
    stage = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    one = artifacts.select("trace_id", F.lit(0).alias("o"), stage.alias("k"), F.col("name").alias("by"), F.concat(F.lit("  artifact "), "stage", F.lit("/"), "name", F.lit(": "), F.substring("json", 1, 160)).alias("line"))
    again = reruns.select(F.col("rerun_of").alias("trace_id"), F.lit(1).alias("o"), F.lit(0).cast("long").alias("k"), F.col("trace_id").alias("by"), F.concat(F.lit("  rerun "), "trace_id", F.lit(": "), F.when(F.col("success"), "success").otherwise("FAILURE")).alias("line"))
    lines = one.unionByName(again).groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "k", "by", "line"))), lambda x: x["line"]).alias("lines"))
    j = traces.select("trace_id", "task", "success").join(n, "trace_id", "left").join(lines, "trace_id", "left")
    head = F.array(F.concat(F.lit("trace="), "trace_id", F.lit(" task='"), F.substring("task", 1, 60), F.lit("'")), F.concat(F.lit("outcome=("), F.when(F.col("success"), "success").otherwise("FAILURE"), F.lit(") events="), F.coalesce("n", F.lit(0)).cast("string")))
    return j.select("trace_id", F.array_join(F.concat(head, F.coalesce("lines", F.array().cast("array<string>"))), "\n").alias("summary"))


def error_tally(errors: DataFrame) -> DataFrame:
    """errors (stage, name, trace_id, error) -> per algorithm: rows and traces."""
    return errors.groupBy("stage", "name").agg(F.count("*").alias("n_errors"), F.countDistinct("trace_id").alias("n_traces"))


def stage_log(logs: list[DataFrame], errors: list[DataFrame], examples: int = 3, width: int = 120) -> DataFrame:
    """Per algorithm: traces processed and failed (of quarantine logs), those that came through, and a line that says so with the first few failures by trace."""
    log = reduce(DataFrame.unionByName, logs)
    e = reduce(DataFrame.unionByName, errors)
    place = F.row_number().over(Window.partitionBy("stage", "name").orderBy("trace_id"))
    few = e.withColumn("_n", place).where(F.col("_n") <= examples)
    few = few.groupBy("stage", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.concat(F.coalesce("trace_id", F.lit("?")), F.lit(": "), F.substring("error", 1, width)).alias("s")))), lambda x: x["s"]), "; ").alias("_said"))
    j = log.join(few, ["stage", "name"], "left").withColumn("ok", F.col("processed") - F.col("failed"))
    line = F.concat("stage", F.lit("/"), "name", F.lit(" -> "), F.when(F.col("failed") > 0, F.concat(F.col("ok").cast("string"), F.lit("/"))).otherwise(F.lit("")), F.col("processed").cast("string"), F.lit(" traces"), F.when(F.col("failed") > 0, F.concat(F.lit("; "), F.col("failed").cast("string"), F.lit(" isolated: "), "_said")).otherwise(F.lit("")))
    return j.select("stage", "name", "processed", "failed", "ok", line.alias("line"))


def scorecard(hyps: DataFrame, traces: DataFrame, labels: DataFrame | None = None, votes: DataFrame | None = None) -> DataFrame:
    """(metric, hits, total) over traces with ground truth: step, agent and code (where it has one) of each algorithm's first hypothesis; of labels (trace_id, codes in order) the first and any; of votes (trace_id, trial, label, recovered) the first trial's label and whether any recovered."""
    truth = traces.where("gt_step is not null").select("trace_id", "gt_step", "gt_agent", "gt_code")
    w = Window.partitionBy("trace_id", "algo").orderBy(F.col("confidence").desc(), "rank")
    top = hyps.withColumn("_n", F.row_number().over(w)).where("_n = 1").join(truth, "trace_id")
    one = lambda name, hit, when=None: F.when(F.lit(True) if when is None else when, F.struct((F.lit(name) if isinstance(name, str) else name).alias("metric"), F.coalesce(hit, F.lit(False)).alias("hit")))
    of = lambda what: F.concat("algo", F.lit(" " + what))
    parts = [top.select(F.explode(F.array(one(of("step"), F.col("step") == F.col("gt_step")), one(of("agent"), F.col("agent") == F.col("gt_agent")), one(of("code"), F.col("code") == F.col("gt_code"), F.col("code").isNotNull()))).alias("m"))]
    if labels is not None:
        parts.append(labels.join(truth, "trace_id").select(F.explode(F.array(one("labels primary", F.get("codes", F.lit(0)) == F.col("gt_code")), one("labels any", F.array_contains("codes", F.col("gt_code"))))).alias("m")))
    if votes is not None:
        v = votes.join(truth.select("trace_id"), "trace_id").groupBy("trace_id").agg(F.min_by("label", "trial").alias("label"), F.max("recovered").alias("recovered"))
        parts.append(v.select(F.explode(F.array(one("votes validated", F.col("label") == "Validated"), one("votes recovered", F.col("recovered")))).alias("m")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.where("m is not null").groupBy("m.metric").agg(F.count_if("m.hit").alias("hits"), F.count("*").alias("total"))
