"""Attribution of failures to an agent and a step. Every attributor gives hypotheses (trace_id, algo, rank, agent, step, code, confidence)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.answers import first_valid
from tracewright.model import ASSERTION, CLAUSE_END, DOC_ID, ERROR_OBS, HARMFUL, MECHANISM, MECHANISMS, MEMORY, NEGATION, NO_RESULT, NOTHING_USABLE, STAGE_ERROR, STEP_KINDS, SUPPORT_LEVELS, SUPPORT_VERDICTS, SYMPTOM_FIX
from tracewright.operators.classify import primary_symptom, symptoms, witnesses
from tracewright.operators.represent import before, by_trace, stage_ranges, step_summaries, subtasks, upto, with_subtask
from tracewright.tables import durable_by


def hypotheses(df: DataFrame, algo: str, code: Column, confidence: Column, rank: Column | None = None) -> DataFrame:
    return df.select("trace_id", F.lit(algo).alias("algo"), (F.lit(1) if rank is None else rank).cast("int").alias("rank"), "agent", F.col("step").cast("int").alias("step"), code.cast("string").alias("code"), confidence.cast("double").alias("confidence"))


def episodes(events: DataFrame, traces: DataFrame) -> DataFrame:
    """Search episodes of each trace: (trace_id, k, start_idx, agent, found, new, utility, gold_hit). Reads before the first search open an episode of their own. A document is new in the first episode that shows it."""
    search = (F.col("kind") == "TOOL_CALL") & (F.col("action") == "search")
    read = (F.col("kind") == "TOOL_CALL") & (F.col("action") == "read_doc") & F.coalesce(F.col("doc_id").rlike(r"^d\d+$"), F.lit(False))
    e = events.withColumns({"n": F.sum(search.cast("int")).over(upto()), "_read": read, "_search": search})
    early = e.withColumn("early", F.max((F.col("_read") & (F.col("n") == 0)).cast("int")).over(Window.partitionBy("trace_id")))
    k = F.col("n") - 1 + F.col("early")
    e = early.withColumn("k", k).where("n > 0 or (n = 0 and early = 1 and _read)")
    opens = F.col("_search") | (F.col("_read") & (F.col("n") == 0))
    start = e.where(opens).groupBy("trace_id", "k").agg(F.min("idx").alias("start_idx"), F.min_by("agent", "idx").alias("agent"))
    shown = F.when(F.col("_read"), F.array("doc_id")).when((F.col("kind") == "TOOL_RESULT") & (F.col("action") == "search"), F.filter(F.transform(F.split(F.regexp_extract("content", r"docs\s*\[([^\]]*)\]", 1), ","), lambda d: F.trim(d)), lambda d: d != ""))
    docs = e.withColumn("doc", F.explode(shown)).select("trace_id", "k", "doc").distinct()
    q = traces.select("trace_id", "evidence", "gold")
    docs = docs.join(q, "trace_id").where(F.array_contains("evidence", F.col("doc"))).withColumn("first", F.min("k").over(Window.partitionBy("trace_id", "doc")) == F.col("k"))
    per = docs.groupBy("trace_id", "k").agg(F.count("*").alias("found"), F.sum(F.col("first").cast("long")).alias("new"), F.max(F.array_contains("gold", F.col("doc"))).alias("gold_hit"), F.collect_set("doc").alias("docs"))
    out = start.join(per, ["trace_id", "k"], "left").withColumns({"found": F.coalesce("found", F.lit(0)), "new": F.coalesce("new", F.lit(0)), "gold_hit": F.coalesce("gold_hit", F.lit(False))})
    return out.withColumn("utility", F.when(F.col("new") > 0, "productive").when(F.col("found") > 0, "redundant").otherwise("unproductive"))


#: What a gap calls for, and why a spectrum says little.
PRESCRIPTION = {"RG": "switch query formulation", "UG": "stop at saturation / enforce grounded citation"}
DEGENERATE = {"no_success": "no successful trajectory in the group: the spectrum is degenerate", "single": "only 1 trajectory in the group: the spectrum is degenerate"}


def gap_labels(events: DataFrame, traces: DataFrame) -> DataFrame:
    """Retrieval or utilization gap of each trace, with its counts and what it calls for. A trace without relevance judgements (evidence, gold) is an error: nothing can be said of it."""
    ep = episodes(events, traces)
    agg = ep.groupBy("trace_id").agg(
        F.count("*").alias("m"), F.max(F.when(F.col("new") > 0, F.col("k"))).alias("k_star"), F.min(F.when(F.col("gold_hit"), F.col("start_idx"))).alias("first_gold_hit"), F.array_distinct(F.flatten(F.collect_list("docs"))).alias("c_m"),
    )
    reads = events.where("kind = 'TOOL_CALL' and action = 'read_doc'").where(F.col("doc_id").rlike(r"^d\d+$")).join(traces.select("trace_id", "evidence"), "trace_id")
    reads = reads.groupBy("trace_id").agg(F.round(F.avg(F.array_contains("evidence", F.col("doc_id")).cast("double")), 4).alias("visit_precision"))
    j = traces.select("trace_id", "success", "gold", "evidence").join(agg, "trace_id", "left").join(reads, "trace_id", "left")
    j = j.withColumns({"m": F.coalesce("m", F.lit(0)), "c_m": F.coalesce("c_m", F.array().cast("array<string>"))}).withColumn("g", F.array_intersect("c_m", "gold"))
    unjudged = F.raise_error(F.concat(F.lit("no relevance judgements for trace "), "trace_id")).cast("string")
    label = F.when(F.col("evidence").isNull() | F.col("gold").isNull(), unjudged).when(F.col("success"), "correct").when(F.size("g") == 0, F.when(F.size("c_m") == 0, "RG_directional").otherwise("RG_last_hop")).when(F.size("g") == F.size("gold"), "UG_true_extraction").otherwise("UG_boundary")
    j = j.withColumn("label", label)
    cure = F.when(F.col("label").startswith("RG"), PRESCRIPTION["RG"]).when(F.col("label").startswith("UG"), PRESCRIPTION["UG"])
    return j.select("trace_id", "label", "m", "k_star", F.when(F.col("k_star").isNull(), F.col("m")).otherwise(F.col("m") - 1 - F.col("k_star")).alias("wasted_tail"), "visit_precision", "first_gold_hit", cure.alias("prescription"))


def gap_hypotheses(events: DataFrame, traces: DataFrame) -> DataFrame:
    """Retrieval gaps at the first search (else the first decision, else the first event); utilization gaps at the first contradiction after the first gold hit, else the last decision after it, else the last acting event."""
    labels = durable_by(gap_labels(events, traces).where("label like 'RG%' or label like 'UG%'").select("trace_id", "label", "first_gold_hit"), "trace_id")
    pick = lambda c, by=F.min_by: by(F.when(c, F.struct("idx", "agent")), F.when(c, F.col("idx")))
    e = events.join(labels, "trace_id").withColumn("_after", F.coalesce(F.col("idx") > F.col("first_gold_hit"), F.lit(True)))
    talk = F.col("_after") & F.col("kind").isin("HANDOFF", "AGENT_MESSAGE", "LLM_CALL") & (F.coalesce("action", F.lit("")) != "search")
    per = e.groupBy("trace_id").agg(
        F.first("label").alias("label"), pick((F.col("kind") == "TOOL_CALL") & F.coalesce(F.col("action") == "search", F.lit(False))).alias("s"), pick(F.col("kind") == "LLM_CALL").alias("l"), pick(F.lit(True)).alias("e"), pick((F.col("agent") != "env") & (F.col("kind") != "VERIFIER"), F.max_by).alias("a"),
        pick(talk & F.col("content").rlike(NO_RESULT)).alias("w"), pick(talk & (F.col("kind") == "LLM_CALL"), F.max_by).alias("d"),
    )
    reads = events.where("kind = 'TOOL_CALL' and action = 'read_doc'").groupBy("trace_id", F.col("doc_id").alias("doc")).agg(F.min("idx").alias("read_at"))
    cited = e.where("label like 'UG%'").where(talk & F.col("content").rlike(ASSERTION)).select("trace_id", "idx", "agent", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(DOC_ID), F.lit(0)))).alias("doc"))
    cited = cited.join(reads, ["trace_id", "doc"], "left").where("read_at is null or read_at > idx").groupBy("trace_id").agg(F.min_by(F.struct("idx", "agent"), "idx").alias("c"))
    t = per.join(cited, "trace_id", "left").withColumn("t", F.when(F.col("label").startswith("RG"), F.coalesce("s", "l", "e")).otherwise(F.coalesce(F.least("w", "c"), "d", "a", "e")))
    code = F.when(F.col("label").startswith("RG"), "retrieval_gap").otherwise("utilization_gap")
    return hypotheses(t.select("trace_id", "label", F.col("t.idx").alias("step"), F.col("t.agent").alias("agent")), "rg_ug", code, F.lit(1.0))


UNIT = ["agent", "action_class", "target"]


def _acting(sigs: DataFrame) -> DataFrame:
    return sigs.where("agent not in ('verifier', 'env')").withColumn("target", F.coalesce("target", F.lit("")))


def spectrum(sigs: DataFrame, traces: DataFrame, lam: float = 0.9) -> DataFrame:
    """Suspicion of every unit (agent, action, target) of a task. Units are counted per trace first, so the shuffle by task carries counts only."""
    return _suspicion(_acting(sigs).groupBy("trace_id", *UNIT).agg(F.count("*").alias("f")), traces, lam)


def _suspicion(units: DataFrame, traces: DataFrame, lam: float) -> DataFrame:
    """spectrum() of units counted per trace (trace_id, agent, action_class, target, f)."""
    if not 0.5 < lam < 1:
        raise ValueError("lam must lie between 0.5 and 1")
    t = traces.select("trace_id", "task_id", "success").where("coalesce(task_id, '') <> ''")
    f = units.join(t, "trace_id")
    decay = F.pow(F.lit(lam), F.col("f") - 1)
    u = f.groupBy("task_id", *UNIT).agg(
        F.sum(F.when(~F.col("success"), decay).otherwise(0.0)).alias("n_cf"), F.sum(F.when(F.col("success"), decay).otherwise(0.0)).alias("n_cs"), F.sum((~F.col("success")).cast("long")).alias("fails"), F.count("*").alias("nc"), F.sum("f").alias("fu"),
    )
    ag = f.groupBy("task_id", "agent", "trace_id").agg(F.sum("f").alias("f")).groupBy("task_id", "agent").agg(F.count("*").alias("nc_agent"), F.sum("f").alias("f_agent"))
    n = t.groupBy("task_id").agg(F.sum((~F.col("success")).cast("long")).alias("n_failed"))
    u = u.join(ag, ["task_id", "agent"]).join(n, "task_id").withColumn("n_uf", F.col("n_failed") - F.col("fails"))
    part = lambda other: F.when(F.col("n_cf") + F.col(other) > 0, F.col("n_cf") / (F.col("n_cf") + F.col(other))).otherwise(0.0)
    kul = 0.5 * (part("n_uf") + part("n_cs"))
    u = u.withColumns({"kul": kul, "gamma": F.col("nc") / F.col("nc_agent"), "beta": F.col("fu") / F.col("f_agent")})
    return u.select("task_id", *UNIT, "n_cf", "n_cs", "n_uf", "kul", "gamma", "beta", (F.col("kul") * (1 + F.col("beta")) * (1 + F.col("gamma"))).alias("base"))


def spectrum_notes(traces: DataFrame) -> DataFrame:
    """(task_id, n_traces, n_passed, notes): what makes a task's spectrum degenerate, joined by '; '; empty if nothing does."""
    n = traces.groupBy("task_id").agg(F.count("*").alias("n_traces"), F.count_if("success").alias("n_passed"))
    notes = F.filter(F.array(F.when(F.col("n_passed") == 0, DEGENERATE["no_success"]), F.when(F.col("n_traces") == 1, DEGENERATE["single"])), lambda x: x.isNotNull())
    return n.withColumn("notes", F.array_join(notes, "; "))


def spectrum_ranking(sigs: DataFrame, traces: DataFrame, lam: float = 0.9, top_k: int = 5) -> DataFrame:
    """Top units of every failed trace by suspicion; the step is the unit's second occurrence if it repeats."""
    failed = traces.where("not success").select("trace_id", "task_id")
    w = Window.partitionBy("trace_id", *UNIT).orderBy("idx")
    units = _acting(sigs).withColumn("nth", F.row_number().over(w)).groupBy("trace_id", *UNIT).agg(F.count("*").alias("f"), F.min("idx").alias("first"), F.min(F.when(F.col("nth") == 2, F.col("idx"))).alias("second"))
    units = durable_by(units, "trace_id")
    f = units.join(failed, "trace_id").join(_suspicion(units.select("trace_id", *UNIT, "f"), traces, lam).select("task_id", *UNIT, "base"), ["task_id", *UNIT])
    f = f.withColumn("score", (1 + F.log("f") / math.log(1 / lam)) * F.col("base"))
    f = f.withColumn("rank", F.row_number().over(Window.partitionBy("trace_id").orderBy(F.round("score", 9).desc(), "first"))).where(F.col("rank") <= top_k)
    return f.select("trace_id", "rank", *UNIT, F.coalesce("second", "first").alias("step"), "score")


def single_pass(events: DataFrame) -> DataFrame:
    """The primary symptom of every trace; 0.3 for the fallback, else 0.7."""
    p = primary_symptom(symptoms(events))
    return hypotheses(p, "single_pass", F.col("code"), F.when(F.col("fault") == "unknown", 0.3).otherwise(0.7))


def clamp_verdicts(verdicts: DataFrame, events: DataFrame, modes: DataFrame) -> DataFrame:
    """verdicts (trace_id, response: an answer with JSON {agent, step, code, confidence} in it) -> hypotheses; step clamped into the trace, unknown agents to its first, unknown codes to null, each with a note."""
    v = verdicts.withColumn("v", first_valid(F.col("response"), "agent string, step int, code string, confidence double", lambda v: v["step"].isNotNull() & v["agent"].isNotNull()))
    n = events.groupBy("trace_id").agg((F.max("idx")).alias("last"), F.min_by("agent", "idx").alias("first_agent"), F.collect_set("agent").alias("agents"))
    m = modes.select(F.col("code").alias("_code"))
    j = v.join(n, "trace_id").join(m, F.col("v.code") == F.col("_code"), "left")
    step = F.greatest(F.lit(0), F.least("last", "v.step"))
    known = F.array_contains("agents", F.col("v.agent"))
    notes = F.array_join(F.filter(F.array(F.when(step != F.col("v.step"), "step clamped"), F.when(~F.coalesce(known, F.lit(False)), "agent unknown"), F.when(F.col("v.code").isNotNull() & F.col("_code").isNull(), "code unknown")), lambda x: x.isNotNull()), "; ")
    return j.select("trace_id", F.when(known, F.col("v.agent")).otherwise(F.col("first_agent")).alias("agent"), step.alias("step"), F.col("_code").alias("code"), F.col("v.confidence").alias("confidence"), notes.alias("notes"))


def bisect(events: DataFrame, traces: DataFrame) -> DataFrame:
    """Step of every failed trace by bisection: the range is halved downwards where the lower half shows a symptom of its own, else upwards.

    What a segment shows is known from witnesses(), found once: all rounds of a trace are look-ups in its own array, in one job for all traces. Of witnesses with the same first part only the earliest end counts.
    """
    failed = events.join(traces.where("not success").select("trace_id"), "trace_id", "left_semi")
    seen = witnesses(failed).groupBy("trace_id", "lo_min", "lo_max").agg(F.min("hi_min").alias("hi_min")).groupBy("trace_id").agg(F.collect_list(F.struct("lo_min", "lo_max", "hi_min")).alias("w"))
    j = failed.groupBy("trace_id").agg(F.max("idx").cast("int").alias("last")).join(seen, "trace_id", "left")
    j = j.withColumn("w", F.coalesce("w", F.array().cast("array<struct<lo_min:int,lo_max:int,hi_min:int>>")))

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        low = F.exists("w", lambda x: (x["lo_min"] <= s["lo"]) & (s["lo"] <= x["lo_max"]) & (x["hi_min"] <= mid))
        down, up = F.struct(s["lo"].alias("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).when(low, down).otherwise(up)

    rounds = F.greatest(F.lit(1), F.ceil(F.log2(F.col("last") + 1)) + 1).cast("int")
    end = F.aggregate(F.sequence(F.lit(1), rounds), F.struct(F.lit(0).alias("lo"), F.col("last").alias("hi")), halve)
    return j.select("trace_id", end["lo"].alias("step"))


def walk_back(events: DataFrame, steps: DataFrame) -> DataFrame:
    """Agent of a step: its own if it acts, else that of the nearest acting event before, else its own."""
    acts = F.col("kind").isin("LLM_CALL", "TOOL_CALL", "HANDOFF", "AGENT_MESSAGE")
    nearest = F.last(F.when(acts, F.col("agent")), ignorenulls=True).over(before())
    e = events.select("trace_id", F.col("idx").alias("step"), F.when(acts, F.col("agent")).otherwise(F.coalesce(nearest, "agent")).alias("agent"))
    return steps.join(e, ["trace_id", "step"])


def parse_half(text: Column) -> Column:
    """'lower' or 'upper' half from an answer that names just one of them, else null; the other one if the first clause that names it denies it. What other clauses deny doesn't count."""
    low = F.lower(text)
    lower, upper = F.contains(low, F.lit("lower")), F.contains(low, F.lit("upper"))
    word = F.when(lower, "lower").otherwise("upper")
    clause = F.get(F.filter(F.split(low, CLAUSE_END), lambda c: F.contains(c, word)), F.lit(0))
    return F.when(lower != upper, F.when(clause.rlike(NEGATION), F.when(lower, "upper").otherwise("lower")).otherwise(word))


def half_answer(text: Column) -> Column:
    """struct<half, negated, fault>: parse_half() with whether a denial turned it, and 'unparseable' where it names neither half or both."""
    half, low = parse_half(text), F.lower(F.coalesce(text, F.lit("")))
    named = F.when(F.contains(low, F.lit("lower")), "lower").otherwise("upper")
    return F.struct(half.alias("half"), F.when(half.isNotNull(), half != named).alias("negated"), F.when(half.isNull(), "unparseable").alias("fault"))


def claim_support(claims: DataFrame, events: DataFrame) -> DataFrame:
    """Support and verdict of each claim (trace_id, claim_id, text, claim_type, introduced): support_status, verdict, responsible_step.

    Processes support themselves. A constraint is met if the first submit cites documents, all of them read at some time; else the last decision before that submit is responsible. A denial of results conflicts with documents that any search showed. Other claims need one cited document that was read before; those that cite none must not be from memory.
    """
    call = lambda a: f"kind = 'TOOL_CALL' and action = '{a}'"
    ids = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(DOC_ID), F.lit(0)))
    reads = events.where(call("read_doc")).select("trace_id", "idx", F.get(ids(F.col("doc_id")), F.lit(0)).alias("doc")).where("doc is not null").groupBy("trace_id", "doc").agg(F.min("idx").alias("read_at"))
    shown = events.where("kind = 'TOOL_RESULT' and action = 'search'").where(F.size(ids(F.col("content"))) > 0).select("trace_id").distinct().withColumn("shown", F.lit(True))
    first = events.where(call("submit")).groupBy("trace_id").agg(F.min_by(F.struct("idx", F.concat_ws(" ", "query", "doc_id", "answer", "to_agent").alias("load")), "idx").alias("submit"))
    cited = first.select("trace_id", F.explode(ids(F.col("submit.load"))).alias("doc")).join(reads, ["trace_id", "doc"], "left").groupBy("trace_id").agg(F.min(F.col("read_at").isNotNull()).alias("all_read"))
    decided = events.where("kind = 'LLM_CALL'").select("trace_id", "idx").join(first, "trace_id").where("idx < submit.idx").groupBy("trace_id").agg(F.max("idx").alias("decided"))
    named = claims.select("trace_id", "claim_id", "introduced", F.explode(ids(F.col("text"))).alias("doc")).join(reads, ["trace_id", "doc"], "left")
    named = named.groupBy("trace_id", "claim_id").agg(F.max(F.coalesce(F.col("read_at") < F.col("introduced"), F.lit(False))).alias("grounded"))
    j = claims.join(named, ["trace_id", "claim_id"], "left")
    for more in (shown, first, cited, decided):
        j = j.join(more, "trace_id", "left")
    said = lambda support, verdict, step=None: F.struct(F.lit(support).alias("support_status"), F.lit(verdict).alias("verdict"), (F.lit(None) if step is None else step).cast("int").alias("responsible_step"))
    fine, harmful = said("DIRECT", "supported"), said("MISSING", "harmful_unsupported_commitment", F.col("introduced"))
    limit = F.col("claim_type") == "constraint"
    v = (
        F.when(F.col("claim_type") == "process", fine)
        .when(limit & F.col("submit").isNull(), said("MISSING", "insufficient_but_nonharmful"))
        .when(limit & F.col("all_read"), fine)
        .when(limit, said("CONFLICTING", "conflicting_support", F.coalesce("decided", "submit.idx")))
        .when(F.col("text").rlike(NOTHING_USABLE) & F.col("shown"), said("CONFLICTING", "conflicting_support", F.col("introduced")))
        .when(F.col("text").rlike(NOTHING_USABLE), fine)
        .when(~F.col("grounded"), harmful)
        .when(F.col("grounded").isNull() & F.col("text").rlike("(?i)memory|recall|unknown"), harmful)
        .otherwise(fine)
    )
    return j.select("trace_id", "claim_id", "claim_type", "introduced", v.alias("v")).select("trace_id", "claim_id", "claim_type", "introduced", "v.*")


def records_of_answers(answers: DataFrame) -> DataFrame:
    """answers (trace_id, response: an answer with JSON {records: [{claim_id, support_status, verdict, responsible_step}]} in it) -> records for check_records(); an answer without such an object has none."""
    one = "struct<claim_id:string,support_status:string,verdict:string,responsible_step:int>"
    v = first_valid(F.col("response"), f"records array<{one}>", lambda v: v["records"].isNotNull() & ~F.exists(v["records"], lambda x: x["claim_id"].isNull()))
    return answers.select("trace_id", F.explode(v["records"]).alias("r")).select("trace_id", "r.*")


def check_records(records: DataFrame, claims: DataFrame, events: DataFrame) -> DataFrame:
    """records (trace_id, claim_id, support_status, verdict, responsible_step) as a judge gave them -> with invalid (null, 'vocabulary' or 'unknown claim'), the step clamped into its trace, and clamped where that changed it. Nothing is dropped."""
    known = claims.select("trace_id", "claim_id", F.col("introduced").alias("_introduced"), F.lit(True).alias("_known")).dropDuplicates(["trace_id", "claim_id"])
    j = records.drop("introduced", "claim_type").join(known, ["trace_id", "claim_id"], "left").join(events.groupBy("trace_id").agg(F.max("idx").alias("_last")), "trace_id")
    words = F.coalesce(F.col("support_status").isin(*SUPPORT_LEVELS) & F.col("verdict").isin(*SUPPORT_VERDICTS), F.lit(False))
    step = F.least(F.greatest("responsible_step", F.lit(0)), "_last")
    return j.select("trace_id", "claim_id", "support_status", "verdict", step.alias("responsible_step"), F.coalesce(step != F.col("responsible_step"), F.lit(False)).alias("clamped"), F.when(~words, "vocabulary").when(F.col("_known").isNull(), "unknown claim").alias("invalid"), F.coalesce(step, F.col("_introduced")).alias("earliest"))


def earliest_harmful(records: DataFrame) -> DataFrame:
    """Tracing by rule: the earliest responsible step of the harmful records, and all of them in order."""
    bad = records.where(F.col("verdict").isin(*HARMFUL))
    return bad.groupBy("trace_id").agg(F.coalesce(F.min("responsible_step"), F.lit(0)).alias("first_error_step"), F.sort_array(F.collect_list("responsible_step")).alias("error_steps"))


def claim_audit(records: DataFrame, claims: DataFrame, events: DataFrame, traced: DataFrame | None = None) -> DataFrame:
    """One row per trace with records: status (harmful or no_harmful_claim), step, agent, reconciled, the earliest harmful claim with its support and verdict, n_valid, n_invalid, n_clamped, confidence.

    traced (trace_id, first_error_step, error_steps) is a judge's tracing, by rule if it isn't given. Its steps are clamped into the trace, and the first error is never later than the earliest of error_steps. Invalid records are counted and not used.
    """
    r = check_records(records, claims, events)
    valid = r.where("invalid is null")
    traced = earliest_harmful(valid) if traced is None else traced
    counts = r.groupBy("trace_id").agg(F.count_if(F.col("invalid").isNull()).alias("n_valid"), F.count("invalid").alias("n_invalid"), F.count_if(F.col("clamped") & F.col("invalid").isNull()).alias("n_clamped"))
    top = valid.where(F.col("verdict").isin(*HARMFUL)).groupBy("trace_id").agg(F.min_by(F.struct("claim_id", "support_status", "verdict"), F.struct(F.coalesce("earliest", F.lit(1 << 30)), "claim_id")).alias("t"))
    last = events.groupBy("trace_id").agg(F.max("idx").alias("last"))
    within = lambda x: F.least(F.greatest(x, F.lit(0)), F.col("last"))
    t = top.join(traced.select("trace_id", "first_error_step", "error_steps"), "trace_id", "left").join(last, "trace_id")
    t = t.withColumns({"said": within(F.coalesce("first_error_step", F.lit(0))), "least": F.array_min(F.transform("error_steps", within))})
    t = t.withColumns({"step": F.least("said", "least"), "reconciled": F.coalesce(F.col("least") < F.col("said"), F.lit(False))})
    t = t.join(events.select("trace_id", F.col("idx").alias("step"), "agent"), ["trace_id", "step"], "left")
    j = counts.join(t, "trace_id", "left")
    return j.select("trace_id", F.when(F.col("t").isNull(), "no_harmful_claim").otherwise("harmful").alias("status"), "step", "agent", F.coalesce("reconciled", F.lit(False)).alias("reconciled"), "t.claim_id", "t.support_status", "t.verdict", "n_valid", "n_invalid", "n_clamped", F.when(F.col("t").isNotNull(), 0.7).alias("confidence"))


def stage_sections(events: DataFrame) -> DataFrame:
    """Steps with their summary, stage (of the interval they lie in; '?' outside) and section: runs of steps of the same stage."""
    ranges = stage_ranges(events).select("trace_id", F.col("start_idx").alias("idx"), F.struct("phase", "end_idx").alias("r"))
    open_ = F.last("r", ignorenulls=True).over(upto())
    steps = events.join(ranges, ["trace_id", "idx"], "left").withColumn("r", open_).withColumn("stage", F.when(F.col("idx") <= F.col("r.end_idx"), F.col("r.phase")))
    steps = steps.where(F.col("kind").isin(*STEP_KINDS)).select("trace_id", "idx", F.coalesce("stage", F.lit("?")).alias("stage")).join(step_summaries(events).select("trace_id", F.col("step").alias("idx"), "summary"), ["trace_id", "idx"])
    starts = F.coalesce((F.lag("stage").over(by_trace()) != F.col("stage")).cast("int"), F.lit(1))
    return steps.withColumn("_s", starts).withColumn("section", F.sum("_s").over(upto())).drop("_s")


def suspicious_stages(events: DataFrame, most: int = 3) -> DataFrame:
    """Stages to look into: first those with a section of two steps of the same first three words (agent, action, start of the argument: a loop), then those with an error word in a summary, in which what came back stands; each once, `most` a trace. Columns: stage, why, rank."""
    s = stage_sections(events)
    prefix = F.array_join(F.slice(F.split("summary", " "), 1, 3), " ")
    loop = s.groupBy("trace_id", "section", "stage", prefix.alias("prefix")).agg(F.count("*").alias("n")).where("n >= 2").select("trace_id", "section", "stage", F.lit(0).alias("o"))
    err = s.where(F.col("summary").rlike(STAGE_ERROR)).select("trace_id", "section", "stage", F.lit(1).alias("o"))
    each = loop.unionByName(err).groupBy("trace_id", "stage").agg(F.min(F.struct("o", "section")).alias("f"))
    rank = F.row_number().over(Window.partitionBy("trace_id").orderBy("f"))
    return each.select("trace_id", "stage", F.when(F.col("f.o") == 0, "loop").otherwise("error").alias("why"), rank.alias("rank")).where(F.col("rank") <= most)


def drill_range(events: DataFrame, picked: DataFrame, context: int = 3) -> DataFrame:
    """picked (trace_id, stage, rank) -> range [start - context, end] of the stage to look into: the first picked stage that the trace has, else its last; of that stage's intervals the first that holds the first error observation (the last event if there is none), else the last."""
    st = stage_ranges(events)
    have = st.select("trace_id", F.col("phase").alias("stage")).distinct()
    first = picked.join(have, ["trace_id", "stage"], "left_semi").groupBy("trace_id").agg(F.min_by("stage", "rank").alias("chosen"))
    last = st.groupBy("trace_id").agg(F.max_by("phase", "stage_no").alias("last_stage"))
    at = events.groupBy("trace_id").agg(F.coalesce(F.min(F.when(F.col("content").rlike(ERROR_OBS), F.col("idx"))), F.max("idx")).alias("at"))
    st = st.join(last.join(first, "trace_id", "left"), "trace_id").where(F.col("phase") == F.coalesce("chosen", "last_stage")).join(at, "trace_id")
    hit = F.col("at").between(F.col("start_idx"), F.col("end_idx"))
    best = st.groupBy("trace_id", "phase").agg(F.coalesce(F.min(F.when(hit, F.struct("start_idx", "end_idx"))), F.max(F.struct("start_idx", "end_idx"))).alias("b"))
    return best.select("trace_id", F.col("phase").alias("stage"), F.greatest(F.lit(0), F.col("b.start_idx") - context).alias("lo"), F.col("b.end_idx").alias("hi"))


def diagnose_stages(picked: DataFrame, answers: DataFrame, events: DataFrame, modes: DataFrame, context: int = 3) -> DataFrame:
    """The verdict of a drill-down per trace of answers (trace_id, response: an answer with JSON {responsible_agent, step, reason, fix_suggestion, confidence, failure_mode} in it): status, stage, lo, hi, agent, step, code, confidence, notes.

    The step is clamped into the drilled range, unknown agents to the trace's first, unknown modes to null; every clamp leaves a note. Traces without any stage are `stage_not_resolved`, answers without a valid object `no_verdict`; both have no hypothesis.
    """
    schema = "responsible_agent string, step int, reason string, fix_suggestion string, confidence double, failure_mode string"
    fits = lambda v: v["responsible_agent"].isNotNull() & (v["step"] >= 0) & v["reason"].isNotNull() & v["fix_suggestion"].isNotNull() & v["confidence"].between(0, 1)
    v = answers.select("trace_id", first_valid(F.col("response"), schema, fits).alias("v"))
    v = v.withColumn("v", F.when(fits(F.col("v")), F.col("v")))
    n = events.groupBy("trace_id").agg(F.min_by("agent", "idx").alias("first_agent"), F.collect_set("agent").alias("agents"))
    j = v.join(n, "trace_id").join(drill_range(events, picked, context), "trace_id", "left").join(modes.select(F.col("code").alias("_code")).distinct(), F.col("v.failure_mode") == F.col("_code"), "left")
    status = F.when(F.col("stage").isNull(), "stage_not_resolved").when(F.col("v").isNull(), "no_verdict").otherwise("diagnosed")
    good = F.col("status") == "diagnosed"
    step, known = F.least(F.greatest("v.step", "lo"), "hi"), F.array_contains("agents", F.col("v.responsible_agent"))
    agent = F.when(known, F.col("v.responsible_agent")).otherwise(F.col("first_agent"))
    note = lambda what, a, b: F.concat(F.lit(f"{what} "), a.cast("string"), F.lit("->"), F.coalesce(b.cast("string"), F.lit("none")))
    notes = F.array(F.when(step != F.col("v.step"), note("step", F.col("v.step"), step)), F.when(~known, note("agent", F.col("v.responsible_agent"), agent)), F.when(F.col("v.failure_mode").isNotNull() & F.col("_code").isNull(), note("mode", F.col("v.failure_mode"), F.col("_code"))))
    own = lambda c, name: F.when(good, c).alias(name)
    return j.withColumn("status", status).select("trace_id", "status", own(F.col("stage"), "stage"), own(F.col("lo"), "lo"), own(F.col("hi"), "hi"), own(agent, "agent"), own(step, "step"), own(F.col("_code"), "code"), own(F.col("v.confidence"), "confidence"), F.when(good, F.array_join(F.filter(notes, lambda x: x.isNotNull()), "; ")).otherwise("").alias("notes"))


def subtask_results(events: DataFrame) -> DataFrame:
    """Whether each subtask passed: searches by a read result without error and no adjacent repeated calls, plans without decisions from memory, all others (reports too) by the trace's last verdict."""
    s = with_subtask(events)
    kind = lambda k: F.col("kind") == k
    call = F.to_json(F.struct("agent", "action", "query", "doc_id", "answer", "content", "to_agent"))
    calls = s.where(kind("TOOL_CALL")).withColumn("again", F.coalesce(F.lag(call).over(Window.partitionBy("trace_id", "subtask").orderBy("idx")) == call, F.lit(False)))
    again = calls.groupBy("trace_id", "subtask").agg(F.max("again").alias("again"))
    ok_read = kind("TOOL_RESULT") & (F.col("action") == "read_doc") & ~F.coalesce(F.col("content").rlike(ERROR_OBS), F.lit(False))
    memory = kind("LLM_CALL") & F.col("content").rlike(MEMORY)
    a = s.groupBy("trace_id", "subtask").agg(F.coalesce(F.max(ok_read), F.lit(False)).alias("read"), F.coalesce(F.max(memory), F.lit(False)).alias("memory"))
    verdict = events.where(kind("VERIFIER")).groupBy("trace_id").agg(F.max_by(F.col("content").startswith("passed"), "idx").alias("last"))
    j = subtasks(events).join(a, ["trace_id", "subtask"]).join(again, ["trace_id", "subtask"], "left").join(verdict, "trace_id", "left")
    passed = F.when(F.col("phase") == "search", F.col("read") & ~F.coalesce("again", F.lit(False))).when(F.col("phase") == "plan", ~F.col("memory")).otherwise(F.coalesce("last", F.lit(False)))
    return j.select("trace_id", "subtask", "phase", passed.alias("passed"))


def failing_subtask(results: DataFrame) -> DataFrame:
    """The last subtask that did not pass; the last of all, with a note, if all did."""
    return results.groupBy("trace_id").agg(F.coalesce(F.max(F.when(~F.col("passed"), F.col("subtask"))), F.max("subtask")).alias("subtask"), F.min("passed").alias("all_passed"))


def mechanisms(events: DataFrame) -> DataFrame:
    """Mechanism of each trace's primary symptom; a local error with less confidence where there is none."""
    m = F.create_map(*[F.lit(x) for kv in MECHANISM.items() for x in kv])
    p = primary_symptom(symptoms(events))
    return p.select("trace_id", F.coalesce(F.try_element_at(m, F.col("fault")), F.lit("local_error")).alias("mechanism"), F.when(F.col("fault") == "unknown", 0.4).otherwise(0.7).alias("confidence"))


def replay_candidates(hyps: DataFrame, most: int = 3) -> DataFrame:
    """Distinct (agent, step) of a trace's hypotheses (the first by algorithm and rank stands), best confidence first, then step; `most` a trace."""
    once = F.row_number().over(Window.partitionBy("trace_id", "agent", "step").orderBy("algo", "rank")) == 1
    c = hyps.withColumn("_o", once).where("_o").drop("_o")
    return c.withColumn("place", F.row_number().over(Window.partitionBy("trace_id").orderBy(F.col("confidence").desc(), "step", "agent"))).where(F.col("place") <= most)


def adjust_by_replay(candidates: DataFrame, outcomes: DataFrame) -> DataFrame:
    """outcomes (trace_id, agent, step, flipped): +0.2 for a replay that turned the outcome (1 at most), -0.3 for one that did not (0 at least)."""
    j = candidates.join(outcomes, ["trace_id", "agent", "step"], "left")
    conf = F.when(F.col("flipped"), F.least(F.lit(1.0), F.col("confidence") + 0.2)).when(~F.col("flipped"), F.greatest(F.lit(0.0), F.col("confidence") - 0.3)).otherwise(F.col("confidence"))
    return j.select("trace_id", "agent", "step", conf.alias("confidence"), F.when(F.col("flipped"), "validated").when(~F.col("flipped"), "refuted").otherwise("untested").alias("status"))


def merge_hypotheses(parts: list[DataFrame], superseding: tuple[str, ...] = ("replay",)) -> DataFrame:
    """All hypotheses; those of superseding algorithms replace others on the same agent and step. A source that is missing or blank is the algorithm."""
    parts = [p if "source" in p.columns else p.withColumn("source", F.lit(None).cast("string")) for p in parts]
    parts = [p.withColumn("source", F.when(F.coalesce("source", F.lit("")) == "", F.col("algo")).otherwise(F.col("source"))) for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    top = out.where(F.col("algo").isin(*superseding))
    rest = out.where(~F.col("algo").isin(*superseding)).join(top.select("trace_id", "agent", "step").distinct(), ["trace_id", "agent", "step"], "left_anti")
    return top.unionByName(rest.select(*top.columns))


def fix_text(fault: Column, step: Column) -> Column:
    """What a symptom's step should do otherwise; null without a symptom."""
    out = F.lit(None).cast("string")
    for name, text in SYMPTOM_FIX.items():
        out = F.when(fault == name, F.replace(F.lit(text), F.lit("{}"), step.cast("string"))).otherwise(out)
    return out


def symptom_at(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """Whether a candidate's step is the step of a symptom, of which, and the edit to try there: the symptom's fix, else a neutral text."""
    s = symptoms(events, fallback=False).groupBy("trace_id", "step").agg(F.min_by("fault", "rule_no").alias("fault"))
    neutral = F.concat(F.lit("Re-examine the reasoning behind step "), F.col("step").cast("string"), F.lit(" before continuing."))
    return candidates.join(s, ["trace_id", "step"], "left").withColumns({"is_symptom": F.col("fault").isNotNull(), "edit_text": F.coalesce(fix_text(F.col("fault"), F.col("step")), neutral)})


def refine(hyps: DataFrame, refined: DataFrame) -> DataFrame:
    """Root cause and confidence from a refining verdict (trace_id, step, root_cause, confidence) where there is one; else a plain text and 0.5."""
    j = hyps.join(refined, ["trace_id", "step"], "left")
    plain = F.concat(F.lit("step "), F.col("step").cast("string"), F.lit(" by "), "agent", F.lit(" decided the failure"))
    return j.withColumns({"root_cause": F.coalesce("root_cause", plain), "confidence": F.coalesce("confidence", F.lit(0.5))})


def clamp_mechanism(said: Column, least: float = 0.75) -> Column:
    """The mechanism nearest to what was said, by edit distance over length; 'unknown' below `least`."""
    s = F.lower(F.trim(said))
    each = F.array(*(F.struct((1 - F.levenshtein(s, F.lit(m)) / F.greatest(F.length(s), F.lit(len(m)))).alias("r"), F.lit(m).alias("m")) for m in MECHANISMS))
    best = F.array_max(each)
    return F.when(best["r"] >= least, best["m"]).otherwise("unknown")


def localize(verdicts: DataFrame, events: DataFrame) -> DataFrame:
    """verdicts (trace_id, response: an answer with JSON {responsible_agent, step, mechanism, confidence} in it) -> agent, step, mechanism, confidence: step clamped into the trace, agents that aren't in it become the step's own, mechanisms the nearest known one; notes say what changed."""
    v = verdicts.select("trace_id", first_valid(F.col("response"), "responsible_agent string, step int, mechanism string, confidence double", lambda v: v["step"].isNotNull() & v["responsible_agent"].isNotNull()).alias("v"))
    n = events.groupBy("trace_id").agg(F.max("idx").alias("last"), F.collect_set("agent").alias("agents"))
    j = v.join(n, "trace_id").withColumn("step", F.least(F.greatest("v.step", F.lit(0)), "last")).join(events.select("trace_id", F.col("idx").alias("step"), F.col("agent").alias("own")), ["trace_id", "step"], "left")
    known, mechanism = F.coalesce(F.array_contains("agents", F.col("v.responsible_agent")), F.lit(False)), clamp_mechanism(F.col("v.mechanism"))
    notes = F.filter(F.array(F.when(F.col("step") != F.col("v.step"), "step"), F.when(~known, "agent"), F.when(mechanism != F.col("v.mechanism"), "mechanism")), lambda x: x.isNotNull())
    return j.select("trace_id", F.when(known, F.col("v.responsible_agent")).otherwise(F.col("own")).alias("agent"), "step", mechanism.alias("mechanism"), "v.confidence", F.array_join(notes, ",").alias("clamped"))
