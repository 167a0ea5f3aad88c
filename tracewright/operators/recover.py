"""The data half of recovery: which step to try again, with what words, and what reruns showed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.model import FAULTS, VOTE_LABEL
from tracewright.operators.attribute import fix_text
from tracewright.operators.classify import symptoms
from tracewright.operators.represent import by_trace

def select_target(hyps: DataFrame, traces: DataFrame) -> DataFrame:
    """Per trace its hypothesis of highest confidence, lowest step; status skipped for successes, skipped_no_hypothesis for failures without one."""
    best = hyps.groupBy("trace_id").agg(F.max_by(F.struct("step", "agent", "code", "confidence"), F.struct("confidence", -F.col("step"), "algo")).alias("b"))
    j = traces.select("trace_id", "success").join(best, "trace_id", "left")
    status = F.when(F.col("success"), "skipped").when(F.col("b").isNull(), "skipped_no_hypothesis").otherwise("selected")
    show = lambda c: F.when(~F.col("success"), F.col(f"b.{c}")).alias(c)
    return j.select("trace_id", status.alias("status"), show("step"), show("agent"), show("code"), show("confidence"))


def feedback_text(targets: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """targets (trace_id, agent, step, fix, root_cause) and earlier attempts (trace_id, round, note) -> feedback and reflection.

    feedback is the fix, or else the root cause, and one line for every failed attempt in order. reflection has up to four parts: its head, the root cause, the fix, and who and where.
    """
    text = lambda c: F.when(F.trim(c) != "", F.col(c))
    at = F.col("step").cast("string")
    t = targets
    if attempts is None:
        t = t.withColumn("notes", F.lit(""))
    else:
        line = lambda a: F.concat(F.lit("\n(attempt "), a["round"].cast("string"), F.lit(" failed: "), F.coalesce(a["note"], F.lit("")), F.lit(" -- give a more specific correction targeting the earliest decisive error at step "), at, F.lit(".)"))
        past = attempts.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("round", "note"))).alias("past"))
        t = t.join(past, "trace_id", "left").withColumn("notes", F.coalesce(F.array_join(F.transform("past", line), ""), F.lit(""))).drop("past")
    where = F.when(F.col("agent").isNotNull() & F.col("step").isNotNull(), F.concat(F.lit("(responsible party "), "agent", F.lit(", decisive error at step "), at, F.lit(")")))
    reflection = F.concat_ws("\n", F.lit("Attribution reflection on the previous failed solve:"), text("root_cause"), F.concat(F.lit("Fix suggestion: "), text("fix")), where)
    return t.withColumns({"feedback": F.concat(F.coalesce(text("fix"), "root_cause"), "notes"), "reflection": reflection}).drop("notes")


def attempt_ledger(reruns: DataFrame, limit: int = 3) -> DataFrame:
    """reruns (rerun_of, trace_id, seq, success) -> per origin: attempts within the limit, rounds until the first success, recovered."""
    r = reruns.withColumn("round", F.row_number().over(Window.partitionBy("rerun_of").orderBy("seq", "trace_id"))).where(F.col("round") <= limit)
    first = F.min(F.when(F.col("success"), F.col("round")))
    return r.groupBy(F.col("rerun_of").alias("trace_id")).agg(F.count("*").alias("attempts"), first.alias("first_success"), first.isNotNull().alias("recovered"))


def verify_closed_loop(reruns: DataFrame, judge: DataFrame | None = None) -> DataFrame:
    """The last rerun of each origin says whether it improved. judge (trace_id, status, score, summary) is what a judge said of reruns: its score and summary stand beside, unless it ended in an error, which is no evidence (judge_available false)."""
    last = F.max_by(F.struct("trace_id", "success"), F.struct("seq", "trace_id")).alias("l")
    out = reruns.groupBy(F.col("rerun_of").alias("trace_id")).agg(last).select("trace_id", F.col("l.trace_id").alias("rerun_id"), F.col("l.success").alias("improved"))
    if judge is None:
        return out
    said = judge.where("coalesce(status, '') <> 'error'").select(F.col("trace_id").alias("rerun_id"), F.col("score").alias("judge_score"), F.col("summary").alias("judge_summary"), F.lit(True).alias("judge_available"))
    return out.join(said.dropDuplicates(["rerun_id"]), "rerun_id", "left").withColumn("judge_available", F.coalesce("judge_available", F.lit(False)))


def trials(events: DataFrame) -> DataFrame:
    """Ranges from each plan message to the event before the next; one trial where there is none. Events before the first plan belong to no trial."""
    last = events.groupBy("trace_id").agg(F.max("idx").alias("last"))
    plan = events.where("kind = 'LLM_CALL' and startswith(content, 'plan:')").select("trace_id", "idx")
    p = plan.withColumns({"nxt": F.lead("idx").over(by_trace()), "trial": F.row_number().over(by_trace()) - 1}).join(last, "trace_id")
    p = p.select("trace_id", "trial", F.col("idx").alias("lo"), F.coalesce(F.col("nxt") - 1, "last").alias("hi"))
    whole = last.join(plan.select("trace_id").distinct(), "trace_id", "left_anti").select("trace_id", F.lit(0).alias("trial"), F.lit(0).alias("lo"), F.col("last").alias("hi"))
    return p.unionByName(whole)


def trial_logs(events: DataFrame) -> DataFrame:
    """Events of each trial, and how many events the trials before it had."""
    t = trials(events)
    slices = events.join(t, "trace_id").where("idx between lo and hi").groupBy("trace_id", "trial").agg(F.count("*").alias("n_events"), F.sum((F.col("kind") == "TOOL_CALL").cast("long")).alias("n_calls"))
    before = Window.partitionBy("trace_id").orderBy("trial").rowsBetween(Window.unboundedPreceding, -1)
    return slices.withColumn("prior", F.coalesce(F.array_join(F.collect_list(F.concat(F.lit("trial "), F.col("trial").cast("string"), F.lit(": "), F.col("n_events").cast("string"), F.lit(" events"))).over(before), "; "), F.lit("")))


def vote_label(said: Column) -> Column:
    """One of the four labels from its known spellings, with any separators between words; null for others."""
    names = F.create_map(*[F.lit(x) for kv in VOTE_LABEL.items() for x in kv])
    low = F.lower(F.trim(said))
    return F.coalesce(F.try_element_at(names, low), F.try_element_at(names, F.regexp_replace(low, r"[\s_-]+", " ")))


def intervention_votes(replays: DataFrame, trials_: DataFrame) -> DataFrame:
    """replays (trace_id, trial, run, success) and trials (trace_id, trial, removed: whether the edit took the fault away) -> label per trial: Validated by a strict majority of successes, else Partially if the fault is gone, else Refuted; without replays Partially or Inconclusive. recovered: a label of the first two, and the last run succeeded."""
    r = replays.groupBy("trace_id", "trial").agg(F.count_if("success").alias("ok"), F.count("success").alias("n"), F.max_by("success", "run").alias("last"))
    j = trials_.select("trace_id", "trial", F.coalesce("removed", F.lit(False)).alias("removed")).join(r, ["trace_id", "trial"], "left").fillna(0, ["ok", "n"])
    label = F.when(2 * F.col("ok") > F.col("n"), "Validated").when(F.col("removed"), "Partially").when(F.col("n") > 0, "Refuted").otherwise("Inconclusive")
    return j.withColumn("label", label).withColumn("recovered", F.col("label").isin("Validated", "Partially") & F.coalesce("last", F.lit(False))).drop("last")


def redact_faults(text: Column) -> Column:
    """Names of faults, however their words are joined, replaced by <edited>."""
    for name in FAULTS:
        text = F.regexp_replace(text, "(?i)" + r"[-_\s]+".join(name.split("_")), "<edited>")
    return text


def feedback_matches(text: Column, fault: Column, description: Column) -> Column:
    """Whether a feedback names the fault, or shares two words with its description."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0)))
    return F.contains(F.lower(text), F.lower(F.regexp_replace(fault, "_", " "))) | F.contains(F.lower(text), F.lower(fault)) | (F.size(F.array_intersect(words(text), words(description))) >= 2)


def trial_failures(events: DataFrame) -> DataFrame:
    """Agent and step of every trial's first symptom by rule; without one its last decision, else its last event. Trials are traces of their own for the rules: their key is the pair as JSON, and both columns come back from it."""
    t = trials(events)
    own = events.join(t, "trace_id").where("idx between lo and hi").withColumn("trace_id", F.to_json(F.struct("trace_id", "trial"))).drop("lo", "hi", "trial")
    s = symptoms(own, fallback=False).groupBy("trace_id").agg(F.min_by(F.struct("step", "agent", "fault"), "rule_no").alias("s"))
    last = own.groupBy("trace_id").agg(F.max_by(F.struct(F.col("idx").alias("step"), "agent"), F.struct((F.col("kind") == "LLM_CALL").cast("int"), "idx")).alias("l"))
    j = last.join(s, "trace_id", "left").withColumn("key", F.from_json("trace_id", "trace_id string, trial int"))
    return j.select("key.trace_id", "key.trial", F.coalesce("s.step", "l.step").cast("int").alias("step"), F.coalesce("s.agent", "l.agent").alias("agent"), F.col("s.fault").alias("fault"))


def interventions(failures: DataFrame, events: DataFrame) -> DataFrame:
    """Where an intervention goes (the orchestrator's instruction for planners, else a subagent's) and its text: the fix of the whole trace's symptom at that step, else to re-examine it."""
    s = symptoms(events, fallback=False).groupBy("trace_id", "step").agg(F.min_by("fault", "rule_no").alias("at_step"))
    j = failures.join(s, ["trace_id", "step"], "left")
    category = F.when(F.col("agent") == "planner", "orchestrator_instruction").otherwise("subagent_instruction")
    neutral = F.concat(F.lit("Re-examine the reasoning behind step "), F.col("step").cast("string"), F.lit(", then continue per the task requirements."))
    return j.select("trace_id", "trial", "step", "agent", category.alias("category"), F.coalesce(fix_text(F.col("at_step"), F.col("step")), neutral).alias("replacement"))
