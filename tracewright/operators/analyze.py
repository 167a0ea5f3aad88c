"""Loops in single traces and drift between groups of traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.answers import first_valid
from tracewright.tables import durable
from tracewright.operators.represent import by_trace, upto


def search_loops(sigs: DataFrame, min_consecutive: int = 10) -> DataFrame:
    """Runs of searches and reads that only a write or a verification breaks, of at least min_consecutive; onset is where a signature first occurs again."""
    breaks = (F.col("action_class") == "FILE_WRITE") | ((F.col("action_class") == "COMMAND") & (F.col("target") == "verify"))
    s = sigs.withColumn("run", F.sum(breaks.cast("int")).over(upto())).where("action_class in ('SEARCH', 'FILE_READ')")
    nth = F.row_number().over(Window.partitionBy("trace_id", "run", "signature").orderBy("idx"))
    s = s.withColumn("nth", nth)
    repeated = F.array_join(F.sort_array(F.collect_set(F.when(F.col("nth") == 2, F.col("signature")))), ",")
    runs = s.groupBy("trace_id", "run").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.count("*").alias("length"), F.min(F.when(F.col("nth") == 2, F.col("idx"))).alias("onset"), repeated.alias("repeated"))
    return runs.where(F.col("length") >= min_consecutive).drop("run")


def _churn(items: DataFrame, keys: list[str], repeat: int, window: int) -> DataFrame:
    """Earliest stretch of `window` action positions with `repeat` items of the same keys; one per trace and target."""
    frame = Window.partitionBy("trace_id", *keys).orderBy("pos").rangeBetween(0, window - 1)
    hit = items.withColumns({"repeats": F.count("*").over(frame), "end_idx": F.max("idx").over(frame)}).where(F.col("repeats") >= repeat)
    first = hit.groupBy("trace_id", "target").agg(F.min_by(F.struct(F.col("idx").alias("start_idx"), "end_idx", "repeats"), "pos").alias("h"))
    return first.select("trace_id", "target", "h.*")


def _positions(sigs: DataFrame) -> DataFrame:
    return sigs.withColumn("pos", F.row_number().over(by_trace()).cast("long"))


def reread_churn(sigs: DataFrame, repeat: int = 3, window: int = 10) -> DataFrame:
    s = _positions(sigs).where("action_class in ('FILE_READ', 'FILE_WRITE') and target is not null")
    group = F.sum((F.col("action_class") == "FILE_WRITE").cast("int")).over(Window.partitionBy("trace_id", "target").orderBy("idx"))
    return _churn(s.withColumn("grp", group).where("action_class = 'FILE_READ'"), ["target", "grp"], repeat, window)


def redundant_searches(sigs: DataFrame, repeat: int = 2, window: int = 10) -> DataFrame:
    return _churn(_positions(sigs).where("action_class = 'SEARCH' and target is not null"), ["target"], repeat, window)


def oscillations(sigs: DataFrame, cycles: int = 2) -> DataFrame:
    """Targets with at least `cycles` read-write-read triples, on their own reads and writes, whose write failed."""
    s = sigs.where("action_class in ('FILE_READ', 'FILE_WRITE') and target is not null")
    w = Window.partitionBy("trace_id", "target").orderBy("idx")
    for k in (1, 2):
        s = s.withColumns({f"c{k}": F.lead("action_class", k).over(w), f"e{k}": F.lead("effect", k).over(w), f"i{k}": F.lead("idx", k).over(w)})
    s = s.where("action_class = 'FILE_READ' and c1 = 'FILE_WRITE' and c2 = 'FILE_READ' and e1 in ('FAILED', 'REVERTED')")
    return s.groupBy("trace_id", "target").agg(F.min("idx").alias("start_idx"), F.max("i2").alias("end_idx"), F.count("*").alias("cycles")).where(F.col("cycles") >= cycles)


def length_bin(n: Column) -> Column:
    return F.when(n <= 9, "len[0-9]").when(n <= 13, "len[10-13]").when(n <= 17, "len[14-17]").otherwise("len[18-+]")


def trace_features(events: DataFrame, traces: DataFrame) -> DataFrame:
    """Per trace: length bin, failure, calls, adjacent identical calls, and its group."""
    calls = events.where("kind = 'TOOL_CALL'")
    same = F.struct("agent", "action", "query", "doc_id", "answer", "content", "to_agent")
    calls = calls.withColumn("again", F.coalesce(F.to_json(F.lag(same).over(by_trace())) == F.to_json(same), F.lit(False)))
    calls = calls.groupBy("trace_id").agg(F.count("*").alias("n_calls"), F.sum(F.col("again").cast("long")).alias("n_repeat"))
    n = events.groupBy("trace_id").agg(F.count("*").alias("n_events"))
    f = traces.join(n, "trace_id").join(calls, "trace_id", "left").fillna(0, ["n_calls", "n_repeat"])
    return f.select("trace_id", "model_version", "prompt_version", "time_window", "task_id", "n_events", length_bin(F.col("n_events")).alias("length_bin"), (~F.col("success")).alias("failed"), "n_calls", "n_repeat")


FAMILIES = {
    "version": (("prompt_version",), "model_version"),
    "behavior": (("model_version", "prompt_version"), "time_window"),
    "data": (("model_version", "prompt_version"), "time_window"),
}


def _in_families(rows: DataFrame) -> DataFrame:
    """Each row once for every contrast family, with the family's fixed key and compared group."""
    null = F.lit("")
    each = F.array(*(F.struct(F.lit(f).alias("family"), F.concat_ws("/", *fixed).alias("fixed"), F.coalesce(group, null).alias("grp")) for f, (fixed, group) in FAMILIES.items()))
    return rows.withColumn("_f", F.explode(each)).select("_f.*", *rows.columns)


GROUP = ["model_version", "prompt_version", "time_window"]


def distributions(events: DataFrame, traces: DataFrame) -> DataFrame:
    """(family, fixed, grp, feature, bin, n, p). Events are counted once by group, kind and action and traces once by group and features; all histograms are sums of those small written rows."""
    feats = trace_features(events, traces)
    acts = events.groupBy("trace_id", "kind", "agent", F.coalesce("action", "kind").alias("act")).agg(F.count("*").alias("n")).join(traces.select("trace_id", *GROUP), "trace_id")
    acts = durable(acts.groupBy(*GROUP, "kind", "agent", "act").agg(F.sum("n").cast("double").alias("n")))
    runs = durable(feats.groupBy(*GROUP, "length_bin", "failed", "task_id").agg(F.count("*").cast("double").alias("n"), F.sum("n_repeat").cast("double").alias("r"), F.sum("n_calls").cast("double").alias("c")))
    bin_ = lambda feature, name, n="n": F.struct(F.lit(feature).alias("feature"), name.alias("bin"), (F.col(n) if isinstance(n, str) else n).alias("n"))
    of_acts = F.array(bin_("kind_hist", F.col("kind")), bin_("action_hist", F.concat_ws(":", "agent", "act")))
    of_runs = F.array(bin_("length_bin", F.col("length_bin")), bin_("failure", F.when(F.col("failed"), "fail").otherwise("ok")), bin_("task_composition", F.col("task_id")), bin_("repeat", F.lit("repeat"), "r"), bin_("repeat", F.lit("clean"), F.col("c") - F.col("r")))
    rows = acts.select(*GROUP, F.explode(of_acts).alias("b")).unionByName(runs.select(*GROUP, F.explode(of_runs).alias("b"))).select(*GROUP, "b.*")
    rows = _in_families(rows).where("(family = 'data') = (feature = 'task_composition')")
    rows = rows.groupBy("family", "fixed", "grp", "feature", "bin").agg(F.sum("n").alias("n")).where("n > 0")
    return rows.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("family", "fixed", "grp", "feature")))


def group_sizes(traces: DataFrame) -> DataFrame:
    return _in_families(traces.select("model_version", "prompt_version", "time_window")).groupBy("family", "fixed", "grp").agg(F.count("*").alias("n_traces"))


def compare_distributions(d: DataFrame, groups: DataFrame, psi_alert: float = 0.2, mismatch_alert: float = 0.1) -> DataFrame:
    """d (family, fixed, grp, feature, bin, p) and groups (family, fixed, grp) -> per pair of groups of a family and feature: PSI over the bins both have, mass of either in bins the other lacks, and whether that alerts."""
    both = groups.alias("a").join(groups.alias("b"), (F.col("a.family") == F.col("b.family")) & (F.col("a.fixed") == F.col("b.fixed")) & (F.col("a.grp") < F.col("b.grp"))).select("a.family", "a.fixed", F.col("a.grp").alias("a"), F.col("b.grp").alias("b"))
    side = lambda s: both.join(d.withColumnRenamed("grp", s), ["family", "fixed", s]).select("family", "fixed", "a", "b", "feature", "bin", F.col("p").alias(f"p_{s}"))
    j = side("a").join(side("b"), ["family", "fixed", "a", "b", "feature", "bin"], "full_outer")
    psi = F.sum(F.coalesce((F.col("p_b") - F.col("p_a")) * F.log(F.col("p_b") / F.col("p_a")), F.lit(0.0)))
    out = j.groupBy("family", "fixed", "a", "b", "feature").agg(psi.alias("psi"), F.sum(F.when(F.col("p_b").isNull(), F.col("p_a")).otherwise(0.0)).alias("mismatch_a"), F.sum(F.when(F.col("p_a").isNull(), F.col("p_b")).otherwise(0.0)).alias("mismatch_b"))
    return out.withColumn("alert", (F.col("psi") > psi_alert) | (F.greatest("mismatch_a", "mismatch_b") > mismatch_alert))


def drift_pairs(events: DataFrame, traces: DataFrame, min_group: int = 5, psi_alert: float = 0.2, mismatch_alert: float = 0.1) -> DataFrame:
    """compare_distributions() of the groups with at least min_group traces; both sides read the same small written rows."""
    sizes = durable(group_sizes(traces).where(F.col("n_traces") >= min_group).select("family", "fixed", "grp"))
    return compare_distributions(durable(distributions(events, traces).select("family", "fixed", "grp", "feature", "bin", "p")), sizes, psi_alert, mismatch_alert)


def independent_alerts(pairs: DataFrame, aliases: DataFrame) -> DataFrame:
    """pairs of compare_distributions() and aliases (a, b, alias: of features by name, or with family, fixed and a pair of groups, then for that pair alone) -> firing features of each pair (family, fixed, a, b, firing, independent): a feature that is an alias of an earlier firing one is not independent."""
    key = ["family", "fixed", "a", "b"]
    firing = pairs.where("alert").select(*key, F.when(F.col("feature") == "task_composition", "task_id").otherwise(F.col("feature")).alias("feature"))
    same = aliases.where("alias").select(F.col("a").alias("first"), F.col("b").alias("feature"))
    other = firing.select(*key, F.col("feature").alias("first"))
    late = firing.join(same, "feature").join(other, [*key, "first"], "left_semi").select(*key, "feature").distinct().withColumn("late", F.lit(True))
    j = firing.join(late, [*key, "feature"], "left")
    names = lambda keep: F.array_join(F.array_sort(F.collect_set(F.when(keep, F.col("feature")))), ",")
    return j.groupBy(*key).agg(names(F.lit(True)).alias("firing"), names(F.col("late").isNull()).alias("independent"))


def feature_aliases(features: DataFrame) -> DataFrame:
    """Pairs of length_bin, failure and task_id that part the traces alike, by counts of distinct values."""
    f = features.select("length_bin", F.col("failed").cast("string").alias("failure"), "task_id").distinct()
    names = ("length_bin", "failure", "task_id")
    counts = [F.countDistinct(n).alias(n) for n in names] + [F.countDistinct(a, b).alias(f"{a}~{b}") for i, a in enumerate(names) for b in names[i + 1 :]]
    one = f.agg(*counts)
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), ((F.col(a) == F.col(f"{a}~{b}")) & (F.col(b) == F.col(f"{a}~{b}"))).alias("alias")) for i, a in enumerate(names) for b in names[i + 1 :]))
    return one.select(F.explode(pairs).alias("p")).select("p.*")


def pair_aliases(features: DataFrame, groups: DataFrame) -> DataFrame:
    """features of trace_features() and groups (family, fixed, grp) -> for every pair of groups (family, fixed, a, b) and of features (first, feature): whether they part the traces of both groups alike. Corpus-wide aliases need not be those of a pair, nor the other way round.

    Traces are reduced to their different combinations per group first; pairs meet only those, and the counts of distinct values and of distinct value pairs are taken in one aggregation.
    """
    names = ("length_bin", "failure", "task_id")
    combos = durable(_in_families(features.select(*GROUP, "length_bin", F.col("failed").cast("string").alias("failure"), "task_id").distinct()).select("family", "fixed", "grp", *names).distinct())
    key = ["family", "fixed", "a", "b"]
    both = groups.alias("x").join(groups.alias("y"), (F.col("x.family") == F.col("y.family")) & (F.col("x.fixed") == F.col("y.fixed")) & (F.col("x.grp") < F.col("y.grp"))).select("x.family", "x.fixed", F.col("x.grp").alias("a"), F.col("y.grp").alias("b"))
    rows = both.withColumn("grp", F.explode(F.array("a", "b"))).join(combos, ["family", "fixed", "grp"])
    pairs = [(f, g) for i, f in enumerate(names) for g in names[i + 1 :]]
    n = rows.groupBy(*key).agg(*(F.countDistinct(f).alias(f) for f in names), *(F.countDistinct(f, g).alias(f"{f}~{g}") for f, g in pairs))
    each = F.array(*(F.struct(F.lit(f).alias("first"), F.lit(g).alias("feature"), ((F.col(f) == F.col(f"{f}~{g}")) & (F.col(g) == F.col(f"{f}~{g}"))).alias("alias")) for f, g in pairs))
    return n.select(*key, F.explode(each).alias("p")).select(*key, "p.*")


def drift_alerts(events: DataFrame, traces: DataFrame, min_group: int = 5, psi_alert: float = 0.2, mismatch_alert: float = 0.1) -> DataFrame:
    """Firing features of every pair of groups (family, fixed, a, b, firing, independent); what is an alias of an earlier firing feature among the traces of this pair is not independent."""
    key = ["family", "fixed", "a", "b"]
    groups = durable(group_sizes(traces).where(F.col("n_traces") >= min_group).select("family", "fixed", "grp"))
    fired = durable(drift_pairs(events, traces, min_group, psi_alert, mismatch_alert).where("alert").select(*key, "feature"))
    same = pair_aliases(trace_features(events, traces), groups).where("alias").select(*key, "first", "feature")
    late = same.join(fired, [*key, "feature"], "left_semi").join(fired.withColumnRenamed("feature", "first"), [*key, "first"], "left_semi").select(*key, "feature").distinct().withColumn("late", F.lit(True))
    names = lambda keep: F.array_join(F.array_sort(F.collect_set(F.when(keep, F.col("feature")))), ",")
    return fired.join(late, [*key, "feature"], "left").groupBy(*key).agg(names(F.lit(True)).alias("firing"), names(F.col("late").isNull()).alias("independent"))


def group_census(traces: DataFrame) -> DataFrame:
    return traces.groupBy("model_version", "prompt_version", "time_window").agg(F.count("*").alias("n_traces"))


#: Other names of severities.
SEVERITY = {"low": "minor", "minor": "minor", "medium": "major", "major": "major", "high": "critical", "severe": "critical", "critical": "critical"}


def quality_verdicts(verdicts: DataFrame) -> DataFrame:
    """verdicts (trace_id, response: an answer with JSON {score, findings: [{severity, note}]} in it) -> score and counts of findings by severity. The answer's first object with a score in 0 to 10 and known severities counts; if none has, the verdict is rejected with the last one's fault. No findings: none."""
    sev = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    words = lambda v: F.transform(F.coalesce(v["findings"], F.array().cast("array<struct<severity:string,note:string>>")), lambda f: F.try_element_at(sev, F.lower(F.trim(f["severity"]))))
    fits = lambda v: v["score"].between(0, 10) & ~F.exists(words(v), lambda x: x.isNull())
    v = verdicts.withColumn("v", first_valid(F.col("response"), "score double, findings array<struct<severity:string,note:string>>", fits)).withColumn("s", words(F.col("v")))
    n = lambda name: F.size(F.filter("s", lambda x: x == name)).cast("long")
    bad = F.when(F.col("v.score").isNull() | ~F.col("v.score").between(0, 10), "score").when(F.exists("s", lambda x: x.isNull()), "severity")
    return v.select("trace_id", F.when(bad.isNull(), F.col("v.score")).alias("score"), n("minor").alias("minor"), n("major").alias("major"), n("critical").alias("critical"), bad.alias("rejected"))


def rule_quality(traces: DataFrame, symptoms: DataFrame) -> DataFrame:
    """9.0 for a success; 2.5 for a failure with symptoms (fallbacks don't count); else 4.0."""
    s = symptoms.where("fault <> 'unknown'").groupBy("trace_id").agg(F.count("*").alias("n_findings"))
    j = traces.select("trace_id", "success").join(s, "trace_id", "left").fillna(0, ["n_findings"])
    return j.select("trace_id", F.when(F.col("success"), 9.0).when(F.col("n_findings") > 0, 2.5).otherwise(4.0).alias("score"), F.when(F.col("success"), F.lit(0)).otherwise(F.col("n_findings")).cast("long").alias("critical"))
