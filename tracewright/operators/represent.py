"""Representations of traces: flattened spans, foldings, action signatures, graphs, trees, renderings.

Inputs are DataFrames in the shapes of tracewright.model. All per-trace windows share the partitioning by trace_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracewright.model import CLAIM_STATUSES, CLAIM_TYPES, DIFF_MARK, ERROR_OBS, FAILURE_WORD, KINDS, MEMORY, MUST_CITE, NOTHING_USABLE, STEP_KINDS
from tracewright.operators.answers import first_valid
from tracewright.operators.payload import has_payload, other_keys
from tracewright.tables import durable, durable_by, durable_long


def by_trace() -> WindowSpec:
    return Window.partitionBy("trace_id").orderBy("idx")


def before() -> WindowSpec:
    """All events of the trace before the current one."""
    return by_trace().rowsBetween(Window.unboundedPreceding, -1)


def upto() -> WindowSpec:
    """All events of the trace up to the current one."""
    return by_trace().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def shorten(text: Column, limit: int = 400) -> Column:
    """White space collapsed, and cut with '...' above limit."""
    s = collapse(text)
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit - 3), F.lit("..."))).otherwise(s)


def _meet(nodes: DataFrame, up: Column, ask: dict[str, Column], give: dict[str, Column]) -> DataFrame:
    """Rows of a trace meet without a join, so that one shuffle by trace_id serves them all: each node stands once under its own number, and once under the number of the node that `up` names. Adds what that node says (`ask`), and sums of what the nodes that name it say (`give`). Other columns keep their values."""
    side = lambda own, key: F.struct(F.lit(own).alias("_own"), key.alias("_key"))
    both = nodes.withColumn("_at", F.explode(F.when(up.isNotNull(), F.array(side(True, F.col("node")), side(False, up))).otherwise(F.array(side(True, F.col("node"))))))
    there, own = Window.partitionBy("trace_id", "_at._key"), F.col("_at._own")
    both = both.withColumns({c: F.max(F.when(own, v)).over(there) for c, v in ask.items()} | {c: F.coalesce(F.sum(F.when(~own, v)).over(there), F.lit(0)) for c, v in give.items()})
    if not give:  # then the row under `up` has all
        return both.where(~own | up.isNull()).withColumns({c: F.when(up.isNotNull(), F.col(c)) for c in ask}).drop("_at")
    kept = [F.max(F.when(own, F.col(c))).alias(c) for c in nodes.columns if c not in ("trace_id", "node")]
    return both.groupBy("trace_id", "node").agg(*kept, *(F.max(F.when(~own, F.col(c))).alias(c) for c in ask), *(F.max(F.when(own, F.col(c))).alias(c) for c in give))


def _double(state: DataFrame) -> DataFrame:
    """One round of pointer doubling: `up` and the sizes reach twice as far."""
    s = _meet(state, F.col("up"), {"_up": F.col("up")}, {"_add": F.col("size")})
    return s.select(*(c for c in state.columns if c not in ("up", "ups", "size")), F.col("_up").alias("up"), F.concat("ups", F.array("_up")).alias("ups"), (F.col("size") + F.col("_add")).alias("size"))


def _preorder(state: DataFrame) -> tuple[DataFrame, int]:
    """A written table of the first round (trace_id, node: numbered in the order of siblings, span_id, up: the node two levels above or null, ups: [the parent, up], size: of the subtree down to its children) -> (trace_id, node, span_id, ups, own, idx, depth, size, by pointer doubling; own: how far idx is from the parent's), and what depth is at most. Every round is one shuffle by trace."""
    rounds, live = 1, None
    while (now := state.where("up is not null").count()) not in (0, live):
        live, rounds = now, rounds + 1
        state = durable_by(_double(state.repartition("trace_id")), "trace_id")
    walk = state.where("up is null").repartition("trace_id").withColumn("_parent", F.get("ups", F.lit(0)))
    elder = F.coalesce(F.sum("size").over(Window.partitionBy("trace_id", "_parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    walk = walk.withColumn("own", elder + F.col("_parent").isNotNull().cast("int")).select("trace_id", "node", "span_id", "ups", "own", F.col("own").alias("idx"), F.lit(1).alias("depth"), "size")
    for k in range(rounds):
        walk = _meet(durable_by(walk, "trace_id").repartition("trace_id") if k else walk, F.get("ups", F.lit(k)), {"_idx": F.col("idx"), "_depth": F.col("depth")}, {})
        add = lambda c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
        walk = walk.select("trace_id", "node", "span_id", "ups", "own", add("idx"), add("depth"), "size")
    return walk, 2**rounds


def flatten_spans(spans: DataFrame, max_depth: int | None = None) -> DataFrame:
    """spans (trace_id, span_id, parent_span_id, ordinal) -> with depth, idx (pre-order) and parent_id (event id of the parent).

    Pointer doubling: in round k every span knows its 2^k-th ancestor, so sizes of subtrees, and then the sums of all that lies before a span on its way to the root, take as many rounds as the logarithm of the depth. A span whose parent is absent is a root; siblings are in order of (ordinal, span_id). Spans of a cycle, or below one, stay out; so does a repeated span id below its first. Of other repeated ids the first has the children. Spans without an id, and spans deeper than a given max_depth, are an error.
    """
    own = F.coalesce("span_id", F.raise_error(F.concat(F.lit("a span without an id in trace "), F.coalesce("trace_id", F.lit("")))).cast("string"))
    s = spans.select("trace_id", own.alias("span_id"), "parent_span_id", "ordinal")
    # rounds carry the number of a span in its trace, not its id
    s = s.withColumn("node", F.row_number().over(Window.partitionBy("trace_id").orderBy("ordinal", "span_id", "parent_span_id"))).drop("ordinal")
    # each span under its own id, then those that name it as their parent; the first of an id stands before all
    side = lambda asks, key: F.struct(F.lit(asks).alias("asks"), F.col(key).alias("key"))
    s = s.withColumn("_at", F.explode(F.when(F.col("parent_span_id").isNotNull() & F.col("trace_id").isNotNull(), F.array(side(0, "span_id"), side(1, "parent_span_id"))).otherwise(F.array(side(0, "span_id")))))
    asks = F.col("_at.asks") == 1
    there = Window.partitionBy("trace_id", "_at.key").orderBy("_at.asks", "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("_first", F.first(F.when(~asks, F.col("node")), ignorenulls=True).over(there))
    s = s.groupBy("trace_id", "node").agg(F.max(F.when(~asks, F.col("span_id"))).alias("span_id"), F.max(F.when(asks, F.col("_first"))).alias("up"), F.max(~asks & (F.col("_first") != F.col("node"))).alias("again"))
    start = lambda d: d.select("trace_id", "node", "span_id", "again", "up", F.array("up").alias("ups"), F.lit(1).cast("long").alias("size"))
    nodes = durable_by(_double(start(s)), "trace_id")
    again = nodes.where("again")
    if not again.isEmpty():
        nodes = nodes.withColumn("up", F.get("ups", F.lit(0)))  # as before the first round
        renew = lambda d: durable_by(_double(start(d.repartition("trace_id"))), "trace_id").drop("again")
        first = durable_long(_preorder(renew(nodes.where("not again")))[0].select("trace_id", "node", "span_id", "idx", "size"))
        parent = first.select("trace_id", F.col("node").alias("up"), F.col("idx").alias("_at"))
        below = again.select("trace_id", "node", "span_id", F.get("ups", F.lit(0)).alias("up")).join(first.drop("node"), ["trace_id", "span_id"]).join(parent, ["trace_id", "up"]).where((F.col("_at") >= F.col("idx")) & (F.col("_at") < F.col("idx") + F.col("size")))
        nodes = renew(nodes.join(below.select("trace_id", "node"), ["trace_id", "node"], "left_anti").select(nodes.columns))
    (walk, deepest), name = _preorder(nodes.drop("again")), lambda i: F.format_string("e%03d", i)
    out = walk.select("trace_id", "span_id", F.col("idx").cast("int").alias("idx"), name(F.col("idx")).alias("id"), "depth", F.when(F.get("ups", F.lit(0)).isNotNull(), name(F.col("idx") - F.col("own"))).alias("parent_id"))
    if max_depth is not None and deepest > max_depth:
        out = durable_long(out)
        if not out.where(F.col("depth") > max_depth).isEmpty():
            raise ValueError(f"spans deeper than {max_depth} levels")
    return out


def admit_kind(kind: Column) -> tuple[Column, Column]:
    """(kind of the vocabulary, whether it was remapped)."""
    k = F.upper(F.trim(kind))
    known = k.isin(*KINDS)
    return F.when(known, k).when(k == "GENERATION", "LLM_CALL").otherwise("AGENT_MESSAGE"), F.coalesce(~known, F.lit(True))


def time_or_index(ts: Column) -> Column:
    """The node's own time, else its place in the trace."""
    return F.coalesce(ts, F.col("idx").cast("double"))


def remap_refs(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """refs (trace_id, span_id, refs array) and ids (trace_id, span_id, id, idx) -> (trace_id, span_id, refs of event ids in order, dropped). The first of repeated span ids wins; dangling refs are dropped and counted."""
    here = ids.select("trace_id", "span_id", F.lit(True).alias("_own"), "id", "idx")
    both = here.unionByName(refs.select("trace_id", "span_id", F.lit(False).alias("_own"), "refs"), allowMissingColumns=True).repartition("trace_id")
    # ids meet refs inside their trace: rows of one id, those that name it among them
    slot = lambda pos, ref: F.struct(pos.cast("int").alias("pos"), ref.cast("string").alias("ref"))
    none = F.lit(None)
    slots = F.when(F.col("_own"), F.array(slot(none, F.col("span_id")))).when(F.size("refs") > 0, F.transform("refs", lambda x, k: slot(k, x))).otherwise(F.array(slot(none, none)))
    both = both.select("trace_id", "span_id", "_own", "id", "idx", F.explode(slots).alias("_slot")).select("*", "_slot.*")
    first = F.min_by("id", F.when(F.col("_own"), F.col("idx"))).over(Window.partitionBy("trace_id", "ref"))
    out = both.withColumn("id", F.when(F.col("trace_id").isNotNull() & F.col("ref").isNotNull(), first)).where("not _own")
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id")))), lambda r: r["id"])
    return out.groupBy("trace_id", "span_id").agg(kept.alias("refs"), F.sum((F.col("ref").isNotNull() & F.col("id").isNull()).cast("int")).alias("dropped"))


def normalize_flat(events: DataFrame) -> DataFrame:
    """idx renumbered from 0 by (ts, id), empty ids filled, negative or null times replaced by idx."""
    idx = F.row_number().over(Window.partitionBy("trace_id").orderBy("idx")) - 1
    e = events.withColumn("idx", idx.cast("int"))
    return e.withColumns({"id": F.when(F.coalesce(F.col("id"), F.lit("")) == "", F.format_string("e%03d", "idx")).otherwise(F.col("id")), "ts": F.when(F.col("ts") >= 0, F.col("ts")).otherwise(F.col("idx").cast("double"))})


def canonical_stats(events: DataFrame) -> DataFrame:
    """Per trace: events, references, and agents in order of first appearance."""
    firsts = events.groupBy("trace_id", "agent").agg(F.min("idx").alias("at"), F.count("*").alias("n"), F.sum(F.size("refs")).alias("r"))
    agents = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "agent"))), lambda a: a["agent"]), ",")
    return firsts.groupBy("trace_id").agg(F.sum("n").alias("n_events"), F.sum("r").alias("n_refs"), agents.alias("agents"))


def fold(events: DataFrame, min_fold: int = 120, digest: int = 100, loose: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """Decision for every TOOL_RESULT with content: keep_error (an error observation, any of the extra keywords in any case, or, if loose, any failure word), keep_patch, keep_short, or a fold with its running number and digest."""
    e = events.where("kind = 'TOOL_RESULT' and coalesce(content, '') <> ''")
    c = F.col("content")
    wrong = [c.rlike(ERROR_OBS), *(F.contains(F.lower(c), F.lit(k.lower())) for k in extra), *([c.rlike(FAILURE_WORD)] if loose else [])]
    how = F.when(reduce(lambda a, b: a | b, wrong), "keep_error").when(c.rlike(DIFF_MARK), "keep_patch").when(F.length(c) <= min_fold, "keep_short").otherwise("fold")
    e = e.select("trace_id", "idx", "content", how.alias("decision"))
    n = F.sum((F.col("decision") == "fold").cast("int")).over(upto())
    fid = F.when(F.col("decision") == "fold", F.concat(F.lit("F"), n.cast("string")))
    text = F.when(fid.isNotNull(), F.concat(F.lit("⟦folded:"), fid, F.lit(" | "), F.substring(collapse(c), 1, digest), F.lit("⟧")))
    return e.select("trace_id", "idx", "decision", fid.alias("fid"), text.alias("placeholder"), "content")


def fold_stats(events: DataFrame, folds: DataFrame) -> DataFrame:
    """Per trace: tool results (empty ones too), how many were folded or kept and why, and the share that was folded, to 4 digits."""
    n = events.groupBy("trace_id").agg(F.count_if(F.col("kind") == "TOOL_RESULT").alias("n_tool_results"))
    kinds = {"n_folded": "fold", "n_kept_error": "keep_error", "n_kept_patch": "keep_patch", "n_kept_short": "keep_short"}
    k = folds.groupBy("trace_id").agg(*(F.count_if(F.col("decision") == v).alias(c) for c, v in kinds.items()))
    j = n.join(k, "trace_id", "left").na.fill(0, list(kinds))
    return j.withColumn("fold_ratio", F.when(F.col("n_tool_results") > 0, F.round(F.col("n_folded") / F.col("n_tool_results"), 4)).otherwise(0.0))


def unfold(lines: DataFrame, folds: DataFrame) -> DataFrame:
    """lines (trace_id, idx, line) with placeholders replaced by the folded content. A line whose fold is missing gets null in `line` and true in `missing`."""
    fid = F.regexp_extract("line", r"⟦folded:(\w+) \| .*⟧", 1)
    f = folds.where("fid is not null").select("trace_id", "fid", F.col("content").alias("_content"))
    j = lines.withColumn("fid", fid).join(f, ["trace_id", "fid"], "left")
    a, b = F.substring_index("line", "⟦folded:", 1), F.regexp_extract("line", r"⟧([^⟧]*)$", 1)
    lost = (F.col("fid") != "") & F.col("_content").isNull()
    return j.select("trace_id", "idx", F.when(lost, F.lit(None)).when(F.col("fid") == "", F.col("line")).otherwise(F.concat(a, "_content", b)).alias("line"), lost.alias("missing"))


def first_answer(events: DataFrame, kind: str) -> DataFrame:
    """(trace_id, id of a call, content) of the first event of `kind` whose last ref is the call."""
    a = events.where((F.col("kind") == kind) & (F.size("refs") > 0))
    return a.groupBy("trace_id", F.element_at("refs", -1).alias("id")).agg(F.min_by(F.struct("idx", "content"), "idx").alias("_a")).select("trace_id", "id", F.col("_a.idx").alias(f"{kind.lower()}_idx"), F.col("_a.content").alias(f"{kind.lower()}_content"))


def classify_actions(events: DataFrame) -> DataFrame:
    """Events that carry an action signature, with action_class and target."""
    k, a = F.col("kind"), F.col("action")
    norm = lambda c: F.lower(collapse(c))
    cls = (
        F.when((k == "TOOL_CALL") & (a == "search"), F.struct(F.lit("SEARCH").alias("c"), norm(F.coalesce("query", F.lit(""))).alias("t")))
        .when((k == "TOOL_CALL") & (a == "read_doc"), F.struct(F.lit("FILE_READ").alias("c"), F.coalesce("doc_id", F.lit("")).alias("t")))
        .when((k == "TOOL_CALL") & (a == "submit"), F.struct(F.lit("COMMAND").alias("c"), F.lit("submit").alias("t")))
        .when(k == "TOOL_CALL", F.struct(F.lit("COMMAND").alias("c"), F.coalesce("action", F.lit("tool")).alias("t")))
        .when(k == "VERIFIER", F.struct(F.lit("COMMAND").alias("c"), F.lit("verify").alias("t")))
        .when(k == "HANDOFF", F.struct(F.lit("AGENT_SPAWN").alias("c"), F.coalesce("to_agent", F.lit("")).alias("t")))
        .when((k == "LLM_CALL") & (F.col("phase") == "plan"), F.struct(F.lit("PLAN").alias("c"), F.substring(norm(F.coalesce("content", F.lit(""))), 1, 60).alias("t")))
        .when(k == "LLM_CALL", F.struct(F.lit("REASON").alias("c"), F.lit(None).cast("string").alias("t")))
    )
    e = events.withColumn("_s", cls).where("_s is not null").withColumns({"action_class": F.col("_s.c"), "target": F.col("_s.t")}).drop("_s")
    return e.withColumn("signature", F.when(F.col("target").isNull(), F.col("action_class")).otherwise(F.concat("action_class", F.lit("("), "target", F.lit(")"))))


def answers(events: DataFrame) -> DataFrame:
    """(trace_id, id of a call, tool_result_content, verifier_content) of the first result and the first verdict whose last ref is the call."""
    a = events.where(F.col("kind").isin("TOOL_RESULT", "VERIFIER") & (F.size("refs") > 0))
    first = lambda k: F.min_by("content", F.when(F.col("kind") == k, F.col("idx"))).alias(f"{k.lower()}_content")
    return a.groupBy("trace_id", F.element_at("refs", -1).alias("id")).agg(first("TOOL_RESULT"), first("VERIFIER"))


def sign_actions(events: DataFrame) -> DataFrame:
    """Action signatures with the effect that the trace alone tells."""
    s = classify_actions(events).join(answers(events), ["trace_id", "id"], "left")
    effect = (
        F.when(F.col("action_class") == "REASON", "REASONING").when(F.col("action_class").isin("PLAN", "AGENT_SPAWN"), "RECORDED").when(F.col("kind") == "VERIFIER", "JUSTIFIED")
        .when(F.col("action") == "submit", F.when(F.col("verifier_content").startswith("passed"), "SURVIVED").otherwise("FAILED"))
        .when(F.col("tool_result_content").rlike(ERROR_OBS), "FAILED").when(F.col("action_class") == "FILE_READ", "JUSTIFIED").otherwise("RECORDED")
    )
    passed = F.when(F.col("kind") == "VERIFIER", F.col("content").startswith("passed"))
    return s.select("trace_id", "idx", "id", "kind", "agent", "action_class", "target", effect.alias("effect"), "signature", passed.alias("passed"), "tool_result_content")


def anchor_documents(signatures: DataFrame, traces: DataFrame) -> DataFrame:
    """(task_id, document) rows: what successful traces of a task read without failing."""
    ok = traces.where("success").select("trace_id", "task_id")
    reads = signatures.where("action_class = 'FILE_READ' and effect <> 'FAILED' and coalesce(target, '') <> ''").select("trace_id", F.col("target").alias("document")).distinct()
    return reads.join(ok, "trace_id").select("task_id", "document").distinct()


def anchor_sets(signatures: DataFrame, traces: DataFrame) -> DataFrame:
    """The same for display: (task_id, anchor), sorted; tasks without any stay out."""
    return anchor_documents(signatures, traces).groupBy("task_id").agg(F.sort_array(F.collect_list("document")).alias("anchor"))


def judge_by_anchor(signatures: DataFrame, documents: DataFrame, traces: DataFrame) -> DataFrame:
    """signatures with n_anchor (documents of the task's anchor; null without one), hit (a read of one, or a search whose result names one, whatever signs its id has, not inside a longer run of letters and digits; ids have one of either) and effect: reads and searches that didn't fail are JUSTIFIED by a hit, else OFF-ANCHOR.

    Anchors stay rows: what a trace reads or is shown meets them in one equi-join on task and document, before hits go back to the signatures. So no array grows with a task, and a hot task is split like any key.
    """
    documents = durable(documents.select("task_id", "document"))
    task = traces.select("trace_id", "task_id").join(documents.groupBy("task_id").agg(F.count("*").alias("n_anchor")), "task_id").select("trace_id", "task_id", "n_anchor")
    runs = F.size(F.regexp_extract_all("document", F.lit("[0-9A-Za-z]+"), F.lit(0)))
    # how many runs of letters and digits ids have: one, or a few
    sizes = sorted(r[0] for r in documents.select(runs.alias("n")).distinct().collect() if r[0])
    said = F.coalesce("tool_result_content", F.lit(""))
    spans = [F.regexp_extract_all(said, F.lit(rf"(?<![0-9A-Za-z])(?=([0-9A-Za-z]+(?:[^0-9A-Za-z]+[0-9A-Za-z]+){{{n - 1}}})(?![0-9A-Za-z]))"), F.lit(1)) for n in sizes]
    look = F.when(F.col("action_class") == "FILE_READ", F.array("target")).otherwise(F.array_distinct(F.concat(*spans)) if spans else F.array().cast("array<string>"))
    seen = signatures.where("action_class in ('FILE_READ', 'SEARCH') and effect <> 'FAILED'").join(task, "trace_id").select("trace_id", "id", "task_id", "action_class", said.alias("said"), F.explode(look).alias("key"))
    core = F.regexp_replace("document", "^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", "")
    # a read names the whole id, a result is searched for what lies between its outer signs
    keys = F.array(F.struct(F.lit("FILE_READ").alias("action_class"), F.col("document").alias("key")), F.struct(F.lit("SEARCH").alias("action_class"), core.alias("key")))
    found = seen.join(documents.select("task_id", "document", F.explode(keys).alias("k")).select("task_id", "document", "k.*"), ["task_id", "action_class", "key"])
    bare = (F.col("action_class") == "FILE_READ") | (F.col("document") == F.col("key"))
    found = found.where(bare | F.expr(r"rlike(said, concat('(?<![0-9A-Za-z])\\Q', document, '\\E(?![0-9A-Za-z])'))"))
    hits = found.select("trace_id", "id").distinct().withColumn("hit", F.lit(True))
    s = signatures.join(task.select("trace_id", "n_anchor"), "trace_id", "left").join(hits, ["trace_id", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    judged = F.col("n_anchor").isNotNull() & F.col("action_class").isin("FILE_READ", "SEARCH") & (F.col("effect") != "FAILED")
    return s.withColumn("effect", F.when(judged, F.when(F.col("hit"), "JUSTIFIED").otherwise("OFF-ANCHOR")).otherwise(F.col("effect")))


def reference_traces(events: DataFrame, traces: DataFrame) -> DataFrame:
    """(task_id, trace_id, n_events) of each task's shortest successful trace, by trace_id on ties."""
    n = events.groupBy("trace_id").agg(F.count("*").alias("n_events"))
    best = F.min(F.struct("n_events", "trace_id")).alias("b")
    return traces.where("success").join(n, "trace_id").groupBy("task_id").agg(best).select("task_id", F.col("b.trace_id").alias("trace_id"), F.col("b.n_events").alias("n_events"))


def milestones(signatures: DataFrame) -> DataFrame:
    """Steps M1 to M5 of every trace whose task has an anchor; null where not reached. signatures come from judge_by_anchor()."""
    s = signatures.where("n_anchor is not null")
    read = (F.col("action_class") == "FILE_READ") & F.col("hit") & (F.col("effect") != "FAILED")
    firsts = s.where(read).groupBy("trace_id", "target").agg(F.min("idx").alias("at")).groupBy("trace_id").agg(F.count("*").alias("n_read"), F.max("at").alias("all_read"), F.min("at").alias("m1"))
    m = s.groupBy("trace_id").agg(
        F.max("n_anchor").alias("n_anchor"), F.min(F.when((F.col("action_class") == "SEARCH") & (F.col("effect") == "JUSTIFIED"), F.col("idx"))).alias("m2"),
        F.min(F.when(F.col("passed"), F.col("idx"))).alias("m4"), F.min(F.when(F.col("effect") == "JUSTIFIED", F.col("idx"))).alias("m5"),
    ).join(firsts, "trace_id", "left")
    return m.select("trace_id", "m1", "m2", F.when(F.col("n_read") == F.col("n_anchor"), F.col("all_read")).alias("m3"), "m4", "m5")


def signature_stats(signatures: DataFrame) -> DataFrame:
    return signatures.groupBy("trace_id", "action_class", "effect").agg(F.count("*").alias("n"))


def graph_nodes(events: DataFrame) -> DataFrame:
    """Events with a payload or refs."""
    return events.where(has_payload(events) | (F.size("refs") > 0)).select("trace_id", "id", "idx", "kind")


def graph_edges(events: DataFrame, nodes_only: bool = True) -> DataFrame:
    """Distinct edges from an earlier event to one that refers to it (trace_id, src, dst, src_idx, dst_idx)."""
    n = graph_nodes(events) if nodes_only else events.select("trace_id", "id", "idx", "kind")
    refs = events.select("trace_id", F.col("id").alias("dst"), F.col("idx").alias("dst_idx"), F.explode("refs").alias("src")).join(n.select("trace_id", F.col("id").alias("dst")), ["trace_id", "dst"], "left_semi")
    src = n.select("trace_id", F.col("id").alias("src"), F.col("idx").alias("src_idx"))
    return refs.join(src, ["trace_id", "src"]).where("src_idx < dst_idx").select("trace_id", "src", "dst", "src_idx", "dst_idx").distinct()


def graph_stats(events: DataFrame) -> DataFrame:
    nodes, edges = graph_nodes(events), graph_edges(events)
    inside = edges.select("trace_id", F.col("dst").alias("id")).distinct().withColumn("_in", F.lit(1))
    per = nodes.join(inside, ["trace_id", "id"], "left").groupBy("trace_id").agg(F.count("*").alias("n_nodes"), F.sum(F.col("_in").isNull().cast("int")).alias("n_sources"))
    e = edges.groupBy("trace_id").agg(F.count("*").alias("n_edges"))
    all_ = events.groupBy("trace_id").agg(F.count("*").alias("n_events"))
    out = all_.join(per, "trace_id", "left").join(e, "trace_id", "left").fillna(0, ["n_nodes", "n_sources", "n_edges"])
    return out.select("trace_id", "n_nodes", "n_edges", "n_sources", (F.col("n_nodes") / F.col("n_events")).alias("node_ratio"), F.when(F.col("n_nodes") > 0, F.col("n_edges") / F.col("n_nodes")).otherwise(0.0).alias("edges_per_node"))


def ancestors(events: DataFrame) -> DataFrame:
    """(trace_id, id, depth) of all that a trace's last event depends on, itself included; depth is the least number of references on the way.

    Reach by doubling: round k joins what is reached so far with the walks of exactly 2^k references, then joins these walks with themselves, without pairs that shorter walks have. Rounds are as many as the logarithm of the longest chain; refs point backwards, so walks run out.
    """
    reached = events.groupBy("trace_id").agg(F.max_by("id", "idx").alias("id")).withColumn("depth", F.lit(0))
    walks = durable_long(graph_edges(events, nodes_only=False).select("trace_id", F.col("dst").alias("id"), "src").distinct())
    seen, length = walks, 1
    while not walks.isEmpty():
        far = reached.join(walks, ["trace_id", "id"]).select("trace_id", F.col("src").alias("id"), (F.col("depth") + length).alias("depth"))
        reached = durable_long(reached.unionByName(far).groupBy("trace_id", "id").agg(F.min("depth").alias("depth")))
        second = walks.select("trace_id", F.col("id").alias("src"), F.col("src").alias("_src"))
        walks = durable_long(walks.join(second, ["trace_id", "src"]).select("trace_id", "id", F.col("_src").alias("src")).distinct().join(seen, ["trace_id", "id", "src"], "left_anti"))
        seen, length = seen.unionByName(walks), 2 * length
    return reached


EXPLORE = ("search", "read_doc")


def step_tree(events: DataFrame, explore: tuple[str, ...] = EXPLORE) -> DataFrame:
    """Steps with parent and depth: exploring calls are siblings of the step before, others its children. Closed form over two windows."""
    s = events.where(F.col("kind").isin(*STEP_KINDS))
    state = ~((F.col("kind") == "TOOL_CALL") & F.coalesce(F.col("action").isin(*explore), F.lit(False)))
    s = s.withColumns({"_state": state, "_prev": F.lag("id").over(by_trace())})
    parent = F.last(F.when(F.col("_state"), F.struct("_prev")), ignorenulls=True).over(upto())["_prev"]
    first = F.first("_state").over(upto())
    depth = 1 + F.sum(F.col("_state").cast("int")).over(upto()) - first.cast("int")
    return s.withColumns({"parent_step": parent, "depth": depth.cast("int"), "step_class": F.when(F.col("_state"), "state").otherwise("explore")}).drop("_state", "_prev")


def step_summaries(events: DataFrame) -> DataFrame:
    """Per step: summary (agent, action or kind, first payload field as key=value; cut at 60; then what came back, cut at 100 in all) and outcome (starts of the observations up to the next step, joined)."""
    group = F.last(F.when(F.col("kind").isin(*STEP_KINDS), F.col("idx")), ignorenulls=True).over(upto())
    e = events.withColumn("step", group).where("step is not null")
    obs = F.transform(F.array_sort(F.collect_list(F.when((F.col("idx") != F.col("step")) & (F.coalesce("content", F.lit("")) != ""), F.struct("idx", "content")))), lambda o: F.substring(o["content"], 1, 40))
    keys = {"query": "query", "doc_id": "doc_id", "answer": "answer", "to_agent": "to", "content": "content"}
    field = F.coalesce(*(F.when(F.col(c) != "", F.concat(F.lit(f"{k}="), F.substring(c, 1, 30))) for c, k in keys.items()))
    summary = F.substring(F.concat_ws(" ", "agent", F.coalesce(F.nullif("action", F.lit("")), F.lower("kind")), field), 1, 60)
    s = e.groupBy("trace_id", "step").agg(F.max(F.when(F.col("idx") == F.col("step"), summary)).alias("summary"), F.array_join(obs, " | ").alias("outcome"))
    return s.withColumn("summary", F.when(F.col("outcome") != "", F.substring(F.concat("summary", F.lit(" -> "), "outcome"), 1, 100)).otherwise(F.col("summary")))


def stage_ranges(events: DataFrame) -> DataFrame:
    """Intervals of the same phase over events that have one: (trace_id, stage_no, phase, start_idx, end_idx)."""
    e = events.where("phase is not null")
    change = F.coalesce((F.lag("phase").over(by_trace()) != F.col("phase")).cast("int"), F.lit(1))
    e = e.withColumn("stage_no", F.sum(F.col("_c")).over(upto())) if "_c" in e.columns else e.withColumn("_c", change).withColumn("stage_no", F.sum("_c").over(upto()))
    return e.groupBy("trace_id", "stage_no").agg(F.first("phase").alias("phase"), F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"))


def tree_markdown(events: DataFrame) -> DataFrame:
    """The step tree of each trace as indented lines, with a marker where the stage changes."""
    t = step_tree(events).join(step_summaries(events).withColumnRenamed("step", "idx"), ["trace_id", "idx"])
    stage = F.coalesce("phase", F.lit("?"))
    t = t.withColumn("_mark", F.coalesce(F.lag(stage).over(by_trace()) != stage, F.lit(True)))
    line = F.concat(F.when(F.col("_mark"), F.concat(F.lit("## "), stage, F.lit("\n"))).otherwise(F.lit("")), F.repeat(F.lit("  "), F.col("depth") - 1), F.lit("- ["), F.col("idx").cast("string"), F.lit("] "), "summary", F.when(F.col("outcome") != "", F.concat(F.lit(" => "), "outcome")).otherwise(F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x["line"])
    return t.groupBy("trace_id").agg(F.array_join(lines, "\n").alias("markdown"))


def with_subtask(events: DataFrame) -> DataFrame:
    """Events with the number of their subtask: phase intervals that tile the trace."""
    last = F.last("phase", ignorenulls=True).over(before())
    e = events.withColumn("_c", (F.col("phase").isNotNull() & F.coalesce(last != F.col("phase"), F.lit(True))).cast("int"))
    return e.withColumn("subtask", (F.greatest(F.lit(1), F.sum("_c").over(upto())) - 1).cast("int")).drop("_c")


def subtasks(events: DataFrame) -> DataFrame:
    s = with_subtask(events)
    return s.groupBy("trace_id", "subtask").agg(F.coalesce(F.min_by("phase", F.when(F.col("phase").isNotNull(), F.col("idx"))), F.lit("task")).alias("phase"), F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"))


def agent_nodes(events: DataFrame) -> DataFrame:
    """Per subtask and agent: first observation (TOOL_RESULT), thought (LLM_CALL), action (TOOL_CALL) and result (VERIFIER), and its steps: events of these four kinds. Results and verdicts belong to the agent of their first ref, and to nobody if there is none such; the environment and verifiers have no node."""
    s = with_subtask(events)
    who = s.select("trace_id", F.col("id").alias("_ref"), F.col("agent").alias("_owner"))
    s = s.withColumn("_ref", F.when(F.col("kind").isin("TOOL_RESULT", "VERIFIER") & (F.size("refs") > 0), F.col("refs")[0])).join(who, ["trace_id", "_ref"], "left")
    s = s.withColumn("owner", F.when(F.col("kind").isin("TOOL_RESULT", "VERIFIER"), F.col("_owner")).otherwise(F.col("agent"))).where("owner not in ('env', 'verifier') and kind in ('TOOL_RESULT', 'LLM_CALL', 'TOOL_CALL', 'VERIFIER')")
    at = lambda *kinds: F.min(F.when(F.col("kind").isin(*kinds), F.col("idx")))
    return s.groupBy("trace_id", "subtask", F.col("owner").alias("agent")).agg(
        at("TOOL_RESULT").alias("observation"), at("LLM_CALL").alias("thought"), at("TOOL_CALL").alias("action"), at("VERIFIER").alias("result"), F.array_join(F.sort_array(F.collect_list("idx")).cast("array<string>"), ",").alias("steps"),
    )


def hcg_edges(events: DataFrame) -> DataFrame:
    """(trace_id, level, src, dst, subtask, step): adjacent subtasks, handoffs between agents (each with its subtask and step), references between steps."""
    sub = subtasks(events).withColumn("nxt", F.lead("subtask").over(Window.partitionBy("trace_id").orderBy("subtask"))).where("nxt is not null")
    name = lambda c: F.concat(F.lit("S"), F.col(c).cast("string"))
    where = with_subtask(events).where("kind = 'HANDOFF'")
    hand = where.select("trace_id", F.lit("agent").alias("level"), F.col("agent").alias("src"), F.when(F.coalesce("to_agent", F.lit("")) == "", "?").otherwise(F.col("to_agent")).alias("dst"), name("subtask").alias("subtask"), F.col("idx").cast("int").alias("step"))
    step = graph_edges(events, nodes_only=False).select("trace_id", F.lit("step").alias("level"), "src", "dst")
    bare = lambda d: d.withColumns({"subtask": F.lit(None).cast("string"), "step": F.lit(None).cast("int")})
    return bare(sub.select("trace_id", F.lit("subtask").alias("level"), name("subtask").alias("src"), name("nxt").alias("dst"))).unionByName(hand).unionByName(bare(step))


def rule_claims(events: DataFrame, traces: DataFrame, most: int = 5) -> DataFrame:
    """Claims by rule, by step: plans (from memory: an entity; else a process), handoffs to the reporter and grounded decisions (evidence); where the task says what must be cited, the constraint at the first submit comes last. `most` a trace.

    Columns: trace_id, claim_id, text, claim_type, status, introduced, effective (first handoff, decision or call after it), reuse (the same step).
    """
    e = events.withColumn("effective", F.first(F.when(F.col("kind").isin("HANDOFF", "LLM_CALL", "TOOL_CALL"), F.col("idx")), ignorenulls=True).over(by_trace().rowsBetween(1, Window.unboundedFollowing)))
    said = F.coalesce("content", F.lit(""))
    load = F.concat_ws(" ", "to_agent", "query", "doc_id", "answer", "action")
    claim = lambda text, kind, status, last=0: F.struct(F.substring(text, 1, 120).alias("text"), F.lit(kind).alias("claim_type"), F.lit(status).alias("status"), F.lit(last).alias("last"))
    plan = (F.col("kind") == "LLM_CALL") & said.startswith("plan:")
    hand = (F.col("kind") == "HANDOFF") & F.contains(load, F.lit("reporter"))
    c = (
        F.when(plan & said.rlike(MEMORY), claim(F.lit("the answer is already known from memory"), "entity", "finalized"))
        .when(plan, claim(F.lit("the task will be solved by search-read-report"), "process", "consequential"))
        .when(hand & said.rlike(NOTHING_USABLE), claim(F.lit("no relevant documents were found"), "evidence", "consequential"))
        .when(hand & (said != ""), claim(said, "evidence", "consequential"))
        .when((F.col("kind") == "LLM_CALL") & said.rlike("(?i)based on|answer:|proposes"), claim(said, "evidence", "finalized"))
    )
    submit = F.min(F.when((F.col("kind") == "TOOL_CALL") & (F.col("action") == "submit"), F.col("idx"))).over(Window.partitionBy("trace_id")) == F.col("idx")
    must = traces.where(F.col("task").rlike(MUST_CITE)).select("trace_id", F.lit(True).alias("must"))
    e = e.withColumns({"c": c, "first_submit": F.coalesce(submit, F.lit(False))}).where("c is not null or first_submit").join(must, "trace_id", "left")
    e = e.withColumn("c", F.when(F.col("first_submit"), F.when(F.col("must"), claim(F.lit("the final answer must cite a document actually read"), "constraint", "consequential", 1))).otherwise(F.col("c"))).where("c is not null")
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("trace_id").orderBy("c.last", "idx"))).where(F.col("n") <= most)
    reuse = F.when(F.col("effective").isNotNull(), F.array("effective")).otherwise(F.array().cast("array<int>"))
    return e.select("trace_id", F.concat(F.lit("c"), F.col("n").cast("string")).alias("claim_id"), "c.text", "c.claim_type", "c.status", F.col("idx").alias("introduced"), "effective", reuse.alias("reuse"))


def claim_ledger(verdicts: DataFrame, events: DataFrame, most: int = 6) -> DataFrame:
    """verdicts (trace_id, response: an answer with JSON {claims: [{id, text, type, status, introduced_step, first_effective_step, reuse_steps}]}) -> claims by position: steps clamped into the trace, none before it is introduced, reuse sorted and distinct. Claims of an unknown type or status have valid false and count for nothing; of the others `most` a trace stay."""
    schema = "claims array<struct<id:string,text:string,type:string,status:string,introduced_step:int,first_effective_step:int,reuse_steps:array<int>>>"
    v = verdicts.withColumn("v", first_valid(F.col("response"), schema, lambda v: v["claims"].isNotNull()))
    v = v.select("trace_id", F.posexplode("v.claims").alias("pos", "c")).join(events.groupBy("trace_id").agg(F.max("idx").alias("last")), "trace_id")
    valid = F.coalesce(F.col("c.type").isin(*CLAIM_TYPES) & F.col("c.status").isin(*CLAIM_STATUSES), F.lit(False))
    within = lambda x, low: F.least(F.greatest(x, low), F.col("last"))
    v = v.withColumns({"valid": valid, "introduced": within(F.col("c.introduced_step"), F.lit(0))})
    v = v.withColumn("nth", F.sum(F.col("valid").cast("int")).over(Window.partitionBy("trace_id").orderBy("pos"))).where(~F.col("valid") | (F.col("nth") <= most))
    effective = F.when(F.col("c.first_effective_step").isNotNull(), within(F.col("c.first_effective_step"), F.col("introduced")))
    reuse = F.array_sort(F.array_distinct(F.transform(F.coalesce("c.reuse_steps", F.array().cast("array<int>")), lambda x: within(x, F.col("introduced")))))
    return v.select("trace_id", F.col("c.id").alias("claim_id"), "c.text", F.col("c.type").alias("claim_type"), "c.status", "valid", F.when(F.col("valid"), F.col("introduced")).alias("introduced"), F.when(F.col("valid"), effective).alias("effective"), F.when(F.col("valid"), reuse).alias("reuse"))


def render_lines(events: DataFrame, folds: DataFrame | None = None) -> DataFrame:
    """One line per event: [i] KIND agent action payload :: content; a payload column is shown with all its keys but content. Folded contents show their placeholder. No ground truth enters a line."""
    e = events
    if folds is not None:
        e = e.join(folds.select("trace_id", "idx", "placeholder"), ["trace_id", "idx"], "left").withColumn("content", F.coalesce("placeholder", "content"))
    load = other_keys(e, "content")
    head = F.concat_ws(" ", F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("]")), "kind", "agent", "action", load)
    return e.select("trace_id", "idx", shorten(F.concat(head, F.when(F.coalesce("content", F.lit("")) != "", F.concat(F.lit(" :: "), "content")).otherwise(F.lit("")))).alias("line"))


def render_traces(events: DataFrame, traces: DataFrame, folds: DataFrame | None = None, outcome: bool = False) -> DataFrame:
    """The judge's view of each trace: task, outcome if asked for, and the lines. Only task and success of the trace are read."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n")
    body = render_lines(events, folds).groupBy("trace_id").agg(lines.alias("body"))
    head = F.concat(F.lit("TASK: "), "task", F.when(F.lit(outcome), F.concat(F.lit("\nOUTCOME: "), F.when(F.col("success"), "success").otherwise("failure"))).otherwise(F.lit("")))
    return traces.select("trace_id", "task", "success").join(body, "trace_id").select("trace_id", F.concat_ws("\n", head, F.lit("=== TRACE BEGIN ==="), "body", F.lit("=== TRACE END ===")).alias("view"))
