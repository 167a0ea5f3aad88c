"""Failure rules and symptoms of traces, and labels checked against the failure modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.answers import first_valid
from tracewright.model import ASSERTION, DOC_ID, ERROR_OBS, FORMAT_ISSUE, MEMORY, NO_RESULT, REJECT, RULE_CODE, SYMPTOM_CODE
from tracewright.operators.payload import has_payload, payload_state
from tracewright.operators.represent import before, by_trace, upto, first_answer
from tracewright.tables import durable

FINDING = ("trace_id", "rule", "step", "agent", "code")


def _finding(df: DataFrame, rule: str, step="step", agent="agent") -> DataFrame:
    return df.select("trace_id", F.lit(rule).alias("rule"), F.col(step).cast("int").alias("step"), F.col(agent).alias("agent"), F.lit(RULE_CODE[rule]).alias("code"))


def last_llm() -> Column:
    return F.last(F.when(F.col("kind") == "LLM_CALL", F.struct(F.col("idx").alias("i"), F.col("agent").alias("a"))), ignorenulls=True).over(before())


def malformed_calls(events: DataFrame) -> DataFrame:
    """Calls without any payload, or whose result is an error observation."""
    return _finding(malformed_reasons(events), "malformed_tool_call", "idx")


def malformed_reasons(events: DataFrame) -> DataFrame:
    """Malformed calls with `reason`: 'empty' (an object without keys was sent), 'missing' (nothing was sent) or 'error' (the result says so)."""
    calls = events.where("kind = 'TOOL_CALL'").join(first_answer(events, "TOOL_RESULT"), ["trace_id", "id"], "left")
    state, error = payload_state(events), F.coalesce(F.col("tool_result_content").rlike(ERROR_OBS), F.lit(False))
    return calls.withColumn("reason", F.when(state != "given", state).when(error, "error")).where("reason is not null")


def premature_success(events: DataFrame) -> DataFrame:
    """Submits without an earlier read that succeeded, at the last decision before."""
    e = events.join(first_answer(events, "TOOL_RESULT"), ["trace_id", "id"], "left")
    ok = (F.col("kind") == "TOOL_CALL") & (F.col("action") == "read_doc") & F.col("tool_result_content").isNotNull() & ~F.col("tool_result_content").rlike(ERROR_OBS)
    e = e.withColumns({"read": F.coalesce(F.max(ok.cast("int")).over(before()), F.lit(0)), "d": last_llm()}).where("kind = 'TOOL_CALL' and action = 'submit' and read = 0")
    return _finding(e.withColumns({"step": F.coalesce("d.i", "idx"), "agent": F.coalesce("d.a", "agent")}), "premature_success_claim")


def invalid_outputs(events: DataFrame) -> DataFrame:
    """The first verdict of a trace that rejects the form of an answer and has a decision before it, at that decision."""
    v = events.withColumn("d", last_llm()).where("kind = 'VERIFIER' and startswith(content, 'failed') and d is not null").where(F.col("content").rlike(REJECT))
    v = v.groupBy("trace_id").agg(F.min_by("d", "idx").alias("d"))
    return _finding(v.select("trace_id", F.col("d.i").alias("step"), F.col("d.a").alias("agent")), "invalid_output")


def no_progress(sigs: DataFrame, loops: DataFrame | None = None, searches: DataFrame | None = None, min_repeats: int = 3) -> DataFrame:
    """Loop hits at their onset, and reads of which min_repeats are the same, at the first of them. Without tables of loops, searches are counted like reads."""
    w = Window.partitionBy("trace_id", "signature")
    classes = ("FILE_READ",) if loops is not None else ("SEARCH", "FILE_READ")
    reads = sigs.where(F.col("action_class").isin(*classes)).withColumns({"n": F.count("*").over(w), "nth": F.row_number().over(w.orderBy("idx"))}).where((F.col("n") >= min_repeats) & (F.col("nth") == 1))
    reads = _finding(reads, "no_progress_loop", "idx")
    if loops is None:
        return reads
    who = sigs.select("trace_id", F.col("idx").alias("step"), "agent")
    hits = loops.select("trace_id", F.coalesce("onset", "start_idx").alias("step")).unionByName(searches.select("trace_id", F.col("start_idx").alias("step")))
    return _finding(hits.join(who, ["trace_id", "step"], "left"), "no_progress_loop").unionByName(reads)


def rule_findings(events: DataFrame, sigs: DataFrame, loops: DataFrame, searches: DataFrame) -> DataFrame:
    out = malformed_calls(events)
    for more in (premature_success(events), invalid_outputs(events), no_progress(sigs, loops, searches)):
        out = out.unionByName(more)
    order = F.element_at(F.create_map(*[F.lit(x) for k, r in enumerate(("malformed_tool_call", "premature_success_claim", "invalid_output", "no_progress_loop")) for x in (r, k)]), F.col("rule"))
    return out.withColumns({"rule_order": order, "confidence": F.lit(0.9)})


def citations(events: DataFrame) -> DataFrame:
    """Messages that assert or bracket a document, with it as `doc`."""
    m = events.where("kind in ('LLM_CALL', 'AGENT_MESSAGE') and coalesce(action, '') <> 'search'").withColumn("doc", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(DOC_ID), F.lit(0)))))
    cited = F.col("content").rlike(ASSERTION) | F.contains(F.col("content"), F.concat(F.lit("["), "doc", F.lit("]"))) | F.contains(F.col("content"), F.concat(F.lit("("), "doc", F.lit(")")))
    return m.where(cited)


def unread_citations(events: DataFrame) -> DataFrame:
    """Citations of a document that no earlier call has read: a document is unread at a step if its first read is not before it."""
    reads = events.where("kind = 'TOOL_CALL' and action = 'read_doc'").groupBy("trace_id", F.col("doc_id").alias("doc")).agg(F.min("idx").alias("read_at"))
    return citations(events).join(reads, ["trace_id", "doc"], "left").where("read_at is null or read_at > idx")


def symptoms(events: DataFrame, fallback: bool = True) -> DataFrame:
    """Symptoms of every trace by the ordered rules; the first is the primary one. One pass of windows over the traces flags rules 1 to 4 and 6, one aggregation picks their first rows; only citations of unread documents (5) need a join."""
    kind = lambda *k: F.col("kind").isin(*k)
    here = F.struct(F.col("idx").alias("step"), "agent")
    call, llm = kind("TOOL_CALL"), kind("LLM_CALL")
    sig = F.when(call, F.to_json(F.struct("agent", "action", "query", "doc_id", "answer", "content", "to_agent")))
    after = by_trace().rowsBetween(1, Window.unboundedFollowing)
    found = kind("TOOL_RESULT") & (F.col("action") == "search") & (F.regexp_extract("content", r"(\d+) docs", 1).try_cast("int") > 0)
    once = lambda flag: F.max(F.coalesce(flag, F.lit(False))).over(before())
    e = events.withColumn("sig", sig).withColumns({
        "call": F.last(F.when(call, here), ignorenulls=True).over(before()), "llm": F.last(F.when(llm, here), ignorenulls=True).over(before()), "s1": F.last("sig", ignorenulls=True).over(before()), "s2": F.first("sig", ignorenulls=True).over(after),
        "hit": once(found), "read": once(call & (F.col("action") == "read_doc")),
    })
    said = F.coalesce("content", F.lit(""))
    error, early = kind("TOOL_RESULT") & said.rlike(ERROR_OBS), call & (F.col("action") == "submit") & ~F.coalesce("read", F.lit(False))
    denied = kind("AGENT_MESSAGE", "LLM_CALL", "HANDOFF") & F.coalesce("hit", F.lit(False)) & said.rlike(NO_RESULT)
    per = e.groupBy("trace_id").agg(
        F.min_by("call", F.when(error, F.col("idx"))).alias("r1"), F.min(F.when((F.col("sig") == F.col("s1")) & (F.col("sig") == F.col("s2")), here)).alias("r2"), F.min(F.when(denied, here)).alias("r3"), F.min_by(F.coalesce("llm", here), F.when(early, F.col("idx"))).alias("r4"),
        F.max(F.when(llm, here)).alias("last"), F.max(kind("VERIFIER") & said.rlike(FORMAT_ISSUE)).alias("issue"),
    )
    unread = unread_citations(events).groupBy("trace_id").agg(F.min(here).alias("r5"))
    per = per.join(unread, "trace_id", "left").withColumn("r6", F.when(F.col("issue"), F.col("last")))
    if fallback:
        per = per.withColumn("r7", F.when(F.coalesce(*(f"r{k}" for k in range(1, 7))).isNull(), F.col("last")))
    rules = list(SYMPTOM_CODE)[: 7 if fallback else 6]
    rows = F.array(*(F.when(F.col(f"r{k}").isNotNull(), F.struct(F.lit(k).alias("rule_no"), F.lit(f).alias("fault"), F.col(f"r{k}.step").cast("int").alias("step"), F.col(f"r{k}.agent").alias("agent"), F.lit(SYMPTOM_CODE[f]).alias("code"))) for k, f in enumerate(rules, 1)))
    return per.select("trace_id", F.explode(rows).alias("r")).where("r is not null").select("trace_id", "r.*")


def primary_symptom(found: DataFrame) -> DataFrame:
    return found.groupBy("trace_id").agg(F.min_by(F.struct("fault", "step", "agent", "code"), "rule_no").alias("p")).select("trace_id", "p.*")


def segment_symptoms(segments: DataFrame) -> DataFrame:
    """Whether a segment's events (trace_id and the event columns) show a symptom of their own: the rules, empty calls, contradictions and decisions from memory."""
    base = symptoms(segments, fallback=False).select("trace_id")
    empty = segments.where("kind = 'TOOL_CALL' and action is not null").where(F.coalesce("content", "query", "doc_id", "answer", "to_agent").isNull()).select("trace_id")
    shown = (F.col("kind") == "TOOL_RESULT") & (((F.col("action") == "search") & (F.regexp_extract("content", r"(\d+) docs", 1).try_cast("int") > 0)) | ((F.col("action") == "read_doc") & ~F.coalesce(F.col("content").rlike(ERROR_OBS), F.lit(False))))
    claim = segments.withColumn("hit", F.max(F.coalesce(shown, F.lit(False)).cast("int")).over(before())).where("kind in ('AGENT_MESSAGE', 'LLM_CALL', 'HANDOFF') and hit = 1").where(F.col("content").rlike(NO_RESULT)).select("trace_id")
    memory = segments.where("kind = 'LLM_CALL'").where(F.col("content").rlike(MEMORY)).select("trace_id")
    return base.unionByName(empty).unionByName(claim).unionByName(memory).distinct()


def witnesses(events: DataFrame) -> DataFrame:
    """(trace_id, lo_min, lo_max, hi_min): segment_symptoms() of the segment [lo, hi] finds something just if some row has lo_min <= lo <= lo_max and hi >= hi_min. All rows come from one pass of windows, but for citations, which follow the last read of their document before."""
    kind = lambda *k: F.col("kind").isin(*k)
    at, said = F.col("idx"), F.coalesce("content", F.lit(""))
    call, llm = kind("TOOL_CALL"), kind("LLM_CALL")
    sig = F.when(call, F.to_json(F.struct("agent", "action", "query", "doc_id", "answer", "content", "to_agent")))
    after = by_trace().rowsBetween(1, Window.unboundedFollowing)
    error, issue = kind("TOOL_RESULT") & said.rlike(ERROR_OBS), kind("VERIFIER") & said.rlike(FORMAT_ISSUE)
    shown = kind("TOOL_RESULT") & (((F.col("action") == "search") & (F.regexp_extract(said, r"(\d+) docs", 1).try_cast("int") > 0)) | ((F.col("action") == "read_doc") & ~said.rlike(ERROR_OBS)))
    read = call & (F.col("action") == "read_doc")
    last = lambda flag, w=None: F.max(F.when(flag, at)).over(w or before())
    e = events.withColumn("_sig", sig).withColumns({
        "_error": last(error), "_call": last(call), "_shown": last(shown), "_read": last(read), "_llm": last(llm), "_next_llm": F.min(F.when(llm, at)).over(after), "_next_call": F.min(F.when(call, at)).over(after),
        "_s1": F.last("_sig", ignorenulls=True).over(before()), "_s2": F.first("_sig", ignorenulls=True).over(after),
    })
    since = lambda c: F.coalesce(F.col(c) + 1, F.lit(0))
    row = lambda when, lo_min, lo_max, hi_min: F.when(when & lo_max.isNotNull() & hi_min.isNotNull(), F.struct(lo_min.cast("int").alias("lo_min"), lo_max.cast("int").alias("lo_max"), hi_min.cast("int").alias("hi_min")))
    zero, empty = F.lit(0), call & F.col("action").isNotNull() & ~has_payload(events)
    rows = F.array(
        row(error, since("_error"), F.col("_call"), at), row((F.col("_sig") == F.col("_s1")) & (F.col("_sig") == F.col("_s2")), zero, F.col("_call"), F.col("_next_call")), row(kind("AGENT_MESSAGE", "LLM_CALL", "HANDOFF") & said.rlike(NO_RESULT), zero, F.col("_shown"), at),
        row(call & (F.col("action") == "submit"), since("_read"), at, at), row(issue, zero, F.col("_llm"), at), row(issue, zero, at, F.col("_next_llm")), row(empty | (llm & said.rlike(MEMORY)), zero, at, at),
    )
    out = e.select("trace_id", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("w")).select("trace_id", "w.*")
    docs = citations(events).select("trace_id", "doc", "idx", F.lit(None).cast("int").alias("read")).unionByName(events.where(read).select("trace_id", F.col("doc_id").alias("doc"), "idx", F.col("idx").cast("int").alias("read")))
    held = F.max("read").over(Window.partitionBy("trace_id", "doc").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    cited = docs.withColumn("_held", held).where("read is null").select("trace_id", since("_held").cast("int").alias("lo_min"), at.cast("int").alias("lo_max"), at.cast("int").alias("hi_min"))
    return out.unionByName(cited)


def checked_labels(verdicts: DataFrame, modes: DataFrame, most: int = 3) -> DataFrame:
    """verdicts (trace_id, labels: array of {code, symptom, step}) checked against modes (code): novel labels need a symptom; valid ones are cut at `most` after checking. Columns: pos, code, status kept, overflow or invalid."""
    v = verdicts.select("trace_id", F.posexplode("labels").alias("pos", "l")).select("trace_id", "pos", "l.*")
    v = v.join(modes.select("code", F.lit(True).alias("known")).distinct(), "code", "left")
    ok = F.coalesce("known", F.lit(False)) | ((F.col("code") == "novel") & (F.coalesce(F.trim("symptom"), F.lit("")) != ""))
    v = v.withColumn("ok", ok).withColumn("nth", F.sum(F.col("ok").cast("int")).over(Window.partitionBy("trace_id").orderBy("pos")))
    return v.select("trace_id", "pos", "code", F.when(~F.col("ok"), "invalid").when(F.col("nth") <= most, "kept").otherwise("overflow").alias("status"))


def labels_of_answers(answers: DataFrame) -> DataFrame:
    """answers (trace_id, response: an answer with JSON {labels: [{code, reason, step, symptom}]} in it) -> verdicts for checked_labels(); an answer without such an object has no labels."""
    v = first_valid(F.col("response"), "labels array<struct<code:string,symptom:string,step:int>>", lambda v: v["labels"].isNotNull() & ~F.exists(v["labels"], lambda x: x["code"].isNull()))
    return answers.select("trace_id", F.coalesce(v["labels"], F.array().cast("array<struct<code:string,symptom:string,step:int>>")).alias("labels"))


#: Words that say nothing about a symptom.
STOP_WORDS = ("the", "a", "an", "to", "for", "of", "and", "or", "before", "after", "is", "are", "was", "were", "be", "been", "i", "will", "would", "shall", "should", "which", "please", "with", "that", "this", "these", "those", "it", "its", "task", "answer", "not", "any", "all", "into", "from")


def novel_symptoms(events: DataFrame) -> DataFrame:
    """Most repeated message of a trace (twice at least; by text on ties), else the start of its last decision."""
    n = events.where("kind in ('HANDOFF', 'AGENT_MESSAGE') and coalesce(content, '') <> ''").groupBy("trace_id", "content").agg(F.count("*").alias("n"), F.min("idx").alias("step")).where("n >= 2")
    top = n.groupBy("trace_id").agg(F.min_by(F.struct("content", "step"), F.struct(-F.col("n"), "content")).alias("m"))
    last = events.where("kind = 'LLM_CALL'").groupBy("trace_id").agg(F.max_by(F.struct("content", "idx"), "idx").alias("l"))
    return last.join(top, "trace_id", "full_outer").select("trace_id", F.coalesce("m.content", F.substring("l.content", 1, 100)).alias("symptom"), F.coalesce("m.step", "l.idx").alias("step"))


def trigrams(text) -> Column:
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), r"\s+", " "))
    return F.when(F.length(norm) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(norm) - 2, F.lit(1))), lambda i: F.substring(norm, i, F.lit(3))))).otherwise(F.array(norm))


def similar_pairs(symptoms_: DataFrame, threshold: float = 0.35) -> DataFrame:
    """symptoms (ord, symptom; different texts) -> (a, b, similarity), a < b, trigram Jaccard at least threshold. An inverted index on the rarest trigrams of each text: texts that similar must share one of its first n - ceil(t n) + 1 by global rarity."""
    t = symptoms_.select("ord", F.explode(trigrams(F.col("symptom"))).alias("g"))
    n = t.groupBy("g").agg(F.count("*").alias("df"))
    t = t.join(n, "g")
    w = Window.partitionBy("ord")
    t = t.withColumns({"k": F.row_number().over(w.orderBy("df", "g")), "n": F.count("*").over(w)})
    prefix = t.where(F.col("k") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).select("ord", "g")
    pairs = prefix.alias("x").join(prefix.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("x.ord") < F.col("y.ord"))).select(F.col("x.ord").alias("a"), F.col("y.ord").alias("b")).distinct()
    s = symptoms_.select("ord", trigrams(F.col("symptom")).alias("s"))
    j = pairs.join(s.select(F.col("ord").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("ord").alias("b"), F.col("s").alias("sb")), "b")
    sim = F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))
    return j.select("a", "b", sim.alias("similarity")).where(F.col("similarity") >= threshold)


def leader_clusters(nodes: DataFrame, pairs: DataFrame, materialize=durable) -> DataFrame:
    """nodes (ord) and similar pairs (a < b) -> (ord, leader): the greedy clusters of a pass in order, by rounds until every node is decided. The first undecided node always leads, so each round decides one at least. An undecided node without an undecided or leading earlier neighbour leads; later neighbours of a leader join the earliest one."""
    left, leaders = nodes.select("ord"), None
    pairs = materialize(pairs.select("a", "b"))
    while leaders is None or not left.isEmpty():
        earlier = pairs.join(left.select(F.col("ord").alias("a")), "a", "left_semi").select(F.col("b").alias("ord")).distinct()
        new = materialize(left.join(earlier, "ord", "left_anti"))
        leaders = new if leaders is None else leaders.unionByName(new)
        covered = pairs.join(new.select(F.col("ord").alias("a")), "a", "left_semi").select(F.col("b").alias("ord")).distinct()
        left = materialize(left.join(new, "ord", "left_anti").join(covered, "ord", "left_anti"))
    own = leaders.select("ord", F.col("ord").alias("leader"))
    near = pairs.join(leaders.select(F.col("ord").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("ord")).agg(F.min("a").alias("leader"))
    return own.unionByName(near.join(leaders, "ord", "left_anti"))


def extended_modes(proposals: DataFrame, builtin: DataFrame, strict: bool = True) -> DataFrame:
    """proposals (code, name, definition) -> with status: accepted, or skipped without a definition. With strict a code of a built-in mode is an error, even where it would be skipped; else its status is clash."""
    j = proposals.join(builtin.select("code", F.lit(True).alias("_own")).distinct(), "code", "left")
    return j.select("code", "name", "definition", F.when(F.col("_own"), F.raise_error(F.concat(F.lit("built-in code "), "code")).cast("string") if strict else F.lit("clash")).when(F.coalesce(F.trim("definition"), F.lit("")) == "", "skipped").otherwise("accepted").alias("status"))


def content_tokens(text: Column) -> Column:
    """Different words of three or more letters that aren't stop words, in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS)))


def match_modes(symptoms_: DataFrame, modes: DataFrame) -> DataFrame:
    """symptoms (id, symptom) with the mode (code, name) that shares most of their words, two at least; by code on ties."""
    s = symptoms_.select("id", F.explode(content_tokens(F.col("symptom"))).alias("w"))
    m = modes.select("code", F.explode(content_tokens(F.col("name"))).alias("w"))
    n = s.join(m, "w").groupBy("id", "code").agg(F.count("*").alias("overlap")).where("overlap >= 2")
    return n.groupBy("id").agg(F.min_by(F.struct("code", "overlap"), F.struct(-F.col("overlap"), "code")).alias("b")).select("id", "b.*")


def cluster_sizes(clusters: DataFrame, symptoms_: DataFrame) -> DataFrame:
    """clusters (ord, leader) and symptoms (ord, n: candidates of the text) -> (leader, size in candidates)."""
    return clusters.join(symptoms_, "ord").groupBy("leader").agg(F.sum("n").alias("size"))


def kinship(words: DataFrame, modes: DataFrame) -> DataFrame:
    """words (leader, word; different) and modes (code, name) -> (leader, kin, overlap) of the mode that holds the largest share of a cluster's words; by code on ties, no row without a common word."""
    m = modes.select("code", F.explode(content_tokens(F.col("name"))).alias("word"))
    n = words.groupBy("leader").agg(F.count("*").alias("n_words"))
    k = words.join(m, "word").groupBy("leader", "code").agg(F.count("*").alias("common")).join(n, "leader")
    k = k.groupBy("leader").agg(F.min_by(F.struct("code", "common", "n_words"), F.struct(-F.col("common"), "code")).alias("k"))
    return k.select("leader", F.col("k.code").alias("kin"), F.round(F.col("k.common") / F.col("k.n_words"), 4).alias("overlap"))


def proposals(clusters: DataFrame, symptoms_: DataFrame, modes: DataFrame, support: int = 3, most: int = 5, dedup: float = 0.8) -> DataFrame:
    """clusters (ord, leader), symptoms (ord, symptom, n: candidates of the text) and built-in modes (code, name) -> proposals of new modes: clusters of at least `support` candidates, named by their three most frequent words, with the mode they are next to; those that share `dedup` or more of their words with it are dropped; NM-n in order of leaders, `most` at most."""
    c = clusters.join(symptoms_, "ord")
    big = c.groupBy("leader").agg(F.sum("n").alias("support")).where(F.col("support") >= support)
    w = c.join(big, "leader").select("leader", "ord", F.col("n").alias("copies"), F.posexplode(F.filter(F.regexp_extract_all(F.lower("symptom"), F.lit("[a-z]{3,}"), F.lit(0)), lambda x: ~x.isin(*STOP_WORDS))).alias("pos", "word"))
    w = w.groupBy("leader", "word").agg(F.sum("copies").alias("n"), F.min(F.struct("ord", "pos")).alias("seen"))
    top = w.withColumn("k", F.row_number().over(Window.partitionBy("leader").orderBy(F.col("n").desc(), "seen"))).where("k <= 3")
    name = top.groupBy("leader").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("name"))
    kin = kinship(w.select("leader", "word"), modes)
    p = big.join(name, "leader", "left").join(kin, "leader", "left").where(F.coalesce("overlap", F.lit(0.0)) < dedup).orderBy("leader").limit(most).withColumn("n", F.row_number().over(Window.orderBy("leader")))  # at most `most` rows
    return p.select(F.concat(F.lit("NM-"), F.col("n").cast("string")).alias("mode_id"), F.coalesce("name", F.lit("unclassified residual")).alias("name"), "support", "leader", "kin", "overlap")
