"""Branches of the representations and rules, a row or two each."""


from pyspark.sql import functions as F

from tracewright.operators import attribute as t
from tracewright.operators import classify as c
from tracewright.operators import represent as r

COLS = "trace_id string, idx int, id string, ts double, kind string, agent string, action string, phase string, content string, query string, doc_id string, answer string, to_agent string, refs array<string>"


def ev(i, kind, agent, action=None, phase=None, content=None, query=None, doc=None, answer=None, to=None, refs=(), trace="t"):
    return (trace, i, f"e{i:03d}", float(i), kind, agent, action, phase, content, query, doc, answer, to, [f"e{k:03d}" for k in refs])


def test_folding_is_strict_by_default(spark):
    long = " x" * 100
    texts = ["the import failed" + long, " Error: gone" + long, "quota Reached" + long, "", None, "fails" + long, "ok", "a\n+++ b/f" + long]
    e = spark.createDataFrame([ev(i, "TOOL_RESULT", "env", content=s) for i, s in enumerate(texts)] + [ev(9, "LLM_CALL", "a", content="error: x")], COLS)
    how = lambda **x: {d.idx: d.decision for d in r.fold(e, **x).collect()}
    assert how() == {0: "fold", 1: "keep_error", 2: "fold", 5: "fold", 6: "keep_short", 7: "keep_patch"}
    assert how(loose=True)[0] == "keep_error" and how(loose=True)[5] == "fold" and how(extra=("QUOTA reached",))[2] == "keep_error"
    s = r.fold_stats(e, r.fold(e)).first()
    assert (s.n_tool_results, s.n_folded, s.n_kept_error, s.n_kept_patch, s.n_kept_short, s.fold_ratio) == (8, 3, 1, 1, 1, 0.375)


def test_anchors_with_signs(spark):
    """doc-1 is hit in [doc-1, doc-10], not in [doc-10]; ids of several runs, and ids that start or end with a sign."""
    says = ["docs [doc-1, doc-10]", "docs [doc-10]", "xdoc-1", "see a/b.c!", "see a/b.cd", "tag #7# here", "tag 7 here", "doc -1", None]
    sig = spark.createDataFrame([("t", i, f"e{i:03d}", "SEARCH", "q", "RECORDED", s) for i, s in enumerate(says)] + [("t", 20, "e020", "FILE_READ", "#7#", "JUSTIFIED", "x"), ("t", 21, "e021", "FILE_READ", "7", "JUSTIFIED", "x"), ("t", 22, "e022", "SEARCH", "q", "FAILED", "doc-1")], "trace_id string, idx int, id string, action_class string, target string, effect string, tool_result_content string")
    docs = spark.createDataFrame([("k", d) for d in ("doc-1", "a/b.c", "#7#")], "task_id string, document string")
    got = {x.idx: x.effect for x in r.judge_by_anchor(sig, docs, spark.createDataFrame([("t", "k")], "trace_id string, task_id string")).collect()}
    assert {i for i, e in got.items() if e == "JUSTIFIED"} == {0, 3, 5, 20} and got[22] == "FAILED" and got[1] == got[21] == "OFF-ANCHOR"


def test_repeats_are_found_at_the_first(spark):
    rows = [("t", i, "a", k, s) for i, (k, s) in enumerate([("FILE_READ", "r(x)"), ("SEARCH", "s(q)"), ("FILE_READ", "r(x)"), ("SEARCH", "s(q)"), ("FILE_READ", "r(x)"), ("SEARCH", "s(q)"), ("COMMAND", "c"), ("COMMAND", "c"), ("COMMAND", "c")])]
    sigs = spark.createDataFrame(rows, "trace_id string, idx int, agent string, action_class string, signature string")
    loops = spark.createDataFrame([("t", 1, 0)], "trace_id string, start_idx int, onset int")
    searches = spark.createDataFrame([("t", 3)], "trace_id string, start_idx int")
    assert sorted(x.step for x in c.no_progress(sigs, loops, searches).collect()) == [0, 0, 3]
    assert sorted(x.step for x in c.no_progress(sigs).collect()) == [0, 1]


def test_agent_nodes_are_of_four_kinds(spark):
    e = spark.createDataFrame([
        ev(0, "TASK_START", "user"), ev(1, "LLM_CALL", "A"), ev(2, "TOOL_CALL", "A"), ev(3, "TOOL_RESULT", "env", refs=(2,)), ev(4, "TOOL_RESULT", "B", refs=(99,)), ev(5, "TOOL_RESULT", "B"), ev(6, "HANDOFF", "A", to=""), ev(7, "AGENT_MESSAGE", "C"),
        ev(8, "VERIFIER", "verifier", refs=(2, 1)), ev(9, "VERIFIER", "verifier"), ev(10, "LLM_CALL", "env"),
    ], COLS)
    assert [tuple(x)[1:] for x in r.agent_nodes(e).collect()] == [(0, "A", 3, 1, 2, 8, "1,2,3,8")]
    edges = {(x.level, x.src, x.dst, x.subtask, x.step) for x in r.hcg_edges(e).collect()}
    assert ("agent", "A", "?", "S0", 6) in edges and ("step", "e002", "e003", None, None) in edges


def test_summaries_hold_what_came_back(spark):
    e = spark.createDataFrame([
        ev(0, "LLM_CALL", "p", content="think " * 20, phase="plan"), ev(1, "TOOL_CALL", "s", "read_doc", phase="search", doc="d1", query=""), ev(2, "TOOL_RESULT", "env", content="error: " + "z" * 60, refs=(1,)), ev(3, "VERIFIER", "v", content="second"), ev(4, "HANDOFF", "s", to="w", phase="report"),
        ev(5, "TOOL_CALL", "s", "search", phase="report", query="cats"), ev(6, "TOOL_CALL", "s", "search", phase="report", query="cats"),
    ], COLS)
    got = {x.step: (x.summary, x.outcome) for x in r.step_summaries(e).collect()}
    shown = "error: " + "z" * 33 + " | second"
    assert got[0] == ("p llm_call content=" + ("think " * 20)[:30], "") and got[1] == ("s read_doc doc_id=d1 -> " + shown, shown) and got[4][0] == "s handoff to=w"
    assert all(len(s) <= 100 for s, _ in got.values())
    assert [(x.stage, x.why) for x in t.suspicious_stages(e).orderBy("rank").collect()] == [("report", "loop"), ("search", "error")]


def test_bad_lines_are_named(spark, tmp_path):
    """Line 3 of the second file, and lines of a file that is read in many splits."""
    import json

    import pytest

    from tracewright.sources import formats as f

    line = lambda i: json.dumps({"trace_id": f"t{i}", "task": "x" * 50, "events": []})
    (tmp_path / "a.jsonl").write_text(line(1) + "\n\n" + line(2) + "\n")
    (tmp_path / "b.jsonl").write_text(line(3) + "\n  \n{broken\n" + line(4) + '\n{"task": "no id"}')
    many = [line(i) for i in range(100, 1000)]
    many[7], many[500], many[899] = "[1]", "nope", '{"trace_id": 5, "events": 7}'
    (tmp_path / "c.jsonl").write_text("\n".join(many))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    traces, faults = f.checked_traces(spark, str(tmp_path))
    got = {(x.file.rsplit("/", 1)[1], x.line) for x in faults.collect()}
    assert got == {("b.jsonl", 3), ("b.jsonl", 5), ("c.jsonl", 8), ("c.jsonl", 501), ("c.jsonl", 900)}
    assert {x.trace_id for x in traces.collect()} == {f"t{i}" for i in (1, 2, 3, 4, *range(100, 1000)) if i - 100 not in (7, 500, 899)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(ValueError, match=r"b\.jsonl:3: not a trace: \{broken"):
        f.require_traces(spark, str(tmp_path))
    assert f.require_traces(spark, str(tmp_path / "a.jsonl")).count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        f.require_traces(spark, str(tmp_path / "absent"))


def test_aliases_of_a_pair_differ_from_the_corpus(spark):
    from tracewright.operators import analyze as a

    rows = [("m", "p", w, b, x, t) for w, b, x, t in [("w0", "s", True, "k1"), ("w0", "l", False, "k1"), ("w1", "s", True, "k2"), ("w1", "l", False, "k1"), ("w2", "s", False, "k1"), ("w2", "l", False, "k2")]]
    feats = spark.createDataFrame(rows, "model_version string, prompt_version string, time_window string, length_bin string, failed boolean, task_id string")
    groups = spark.createDataFrame([("behavior", "m/p", w) for w in ("w0", "w1", "w2")], "family string, fixed string, grp string")
    got = {(x.a, x.b, x.first, x.feature) for x in a.pair_aliases(feats, groups).where("alias").select("a", "b", F.col("first").alias("first"), "feature").collect()}
    assert got == {("w0", "w1", "length_bin", "failure")}
    assert not any(x.alias for x in a.feature_aliases(feats).collect())


def test_witnesses_say_what_segments_show(spark):
    """Every segment of random traces: the rules run on the segment's own events against its witnesses."""
    import random

    rnd = random.Random(6)
    rows, segments = [], []
    for k in range(25):
        n = rnd.randint(1, 9)
        for i in range(n):
            kind = rnd.choice(["LLM_CALL", "TOOL_CALL", "TOOL_CALL", "TOOL_RESULT", "VERIFIER", "HANDOFF", "AGENT_MESSAGE"])
            action = {"TOOL_CALL": rnd.choice(["search", "read_doc", "submit", None]), "TOOL_RESULT": rnd.choice(["search", "read_doc"])}.get(kind)
            text = {"TOOL_RESULT": rnd.choice(["error: x", "2 docs [d1]", "0 docs", "text"]), "VERIFIER": rnd.choice(["failed: missing", "passed"]), "TOOL_CALL": None}.get(kind, rnd.choice(["based on d1", "no results", "from memory", "see [d2]", "plan", None]))
            rows.append(ev(i, kind, "a", action, content=text, doc=rnd.choice(["d1", "d2"]) if action == "read_doc" else None, query=rnd.choice(["q", None]) if action == "search" else None, answer=rnd.choice(["x", None]) if action == "submit" else None, trace=f"t{k}"))
        segments += [(f"t{k}", f"t{k}/{lo}/{hi}", lo, hi) for lo in range(n) for hi in range(lo, n)]
    e = spark.createDataFrame(rows, COLS)
    own = e.join(spark.createDataFrame(segments, "trace_id string, seg string, lo int, hi int"), "trace_id").where("idx between lo and hi").drop("trace_id", "lo", "hi").withColumnRenamed("seg", "trace_id")
    want = {x.trace_id for x in c.segment_symptoms(own).collect()}
    w = [tuple(x) for x in c.witnesses(e).collect()]
    got = {s for tr, s, lo, hi in segments if any(t0 == tr and a <= lo <= b and hi >= h for t0, a, b, h in w)}
    assert got == want and 0 < len(want) < len(segments)


def test_alignment_in_little_memory():
    """The walk over kept rows against the walk over the whole table; 12,000 by 12,000 in a few MB (the table has 576)."""
    import random
    import tracemalloc

    import numpy as np

    from tracewright.operators import align

    def whole(fit):
        n, m = fit.shape
        length = np.zeros((n + 1, m + 1), int)
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                length[i, j] = length[i + 1, j + 1] + 1 if fit[i, j] else max(length[i + 1, j], length[i, j + 1])
        out, i, j = [-1] * m, 0, 0
        while i < n and j < m:
            if fit[i, j]:
                out[j] = i
                i, j = i + 1, j + 1
            elif length[i + 1, j] >= length[i, j + 1]:
                i += 1
            else:
                j += 1
        return out

    rnd = random.Random(8)
    side = lambda n: [{"action_class": "X", "target": rnd.choice("abc"), "effect": rnd.choice(["JUSTIFIED", "SURVIVED", "OFF-ANCHOR", "FAILED", None])} for _ in range(n)]
    for _ in range(300):
        a, b = side(rnd.randint(0, 14)), side(rnd.randint(0, 14))
        fit = align.fitting(a, b)
        by_hand = np.array([[x["target"] == y["target"] and ("OFF-ANCHOR" in (x["effect"], y["effect"]) or x["effect"] == y["effect"] or {x["effect"], y["effect"]} == {"SURVIVED", "JUSTIFIED"}) for y in b] for x in a], bool).reshape(len(a), len(b))
        assert (fit == by_hand).all() and align.longest_match(align.Fits(a, b)).tolist() == align.longest_match(fit).tolist() == whole(fit)
    for n in (0, 7, 1 << 20):  # kept rows and whole tables give the same walk
        align.SMALL, before = n, align.SMALL
        rnd.seed(9)
        walks = [align.longest_match(align.Fits(side(rnd.randint(0, 60)), side(rnd.randint(0, 60)))).tolist() for _ in range(60)]
        first = walks if n == 0 else first
        assert walks == first
        align.SMALL = before
    long = align.Fits(side(12_000), side(12_000))
    tracemalloc.start()
    got = align.longest_match(long)
    assert tracemalloc.get_traced_memory()[1] < 40_000_000 and (got >= 0).sum() > 7000 and (np.diff(got[got >= 0]) > 0).all()
    tracemalloc.stop()


def test_gaps_need_judgements(spark):
    import pytest

    e = spark.createDataFrame([ev(0, "TOOL_CALL", "s", "search", query="q"), ev(1, "TOOL_RESULT", "env", "search", content="2 docs [d9]", refs=(0,))], COLS)
    tr = lambda evidence, gold, ok=False: spark.createDataFrame([("t", ok, evidence, gold)], "trace_id string, success boolean, evidence array<string>, gold array<string>")
    got = t.gap_labels(e, tr(["d1"], ["d1"])).first()
    assert (got.label, got.prescription) == ("RG_directional", "switch query formulation") and t.gap_labels(e, tr(["d1"], ["d1"], True)).first().prescription is None
    for bad in (tr(None, ["d1"]), tr(["d1"], None)):
        with pytest.raises(Exception, match="no relevance judgements for trace t"):
            t.gap_labels(e, bad).collect()


def test_degenerate_spectra_are_noted(spark):
    rows = spark.createDataFrame([("a", "1", True), ("a", "2", False), ("b", "3", False), ("b", "4", False), ("c", "5", False), ("d", "6", True)], "task_id string, trace_id string, success boolean")
    got = {x.task_id: x.notes for x in t.spectrum_notes(rows).collect()}
    assert got["a"] == "" and "no successful" in got["b"] and "only 1" not in got["b"] and "no successful" in got["c"] and "only 1" in got["c"] and got["d"].startswith("only 1")


def test_half_answers_leave_a_trail(spark):
    said = ["lower half", "No error in the lower half", "There is no doubt: the upper half", "middle", "lower or upper", None]
    got = [tuple(x.h) for x in spark.createDataFrame([(s,) for s in said], "s string").select(t.half_answer(F.col("s")).alias("h")).collect()]
    assert got == [("lower", False, None), ("upper", True, None), ("upper", False, None), (None, None, "unparseable"), (None, None, "unparseable"), (None, None, "unparseable")]


def test_judges_errors_are_no_evidence(spark):
    from tracewright.operators import recover as v

    reruns = spark.createDataFrame([("a", "r1", 1, True), ("a", "r2", 2, False), ("b", "r3", 1, True), ("c", "r4", 1, True)], "rerun_of string, trace_id string, seq int, success boolean")
    judge = spark.createDataFrame([("r2", None, 3.0, "x"), ("r3", "error", None, None), ("r1", None, 9.0, "y")], "trace_id string, status string, score double, summary string")
    got = {x.trace_id: (x.rerun_id, x.improved, x.judge_score, x.judge_summary, x.judge_available) for x in v.verify_closed_loop(reruns, judge).collect()}
    assert got == {"a": ("r2", False, 3.0, "x", True), "b": ("r3", True, None, None, False), "c": ("r4", True, None, None, False)}


def test_sparse_calls_and_leaks(spark):
    from tracewright.operators import evaluate as e

    calls = spark.createDataFrame([("t", True, None, None, 5, 2, None), ("t", None, 0, 30, None, None, None), ("t", True, 3, 10, 7, 1, 6)], "tag string, ok boolean, http_requests int, latency_ms int, tokens int, prompt_tokens int, completion_tokens int")
    m = e.call_metrics(calls).first()
    assert (m.n_calls, round(m.ok_rate, 4), round(m.http_per_call, 4), round(m.repair_rate, 4), m.p50, m.latest, m.tokens, m.prompt_tokens, m.completion_tokens) == (3, 0.6667, 1.6667, 0.3333, 10, 30, 12, 3, 6)
    said = spark.createDataFrame([(k, "j", "has qrels" if k % 2 else "has QRELS", None) for k in range(30)], "record int, tag string, prompt string, response string")
    assert [(x.word, x.n_calls, x.records) for x in e.leak_scan(said).collect()] == [("qrels", 15, [1, 3, 5, 7, 9, 11, 13, 15, 17, 19])]


def test_leak_scan_reads_whole_prompts(spark):
    """a prompt without a name by rule (index 12, 25, ...) is still scanned, and so are the texts beside content; spellings are as written."""
    import duckdb

    from tracewright.plans import all_sql
    from tracewright.plans.recover_queries import e8
    from tracewright.sources.fixtures import BASE_SQL

    e = spark.createDataFrame([
        ev(12, "TOOL_RESULT", "env", content="the qrels"), ev(25, "HANDOFF", "a", to="ground_truth"), ev(38, "TOOL_CALL", "a", "search", query="step_repetition"), ev(51, "TOOL_CALL", "a", "submit", answer="injected_fault"), ev(64, "TOOL_CALL", "qrels", "read_doc", doc="info_withholding"),
        ev(77, "LLM_CALL", "a", content="QRELS"), ev(90, "TOOL_CALL", "a", "disobey_task_spec"), ev(8, "LLM_CALL", "a", content="x" * 1000 + " qrels"), ev(103, "LLM_CALL", "a"),
    ], COLS).withColumn("k", F.lit(0))
    got = {tuple(x) for x in e8(e, None).select("place", "tag", "word", "n_calls").collect()}
    assert got == {("prompt", "TOOL_RESULT", "qrels", 1), ("environment", "HANDOFF", "ground_truth", 1), ("prompt", "TOOL_CALL", "step_repetition", 1), ("prompt", "TOOL_CALL", "injected_fault", 1), ("prompt", "TOOL_CALL", "qrels", 1), ("prompt", "TOOL_CALL", "info_withholding", 1), ("prompt", "TOOL_CALL", "disobey_task_spec", 1), ("prompt", "LLM_CALL", "qrels", 1)}
    con = duckdb.connect()
    con.execute("CREATE TABLE ev (" + ", ".join(f"{c} {'INT' if c == 'k' else 'VARCHAR' if t == 'string' else t}" for c, t in e.drop("refs", "ts").dtypes) + ")")
    con.executemany(f"INSERT INTO ev VALUES ({', '.join('?' * (len(e.columns) - 2))})", [tuple(x) for x in e.drop("refs", "ts").collect()])
    assert set(con.execute(all_sql()["e8_leak_scan"].replace(BASE_SQL + ", ", "")).fetchall()) == got


def test_scores_are_tallied(spark):
    from tracewright.sources import formats as f

    hyps = spark.createDataFrame([("a", "x", 1, None, 0.5, "sbfl", "why " * 50), ("a", "y", 1, "FM-1.1", 0.9, "judge", "because"), ("a", "z", 7, None, 0.9, "judge", "b")], "trace_id string, agent string, step int, code string, confidence double, algo string, root_cause string")
    spans = spark.createDataFrame([("a", 1, "s1")], "trace_id string, step int, span_id string")
    p = f.score_payloads(hyps, spans, run_id="r", longest=30)
    rows = [(x.name, x.value, x.data_type, x.comment, x.metadata["algo"]) for x in p.orderBy("emit_order").collect()]
    assert rows == [("blamed-step", "FM-1.1", "CATEGORICAL", "y @ step 1: because", "judge"), ("confidence", "0.9", "NUMERIC", "confidence of the top hypothesis"[:30], "judge"), ("root-cause", "FM-1.1", "CATEGORICAL", "y @ step 1: because (run r)", "judge")]
    traces = spark.createDataFrame([("a",), ("b",), ("c",)], "trace_id string")
    done = spark.createDataFrame([("c", "root-cause"), ("a", "blamed-step")], "trace_id string, name string")
    tally = lambda **x: tuple(f.score_tally(f.skip_scored(traces, p, done, **x), p).first())
    assert tally() == (1, 0, 1, 1, 3) and tally(dry_run=True) == (0, 1, 1, 1, 3) and tally(force=True) == (1, 0, 0, 2, 3)
