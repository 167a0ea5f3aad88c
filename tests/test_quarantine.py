"""Faults keep their own trace out and no other; code hits come from labels; stacks must share their traces."""

import pytest
from pyspark.sql import functions as F

from tracewright.operators import evaluate as e
from tracewright.operators import quarantine as q


def test_bad_spans_keep_only_their_trace_out(spark):
    rows = [("a", "r", None, 0), ("a", "x", "r", 1), ("b", "r", None, 0), ("b", None, "r", 1), ("b", "", "r", 2), ("c", "r", None, 0), (None, "s", None, 0)]
    flat, split = q.checked_spans(spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, ordinal int"))
    assert {(r.trace_id, r.span_id, r.idx) for r in flat.collect()} == {("a", "r", 0), ("a", "x", 1), ("c", "r", 0)}
    assert {tuple(r) for r in split.errors.collect()} == {("represent", "canonical_events", "b", "a span without an id", 2), ("represent", "canonical_events", None, "a row without a trace", 1)}
    assert split.seen == {"rows": 7, "bad_rows": 3} and tuple(split.log.first()) == ("represent", "canonical_events", 4, 2)


def test_clean_and_empty_input(spark):
    rows = spark.createDataFrame([("a", "r", None, 0)], "trace_id string, span_id string, parent_span_id string, ordinal int")
    for d, n in ((rows, 1), (rows.limit(0), 0)):
        flat, split = q.checked_spans(d)
        assert flat.count() == n and split.errors.count() == 0 and tuple(split.log.first())[2:] == (n, 0)


def test_observations_sources_and_answers(spark):
    o = spark.createDataFrame([("a", "1"), ("b", ""), ("b", "2")], "trace_id string, id string")
    o = o.select("*", *(F.lit(None).cast("string").alias(c) for c in ("name", "type", "parent_id", "start_time", "input", "output", "level", "metadata", "top")))
    spans, split = q.checked_observations(o)
    assert [r.trace_id for r in spans.collect()] == ["a"] and split.errors.first().error == "observation without an id, named nothing"
    events = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "trace_id string, idx int")
    lists = spark.createDataFrame([("a", ["x"]), ("b", ["y"]), ("z", ["w"])], "trace_id string, source_span_ids array<string>")
    good, split = q.checked_sources(events, lists)
    assert [tuple(r) for r in good.collect()] == [("b", 0, "y")] and split.errors.first().error == "1 source spans for 2 events"
    answers = spark.createDataFrame([("a", '{"score": 2}'), ("b", "{"), ("c", None), ("d", '{"score": 99}')], "trace_id string, response string")
    split = q.checked_answers(answers, "judge_eval", rules=((F.get_json_object("response", "$.score").cast("int") > 10, "score"),))
    assert {r.trace_id: r.error for r in split.errors.collect()} == {"b": "unclosed", "c": "no object", "d": "score"} and [r.trace_id for r in split.good.collect()] == ["a"]
    line = e.stage_log([split.log], [split.errors], examples=2).first().line
    assert line == "analyze/judge_eval -> 1/4 traces; 3 isolated: b: unclosed; c: no object"


def evaluated(spark):
    traces = spark.createDataFrame([("a", 3, "x", "FM-1.1", "k1"), ("b", 2, "y", "FM-2.2", "k1"), ("c", 1, "z", "FM-3.3", "k2"), ("d", None, None, None, None)], "trace_id string, gt_step int, gt_agent string, gt_code string, gt_kind string")
    hyps = spark.createDataFrame([("a", "m", 1, 3, "x", "FM-9.9", 0.5), ("a", "m", 2, 1, "y", "FM-1.1", 0.5), ("b", "m", 1, 0, "y", "FM-2.2", 0.9)], "trace_id string, algo string, rank int, step int, agent string, code string, confidence double")
    labels = spark.createDataFrame([("a", 1, "FM-2.2"), ("a", 0, "FM-1.1"), ("d", 0, "FM-1.1")], "trace_id string, pos int, code string")
    findings = spark.createDataFrame([("a", 0, "FM-3.3"), ("b", 1, "FM-2.2"), ("b", 0, "FM-1.1"), ("c", 5, "FM-3.3")], "trace_id string, pos int, code string")
    return traces, hyps, labels, findings


def test_code_hits_come_from_labels(spark):
    """The hypothesis' own code counts for nothing; labels come before findings; the first of highest confidence is taken without regard to its step."""
    traces, hyps, labels, findings = evaluated(spark)
    recovered = spark.createDataFrame([("b", False), ("b", True), ("c", False)], "trace_id string, recovered boolean")
    got = {r.trace_id: (r.step_hit, r.agent_hit, r.code_hit, r.recovered, r.improved) for r in e.score_hypotheses(hyps, traces, labels, findings, recovered).collect()}
    assert got == {"a": (True, True, True, False, False), "b": (False, True, False, True, False), "c": (False, False, True, False, False)}
    total = {r.kind: (r.total, r.step_hits, r.code_hits, r.recovered) for r in e.rollup_by_kind(e.score_hypotheses(hyps, traces, labels, findings, recovered)).collect()}
    assert total == {"k1": (2, 1, 1, 1), "k2": (1, 0, 1, 0), "total": (3, 1, 2, 1)}
    assert not any(r.code_hit for r in e.score_hypotheses(hyps, traces).collect())


def test_stacks_share_their_traces(spark):
    traces, hyps, labels, findings = evaluated(spark)
    calls = spark.createDataFrame([("t1",), ("t2",), ("t1",)], "tag string")
    row = {r.config: r for r in e.compare_stacks({"one": {"hyps": hyps, "findings": findings, "calls": calls, "errors": calls, "traces": traces}, "two": hyps}, traces).collect()}
    assert (row["one"].n_calls, row["one"].calls_by_tag, row["one"].errors, row["one"].code_hits) == (3, "t1=2,t2=1", 3, 1) and (row["two"].n_calls, row["two"].calls_by_tag, row["two"].errors) == (0, "", 0)
    with pytest.raises(ValueError, match="other traces"):
        e.compare_stacks({"one": {"hyps": hyps, "traces": traces.where("trace_id <> 'a'")}}, traces)


def test_rounds_and_their_sum(spark):
    traces = spark.createDataFrame([("a", True), ("b", False)], "trace_id string, success boolean")
    hyps, errors = traces.where("not success"), traces.limit(1)
    got = {r["round"]: (r.n_traces, r.n_failed, r.n_attributed, r.n_reruns, r.n_rerun_ok, r.n_errors) for r in e.run_rounds({0: (traces, hyps, traces.limit(0), errors), 1: (traces, hyps, traces, errors.limit(0))}).collect()}
    assert got == {0: (2, 1, 1, 0, 0, 1), 1: (2, 1, 1, 2, 1, 0), None: (4, 2, 2, 2, 1, 1)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_as_long_as_the_spans_are_never_broadcast(spark):
    rows = [("a", "r", None, 0), ("a", "x", "r", 1), ("a", "y", "x", 0), ("b", "r", None, 0), ("b", None, "r", 1)]
    flat, split = q.checked_spans(spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, ordinal int"))
    assert "BroadcastHashJoin" not in plan_of(flat) and "BroadcastHashJoin" not in plan_of(split.good)
    assert {(r.trace_id, r.span_id, r.idx, r.depth, r.parent_id) for r in flat.collect()} == {("a", "r", 0, 1, None), ("a", "x", 1, 2, "e000"), ("a", "y", 2, 3, "e001")}


def test_the_stage_log_flattens_nothing(spark, monkeypatch):
    """Its first split says all that the log needs of the spans."""
    from tracewright.plans import all_queries
    from tracewright.plans import recover_queries as p

    monkeypatch.setattr(q, "flatten_spans", lambda *a, **b: pytest.fail("spans are flattened"))
    rows = [("a", i, f"e{i:03d}", "search", 50 + i) for i in range(5)]
    events = spark.createDataFrame(rows, "trace_id string, idx int, id string, action string, k int")
    assert all_queries and {(r.stage, r.processed, r.failed) for r in p.e13_log(events, None).collect()} == {("represent", 1, 1), ("import", 1, 0), ("analyze", 1, 0), ("recover", 1, 1)}
