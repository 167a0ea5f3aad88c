"""Noisy answers: the scan on rows, the first valid object, and the verdict of a drill-down."""

import json
import random

from pyspark.sql import functions as F

from tracewright.operators import answers as a
from tracewright.operators import attribute as t


def slow_blocks(text):
    """Outermost braced stretches, character by character."""
    out, depth, start, quoted, skip = [], 0, 0, False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quoted and c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif quoted:
            pass
        elif c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[start : i + 1])
    return out


def test_scan_against_characters():
    rnd = random.Random(5)
    for _ in range(20_000):
        s = "".join(rnd.choice('{{}}""\\\\ab\n') for _ in range(rnd.randint(0, 25)))
        assert a.braced(s) == slow_blocks(s), s


def test_objects_in_order():
    assert a.objects_of(None) == a.objects_of("") == a.objects_of("no braces") == a.objects_of('{"a": 1') == a.objects_of('["x"]') == []
    assert a.objects_of('needs {"score"} maybe { \'x\': 1 }.\nthen {"score": 2.5}') == ['{"x": 1}', '{"score": 2.5}']
    assert a.objects_of('{"a": 1}\n```json\n{"b": {"c": 2}}\n```') == ['{"b": {"c": 2}}', '{"a": 1}']
    assert [json.loads(o) for o in a.objects_of("{'score': 5.0, 'ok': True, 'x': None, 's': \"it's\"}")] == [{"score": 5.0, "ok": True, "x": None, "s": "it's"}]
    assert a.objects_of('{"s": "has } brace { and \\" inside"}') == ['{"s": "has } brace { and \\" inside"}']
    assert a.objects_of('{"a": 1} {"a": 1} ```{"a": 1}```') == ['{"a": 1}']
    assert a.objects_of("{" * 5000 + "}" * 5000) == []


def test_first_valid(spark):
    rows = [(1, '{"score": 99} {"score": 3}'), (2, '{"score": 99}'), (3, "none"), (4, None), (5, '{"other": 1} {"score": 12}'), (6, '{"score": "4"} {"score": 4}')]
    got = spark.createDataFrame(rows, "i int, r string").select("i", a.first_valid(F.col("r"), "score double", lambda v: v["score"].between(0, 10))["score"].alias("s"), a.unparsed(F.col("r")).alias("why"))
    assert {r.i: (r.s, r.why) for r in got.collect()} == {1: (3.0, None), 2: (99.0, None), 3: (None, "no object"), 4: (None, "no object"), 5: (12.0, None), 6: (4.0, None)}


def test_stage_diagnosis(spark):
    """Clamps into the drilled range [start - 3, end], with a note each; no stages, no verdict."""
    phases = ["plan", "plan", "search", "search", "search", None, "report", "report"]
    ev = [(tr, i, f"e{i}", "LLM_CALL", "planner" if i < 2 else "searcher", None if tr == "none" else p, "error: x" if i == 3 else "ok") for tr in ("in", "out", "none", "dumb") for i, p in enumerate(phases)]
    events = spark.createDataFrame(ev, "trace_id string, idx int, id string, kind string, agent string, phase string, content string")
    say = lambda **x: json.dumps({"responsible_agent": "searcher", "step": 3, "reason": "r", "fix_suggestion": "f", "confidence": 0.8} | x)
    said = [("in", say(failure_mode="FM-1.3")), ("out", "hm {'x': 1} " + say(step=77, responsible_agent="ghost", failure_mode="FM-9.9")), ("none", say()), ("dumb", say(confidence=7))]
    picked = spark.createDataFrame([(tr, s, k) for tr in ("in", "out", "dumb") for k, s in enumerate(["gone", "search"], 1)], "trace_id string, stage string, rank int")
    got = {r.trace_id: tuple(r)[1:] for r in t.diagnose_stages(picked, spark.createDataFrame(said, "trace_id string, response string"), events, spark.createDataFrame([("FM-1.3",)], "code string")).collect()}
    assert got["in"] == ("diagnosed", "search", 0, 4, "searcher", 3, "FM-1.3", 0.8, "")
    assert got["out"] == ("diagnosed", "search", 0, 4, "planner", 4, None, 0.8, "step 77->4; agent ghost->planner; mode FM-9.9->none")
    assert got["none"][0] == "stage_not_resolved" and got["dumb"][0] == "no_verdict" and got["none"][1:7] == got["dumb"][1:7] == (None,) * 6
