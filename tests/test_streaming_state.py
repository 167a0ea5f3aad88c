"""State of the streamed import: a table that Spark writes, no Python call per trace."""

import json

from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from tracewright.streaming import ingest as s


def span(trace, k, second, expected=None):
    return json.dumps({"trace_id": trace, "span_id": f"s{k}", "ordinal": k, "kind": "TOOL_CALL", "agent": "a", "action": f"x{k}", "at": f"2024-01-01T00:00:{second:02d}Z", "expected": expected}) + "\n"


def test_traces_are_told_by_the_table(spark, tmp_path, monkeypatch):
    def per_trace(*_, **__):
        raise AssertionError("a Python call per trace")

    monkeypatch.setattr(GroupedData, "applyInPandasWithState", per_trace)
    source, folder = tmp_path / "in", tmp_path / "work"
    source.mkdir()
    options = {"delay": "2 hours", "silence_ms": 3_600_000}
    told = lambda: sorted((r.batch, r.trace_id, r.why, r.n) for r in spark.read.parquet(f"{folder}/closed").collect())
    (source / "a.json").write_text(span("whole", 0, 1) + span("whole", 1, 2, 2) + span("grows", 0, 1, 1) + span("silent", 0, 1) + span("short", 0, 1, 3) + span("short", 0, 1, 3))
    s.ingest(spark, str(source), str(folder), **options)
    assert [t[1:] for t in told()] == [("grows", "complete", 1), ("whole", "complete", 2)]
    (source / "b.json").write_text(span("grows", 1, 3) + span("whole", 1, 2, 2))  # a span that is new, and one that is not
    s.ingest(spark, str(source), str(folder), **options)
    assert len(told()) == 2
    (source / "c.json").write_text(json.dumps({"trace_id": "end", "span_id": "s", "kind": "SPAN", "agent": "a", "at": "2024-01-02T00:00:00Z"}) + "\n")
    out = s.ingest(spark, str(source), str(folder), **options)
    assert sorted(t[1:] for t in told()[2:]) == [("grows", "late", 2), ("short", "silence", 1), ("silent", "silence", 1)]
    assert {(r.trace_id, r["count"]) for r in out.groupBy("trace_id").count().collect()} == {("whole", 2), ("grows", 2), ("silent", 1), ("short", 1)}
    last = max((int(p.name.split("=")[1]) for p in (folder / "closed").iterdir() if p.name.startswith("batch=")))
    state = spark.read.parquet(f"{folder}/state/{last % 2}")
    assert {r.trace_id for r in state.where("not gone and trace_id is not null").collect()} == {"end"}  # what is closed by silence leaves the state


def test_watermark_and_silence(spark):
    before = spark.createDataFrame([("a", 2, None, 0, 10, 0), ("b", 2, 2, 0, 10, 2), ("c", 3, 2, 0, 10, 2), ("d", 1, 3, 0, 50, 0)], "trace_id string, n long, expected long, f long, l long, told long")
    before = before.select("trace_id", "n", "expected", F.timestamp_seconds("f").alias("first"), F.timestamp_seconds("l").alias("last"), "told", F.lit(None).cast("string").alias("why"), F.lit(False).alias("gone"))
    new = spark.createDataFrame([("d", "s1", 55, None), ("d", "s2", 56, None)], "trace_id string, span_id string, t long, expected long").withColumn("at", F.timestamp_seconds("t"))
    at = lambda second: {r.trace_id: (r.n, r.told, r.why, r.gone) for r in s.tracked(before, new, second and second * 1_000_000, "10 seconds", 20_000).where("trace_id is not null").collect()}
    assert at(None) == at(40) == {"a": (2, 0, None, False), "b": (2, 2, None, False), "c": (3, 2, None, False), "d": (3, 3, "complete", False)}  # 40 - 10 has not passed 10 + 20
    assert at(41) == {"a": (2, 0, "silence", True), "b": (2, 2, None, True), "c": (3, 2, "late", True), "d": (3, 3, "complete", False)}
