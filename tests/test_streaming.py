"""Streamed traces equal the batch run: late, repeated and split input, and a restart in between."""

import json
import random

from pyspark.sql import functions as F

from tracewright.streaming import ingest as s


def spans_of(traces, rnd):
    rows = []
    for t in range(traces):
        n = rnd.randint(1, 12)
        for k in range(n):
            at = f"2024-01-01T00:{t % 50:02d}:{k:02d}Z"
            rows.append({"trace_id": f"t{t}", "span_id": f"s{k}", "parent_span_id": f"s{rnd.randrange(k)}" if k else None, "ordinal": k, "kind": "TOOL_CALL", "agent": "a", "action": f"x{k}", "at": at, "payload": json.dumps({"content": f"c{k}", "more": [k]})})
        if t % 3:
            rows[-1]["expected"] = n
    return rows


def write(folder, name, rows):
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def events(df):
    return sorted((r.trace_id, r.idx, r.action, r.parent or "", r.content, r.j) for r in df.withColumn("j", F.to_json("payload")).collect())


def test_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(1)
    rows = spans_of(24, rnd)
    held = [r for r in rows if r["trace_id"] in ("t4", "t9") and r["span_id"] != "s0"][:5]  # these come after the restart
    first = [r for r in rows if r not in held]
    rnd.shuffle(first)
    source, folder = tmp_path / "in", tmp_path / "work"
    source.mkdir()
    third = len(first) // 3
    write(source, "a.json", first[:third] + first[:5])
    write(source, "b.json", first[third : 2 * third] + first[third - 4 : third])
    (source / "bad.json").write_text("no json\n{\"span_id\": \"x\"}\n")
    options = {"delay": "2 hours", "silence_ms": 3_600_000, "files_a_batch": 1}
    s.ingest(spark, str(source), str(folder), **options)
    write(source, "c.json", first[2 * third :] + rnd.sample(first, 10))
    write(source, "d.json", held + held)
    s.ingest(spark, str(source), str(folder), **options)
    end = [{"trace_id": "end", "span_id": "s", "kind": "SPAN", "agent": "a", "at": "2024-01-02T00:00:00Z", "expected": 1}]
    write(source, "e.json", end)  # time goes on: all that is silent closes
    got = s.ingest(spark, str(source), str(folder), **options)
    want = s.batch_events(spark.createDataFrame([tuple(r.get(c) for c in ("trace_id", "span_id", "parent_span_id", "ordinal", "kind", "agent", "action", "payload", "at")) for r in rows + end], "trace_id string, span_id string, parent_span_id string, ordinal long, kind string, agent string, action string, payload string, at string").withColumns({"at": F.to_timestamp("at"), "phase": F.lit(None).cast("string"), "refs": F.array().cast("array<string>"), "ts": F.lit(None).cast("double")}))
    assert events(got) == events(want)
    told = {(r.trace_id, r.why) for r in spark.read.parquet(f"{folder}/closed").collect()}
    assert {w for _, w in told} >= {"complete", "silence"} and ("t0", "silence") in told and ("t1", "complete") in told
    before = spark.read.parquet(f"{folder}/out").count()
    assert events(s.ingest(spark, str(source), str(folder), **options)) == events(want) and spark.read.parquet(f"{folder}/out").count() == before  # nothing new: nothing done
