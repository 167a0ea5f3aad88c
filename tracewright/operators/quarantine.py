"""Error rows in place of a failed job: validation as a column, one written pass split into traces that are whole and traces that are not."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tracewright.operators.answers import unparsed
from tracewright.operators.represent import flatten_spans
from tracewright.sources.formats import observation_spans, source_spans
from tracewright.tables import durable, durable_long


@dataclass
class Split:
    """good: rows of traces without any fault; errors (stage, name, trace_id, error: the first of its faults, n_rows: how many rows have one); seen: rows and bad_rows, counted while they were written; log: one row (stage, name, processed, failed: traces)."""

    good: DataFrame
    errors: DataFrame
    seen: dict[str, int]
    log: DataFrame


def quarantine(rows: DataFrame, stage: str, name: str, rules: list[tuple[Column, str | Column]]) -> Split:
    """Check rows (trace_id, ...) against rules (when it is a fault, what it is; the first that applies counts) in one pass. A fault keeps its whole trace out, and no other; a row without a trace_id is a fault of its own. Columns of the good rows stay as they are."""
    fault = F.coalesce(F.when(F.col("trace_id").isNull(), "a row without a trace"), *(F.when(F.coalesce(bad, F.lit(False)), what if isinstance(what, Column) else F.lit(what)) for bad, what in rules))
    count = Observation()
    held = durable(rows.withColumn("_fault", fault).observe(count, F.count(F.lit(1)).alias("rows"), F.count("_fault").alias("bad_rows")))
    bad = held.where("_fault is not null").groupBy("trace_id").agg(F.min("_fault").alias("error"), F.count("*").alias("n_rows"))
    errors = durable_long(bad.select(F.lit(stage).alias("stage"), F.lit(name).alias("name"), "trace_id", F.substring("error", 1, 500).alias("error"), "n_rows"))
    good = held.where("_fault is null").drop("_fault")
    if count.get["bad_rows"]:
        good = good.join(errors.select("trace_id"), "trace_id", "left_anti").select(rows.columns)
    # count_distinct skips null, which is one trace of its own here
    traces = held.agg(F.countDistinct("trace_id").alias("n"), F.coalesce(F.max(F.col("trace_id").isNull().cast("int")), F.lit(0)).alias("none")).select((F.col("n") + F.col("none")).alias("processed"))
    log = traces.crossJoin(errors.agg(F.count("*").alias("failed"))).select(F.lit(stage).alias("stage"), F.lit(name).alias("name"), "processed", "failed")  # one row each
    return Split(good, errors, count.get, log)


def span_faults(spans: DataFrame) -> Split:
    """The split alone; nothing is flattened."""
    return quarantine(spans, "represent", "canonical_events", [(F.coalesce("span_id", F.lit("")) == "", "a span without an id")])


def checked_spans(spans: DataFrame) -> tuple[DataFrame, Split]:
    """Flattened spans of all traces whose spans have ids, and the split."""
    s = span_faults(spans)
    return flatten_spans(s.good), s


def checked_observations(observations: DataFrame, namespace: str = "own") -> tuple[DataFrame, Split]:
    """Spans of all traces whose observations have ids, and the split."""
    s = quarantine(observations, "import", "observations", [(F.coalesce("id", F.lit("")) == "", F.concat(F.lit("observation without an id, named "), F.coalesce("name", F.lit("nothing"))))])
    return observation_spans(s.good, namespace), s


def checked_sources(events: DataFrame, artifact: DataFrame) -> tuple[DataFrame, Split]:
    """Source spans of all traces whose lists are as long as their events, and the split."""
    n = events.groupBy("trace_id").agg(F.count("*").alias("_n"))
    rows = artifact.join(n, "trace_id")
    said = F.concat(F.size("source_span_ids").cast("string"), F.lit(" source spans for "), F.col("_n").cast("string"), F.lit(" events"))
    s = quarantine(rows, "recover", "score_writer", [(F.size("source_span_ids") != F.col("_n"), said)])
    return source_spans(events, s.good.drop("_n")), s


def checked_answers(answers: DataFrame, name: str, stage: str = "analyze", rules: tuple = ()) -> Split:
    """answers (trace_id, response) that hold an object, and that further rules accept."""
    return quarantine(answers, stage, name, [(unparsed(F.col("response")).isNotNull(), unparsed(F.col("response"))), *rules])
