"""Incremental import: spans stream in, traces are closed by a completion marker or by silence, and the batch operators run on what is closed.

Two queries. The first lands raw spans as Parquet, exactly once. The second reads the landed spans, keeps the ids of spans until the watermark passes them (so that repetitions count once) and a few numbers per open trace as a table that each micro-batch writes anew from that of the one before, and hands the traces that a micro-batch closes to the batch operators, which read them from the landing. A micro-batch replaces its own state and its own partition of the output, so a restart repeats nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tracewright.operators.payload import as_object
from tracewright.sources.imports import events_of_spans

#: A span as it arrives; `expected` stands on a completion marker: how many spans its trace has.
SPAN = "trace_id string, span_id string, parent_span_id string, ordinal long, kind string, agent string, action string, phase string, refs array<string>, ts double, payload string, at timestamp, expected long"
#: Per trace: its spans, how many it should have, their times, how many it had when it was told (0: never), why this micro-batch tells it, if it does, and whether it leaves the state. The row without a trace holds the latest time of all spans so far.
STATE = "trace_id string, n long, expected long, first timestamp, last timestamp, told long, why string, gone boolean"
CLOSED = ("trace_id", "why", "first", "last", "n")


def land_spans(spark: SparkSession, source: str, folder: str, files_a_batch: int = 100) -> StreamingQuery:
    """JSON lines of spans (SPAN) from `source` to Parquet under `folder`, until all that is there is landed. A line that is no JSON is kept out of the landing: it has no trace."""
    spans = spark.readStream.schema(SPAN).option("maxFilesPerTrigger", files_a_batch).json(source).where("trace_id is not null and at is not null")
    return spans.writeStream.format("parquet").option("path", f"{folder}/spans").option("checkpointLocation", f"{folder}/land-state").trigger(availableNow=True).start()


def new_spans(spans: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Stream of spans (trace_id, span_id, at, expected), repeated ones once; those older than the watermark are left out."""
    return spans.select("trace_id", "span_id", "at", "expected").withWatermark("at", delay).dropDuplicatesWithinWatermark(["trace_id", "span_id"])


def tracked(before: DataFrame, new: DataFrame, seen: int | None, delay: str = "10 minutes", silence_ms: int = 600_000) -> DataFrame:
    """STATE after the new spans of a micro-batch, from the STATE before; `seen` is the latest time (microseconds) of all spans of earlier micro-batches, that give the watermark.

    A trace is told once when the expected number is there ('complete'), or when nothing came for a while ('silence'): the watermark has passed its last span by silence_ms, and it leaves the state. If more spans came after it was told, it is told again then ('late').
    """
    latest = F.timestamp_micros(F.lit(seen).cast("long"))
    kept = before.where("not gone and trace_id is not null").select("trace_id", "n", "expected", "first", "last", "told")
    came = new.select("trace_id", F.lit(1).cast("long").alias("n"), "expected", F.col("at").alias("first"), F.col("at").alias("last"), F.lit(0).cast("long").alias("told"))
    clock = new.sparkSession.range(1).select(F.lit(None).cast("string").alias("trace_id"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("expected"), latest.alias("first"), latest.alias("last"), F.lit(0).cast("long").alias("told"))
    s = kept.unionByName(came).unionByName(clock).groupBy("trace_id").agg(F.sum("n").alias("n"), F.max("expected").alias("expected"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("told").alias("told"))
    trace = F.col("trace_id").isNotNull()
    passed = F.unix_millis("last") + silence_ms < F.unix_millis(latest - F.expr(f"interval '{delay}'"))
    gone = trace & F.coalesce(passed, F.lit(False))
    whole = trace & (F.col("told") == 0) & F.coalesce((F.col("expected") > 0) & (F.col("n") >= F.col("expected")), F.lit(False))
    why = F.when(whole, "complete").when(gone & (F.col("n") != F.col("told")), F.when(F.col("told") == 0, "silence").otherwise("late"))
    return s.select("trace_id", "n", "expected", "first", "last", F.when(whole, F.col("n")).otherwise(F.col("told")).alias("told"), why.alias("why"), gone.alias("gone"))


def once_each(spans: DataFrame) -> DataFrame:
    """Landed spans without repetitions: of rows of one span the earliest, then the one with the least text. They stay dealt by trace, as all that follows needs them."""
    first = F.row_number().over(Window.partitionBy("trace_id", "span_id").orderBy("at", F.col("payload").asc_nulls_last()))
    return spans.repartition("trace_id").withColumn("_n", first).where("_n = 1").drop("_n")


def batch_events(spans: DataFrame) -> DataFrame:
    """The batch operators on landed spans: canonical events."""
    s = once_each(spans)
    return events_of_spans(s.withColumns({"payload": as_object(F.col("payload")), "name": F.coalesce("action", "kind")}))


def close_traces(spark: SparkSession, folder: str, work: Callable[[DataFrame], DataFrame] = batch_events, delay: str = "10 minutes", silence_ms: int = 600_000, files_a_batch: int = 100) -> StreamingQuery:
    """Run `work` (spans of closed traces -> rows with trace_id) on all traces that landed spans close, and write its rows to folder/out/batch=N, until all that is there is read. Only landed files whose spans can belong to the closed traces are read, by the range of their times."""
    landed = f"{folder}/spans"
    schema = spark.read.schema(SPAN).parquet(landed).schema
    work(spark.read.schema(schema).parquet(landed).limit(0)).write.mode("overwrite").parquet(f"{folder}/out/batch=-1")  # so that there is an output before anything closes

    def run(new: DataFrame, number: int) -> None:
        session, state = new.sparkSession, [f"{folder}/state/{k % 2}" for k in (number - 1, number)]
        before = session.read.schema(STATE).parquet(state[0]) if number else session.range(0).select(F.from_json(F.lit("{}"), STATE).alias("s")).select("s.*")
        seen = before.agg(F.unix_micros(F.max("last"))).first()[0]
        tracked(before, new, seen, delay, silence_ms).write.mode("overwrite").parquet(state[1])
        path = f"{folder}/closed/batch={number}"
        session.read.schema(STATE).parquet(state[1]).where("why is not null").select(*CLOSED).write.mode("overwrite").parquet(path)
        told = session.read.parquet(path)
        first, last, n = told.agg(F.min("first"), F.max("last"), F.count("*")).first()
        if n:
            spans = session.read.schema(schema).parquet(landed).where(F.col("at").between(F.lit(first), F.lit(last)))
            rows = work(spans.join(told.select("trace_id"), "trace_id", "left_semi"))
            rows.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    # ids of spans are kept on disk, not on the heap, with bounded memory for each executor
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(landed)
    return new_spans(stream, delay).writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/close-state").trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """Output rows of the last micro-batch that closed each trace."""
    rows = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    last = rows.groupBy("trace_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["trace_id", "batch"], "left_semi").drop("batch")


def ingest(spark: SparkSession, source: str, folder: str, **options) -> DataFrame:
    """Land and close all that `source` (at least one span) holds now; call it again when more has come. Returns the rows of all closed traces."""
    files = {k: options[k] for k in ("files_a_batch",) if k in options}
    land_spans(spark, source, folder, **files).awaitTermination()
    close_traces(spark, folder, **options).awaitTermination()
    return latest(spark, folder)
