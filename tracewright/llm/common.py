"""Shared helpers: durable intermediate tables, and connected components by joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or (local mode only) a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="tracewright-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def open_folder(path: str):
    """(file system, path in it) of a shared folder, for tasks that read or write files there themselves."""
    from pyarrow import fs

    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: it cuts the lineage, survives lost executors, and gives the planner a true size."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast to the given types; so extra columns, whatever their names, do no harm."""
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()))


def struct_of(df: DataFrame) -> DataFrame:
    """df as one column `row`, so that helper columns beside it can't clash with its own; select('row.*') gives df back."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def bounded_batches(df: DataFrame, rows: int = 2000) -> DataFrame:
    """df, with Arrow batches of at most `rows` rows in its session, so that a Python worker holds a few MB of texts at a time. A smaller positive setting stays; 0 and less mean no limit."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key, "10000")) <= rows:
        df.sparkSession.conf.set(key, str(rows))
    return df


def slices(texts: list[bytes | None], size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts) of runs of texts of about `size` bytes, null as empty; a longer text is one of its own."""
    at, held, total = 0, [], 0
    for k, t in enumerate(texts):
        held.append(t or b"")
        total += len(held[-1])
        if total >= size:
            yield at, held
            at, held, total = k + 1, [], 0
    if held:
        yield at, held


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v): root is the smallest node of its component.

    Alternating large-star and small-star steps. Every step takes a minimum per node (partial sums before the shuffle) and one join that adaptive execution can split at a hub; neighbours are never gathered.
    Rounds grow as the logarithm of the size of a component. Nulls and loops are left out.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = materialize(now, "edges"), None
    for _ in range(max_rounds):
        if (state := _state(now)) == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("a"), "m").where("a <> m").unionByName(least.select(F.col("u").alias("a"), "m"))
        now = materialize(small.select(F.greatest("a", "m").alias("u"), F.least("a", "m").alias("v")).distinct(), "small-star")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def ranked(df: DataFrame, order: list, name: str) -> tuple[DataFrame, DataFrame]:
    """(df with `part` and `place`, spans (part, before)): in `order`, a row's rank over all rows from 0 is before + place.

    Ranges of `order`, sorted in their tasks and written once with their places; only one number per range is summed in one task. df should be a written table: its ranges are sampled first.
    """
    at = F.monotonically_increasing_id()
    rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", at), name)
    rows = rows.withColumn("part", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    return rows, spans
