"""Cutting the lineage of iterative jobs through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; only local sessions without one get a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tracewright-")
    return f"{root.rstrip('/')}/files-{uuid.uuid4().hex[:12]}"


def durable(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: it is computed once (an eager checkpoint() computes it twice), its lineage is cut, it survives lost executors, and the planner knows its size."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable_long(df: DataFrame) -> DataFrame:
    """durable() for tables that grow with spans, events or traces: the planner takes a Parquet file's compressed size for the size of its rows, a tenth of it here, and would send a table of hundreds of MB whole through the driver. With this hint joins are merged, whatever the size."""
    return durable(df).hint("merge")


def durable_by(df: DataFrame, key: str) -> DataFrame:
    """durable_long() dealt into as many buckets by `key` as shuffles have partitions, so that windows, aggregations and joins by `key`, or by it and more columns, need no shuffle. The latter holds for joins as the session no longer asks that both sides be dealt by all columns of a join."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), "kept_" + path[-12:]
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(name)
    return spark.table(name).hint("merge")
