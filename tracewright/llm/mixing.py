"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

Words are summed by source and hash bucket; the bucket in which the budget of a source ends is refined twice more, and a plain filter on the hash takes the documents. No source is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, pick

LEVELS, BITS = 3, 16


def hash48() -> Column:
    """48 bits of the MD5 of doc_id; of the text where doc_id is null."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """One row per source: weight by its place in code point order (null last), and its target.

    All targets together are share times all words. A target stops at `most` times its source's words and the excess goes to the others by weight. The level at which that ends is found in closed form over the sources ordered by limit / weight; those windows hold all sources in one task, so sources are names (up to some millions), not keys that grow with the rows.
    """
    total = Window.partitionBy()
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("limit", (most * F.col("source_size")).cast("double")).withColumn("ratio", F.col("limit") / F.col("weight"))
    upto = Window.orderBy("ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumns({"budget": F.lit(float(share)) * F.sum("source_size").over(total), "all_w": F.sum("weight").over(total), "sum_l": F.sum("limit").over(upto), "sum_w": F.sum("weight").over(upto)})
    s = s.withColumn("full", F.col("sum_l") + F.col("ratio") * (F.col("all_w") - F.col("sum_w")) <= F.col("budget"))
    spent, left = F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(total), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(total)
    s = s.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.least("limit", (F.col("budget") - spent) * F.col("weight") / left)))
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    return s.withColumn("whole", whole).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))).select("source", "source_size", "target", "whole", "rest")


def _sizes(docs: DataFrame) -> DataFrame:
    n = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")
    return materialize(pick(docs, doc_id="long", text="string", source="string").select("doc_id", "source", F.greatest(n, F.lit(0)).alias("size"), hash48().alias("h")), "mix-sizes")


def mix_limits(sized: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """sized (source, size, h) -> one row per source: source_size, target, whole (times that every document is taken) and end (documents with a hash below it are taken once more)."""
    targets = materialize(source_targets(sized, weights, share, most), "mix-targets")
    state = targets.where("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("tied"))
    for level in range(LEVELS):
        low = BITS * (LEVELS - 1 - level)
        inside = _by_source(sized.select("source", "size", "h"), state).where(F.shiftright("h", low + BITS) == F.col("prefix"))
        hist = inside.groupBy("source", "rest", F.shiftright("h", low).alias("bucket")).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy("source"))}).where("upto >= least(rest, total)")
        edge = hist.groupBy("source", "rest").agg(F.min_by(F.struct("bucket", "n", "upto"), "bucket").alias("e"))
        state = materialize(edge.select("source", (F.col("rest") - F.col("e.upto") + F.col("e.n")).alias("rest"), F.col("e.bucket").alias("prefix"), F.col("e.n").alias("tied")), "mix-edge")
    ends = state.select("source", (F.col("prefix") + (2 * F.col("rest") >= F.col("tied")).cast("long")).alias("end"))
    return materialize(_by_source(targets, ends, "left").select("source", "source_size", "target", "whole", F.coalesce("end", F.lit(0)).alias("end")), "mix-limits")


def mix_to_targets(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, size, source_size, target, repeats, taken.

    Every document is taken floor(target / source_size) times, and once more if its hash is below the threshold of its source. The last document at the threshold is taken if that comes nearer to the target.
    Null text: size 0. Null source: a source like any other, last in order. Null doc_id: hashed by its text. Rows of the same doc_id are taken together. Other columns are not read. Empty table: no rows. Same input, same rows.
    """
    sized = _sizes(docs)
    limits = mix_limits(sized, weights, share, most)
    repeats = F.col("whole") + (F.col("h") < F.col("end")).cast("int")
    return _by_source(sized, limits).select("doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken"))


def take_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """docs with each row as often as the mix takes it, with all its columns. Only the small table of limits meets the texts, which are not shuffled unless that table is too large to broadcast.

    Null source: a source like any other. Null text: no words. Null doc_id: taken by the hash of its text. Rows of one doc_id are taken together. Extra columns stay, whatever their names. Empty table: no rows.
    """
    limits = mix_limits(_sizes(docs), weights, share, most).withColumn("source", F.col("source").cast(docs.schema["source"].dataType))
    rows = docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).select("source", "row", hash48().alias("h"))
    repeats = F.col("whole") + (F.col("h") < F.col("end")).cast("int")
    turns = _by_source(rows, limits).select("row", repeats.alias("repeats"), F.explode(F.sequence(F.lit(1), F.lit(most))).alias("turn"))
    return turns.where("turn <= repeats").select("row.*")


def _by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join by source, null like any other. The right side is a small written table, so the planner broadcasts it if its measured size allows, and else sorts and splits a hot source."""
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, left["source"].eqNullSafe(right["_source"]), how).drop("_source")


#: doc_id is hashed as above; a window finds each source's threshold by sorting, for comparison.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM s),
r AS (SELECT *, CAST(2 * source_size AS DOUBLE) AS lim, 2.0 * source_size / weight AS ratio FROM w),
c AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(weight) OVER () AS all_w,
        sum(lim) OVER (ORDER BY ratio RANGE UNBOUNDED PRECEDING) AS sum_l, sum(weight) OVER (ORDER BY ratio RANGE UNBOUNDED PRECEDING) AS sum_w FROM r),
f AS (SELECT *, sum_l + ratio * (all_w - sum_w) <= budget AS is_full FROM c),
t AS (SELECT source, source_size, CASE WHEN is_full THEN lim ELSE
        least(lim, (budget - sum(CASE WHEN is_full THEN lim ELSE 0 END) OVER ()) * weight / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ()) END AS target FROM f),
q AS (SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size)) ELSE 0 END AS whole FROM t),
b AS (SELECT *, greatest(0, target - whole * source_size) AS rest FROM q),
h AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
u AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto, sum(n) OVER (PARTITION BY source) AS total FROM h),
e AS (SELECT b.source, min(u.h) AS h, min_by(u.n, u.h) AS n, min_by(u.upto, u.h) AS upto FROM b JOIN u ON b.source IS NOT DISTINCT FROM u.source
      WHERE b.rest > 0 AND u.upto >= least(b.rest, u.total) GROUP BY b.source),
l AS (SELECT b.*, coalesce(e.h + CAST(2 * (b.rest - e.upto + e.n) >= e.n AS INT), 0) AS until FROM b LEFT JOIN e ON b.source IS NOT DISTINCT FROM e.source)
SELECT d.doc_id, d.size, l.source_size, l.target, CAST(d.size * (l.whole + CAST(d.h < l.until AS INT)) AS BIGINT) AS taken
FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source
"""
