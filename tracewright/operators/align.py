"""Alignment of a trace's action signatures with its task's reference trace."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUT = "trace_id string, reference string, idx int, signature string, ref_place int"
#: Pairs of a table that is made whole.
SMALL = 1 << 20
#: Effects that count as one another: both say that the action holds. OFF-ANCHOR counts as any effect.
HOLDS, ANY = ("SURVIVED", "JUSTIFIED"), "OFF-ANCHOR"


def codes(*sides: list) -> list[np.ndarray]:
    """The same small numbers for equal values of all sides."""
    known: dict = {}
    return [np.array([known.setdefault(v, len(known)) for v in side], np.int64) for side in sides]


class Fits:
    """Whether two signatures match, on class, target and effects that count as one another; a row of it at a time, for one reference signature against all own ones."""

    def __init__(self, reference: list[dict], own: list[dict]):
        what = lambda side: [(s["action_class"], s["target"]) for s in side]
        effect = lambda side: [HOLDS[0] if s["effect"] in HOLDS else s["effect"] or "" for s in side]
        self.a, self.b = codes(what(reference), what(own))
        self.x, self.y, any_ = codes(effect(reference), effect(own), [ANY])
        self.any = int(any_[0])
        self.free = self.y == self.any
        self.shape = (len(self.a), len(self.b))

    def whole(self) -> Matrix:
        """All rows at once."""
        effect = (self.x[:, None] == self.y[None, :]) | (self.x == self.any)[:, None] | self.free[None, :]
        return Matrix((self.a[:, None] == self.b[None, :]) & effect)

    def row(self, r: int, first: int = 0) -> np.ndarray:
        """Row r from column `first` on."""
        same = self.b[first:] == self.a[r]
        return same if self.x[r] == self.any else same & ((self.y[first:] == self.x[r]) | self.free[first:])


class Matrix:
    """The same over a given matrix."""

    def __init__(self, fit: np.ndarray):
        self.fit, self.shape = fit, fit.shape

    def row(self, r: int, first: int = 0) -> np.ndarray:
        return self.fit[r, first:]


def fitting(reference: list[dict], own: list[dict]) -> np.ndarray:
    """[reference, own]: whether two signatures match."""
    return Fits(reference, own).whole().fit


def _above(below: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """Row of common lengths from the one below it: one more where its pairs fit, and never less than what lies to its right. So a row is two array operations."""
    out = np.zeros_like(below)
    here = np.maximum(below[:-1], np.where(fit, below[1:] + 1, 0))
    out[:-1] = np.maximum.accumulate(here[::-1])[::-1]
    return out


def longest_match(fit: np.ndarray | Fits) -> np.ndarray:
    """For every column its row, or -1: the longest common subsequence that, from the start on, takes a fitting pair whenever both sides stand at one, and else leaves out of the reference as long as that costs nothing.

    Lengths of what follows from row r and column k on grow from the last row up; the walk goes down from the first. So every B-th row is kept, B the square root of their number, and the rows between two of them are made again when the walk comes there, from its column on: memory is (rows / B + B) columns, not rows times columns. Small tables are made once, whole.
    """
    fits = Matrix(fit) if isinstance(fit, np.ndarray) else fit
    rows, cols = fits.shape
    small = rows * cols <= SMALL
    if small and isinstance(fits, Fits):
        fits = fits.whole()
    step = max(1, rows if small else math.isqrt(rows))
    kept, length = {rows: np.zeros(cols + 1, np.int32)}, np.zeros(cols + 1, np.int32)
    for r in range(rows - 1, 0 if not small else rows, -1):
        length = _above(length, fits.row(r))
        if r % step == 0:
            kept[r] = length
    found, k = np.full(cols, -1, np.int64), 0
    for top in range(0, rows, step):
        end, first = min(rows, top + step), k
        block = [kept.pop(end)[first:]]
        for r in range(end - 1, top - 1, -1):
            block.append(_above(block[-1], fits.row(r, first)))
        for r in range(top, end):
            if k == cols:
                return found
            here, below, own = block.pop(), block[-1], fits.row(r, k)
            at = k - first
            # the first column where the pair fits, or where leaving this row out costs nothing
            stops = own | (below[at:-1] >= here[at + 1 :])
            if not stops.any():
                return found
            go = int(np.argmax(stops))
            k += go
            if own[go]:
                found[k], k = r, k + 1
    return found


def align_to_reference(sigs: DataFrame, traces: DataFrame, references: DataFrame) -> DataFrame:
    """(OUT) every signature of every trace with its place in the reference's, null where it has none. A task holds the signatures of one trace and its reference at a time; a trace of n and a reference of m signatures take about 2 n sqrt(m) small numbers. References are their tasks' shortest traces, so a pair is not much larger than the trace alone."""
    row = F.struct("idx", "action_class", "target", "effect", "signature")
    own = sigs.groupBy("trace_id").agg(F.array_sort(F.collect_list(row)).alias("own"))
    ref = own.select(F.col("trace_id").alias("reference"), F.col("own").alias("ref")).join(references.select("task_id", F.col("trace_id").alias("reference")), "reference")
    pairs = own.join(traces.select("trace_id", "task_id"), "trace_id").join(ref, "task_id").select("trace_id", "reference", "own", "ref")

    def run(batches):
        for b in batches:
            out = []
            for t, r, mine, theirs in zip(*(b.column(n).to_pylist() for n in ("trace_id", "reference", "own", "ref")), strict=True):
                out += [(t, r, s["idx"], s["signature"], int(k) if k >= 0 else None) for s, k in zip(mine, longest_match(Fits(theirs, mine)), strict=True)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in OUT.split(", ")])

    return pairs.mapInArrow(run, OUT)


def divergence_spans(aligned: DataFrame) -> DataFrame:
    """Maximal runs of signatures without a match: (trace_id, start_idx, end_idx, length)."""
    w = Window.partitionBy("trace_id").orderBy("idx")
    a = aligned.withColumn("run", F.sum(F.col("ref_place").isNotNull().cast("int")).over(w)).where("ref_place is null")
    return a.groupBy("trace_id", "run").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.count("*").alias("length")).drop("run")


def alignment_stats(aligned: DataFrame, sigs: DataFrame) -> DataFrame:
    """Per trace: coverage (share of its signatures that match), n_added (that don't), off_anchor_ratio, each rounded to four places."""
    a = aligned.groupBy("trace_id").agg(F.count("*").alias("n"), F.count("ref_place").alias("hit"))
    off = sigs.groupBy("trace_id").agg(F.avg((F.col("effect") == ANY).cast("double")).alias("off"))
    return a.join(off, "trace_id").select("trace_id", F.round(F.col("hit") / F.col("n"), 4).alias("coverage"), (F.col("n") - F.col("hit")).alias("n_added"), F.round("off", 4).alias("off_anchor_ratio"))
