"""Quality classifier: regularised quadratic discriminant over transformed statistics of whole texts."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, pick

FEATURES = ("log_words", "log_word_len", "upper", "digit", "punct", "symbol", "space", "distinct", "top_word", "same_next", "log_line", "distinct_lines", "ends", "odd_words")
_KIND = np.zeros(256, np.uint8)  # 0 letter or other, 1 upper, 2 digit, 3 sentence punctuation, 4 other ASCII symbol, 5 white space, 6 UTF-8 continuation
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 4
_KIND[[ord(c) for c in ".,;:'\"-()?!"]] = 3
_KIND[[32, 9, 10, 11, 12, 13]] = 5
_KIND[128:192] = 6


def _logit(share: float, n: float) -> float:
    """Log odds of a share, drawn to the middle as for one more of either kind."""
    p = (share * n + 0.5) / (n + 1.0)
    return math.log(p / (1.0 - p))


def features(text: bytes | None) -> list[float]:
    """Statistics of the whole text, each on a log or log-odds scale. Null and empty texts have finite values too."""
    text = text or b""
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=7) if text else np.zeros(7, np.int64)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    chars, n = float(len(text) - kinds[6]), len(words)
    share = lambda k: _logit(k / chars if chars else 0.0, chars)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    odd = sum(not w.rstrip(b".,;:!?")[-1:].isalnum() and w[-1] < 128 for w in words)
    odd_part = lambda k, m: _logit(k / m if m else 0.0, m)
    return [
        math.log1p(n), math.log1p((chars - kinds[5]) / n if n else 0.0), share(kinds[1]), share(kinds[2]), share(kinds[3]), share(kinds[4]), share(kinds[5]),
        odd_part(len(counts), n) / (1.0 + math.log1p(n)), odd_part(top, n), odd_part(same, max(n - 1, 0)),
        math.log1p(chars / len(lines) if lines else 0.0), odd_part(len(set(lines)), len(lines)), odd_part(sum(x.rstrip()[-1:] in b".!?" for x in lines), len(lines)), odd_part(odd, n),
    ]


def document_features(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, x (array of double). Rows of a batch are read one at a time."""

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            offsets = pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32))
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["doc_id", "x"])

    return bounded_batches(pick(docs, doc_id="long", text="binary")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Per class: log prior, mean, inverse Cholesky factor of the shrunken covariance, and log determinant. All are computed once and sent with the task."""

    prior: tuple[float, float]
    mean: np.ndarray
    factor: np.ndarray
    logdet: tuple[float, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 from the difference of the two log densities."""
        dens = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.factor[k].T
            dens.append(self.prior[k] - 0.5 * (self.logdet[k] + np.einsum("ij,ij->i", z, z)))
        return 1.0 / (1.0 + np.exp(-np.clip(dens[1] - dens[0], -700, 700)))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1 if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(labelled: DataFrame, shrink: float = 0.3, toward: float = 0.1) -> Discriminant:
    """labelled (x, y in 0, 1) -> model. Sums and outer products of every labelled row are added up on the executors; the driver gets one small matrix a class.

    A class covariance is mixed with the pooled one (weight `toward`), then with a scaled diagonal (weight `shrink`). A class without rows takes the pooled mean, and a prior as of half a row; without any labels every score is 0.5. Sums of doubles are added in the order in which tasks end, so scores may differ in their last digits from run to run.
    """
    d = len(FEATURES) + 1

    def run(batches):
        sums = np.zeros((2, d, d))
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(0).to_pylist(), float).reshape(-1, d - 1)
                y = b.column(1).to_numpy(zero_copy_only=False)
                x = np.column_stack([np.ones(len(x)), x])
                for k in (0, 1):
                    sums[k] += x[y == k].T @ x[y == k]
        yield pa.record_batch([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], names=["cell", "s"])

    sums = np.zeros(2 * d * d)
    for r in labelled.select("x", F.col("y").cast("int")).mapInArrow(run, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect():
        sums[r["cell"]] = r["s"]
    sums = sums.reshape(2, d, d)
    n, both = sums[:, 0, 0], sums.sum(axis=0)
    total = max(both[0, 0], 1.0)
    pooled_mean = both[0, 1:] / total
    spread = lambda s, m, k: s[1:, 1:] / max(k, 1.0) - np.outer(m, m)
    means = np.array([sums[k, 0, 1:] / n[k] if n[k] else pooled_mean for k in (0, 1)])
    within = sum(n[k] / total * spread(sums[k], means[k], n[k]) for k in (0, 1) if n[k]) if n.any() else np.eye(d - 1)
    factors, logdets = [], []
    for k in (0, 1):
        own = spread(sums[k], means[k], n[k]) if n[k] > 1 else within
        cov = (1 - toward) * own + toward * within
        cov = (1 - shrink) * cov + shrink * np.diag(np.maximum(np.diag(within), 1e-6)) + 1e-9 * np.eye(d - 1)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        logdets.append(float(2 * np.log(np.diag(low)).sum()))
    prior = tuple(float(np.log((n[k] + 0.5) / (n.sum() + 1.0))) for k in (0, 1))
    return Discriminant(prior, means, np.array(factors), tuple(logdets))


def train(features_: DataFrame, labels: DataFrame) -> Discriminant:
    """Join the small feature rows with labels whose doc_id isn't held out; quality null or not 0 or 1 is no label, and every row of a repeated label counts."""
    y = pick(labels, doc_id="long", quality="int").where("quality in (0, 1)").where(~F.coalesce(held_out(), F.lit(True)))
    return fit(features_.join(y.withColumnRenamed("quality", "y"), "doc_id").select("x", "y"))


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, quality) -> doc_id, held_out, score, predicted, one row per row of docs.

    Only the text enters a score. Null text: scored as empty. Null doc_id: scored, held_out false. Repeated rows stay. Other columns are not read. Empty table: no rows; no labels: every score 0.5, predicted 1.
    """
    x = materialize(document_features(docs), "quality-features")
    model = train(x, labels)

    def run(batches):
        for b in batches:
            s = model.score(np.array(b.column(1).to_pylist(), float).reshape(-1, len(FEATURES))) if b.num_rows else np.zeros(0)
            yield pa.record_batch([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = x.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs that the classifier accepts, with all their columns. Texts are not shuffled: the model is trained on features of all documents, and each task scores its own texts again.

    Null and empty texts are scored as empty, very long ones whole; repeated rows and null ids fare by their text; columns of any name stay. Empty docs: no rows. No labels: all rows (score 0.5).
    """
    model = train(materialize(document_features(docs), "quality-features"), labels)
    schema = docs.schema

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            if b.num_rows:
                s = model.score(np.array([features(t) for t in b.column(at).cast(pa.binary()).to_pylist()]))
                yield b.filter(pa.array(s >= 0.5))

    return bounded_batches(docs).mapInArrow(run, schema)
