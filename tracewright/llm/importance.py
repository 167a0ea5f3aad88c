"""Importance resampling towards a target: hashed word n-gram weights, with every distinct line's features counted once.

Line feeds part words, so a text's n-grams are those inside its lines and those that cross line ends. Distinct lines are counted, hashed once and multiplied by their occurrences; n-grams across lines are added from the documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, pick, ranked, slices

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 5, 42
#: A line with more than one in HOT of all line occurrences is dealt to several tasks; there are at most HOT such lines.
HOT = 1000

_IN_WORD = np.ones(256, bool)
for _a, _e in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    _IN_WORD[_a : _e + 1] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD[65:91] = True  # letters are lowered before words are cut


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _byte_table()


def _apply(op: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A linear map of CRCs, given as 4 tables of one byte each."""
    return op[0][c & 255] ^ op[1][c >> 8 & 255] ^ op[2][c >> 16 & 255] ^ op[3][c >> 24]


def _shift_tables(most: int = 64) -> tuple[np.ndarray, list[np.ndarray]]:
    """What n zero bytes do to a CRC: for every n below `most`, and for the powers of two."""
    small = np.zeros((most, 4, 256), np.uint32)
    small[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, most):
        small[n] = _CRC[small[n - 1] & 255] ^ (small[n - 1] >> 8)
    powers = [small[1]]
    for _ in range(40):
        powers.append(_apply(powers[-1], powers[-1]))
    return small, powers


_SMALL, _POWERS = _shift_tables()
_SPACE = np.uint32(zlib.crc32(b" "))


def _shift(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    k = np.where(n < len(_SMALL), n, 0)
    out = _SMALL[k, 0, c & 255] ^ _SMALL[k, 1, c >> 8 & 255] ^ _SMALL[k, 2, c >> 16 & 255] ^ _SMALL[k, 3, c >> 24]
    for bit in range(41 if (k != n).any() else 0):
        some = np.flatnonzero((n >= len(_SMALL)) & (n >> bit & 1 == 1))
        out[some] = _apply(_POWERS[bit], out[some])
    return out


def followed(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC of a text, a space and a further text of `size` bytes, from the CRCs of both."""
    return _shift(_apply(_SMALL[1], a) ^ _SPACE, size) ^ b


def cut(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes, first byte and size of every word."""
    low = _LOWER[np.frombuffer(data, np.uint8)]
    inside = np.concatenate(([False], _IN_WORD[low], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return low, edge[::2], edge[1::2] - edge[::2]


def word_crcs(low: np.ndarray, start: np.ndarray, size: np.ndarray, long: int = 32) -> np.ndarray:
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(size <= long)
    for k in range(long):
        some = some[size[some] > k]
        if not len(some):
            break
        c = crc[some]
        crc[some] = _CRC[(c ^ low[start[some] + k]) & 255] ^ (c >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(size > long).tolist():
        crc[k] = zlib.crc32(low[start[k] : start[k] + size[k]])
    return crc


def _listed(values: np.ndarray, owner: np.ndarray, owners: int) -> pa.ListArray:
    """values, in order of their owners, as one list each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=owners)))), pa.int32()), pa.array(values.astype(np.int16)))


def _owners(start: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Which text every word lies in, if texts stand one byte apart."""
    first = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return np.searchsorted(first, start, "right") - 1


def inner_features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of all features of each text, in order of texts."""
    low, start, size = cut(b"\n".join(texts))
    own, one = _owners(start, texts), word_crcs(low, start, size)
    n = len(own)
    crc, real = np.zeros((n, 3), np.uint32), np.zeros((n, 3), bool)
    crc[:, 0], real[:, 0] = one, True
    if n > 1:
        crc[:-1, 1], real[:-1, 1] = followed(one[:-1], one[1:], size[1:]), own[:-1] == own[1:]
    if n > 2:
        crc[:-2, 2], real[:-2, 2] = followed(crc[:-2, 1], one[2:], size[2:]), own[:-2] == own[2:]
    return crc[real] % np.uint32(buckets), np.repeat(own, real.sum(axis=1))


def crossing_features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of the features that cross a line end, in order of texts; and the number of words of each text."""
    low, start, size = cut(b"\n".join(texts))
    own = _owners(start, texts)
    line = np.cumsum(low == 10)[start] if len(low) else start
    two = np.flatnonzero((own[:-1] == own[1:]) & (line[:-1] != line[1:]))
    three = np.flatnonzero((own[:-2] == own[2:]) & (line[:-2] != line[2:]))
    need = np.unique(np.concatenate((two, two + 1, three, three + 1, three + 2)))
    one = np.zeros(len(own), np.uint32)
    one[need] = word_crcs(low, start[need], size[need])
    pairs = followed(one[two], one[two + 1], size[two + 1])
    triples = followed(followed(one[three], one[three + 1], size[three + 1]), one[three + 2], size[three + 2])
    crc, at = np.concatenate((pairs, triples)), np.concatenate((own[two], own[three]))
    order = np.argsort(at, kind="stable")
    return crc[order] % np.uint32(buckets), at[order], np.bincount(own, minlength=len(texts))


def _key(c: Column, name: str) -> list[Column]:
    """Two independent 64-bit hashes, together a key of 128 bits."""
    return [F.xxhash64(c).alias(f"{name}1"), F.xxhash64(F.lit(SEED), c).alias(f"{name}2")]


def line_table(docs: DataFrame, buckets: int) -> DataFrame:
    """Every distinct line once: (k1, k2, n: its occurrences, buckets of its features). Copies are added up before the shuffle."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").groupBy("line").count()
    lines = bounded_batches(lines.select(*_key(F.col("line"), "k"), F.col("count").alias("n"), F.col("line").cast("binary").alias("line")))

    def run(batches):
        for b in batches:
            for at, texts in slices(b.column("line").to_pylist()):
                found, own = inner_features(texts, buckets)
                yield pa.record_batch([*(b.column(c).slice(at, len(texts)) for c in ("k1", "k2", "n")), _listed(found, own, len(texts))], names=["k1", "k2", "n", "buckets"])

    return materialize(lines.mapInArrow(run, "k1 long, k2 long, n long, buckets array<short>"), "lines")


def crossing_table(docs: DataFrame, buckets: int) -> DataFrame:
    """Every document: (doc_id, t1, t2: key of its text, words, buckets of the features across its lines)."""
    docs = bounded_batches(docs.select("doc_id", *_key(F.col("text"), "t"), F.col("text").cast("binary").alias("text")))

    def run(batches):
        for b in batches:
            for at, texts in slices(b.column("text").to_pylist()):
                found, own, words = crossing_features(texts, buckets)
                yield pa.record_batch([*(b.column(c).slice(at, len(texts)) for c in ("doc_id", "t1", "t2")), pa.array(words.astype(np.int64)), _listed(found, own, len(texts))], names=["doc_id", "t1", "t2", "words", "buckets"])

    return materialize(docs.mapInArrow(run, "doc_id long, t1 long, t2 long, words long, buckets array<short>"), "crossings")


def bucket_sums(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) over rows (n, buckets): each row's features, n times. A task adds up its rows first."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            held = b.column("buckets")
            times = np.repeat(b.column("n").to_numpy(zero_copy_only=False), np.diff(held.offsets.to_numpy()))
            total += np.bincount(held.flatten().to_numpy(), weights=times, minlength=buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    return rows.select("n", "buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def target_sums(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) over all features of whole texts."""

    def run(batches):
        for b in batches:
            for _, some in slices(b.column(0).to_pylist()):
                found, own = inner_features(some, buckets)
                yield pa.record_batch([pa.array(np.ones(len(some), np.int64)), _listed(found, own, len(some))], names=["n", "buckets"])

    return bucket_sums(bounded_batches(texts.select(F.col("text").cast("binary"))).mapInArrow(run, "n long, buckets array<short>"), buckets)


def bucket_gains(spark, sums: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of every bucket: floor of 1000 times the log of smoothed target share over corpus share. One number a bucket."""
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(sums.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0)
    all_ = both.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    d = lambda c: (F.col(c) + 1).cast("double")
    gain = F.floor(1000 * F.log(d("t") * float(all_["S"] + buckets) / (d("s") * float(all_["T"] + buckets))))
    out = np.zeros(buckets, np.int64)
    for r in both.select("bucket", gain.alias("gain")).collect():
        out[r["bucket"]] = r["gain"]
    return out


def weigh(rows: DataFrame, gains: np.ndarray, keep: list[str]) -> DataFrame:
    """rows' columns `keep`, and `weight`: the gains of their buckets added up."""

    def run(batches):
        for b in batches:
            held = b.column("buckets")
            upto = np.concatenate(([0], np.cumsum(gains[held.flatten().to_numpy()])))
            cuts = held.offsets.to_numpy() - held.offsets[0].as_py()
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(upto[cuts[1:]] - upto[cuts[:-1]])], names=[*keep, "weight"])

    return rows.select(*keep, "buckets").mapInArrow(run, ", ".join(f"{c} long" for c in [*keep, "weight"]))


def line_weights(docs: DataFrame, lines: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, t1, t2, weight) of every line occurrence. A line with more than 1/HOT of all occurrences is joined in shares of at most that size, dealt by document."""
    total = lines.agg(F.sum("n")).first()[0] or 0
    share = total // HOT + 1
    hot = lines.where(F.col("n") > share).select("k1", "k2", F.ceil(F.col("n") / share).alias("shares"))
    weights = weigh(lines, gains, ["k1", "k2", "n"])
    weights = weights.withColumn("share", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > share, F.ceil(F.col("n") / share).cast("int") - 1).otherwise(0))))
    found = docs.select("doc_id", *_key(F.col("text"), "t"), F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").select("doc_id", "t1", "t2", *_key(F.col("line"), "k"))
    # at most HOT rows, as they hold more than 1/HOT of all each
    found = found.join(F.broadcast(hot), ["k1", "k2"], "left")
    found = found.withColumn("share", F.coalesce(F.pmod(F.xxhash64("doc_id", "t1"), F.col("shares")), F.lit(0)).cast("int")).drop("shares")
    return found.join(weights.drop("n"), ["k1", "k2", "share"]).select("doc_id", "t1", "t2", "weight")


def importance(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, words, n_features, weight) of every row of docs (doc_id, text) towards the texts of target.

    Null and empty texts have no words, no features and weight 0. Texts are read whole. Null and repeated doc_ids are rows of their own; rows of equal doc_id and text are counted together and come out as often as they came in. Other columns are not read. Empty docs: no rows; empty target: all target counts are 0.
    """
    spark = docs.sparkSession
    docs = pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    lines, crossings = line_table(docs, buckets), crossing_table(docs, buckets)
    sums = bucket_sums(lines, buckets).unionByName(bucket_sums(crossings.withColumn("n", F.lit(1).cast("long")), buckets)).groupBy("bucket").agg(F.sum("n").alias("n"))
    gains = bucket_gains(spark, sums, target_sums(pick(target, text="string"), buckets), buckets)
    none = F.lit(0).cast("long")
    parts = line_weights(docs, lines, gains).withColumns({"words": none, "rows": none}).unionByName(weigh(crossings, gains, ["doc_id", "t1", "t2", "words"]).withColumn("rows", none + 1))
    whole = parts.groupBy("doc_id", "t1", "t2").agg(*(F.sum(c).alias(c) for c in ("weight", "words", "rows")))
    n = F.expr("words div rows")
    features = n + F.greatest(n - 1, none) + F.greatest(n - 2, none)
    one = whole.select("doc_id", n.alias("words"), features.alias("n_features"), F.expr("weight div rows").alias("weight"), "rows")
    return one.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("_", "rows")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel draw that depends on seed and doc_id alone (null: empty), rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score (weight plus noise), rank among the drawn (null: not drawn).

    Of the documents with least_words words or more, the `percent` in a hundred of highest scores are drawn, ties to smaller doc_ids (null last). Ranks come from sorted ranges, so no task holds all. Other cases: see importance().
    """
    scored = importance(docs, target, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("fit", F.col("words") >= least_words)
    scored = materialize(scored, "importance")
    rows, spans = ranked(scored, [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")], "importance-order")
    drawn = scored.where("fit").count() * percent // 100
    # one row per range
    rank = F.col("before") + F.col("place") + 1
    out = rows.join(F.broadcast(spans), "part")
    return out.select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))


#: CRC-32 is folded byte by byte with its table; an n-gram's goes on from that of the n-gram without its last word, each different one once.
RESAMPLE_SQL = r"""
WITH t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM range(256) r(i))),
texts AS (SELECT 'd' AS side, doc_id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 'b', NULL, row_number() OVER (), text FROM benchmark),
cut AS (SELECT side, doc_id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
w AS (SELECT side, r, unnest(ws) AS w1, generate_subscripts(ws, 1) AS pos FROM cut),
g AS MATERIALIZED (SELECT side, r, w1, lead(w1) OVER (PARTITION BY side, r ORDER BY pos) AS w2, lead(w1, 2) OVER (PARTITION BY side, r ORDER BY pos) AS w3 FROM w),
word AS MATERIALIZED (SELECT w1 AS word, list_prepend(32::BIGINT, list_transform(regexp_extract_all(hex(encode(w1)), '..'), lambda h: ('0x' || h)::BIGINT)) AS bytes FROM (SELECT DISTINCT w1 FROM w)),
c1 AS MATERIALIZED (SELECT word AS w1, list_reduce(list_prepend(4294967295::BIGINT, bytes[2:]), lambda a, b: xor(t.t[(xor(a, b) & 255) + 1], a >> 8)) AS s FROM word, t),
c2 AS MATERIALIZED (SELECT x.w1, x.w2, list_reduce(list_prepend(c1.s, bytes), lambda a, b: xor(t.t[(xor(a, b) & 255) + 1], a >> 8)) AS s FROM (SELECT DISTINCT w1, w2 FROM g WHERE w2 IS NOT NULL) x JOIN c1 USING (w1) JOIN word ON word = w2, t),
c3 AS MATERIALIZED (SELECT x.w1, x.w2, x.w3, list_reduce(list_prepend(c2.s, bytes), lambda a, b: xor(t.t[(xor(a, b) & 255) + 1], a >> 8)) AS s FROM (SELECT DISTINCT w1, w2, w3 FROM g WHERE w3 IS NOT NULL) x JOIN c2 USING (w1, w2) JOIN word ON word = w3, t),
f AS MATERIALIZED (SELECT side, r, xor(s, 4294967295) % 10000 AS b FROM g JOIN c1 USING (w1) UNION ALL SELECT side, r, xor(s, 4294967295) % 10000 FROM g JOIN c2 USING (w1, w2) UNION ALL SELECT side, r, xor(s, 4294967295) % 10000 FROM g JOIN c3 USING (w1, w2, w3)),
n AS (SELECT b, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f GROUP BY b),
al AS (SELECT count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f),
gain AS (SELECT n.b, CAST(floor(1000 * ln((n.t + 1)::DOUBLE * (al.s + 10000)::DOUBLE / ((n.s + 1)::DOUBLE * (al.t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM n, al),
wt AS (SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN gain USING (b) WHERE side = 'd' GROUP BY r),
sc AS (SELECT doc_id, len(ws) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM cut LEFT JOIN wt USING (r) WHERE side = 'd'),
ra AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS o, count(*) OVER (PARTITION BY words >= 20) AS n FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND o <= 5 * n // 100 THEN o END AS rank FROM ra
"""
