"""SimHash fingerprints of word shingles, and their near-duplicate classes by the generalised pigeonhole principle."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, materialize, pick, struct_of

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
CHUNK = 1 << 15


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash: bit b is 1 if it is set in over half the XXH64 values of the shingles, repeats included. Null and blank texts: 0."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, ends = np.concatenate(([0], ends[:-1])), ends - 1
    n = max(1, len(words) - width + 1)
    starts, ends, hash_of = starts[:n].tolist(), ends[-n:].tolist(), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        hashes = np.array([hash_of(line[a:b], seed) for a, b in zip(starts[k : k + CHUNK], ends[k : k + CHUNK], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp (the 64 bits as a signed long)."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, width, seed) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return bounded_batches(pick(docs, doc_id="long", text="binary")).mapInArrow(run, "doc_id long, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_correlations(nodes: DataFrame) -> np.ndarray:
    """Absolute correlations of the 64 bits. Counts cover all fingerprints; the driver gets 64 x 64 sums."""

    def run(batches):
        both, n = np.zeros((64, 64)), 0
        for b in batches:
            x = _bits(b.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            for k in range(0, len(x), CHUNK):
                both += x[k : k + CHUNK].T @ x[k : k + CHUNK]
            n += len(x)
        if n:
            yield pa.record_batch([pa.array(np.arange(4097)), pa.array(np.append(both.ravel(), n).astype(np.int64))], names=["cell", "n"])

    sums = {r["cell"]: r["n"] for r in nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    n = max(1, sums.get(4096, 0))
    both = np.array([sums.get(k, 0) for k in range(4096)], float).reshape(64, 64) / n
    one = both.diagonal()
    sd = np.sqrt(np.maximum(one * (1 - one), 1e-12))
    return np.abs((both - np.outer(one, one)) / np.outer(sd, sd))


def correlated_partitions(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Bits 0..63 in groups of nearly equal size, each grown from the bit that correlates most by adding the bit most correlated with the group."""
    free, groups = list(range(64)), []
    for k in range(parts):
        group: list[int] = []
        while len(group) < 64 // parts + (k < 64 % parts):
            score = corr[np.ix_(free, group or free)].sum(axis=1)
            group.append(free.pop(int(np.argmax(np.round(score, 9)))))
        groups.append(sorted(group))
    return groups


def _project(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((fps.view(np.uint64) >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def distance_shares(nodes: DataFrame, groups: list[list[int]], most: int) -> list[np.ndarray]:
    """For every block of up to 8 bits of a group: table [value, d] of the share of all fingerprints that differ from value in just d of its bits. At most 256 counts a block reach the driver."""
    blocks = [g[k : k + 8] for g in groups for k in range(0, len(g), 8)]

    def run(batches):
        counts = np.zeros((len(blocks), 256), np.int64)
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            for i, bits in enumerate(blocks):
                counts[i] += np.bincount(_project(fps, bits), minlength=256)
        at = np.flatnonzero(counts.ravel())
        yield pa.record_batch([pa.array(at), pa.array(counts.ravel()[at])], names=["cell", "n"])

    counts = np.zeros((len(blocks), 256))
    for r in nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"] // 256, r["cell"] % 256] = r["n"]
    apart = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)])
    n = max(1.0, counts[0].sum())
    return [np.stack([(apart == d) @ c / n for d in range(most + 1)], axis=1) for c in counts]


def allocate(fps: np.ndarray, groups: list[list[int]], shares: list[np.ndarray], n: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds [query, group] from -1 (not probed) up, with sum(threshold + 1) = most + 1, of least estimated cost, and that cost: keys probed plus candidates met. Dynamic programming over the groups, for all queries at once."""
    spend = most + 1
    best = np.full((len(fps), spend + 1), np.inf)
    best[:, 0], chosen, at = 0.0, [], 0
    for bits in groups:
        ball = np.ones((len(fps), 1))
        for k in range(0, len(bits), 8):
            part = shares[at][_project(fps, bits[k : k + 8])]
            ball = np.stack([sum(ball[:, i] * part[:, d - i] for i in range(d + 1) if i < ball.shape[1]) for d in range(most + 1)], axis=1)
            at += 1
        keys = np.cumsum([float(len(list(combinations(range(len(bits)), d)))) for d in range(most + 1)])
        cost = np.concatenate([np.zeros((len(fps), 1)), keys + n * np.cumsum(ball, axis=1)], axis=1)
        options = np.stack([np.stack([best[:, s - e] + cost[:, e] if e <= s else np.full(len(fps), np.inf) for e in range(spend + 1)], axis=1) for s in range(spend + 1)], axis=1)
        pick_e = options.argmin(axis=2)
        best = np.take_along_axis(options, pick_e[:, :, None], axis=2)[:, :, 0]
        chosen.append(pick_e)
    out, left = np.zeros((len(fps), len(groups)), np.int64), np.full(len(fps), spend)
    for g in range(len(groups) - 1, -1, -1):
        e = chosen[g][np.arange(len(fps)), left]
        out[:, g], left = e - 1, left - e
    return out, best[:, spend]


def cheapest_partitions(nodes: DataFrame, most: int, n: float, parts: tuple[int, ...]) -> tuple[list[list[int]], list[np.ndarray]]:
    """Of the numbers of groups in `parts`, the one whose allocated thresholds cost least over all fingerprints: few wide groups pay when there are many fingerprints, more and narrower ones when there are few."""
    corr = bit_correlations(nodes)
    ways = [correlated_partitions(corr, p) for p in parts]
    every = distance_shares(nodes, [g for way in ways for g in way], most)
    shares, at = [], 0
    for way in ways:
        width = sum(-(-len(g) // 8) for g in way)
        shares.append(every[at : at + width])
        at += width

    def run(batches):
        total = np.zeros(len(ways))
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(fps), 4096):
                total += [allocate(fps[k : k + 4096], way, share, n, most)[1].sum() for way, share in zip(ways, shares, strict=True)]
        yield pa.record_batch([pa.array(np.arange(len(ways))), pa.array(total)], names=["way", "cost"])

    cost = {r["way"]: r["cost"] for r in nodes.select("fp").mapInArrow(run, "way long, cost double").groupBy("way").agg(F.sum("cost").alias("cost")).collect()}
    best = min(range(len(ways)), key=lambda w: (float(f"{cost.get(w, 0.0):.6g}"), w))
    return ways[best], shares[best]


def links(nodes: DataFrame, most: int = 2, parts: tuple[int, ...] = (3, 2)) -> DataFrame:
    """All pairs (u, v) of different fingerprints, u < v, that differ in `most` bits at most.

    If thresholds of a query's groups satisfy sum(threshold + 1) = most + 1, a partner lies within the threshold in one group at least. So every fingerprint is stored under its value in each group, and probes in each group all values within its own threshold there. Each query finds every partner, so a pair is kept at its smaller member only. The join itself verifies the distance, so that no candidate leaves it. The number of groups is chosen by the same cost estimate as the thresholds.
    """
    n = float(nodes.count())
    groups, shares = cheapest_partitions(nodes, most, n, parts)
    masks = [[np.array([sum(1 << b for b in c) for c in combinations(range(len(g)), d)], np.int64) for d in range(most + 1)] for g in groups]

    def stored(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array(np.concatenate([_project(fps, bits) | (g << 40) for g, bits in enumerate(groups)])), pa.array(np.tile(fps, len(groups)))], names=["key", "v"])

    def probes(batches):
        for b in batches:
            whole = b.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(whole), 4096):
                fps = whole[k : k + 4096]
                radius, _ = allocate(fps, groups, shares, n, most)
                for g, bits in enumerate(groups):
                    for d in range(most + 1):
                        some = fps[radius[:, g] >= d]
                        keys = (_project(some, bits)[:, None] ^ masks[g][d][None, :]) | (g << 40)
                        if keys.size:
                            yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(some, keys.shape[1]))], names=["key", "u"])

    fps = nodes.select("fp")
    found = fps.mapInArrow(probes, "key long, u long").join(fps.mapInArrow(stored, "key long, v long"), "key")
    return found.where(f"u < v and bit_count(u ^ v) <= {int(most)}").select("u", "v")


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, most: int = 2, parts: tuple[int, ...] = (3, 2)) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links, itself included).

    Exact copies share a fingerprint and are one node from the start, however many they are. Null or blank text: fingerprint zero, linked like any other. Rows of the same doc_id are separate members. Null doc_id: a member that can't be the smallest, unless all are null (component_id null). Other columns are not read. Empty table: no rows.
    """
    own = materialize(fingerprints(docs, width, seed), "simhash")
    nodes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = connected_components(links(nodes, most, parts)).withColumnRenamed("node", "fp")
    nodes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    nodes = materialize(nodes, "simhash-roots")
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = nodes.join(least, "root").select("fp", "component_id")
    return own.join(classes, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, **settings) -> DataFrame:
    """One row of docs for every near-duplicate class, with all its columns: the row whose doc_id is the class's component_id.

    Where rows of that doc_id hold different texts, or a class has null ids alone, or a row is repeated, the fingerprint decides as well, and one row (least text) stays. Null and blank texts are one class. Long texts are read whole. Extra columns stay, whatever their names. Empty table: no rows.
    """
    found = near_duplicates(docs, **settings)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("fp", F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    kept = materialize(kept, "simhash-kept")
    ids = materialize(found.select("doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id"), "simhash-repeated")  # ids that don't name one row
    row = struct_of(docs)
    single = kept.where("n = 1 and id is not null").join(ids, F.col("id") == F.col("doc_id"), "left_anti").select("id")
    docs_id = F.col("row.doc_id").cast("long")
    out = row.join(single.hint("merge"), docs_id == F.col("id"), "left_semi")  # the ids grow with the texts: the same plan at every size
    if ids.isEmpty():
        return out.select("row.*")
    from pyspark.sql.types import LongType, StructField, StructType

    def add(batches):
        for b in batches:
            texts = b.column(0).field(b.schema.field("row").type.get_field_index("text")).cast(pa.binary()).to_pylist()
            yield b.append_column("own_fp", pa.array(np.array([fingerprint(t, settings.get("width", 3), settings.get("seed", 42)) for t in texts], np.uint64).view(np.int64)))

    many = row.join(ids, docs_id.eqNullSafe(ids["doc_id"]), "left_semi")
    many = bounded_batches(many).mapInArrow(add, StructType([*many.schema.fields, StructField("own_fp", LongType())]))
    many = many.join(kept, (F.col("own_fp") == F.col("fp")) & docs_id.eqNullSafe(F.col("id")), "left_semi")
    one = many.groupBy("own_fp").agg(F.min_by("row", F.coalesce(F.col("row.text").cast("string"), F.lit(""))).alias("row"))  # partial minima first: a class may hold any share of the rows
    return out.unionByName(one.select("row")).select("row.*")
