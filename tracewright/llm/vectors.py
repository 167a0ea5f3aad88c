"""Embedding near-duplicates: subspace pigeonhole join.

Vectors of length 1 with cosine >= c are within squared distance 2 (1 - c). A fixed random rotation spreads that over all coordinates; they are split into blocks, and each block gets its share of the squared distance in proportion to its width. If two vectors link, they are within the share of at least one block. So each block is range-joined alone, and the union of what that finds is verified with exact cosines.
The range join of a block is exact: tiles of vectors meet every tile, and all distances of a block come from products of matrices. So no link is lost; on vectors without structure no grid can leave out cells without losing some.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, pick

_spaces: dict[tuple, Space] = {}  # noqa: F821
#: Distances are compared in single precision; what this adds to a share is above their error, so that verification sees every pair.
SLACK = 1e-4
#: Rows and columns whose distances are held at a time.
PART = (1024, 2048)


class Space:
    """Rotation and blocks for one number of dimensions; the same in every task."""

    def __init__(self, dim: int, cosine: float, blocks: int):
        self.rotation = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))[0]
        self.blocks = [b for b in np.array_split(np.arange(dim), min(blocks, dim)) if len(b)]
        self.share = [2 * (1 - cosine) * len(b) / dim for b in self.blocks]

    def units(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        x = x / np.abs(x).max(axis=1)[:, None]  # squares of very large or small components stay finite
        return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]

    def sides(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per block two matrices; a row of one times a row of the other is the squared distance in the block."""
        z = x @ self.rotation
        out = []
        for b in self.blocks:
            zb = z[:, b]
            n, one = (zb * zb).sum(axis=1)[:, None], np.ones((len(zb), 1))
            out.append((np.hstack((-2 * zb, n, one)).astype(np.float32), np.hstack((zb, one, n)).astype(np.float32)))
        return out


def space(dim: int, *settings) -> Space:
    if (dim, *settings) not in _spaces:
        _spaces[dim, *settings] = Space(dim, *settings)
    return _spaces[dim, *settings]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _verified(cosine: float, p: np.ndarray, q: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of p and of q with the cosine, among the pairs of a mask."""
    i, j = np.nonzero(near)
    if len(i) * 32 > near.size:  # many: all cosines at once, and those at the threshold again as below
        c = (p @ q.T)[i, j]
        keep = c >= cosine - 1e-9
        i, j, sure = i[keep], j[keep], c[keep] > cosine + 1e-9
    else:
        sure = np.zeros(len(i), bool)
    at = np.flatnonzero(~sure)
    for k in range(0, len(at), 65536):
        some = at[k : k + 65536]
        sure[some] = np.einsum("ij,ij->i", p[i[some]], q[j[some]]) >= cosine
    return i[sure], j[sure]


def _links_of(s: Space, cosine: float, ids: np.ndarray, copies: np.ndarray, own: np.ndarray, keys: np.ndarray, x: np.ndarray) -> tuple | None:
    """(id, links, root) from whole groups of rows; keys are (a, b), the two tiles that meet. Memory is that of the rows and of one part of their distances."""
    x = s.units(x)
    cut = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(ids)]))
    links, used, root = np.zeros(len(ids), np.int64), [], []
    for first, end in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        tile, (a, b) = own[first:end], keys[first].tolist()
        p, q = (first + np.flatnonzero(tile == t) for t in (a, b))
        sides_p, sides_q = ([side[k] for side in s.sides(x[rows])] for k, rows in ((0, p), (1, q)))
        u, v = [], []
        for i0 in range(0, len(p), PART[0]):
            for j0 in range(i0 // PART[1] * PART[1] if a == b else 0, len(q), PART[1]):
                ip, jq = slice(i0, i0 + PART[0]), slice(j0, j0 + PART[1])
                near = np.zeros((len(p[ip]), len(q[jq])), bool)
                for side_p, side_q, share in zip(sides_p, sides_q, s.share, strict=True):
                    near |= side_p[ip] @ side_q[jq].T <= share + SLACK
                if a == b:
                    near &= np.arange(i0, i0 + near.shape[0])[:, None] < np.arange(j0, j0 + near.shape[1])
                i, j = _verified(cosine, x[p[ip]], x[q[jq]], near)
                if len(i):
                    i, j = p[ip][i], q[jq][j]
                    links += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
                    rows, place = np.unique(np.concatenate((i, j)), return_inverse=True)
                    u.append(rows)  # of many pairs only what spans them is kept
                    v.append(rows[_labels(len(rows), place[: len(i)], place[len(i) :])])
        if u:
            rows, place = np.unique(np.concatenate(u + v), return_inverse=True)
            used.append(rows)
            half = len(place) // 2
            root.append(rows[_labels(len(rows), place[:half], place[half:])])
    if not used:
        return None
    # a row of a tile stands in one group for each tile that it meets
    rows = np.concatenate(used)
    return ids[rows], links[rows], ids[np.concatenate(root)]


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link_vectors(rows: DataFrame, cosine: float = 0.9, blocks: int = 4, chunk: int = 4096) -> tuple[DataFrame, DataFrame]:
    """rows (id, copies, x: equal-length finite non-zero vectors of one or more lengths) -> (id, links: copies of all linked ids), and edges (u, v) that span the components of the links.

    Rows are dealt out by hash to tiles of about `chunk` rows. Each pair of tiles is a task group of its own, so a pair of rows meets once, in one task, and no group holds more than about two tiles. Compared pairs grow with the square of the rows, and every row is sent to all tiles.
    """
    tiles = max(1, -(-rows.count() // chunk))
    settings = (cosine, blocks)
    met = rows.select("id", "copies", "x", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int").alias("c")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    met = met.select("id", "copies", "x", "c", F.least("c", "other").alias("a"), F.greatest("c", "other").alias("b"))
    groups = met.repartition("a", "b").sortWithinPartitions("a", "b", "id")

    def run(batches):
        held: list[tuple] = []

        def whole(parts):
            for dim in sorted({p[4].shape[1] for p in parts}):
                got = [np.concatenate([p[k] for p in parts if p[4].shape[1] == dim]) for k in range(5)]
                if found := _links_of(space(dim, *settings), cosine, *got):
                    yield pa.record_batch([pa.array(f) for f in found], names=["id", "links", "root"])

        for b in batches:
            if not b.num_rows:
                continue
            col = [b.column(n).to_numpy(zero_copy_only=False) for n in ("id", "copies", "c")]
            keys = np.stack([b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("a", "b")], axis=1)
            x = b.column("x")
            dims = np.diff(x.offsets.to_numpy())
            turns = np.concatenate(([0], np.flatnonzero(dims[1:] != dims[:-1]) + 1, [len(dims)])).tolist()
            parts = [(*(c[s:e] for c in col), keys[s:e], _matrix(x.slice(s, e - s))) for s, e in zip(turns[:-1], turns[1:], strict=True)]
            open_ = (keys != keys[-1]).any(axis=1)
            last = int(np.flatnonzero(open_)[-1]) + 1 if open_.any() else 0
            if held and (last or (held[-1][3][-1] != keys[-1]).any()):
                split = [(tuple(v[: max(0, last - s)] for v in p), tuple(v[max(0, last - s) :] for v in p)) for s, p in zip(turns[:-1], parts, strict=True)]
                yield from whole(held + [h for h, _ in split if len(h[0])])
                held = [t for _, t in split if len(t[0])]
            elif held:
                held += parts
            else:
                split = [(tuple(v[: max(0, last - s)] for v in p), tuple(v[max(0, last - s) :] for v in p)) for s, p in zip(turns[:-1], parts, strict=True)]
                yield from whole([h for h, _ in split if len(h[0])])
                held = [t for _, t in split if len(t[0])]
        if held:
            yield from whole(held)

    found = materialize(groups.mapInArrow(run, "id long, links long, root long"), "vector-links")
    return found.groupBy("id").agg(F.sum("links").alias("links")), found.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v"))


def near_vectors(vectors: DataFrame, cosine: float = 0.9, **settings) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, n_links, component_id, kept, one row per row.

    Equal vectors are one class from the start. A vector that is null, empty or zero, or holds null or non-finite components, links with nothing: its component is its own vec_id. Vectors of different lengths never link. Repeated rows, and rows with a null vec_id, are members and links of their own (component_id is the smallest vec_id that isn't null; kept is false for a null vec_id). Other columns are not read. Empty table: no rows.
    """
    v = pick(vectors, vec_id="long", embedding="array<float>")
    fine = F.coalesce((F.size("embedding") > 0) & ~F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("embedding", lambda e: e != 0), F.lit(False))
    v = materialize(v.select("vec_id", F.when(fine, F.transform("embedding", lambda e: F.when(e == 0, F.lit(0.0).cast("float")).otherwise(e))).alias("x")), "vectors")
    good = v.where("x is not null")
    classes = good.groupBy("x").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")  # written once, so an id is a vector's own and never changes
    links, edges = link_vectors(classes, cosine, **settings)
    roots = connected_components(edges).withColumnRenamed("node", "id")
    named = classes.select("id", "least", "copies").join(links, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = materialize(named, "vector-roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    own = good.join(classes.select("x", "id"), "x").select("vec_id", "id").join(named, "id").select("vec_id", "n_links", "component_id")
    none = v.where("x is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.unionByName(none).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
