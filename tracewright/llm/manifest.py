"""A Merkle manifest of a corpus. Every node is labelled with the interval [lo, hi) of leaf ranks that it covers; ancestors and siblings come from the labels alone.

Leaves are ranked by (source, doc_id) over the whole corpus without a sort in one task. Each source is a tree of runs of 16; the tops of the sources, in turn, are the leaves of a tree of the same kind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick, ranked

FAN, BITS = 16, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "array<struct<before:binary,after:binary>>"


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _sha(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def _parent(digests: Column) -> Column:
    """Digest over the hex text of digests that stand one after the other as bytes."""
    return _sha(_hex(digests))


def _join_bytes(digests: Column) -> Column:
    return F.unhex(F.array_join(F.transform(digests, F.hex), ""))


def _field(c: Column) -> Column:
    b = c.cast("string").cast("binary")
    return F.when(c.isNull(), F.lit("-").cast("binary")).otherwise(F.concat(F.concat(F.octet_length(b).cast("string"), F.lit(":")).cast("binary"), b))


def leaf_digest(text: Column) -> Column:
    return _sha(F.concat(*(_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), _field(text)))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def every_fifth(doc_id: Column) -> Column:
    """Whether 5 divides the CRC-32 of the decimal doc_id; never for a null one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def leaf_table(docs: DataFrame, changed: Column | None = None, change=lower_ascii) -> DataFrame:
    """(doc_id, source, leaf, present): digest of every document, and of what is there now: where `changed` holds, its text is taken through `change`. Texts are read once."""
    docs = pick(docs, doc_id="long", source="string", lang="string", n_chars="long", text="string")
    leaf = leaf_digest(F.col("text"))
    present = F.when(changed, leaf_digest(change(F.col("text")))) if changed is not None else F.lit(None).cast("binary")
    return docs.select("doc_id", "source", leaf.alias("leaf"), present.alias("present")).withColumn("present", F.coalesce("present", "leaf"))


def label_leaves(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves with their label, sources). A leaf's label: lo (its rank), tree (rank of its source), pos and size (place in the source, leaves of the source). Sources: tree, lo, hi.

    Rows of one doc_id in a source are in order of their digests; null sources and ids come first.
    """
    rows, spans = ranked(leaves, [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("present")], "manifest-leaves")
    runs = rows.groupBy("source", "part").agg(F.min("place").alias("place"), F.count("*").alias("n"))
    runs = runs.join(spans, "part").select("source", "part", F.col("before"), (F.col("before") + F.col("place")).alias("lo"), "n")
    whole = runs.groupBy("source").agg(F.min("lo").alias("lo"), F.sum("n").alias("size"))
    sources, before = ranked(whole, [F.col("lo")], "manifest-sources")
    sources = materialize(sources.join(before, "part").select("source", (F.col("before") + F.col("place")).alias("tree"), F.col("lo").alias("first"), "size"), "manifest-trees")
    runs = runs.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), F.col("part").alias("_p"), "before", "tree", "first", "size")
    rows = rows.join(runs, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))
    labelled = rows.select("doc_id", "leaf", "present", "tree", (F.col("before") + F.col("place")).alias("lo"), (F.col("before") + F.col("place") - F.col("first")).alias("pos"), "size")
    return labelled, sources.select("tree", F.col("first").alias("lo"), (F.col("first") + F.col("size")).alias("hi"), "size")


def grow(units: DataFrame, height: int, name: str) -> list[DataFrame]:
    """Inner levels of all trees over units (tree, pos, size, lo, hi, digest), lowest first: nodes (tree, slot, size, top, lo, hi, digest, kids). A group is one node's 16 children at most."""
    levels, below = [], units.select("tree", F.col("pos").alias("slot"), "size", (F.col("size") == 1).alias("top"), "lo", "hi", "digest")
    for level in range(1, height + 1):
        kids = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest")))
        up = below.where("not top").groupBy("tree", F.shiftright("slot", BITS).alias("slot"), "size").agg(kids.alias("kids"))
        digest = _parent(_join_bytes(F.col("kids.digest")))
        up = up.select("tree", "slot", "size", (F.lit(FAN**level) >= F.col("size")).alias("top"), F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), digest.alias("digest"), "kids")
        below = materialize(up, f"{name}-{level}")
        levels.append(below)
    return levels


def _tops(units: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, lo, hi, digest) of the one node that remains of every tree."""
    nodes = [units.where("size = 1"), *(level.where("top") for level in levels)]
    return reduce(DataFrame.unionByName, [n.select("tree", "lo", "hi", "digest") for n in nodes])


def _siblings(kids: Column, lo: Column) -> Column:
    """The parent's interval without the node's own: what lies before it and after it."""
    before = F.filter(kids, lambda k: k["lo"] < lo)
    after = F.filter(kids, lambda k: k["lo"] > lo)
    return F.struct(_join_bytes(before["digest"]).alias("before"), _join_bytes(after["digest"]).alias("after"))


def attach(units: DataFrame, levels: list[DataFrame], anchors: DataFrame) -> DataFrame:
    """units (tree, pos, size, lo, ...) with `path`: the siblings at every level from the unit to the top of its tree, then its tree's `above`; and the anchors' other columns.

    From the top down each level meets the one above in a join on the parent's bucket, kept if the parent's interval contains the node's. So the long paths are attached to few nodes, and units only to their own parents.
    """
    extra = [c for c in anchors.columns if c not in ("tree", "above")]

    def meet(nodes: DataFrame, parents: DataFrame | None, slot: str, top: Column) -> DataFrame:
        own = nodes.where(top).join(anchors, "tree").withColumnRenamed("above", "path")
        if parents is None:
            return own
        p = parents.select(F.col("tree").alias("_t"), F.col("slot").alias("_slot"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("kids").alias("_kids"), F.col("path").alias("_path"), *extra)
        held = nodes.where(~top).join(p, (F.col("tree") == F.col("_t")) & (F.shiftright(slot, BITS) == F.col("_slot")) & (F.col("lo") >= F.col("_lo")) & (F.col("lo") < F.col("_hi")))
        path = F.concat(F.array(_siblings(F.col("_kids"), F.col("lo"))), F.col("_path"))
        return held.withColumn("path", path).select(own.columns).unionByName(own)

    above = None
    for level in reversed(levels):
        above = meet(level, above, "slot", F.col("top"))
    return meet(units, above, "pos", F.col("size") == 1)


def height(size: int) -> int:
    """Levels above `size` leaves."""
    levels = 0
    while size > 1:
        size, levels = -(-size // FAN), levels + 1
    return levels


def build_manifest(leaves: DataFrame) -> dict:
    """The manifest of a leaf table: labelled leaves, sources, the levels of the sources' trees and of the tree over them, subroots and root."""
    labelled, sources = label_leaves(materialize(leaves, "leaf-digests"))
    labelled = materialize(labelled, "manifest-labels")
    widest = sources.agg(F.max("size"), F.count("*")).first()
    units = labelled.select("tree", "pos", "size", "lo", (F.col("lo") + 1).alias("hi"), F.col("leaf").alias("digest"))
    levels = grow(units, height(widest[0] or 0), "manifest-level")
    subroots = materialize(_tops(units, levels), "manifest-subroots")
    over = subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(widest[1]).cast("long").alias("size"), "lo", "hi", "digest")
    upper = grow(over, height(widest[1]), "manifest-upper")
    return {"leaves": labelled, "sources": sources, "levels": levels, "upper": upper, "subroots": subroots, "over": over, "root": _tops(over, upper)}


def manifest_nodes(manifest: dict) -> DataFrame:
    """The manifest as a table: (tree: rank of the source, -1 over the sources; level, lo, hi, digest in hex)."""
    parts = [manifest["leaves"].select("tree", F.lit(0).alias("level"), "lo", (F.col("lo") + 1).alias("hi"), _hex(F.col("leaf")).alias("digest"))]
    for levels in (manifest["levels"], manifest["upper"]):
        parts += [n.select("tree", F.lit(k + 1).alias("level"), "lo", "hi", _hex(F.col("digest")).alias("digest")) for k, n in enumerate(levels)]
    return reduce(DataFrame.unionByName, parts)


def prove(manifest: dict) -> DataFrame:
    """Leaves with `path` (siblings from the leaf to the root), `subroot` and `root`."""
    root = manifest["root"].select(F.lit(-1).cast("long").alias("tree"), F.array().cast(STEP).alias("above"), F.col("digest").alias("root"))
    over = attach(manifest["over"], manifest["upper"], root)
    anchors = over.select(F.col("pos").alias("tree"), F.col("path").alias("above"), F.col("digest").alias("subroot"), "root")
    return attach(manifest["leaves"], manifest["levels"], materialize(anchors, "manifest-anchors"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, s: _parent(F.concat(s["before"], acc, s["after"])))


def audit_documents(docs: DataFrame, changed: Column | None = None, change=lower_ascii) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256 (of all siblings from leaf to root), folded_root (from what is there now), verified.

    docs: doc_id, source, lang, n_chars, text; other columns are not read. Null in any of them: the field `-`; null source: a source of its own, before all others. Empty and long texts are leaves like any other. Null doc_id: first in its source. Rows of one doc_id are leaves of their own, in order of their digests; equal rows get equal leaves but their own proofs. Empty table: no rows.
    """
    proved = prove(build_manifest(leaf_table(docs, changed, change)))
    siblings = F.array_join(F.flatten(F.transform("path", lambda s: F.array(_hex(s["before"]), _hex(s["after"])))), "")
    out = proved.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.col("present"), F.col("path")).alias("folded"))
    return out.select("doc_id", *(_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")), "proof_sha256", _hex(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


#: Runs of 16 as lists per source; siblings are slices without the own element. CRC-32 is folded bit by bit over the decimal doc_id.
MANIFEST_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text,
    CASE WHEN text IS NULL THEN NULL ELSE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS low,
    list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda c: [ascii(c)::BIGINT + 1, 0, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, x: CASE WHEN x > 0 THEN xor(a, x - 1) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS crc
  FROM documents),
e AS (SELECT doc_id, source, crc,
    concat_ws('', coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'), coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-')) AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS body, coalesce(octet_length(encode(low)) || ':' || low, '-') AS low_body
  FROM d),
l AS (SELECT doc_id, source, sha256(head || body) AS leaf, CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN sha256(head || low_body) ELSE sha256(head || body) END AS present,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256(head || body)) - 1 AS pos
  FROM e),
up(source, level, nodes) AS (
  SELECT source, 0, list(leaf ORDER BY pos) FROM l GROUP BY source
  UNION ALL
  SELECT source, level + 1, list_transform(range(0, (len(nodes) + 15) // 16), lambda i: sha256(array_to_string(nodes[i * 16 + 1 : i * 16 + 16], ''))) FROM up WHERE len(nodes) > 1),
trees AS (SELECT source, list(nodes ORDER BY level) AS levels FROM up GROUP BY source),
subs AS (SELECT source, levels, levels[-1][1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spot FROM trees),
over_up(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY spot) FROM subs
  UNION ALL
  SELECT level + 1, list_transform(range(0, (len(nodes) + 15) // 16), lambda i: sha256(array_to_string(nodes[i * 16 + 1 : i * 16 + 16], ''))) FROM over_up WHERE len(nodes) > 1),
top AS (SELECT list(nodes ORDER BY level) AS levels FROM over_up),
steps AS (
  SELECT l.doc_id, l.leaf, l.present, s.subroot, top.levels[-1][1] AS root,
    list_concat(
      list_transform(range(0, len(s.levels) - 1), lambda k: {'level': s.levels[k + 1], 'at': l.pos // (16 ** k)::BIGINT}),
      list_transform(range(0, len(top.levels) - 1), lambda k: {'level': top.levels[k + 1], 'at': s.spot // (16 ** k)::BIGINT})) AS walk
  FROM l JOIN subs s ON l.source IS NOT DISTINCT FROM s.source CROSS JOIN top),
path AS (
  SELECT doc_id, leaf, present, subroot, root, list_transform(walk, lambda w: {
    'a': array_to_string(w.level[(w.at // 16) * 16 + 1 : w.at], ''), 'b': array_to_string(w.level[w.at + 2 : (w.at // 16) * 16 + 16], '')}) AS sides
  FROM steps)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(sides, lambda s: s.a || s.b), '')) AS proof_sha256,
  list_reduce(list_prepend({'a': present, 'b': ''}, sides), lambda acc, s: {'a': sha256(s.a || acc.a || s.b), 'b': ''}).a AS folded_root,
  list_reduce(list_prepend({'a': present, 'b': ''}, sides), lambda acc, s: {'a': sha256(s.a || acc.a || s.b), 'b': ''}).a = root AS verified
FROM path
"""
