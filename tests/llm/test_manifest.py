"""op11 against a recursive tree over lists, on edge rows and on a corpus of several levels."""

import hashlib
import zlib

import duckdb
import pytest

from tracewright.llm import manifest, queries

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, part long, place int, path string, tree long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def slow_leaf(i, source, lang, n, text):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(map(field, (i, source, lang, n, text))))


def slow_tree(nodes):
    """(top, siblings before and after each leaf, level by level)."""
    paths = [[] for _ in nodes]
    under = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for k in range(len(run)):
                for leaf in under[a + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha("".join(run)))
            held.append([leaf for k in range(len(run)) for leaf in under[a + k]])
        nodes, under = up, held
    return nodes[0], paths


def slow_audit(rows, tamper=lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0):
    low = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted(((r[0] is not None, r[0] or 0, slow_leaf(*r)), r) for r in rows if r[1] == s)
        trees.append((own, *slow_tree([o[0][2] for o in own])))
    root, over = slow_tree([t[1] for t in trees])
    out = []
    for (own, subroot, paths), up in zip(trees, over, strict=True):
        for (key, r), path in zip(own, paths, strict=True):
            path = path + up
            node = slow_leaf(*r[:4], low(r[4])) if tamper(r[0]) else key[2]
            for a, b in path:
                node = sha(a + node + b)
            out.append((r[0], key[2], subroot, root, sha("".join(a + b for a, b in path)), node, node == root))
    return out


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, 7, "p", 9) for r in rows], COLUMNS)


def key(r):
    return tuple(map(str, r))


EDGE = [(1, None, "en", 3, "Abc"), (2, "a", None, None, None), (3, "a", "en", 0, ""), (3, "a", "en", 0, ""), (None, "a", "en", 2, "AB"), (4, "é", "en", -5, "ÀB c"), (5, "b", "en", 10**12, "X " * 200_000), (-7, "", "en", 1, "Q"), (10**15, "a", "en", 1, "Zz")]


def many(n, sources):
    return [(k * 37 % (n * 3), f"s{k * k % sources}" if k % 11 else None, "en", k, f"Text {k} OF {k % 7}") for k in range(n)]


@pytest.mark.parametrize("rows", [EDGE, EDGE[:1], many(16, 1), many(17, 1), many(700, 3), many(900, 40)])
def test_audit(spark, rows):
    got = [tuple(r) for r in manifest.audit_documents(docs_of(spark, rows), manifest.every_fifth(manifest.F.col("doc_id"))).collect()]
    assert sorted(got, key=key) == sorted(slow_audit(rows), key=key)


def test_empty_and_unchanged(spark):
    assert manifest.audit_documents(docs_of(spark, EDGE).limit(0)).count() == 0
    assert all(r.verified for r in manifest.audit_documents(docs_of(spark, EDGE)).collect())


def test_labels_nest(spark):
    """Intervals of one level of a tree part its leaves without gaps; every node lies in one parent."""
    found = manifest.build_manifest(manifest.leaf_table(docs_of(spark, many(900, 3))))
    nodes = [tuple(r) for r in manifest.manifest_nodes(found).select("tree", "level", "lo", "hi").collect()]
    whole = {t: (lo, hi) for t, lo, hi in ((r[0], r[1], r[2]) for r in found["sources"].select("tree", "lo", "hi").collect())} | {-1: (0, 900)}
    for t, level in {(n[0], n[1]) for n in nodes}:
        own = sorted(n[2:] for n in nodes if n[:2] == (t, level))
        assert own[0][0] == whole[t][0] and own[-1][1] == whole[t][1] and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
        above = [n[2:] for n in nodes if n[:2] == (t, level + 1)]
        assert not above or all(sum(a <= lo and hi <= b for a, b in above) == 1 for lo, hi in own)


def test_query_against_both(spark):
    got = sorted((tuple(r) for r in queries.op11_merkle_manifest(spark, SF).collect()), key=key)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert got == sorted(slow_audit(rows), key=key) and 0 < sum(not r[6] for r in got) < len(got) / 2
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got == sorted(duckdb.sql(f"SELECT {', '.join(names)} FROM ({manifest.MANIFEST_SQL})").fetchall(), key=key)
