"""op13 against plain loops over every feature of every whole text."""

import hashlib
import math
import random
import re
import zlib

import pytest

from tracewright.llm import importance, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_features(text):
    w = WORD.findall((text or "").encode().lower())
    return len(w), [zlib.crc32(b" ".join(w[k : k + n])) % 10000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def slow_resample(docs, target):
    of = [slow_features(t) for _, t in docs]
    s, t = [0] * 10000, [0] * 10000
    for _, f in of:
        for b in f:
            s[b] += 1
    for text in target:
        for b in slow_features(text)[1]:
            t[b] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for (i, _), (n, f) in zip(docs, of, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: 5 * len(fit) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in rows]


def key(r):
    return tuple(map(str, r))


def edge(seed=3):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["Alpha", "beta", "gÄmma", "x", "y2", "é", "W" * 70, "漢字"])
    line = lambda n: rnd.choice([" ", ", ", "\t"]).join(word() for _ in range(n))
    texts = ["\n".join(line(rnd.choice([0, 1, 1, 2, 3, 9])) for _ in range(rnd.randint(0, 12))) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(1000, None), (1001, ""), (1002, "\n\n \n"), (1003, "one\ntwo\nthree"), (1004, "a\r\nb\r\n\r\nc d"), (5, texts[5]), (5, texts[5]), (5, texts[6]), (None, texts[7]), (None, texts[7]), (None, None), (None, None)]
    rows += [(2000, "Same line here\n" * 3000), (2001, "w" * 300_000 + " tail"), (2002, "no end of words " * 50_000)] + [(3000 + k, "Same line here\nother\n" + texts[k]) for k in range(100)]
    return rows


def test_hashes_are_crcs():
    words = [b"a", b"bc", b"x" * 33, b"y" * 64, b"z" * 200, "é".encode(), b"q" * 70_000, b"0"]
    low, start, size = importance.cut(b"-".join(words))
    one = importance.word_crcs(low, start, size)
    assert one.tolist() == [zlib.crc32(w) for w in words]
    assert importance.followed(one[:-1], one[1:], size[1:]).tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:], strict=False)]


@pytest.mark.parametrize("seed", [3, 4])
def test_resample(spark, seed):
    rows = edge(seed)
    target = ["alpha beta gÄmma\nx y2", None, "", "x x x x"]
    docs = spark.createDataFrame([(*r, 1, 2, 3, "l", 1) for r in rows], "doc_id int, text string, weight long, rows int, share long, line string, k1 long")
    got = [tuple(r) for r in importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()]
    assert sorted(got, key=key) == sorted(slow_resample(rows, target), key=key)


def test_empty(spark):
    docs = spark.createDataFrame([(k, t) for k, t in edge()], "doc_id long, text string")
    assert importance.resample(docs.limit(0), docs.select("text")).count() == 0
    got = [tuple(r) for r in importance.resample(docs, docs.select("text").limit(0)).collect()]
    assert sorted(got, key=key) == sorted(slow_resample(edge(), []), key=key)


def test_query(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    want = slow_resample([tuple(r) for r in read("documents").select("doc_id", "text").collect()], [r[0] for r in read("benchmark").select("text").collect()])
    got = [tuple(r) for r in queries.op13_line_resampling(spark, SF).collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and 0 < sum(r[4] is not None for r in got) < len(got)


def test_sql():
    import duckdb

    for t in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = slow_resample(duckdb.sql("SELECT doc_id, text FROM documents").fetchall(), [r[0] for r in duckdb.sql("SELECT text FROM benchmark").fetchall()])
    assert sorted(duckdb.sql(f"SELECT doc_id, n_features, weight, score, rank FROM ({importance.RESAMPLE_SQL})").fetchall(), key=key) == sorted(want, key=key)
