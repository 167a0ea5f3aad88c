"""Every operator against a brute-force version, an exact round trip or held-out accuracy, and on edge rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tracewright.llm import chat, decontam, licenses, mixing, quality, secrets, simhash, tokens, vectors, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, fp long, h long, x string, score double, end long, least long, whole int, seq string"


def edge_docs(spark, more=()):
    """Null, empty, blank and very long texts, repeated rows, null ids and sources, and columns with clashing names."""
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    a = prose(40)
    rows = [(1, None, "s0"), (2, "", "s0"), (3, " \n\t ", None), (4, a, "s1"), (5, a, "s1"), (5, a, "s1"), (None, prose(30), "s2"), (None, None, None), (6, prose(60_000), "s1"), (7, a.upper(), "s2"), (8, "one", "s0"), *more]
    return spark.createDataFrame([(i, t, "en", s, 0, 1, 1.0, 1, 1, "x", 0.5, 1, 1, 1, "q") for i, t, s in rows], CLASHING)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --- 4 SimHash ---------------------------------------------------------------


def slow_fingerprint(text, width=3):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    shingles = [" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))


def components(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_fingerprints_are_exact():
    for t in (None, "", " ", "One", "A b", "Ünï code\x0bwords and MORE words", "x " * 100, "é è à"):
        assert simhash.fingerprint(None if t is None else t.encode()) == slow_fingerprint(t)


def test_simhash_edges(spark):
    got = rows_of(simhash.near_duplicates(edge_docs(spark)))
    by = {}
    for i, _, f, c in got:
        by.setdefault(i, []).append((f, c))
    assert len(got) == 11 and by[1] == by[2] == [("0" * 16, 1)] and by[3] == [("0" * 16, 1)]
    assert {c for _, c in by[4] + by[5] + by[7]} == {4} and len(by[5]) == 2
    assert sorted(c is None for _, c in by[None]) == [False, True] or all(c in (1, None) for _, c in by[None])
    assert simhash.near_duplicates(edge_docs(spark).limit(0)).count() == 0


def test_links_find_every_pair(spark):
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 2**64, 30, np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rnd.choice(12, rnd.integers(0, 4), replace=False)) for b in base for _ in range(40)]
    fps = sorted({np.uint64(x).view(np.int64).item() for x in [*near, *base.tolist()]})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {tuple(r) for r in rows_of(simhash.links(nodes))}
    assert all({tuple(r) for r in rows_of(simhash.links(nodes, parts=p))} == got for p in ((2,), (3,), (4,)))
    assert len(simhash.cheapest_partitions(nodes, 2, float(len(fps)), (3, 2))[0]) == 3 and len(simhash.cheapest_partitions(nodes, 2, 1e13, (3, 2))[0]) == 2
    u = np.array(fps).view(np.uint64)
    want = {(fps[i], fps[j]) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin(int(u[i] ^ u[j])).count("1") <= 2}
    assert got == want and len(want) > 100


def test_thresholds_satisfy_the_principle():
    fps = np.random.default_rng(2).integers(-(2**63), 2**63, 500)
    groups = [list(range(0, 22)), list(range(22, 43)), list(range(43, 64))]
    shares = [np.full((256, 3), 0.01 * (k + 1)) for k in range(9)]
    t, cost = simhash.allocate(fps, groups, shares, 1e6, 2)
    assert (cost > 0).all()
    assert (t >= -1).all() and ((t + 1).sum(axis=1) == 3).all()


def test_components_on_a_long_chain(spark):
    from tracewright.llm.common import connected_components

    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 200)] + [(500, 400), (400, 400), (None, 3)], "u long, v long")
    got = dict(rows_of(connected_components(edges)))
    assert all(got[k] == 1 for k in range(1, 201)) and got[500] == 400


def test_representatives_keep_one(spark):
    docs = edge_docs(spark)
    kept = rows_of(simhash.keep_representatives(docs).select("doc_id", "text"))
    fps = [slow_fingerprint(t) for _, t in kept]
    assert len(fps) == len(set(fps)) and {slow_fingerprint(t) for _, t in rows_of(docs.select("doc_id", "text"))} == set(fps)


def test_representatives_of_repeated_ids(spark):
    long = lambda c: " ".join(f"{c}{k}" for k in range(30))
    rows = [(1, long("a"), "x"), (5, long("b"), "y"), (5, long("a"), "z"), (7, long("c"), "u"), (7, long("c"), "v"), (None, long("d"), "w"), (None, long("a"), "q")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id int, text string, tag string, fp int, _kept int, place int")
    kept = sorted((str(r[0]), r[1], r[2] in "uv") for r in rows_of(simhash.keep_representatives(docs)))
    assert kept == sorted([("1", long("a"), False), ("5", long("b"), False), ("7", long("c"), True), ("None", long("d"), False)])
    assert simhash.keep_representatives(docs).columns == docs.columns and simhash.keep_representatives(docs.limit(0)).count() == 0


# --- 5 mixing ----------------------------------------------------------------


def test_mixing_meets_targets(spark):
    rnd = random.Random(5)
    more = [(k, "w " * rnd.randint(0, 300), f"s{rnd.choice('0000123')}") for k in range(100, 900)]
    got = rows_of(mixing.mix_to_targets(edge_docs(spark, more)).select("source", "size", "source_size", "target", "taken"))
    assert len(got) == 811
    for source in {g[0] for g in got}:
        own = [g for g in got if g[0] == source]
        size, target, taken = sum(g[1] for g in own), own[0][3], sum(g[4] for g in own)
        assert own[0][2] == size and target <= 2 * size + 1e-6 and all(g[4] <= 2 * g[1] for g in own)
        assert abs(taken - target) <= max(g[1] for g in own) / 2 + 1e-6 or size == 0
    total = sum(g[1] for g in got)
    assert abs(sum({g[0]: g[3] for g in got}.values()) - 1.5 * total) < 1e-3
    assert mixing.mix_to_targets(edge_docs(spark).limit(0)).count() == 0


def test_mix_is_taken_by_rows(spark):
    docs = edge_docs(spark)
    repeats = sum(r[0] for r in rows_of(mixing.mix_to_targets(docs).select("repeats")))
    taken = mixing.take_mix(docs)
    assert taken.count() == repeats and taken.columns == docs.columns


# --- 6 vectors ---------------------------------------------------------------


def test_vectors_against_brute_force(spark):
    rnd = np.random.default_rng(6)
    base = rnd.normal(size=(40, 32))
    x = [base[k // 6] + rnd.normal(size=32) * 0.12 for k in range(240)] + [base[0]] * 30
    rows = [(k, [float(np.float32(v)) for v in r]) for k, r in enumerate(x)]
    m = np.array([r for _, r in rows], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.9
    want = components(len(rows), [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j])
    for chunk in (2048, 7):
        classes = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        got = {r[0]: r[1:] for r in rows_of(vectors.near_vectors(classes, chunk=chunk))}
        links = near.sum(axis=1) - 1
        found = sum(got[k][0] for k in range(len(rows)))
        assert found >= 0.98 * links.sum() and all(got[k][0] <= links[k] for k in range(len(rows)))
        assert sum(got[k][1] != want[k] for k in range(len(rows))) <= 5
        assert all(got[k][2] == (got[k][1] == k) for k in range(len(rows)))


def test_no_link_is_lost(spark):
    """Pairs just above and below the threshold, in tiles of every size; no grid has to find them."""
    rnd = np.random.default_rng(7)
    base = rnd.normal(size=(400, 64))
    side = rnd.normal(size=(400, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side -= (side * base).sum(axis=1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    c = np.where(np.arange(400) % 4 == 3, 0.8999, 0.9001)[:, None]
    x = np.concatenate((base, c * base + np.sqrt(1 - c * c) * side)).astype(np.float32)
    m = x.astype(float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.9
    want = components(800, [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j])
    assert near.sum() - 800 == 600
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    for chunk in (4096, 150):
        got = {r[0]: r[1:] for r in rows_of(vectors.near_vectors(df, chunk=chunk))}
        assert all(got[k] == (near[k].sum() - 1, want[k], want[k] == k) for k in range(800))


def test_dense_groups_in_parts(monkeypatch):
    """A group's distances are held in parts; parts full of pairs and sparse ones agree with all cosines."""
    rnd = np.random.default_rng(8)
    x = np.concatenate((rnd.normal(size=16) + rnd.normal(size=(60, 16)) * 0.3, rnd.normal(size=(70, 16)))).astype(np.float32)
    copies, own = rnd.integers(1, 4, 130), rnd.integers(0, 2, 130)
    m = x.astype(float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = (m @ m.T >= 0.9) & ~np.eye(130, dtype=bool)
    for part in ((1024, 2048), (7, 20)):
        monkeypatch.setattr(vectors, "PART", part)
        for keys, mask in (([0, 0], None), ([0, 1], own[:, None] != own)):
            tile = np.zeros(130, int) if mask is None else own
            used, links, root = vectors._links_of(vectors.space(16, 0.9, 4), 0.9, np.arange(130), copies, tile, np.tile(keys, (130, 1)), x)
            linked = near if mask is None else near & mask
            assert dict(zip(used.tolist(), links.tolist(), strict=True)) == {k: int(linked[k] @ copies) for k in range(130) if linked[k].any()}
            want = components(130, [(i, j) for i, j in zip(*np.nonzero(linked), strict=True) if i < j])
            assert all(want[k] == r for k, r in zip(used.tolist(), root.tolist(), strict=True))


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    v = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [1.0, inf]), (6, [1.0, None]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 3.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (10, [-0.0, 1.0]), (11, [0.0, 1.0])]
    df = spark.createDataFrame([(i, e, 0, 1) for i, e in v], "vec_id long, embedding array<float>, id int, copies int")
    got = {}
    for r in rows_of(vectors.near_vectors(df)):
        got.setdefault(r[0], []).append(r[1:])
    assert all(got[k] == [(0, k, True)] for k in range(1, 7))
    assert got[7] == [(2, 7, True)] and got[8] == [(2, 7, False)] and got[None] == [(2, 7, False)]
    assert got[9] == [(1, 9, True)] * 2 and got[11] == [(1, 10, False)]
    assert vectors.near_vectors(df.limit(0)).count() == 0


# --- 7 chat ------------------------------------------------------------------


def test_chat_round_trip(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    turns = [(1, 0, "user", "hi\\n<|"), (1, 1, "assistant", said), (1, 2, "user", None), (1, 3, "assistant", "b\\|\\\\"), (1, 4, "user", "tail"), (2, 0, "user", "alone"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, None, None, None), (None, 1, "assistant", "z"), (4, 0, "we\nird<|", said)]
    df = chat.probe_conversation(spark.createDataFrame([(*t, "e") for t in turns], "conv_id long, turn long, role string, text string, example string"))
    examples = chat.expand_examples(df)
    found = chat.digest_examples(examples).collect()
    got = {r["conv_id"]: r for r in found}
    assert sorted((r["n_turns"], r["loss_chars"]) for r in found if r["conv_id"] is None) == [(1, 0), (1, 1)]
    wrong = spark.createDataFrame([(1, 0, 1, True, "ab", 0, 0), (1, 1, 2, True, "xbc", 0, 0)], chat.EXAMPLE).coalesce(1)
    with pytest.raises(Exception, match="doesn't start with"):
        chat.digest_examples(wrong).collect()
    everything = turns + [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    for conv in {t[0] for t in everything} - {None}:
        own = [(t[2] or "", t[3] or "") for t in everything if t[0] == conv]
        g = got[conv]
        loss = "".join(t for r, t in own if r == "assistant")
        assert g["n_turns"] == len(own) and g["loss_chars"] == len(loss) and g["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
    for e in examples.collect():
        parsed = chat.parse(e["text"])
        assert len(parsed) == e["n_turns"]
        if e["trains"]:
            assert chat.unescape(e["text"][e["loss_start"] : e["loss_end"]]) == parsed[-1][1] and parsed[-1][0] == "assistant"
    assert chat.expand_examples(df.limit(0)).count() == 0


# --- 8 tokens ----------------------------------------------------------------


def test_tokens_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    docs = edge_docs(spark, [(9, "It's “quoted”, isn't it? É\x01 a.b,c", "s0")])
    order = sorted(rows_of(docs.select("doc_id", "text")), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for by_word in (True, False):
        shards, folder = tokens.write_tokens(docs, path, length=64, by_word=by_word)
        got = sorted(rows_of(tokens.read_tokens(shards, folder)), key=lambda r: r[1])
        at = 0
        for (i, text), g in zip(order, got, strict=True):
            ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
            assert g == (i, at, len(ids), zlib.crc32(ids.tobytes()))
            at += len(ids)
        first = shards.first()
        ids, seqs, index = tokens.open_shard(folder, first["shard"])
        assert seqs.schema.field("ids").type.list_size == 64 and len(ids) == first["n_tokens"] and index.num_rows == first["n_docs"]
    shards, folder = tokens.write_tokens(docs.limit(0), path)
    assert tokens.read_tokens(shards, folder).count() == 0


def test_added_tokens_as_by_the_plain_call(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["end <|endoftext|> next", "End <|ENDOFTEXT|> Next", "in<|startoftext|>side a.b", "<|startoftext|><|endoftext|>", "<|endoftext |> none", "plain words. End"]
    for by_word in (True, False):
        shards, folder = tokens.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, by_word=by_word)
        got = {r[0]: (r[2], r[3]) for r in rows_of(tokens.read_tokens(shards, folder))}
        for k, text in enumerate(texts):
            ids = t.encode(text, add_special_tokens=False).ids + [1]
            assert got[k] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), (by_word, text)
    assert t.encode(texts[0], add_special_tokens=False).ids == [806, 49407, 1131]


def test_texts_by_words_are_those_of_the_plain_call():
    import public_tokenizers

    t = tokens._tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    few, many = tokens.WordIds(t, np.uint16, most=50), tokens.WordIds(t, np.uint16)
    rnd = random.Random(8)
    bits = ["a", "B", "é", "É", "e\u0301", "'", "'s", "'LL", "1", "23", ".", ",", "...", "!?", "<", "|", ">", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "漢", "字", "한", "\u0338", "=", "-", "_", "ΣΑΣ", "İ", "ß", "ﬁ", "😀", "\x00", "\x1c", "\x01", "word", "Another", "x" * 40, "longcompoundwordofmanyletters", "\u200b", "\u0085", "ǅ", "٣", "\u037e", "\u0345"]
    for _ in range(100):
        texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(20)]
        for words in (few, many):
            for text, ids in zip(texts, words.texts([x.encode() for x in texts]), strict=True):
                assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, text
    assert few.texts([]) == [] and [len(i) for i in few.texts([b"", b" "])] == [0, 0]


def test_by_word_refuses_other_tokenizers():
    import public_tokenizers

    with pytest.raises(ValueError):
        tokens.WordIds(tokens._tokenizer(public_tokenizers.path("byte_bpe_50k.json")), np.uint16)


# --- 9 secrets ---------------------------------------------------------------


def slow_base(text):
    out = []
    for kind, p, least, group in (("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2), ("access", r"AKIA[A-Z0-9]+", 16, 0), ("hex", r"[0-9a-f]+", 32, 0)):
        for m in re.finditer(p, text, re.I | re.A if kind == "assign" else 0):
            if len(m.group(group)) >= least:
                out.append((m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def test_base_spans_match_brute_force():
    rnd = random.Random(9)
    bits = ["password", "PassWD", "token", "secret", "api_key", "apikey", "paſſword", "=", ":", " ", '"', "'", "abc", "0123456789abcdef", "AKIA", "ABCDEF123", "é", "/x+", "deadbeef" * 4, "\n"]
    for _ in range(3000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))
        found = secrets.scan_text(t)
        assert found[4] == hashlib.sha256(slow_base(t).encode()).hexdigest(), t
        assert set(filter(None, slow_base(t).split(","))) <= set(found[5].split(","))


def test_named_literals_and_constants():
    spans = lambda t: {t[a:b] for a, b, _ in secrets.named_spans(t)}
    assert spans('db = "Xk29dkLq0z"\nsigning_key_secret = db') == {"Xk29dkLq0z"}
    assert spans("client_secret: 'aB3dE5gH7'") == {"aB3dE5gH7"}
    assert spans('<apiKey>a8f7d6s5d4</apiKey>') == {"a8f7d6s5d4"}
    assert spans('token_name = "a8f7d6s5d4"') == set() and spans('password = "changeme"') == set() and spans("colour: a8f7d6s5d4") == set()
    assert spans('A = "kd83"\nB = A + "9fKLs2"\npassword = B') == {"kd83", "9fKLs2"}
    assert spans('A = "k8"\nB = A + "9fKLs2"\npassword = B') == {"k8", "9fKLs2"}
    many = "\n".join(f'p{k} = "a{k}Zq"' for k in range(100)) + "\nx = " + " + ".join(f"p{k}" for k in range(100))
    assert spans(many + "\npassword = x") == {f"a{k}Zq" for k in range(100)}
    assert spans('a = "Xk29dkLq0z"\n' + "a = a + a\n" * 300 + "password = a") == {"Xk29dkLq0z"}


def slow_literal_score(value):
    if len(value) < 8 or any(c.isspace() for c in value) or secrets.PLACEHOLDER.match(value):
        return 0.0
    shares = [value.count(c) / len(value) for c in set(value)]
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, -sum(p * np.log2(p) for p in shares) / 4.0) * (0.5 + 0.25 * min(2, kinds - 1))


def slow_named(text):
    """Constants written out in full, on lines name = piece + piece."""
    known, out = {}, set()
    for m in re.finditer(r"(?m)^(\w+) = (.*)$", text):
        leaves = []
        for piece in re.finditer(r'"([^"\n]*)"|(\w+)', m[2]):
            if piece[2] is None:
                leaves.append((m.start(2) + piece.start(1), m.start(2) + piece.end(1), piece[1]))
            else:
                leaves += known.get(piece[2], [(m.start(2) + piece.start(), m.start(2) + piece.end(), piece[2])])
        known[m[1]] = leaves
        score, weight = slow_literal_score("".join(v for _, _, v in leaves)), secrets.name_score(m[1])
        if weight and score >= 0.5 and weight + score > 1.0:
            out |= {(a, e, "named") for a, e, v in leaves if v}
    return sorted(out)


def test_named_spans_match_brute_force():
    rnd = random.Random(12)
    names = ["a", "b", "c", "password", "db_secret", "token_name", "auth_key", "colour"]
    pieces = ['"Xk29dkLq0z"', '"kd83"', '"changeme"', '"xxxxxxxxxxxx"', '"<tag"', '"end>"', '"${v"', '"two words"', '""', "Zx81kqLm"]
    for _ in range(1500):
        text = "\n".join(f"{rnd.choice(names)} = " + " + ".join(rnd.choice(pieces + names[:3]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 8)))
        assert secrets.named_spans(text) == slow_named(text), text
    for _ in range(3000):
        value = "".join(rnd.choice(["x", "X", "*", ".", "<", ">", "${", "%(", "{{", "example", "your_", "A", "b", "9", "é", "xxxxxxxx", "-"]) for _ in range(rnd.randint(0, 12))) * rnd.choice((1, 1, 5))
        cut = rnd.randint(0, len(value))
        chain = secrets.Value(0, 0, "", (secrets.Value(0, 1, value[:cut]), secrets.Value(1, 2, value[cut:])))
        assert abs(slow_literal_score(value) - secrets.literal_score(value)) < 1e-9 and abs(slow_literal_score(value) - chain.score()) < 1e-9, value


def test_secret_edges(spark):
    got = rows_of(secrets.scan_secrets(edge_docs(spark, [(20, "é password=abcdefgh12", "s0")])))
    assert len(got) == 12 and {r[1] for r in got if r[0] != 20} == {0}
    assert next(r for r in got if r[0] == 20)[6].startswith("assign:2:")
    assert secrets.scan_secrets(edge_docs(spark).limit(0)).count() == 0


# --- 10 decontamination ------------------------------------------------------


def slow_edits(item, doc):
    """Least edits between item and any stretch of doc."""
    row = [0] * (len(doc) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(doc, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != d)))
        row = new
    return min(row)


def test_align_is_exact():
    rnd = np.random.default_rng(10)
    for _ in range(300):
        item, doc = rnd.integers(1, 5, rnd.integers(1, 9)), rnd.integers(0, 5, rnd.integers(0, 20))
        edits, a, e = decontam.align(item, doc)
        assert edits == slow_edits(item.tolist(), doc.tolist())
        assert slow_edits(item.tolist(), doc[a:e].tolist()) == edits


def test_contamination_recall_and_precision(spark, monkeypatch):
    rnd = random.Random(4)
    voc = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 5))) for _ in range(400)] + ["the", "of"] * 60
    items = [(k, " ".join(rnd.choice(voc) for _ in range(rnd.randint(8, 50)))) for k in range(30)] + [(98, "short one"), (99, None), (100, "")]
    docs, planted = [], set()
    for d in range(300):
        words = [rnd.choice(voc) for _ in range(rnd.randint(0, 150))]
        if d % 3 == 0:
            k = rnd.randrange(30)
            w = items[k][1].split()
            for _ in range(int(len(w) * rnd.choice((0, 0.1, 0.2)))):
                w[rnd.randrange(len(w))] = rnd.choice(voc)
            at = rnd.randint(0, len(words))
            words[at:at] = w
        docs.append((d, " ".join(words).upper() if d % 2 else "\n".join(words)))
    for d, t in docs:
        for k, item in items[:30]:
            w = item.split()
            if slow_edits(w, t.lower().split()) <= int(0.2 * len(w) + 1e-9):
                planted.add((d, k))
    df, b = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(decontam.find_contamination(df, b))
    pairs = {(r[0], r[1]) for r in got}
    assert pairs == planted and len(planted) >= 90
    assert all(r[3] >= 0.8 for r in got)
    clean = {r[0] for r in rows_of(decontam.drop_contaminated(df, b).select("doc_id"))}
    assert clean == {d for d, _ in docs} - {p[0] for p in pairs}
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 7)
    assert {(r[0], r[1]) for r in rows_of(decontam.find_contamination(df, b))} == pairs
    assert {r[0] for r in rows_of(decontam.drop_contaminated(df, b).select("doc_id"))} == clean
    assert decontam.find_contamination(df.limit(0), b).count() == 0 and decontam.find_contamination(df, b.limit(0)).count() == 0
    assert decontam.find_contamination(edge_docs(spark), b).count() == 0


def test_long_and_short_items_are_all_found():
    rnd = random.Random(11)
    voc = [f"w{k}" for k in range(3000)]
    items = [[rnd.choice(voc) for _ in range(n)] for n in (5, 9, 20, 100, 150, 220, 300)]
    index = decontam.Index([(k, " ".join(w).encode()) for k, w in enumerate([*items, ["what", "is", "it"], []])], 0.8, 24, 3, 5)
    for kind in ("deletion", "insertion", "substitution", "mixed"):
        for k, item in enumerate(items):
            for _ in range(3):
                w, n = list(item), len(item) // 5
                for at in sorted(rnd.sample(range(len(item)), n), reverse=True):
                    how = rnd.choice(("deletion", "insertion", "substitution")) if kind == "mixed" else kind
                    w[at : at + (how != "insertion")] = [] if how == "deletion" else ["new"]
                text = [rnd.choice(voc) for _ in range(rnd.randint(0, 40))] + w + [rnd.choice(voc) for _ in range(rnd.randint(0, 40))]
                found = {(t, i): (edits, x, y) for t, i, edits, x, y in index.find([b"w1 w2", " ".join(text).encode(), b"w3"])}
                assert (1, k) in found and found[1, k][0] <= n, (kind, len(item))
                edits, x, y = found[1, k]
                assert slow_edits(item, text[x:y]) == edits
    assert [(t, i, edits) for t, i, edits, _, _ in index.find([b"so What\nis it then", b"what is", b"it", b"what is that it", b"it what is"])] == [(0, 7, 0)]


# --- 1 licences, 3 WARC ------------------------------------------------------


def test_license_rules(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and so on. The above copyright notice and this permission notice shall be included in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
    texts = {30: "Intro.\nLicensed under the Apache License, Version 2.0.\nMore.", 31: mit, 32: mit.replace("The above", "Stop here. The above"), 33: "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."}
    got = {r[0]: r[1:] for r in rows_of(licenses.scan_licenses(edge_docs(spark, [(k, t, "s0") for k, t in texts.items()]))) if r[0] in texts}
    assert got[30][2] == "Apache-2.0" and got[31] == (3, "mit-permission,mit-notice,as-is", "MIT") and got[33][2] == "GPL-3.0,CC-BY-NC-4.0"
    assert got[32][2] == "" and got[32][0] == 3
    assert licenses.scan_licenses(edge_docs(spark)).count() == 11


MIT_FILE = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY."""
GPL_HEADER = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD_FILE = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES ARE DISCLAIMED."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""


def test_wrapped_license_texts(spark):
    slashes = lambda t: "\n".join(f"// {x}".rstrip() for x in t.split("\n"))
    stars = lambda t: "/*\n" + "\n".join(f" * {x}".rstrip() for x in t.split("\n")) + "\n */"
    whole = {MIT_FILE: ("MIT", "mit-permission,mit-notice,as-is,no-liability"), GPL_HEADER: ("GPL-family", "gpl-free,gpl-no-warranty"), BSD_FILE: ("BSD-3-Clause", "bsd-redistribution,bsd-endorse,bsd-as-is"), APACHE_HEADER: ("Apache-2.0", "apache-2-grant,apache-2-comply,apache-2-copy,apache-2-basis")}
    cases = [(f(t), *want) for t, want in whole.items() for f in (str, slashes, stars, lambda t: t.replace("\n", "\r\n"))]
    cases += [("// Licensed under the MIT License.", "MIT", "mit-grant"), ("x\nLicensed under the MIT License\nCopyright me", "MIT", "mit-grant"), ("/* SPDX-License-Identifier: MIT */", "MIT", "spdx-mit"), ("Licensed under the Apache License, Version 2.0\nother words\nAll rights reserved", "Apache-2.0,proprietary", "apache-2-grant,reserved")]
    got = {r[0]: r for r in rows_of(licenses.scan_licenses(spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "doc_id long, text string")))}
    for k, (text, names, found) in enumerate(cases):
        assert (got[k][3], got[k][2]) == (names, found), text


def test_revisits(spark):
    from datetime import datetime

    t = lambda k: datetime(2024, 1, 1 + k // 24, k % 24)
    rows = [
        (1, "http://www.A.com/x/?utm_source=q&b=2&a=1#f", "response", t(0), 200, {"etag": '"1"', "content-type": "html", "cache-control": "old"}, "d1", "z"),
        (2, "https://a.com:443/x?a=1&b=2", "revisit", t(30), 304, {"etag": 'W/"1"', "content-type": "text", "cache-control": "new"}, None, "z"),
        (3, "https://a.com/x?a=1&b=2", "response", t(50), 200, {"etag": '"2"'}, "d2", "z"),
        (4, "https://a.com/x?a=1&b=2", "revisit", t(60), 304, {"etag": '"1"'}, "d2", "z"),
        (5, "https://a.com/x?a=1&b=2", "revisit", t(0), 304, None, None, "z"),
        (6, None, "revisit", t(70), 304, {}, None, "z"), (7, "https://a.com/x?a=1&b=2", "revisit", None, 304, {}, None, "z"), (8, "https://a.com/x?a=1&b=2", "revisit", t(49), 304, {}, "d1", "z"), (8, "https://a.com/x?a=1&b=2", "revisit", t(49), 304, {}, "d1", "z"), (9, "https://a.com/x?a=1&b=2", "response", t(49), 500, {}, "d9", "z"),
    ]
    df = spark.createDataFrame(rows, warc.RECORD + ", base_id string")
    got = sorted((r["record_id"], r["base_id"], r["verdict"], r["headers"]) for r in warc.resolve_revisits(df).collect())
    assert got[0] == (2, 1, "etag", {"etag": 'W/"1"', "content-type": "html", "cache-control": "new"})
    assert got[1] == (4, 3, "mismatch", {"etag": '"2"'}) and got[2][:3] == (5, 1, "unchecked")
    assert [g[:3] for g in got[3:]] == [(6, None, "not-found"), (7, None, "not-found"), (8, 1, "digest"), (8, 1, "digest")]
    assert warc.resolve_revisits(df.limit(0)).count() == 0
    assert rows_of(warc.parse_records(spark.createDataFrame([(1, None), (2, "junk")], "record_id long, record string")).select("record_id", "uri", "kind")) == [(1, None, None), (2, None, None)]


def test_records_as_servers_send_them(spark):
    head = "WARC/1.1\r\nWARC-Type: Response\r\nWARC-Target-URI: {}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n\r\n"
    body = "line\r\n\r\nline: two\n\nend\r\n"
    cookies = "HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nETag: x\r\nset-cookie: b=2:3\r\nno colon\r\n: empty\r\n\r\n"
    raw = [(1, head.format("http://a.com/") + cookies + body), (2, head.format("") + cookies + body), (3, head.format("u")), (4, ""), (5, (head.format("u") + cookies).replace("\r\n", "\n") + body)]
    got = {r["record_id"]: r for r in warc.parse_records(spark.createDataFrame([(*r, "x") for r in raw], "record_id long, record string, uri string")).collect()}
    assert got[1]["headers"] == {"set-cookie": "b=2:3", "etag": "x", "": "empty"} and got[1]["body"] == got[5]["body"] == body
    assert got[1]["kind"] == "response" and got[1]["status"] == 200 and got[5]["headers"] == got[1]["headers"] and got[1]["uri"] == "http://a.com/"
    assert got[2]["uri"] is None and got[3]["body"] is None and got[3]["status"] is None and got[4]["kind"] is None
    pages = spark.createDataFrame([(k, None if k % 2 else "", "<p>") for k in range(0, 8)] + [(None, "u", None)], "page_id long, url string, html string")
    found = warc.resolve_revisits(warc.parse_records(warc.records_of_pages(pages))).collect()
    assert {r["verdict"] for r in found} == {"not-found"} and {r["url"] for r in found} <= {None, "u"}


# --- 2 quality, pipeline -----------------------------------------------------


def test_quality_held_out(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.classify_quality(d, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    right = sum(r["predicted"] == r["quality"] for r in got)
    assert right >= 0.97 * len(got) and all(0 <= r["score"] <= 1 for r in got)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(4, 1), (8, 0), (None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    got = rows_of(quality.classify_quality(edge_docs(spark), labels))
    assert len(got) == 11 and all(0 <= r[2] <= 1 and r[3] == int(r[2] >= 0.5) for r in got)
    assert all(r[1] == (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1) for r in got)
    assert {r[2] for r in rows_of(quality.classify_quality(edge_docs(spark), labels.limit(0)))} == {0.5}
    assert quality.classify_quality(edge_docs(spark).limit(0), labels).count() == 0


def slow_discriminant(x, y, shrink=0.3, toward=0.1):
    """Scores of all rows of x from textbook densities; y: 0, 1, or None for rows that aren't learned from."""
    known = np.array([v is not None for v in y])
    means, covs, priors = [], [], []
    for k in (0, 1):
        own = x[[v == k for v in y]]
        means.append(own.mean(axis=0))
        covs.append(np.cov(own.T, bias=True))
        priors.append(np.log((len(own) + 0.5) / (known.sum() + 1)))
    n = [sum(v == k for v in y) for k in (0, 1)]
    pooled = sum(n[k] / known.sum() * covs[k] for k in (0, 1))
    dens = []
    for k in (0, 1):
        cov = (1 - shrink) * ((1 - toward) * covs[k] + toward * pooled) + shrink * np.diag(np.maximum(np.diag(pooled), 1e-6)) + 1e-9 * np.eye(x.shape[1])
        d = x - means[k]
        dens.append(priors[k] - 0.5 * (np.linalg.slogdet(cov)[1] + np.sum(d * np.linalg.solve(cov, d.T).T, axis=1)))
    return 1 / (1 + np.exp(dens[0] - dens[1]))


def slow_scores(docs, labels):
    """{(doc_id, text): score}, from labels outside the held-out third."""
    x = np.array([quality.features(None if t is None else t.encode()) for _, t in docs])
    label = {i: q for i, q in labels if q in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1}
    return dict(zip(docs, slow_discriminant(x, [label.get(i) for i, _ in docs]), strict=True))


def test_quality_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    want = slow_scores(rows_of(docs.select("doc_id", "text")), rows_of(labels.select("doc_id", "quality")))
    want = {i: v for (i, _), v in want.items()}
    got = {r[0]: (r[2], r[3]) for r in rows_of(quality.classify_quality(docs, labels))}
    assert got.keys() == want.keys() and all(abs(got[i][0] - want[i]) < 1e-6 and got[i][1] == (want[i] >= 0.5) for i in want)


def slow_mix(docs, weights=(3, 1, 2), share=1.5, most=2):
    """Times each (doc_id, text, source) is taken: targets by repeated resharing, thresholds by sorting hashes."""
    n = [len(WORD.findall(t or "")) for _, t, _ in docs]
    sources = sorted({s for *_, s in docs}, key=lambda s: (s is None, s or ""))
    size = {s: sum(k for k, d in zip(n, docs, strict=True) if d[2] == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    budget, open_, target = share * sum(n), set(sources), {}
    while open_:
        left = {s: budget * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if left[s] >= most * size[s]}
        target |= {s: float(most * size[s]) for s in full} if full else left
        budget -= sum(most * size[s] for s in full)
        open_ = open_ - full if full else set()
    out = [0] * len(docs)
    for s in sources:
        whole = min(most, int(target[s] // size[s])) if size[s] else 0
        own = sorted((int(hashlib.md5(str(d[0]).encode()).hexdigest()[:12], 16), k) for k, d in enumerate(docs) if d[2] == s)
        rest, upto = target[s] - whole * size[s], 0
        for h, k in own:
            out[k] = whole
            if rest > 0 and upto < rest and (upto + n[k] <= rest or 2 * (rest - upto) >= n[k]):
                out[k] += 1
            upto += n[k]
    return out, target


def test_pipeline_stages(spark):
    """Each stage on its own input against a brute-force version."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, pair = docs.columns, ("doc_id", "text")
    a = p.quality(spark, docs, SF)
    scores = slow_scores(rows_of(docs.select(*pair)), rows_of(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")))
    good = rows_of(a.select(*pair))
    assert sorted(good) == sorted(d for d, v in scores.items() if v >= 0.5) and a.columns == columns
    b = p.near_duplicates(spark, a, SF)
    fps = [slow_fingerprint(t) for _, t in good]
    root = components(len(good), [(i, j) for i in range(len(good)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    least = {}
    for k, r in enumerate(root):
        least[r] = min(least.get(r, good[k]), good[k])
    single = rows_of(b.select(*pair))
    assert sorted(single) == sorted(least.values()) and b.columns == columns
    c = p.decontamination(spark, b, SF)
    low = lambda t: [w.translate({k: k + 32 for k in range(65, 91)}) for w in WORD.findall(t or "")]
    items = [low(r[0]) for r in rows_of(spark.read.parquet(f"{SF}/benchmark.parquet").select("text"))]
    ids = {w: k + 1 for k, w in enumerate({w for i in items for w in i})}

    def holds(text):
        words = np.array([ids.get(w, 0) for w in low(text)], np.int64)
        return any(len(i) and np.isin(words, [ids[w] for w in i]).any() and decontam.align(np.array([ids[w] for w in i]), words)[0] <= (int(0.2 * len(i) + 1e-9) if len(i) >= 5 else 0) for i in items)

    clean = sorted(d for d in single if not holds(d[1]))
    assert sorted(rows_of(c.select(*pair))) == clean and 0 < len(clean) < len(single) and c.columns == columns
    m = p.mixing(spark, c, SF)
    triples = rows_of(c.select("doc_id", "text", "source"))
    times, _ = slow_mix(triples)
    mixed = rows_of(m.select(*pair))
    assert sorted(mixed) == sorted(d[:2] for d, k in zip(triples, times, strict=True) for _ in range(k)) and m.columns == columns
    t, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    out = sorted(rows_of(p.tokens(spark, m, SF)), key=lambda r: r[1])
    for (i, text), row in zip(sorted(mixed), out, strict=True):
        own = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert row == (i, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)


def test_pipeline_edges(spark):
    import corpus_pipeline as p

    docs = edge_docs(spark, [(11, "<|endoftext|> " * 3, None)])
    once = {"quality", "near_duplicates", "decontamination"}
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        got = out.count()
        if name != "tokens":
            assert out.columns == docs.columns and got <= docs.count() * (1 if name in once else 2)
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert p.decontamination(spark, docs, SF).count() == p.tokens(spark, docs, SF).count() == docs.count()
    assert {r[0] for r in rows_of(p.near_duplicates(spark, docs, SF).select("doc_id"))} >= {1, 6, 8}
