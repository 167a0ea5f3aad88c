"""op12: every prefix of every text against the tokenizer's plain call."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracewright.llm import counts, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "   ", "a", "Hello world, it's we'll 'tis they'RE x're y've z'll d'd s's m'm t't", "a  b   c\n\n\nd\t\te \n f\r\n\r\ng  ", "  \n lead", "x  y  z　　w", "12345 67,89.10 1a2b", "!!??...--- '''re ''ll '", "naïve café Éá ÅÄÖ ß",
    "漢字かな 한국어 русский текст العربية עברית", "😀👍🏽 ☃ \U0001f9ff\U0001fae8", "<|endoftext|>", "a <|endoftext|> b", "a  <|endoftext|>  b<|endoftext|><|endoftext|>", "<|endoftext", "x<|endoftext|", "  <|endo <|endoftext|>'ll", "\x00\x1c\x85​﻿", "= " * 50 + "-" * 200 + " " * 130 + "x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "http://a.b/c?d=e&f=g#h", "thethethethe'llthe",
    "՘ ࢏ ౜ ₏ ꟎ \U00010940", "\n", "a\n", " \n", "a\n b\n\n  c",
]


def slow(tokenizer, text):
    return [len(tokenizer.encode(text[: k + 1], add_special_tokens=False).ids) for k in range(len(text))]


@pytest.fixture(scope="module")
def both():
    return counts.PrefixCounts(PATH), Tokenizer.from_file(PATH)


def test_every_prefix(both):
    ours, plain = both
    for t in TEXTS:
        assert ours.text(t).tolist() == slow(plain, t), t


def test_random_prefixes(both):
    ours, plain = both
    rnd = random.Random(1)
    bits = ["the", "ing", "'", "'re", "'ll", " ", "  ", "\n", "\t", "é", "漢", "1", "23", ".", "--", "a", "B", "<|endoftext|>", "<|", "|>", "😀", " ", "tion", "x" * 9, "qzj"]
    for _ in range(400):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14)))
        assert ours.text(t).tolist() == slow(plain, t), t
    for _ in range(300):
        t = "".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(0, 0x24F), rnd.randint(0x370, 0x30FF), rnd.randint(0xE000, 0x1FFFF)])) for _ in range(rnd.randint(1, 30)))
        assert ours.text(t).tolist() == slow(plain, t), t


def test_settled_letters_are_cut_alike(both):
    ours, plain = both
    settled = [c for c in map(chr, (*range(0xD800), *range(0xE000, 0x1F650))) if counts.SETTLED.fullmatch(c)]
    for k in range(0, len(settled), 500):
        t = "".join(f"a{c}1{c}!{c}{c}b" for c in settled[k : k + 500])
        assert counts.PIECE.findall(t) == [t[a:e] for _, (a, e) in plain.pre_tokenizer.pre_tokenize_str(t)]
    assert len(settled) > 30_000


def test_store_starts_anew(both, monkeypatch):
    monkeypatch.setattr(counts, "MOST", 5)
    ours, plain = counts.PrefixCounts(PATH), both[1]
    for t in TEXTS:
        assert ours.text(t)[-1:].tolist() == slow(plain, t)[-1:]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        counts.PrefixCounts(public_tokenizers.path("word_bpe_49k.json"))


def rows(spark):
    long = "Long text, it's  long.\n\n" * 3000
    return [*enumerate(TEXTS), (None, "null id"), (5, "again"), (5, "again"), (900, None), (901, long), (902, "q" * 20_000)]


def test_table_and_questions(spark, both):
    plain = both[1]
    own = rows(spark)
    docs = spark.createDataFrame([(*r, 1, True, [1], 5) for r in own], "doc_id int, text string, block int, last boolean, counts array<int>, n_bytes int")
    table = counts.prefix_counts(docs, PATH)
    got = sorted(map(str, (tuple(r) for r in counts.whole_counts(table, 1024).collect())))
    n = {t: len(plain.encode(t or "", add_special_tokens=False).ids) for _, t in own}
    assert got == sorted(str((i, len((t or "").encode()), n[t], n[t] > 1024)) for i, t in own)
    long = own[-2][1]
    places = spark.createDataFrame([(901, k) for k in (0, 1, 4095, 4096, 4097, 8192, 50_000, len(long), len(long) + 1)] + [(900, 0), (900, 1), (77777, 0)], "doc_id long, at long")
    for i, at, found in counts.counts_at(table, places).collect():
        want = None if i == 77777 or at > (len(long) if i == 901 else 0) else len(plain.encode(long[:at], add_special_tokens=False).ids)
        assert found == want, (i, at)
    for budget in (0, 1, 7, 2000):
        fits = {r.doc_id: (r.n_chars, r.n_tokens) for r in counts.fit_to(table, budget).collect() if r.doc_id not in (5, None)}
        for i, t in own:
            if i in fits and i < 900:
                c = [0, *slow(plain, t)]
                best = max(k for k, v in enumerate(c) if v <= budget)
                assert fits[i] == (best, c[best]), (t, budget)
        k = fits[901][0]
        assert len(plain.encode(long[:k], add_special_tokens=False).ids) <= budget and (k == len(long) or len(plain.encode(long[: k + 1], add_special_tokens=False).ids) > budget)
    assert counts.prefix_counts(docs.limit(0), PATH).count() == 0


def test_query(spark, both):
    docs = {r[0]: r[1] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r[0]: tuple(r[1:]) for r in queries.op12_prefix_counts(spark, SF).collect()}
    assert got == {i: (len(t.encode()), n := len(both[1].encode(t, add_special_tokens=False).ids), n > 1024) for i, t in docs.items()} and np.mean([v[2] for v in got.values()]) > 0


def test_texts_are_learned_once(monkeypatch):
    """The pieces of all texts are learned together; no text asks for its own again. ASCII texts are cut as others are."""
    counter = counts.PrefixCounts(public_tokenizers.path("byte_bpe_50k.json"))
    calls = []
    learn = counter.learn
    monkeypatch.setattr(counter, "learn", lambda needed: (calls.append(len(needed)), learn(needed)))
    texts = ["It's a cat, o'clock 12,5", "they'll\tgo home_now  x", "a cat's home!"]
    got = counter.texts(texts)
    assert len([n for n in calls if n > 1]) == 1
    signs = [*texts, " \t\n\v\f\r x", "a  \n b", "  ", "I've 1a2b '' 's'd \x7f", "x\n\n", *(chr(k) + " a" + chr(k) + "1" for k in range(128))]
    assert all(counter.pieces(t) == counts.PIECE.findall(t) for t in signs)
    assert [int(g[-1]) for g in got] == [len(counter.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
