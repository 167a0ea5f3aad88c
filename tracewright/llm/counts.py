"""Exact token counts of every prefix of a text, by dynamic programming over byte-level BPE."""

from __future__ import annotations

import json
import re
from array import array
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, pick, slices
from .tokens import _tokenizer

BLOCK = 4096
#: Pieces that a byte-level tokenizer encodes apart from each other.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same where all signs are ASCII, and none is a blank to some tables only.
ASCII, ASCII_PIECE = re.compile(r"[\t-\r -~]*"), re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
#: Scripts whose letters have been the same for long; other texts are cut by the tokenizer's own, older tables.
SETTLED = regex.compile(
    r"[\x00-\u036f\u0391-\u03a1\u03b1-\u03c9\u0400-\u0481\u048a-\u052f\u05d0-\u05ea\u0621-\u064a\u2000-\u2027\u2030-\u205e\u20a0-\u20ac\u2190-\u23ff\u2500-\u27bf\u3000-\u303f"
    r"\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e\U0001f300-\U0001f64f]*+"
)
RUN = regex.compile(r"\s{2,}(?=\S)")
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Rows of pieces and answers for pairs that a worker holds at most, before it starts anew.
MOST = 500_000


def _byte_letters() -> list[str]:
    """The letter by which such vocabularies write each byte: itself if it is printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class PrefixCounts:
    """Token counts of all prefixes of texts, for one tokenizer.

    Inside a piece, prefix i ends with the one token t that is a suffix of it and may follow the last token of prefix i - len(t): the two stay apart when they are encoded together. So count[i] = count[i - len(t)] + 1, and one pass gives all prefixes. Rows of distinct pieces are kept and laid end to end.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        setup = json.loads(self.tokenizer.to_str())
        pre, model = setup["pre_tokenizer"] or {}, setup["model"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or setup["normalizer"] or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("prefix counts need a plain byte-level BPE tokenizer")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in setup["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.model = self.tokenizer.model
        added = sorted((t["content"] for t in setup["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(_byte_letters())})
        #: Tokens that are encoded as themselves, and their lengths by their last two letters, longest first.
        self.whole = {t for t in model["vocab"] if t not in added and [x.value for x in self.model.tokenize(t)] == [t]}
        lengths: dict[str, set] = {}
        for t in self.whole:
            lengths.setdefault(t[-2:], set()).add(len(t))
            if len(t) > 1:
                lengths.setdefault(t[-1:], set())
        if not self.whole.issuperset(_byte_letters()):
            raise ValueError("every byte must be a token")
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}
        self.rows: dict[str, bytes] = {}
        self.follows: dict[str, dict[str, bool]] = {}
        self.held = 0

    def _may_follow(self, a: str, b: str) -> bool:
        if self.held >= MOST:
            self.follows.clear()
            self.held = 0
        self.held += 1
        found = self.follows.setdefault(a, {})[b] = [x.value for x in self.model.tokenize(a + b)] == [a, b]
        return found

    def _extend(self, piece: str, count: list[int], last: list[str]) -> None:
        """Counts and last tokens of the prefixes of a piece, byte by byte, after those that the lists hold; the piece is in the vocabulary's letters."""
        whole, lengths, follows, none = self.whole, self.lengths, self.follows, {}
        for i in range(len(count), len(piece) + 1):
            for n in lengths.get(piece[i - 2 : i] if i > 1 else piece[0], ()) or (1,):
                if n > i or (t := piece[i - n : i]) not in whole:
                    continue
                if n == i:
                    break
                before = last[i - n]
                ok = follows.get(before, none).get(t)
                if self._may_follow(before, t) if ok is None else ok:
                    break
            else:
                n, t = 1, piece[i - 1]
            count.append(count[i - n] + 1)
            last.append(t)

    def learn(self, needed: set[str]) -> None:
        """Rows of all needed pieces. New ones in the order of their letters, so that a piece goes on from the prefix that it shares with the one before."""
        pieces = needed.difference(self.rows)
        if len(self.rows) + len(pieces) > MOST:
            self.rows.clear()
            pieces = needed
        before, count, last = "", [0], [""]
        for said, piece in sorted((p.encode().decode("latin-1").translate(self.letters), p) for p in pieces):
            k, n = 0, min(len(said), len(before))
            while k < n and said[k] == before[k]:
                k += 1
            del count[k + 1 :], last[k + 1 :]
            self._extend(said, count, last)
            before = said
            row = count[1:] if piece.isascii() else [count[k] for k in accumulate(len(c.encode()) for c in piece)]
            if piece in CONTRACTIONS:
                # a cut contraction is a sign and a word
                row = [1, *(1 + n for n in self._letters(piece[1:-1])), row[-1]]
            self.rows[piece] = array("i", row).tobytes()

    def _letters(self, word: str) -> list[int]:
        count, last = [0], [""]
        self._extend(word, count, last)
        return count[1:]

    def row(self, piece: str) -> bytes:
        """Counts of the prefixes of a piece that end with its characters, as 32-bit integers."""
        if piece not in self.rows:
            self.learn({piece})
        return self.rows[piece]

    def pieces(self, text: str) -> list[str]:
        if ASCII.fullmatch(text):
            return ASCII_PIECE.findall(text)
        if SETTLED.fullmatch(text):
            return PIECE.findall(text)
        return [text[a:e] for _, (a, e) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _plain(self, text: str, pieces: list[str] | None = None) -> np.ndarray:
        """Counts of all prefixes of a text without added tokens."""
        pieces = self.pieces(text) if pieces is None else pieces
        try:
            rows = list(map(self.rows.__getitem__, pieces))
        except KeyError:  # new, or forgotten since they were learned
            self.learn(set(pieces))
            rows = list(map(self.rows.__getitem__, pieces))
        flat = np.frombuffer(b"".join(rows), np.intc)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        own = flat[np.cumsum(size) - 1].astype(np.int64)
        out = flat + np.repeat(np.cumsum(own) - own, size)
        for m in RUN.finditer(text):
            # a prefix that ends with a run of white space holds it as one piece
            a, e = m.span()
            out[e - 1] = (out[a - 1] if a else 0) + np.frombuffer(self.row(m[0]), np.intc)[-1]
        return out

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Counts of all prefixes of each text; the pieces of all are learned together."""
        plain = [not (self.added and self.added.search(t)) for t in texts]
        pieces = [self.pieces(t) if ok and t else [] for t, ok in zip(texts, plain, strict=True)]
        self.learn(set(chain.from_iterable(pieces)))
        return [self._plain(t, p) if p else self.text(t) for t, p in zip(texts, pieces, strict=True)]

    def text(self, text: str) -> np.ndarray:
        """Counts of all prefixes of a text, by character: [n - 1] is the count of its first n characters."""
        found = self.added.finditer(text) if self.added else ()
        parts, base, at = [np.zeros(0, np.int64)], 0, 0
        for m in found:
            a, e = m.span()
            # prefixes that end inside an added token are plain text
            inside = self.text(text[at : e - 1])
            parts.append(base + inside)
            base += int(self._plain(text[at:a])[-1]) + 1 if a > at else 1
            parts.append(np.array([base]))
            at = e
        if at < len(text):
            parts.append(base + self._plain(text[at:]))
        return np.concatenate(parts)


_counters: dict[str, PrefixCounts] = {}


def prefix_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The token count of every prefix of every text of docs (doc_id, text), as the tokenizer's plain call gives it without special tokens added.

    One row per block of 4,096 characters: doc_id, t1, t2 (key of the text), n_bytes, block, counts (of the prefixes that end with each of its characters), last (whether it is the text's last block; its last count is the whole text's). A text without characters has one block without counts.

    Null text: empty. Null and repeated doc_ids, repeated rows: blocks of their own. Very long texts: many rows; a task holds one text at a time. Bytes that are no UTF-8 count as U+FFFD. Empty table: no rows. Other columns are not read. Added tokens inside a text count as one.
    """
    docs = pick(docs, doc_id="long", text="binary").withColumn("text", F.coalesce("text", F.lit(b"")))
    docs = bounded_batches(docs.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(42), "text").alias("t2"), F.octet_length("text").cast("long").alias("n_bytes"), "text"))
    schema = pa.schema([("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("n_bytes", pa.int64()), ("block", pa.int64()), ("counts", pa.list_(pa.int32())), ("last", pa.bool_())])

    def run(batches):
        if tokenizer not in _counters:
            _counters[tokenizer] = PrefixCounts(tokenizer)
        count = _counters[tokenizer].texts
        for b in batches:
            for at, texts in slices(b.column("text").to_pylist()):
                found = count([t.decode("utf-8", "replace") for t in texts])
                size = np.fromiter(map(len, found), np.int64, len(found))
                blocks = np.maximum(1, -(-size // BLOCK))
                own = np.repeat(np.arange(len(found)), blocks)
                number = np.arange(len(own)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                filled = np.minimum(BLOCK, size[own] - number * BLOCK)
                flat = pa.array(np.concatenate(found).astype(np.int32))
                counts = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(filled))), pa.int32()), flat)
                held = [b.column(c).slice(at, len(texts)).take(pa.array(own)) for c in ("doc_id", "t1", "t2", "n_bytes")]
                yield pa.record_batch([*held, pa.array(number), counts, pa.array(number == blocks[own] - 1)], schema=schema)

    return docs.mapInArrow(run, "doc_id long, t1 long, t2 long, n_bytes long, block long, counts array<int>, last boolean")


def whole_counts(prefixes: DataFrame, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text of a prefix table: its last prefix."""
    n = F.coalesce(F.try_element_at("counts", F.lit(-1)), F.lit(0)).cast("long")
    return prefixes.where("last").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


def counts_at(prefixes: DataFrame, places: DataFrame) -> DataFrame:
    """places (doc_id, at) with `n_tokens` of the first `at` characters; at 0: 0. Places beyond a text, or of unknown or null doc_ids, have null; texts that share a doc_id give a row each."""
    wanted = pick(places, doc_id="long", at="long").withColumn("block", F.expr("if(at > 0, (at - 1) div 4096, 0)"))
    n = F.when(F.col("at") == 0, F.when(F.col("counts").isNotNull(), 0)).when(F.col("at") > 0, F.try_element_at("counts", ((F.col("at") - 1) % BLOCK + 1).cast("int")))
    return wanted.join(prefixes.select("doc_id", "block", "counts"), ["doc_id", "block"], "left").select("doc_id", "at", n.cast("long").alias("n_tokens"))


def fit_to(prefixes: DataFrame, budget: int) -> DataFrame:
    """(doc_id, t1, t2, n_chars, n_tokens): the longest prefix of every text that has at most `budget` tokens, and its count. A count can fall as a text grows, so every prefix is looked at. Rows of the same doc_id and text give one answer."""
    upto = F.transform("counts", lambda c, k: F.when(c <= budget, F.struct((F.col("block") * BLOCK + k + 1).alias("n_chars"), c.cast("long").alias("n_tokens"))))
    none = F.struct(F.lit(0).cast("long").alias("n_chars"), F.lit(0).cast("long").alias("n_tokens"))
    best = prefixes.groupBy("doc_id", "t1", "t2").agg(F.coalesce(F.max(F.array_max(upto)), none).alias("best"))
    return best.select("doc_id", "t1", "t2", "best.n_chars", "best.n_tokens")
