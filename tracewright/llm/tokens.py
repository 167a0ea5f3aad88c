"""Token ids of whole documents as Arrow files of fixed-size lists, for random access without copies."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, open_folder, pick, shared_path, slices

SEQUENCE, BATCH = 2048, 64
_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


MARK = "\x01"
#: Words of up to this many bytes are told apart by whole-array comparison; longer ones are looked up one by one.
LANES = 4
_BLANK, _ALNUM, _SIGN = (np.zeros(256, bool) for _ in range(3))
_BLANK[list(b" \t\n\v\f\r")] = True
_ALNUM[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
#: After an ASCII letter or digit the tokenizer cuts before these anyway.
_SIGN[list(b".,;:!?")] = True
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: What may differ between a text and its words in turn: contractions, marks to compose, digits, signs in a row, scripts without blanks, blanks beyond ASCII, letters that change length in lower case.
PROBES = (
    "Ab., c D1", "It's we'LL 'tis o'clock 're", "café Éa ́x", "12,345.67 1a2b ٣٤", "a...b ?!? --x;:y", "漢字かな 한국어 한", "a b c　d\u0085e​f",
    "İSTANBUL Straße ΣΑΣ ǅ Å", "😀👍🏽 ☃.x", "x̸= ≮ ;̸", "a\x00b\x1cc\x1fd ﻿e", "नमस्ते ไทย",
)


class WordIds:
    """Ids of whole texts from those of their distinct words, for tokenizers that lower-case, drop white space, and part letters from signs.

    Words are cut, packed into 8-byte lanes and grouped as arrays; each distinct word of a batch is looked up once, and encoded by the tokenizer if it is new. Equal keys are compared in all their bytes. The store of words starts anew when it holds `most`, so memory is bounded.
    """

    def __init__(self, tokenizer, kind: type, most: int = 500_000):
        self.encode, self.kind, self.most = tokenizer.encode_batch_fast, kind, most
        added = [re.escape(t.content.lower().strip().encode()) for t in tokenizer.get_added_tokens_decoder().values()]
        #: A text that may hold an added token, in any case, is encoded whole.
        self.added = re.compile(b"|".join(sorted(filter(None, added), key=len, reverse=True))) if any(added) else None
        mark = self._ids([MARK])[0]
        if len(mark) != 1:
            raise ValueError("by_word doesn't suit this tokenizer")
        self.mark = int(mark[0])
        self.last = np.zeros(tokenizer.get_vocab_size() + 1, bool)
        self.last[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self._forget()
        for text in PROBES:
            if self.texts([text.encode()])[0].tobytes() != self._ids([text])[0].tobytes():
                raise ValueError("by_word doesn't suit this tokenizer")

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.encode(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, self.kind), 0
        self.first, self.size = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)

    def texts(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of every text. White space here is ASCII; other white space inside a word is the tokenizer's to handle."""
        if len(self.place) > self.most:
            self._forget()
        joined = b" ".join(texts).lower()
        whole = [k for k, t in enumerate(texts) if self.added.search(t.lower())] if self.added and self.added.search(joined) else []
        buffer = np.frombuffer(joined + b" " * (8 * LANES), np.uint8)
        begin, end = self._cut(buffer[: len(joined)])
        word = self._places(joined, buffer, begin, end)
        size = self.size[word]
        upto = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(self.first[word] - upto[:-1], size) + np.arange(upto[-1])]
        lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        cuts = upto[np.searchsorted(begin, np.concatenate(([0], np.cumsum(lens))))].tolist()
        out = [ids[a:e] for a, e in zip(cuts[:-1], cuts[1:], strict=True)]
        for k in whole:
            out[k] = self._ids([texts[k].decode()])[0]
        return out

    @staticmethod
    def _cut(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of every word."""
        blank = np.concatenate(([True], _BLANK[b], [True]))
        cut = np.zeros(len(b) + 1, bool)
        cut[1:-1] = _SIGN[b[1:]] & _ALNUM[b[:-1]]
        return np.flatnonzero(~blank[1:-1] & (blank[:-2] | cut[:-1])), np.flatnonzero(~blank[1:-1] & (blank[2:] | cut[1:])) + 1

    def _places(self, joined: bytes, buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where the store holds each word."""
        n = end - begin
        out = np.zeros(len(n), np.int64)
        short = np.flatnonzero(n <= 8 * LANES)
        a, m = begin[short], n[short]
        eight = np.lib.stride_tricks.as_strided(buffer.view(np.uint8), (max(0, len(buffer) - 7), 8), (1, 1)).view("<u8")[:, 0] if len(buffer) >= 8 else np.zeros(0, np.uint64)
        lanes, key = [], m.astype(np.uint64)
        for k in range(LANES):
            some = np.flatnonzero(m > 8 * k) if k else slice(None)
            lane = np.zeros(len(a), np.uint64)
            lane[some] = eight[a[some] + 8 * k] & _KEEP[np.clip(m[some] - 8 * k, 0, 8)]
            lanes.append(lane)
            key[some] = (key[some] ^ lane[some]) * np.uint64(0x9E3779B97F4A7C15)
            key[some] ^= key[some] >> np.uint64(29)
        _, first, group = np.unique(key, return_index=True, return_inverse=True)
        if all((lane == lane[first][group]).all() for lane in lanes) and (m == m[first][group]).all():
            out[short] = self._stored([joined[x:y] for x, y in zip(a[first].tolist(), end[short][first].tolist(), strict=True)])[group]
            rest = np.flatnonzero(n > 8 * LANES)
        else:  # different words of one key
            rest = np.arange(len(n))
        if len(rest):
            out[rest] = self._stored([joined[x:y] for x, y in zip(begin[rest].tolist(), end[rest].tolist(), strict=True)])
        return out

    def _stored(self, words: list[bytes]) -> np.ndarray:
        """Places of words; new ones are encoded."""
        place = self.place
        plain, rest = [], []
        for w in dict.fromkeys([w for w in words if w not in place]):
            if w.isalpha():
                plain.append(w)
            else:
                t = w.decode()
                (plain if t.isalpha() and t.lower().isalpha() and is_normalized("NFC", t) else rest).append(w)
        for some, method in ((plain, self._plain), (rest, self._marked)):
            for k in range(0, len(some), 4096):
                part = some[k : k + 4096]
                self._store(part, *method(part))
        return np.fromiter(map(place.__getitem__, words), np.int64, len(words))

    def _store(self, words: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        at = len(self.place)
        while at + len(words) > len(self.first):
            self.first, self.size = (np.concatenate((v, np.zeros_like(v))) for v in (self.first, self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.first[at : at + len(words)] = self.used + np.cumsum(size) - size
        self.size[at : at + len(words)] = size
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.place.update(zip(words, range(at, at + len(words)), strict=True))

    def _plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in turn, and how many each has. Words of letters alone end with their only token that ends a word."""
        ids = self._ids([b" ".join(words).decode()])[0]
        ends = np.flatnonzero(self.last[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) else self._marked(words)

    def _marked(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words in one call with a mark between; one by one if a word holds the mark."""
        line = f" {MARK} ".encode().join(words)
        if line.count(MARK.encode()) == len(words) - 1:
            ids = self._ids([line.decode()])[0]
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) == len(words) - 1:
                return np.delete(ids, cuts), np.diff(cuts, prepend=-1, append=len(ids)) - 1
        one = self._ids([w.decode() for w in words])
        return np.concatenate(one), np.fromiter(map(len, one), np.int64, len(one))


def _encoder(path: str, kind: type, by_word: bool):
    """texts as UTF-8 -> ids of each."""
    if by_word:
        key = f"{path} {np.dtype(kind)}"
        if key not in _loaded:
            _loaded[key] = WordIds(_tokenizer(path), kind)
        return _loaded[key].texts
    encode = _tokenizer(path).encode_batch_fast
    return lambda texts: [np.array(e.ids, kind) for e in encode([t.decode() for t in texts], add_special_tokens=False)]


def _sequences(ids: np.ndarray, real: int, length: int) -> pa.RecordBatch:
    flat = pa.array(ids)
    mask = pa.array(np.arange(len(ids)) < real)
    return pa.record_batch([pa.FixedSizeListArray.from_arrays(flat, length), pa.FixedSizeListArray.from_arrays(mask, length)], names=["ids", "mask"])


class ShardWriter:
    """One shard: NAME.arrow has rows of `length` ids and of their masks (false: padding after the last document), NAME.docs.arrow where each document starts. Both get their names only when they are whole, so a task that is run again replaces nothing half."""

    def __init__(self, folder: str, name: str, length: int, wide: bool):
        self.fs, self.folder = open_folder(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.name, self.length, self.kind = name, length, np.uint32 if wide else np.uint16
        self.part = f"{self.folder}/.{name}.{uuid.uuid4().hex}"
        value = pa.from_numpy_dtype(self.kind)
        self.seq = self.fs.open_output_stream(self.part + ".arrow")
        self.seqs = pa.ipc.new_file(self.seq, pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))]))
        self.idx = self.fs.open_output_stream(self.part + ".docs.arrow")
        self.docs = pa.ipc.new_file(self.idx, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
        self.held: list[np.ndarray] = []
        self.waiting = self.total = 0

    def add(self, doc_ids: list, encoded: list[np.ndarray]) -> None:
        n = np.array([len(e) for e in encoded], np.int64)
        self.docs.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(self.total + np.cumsum(n) - n), pa.array(n)], names=["doc_id", "start", "n_tokens"]))
        self.held += encoded
        self.waiting += int(n.sum())
        self.total += int(n.sum())
        if self.waiting >= self.length * BATCH:
            ids = np.concatenate(self.held)
            full = len(ids) // (self.length * BATCH) * self.length * BATCH
            for k in range(0, full, self.length * BATCH):
                self.seqs.write_batch(_sequences(ids[k : k + self.length * BATCH], self.length * BATCH, self.length))
            self.held, self.waiting = [ids[full:].copy()], len(ids) - full

    def close(self) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        if len(ids):
            padded = np.zeros(-(-len(ids) // self.length) * self.length, self.kind)
            padded[: len(ids)] = ids
            self.seqs.write_batch(_sequences(padded, len(ids), self.length))
        for writer, stream, end in ((self.seqs, self.seq, ".arrow"), (self.docs, self.idx, ".docs.arrow")):
            writer.close()
            stream.close()
            self.fs.move(self.part + end, f"{self.folder}/{self.name}{end}")


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = SEQUENCE, folder: str | None = None, by_word: bool = False) -> tuple[DataFrame, str]:
    """Encode docs (doc_id, text), append end_id to each, and write the ids in ascending doc_id order as shards in `folder` (default: a new one in the shared folder).

    Returns the written list of shards (shard, n_docs, n_tokens, base: ids in all shards before it) and the folder. A shard is one range of doc_id, sorted in its task, which holds a batch at a time. Ids are 16 bits wide where the vocabulary allows.
    by_word: encode each distinct word once, by the tokenizer; only for tokenizers that lower-case, drop white space and part letters from signs, where the ids are the same (others are refused). Added tokens in a text are found as the library's plain call does; such texts are encoded whole.
    Null text: empty, so end_id alone. Null doc_id: first. Rows of the same doc_id: by text. Empty table: no shards. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    wide = _tokenizer(tokenizer).get_vocab_size() > 65536 or end_id > 65535
    docs = bounded_batches(pick(docs, doc_id="long", text="binary"))
    parts = docs.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        from pyspark import TaskContext

        shard, writer, n_docs, kind = TaskContext.get().partitionId(), None, 0, np.uint32 if wide else np.uint16
        encode, end = _encoder(tokenizer, kind, by_word), np.array([end_id], kind)
        for b in batches:
            for at, texts in slices(b.column(1).to_pylist()):
                writer = writer or ShardWriter(folder, f"shard-{shard:07d}", length, wide)
                writer.add(b.column(0).slice(at, len(texts)).to_pylist(), [np.append(e, end) for e in encode(texts)])
            n_docs += b.num_rows
        if writer:
            writer.close()
            yield pa.record_batch([[shard], [n_docs], [writer.total]], schema=pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    shards = materialize(parts.mapInArrow(run, "shard long, n_docs long, n_tokens long"), "token-shards")
    from pyspark.sql import Window

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "token-bases"), folder


def open_shard(folder: str, shard: int) -> tuple[np.ndarray, pa.Table, pa.Table]:
    """(ids of the shard in order, its sequences, its documents). A local file is memory-mapped; ids are a view of it if one batch holds all."""
    fs, root = open_folder(folder)
    from pyarrow.fs import LocalFileSystem

    def read(name: str) -> pa.Table:
        source = pa.memory_map(name) if isinstance(fs, LocalFileSystem) else fs.open_input_file(name)
        return pa.ipc.open_file(source).read_all()

    seqs, docs = read(f"{root}/shard-{shard:07d}.arrow"), read(f"{root}/shard-{shard:07d}.docs.arrow")
    ids = [c.flatten().to_numpy() for c in seqs.column("ids").chunks]
    real = sum(c.flatten().true_count for c in seqs.column("mask").chunks)
    return (ids[0] if len(ids) == 1 else np.concatenate(ids) if ids else np.zeros(0, np.uint16))[:real], seqs, docs


def read_tokens(shards: DataFrame, folder: str) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers)."""

    def run(batches):
        for b in batches:
            for shard, base in zip(b.column("shard").to_pylist(), b.column("base").to_pylist(), strict=True):
                ids, _, docs = open_shard(folder, shard)
                starts, n = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                sums = [zlib.crc32(ids[a : a + k].astype("<u4")) for a, k in zip(starts.tolist(), n.tolist(), strict=True)]
                for k in range(0, len(sums), 10_000):
                    some = docs.slice(k, 10_000)
                    yield pa.record_batch([some.column("doc_id").combine_chunks(), pa.array(starts[k : k + 10_000] + base), pa.array(n[k : k + 10_000]), pa.array(sums[k : k + 10_000], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    per_task = shards.repartition(max(1, min(10_000, shards.count())), "shard")
    return per_task.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
