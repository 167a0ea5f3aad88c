"""Benchmark decontamination: CGK random walks over words, bit-sampling LSH on item-sized windows, exact edit verification.

A CGK walk maps a word sequence to a longer one: at every step it writes the word under a pointer and a random bit of (step, word) says whether the pointer moves on. Sequences a few edits apart fall into step again, so they agree at most steps; samples of a few steps of many walks are LSH keys.

Walks drift apart with the number of edits, so walks alone lose long items. Each item is therefore also cut into one piece more than the edits it may have: in any match one piece at least is whole (pigeonhole), and all whole pieces are looked up. Recall at the similarity bound is 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, open_folder, pick, shared_path, slices
from .simhash import LOWER

#: Items that one pass over the documents holds; more items take more passes.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000
SLICE_BYTES = 1 << 20  # of a run of texts, see slices()
_rng = np.random.default_rng(20_240_229)
_BYTE = _rng.integers(0, 2**63, 256, np.uint64)
_BASE, _SPACE = 0x9E3779B97F4A7C15, np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_power = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    if len(_power[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _power[k] = np.multiply.accumulate(steps)
    return _power[0], _power[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(buffer: np.ndarray, starts_of_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end) of every word of adjoining lower-cased texts: runs of anything but ASCII white space; no word crosses texts."""
    up, down = _powers(len(buffer) + 1)
    blank = np.concatenate(([True], _SPACE[buffer], [True]))
    first = blank[:-2] & ~blank[1:-1]
    cut = starts_of_texts[starts_of_texts < len(buffer)]
    first[cut] = ~blank[1:-1][cut]
    last = ~blank[1:-1] & blank[2:]
    cut = cut[cut > 0] - 1
    last[cut] = ~blank[1:-1][cut]
    a, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[buffer] * up[: len(buffer)], dtype=np.uint64)))
    return _mix((sums[e] - sums[a]) * down[a]), a, e


def _pair(hashes: np.ndarray) -> np.ndarray:
    return _mix(hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[1:])


def _member(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return at, sorted_[at] == values


class Index:
    """LSH tables of one block of items, `walks` walks of `samples` sampled steps each (items of like length share steps), and tables of the items' pieces by length. Items of under `min_words` words may have no edits."""

    def __init__(self, items: list[tuple[int, bytes]], similarity: float, walks: int, samples: int, min_words: int):
        self.similarity = similarity
        self.ids, words = [], []
        self.said: list[list[bytes]] = []
        for item_id, text in items:
            h = word_hashes(np.frombuffer(text.translate(LOWER), np.uint8), np.zeros(1, np.int64))[0] if text else np.zeros(0, np.uint64)
            if len(h):
                self.ids.append(item_id)
                self.said.append(text.translate(LOWER).split())
                words.append(h)
        self.vocab = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.vocab >> np.uint64(40)) & np.uint64((1 << 18) - 1)] = True
        self.pairs = np.unique(np.concatenate([_pair(h) for h in words])) if words else np.zeros(0, np.uint64)
        self.maybe_pair = np.zeros(1 << 18, bool)
        self.maybe_pair[(self.pairs >> np.uint64(40)) & np.uint64((1 << 18) - 1)] = True
        self.items = [np.searchsorted(self.vocab, h) + 1 for h in words]
        self.spare = [int((1 - similarity) * len(x) + 1e-9) if len(x) >= min_words else 0 for x in self.items]
        self.words_of, self.spare_of = np.array([len(x) for x in self.items], np.int64), np.array(self.spare, np.int64)
        rng = np.random.default_rng(7)
        self.classes = []
        order = sorted((i for i in range(len(self.items)) if len(self.items[i]) >= min_words), key=lambda i: len(self.items[i]))
        while order:
            top = max(len(self.items[order[0]]) * 1.25, len(self.items[order[0]]) + 3)
            own = [i for i in order if len(self.items[i]) <= top]
            order = order[len(own) :]
            low, high = len(self.items[own[0]]), len(self.items[own[-1]])
            need, span = min(len(self.items[i]) - self.spare[i] for i in own), max(len(self.items[i]) + self.spare[i] for i in own)
            pairs = min(len(self.items[i]) - 1 - 2 * self.spare[i] for i in own)
            self.classes.append((need, pairs, span, [self._walk(own, low, samples, rng) for _ in range(walks)]))

        self.pieces = self._pieces()

    def _pieces(self) -> list[tuple]:
        """(length, sorted keys, item of each, place in the item of each): every item in spare + 1 pieces of like length, so spare edits leave one whole."""
        by_length: dict[int, list[tuple[int, int]]] = {}
        for i, item in enumerate(self.items):
            cuts = [len(item) * k // (self.spare[i] + 1) for k in range(self.spare[i] + 2)]
            for a, e in zip(cuts, cuts[1:]):
                if e > a:
                    by_length.setdefault(e - a, []).append((i, a))
        out = []
        for length, own in sorted(by_length.items()):
            key = self._key(list(np.array([self.items[i][a : a + length] for i, a in own]).T), len(self.vocab) + 1)
            sort = np.argsort(key, kind="stable")
            out.append((length, key[sort], *np.array(own, np.int64)[sort].T))
        return out

    def _walk(self, own: list[int], low: int, samples: int, rng) -> tuple:
        steps = np.sort(rng.choice(2 * low, min(samples, 2 * low), replace=False))
        factors = rng.integers(0, 2**63, int(steps[-1]) + 1, np.uint64) * np.uint64(2) + np.uint64(1)
        hashes = np.concatenate((np.zeros(1, np.uint64), self.vocab))
        wide = max(len(self.items[i]) for i in own)
        table = np.zeros((len(own), wide + 1), np.int64)
        for k, i in enumerate(own):
            table[k, : len(self.items[i])] = self.items[i]
        at, seen = np.zeros(len(own), np.int64), []
        for s in range(int(steps[-1]) + 1):
            now = table[np.arange(len(own)), np.minimum(at, wide)]
            if s in steps:
                seen.append(now)
            at += (hashes[now] * factors[s] >> np.uint64(63)).astype(np.int64)
        allowed = []
        for now in seen:
            ok = np.zeros(len(self.vocab) + 1, bool)
            ok[now[now > 0]] = True
            allowed.append(ok)
        base = len(self.vocab) + 1
        key = self._key(seen, base)
        real = np.all([n > 0 for n in seen], axis=0)
        sort = np.argsort(key[real], kind="stable")
        return steps, factors, allowed, key[real][sort], np.array(own)[real][sort]

    @staticmethod
    def _key(seen: list[np.ndarray], base: int) -> np.ndarray:
        key = np.zeros(len(seen[0]), np.uint64)
        for s in seen:
            key = _mix(key * np.uint64(base) + s.astype(np.uint64))
        return key

    @staticmethod
    def _matches(keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in key, place in the sorted keys) of all equal pairs."""
        a, e = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        m = e - a
        rows = np.repeat(np.arange(len(key)), m)
        return rows, a[rows] + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)

    def candidates(self, hashes: np.ndarray, ids: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window start, item) pairs that share a key or a piece. Windows with too few words, or pairs of adjoining words, of any item are left out first: an edit spoils one word and two pairs at most, so they can't reach the similarity."""
        count = np.concatenate(([0], np.cumsum(ids > 0)))
        pair = _pair(hashes)
        known = self.maybe_pair[(pair >> np.uint64(40)) & np.uint64((1 << 18) - 1)]
        some = np.flatnonzero(known)
        known[some] = _member(self.pairs, pair[some])[1]
        double = np.concatenate(([0], np.cumsum(known), [0]))
        double[-1] = double[-2]
        windows, items = [], []
        n = len(ids)
        for need, pairs, span, walks in self.classes:
            upto = np.minimum(np.arange(n) + span, n)
            start = np.flatnonzero((double[upto] - double[:-1] >= pairs) & (count[upto] - count[:-1] >= need))
            if not len(start):
                continue
            for steps, factors, allowed, keys, owners in walks:
                at, alive, seen, k = start.copy(), start, [], 0
                for s in range(int(steps[-1]) + 1):
                    if s == steps[k]:
                        word = ids[np.minimum(at, n - 1)]
                        ok = allowed[k][word] & (at < n)
                        at, alive, seen = at[ok], alive[ok], [x[ok] for x in seen] + [word[ok]]
                        k += 1
                        if k == len(steps) or not len(at):
                            break
                    at = at + (hashes[np.minimum(at, n - 1)] * factors[s] >> np.uint64(63)).astype(np.int64)
                if not len(alive) or k < len(steps):
                    continue
                key = self._key(seen, len(self.vocab) + 1)
                rows, at = self._matches(keys, key)
                windows.append(alive[rows])
                items.append(owners[at])
        for length, keys, owners, places in self.pieces:
            if length > n:
                continue
            start = np.flatnonzero((count[length:] - count[:-length] == length) & (double[length - 1 : n] - double[: n - length + 1] == length - 1))
            rows, at = self._matches(keys, self._key([ids[start + k] for k in range(length)], len(self.vocab) + 1))
            found, item, begin = start[rows], owners[at], start[rows] - places[at]
            words, spare = self.words_of[item], self.spare_of[item]
            a, e = np.clip(begin - spare, 0, n), np.clip(begin + words + spare, 0, n)
            ok = (count[e] - count[a] >= words - spare) & (double[np.maximum(e - 1, a)] - double[a] >= words - 1 - 2 * spare)
            windows.append(np.maximum(begin[ok], np.searchsorted(text_of, text_of[found[ok]])))
            items.append(item[ok])
        if not windows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.stack([np.concatenate(items), np.concatenate(windows)]), axis=1)
        return both[1], both[0]

    def find(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """(place of the text, item_id, edits, first word, end word) of the best place of each item in each text."""
        lens = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(lens) - lens
        buffer = np.frombuffer(b"".join(texts).translate(LOWER), np.uint8)
        if not len(buffer) or not self.items:
            return
        hashes, first, end = word_hashes(buffer, begin)
        if not len(hashes):
            return
        ids = np.zeros(len(hashes), np.int64)
        some = np.flatnonzero(self.maybe[(hashes >> np.uint64(40)) & np.uint64((1 << 18) - 1)])
        at, known = _member(self.vocab, hashes[some])
        ids[some] = np.where(known, at + 1, 0)
        text_of = np.searchsorted(begin, first, "right") - 1
        windows, items = self.candidates(hashes, ids, text_of)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        done: dict[tuple[int, int], int] = {}
        for p, i in sorted(zip(windows.tolist(), items.tolist(), strict=True)):
            t = int(text_of[p])
            if done.get((t, i), -1) > p:
                continue
            item, spare = self.items[i], self.spare[i]
            lo, hi = np.searchsorted(text_of, [t, t + 1])
            a, e = max(int(lo), p - len(item)), min(int(hi), p + 2 * len(item) + spare)
            part = ids[a:e]
            if np.isin(part, item).sum() < len(item) - spare:
                continue
            done[t, i] = p + len(item) // 2
            edits, x, y = align(item, part)
            if edits <= spare:  # the words themselves, not their hashes, have the last word
                place = {w: k + 1 for k, w in enumerate(self.said[i])}
                said = [place.get(buffer[u:v].tobytes(), 0) for u, v in zip(first[a:e].tolist(), end[a:e].tolist(), strict=True)]
                edits, x, y = align(np.array([place[w] for w in self.said[i]]), np.array(said))
            if edits <= spare and (edits, a + x) < best.get((t, i), (1 << 40, 0, 0))[:2]:
                best[t, i] = (edits, a + x, a + y)
        for (t, i), (edits, x, y) in sorted(best.items()):
            lo = int(np.searchsorted(text_of, t))
            yield t, i, edits, x - lo, y - lo


def align(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """Least edits (words put in, left out or changed) between item and any stretch of part, with its first and end word. The start rides in the low digits of the cost."""
    m, unit = len(part), 1 << 32
    column = np.arange(m + 1)
    cost = unit - 1 - column
    for w in item.tolist():
        step = cost + unit
        step[1:] = np.minimum(step[1:], cost[:-1] + unit * (part != w))
        cost = np.minimum.accumulate(step - column * unit) + column * unit
    end = int(np.argmin(cost))
    edits, rest = divmod(int(cost[end]), unit)
    return edits, unit - 1 - rest, end


def _write_blocks(benchmark: DataFrame) -> tuple[str, list[int]]:
    """Write the items to the shared folder in blocks of a size that a task can hold, and return the folder and the blocks; the items never reach the driver."""
    items = pick(benchmark, item_id="long", text="binary").where("text is not null").dropDuplicates()
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    k = max(1, -(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    folder = shared_path(items.sparkSession, "benchmark-blocks")
    items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(k)).cast("int")).repartition("block").write.partitionBy("block").parquet(folder)
    return folder, list(range(k))


def _read_block(folder: str, block: int) -> list[tuple[int, bytes]]:
    """Items of a block, by id and text."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, root = open_folder(folder)
    found = files.get_file_info(fs.FileSelector(f"{root}/block={block}", allow_not_found=True))
    tables = [pq.read_table(f.path, filesystem=files, columns=["item_id", "text"], partitioning=None) for f in found if f.path.endswith(".parquet")]
    rows = [r for t in tables for r in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True)]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, walks: int = 24, samples: int = 3, min_words: int = 5) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, item_id, edits, similarity (1 - edits / words of the item), first_word, end_word: the best place of every item that a document holds with at least that similarity.

    Words are lower-cased (A-Z) runs of anything but ASCII white space. Documents are not shuffled; each task reads whole texts in slices. Every place with that similarity is found, and verified word by word. Items of the benchmark are written in blocks that the tasks read; each block is one more pass over docs. Items of under min_words words (5: the shingle length) match by their exact sequence of words alone; items without words never match. Null or blank texts, null items: no match. Null doc_id or item_id: carried as null. Repeated rows of docs: each has its rows; repeated items: one. Other columns are not read. Empty tables: no rows.
    """
    out = None
    folder, blocks = _write_blocks(benchmark)
    for block in blocks:
        found = bounded_batches(pick(docs, doc_id="long", text="binary")).mapInArrow(_finder(folder, block, similarity, walks, samples, min_words), "doc_id long, item_id long, edits long, similarity double, first_word long, end_word long")
        out = found if out is None else out.unionByName(found)
    return out


def _finder(folder, block, similarity, walks, samples, min_words):
    def run(batches):
        index = Index(_read_block(folder, block), similarity, walks, samples, min_words)
        for b in batches:
            doc_ids, rows = b.column(0).to_pylist(), []
            for at, texts in slices(b.column(1).to_pylist()):
                rows += [(doc_ids[at + t], index.ids[i], edits, 1 - edits / len(index.items[i]), x, y) for t, i, edits, x, y in index.find(texts)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "edits", "similarity", "first_word", "end_word"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, walks: int = 24, samples: int = 3, min_words: int = 5) -> DataFrame:
    """Rows of docs that hold no item, with all their columns, whatever their names. Null, empty and blank texts, repeated rows and null ids stay; texts are read whole. Empty docs: no rows; empty benchmark: all rows."""
    schema = docs.schema
    folder, blocks = _write_blocks(benchmark)
    for block in blocks:

        def run(batches, block=block):
            index = Index(_read_block(folder, block), similarity, walks, samples, min_words)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for at, texts in slices(b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist()):
                    for t, *_ in index.find(texts):
                        keep[at + t] = False
                yield b.filter(pa.array(keep))

        docs = bounded_batches(docs).mapInArrow(run, schema)
    return docs
