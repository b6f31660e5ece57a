"""Benchmark decontamination by SimHash of item-sized windows.

Items fall into size classes; the window of a class holds between three fifths
and four fifths of its items' words, which lets document windows advance by a
stride while every item is indexed at all its offsets: a passage that contains
an item is met at three aligned windows or more.  Windows are fingerprinted by
the words in them (one unchanged word more or less moves few bits), and a
multi-index over four blocks of 16 bits finds every indexed fingerprint within
seven bits: of two that differ in seven, one block differs in one bit at most, and
each block is looked up at its own value and at the 16 beside it.  Each
hit is verified at its alignment: the share of the item's five-word shingles,
each weighed by one over the number of items that hold it and counted as often
as it occurs, that the passage and a small margin contain.

Items are a stated query set: they are read in blocks of at most INDEX_BYTES of
text, each block's index (some 200 bytes a word at most) is a broadcast of its
own, and documents are scanned once for each block.  Documents are never shuffled.

Edge cases: null and blank texts match nothing, as do null and blank items;
items under five words have their whole sequence as one shingle; repeated items
and repeated documents are matched row by row; extra columns pass through
``uncontaminated``; ``matches`` reads ``doc_id`` and ``text`` only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.kernels import shingles, text_slices, word_hashes, words

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 7
BLOCKS = 4
INDEX_BYTES = 2 << 20
SMALL = 8
#: words whose running bit counts are held at a time
PIECE = 1 << 18
#: candidates compared at a time
CANDIDATES = 1 << 20
_BESIDE = np.array([0, *[1 << b for b in range(16)]], np.uint16)


def window_size(n: int) -> int:
    """Words in the windows of an item of ``n`` words: the class sizes grow by 1.3 from SMALL."""
    if n < SMALL:
        return n
    size = SMALL
    while int(size * 1.3) <= 0.8 * n:
        size = int(size * 1.3)
    return size


def window_prints(h: np.ndarray, at: np.ndarray, size: int, sums: np.ndarray | None = None) -> np.ndarray:
    """SimHash of the ``size`` words from each place in ``at``."""
    sums = bit_sums(h, size) if sums is None else sums
    ones = (sums[at + size] - sums[at]) > size // 2
    return np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()


def bit_sums(h: np.ndarray, largest: int) -> np.ndarray:
    """Running counts of each of 64 bits; they wrap, which differences up to ``largest`` survive."""
    kind = np.uint8 if largest < 256 else np.uint32
    out = np.zeros((len(h) + 1, 64), kind)
    bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8), bitorder="little").reshape(-1, 64)
    np.cumsum(bits, axis=0, dtype=kind, out=out[1:])
    return out


class ItemIndex:
    """The items' window fingerprints by class, their multi-index and their weighted shingles."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.lengths = [], []
        bags: list[tuple[np.ndarray, np.ndarray]] = []
        prints: dict[int, list] = {}
        for item_id, text in items:
            buf = np.frombuffer((text or "").encode(), np.uint8)
            starts, ends, first = words(buf, np.array([0, len(buf)]))
            if not len(starts):
                continue
            h = word_hashes(buf, starts, ends)
            s, left = shingles(h, first, SHINGLE)
            k, size = len(self.ids), window_size(len(h))
            self.ids.append(item_id)
            self.lengths.append(len(h))
            bags.append(np.unique(s[: max(1, len(h) - SHINGLE + 1)], return_counts=True))
            offsets = np.arange(len(h) - size + 1)
            prints.setdefault(size, []).append((window_prints(h, offsets, size), np.full(len(offsets), k, np.int32), offsets.astype(np.int32)))
        held, n = np.unique(np.concatenate([b[0] for b in bags]), return_counts=True) if bags else (np.zeros(0, np.uint64), np.zeros(0, int))
        #: each item's distinct shingles in order, how often they occur and their weights
        self.bags = [(x, c, 1.0 / n[np.searchsorted(held, x)]) for x, c in bags]
        self.totals = [float((c * w).sum()) for _, c, w in self.bags]
        self.classes = []
        for size, parts in sorted(prints.items()):
            fp, item, offset = (np.concatenate(p) for p in zip(*parts))
            room = min(self.lengths[k] for k in np.unique(item)) - size + 1
            tables = []
            for block in np.ascontiguousarray(fp).view(np.uint16).reshape(-1, BLOCKS).T:
                order = np.argsort(block, kind="stable").astype(np.int32)
                counts = np.bincount(block, minlength=1 << 16).astype(np.int32)
                beside = np.zeros(1 << 16, bool)
                for flip in _BESIDE:
                    beside[np.flatnonzero(counts) ^ int(flip)] = True
                tables.append((order, counts, np.cumsum(counts, dtype=np.int32) - counts, beside))
            self.classes.append((size, max(1, -(-room // 3)), fp, item, offset, tables))
        self.largest = max((c[0] for c in self.classes), default=1)

    def hits(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (text, item, start) of indexed windows within RADIUS bits of a document window."""
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        begin = first[text]
        left = first[text + 1] - np.arange(len(h))
        place_in_text, found = np.arange(len(h)) - begin, []
        for lo in range(0, len(h), PIECE):
            part = h[lo : lo + PIECE + self.largest]
            sums = bit_sums(part, self.largest)
            near_words = slice(lo, lo + PIECE)
            for size, stride, fp, item, offset, tables in self.classes:
                at = np.flatnonzero((left[near_words] >= size) & (place_in_text[near_words] % stride == 0))
                if not len(at):
                    continue
                for w, e in near_pairs(window_prints(part, at, size, sums), fp, tables):
                    w = lo + at[w]
                    found.append(np.stack([text[w], item[e], w - offset[e]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def matches(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(text, item, first word, word after the last, similarity) of verified matches, the best of each pair."""
        best: dict[tuple[int, int], tuple] = {}
        whole, _ = shingles(h, first, SHINGLE)
        for t, k, start in self.hits(h, first).tolist():
            lo, hi, n = int(first[t]), int(first[t + 1]), self.lengths[k]
            slack = max(2, n // 8)
            a, b = max(lo, start - slack), min(hi, start + n + slack)
            if b <= a:
                continue
            if n >= SHINGLE and b - a >= SHINGLE:
                seen = whole[a : b - SHINGLE + 1]
            else:
                s, _ = shingles(h[a:b], np.array([0, b - a]), min(SHINGLE, n))
                seen = s[: max(1, b - a - min(SHINGLE, n) + 1)]
            keys, counts, weights = self.bags[k]
            have, n_have = np.unique(seen, return_counts=True)
            place = np.minimum(np.searchsorted(have, keys), len(have) - 1)
            shared = float((weights * np.where(have[place] == keys, np.minimum(counts, n_have[place]), 0)).sum())
            value = shared / self.totals[k]
            if value >= THRESHOLD - 1e-12 and (value, -start) > best.get((t, k), (0.0, 0))[:2]:
                best[t, k] = (value, -start, max(start, lo) - lo, min(start + n, hi) - lo)
        return [(t, k, a, b, v) for (t, k), (v, _, a, b) in sorted(best.items())]


def near_pairs(seen: np.ndarray, fp: np.ndarray, tables: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in ``seen``, place in ``fp``) of all pairs within RADIUS bits, some more than once, CANDIDATES at a time."""
    for block, (order, counts, bounds, beside) in zip(seen.view(np.uint16).reshape(-1, BLOCKS).T, tables):
        close = np.flatnonzero(beside[block])
        block = block[close]
        for flip in _BESIDE:
            key = block ^ flip
            n = counts[key]
            some = np.flatnonzero(n)
            low, n = bounds[key[some]].astype(np.int64), n[some].astype(np.int64)
            some = close[some]
            total = np.cumsum(n)
            lo = 0
            while lo < len(some):
                done = total[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(total, done + CANDIDATES, "right")))
                m = n[lo:hi]
                w = np.repeat(some[lo:hi], m)
                e = order[np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[lo:hi], m)]
                near = np.bitwise_count(seen[w] ^ fp[e]) <= RADIUS
                if near.any():
                    yield w[near], e[near]
                lo = hi


def indexes(benchmark: DataFrame, size: int = INDEX_BYTES) -> Iterator[ItemIndex]:
    """Indexes of consecutive blocks of items of at most ``size`` bytes (or one item), read one block at a time."""
    block: list = []
    held = 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        n = len((row[1] or "").encode())
        if block and held + n > size:
            yield ItemIndex(block)
            block, held = [], 0
        block.append((row[0], row[1]))
        held += n
    yield ItemIndex(block)


def _scanned(column: pa.Array, index: ItemIndex) -> Iterator[tuple]:
    for lo, _, buf, offsets in text_slices(column):
        starts, ends, first = words(buf, offsets)
        if len(starts) and index.ids:
            for t, k, a, b, v in index.matches(word_hashes(buf, starts, ends), first):
                yield lo + t, k, a, b, v


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that it contains: doc_id, item_id, word span and similarity."""
    sc = docs.sparkSession.sparkContext
    out = None
    for index in indexes(benchmark):
        shared = sc.broadcast(index)

        def scan(batches, shared=shared):
            for batch in batches:
                rows = list(_scanned(batch.column("text"), shared.value))
                t = pa.array([r[0] for r in rows], pa.int64())
                ids = pa.array([shared.value.ids[r[1]] for r in rows], pa.int64())
                rest = [pa.array([r[j] for r in rows], kind) for j, kind in ((2, pa.int64()), (3, pa.int64()), (4, pa.float64()))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(t), ids, *rest], ["doc_id", "item_id", "first_word", "end_word", "similarity"]
                )

        kinds = "doc_id long, item_id long, first_word long, end_word long, similarity double"
        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, kinds)
        out = part if out is None else out.unionByName(part)
    return out


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no item, with the columns they came with."""
    sc = docs.sparkSession.sparkContext
    names = docs.columns
    # plain names on the way: those of the input may hold dots
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index('text')}"
    for index in indexes(benchmark):
        shared = sc.broadcast(index)

        def keep(batches, shared=shared):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row in _scanned(batch.column(text), shared.value):
                    clean[row[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs.toDF(*names)
