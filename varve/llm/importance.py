"""Importance resampling towards a target distribution, by hashed word features counted in partition-local tries.

Features are all runs of one to three words; a feature's bucket is the CRC-32 of
its bytes modulo BUCKETS.  A task keeps a trie whose paths are the runs of its own
texts.  A node holds how often its run occurred and the CRC state of its bytes; a
child's state follows from its parent's, from the CRC of the added word and from
the number of added bytes, so a run's bytes are never put together.  Tasks add
their nodes into bucket totals, at most BUCKETS rows each, which meet in one
grouped sum.  A bucket's gain compares its share of the target with its share of
the raw corpus.  In the second pass nodes hold the gain of their bucket and a
document's weight is the sum of gains along the paths that its words walk.

A trie is emptied into the totals and begun anew at NODES nodes, and a text is
walked in pieces, so memory is bounded whatever a task or a text holds.

Drawing the best scores is one range shuffle of narrow rows.  A row's place in its
range and the sizes of the ranges before it make its rank, so no task sees more
than a range, and undrawn documents need no join.

Edge cases: null, empty and wordless texts have no features and weight zero; equal
scores go by ``doc_id``, a null one last; repeated rows score alike and take
adjacent ranks; an empty target or corpus counts zero in every bucket; no
documents give no rows.  ``resampled`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from varve.llm.durable import bounded, durable
from varve.llm.kernels import distinct, distinct_words, lowered, text_slices, words

BUCKETS = 10_000
DEPTH = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
NODES = 1 << 21
SLICE = 4 << 20
#: words walked at a time
PIECE = 1 << 19
#: ranges of documents whose sizes are broadcast, one row each
RANGES = 1_000_000

#: digits, letters and all bytes of characters beyond ASCII; texts are folded first
_INNER = np.zeros(256, bool)
_INNER[48:58] = _INNER[97:123] = _INNER[128:] = True
_WORD = np.int64((1 << 32) - 1)


def _crc_table() -> np.ndarray:
    """What each byte adds to a CRC-32 (reflected polynomial 0xEDB88320)."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def _zero_bytes() -> list[np.ndarray]:
    """Tables that carry a CRC over 1, 2, 4, ... zero bytes."""
    parts = [np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)]
    out = [np.stack([_crc_table(), *[np.arange(256, dtype=np.uint32) << np.uint32(8 * (j - 1)) for j in (1, 2, 3)]])]
    while len(out) < 32:
        out.append(np.stack([_apply(out[-1], _apply(out[-1], p)) for p in parts]))
    return out


_ZEROS = _zero_bytes()


def crc_after(crc: np.ndarray, added: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC of strings with CRC ``crc`` followed by ``sizes`` bytes whose own CRC is ``added``."""
    crc = crc.copy()
    for k in range(int(sizes.max(initial=0)).bit_length()):
        some = np.flatnonzero(sizes >> k & 1)
        crc[some] = _apply(_ZEROS[k], crc[some])
    return crc ^ added


class Level:
    """Nodes of one depth: the key (parent, word) in order, and by node its CRC state, its count and its gain."""

    def __init__(self):
        self.keys, self.nodes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.crc, self.count, self.gain = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def grow(self, crc: np.ndarray, gains: np.ndarray | None) -> None:
        self.crc = np.concatenate([self.crc, crc])
        if gains is None:
            self.count = np.concatenate([self.count, np.zeros(len(crc), np.int64)])
        else:
            self.gain = np.concatenate([self.gain, gains[crc % BUCKETS]])


class WordTrie:
    """All runs of one to DEPTH words that were walked; with ``gains`` nodes hold these instead of counts."""

    def __init__(self, gains: np.ndarray | None = None):
        self.gains = gains
        self.clear()

    def clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.added, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.levels = [Level() for _ in range(DEPTH)]

    def __len__(self) -> int:
        return sum(len(x.crc) for x in self.levels)

    def intern(self, found: list[bytes]) -> np.ndarray:
        """The numbers of words; those not met before become nodes of depth one."""
        known = len(self.words)
        out = np.array([self.words.setdefault(w, len(self.words)) for w in found], np.int64)
        fresh = [w for w, k in zip(found, out.tolist()) if k >= known]
        if fresh:
            self.levels[0].grow(np.array([zlib.crc32(w) for w in fresh], np.uint32), self.gains)
            self.added = np.concatenate([self.added, np.array([zlib.crc32(b" " + w) for w in fresh], np.uint32)])
            self.sizes = np.concatenate([self.sizes, np.array([len(w) + 1 for w in fresh], np.int64)])
        return out

    def children(self, depth: int, parents: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of distinct (parent, word) and for each place which of them it is; what is new is added."""
        level, above = self.levels[depth], self.levels[depth - 1]
        keys, which = distinct(parents << 32 | word)
        at = np.minimum(np.searchsorted(level.keys, keys), max(0, len(level.keys) - 1))
        have = level.keys[at] == keys if len(level.keys) else np.zeros(len(keys), bool)
        nodes = np.empty(len(keys), np.int64)
        nodes[have] = level.nodes[at[have]]
        fresh = keys[~have]
        nodes[~have] = np.arange(len(level.crc), len(level.crc) + len(fresh))
        last = fresh & _WORD
        level.grow(crc_after(above.crc[fresh >> 32], self.added[last], self.sizes[last]), self.gains)
        keys = np.concatenate([level.keys, fresh])
        order = np.argsort(keys, kind="stable")
        level.keys, level.nodes = keys[order], np.concatenate([level.nodes, nodes[~have]])[order]
        return nodes, which

    def walk(self, word: np.ndarray, left: np.ndarray, n: int) -> np.ndarray | None:
        """Walks the runs from each of the first ``n`` words on; ``left`` words of its text follow it, itself included.

        Returns the gain that starts at each place, or counts.
        """
        total = None if self.gains is None else self.levels[0].gain[word[:n]]
        if self.gains is None:
            self.levels[0].count += np.bincount(word[:n], minlength=len(self.levels[0].crc))
        at, parents = np.arange(n), word[:n]
        for depth in range(1, DEPTH):
            on = left[at] > depth
            at, parents = at[on], parents[on]
            nodes, which = self.children(depth, parents, word[at + depth])
            level = self.levels[depth]
            if total is None:
                level.count[nodes] += np.bincount(which, minlength=len(nodes))
            else:
                total[at] += level.gain[nodes][which]
            parents = nodes[which]
        return total

    def totals(self) -> np.ndarray:
        """The counts of all nodes by bucket."""
        return sum(np.bincount(x.crc % BUCKETS, weights=x.count, minlength=BUCKETS) for x in self.levels).astype(np.int64)


def walked(column: pa.Array, trie: WordTrie, full=None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
    """Walks a column of texts: (first row, last row + 1, words of each text, gain of each text) of slices.

    ``full`` is called before a trie of NODES nodes is cleared.
    """
    for lo, hi, buf, offsets in text_slices(column, SLICE):
        buf = lowered(buf)
        starts, ends, first = words(buf, offsets, _INNER)
        counts = np.diff(first)
        gain = None if trie.gains is None else np.zeros(hi - lo, np.int64)
        left = np.repeat(first[1:], counts) - np.arange(len(starts))
        text = np.repeat(np.arange(hi - lo), counts)
        for a in range(0, len(starts), PIECE):
            b = min(len(starts), a + PIECE)
            more = min(len(starts), b + DEPTH - 1)
            if len(trie) > NODES:
                if full:
                    full()
                trie.clear()
            found, which = distinct_words(buf[starts[a] : ends[more - 1]], starts[a:more] - starts[a], ends[a:more] - starts[a])
            got = trie.walk(trie.intern(found.to_pylist())[which], left[a:more], b - a)
            if got is not None:
                own = text[a:b]
                cuts = np.flatnonzero(np.diff(own, prepend=-1))
                gain[own[cuts]] += np.add.reduceat(got, cuts)
        yield lo, hi, counts, gain


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches):
        trie, held = WordTrie(), np.zeros(BUCKETS, np.int64)

        def empty():
            held[:] += trie.totals()

        for batch in batches:
            for _ in walked(batch.column(0), trie, empty):
                pass
        empty()
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows.collect():  # at most BUCKETS rows
        out[bucket] = n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of a bucket's smoothed share of the target over its smoothed share of the raw corpus."""
    s, t = float(raw.sum()), float(target.sum())
    ratios = (target + 1.0) * (s + BUCKETS) / ((raw + 1.0) * (t + BUCKETS))
    return np.array([math.floor(1000 * math.log(x)) for x in ratios.tolist()], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel draw of a document, from the first 32 bits of a SHA-256, in thousandths."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """``docs`` with four columns at the end, n_words, n_features, weight and score, under names c0, c1, ... for its own."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: own[i] for i, c in enumerate(docs.columns)}
    safe = docs.toDF(*own)
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    text = own.index(at["text"])

    def weigh(batches):
        trie = WordTrie(shared.value)
        for batch in batches:
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for lo, hi, counts, gain in walked(batch.column(text), trie):
                n[lo:hi], weight[lo:hi] = counts, gain
            features = sum(np.maximum(n - k, 0) for k in range(DEPTH))
            added = [pa.array(x) for x in (n, features, weight)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*own, "n_words", "n_features", "weight"])

    kinds = StructType([*safe.schema.fields, *[StructField(c, LongType()) for c in ("n_words", "n_features", "weight")]])
    return safe.mapInArrow(weigh, kinds).withColumn("score", F.col("weight") + noise(F.col(at["doc_id"])))


def target_gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket, from all texts of both tables."""
    return bucket_gains(bucket_counts(docs), bucket_counts(target))


def ranked(docs: DataFrame, gains: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; undrawn ones have no rank."""
    df = scored(docs.select("doc_id", "text"), gains).select(F.col("c0").alias("doc_id"), "n_words", "n_features", "weight", "score")
    df = durable(df)
    drawable = F.col("n_words") >= LEAST_WORDS
    order = [F.coalesce(drawable, F.lit(False)).desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = durable(placed)
    inside = F.lit(1 << 33)
    sizes = placed.groupBy((F.col("place") / inside).cast("long").alias("range")).agg(F.count(F.lit(1)).alias("n"), F.count_if(drawable).alias("drawable"))
    whole = sizes.agg(F.sum("drawable").alias("N"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("range").alias("__range"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    sizes, _ = bounded(sizes.crossJoin(F.broadcast(whole)), RANGES)
    df = placed.join(sizes, (F.col("place") / inside).cast("long") == F.col("__range"))
    place = F.col("__before") + F.col("place") % inside + 1
    rank = F.when(place <= F.floor(F.col("N") * percent / 100), place).cast("long")
    return df.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The drawn documents with the columns they came with, read once more and compared with the last one drawn: texts meet no shuffle.

    Rows that equal the last one in score and id are all kept.
    """
    gains = target_gains(docs, target)
    last = ranked(docs, gains, percent).agg(F.max_by(F.struct("score", "doc_id"), "rank")).first()[0]
    df = scored(docs, gains)
    doc_id = F.col(f"c{docs.columns.index('doc_id')}")
    if last is None:
        return docs.limit(0)
    above = F.col("score") > last["score"]
    level = F.col("score") == last["score"]
    known = F.lit(True) if last["doc_id"] is None else doc_id <= F.lit(last["doc_id"])
    kept = df.filter((F.col("n_words") >= LEAST_WORDS) & (above | level & known))
    return kept.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
