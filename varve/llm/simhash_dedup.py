"""SimHash near-dedup by anchor-point covering.

Fingerprints within three bits differ by at most one bit in one of their 32-bit
halves.  The first 31 bits of a half are covered by the words of the perfect
Hamming code, whose covering radius is one: every value is within one bit of an
anchor, and a value one bit further is within two.  Each distinct fingerprint is
therefore replicated to every anchor within two bits of either half (one or 16
anchors a half), and any two that must be linked meet at the anchor of either.

Fingerprints are compared per anchor; anchors that hold many are cut into
square tiles, each two blocks of fingerprints, so no task holds more than two
blocks.  A tile returns the edges of a spanning forest of its exact links, never
all pairs; components are then contracted by ``components``.

Edge cases: a null or blank text has fingerprint zero and links like any other;
fewer words than a shingle make one shingle; equal texts, repeated rows and tied
fingerprints meet before anchors as one fingerprint; a null ``doc_id`` takes the
least other id of its component, null if there is none; no rows give no rows.
Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.components import components
from varve.llm.durable import bounded, durable
from varve.llm.words import unused

SHINGLE = 3
RADIUS = 3
BLOCK = 2048
PIECE = 1 << 16
FEW = 500_000


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of the word shingles of a text, each as often as it occurs."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - SHINGLE + 1)
    ends = np.cumsum([len(t) for t in tokens]) + np.arange(len(tokens))
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(SHINGLE, len(tokens)) - 1 :].tolist()
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, PIECE):
        span = range(lo, min(n, lo + PIECE))
        h = np.fromiter((digest(joined[starts[i] : ends[i]], 42) for i in span), np.uint64, len(span))
        bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(values)], ["doc_id", "text_hash", "fp"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fingerprint (as a long) of every document."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return df.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def anchors_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``fp``, anchor) for every anchor within two bits of either half."""
    places = np.arange(1, 32, dtype=np.uint32)
    low = np.triu(np.bitwise_xor.outer(places, places), 1)  # low[i, j]: syndrome of flipping both
    at, keys = [], []
    for half in (0, 1):
        v = ((fp >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)).astype(np.uint32)
        s = np.zeros(len(v), np.uint32)
        for p in places:
            s ^= np.where((v >> (p - 1)) & 1, p, np.uint32(0))
        for syndrome in range(32):
            rows = np.flatnonzero(s == syndrome)
            if not len(rows):
                continue
            flips = [1 << (syndrome - 1) if syndrome else 0]
            if syndrome:
                flips += [1 << (int(places[i]) - 1) | 1 << (int(places[j]) - 1) for i, j in zip(*np.nonzero(low == syndrome))]
            for f in flips:
                at.append(rows)
                keys.append((v[rows] ^ np.uint32(f)).astype(np.int64) | half << 31)
    return np.concatenate(at or [np.zeros(0, np.int64)]), np.concatenate(keys or [np.zeros(0, np.int64)])


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        at, keys = anchors_of(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[at])], ["anchor", "fp"])


def forest(fp: np.ndarray, radius: int = RADIUS) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the graph that links values within ``radius`` bits."""
    rest = np.unique(fp)
    left, right = [], []
    queue: list = []
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
            continue
        x = queue.pop()
        near = np.bitwise_count(rest ^ x) <= radius
        if near.any():
            found = rest[near]
            rest = rest[~near]
            queue.extend(found)
            left.extend([x] * len(found))
            right.extend(found)
    return left, right


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        us, vs = [], []
        for group in batch.column("fps"):
            u, v = forest(group.values.to_numpy(zero_copy_only=False).view(np.uint64))
            us.extend(u)
            vs.extend(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (us, vs)], ["u", "v"]
        )


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` that connect all within RADIUS bits."""
    rows = distinct.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    shared = rows.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    shared = shared.select(F.col("anchor").alias("a"), F.ceil(F.col("n") / BLOCK).cast("int").alias("t"))
    met = rows.join(shared, (F.xxhash64("anchor") == F.xxhash64("a")) & (F.col("anchor") == F.col("a")))
    own = F.pmod(F.xxhash64("fp"), F.col("t")).cast("int")
    met = met.withColumn("b", own).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    tiles = met.groupBy("anchor", F.least("b", "k").alias("i"), F.greatest("b", "k").alias("j"))
    return tiles.agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_compare, "u long, v long").distinct()


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with their fingerprints, distinct fingerprints with their component's least document)."""
    base = durable(fingerprints(docs))
    distinct = durable(base.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")))
    linked = components(links(distinct)).select(F.col("node").alias("fp"), "label")
    merged = distinct.join(linked, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = merged.groupBy("label").agg(F.min("first").alias("keeper")).withColumnRenamed("label", "l")
    merged = merged.join(least, (F.xxhash64("label") == F.xxhash64("l")) & (F.col("label") == F.col("l"))).select(F.col("fp").alias("f"), "keeper")
    return base, durable(merged)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    base, merged = classes(docs)
    df = base.join(merged, (F.xxhash64("fp") == F.xxhash64("f")) & (F.col("fp") == F.col("f")))
    return df.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("keeper.doc_id").alias("component_id")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the least id, with the columns it came with.

    The keys of rows that go, and of those that stand more than once, are the
    smaller side: up to FEW of them are broadcast and texts stay where they are;
    beyond that both sides are shuffled.
    """
    base, merged = classes(docs)
    own, key, once = unused(docs.columns, "__own", "__key", "__once")
    keys = base.join(merged, (F.xxhash64("fp") == F.xxhash64("f")) & (F.col("fp") == F.col("f")))
    keeper = F.xxhash64("keeper.doc_id", "keeper.text_hash")
    keys = keys.groupBy(F.xxhash64("doc_id", "text_hash").alias(key)).agg(F.max(F.xxhash64("doc_id", "text_hash") == keeper).alias("stays"), F.count(F.lit(1)).alias("n"))
    odd, _ = bounded(keys.filter("not stays or n > 1"), FEW)
    keyed = docs.withColumn(own, F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))))
    kept = keyed.join(odd.select(key), F.col(own) == F.col(key), "left_anti")
    repeated = odd.filter("stays").select(F.col(key).alias(once))
    if not repeated.isEmpty():
        kept = kept.unionByName(keyed.join(repeated, F.col(own) == F.col(once), "left_semi").dropDuplicates([own]))
    return kept.select(*[f"`{c}`" for c in docs.columns])
