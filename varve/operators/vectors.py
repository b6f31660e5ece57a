"""Pairs of vectors and of sets: rows are dealt to blocks, two blocks meet in one task, and their Arrow batches are compared by matrix products.

A task holds the left block of a tile and passes the right one by, so its memory is
that of one block and of a slice of pairs, whatever the tables hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.session import durable

#: rows of a block; pairs that a task looks at together
SIDE = 4096
PAIRS = 1 << 18
#: squared distances under this share of the squared lengths are taken from the differences themselves
CLOSE = 0.05


@dataclass
class Rows:
    """Some rows of one side of a tile: ids, vectors (zero where unknown or beyond the end), what is known of them, and the rows known whole."""

    ids: pa.Array
    v: np.ndarray
    known: np.ndarray
    whole: np.ndarray

    def slices(self, others: int) -> Iterator[Rows]:
        step = max(1, PAIRS // max(others, 1))
        for k in range(0, len(self.ids), step):
            yield Rows(self.ids.slice(k, step), self.v[k : k + step], self.known[k : k + step], self.whole[k : k + step])


def _rows(table: pa.Table) -> Rows:
    lists = table.column("v").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    width = int(sizes.max(initial=0))
    at = np.arange(width) < sizes[:, None]
    v, known = np.zeros(at.shape), np.zeros(at.shape, bool)
    known[at] = flat.is_valid().to_numpy(zero_copy_only=False)
    v[at] = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
    ids = table.column("id").combine_chunks()
    return Rows(ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, v, known, known.all(1) & np.isfinite(v).all(1))


def _widened(rows: Rows, width: int) -> Rows:
    if rows.v.shape[1] == width:
        return rows
    more = ((0, 0), (0, width - rows.v.shape[1]))
    return Rows(rows.ids, np.pad(rows.v, more), np.pad(rows.known, more), np.zeros(len(rows.ids), bool))


def _tile_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[list, pa.RecordBatch]]:
    """(values of the keys, rows) of the stretches of equal keys in each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for name in keys:
            c = batch.column(name)
            change |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cut[:-1], cut[1:]):
            yield [batch.column(name)[lo].as_py() for name in keys], batch.slice(lo, hi - lo)


def met(left: DataFrame, right: DataFrame, by: Sequence[str], compare: Callable[[Rows, Rows], Iterator[tuple]], schema: str, side: int = SIDE, read: Callable = _rows, cols: Sequence[str] = ()) -> DataFrame:
    """What ``compare`` makes of every two blocks of left and right rows (``by``, id, v, ``cols``) that are equal in ``by``: arrays of the columns of ``schema``, after those of ``by``."""
    by = list(by)
    for c in by:
        left, right = left.filter(F.col(c).isNotNull()), right.filter(F.col(c).isNotNull())
    a = left.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / side).cast("int").alias("__bl"))
    b = right.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / side).cast("int").alias("__br"))
    equal = lambda p: reduce(lambda x, y: x & y, [F.col(c) == F.col(f"{p}{c}") for c in by], F.lit(True))
    b = b.select(*[F.col(c).alias(f"__{c}") for c in by], "__br")
    sizes = durable(a.join(b, equal("__")).select(*[F.col(c).alias(f"__g_{c}") for c in by], "__bl", "__br").filter("__bl > 0 AND __br > 0"))
    tiles = sizes.agg(F.sum(F.col("__bl").cast("long") * F.col("__br"))).first()[0] or 0
    hashed = lambda p: F.xxhash64(F.lit(6), *[F.col(f"{p}{c}") for c in by])

    def dealt(df: DataFrame, number: int) -> DataFrame:
        df = df.join(sizes, (hashed("") == hashed("__g_")) & equal("__g_")) if by else df.crossJoin(F.broadcast(sizes))
        own, other = ("__bl", "__br")[:: 1 - 2 * number]
        names = ("__i", "__j")[:: 1 - 2 * number]
        block = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        return df.select(*by, "id", "v", *cols, F.lit(number).alias("__side"), block.alias(names[0]), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(names[1]))

    keys = [*by, "__i", "__j"]
    rows = dealt(left, 0).unionByName(dealt(right, 1)).repartition(max(1, min(2 * tiles, 4096)), *keys).sortWithinPartitions(*keys, "__side")
    kinds = [(f.name, f.dataType.simpleString()) for f in left.select(*by).schema.fields]
    schema = ", ".join([*[f"`{n}` {k}" for n, k in kinds], schema])
    names = None if not schema else [s.strip().split(" ")[0].strip("`") for s in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, block = None, [], None
        for key, batch in _tile_runs(batches, keys):
            if key != tile:
                tile, held, block = key, [], None
            second = pc.equal(batch.column("__side"), 1)
            if block is None:
                held.append(batch.filter(pc.invert(second)))
            batch = batch.filter(second)
            if not batch.num_rows:
                continue
            if block is None:
                block = read(pa.Table.from_batches(held))
                held = []
            for out in compare(block, read(pa.Table.from_batches([batch]))):
                fixed = [pa.array([value], batch.column(c).type).take(pa.array(np.zeros(len(out[0]), np.int64))) for c, value in zip(by, key)]
                yield pa.RecordBatch.from_arrays([*fixed, *out], names)

    return rows.mapInArrow(run, schema)


def _apart(u: np.ndarray, v: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Distances of rows of equal shape over what is known of both; no number where nothing is."""
    with np.errstate(invalid="ignore", over="ignore"):
        d = np.sqrt(np.where(both, (u - v) ** 2, 0.0).sum(-1))
    return d


def distances(left: DataFrame, right: DataFrame, key: str, vector: str, digits: int, side: int = SIDE) -> DataFrame:
    """(i, j, distance): Euclidean distances, rounded, of every left to every right row of another key, over the elements that both have; null where they have none."""

    def compare(a: Rows, every: Rows) -> Iterator[tuple]:
        width = max(a.v.shape[1], every.v.shape[1])
        a, every = _widened(a, width), _widened(every, width)
        uu = (a.v * a.v).sum(1)
        for b in every.slices(len(a.ids)):
            with np.errstate(invalid="ignore", over="ignore"):
                sizes = uu[:, None] + (b.v * b.v).sum(1)
                square = sizes - 2 * (a.v @ b.v.T)
                d = np.sqrt(np.maximum(square, 0.0))
            none = np.zeros(d.shape, bool)
            sure = a.whole[:, None] & b.whole & (square >= CLOSE * sizes)
            p, q = np.nonzero(~sure)
            for k in range(0, len(p), PAIRS // 64):
                r, c = p[k : k + PAIRS // 64], q[k : k + PAIRS // 64]
                both = a.known[r] & b.known[c]
                d[r, c] = _apart(a.v[r], b.v[c], both)
                none[r, c] = ~both.any(1)
            scale = 10.0**digits
            d = np.where(np.isfinite(d * scale), np.floor(d * scale + 0.5) / scale, d)
            i, j = a.ids.take(pa.array(np.repeat(np.arange(len(a.ids)), len(b.ids)))), b.ids.take(pa.array(np.tile(np.arange(len(b.ids)), len(a.ids))))
            use = pc.not_equal(i, j)
            yield tuple(x.filter(use) for x in (i, j, pa.array(d.ravel(), mask=none.ravel())))

    kind = left.schema[key].dataType.simpleString()
    sides = [df.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v")) for df in (left, right)]
    return met(*sides, [], compare, f"i {kind}, j {kind}, distance double", side)


def _known(df: DataFrame, key: str, vector: str, by: Sequence[str]) -> DataFrame:
    """(by, length, id, v) of the rows whose vectors are known whole."""
    v = F.col(vector)
    return df.filter(v.isNotNull() & ~F.exists(v, lambda x: x.isNull())).select(*by, F.size(v).alias("__length"), F.col(key).alias("id"), v.alias("v"))


def alike(left: DataFrame, right: DataFrame, key: str, vector: str, threshold: float, by: Sequence[str] = (), side: int = SIDE) -> DataFrame:
    """(``by``, i, j, similarity): the pairs, equal in ``by`` and of equal length, whose cosine is at least ``threshold``; vectors without length match nothing."""

    def compare(a: Rows, every: Rows) -> Iterator[tuple]:
        uu = (a.v * a.v).sum(1)
        for b in every.slices(len(a.ids)):
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                c = (a.v @ b.v.T) / np.sqrt(uu[:, None] * (b.v * b.v).sum(1))
            i, j = np.nonzero(c >= threshold - 1e-12)
            if len(i):
                yield a.ids.take(pa.array(i)), b.ids.take(pa.array(j)), pa.array(c[i, j])

    kind = left.schema[key].dataType.simpleString()
    sides = [_known(df, key, vector, by) for df in (left, right)]
    return met(*sides, [*by, "__length"], compare, f"i {kind}, j {kind}, similarity double", side).drop("__length")


def with_alike(left: DataFrame, right: DataFrame, key: str, vector: str, threshold: float, by: Sequence[str] = (), side: int = SIDE) -> DataFrame:
    """Keys of the left rows that some right row, equal in ``by`` and of equal length, has a cosine of at least ``threshold`` with; vectors without length match all."""

    def compare(b: Rows, every: Rows) -> Iterator[tuple]:
        vv = (b.v * b.v).sum(1)
        step = max(1, min(len(b.ids), 1024))
        for a in every.slices(step):
            uu, open_ = (a.v * a.v).sum(1), np.arange(len(a.ids))
            for k in range(0, len(b.ids), step):
                with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                    c = (a.v[open_] @ b.v[k : k + step].T) / np.sqrt(uu[open_, None] * vv[k : k + step])
                open_ = open_[~((c >= threshold) | np.isnan(c)).any(1)]
                if not len(open_):
                    break
            found = np.ones(len(a.ids), bool)
            found[open_] = False
            yield (a.ids.filter(pa.array(found)),)

    kind = left.schema[key].dataType.simpleString()
    sides = [_known(df, key, vector, by) for df in (right, left)]
    return met(*sides, [*by, "__length"], compare, f"id {kind}", side).select("id").distinct()


def _members(tables: Sequence[pa.Table], members: int) -> Iterator[list[np.ndarray]]:
    """0/1 matrices of the sets ``v`` of each table, some members at a time."""
    lists = [t.column("v").combine_chunks() for t in tables]
    lists = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in lists]
    coded = pa.chunked_array([x.flatten() for x in lists]).dictionary_encode().unify_dictionaries()
    codes = [c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks]
    rows = [np.repeat(np.arange(len(x)), pc.list_value_length(x).to_numpy(zero_copy_only=False)) for x in lists]
    most = max((int(c.max(initial=-1)) for c in codes), default=-1) + 1
    for lo in range(0, most, members):
        out = []
        for x, code, row in zip(lists, codes, rows):
            m = np.zeros((len(x), min(members, most - lo)), np.float32)
            use = (code >= lo) & (code < lo + members)
            m[row[use], code[use] - lo] = 1
            out.append(m)
        yield out


def meeting(a: DataFrame, b: DataFrame, key: str, member: str, side: int = SIDE, members: int = 1024) -> DataFrame:
    """(key, n): for each key of ``a`` the keys of ``b`` with which it shares a member, from rows (key, member) of either.

    Keys of equal sets are one class, and only classes meet, block by block; so the
    work grows with the square of the different sets at most, and no pair is written.
    """

    def sets(df: DataFrame) -> DataFrame:
        df = df.select(F.col(key).alias("key"), F.col(member).alias("member")).dropna()
        return df.groupBy("key").agg(F.array_sort(F.collect_set("member")).alias("v"))

    def compare(x: pa.Table, every: pa.Table) -> Iterator[tuple]:
        for k in range(0, every.num_rows, PAIRS // side):
            y = every.slice(k, PAIRS // side)
            shared = np.zeros((x.num_rows, y.num_rows), np.float32)
            for p, q in _members((x, y), members):
                shared += p @ q.T
            hits = (shared > 0) @ y.column("n").to_numpy()
            use = hits > 0
            yield x.column("id").combine_chunks().filter(pa.array(use)), pa.array(hits[use])

    mine = sets(a)
    classes = mine.groupBy("v").agg(F.min("key").alias("id"), F.lit(0).cast("long").alias("n"))
    theirs = sets(b).groupBy("v").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("n"))
    kind = a.schema[key].dataType.simpleString()
    hits = met(classes, theirs, [], compare, f"id {kind}, n long", side, lambda t: t, ["n"]).groupBy("id").agg(F.sum("n").alias("n"))
    known = classes.select(F.col("v").alias("w"), "id").join(hits.select(F.col("id").alias("of"), "n"), F.col("id") == F.col("of"), "left").select("w", F.coalesce("n", F.lit(0)).alias("n"))
    on = (F.xxhash64("v", F.lit(7)) == F.xxhash64("w", F.lit(7))) & (F.col("v") == F.col("w"))
    return mine.join(known, on).select(F.col("key").alias(key), "n")
