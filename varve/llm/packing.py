"""Packing documents into windows of tokens, each window filled with documents alike by BM25.

A document is encoded once.  Its whole windows are sequences of their own; the
rest of each document is packed with others.  Rests are ordered by the terms that
stand first in a fixed random order weighted by inverse document frequency, so
that documents alike lie close together, and dealt into ranges; the rows of a range
are cut into shards of at most SHARD documents.  A shard is an inverted index with
BM25 weights from corpus-wide statistics (terms are token ids, so there is a row of
statistics for each id of the vocabulary).  The first document seeds a window, and
its unused neighbours join in order of their score for the seed until the window
is full; the one that does not fit is cut, and what is left of it seeds the next.
What a shard has left at its end, less than a window, is cut into sequences of
powers of two, which need no padding either.

A shard is all that a task holds, whatever the corpus; documents that are equal or
have no term in common with any other are dealt by a hash of their ids.

Edge cases: a null or empty text is the end mark alone; a null ``doc_id`` is kept;
repeated rows are packed each for itself; an empty table gives no rows; other
columns are not read; a very long text is encoded as one slice.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.durable import durable
from varve.llm.kernels import mix, packed_numbers, spans, text_slices, unpacked_numbers
from varve.llm.tokens import word_encoder, word_table

WINDOW = 4096
END = 2
SHARD = 1024
#: fixed values: the usual saturation and length weights of BM25
K1, B = 1.2, 0.75
SLICE = 8 << 20
#: pieces returned at a time
ROWS = 4096

#: a row is a whole window (crc known), a rest (ids known) or, without length, how many of a task's documents hold each id
_ENCODED = "doc_id long, doc_tokens long, start long, length long, ids_crc32 long, sequence long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def crc32(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian 32-bit numbers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def _rows(columns: list[list], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, (_, k) in zip(columns, schema)], [n for n, _ in schema])


def encoded(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """Whole windows and rests of all documents, and each task's document frequencies of ids among its rests."""
    schema = [(c, pa.int64()) for c in ("doc_id", "doc_tokens", "start", "length", "ids_crc32", "sequence")] + [("ids", pa.binary())]

    def run(batches):
        table, vocabulary = word_table(path), word_encoder(path).tokenizer.get_vocab_size()
        last = np.zeros(vocabulary, np.int64)
        held, sequence = np.zeros(vocabulary, np.int64), TaskContext.get().partitionId() << 32
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for lo, hi, buf, offsets in text_slices(batch.column(1), SLICE):
                ids, first = table.encode(buf, offsets)
                rows: list[tuple] = []
                for k in range(hi - lo):
                    own = np.append(ids[first[k] : first[k + 1]], np.uint32(end))
                    n, whole = len(own), len(own) // window * window
                    for at in range(0, whole, window):
                        part = own[at : at + window]
                        rows.append((doc_ids[lo + k], n, at, window, crc32(part), sequence, packed_numbers(part) if with_ids else None))
                        sequence += 1
                    if n > whole:
                        rows.append((doc_ids[lo + k], n, whole, n - whole, None, None, packed_numbers(own[whole:])))
                        rest = own[whole:]
                        at = np.arange(len(rest))
                        last[rest] = at
                        held[rest[last[rest] == at]] += 1  # each id where it stands last
                yield _rows([list(c) for c in zip(*rows)], schema)
        if held.any():
            yield _rows([[None], [None], [None], [None], [None], [None], [packed_numbers(held)]], schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ENCODED)


def frequencies(rows: DataFrame, vocabulary: int) -> np.ndarray:
    """How many rests hold each id, from the tasks' own counts; at most one row an id reaches the driver."""

    def add(batches):
        held = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                held += unpacked_numbers(packed, vocabulary)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["term", "n"])

    counts = rows.filter("length IS NULL").select("ids").mapInArrow(add, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(vocabulary, np.int64)
    for term, n in counts.collect():
        out[term] = n
    return out


def inverse_frequency(held: np.ndarray, documents: int) -> np.ndarray:
    return np.log1p((documents - held + 0.5) / (held + 0.5))


def term_order(idf: np.ndarray) -> np.ndarray:
    """The place of each term in a random order in which a term comes early in proportion to its weight."""
    u = (mix(np.arange(1, len(idf) + 1, dtype=np.uint64)) >> np.uint64(11)).astype(float) / (1 << 53)
    order = np.argsort(-np.log(np.maximum(u, 1e-300)) / np.maximum(idf, 1e-9), kind="stable")
    out = np.empty(len(idf), np.int64)
    out[order] = np.arange(len(idf))
    return out


class ShardIndex:
    """Postings of a shard: for each term the documents that hold it and their BM25 weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        sizes = np.array([len(d) for d in docs], np.int64)
        keys, tf = np.unique(np.repeat(np.arange(len(docs)), sizes) * len(idf) + np.concatenate(docs).astype(np.int64), return_counts=True)
        doc, term = keys // len(idf), keys % len(idf)
        self.documents = len(docs)
        self.bounds = np.searchsorted(doc, np.arange(len(docs) + 1))
        self.terms = term
        order = np.argsort(term, kind="stable")
        self.holders = doc[order]
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean))
        self.weights = weight[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(idf)))])

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every document of the shard for the terms of one of them."""
        own = self.terms[self.bounds[seed] : self.bounds[seed + 1]]
        at = spans(self.starts[own], self.starts[own + 1] - self.starts[own])
        return np.bincount(self.holders[at], weights=self.weights[at], minlength=self.documents)


def fill(index: ShardIndex, lengths: np.ndarray, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length); all are full but the last."""
    left, begin = lengths.copy(), np.zeros(len(lengths), np.int64)
    seed = 0
    while seed is not None:
        scores = index.scores(seed)
        scores[seed] = np.inf
        unused = np.flatnonzero(left)
        pieces, room, cut = [], window, None
        for k in unused[np.argsort(-scores[unused], kind="stable")].tolist():
            take = min(int(left[k]), room)
            pieces.append((k, int(begin[k]), take))
            begin[k] += take
            left[k] -= take
            room -= take
            if not room:
                cut = k if left[k] else None
                break
        yield pieces
        rest = np.flatnonzero(left)
        seed = cut if cut is not None else int(rest[0]) if len(rest) else None


def powers_of_two(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Pieces dealt into sequences whose sizes are the powers of two in their sum, largest first."""
    total = sum(n for _, _, n in pieces)
    queue = list(reversed(pieces))
    while total:
        size = 1 << total.bit_length() - 1
        total -= size
        out = []
        while size:
            k, start, n = queue.pop()
            take = min(n, size)
            out.append((k, start, take))
            size -= take
            if n > take:
                queue.append((k, start + take, n - take))
        yield out


def sequences_of(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """All sequences of one shard."""
    lengths = np.array([len(d) for d in docs], np.int64)
    for pieces in fill(ShardIndex(docs, idf, mean), lengths, window):
        if sum(n for _, _, n in pieces) == window:
            yield pieces
        else:
            yield from powers_of_two(pieces)


def packed(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, shard: int = SHARD, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: where it lies in its document and in its sequence, and the CRC-32 of its ids (or these too)."""
    rows = durable(encoded(docs, path, window, end, with_ids))
    rests = rows.filter("ids_crc32 IS NULL AND length IS NOT NULL")
    documents, tokens = rests.agg(F.count(F.lit(1)), F.sum("length")).first()
    vocabulary = word_encoder(path).tokenizer.get_vocab_size()
    idf = inverse_frequency(frequencies(rows, vocabulary), documents)
    mean = tokens / documents if documents else 1.0
    shared = docs.sparkSession.sparkContext.broadcast((idf, term_order(idf)))

    def key(batches):
        _, places = shared.value
        for batch in batches:
            ends = np.full((batch.num_rows, 2), vocabulary, np.int64)
            for k, (n, ids) in enumerate(zip(batch.column("length").to_pylist(), batch.column("ids").to_pylist())):
                own = places[unpacked_numbers(ids, n)]
                ends[k, 0] = own.min()
                ends[k, 1] = own.min(where=own != ends[k, 0], initial=vocabulary)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends[:, 0]), pa.array(ends[:, 1])], [*batch.schema.names, "first", "second"])

    kinds = [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    kinds += [("ids", pa.list_(pa.int64()))] * with_ids

    def place(batches):
        weights, _ = shared.value
        sequence = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        out: list[tuple] = []
        for batch in (*batches, None):
            if batch is not None:
                held += zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "start", "length", "ids")))
            while len(held) >= shard or batch is None and held:
                part, held = held[:shard], held[shard:]
                texts = [unpacked_numbers(r[4], r[3]) for r in part]
                for pieces in sequences_of(texts, weights, mean, window):
                    offset = 0
                    for k, at, n in pieces:
                        doc_id, doc_tokens, start, _, _ = part[k]
                        ids = texts[k][at : at + n]
                        out.append((doc_id, start + at, n, crc32(ids), doc_tokens, 2 * sequence + 1, offset, *[ids.astype(np.int64)] * with_ids))
                        offset += n
                    sequence += 1
                    if len(out) >= ROWS:
                        yield _rows([list(c) for c in zip(*out)], kinds)
                        out = []
        if out:
            yield _rows([list(c) for c in zip(*out)], kinds)

    pieces = _PIECES + ", ids array<long>" * with_ids
    rests = rests.select("doc_id", "doc_tokens", "start", "length", "ids")
    keyed = rests.mapInArrow(key, "doc_id long, doc_tokens long, start long, length long, ids binary, first long, second long")
    order = ["first", "second", F.xxhash64("doc_id"), "doc_id", "length"]
    mixed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(place, pieces)
    whole = rows.filter("ids_crc32 IS NOT NULL")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", (2 * F.col("sequence")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")]
    if not with_ids:
        return whole.select(*names).unionByName(mixed)

    def expand(batches):
        for batch in batches:
            ids = [unpacked_numbers(x, n).astype(np.int64) for x, n in zip(batch.column("ids").to_pylist(), batch.column("length").to_pylist())]
            yield batch.set_column(batch.schema.get_field_index("ids"), "ids", pa.array(ids, pa.list_(pa.int64())))

    return whole.select(*names, "ids").mapInArrow(expand, pieces).unionByName(mixed)


def sequences(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, shard: int = SHARD) -> DataFrame:
    """(sequence_id, length, doc_ids, ids): the sequences themselves; a sequence holds at most ``window`` tokens."""
    part = F.struct("offset", "doc_id", "ids")
    whole = packed(docs, path, window, end, shard, True).groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    return whole.select("sequence_id", F.size(ids).cast("long").alias("length"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), ids.alias("ids"))
