"""Alignment of two tokenizers over the same bytes.

Token ends are bits of a packed set, one for each byte of a slice of texts; the
AND of the two sets are the shared cuts.  The number of bits up to a cut, from
running popcounts of whole words and the popcount of a masked one (rank), tells
how many tokens of either side lie before it, so consecutive cuts are groups of
token ranges.  A group links each of its tokens of one side with each of the other.

How many documents of the corpus hold a pair of ids linked is counted in two
steps: a task gathers the links of some megabytes of texts into a block with its
own list of distinct pairs, and blocks' counts meet in a grouped sum.  The other
way, a block asks for the counts of its list, not a document for those of its
links, so what is shuffled is the blocks' lists twice and each block's links once,
as places in its list (packed).  A pair that every document holds is one row of a block.

Edge cases: null and empty texts, and those whose token bytes do not add up to a
space and the text (white space that one side folds, a literal U+2581), have no
tokens, zeros and an empty digest; a null ``doc_id`` is kept; repeated rows count
as documents of their own; an empty table gives no rows; other columns are not read.
A group of many tokens on both sides is expanded in parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.durable import durable
from varve.llm.kernels import packed_numbers, spans, unpacked_numbers
from varve.llm.tokens import byte_encoder, piece_encoder

#: bytes of text aligned at a time
SLICE = 1 << 20
#: links expanded at a time
LINKS = 1 << 21
#: (document, pair) entries of a block
BLOCK = 1 << 22

COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


class Marks:
    """A packed set of token ends with running counts of its 64-bit words."""

    def __init__(self, ends: np.ndarray, n: int):
        bits = np.zeros((n // 64 + 1) * 64, bool)
        bits[ends] = True
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many marks lie at or before each place."""
        word = at >> 6
        upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (63 - (at & 63)).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & upto)


def shared_cuts(a: Marks, b: Marks) -> np.ndarray:
    """The places at which tokens of both sides end, in order."""
    return np.flatnonzero(np.unpackbits((a.words & b.words).view(np.uint8), bitorder="little"))


class Slice(NamedTuple):
    """Texts one after another: their ids on either side, group bounds as token counts, and the text of each group."""

    a: np.ndarray
    b: np.ndarray
    to_a: np.ndarray
    to_b: np.ndarray
    text: np.ndarray


def aligned_slice(texts: list[tuple[list[int], list[int]]], size_a: np.ndarray, size_b: np.ndarray) -> Slice:
    """Groups of texts given as ids of either side; ``size_a`` and ``size_b`` are the bytes of each id."""
    a, b = (np.array([x for t in texts for x in t[k]], np.int64) for k in (0, 1))
    ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    n = int(ends_a[-1]) if len(ends_a) else 0
    marks_a, marks_b = Marks(ends_a, n), Marks(ends_b, n)
    cuts = shared_cuts(marks_a, marks_b)
    to_a, to_b = marks_a.rank(cuts), marks_b.rank(cuts)
    upto = np.cumsum([len(t[0]) for t in texts])
    return Slice(a, b, to_a, to_b, np.searchsorted(upto, to_a))


def _from(to: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], to[:-1]])


def link_pieces(s: Slice, ids_b: int, limit: int = LINKS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, pair, times) of links, pairs as a * ids_b + b; distinct within a piece of about ``limit`` links."""
    from_a, from_b = _from(s.to_a), _from(s.to_b)
    n_a, n_b = s.to_a - from_a, s.to_b - from_b
    total = np.cumsum(n_a * n_b)
    top = (int(s.a.max(initial=0)) + 1) * ids_b
    lo = 0
    while lo < len(total):
        done = int(total[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + limit, "right")))
        if int(total[hi - 1]) - done <= limit:
            m = (n_a * n_b)[lo:hi]
            group = np.repeat(np.arange(lo, hi), m)
            k = spans(np.zeros(len(m), np.int64), m)
            pair = s.a[from_a[group] + k // n_b[group]] * ids_b + s.b[from_b[group] + k % n_b[group]]
            key, times = np.unique(s.text[group] * top + pair, return_counts=True)
            yield key // top, key % top, times
        else:  # one group: its distinct ids of either side, a part of the one at a time
            ids, many = np.unique(s.a[from_a[lo] : s.to_a[lo]], return_counts=True)
            other, others = np.unique(s.b[from_b[lo] : s.to_b[lo]], return_counts=True)
            step = max(1, limit // len(other))
            for k in range(0, len(ids), step):
                pair = (ids[k : k + step, None] * ids_b + other).ravel()
                yield np.full(len(pair), s.text[lo]), pair, np.outer(many[k : k + step], others).ravel()
        lo = hi


def links(s: Slice, ids_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, times) of all links, distinct and in order of text and pair."""
    pieces = list(link_pieces(s, ids_b))
    if len(pieces) < 2:
        return pieces[0] if pieces else tuple(np.zeros(0, np.int64) for _ in range(3))
    text, pair, times = (np.concatenate(x) for x in zip(*pieces))
    order = np.lexsort((pair, text))
    text, pair, times = text[order], pair[order], times[order]
    first = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(pair, prepend=-1) != 0))
    return text[first], pair[first], np.add.reduceat(times, first)


class Renderer:
    """Writes groups as ``a1,a2|b1;a3|b2``: ids of one side, a bar, those of the other, groups apart by semicolons."""

    def __init__(self, ids_a: int, ids_b: int):
        self.ids_a, self.ids_b = ids_a, ids_b
        self.table = [f"{k}{end}".encode() for n, last in ((ids_a, "|"), (ids_b, ";")) for end in (",", last) for k in range(n)]

    def parts(self, s: Slice) -> list[bytes]:
        """The written tokens, in the order in which they stand."""
        group_a = np.repeat(np.arange(len(s.to_a)), s.to_a - _from(s.to_a))
        group_b = np.repeat(np.arange(len(s.to_b)), s.to_b - _from(s.to_b))
        codes = np.empty(len(s.a) + len(s.b), np.int64)
        last_a, last_b = np.zeros(len(s.a), bool), np.zeros(len(s.b), bool)
        last_a[s.to_a - 1] = last_b[s.to_b - 1] = True
        codes[np.arange(len(s.a)) + _from(s.to_b)[group_a]] = s.a + last_a * self.ids_a
        codes[np.arange(len(s.b)) + s.to_a[group_b]] = 2 * self.ids_a + s.b + last_b * self.ids_b
        return list(map(self.table.__getitem__, codes.tolist()))


class Aligner:
    """Both tokenizers and what their ids stand for."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = byte_encoder(path_a), piece_encoder(path_b)
        self.ids_b = len(self.b.pieces)
        self.size_a, self.size_b = (np.array([len(p) for p in x.pieces], np.int64) for x in (self.a, self.b))

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of either side, none where their bytes are not those of a space and the text."""
        if not text:
            return [], []
        a, b = self.a.encode(f" {text}"), self.b.encode(text)
        raw = f" {text}".encode()
        same = b"".join(map(self.b.pieces.__getitem__, b)) == raw and b"".join(map(self.a.pieces.__getitem__, a)) == raw
        return (a, b) if same else ([], [])

    def slices(self, column: pa.Array) -> Iterator[tuple[int, Slice, np.ndarray, np.ndarray]]:
        """(first row, groups, tokens of each text on either side) of consecutive texts of about SLICE bytes."""
        held, size, lo = [], 0, 0
        for k in range(len(column) + 1):
            if k == len(column) or size >= SLICE:
                if held:
                    n = [np.array([len(t[j]) for t in held], np.int64) for j in (0, 1)]
                    yield lo, aligned_slice(held, self.size_a, self.size_b), *n
                held, size, lo = [], 0, k
            if k < len(column):
                text = column[k].as_py()
                held.append(self.encode(text))
                size += len(text or "")


def _block(name: str, rows: dict[str, list], entries: list[tuple]) -> pa.RecordBatch:
    """One row: the documents' columns, the distinct pairs by falling number of documents, and each document's links as places in that list."""
    held, pair, times = (np.concatenate(x) for x in zip(*entries))
    codes, which, n = np.unique(pair, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    place = np.empty(len(codes), np.int64)
    place[order] = np.arange(len(codes))
    row = {"block": [name]} | {k: [v] for k, v in rows.items()}
    row |= {"held": [held.tolist()], "pairs": [codes[order]], "n": [n[order]], "links": [packed_numbers(place[which])], "times": [packed_numbers(times)]}
    return pa.RecordBatch.from_pydict(row)


_BLOCKS = (
    "block string, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "held array<long>, pairs array<long>, n array<long>, links binary, times binary"
)


def blocks(docs: DataFrame, path_a: str, path_b: str, most: int = BLOCK) -> DataFrame:
    """Blocks of consecutive documents with their counts, digests and packed links."""

    def pack(batches):
        aligner = Aligner(path_a, path_b)
        write = Renderer(len(aligner.size_a), aligner.ids_b)
        task, k, size = TaskContext.get().partitionId(), 0, 0
        names = ["doc_id", *_COUNTS, "groups_sha256"]
        rows, entries = {c: [] for c in names}, []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, s, n_a, n_b in aligner.slices(batch.column(1)):
                texts = len(n_a)
                groups = np.bincount(s.text, minlength=texts)
                made = (s.to_a - _from(s.to_a)) * (s.to_b - _from(s.to_b))
                n_links = np.bincount(s.text, weights=made, minlength=texts).astype(np.int64)
                parts, bounds = write.parts(s), np.cumsum(n_a + n_b).tolist()
                starts = [0, *bounds[:-1]]
                text, pair, times = links(s, aligner.ids_b)
                entries.append((np.bincount(text, minlength=texts), pair, times))
                rows["doc_id"] += ids[lo : lo + texts]
                for name, values in zip(_COUNTS, (n_a, n_b, groups, n_links)):
                    rows[name] += values.tolist()
                rows["groups_sha256"] += [hashlib.sha256(b"".join(parts[i:j])[:-1]).hexdigest() if j > i else "" for i, j in zip(starts, bounds)]
                size += len(pair)
                if size >= most:
                    yield _block(f"{task}-{k}", rows, entries)
                    rows, entries, size, k = {c: [] for c in names}, [], 0, k + 1
        if entries:
            yield _block(f"{task}-{k}", rows, entries)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, _BLOCKS)


def pair_counts(packed: DataFrame, ids_b: int) -> DataFrame:
    """(pair, documents, best): how many documents hold each pair linked, and whether no pair of its first id is held by more."""
    listed = packed.select(F.explode(F.arrays_zip("pairs", "n")).alias("p")).select("p.pairs", "p.n")
    counts = listed.groupBy(F.col("pairs").alias("pair")).agg(F.sum("n").alias("documents"))
    first = F.floor(F.col("pair") / ids_b)
    most = counts.groupBy(first.alias("a")).agg(F.max("documents").alias("most"))
    return counts.join(most, first == F.col("a")).select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, path_a: str, path_b: str, most: int = BLOCK) -> DataFrame:
    """For each document its tokens, groups, links and digest, and over its links the sum of their counts and how many are the best of their first id."""
    ids_b = len(piece_encoder(path_b).pieces)
    packed = durable(blocks(docs, path_a, path_b, most))
    asked = packed.select(F.col("block").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    told = asked.join(pair_counts(packed, ids_b), "pair").select("of", "place", "documents", "best")

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.slice(0, 1).to_pylist()[0] if left.num_rows else None
        out = {c: [] for c in ["doc_id", *_COUNTS, "groups_sha256", "n_best", "count_sum"]}
        if row is not None:
            held = np.array(row["held"], np.int64)
            n = int(held.sum())
            documents, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, bool)
            place = right.column("place").to_numpy()
            documents[place], best[place] = right.column("documents").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
            at, times = unpacked_numbers(row["links"], n), unpacked_numbers(row["times"], n).astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(held)])
            for name, value in (("n_best", best[at]), ("count_sum", documents[at])):
                sums = np.concatenate([[0], np.cumsum(times * value)])
                out[name] = (sums[upto[1:]] - sums[upto[:-1]]).tolist()
            for c in ["doc_id", *_COUNTS, "groups_sha256"]:
                out[c] = row[c]
        kinds = [pa.string() if c == "groups_sha256" else pa.int64() for c in out]
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    own = packed.select("block", "doc_id", *_COUNTS, "groups_sha256", "held", "links", "times")
    return own.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(weigh, f"{COLUMNS}, n_best long, count_sum long")


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, place, a, b): the ids of either side in each group of each document, in order."""

    def expand(batches):
        aligner = Aligner(path_a, path_b)
        for batch in batches:
            for lo, s, _, _ in aligner.slices(batch.column(1)):
                first = np.searchsorted(s.text, s.text)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(lo + s.text)),
                        pa.array(np.arange(len(s.text)) - first),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], s.to_a]).astype(np.int32)), pa.array(s.a)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], s.to_b]).astype(np.int32)), pa.array(s.b)),
                    ],
                    ["doc_id", "place", "a", "b"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(expand, "doc_id long, place long, a array<long>, b array<long>")
