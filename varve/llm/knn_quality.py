"""Quality classification by nearest-neighbour voting in a latent-semantic space.

A text's terms are hashed byte trigrams and hashed steps, the differences between
the hashes of neighbouring words.  Square roots of the counts, of unit length for
each kind of term, are weighed by inverse document frequency; the leading singular
vectors of a labelled sample span the latent space.  The sample is the MAX_LABELLED labelled documents of
least hash (a documented bound: fewer if fewer are labelled), so the broadcast
model has a fixed size.  Every document is scored: its cosines with all labelled
vectors are exact blocked products, and the NEIGHBOURS nearest vote with a power of
their similarity as weight, those of the rarer label more by up to BALANCE, next to a small prior.

Edge cases: an empty, blank or null text has no vector and scores the prior; a
null label is ignored and repeated labels of one document are averaged; without
any label every score is 0.5; repeated rows score alike; only ``doc_id`` and
``text`` are read, so other columns (``lang``, ``source``) are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.llm.kernels import mix, text_slices, trigram_counts, word_hashes, words

DIMS = 1024
STEPS = 1024
LATENT = 48
MAX_LABELLED = 4096
NEIGHBOURS = 8
SHARPNESS = 6
BALANCE = 2.0
PRIOR_WEIGHT = 0.5
CUT = 0.7
HELD_OUT = (4, 2)


def held_out() -> Column:
    """True for documents kept out of learning: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col("doc_id").cast("string")) % HELD_OUT[0] == HELD_OUT[1]


def vectors(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of square-rooted trigram and step counts, either part of unit length (zero where it has none)."""
    return np.concatenate([_unit(np.sqrt(x).astype(np.float32)) for x in (trigram_counts(buf, offsets, DIMS, lower=False), step_counts(buf, offsets))], axis=1)


def step_counts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed differences between neighbouring words, one row of STEPS for each text."""
    texts = len(offsets) - 1
    starts, ends, first = words(buf, offsets)
    if len(starts) < 2:
        return np.zeros((texts, STEPS), np.int64)
    h = word_hashes(buf, starts, ends)
    text = np.repeat(np.arange(texts), np.diff(first))
    bucket = (mix(h[1:] - h[:-1]) >> np.uint64(40)).astype(np.int64) % STEPS
    inside = text[1:] == text[:-1]
    return np.bincount(text[1:][inside] * STEPS + bucket[inside], minlength=texts * STEPS).reshape(texts, STEPS)


def _unit(z: np.ndarray) -> np.ndarray:
    norm = np.sqrt((z * z).sum(axis=1, keepdims=True))
    return np.divide(z, norm, out=np.zeros_like(z), where=norm > 1e-12)


class Model:
    """The projection and the labelled vectors."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        n = max(1, len(x))
        self.idf = np.log((1 + n) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
        weighed = x * self.idf
        _, basis = np.linalg.eigh((weighed.T @ weighed).astype(np.float64))
        self.basis = np.ascontiguousarray(basis[:, ::-1][:, :LATENT], dtype=np.float32)
        self.labelled = self.latent(x)
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        rare = 0.0 if self.prior >= 0.5 else 1.0
        share = min(self.prior, 1 - self.prior)
        more = min(BALANCE, (1 - share) / share) if 0 < share < 1 else 1.0
        self.votes = np.where(np.round(self.labels) == rare, more, 1.0)

    def latent(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space."""
        return _unit((x * self.idf) @ self.basis)

    def score(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        z = self.latent(x)
        out = np.full(len(z), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        for lo in range(0, len(z) if k else 0, block):
            sims = z[lo : lo + block] @ self.labelled.T
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < len(self.labels) else np.tile(np.arange(k), (len(sims), 1))
            w = np.clip(np.take_along_axis(sims, near, axis=1), 0, None).astype(np.float64) ** SHARPNESS * self.votes[near]
            out[lo : lo + block] = ((w * self.labels[near]).sum(axis=1) + PRIOR_WEIGHT * self.prior) / (w.sum(axis=1) + PRIOR_WEIGHT)
        return np.clip(out, 0.0, 1.0)


def _vector_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r.astype(np.float16).tobytes() for _, _, buf, offsets in text_slices(batch.column("text")) for r in vectors(buf, offsets)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "v"])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from at most ``max_labelled`` labelled documents that are not held out."""
    known = labels.filter(~held_out()).filter(F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = texts.select("doc_id", "label", "text").mapInArrow(_vector_rows, "doc_id long, label double, v binary")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("v", "label")).alias("r")).orderBy("doc_id").collect()
    x = np.stack([np.frombuffer(r.r.v, np.float16) for r in rows]).astype(np.float32) if rows else np.zeros((0, DIMS + STEPS), np.float32)
    return Model(x, np.array([r.r.label for r in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            parts = [shared.value.score(vectors(buf, offsets)) for _, _, buf, offsets in text_slices(batch.column("text"))]
            values = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "score"])

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return df.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
