"""Language identification of web pages by Bayesian evidence fusion.

The posterior of a page multiplies four pieces of evidence: a trigram text
likelihood, tempered so that a long page does not silence the rest; how often
pages of a language declare this markup language; how often they lie under this
address suffix; and a prior of the page's host, smoothed towards its registered
domain and that towards the whole corpus.  Declarations, suffixes, hosts and
domains are counted by grouped aggregation of the text posteriors over all
pages (soft counts), each page's own share left out of what it is judged by.

The text model is fitted on ``documents`` with a known language, about
MAX_TRAINING of each language by hash (a documented bound); everything else
covers all pages.  Counts return to pages by joins that adaptive execution can
split, so a host with a third of all pages is no single task.

Edge cases: null or blank markup leaves the other evidence; a null or malformed
address has the empty host and suffix; an unknown declaration counts like any
other value; ties go to the first language by name; repeated pages are judged
alike; without training rows no language can be named and ``lang`` is null.
Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.llm.durable import durable
from varve.llm.kernels import text_slices, trigram_counts
from varve.llm.words import let

DIMS = 4096
MAX_TRAINING = 2000
EVIDENCE = 60
HOST_STRENGTH = 5.0
DOMAIN_STRENGTH = 20.0
MARK_STRENGTH = 10.0

# what is not closed runs to the end, as it does in browsers, so every byte is looked at once
_HIDDEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)")
_TAG = re.compile(r"(?s)<[^<>]*>")
_COMMENT = r"(?s)<!--.*?(-->|\z)"
_QUOTE = "[\"']?"
_TAGS = r"(?i)<(?:html|meta)\b[^<>]*"
# on tags whose blanks are single
_LANG = rf"(?i)^<html (?:[^<>]*? )?(?:xml:)?lang ?= ?{_QUOTE}([A-Za-z]{{2,8}})"
_CONTENT_LANGUAGE = rf"(?i)^<meta\b[^<>]* http-equiv ?= ?{_QUOTE}content-language\b"
_CONTENT = rf"(?i) content ?= ?{_QUOTE} ?([A-Za-z]{{2,8}})"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/]*\]|[^/?#:@\[]*)"
_NUMBER = r"^\[|^[0-9]+(\.[0-9]+){3}$"
#: Labels under which countries register names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "mil", "ne", "net", "nom", "or", "org")


def visible(page: str | None) -> str:
    """The text of a page without markup, scripts, styles and comments."""
    return markup.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page or "")))


def declared(page: Column) -> Column:
    """The primary language of the markup's declaration (``html`` tag, else ``meta`` header), or nothing; comments declare none."""
    shown = F.regexp_replace(F.coalesce(page, F.lit("")), _COMMENT, " ")
    tags = F.transform(F.regexp_extract_all(shown, F.lit(_TAGS), F.lit(0)), lambda t: F.regexp_replace(t, r"\s+", " "))
    own = lambda t: F.nullif(F.regexp_extract(t, _LANG, 1), F.lit(""))
    header = lambda t: F.when(t.rlike(_CONTENT_LANGUAGE), F.nullif(F.regexp_extract(t, _CONTENT, 1), F.lit("")))
    first = lambda ts, find: F.get(F.array_compact(F.transform(ts, find)), 0)
    return F.lower(let(tags, lambda ts: F.coalesce(first(ts, own), first(ts, header), F.lit(""))))


def address(url: Column) -> tuple[Column, Column, Column]:
    """(host, registered domain, suffix) of an address; empty where there is none.

    A numeric host is a domain of its own without a suffix; under a country's
    second-level label (co.uk) a domain has three labels.
    """
    host = F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1)), F.lit("."))
    parts = F.split(host, "\\.")
    last, second = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    deep = (F.size(parts) > 2) & (F.length(last) == 2) & second.isin(*SECOND_LEVEL)
    number = host.rlike(_NUMBER)
    domain = F.when(number, host).otherwise(F.when(deep, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2)))
    return host, domain, F.when(number, F.lit("")).otherwise(last)


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lo, hi, buf, offsets in text_slices(batch.column("text")):
            counts = trigram_counts(buf, offsets, DIMS, lower=True)
            for lang in np.unique(langs[lo:hi]):
                total = counts[langs[lo:hi] == lang].sum(axis=0)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["lang", "bucket", "n"])


def fit(docs: DataFrame, max_training: int = MAX_TRAINING) -> tuple[list[str], np.ndarray]:
    """Languages and their log trigram probabilities (languages x DIMS)."""
    sizes = {r[0]: r[1] for r in docs.filter("lang is not null").groupBy("lang").count().collect()}
    if not sizes:
        return [], np.zeros((0, DIMS))
    rate = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, max_training / n)))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = docs.filter("lang is not null").select("lang", "doc_id", "text").filter(draw < rate[F.col("lang")]).select("lang", "text")
    rows = sample.mapInArrow(_train_rows, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = sorted(sizes)
    counts = np.full((len(langs), DIMS), 0.5)
    for lang, bucket, n in rows.collect():
        counts[langs.index(lang), bucket] += n
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def evidence(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """page_id, host, domain, suffix, mark and the tempered log likelihood of each language."""
    shared = pages.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            raw = batch.column("html").to_pylist()
            text = pa.array([visible(x) for x in raw], pa.string())
            parts = []
            for _, _, buf, offsets in text_slices(text):
                c = trigram_counts(buf, offsets, DIMS, lower=True)
                n = c.sum(axis=1, keepdims=True)
                parts.append((c @ shared.value.T) / np.maximum(n, 1) * np.minimum(n, EVIDENCE))
            ll = np.concatenate(parts) if parts else np.zeros((0, len(langs)))
            names = ["page_id", "host", "domain", "suffix", "mark"]
            cols = [batch.column(n) for n in names] + [pa.array(np.ascontiguousarray(ll[:, i])) for i in range(len(langs))]
            yield pa.RecordBatch.from_arrays(cols, [*names, *[f"l{i}" for i in range(len(langs))]])

    kinds = "page_id long, host string, domain string, suffix string, mark string" + "".join(f", l{i} double" for i in range(len(langs)))
    host, domain, suffix = address(F.col("url"))
    named = [host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), declared(F.col("html")).alias("mark")]
    return pages.select(F.col("page_id").cast("long").alias("page_id"), *named, "html").mapInArrow(run, kinds)


def _posterior(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    parts = [F.exp(x - top) for x in logs]
    return [p / sum(parts[1:], parts[0]) for p in parts]


def _joined(df: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """``df`` with ``counts`` by ``key``; both sides are shuffled, so a hot key can be split."""
    other = counts.withColumnRenamed(key, f"__{key}")
    same = (F.xxhash64(key, F.lit(key)) == F.xxhash64(f"__{key}", F.lit(key))) & (F.col(key) == F.col(f"__{key}"))
    return df.join(other, same).drop(f"__{key}")


def identify(pages: DataFrame, docs: DataFrame, max_training: int = MAX_TRAINING) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared and host of every page."""
    langs, table = fit(docs, max_training)
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select("page_id", none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"), none.alias("declared"), none.alias("host"))
    each = range(len(langs))
    base = durable(evidence(pages, langs, table).select("*", *[p.alias(f"p{i}") for i, p in enumerate(_posterior([F.col(f"l{i}") for i in each]))]))

    def counts(key: str, tag: str, *more: Column) -> DataFrame:
        return base.groupBy(key).agg(*[F.sum(f"p{i}").alias(f"{tag}{i}") for i in each], *more)

    whole = base.agg(*[F.sum(f"p{i}").alias(f"g{i}") for i in each]).first()
    g = [float(x or 0.0) for x in whole]
    total = sum(g) or 1.0
    share = [(x + 1.0 / len(langs)) / (total + 1.0) for x in g]
    n = lambda tag: sum((F.col(f"{tag}{i}") for i in each), F.lit(0.0))
    domains = counts("domain", "d")
    hosts = _joined(counts("host", "h", F.min("domain").alias("domain")), domains, "domain").drop("domain")
    df = _joined(_joined(_joined(base, hosts, "host"), counts("mark", "m"), "mark"), counts("suffix", "s"), "suffix")
    logs = []
    for i in each:
        own = F.col(f"p{i}")
        dom = (F.col(f"d{i}") - own + DOMAIN_STRENGTH * share[i]) / (n("d") - 1 + DOMAIN_STRENGTH)
        host = (F.col(f"h{i}") - own + HOST_STRENGTH * dom) / (n("h") - 1 + HOST_STRENGTH)
        seen = lambda tag: (F.col(f"{tag}{i}") - own + MARK_STRENGTH * n(tag) / total) / (F.lit(g[i]) - own + MARK_STRENGTH)  # noqa: E731,B023
        logs.append(F.col(f"l{i}") + F.log(F.greatest(host, F.lit(1e-9))) + F.log(F.greatest(seen("m"), F.lit(1e-9))) + F.log(F.greatest(seen("s"), F.lit(1e-9))))
    posterior = F.array(*_posterior(logs))
    df = df.withColumn("posterior", posterior)
    best = lambda c: F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position(c, F.array_max(c)).cast("int"))
    return df.select(
        "page_id",
        best(F.col("posterior")).alias("lang"),
        F.array_max("posterior").alias("confidence"),
        best(F.array(*[F.col(f"p{i}") for i in each])).alias("text_lang"),
        F.col("mark").alias("declared"),
        "host",
    )
