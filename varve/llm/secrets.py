"""Secret scans: candidate spans by pattern, verdicts by corpus-wide ownership.

Spans come from ``split`` and ``regexp_extract_all`` with one pattern: the
pieces between matches and the matches alternate, so running lengths give code
point offsets without user functions; every pattern looks at a character a bounded
number of times.  Candidate values are hashed and counted by distinct owners and
repositories over the whole corpus.  A value that ``example_owners`` owners carry is
a copied example, wherever it stands, and so is one of two owners or more in
``example_repositories`` repositories; what stays with one owner looks live however
often that owner repeats it, and ``live_spans`` names its spans.
Counting is grouped aggregation with partial sums, and verdicts return over the
distinct candidate lists, so a value pasted into a third of all documents costs
one row in each map task.

Edge cases: a null text is empty; a document without candidates keeps empty
spans and zero counts; repeated rows count once for a repository; a null owner
or repository is one of its own; columns beyond those named are ignored, and pass
through ``redacted`` whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.llm.durable import bounded, durable
from varve.llm.words import let, member, running, unused


@dataclass(frozen=True)
class Kind:
    """A pattern; the group that holds the secret value and the least length of that group.

    A ``bare`` kind's pattern begins with one character outside its run, so that a
    run is entered once; its span is the value alone.
    """

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    bare: bool = False


#: The base kinds, in the order in which equal starts are listed.
BASE = (
    Kind(
        "assign",
        "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
        "|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    Kind("access", "AKIA[A-Z0-9]+", 0, 20),
    Kind("hex", "[0-9a-f]{24,}", 0, 24),
)
#: Further public credential formats.
MORE = (
    Kind("forge", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Kind("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Kind("jwt", "[^A-Za-z0-9_-](eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,})", 1, 28, True),
    # the value is the key itself, with the two header lines that an encrypted one may have
    Kind(
        "pem",
        "-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----([\\x20\\t\\r\\n]*(?:Proc-Type:[^\\n]*\\n[\\x20\\t\\r]*)?(?:DEK-Info:[^\\n]*\\n)?[^-]*)",
        1,
        20,
    ),
)
#: A value that at least so many owners, or two and so many repositories, carry is a copied example.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 50
SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string>>"
CHUNK = 256
FEW = 500_000


def kind_spans(text: Column, kind: Kind, rank: int) -> Column:
    """Spans of one kind as an array of structs; matches whose group is too short are dropped."""
    body = F.concat(F.lit("\n"), text) if kind.bare else text
    whole = F.regexp_extract_all(body, F.lit(kind.pattern), F.lit(0))
    value = F.regexp_extract_all(body, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else whole
    pieces = F.split(body, kind.pattern, -1)

    def build(m: Column, v: Column, ends: Column) -> Column:
        def one(end: Column, i: Column) -> Column:
            start = end - F.length(F.get(v if kind.bare else m, i))
            shift = 1 if kind.bare else 0
            return F.struct(
                (start - shift).alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), (end - shift).alias("end"), F.get(v, i).alias("value")
            )

        return F.filter(F.transform(ends, one), lambda s: F.length(s["value"]) >= kind.least).cast(SPAN)

    def ends(p: Column, m: Column) -> Column:
        steps = F.transform(m, lambda x, i: (F.length(x) + F.length(F.get(p, i))).cast("long"))
        return running(steps, lambda x, before: x + F.coalesce(before, F.lit(0).cast("long")))

    found = F.struct(pieces.alias("p"), whole.alias("m"), value.alias("v"))
    found = let(found, lambda s: let(ends(s["p"], s["m"]), lambda e: build(s["m"], s["v"], e)))
    return F.when(body.rlike(kind.pattern), found).otherwise(F.array().cast(SPAN))


def spans(text: Column, kinds=BASE + MORE) -> Column:
    """All spans of a text by start, then kind order."""
    body = F.coalesce(text, F.lit(""))
    return F.sort_array(F.concat(*[kind_spans(body, k, i) for i, k in enumerate(kinds)]))


def joined(found: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """doc_id, owner, repository, text_hash and ``found``: the spans with their values."""
    return docs.select(
        "doc_id",
        F.col(owner).cast("string").alias("owner"),
        F.col(repository).cast("string").alias("repository"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        spans(F.col("text")).alias("found"),
    )


def ownership(scanned: DataFrame) -> DataFrame:
    """One row for each distinct value hash: how many owners and how many repositories carry it."""
    value = F.explode(F.array_distinct(F.transform("found", lambda s: F.xxhash64(s["value"]))))
    each = scanned.filter(F.size("found") > 0).select("owner", "repository", value.alias("value_hash"))
    n = F.count(F.lit(1))
    owners = each.select("value_hash", "owner").distinct().groupBy("value_hash").agg(n.alias("n_owners"))
    repositories = each.select("value_hash", "repository").distinct().groupBy("value_hash").agg(n.alias("n_repositories"))
    return owners.join(repositories, "value_hash")


def judged(
    docs: DataFrame, owner: str = "source", repository: str = "doc_id", example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES
) -> DataFrame:
    """``scan`` with ``live`` and ``example``: the value hashes of either verdict in each document, in order."""
    base = durable(scan(docs, owner, repository))
    hashes = F.array_sort(F.array_distinct(F.transform("found", lambda s: F.xxhash64(s["value"]))))
    some = base.filter(F.size("found") > 0).withColumn("values", hashes).withColumn("list_id", F.xxhash64("values"))
    lists = some.groupBy("list_id").agg(F.min("values").alias("values"))
    seen = lists.select("list_id", F.explode("values").alias("value_hash"))
    shared = (F.col("n_owners") >= example_owners) | (F.col("n_owners") >= 2) & (F.col("n_repositories") >= example_repositories)
    counts = ownership(base).select(F.col("value_hash").alias("h"), shared.alias("shared"))
    verdicts = (
        seen.join(counts, F.xxhash64("value_hash", F.lit(1)) == F.xxhash64("h", F.lit(1)))
        .filter(F.col("value_hash") == F.col("h"))
        .groupBy("list_id")
        .agg(
            F.array_sort(F.collect_list(F.when(~F.col("shared"), F.col("value_hash")))).alias("live"),
            F.array_sort(F.collect_list(F.when(F.col("shared"), F.col("value_hash")))).alias("example"),
        )
        .select(F.col("list_id").alias("l"), "live", "example")
    )
    some = some.join(verdicts, (F.xxhash64("list_id", F.lit(1)) == F.xxhash64("l", F.lit(1))) & (F.col("list_id") == F.col("l")))
    none = F.array().cast("array<bigint>")
    rest = base.filter(F.size("found") == 0).withColumns({"live": none, "example": none})
    cols = ["doc_id", "owner", "repository", "text_hash", "found", "live", "example"]
    return some.select(*cols).unionByName(rest.select(*cols))


def live_spans(found: Column, live: Column) -> Column:
    """The spans whose value looks live."""
    return F.filter(found, lambda s: member(live, F.xxhash64(s["value"])))


def digest(judgements: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans, all spans and those that look live, of every document."""
    n = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return judgements.select(
        "doc_id",
        *[n(k.name).alias(f"n_{k.name}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        joined(live_spans(F.col("found"), F.col("live"))).alias("live_spans"),
        F.size("live").cast("long").alias("n_live"),
        F.size("example").cast("long").alias("n_example"),
    )


def masked(body: Column, hits: Column, mask: str) -> Column:
    """``body`` with the values of spans replaced; spans that touch are one.

    The text is cut into chunks once, and what lies between two values is put
    together from those it crosses, so the work goes with the text and the spans.
    """

    def between(chunks: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        first, last = (a % CHUNK).cast("int"), (b % CHUNK).cast("int")
        at = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
        apart = F.concat(F.substring(at(i), first + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, j - i - 1), ""), F.substring(at(j), F.lit(1), last))
        return F.when(i == j, F.substring(at(i), first + 1, last - first)).otherwise(apart)

    def build(s: Column) -> Column:
        before = lambda k: F.coalesce(F.get(s["ends"], k - 1), F.lit(0).cast("long"))

        def part(h: Column, k: Column) -> Column:
            start = h["end"] - F.length(h["value"])
            return F.when(start >= before(k), F.concat(between(s["chunks"], before(k), start), F.lit(mask))).otherwise(F.lit(""))

        tail = between(s["chunks"], before(F.size(s["ends"])), F.length(s["body"]).cast("long"))
        return F.concat(F.array_join(F.transform(s["hits"], part), ""), tail)

    known = F.struct(body.alias("body"), hits.alias("hits"), F.regexp_extract_all(body, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("chunks"))
    ends = lambda h: running(F.transform(h, lambda x: x["end"]), lambda x, before: F.greatest(x, before))
    return let(known, lambda s: let(F.struct(s["body"].alias("body"), s["hits"].alias("hits"), s["chunks"].alias("chunks"), ends(s["hits"]).alias("ends")), build))


def redacted(docs: DataFrame, mask: str = "<secret>", **settings) -> DataFrame:
    """``docs`` with the values of live-looking spans replaced; other documents as they came.

    Only documents with a live-looking value meet the verdicts: the keys of up to
    FEW of them are broadcast to part them from the rest, whose texts stay where
    they are.  ``n_chars`` is brought up to date where the input has it.
    """
    text = F.coalesce("text", F.lit(""))
    found, key, k = unused(docs.columns, "__found", "__key", "__k")
    verdicts = judged(docs, **settings).filter(F.size("live") > 0)
    keys = verdicts.select(F.xxhash64("doc_id", "text_hash").alias(key), live_spans(F.col("found"), F.col("live")).alias(found))
    keys = keys.groupBy(key).agg(F.min(found).alias(found))
    df = docs.withColumn(k, F.xxhash64("doc_id", F.xxhash64(text)))
    hit = unused(docs.columns, "__hit")[0]
    hits, few = bounded(keys.select(F.col(key).alias(hit)), FEW)
    rest = df.join(hits, F.col(k) == F.col(hit), "left_anti")
    some = df.join(hits, F.col(k) == F.col(hit), "left_semi") if few else df
    some = some.join(keys, F.col(k) == F.col(key)).withColumn("text", masked(text, F.col(found), mask))
    if "n_chars" in docs.columns:
        some = some.withColumn("n_chars", F.length("text").cast("long"))
    cols = [f"`{c}`" for c in docs.columns]
    return rest.select(*cols).unionByName(some.select(*cols))
