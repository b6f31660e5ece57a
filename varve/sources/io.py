"""Readers and writers of the file formats around a count table."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of control profiles, and columns that are no profile.
CONTROL = "^(EB|Negative)"
NOT_PROFILES = ("Taxon", "taxonomy")


def wide_to_long(lines: DataFrame, header: str, controls: str = CONTROL) -> DataFrame:
    """(feature, sample, count) of the lines of a wide tab-separated feature table.

    Comment lines and the header are skipped, control profiles and taxonomy
    columns dropped, zero cells left implicit.  Each line is split once and
    exploded, so thousands of columns never become columns of a DataFrame.
    """
    names = header.split("\t")
    keep = [(i, n) for i, n in enumerate(names) if i and n not in NOT_PROFILES]
    cells = F.split("value", "\t")
    labels = F.array(*[F.lit(n) for _, n in keep])
    values = F.slice(cells, 2, len(names) - 1) if len(keep) == len(names) - 1 else F.array(*[F.get(cells, F.lit(i)) for i, _ in keep])
    body = lines.filter(~F.col("value").startswith("#") & (F.col("value") != header))
    long = body.select(F.get(cells, F.lit(0)).alias("feature"), F.explode(F.arrays_zip(labels.alias("sample"), values.alias("count"))).alias("c"))
    long = long.select("feature", F.col("c.sample").alias("sample"), F.col("c.count").try_cast("double").alias("count"))
    return long.filter((F.col("count") != 0) & ~F.col("sample").rlike(controls))


def read_wide_tsv(spark: SparkSession, path: str, controls: str = CONTROL) -> DataFrame:
    """``wide_to_long`` of a file, plain or gzip; one leading ``# Constructed`` line is allowed."""
    lines = spark.read.text(path)
    header = next(r.value for r in lines.limit(2).collect() if not r.value.startswith("# "))
    return wide_to_long(lines, header, controls)


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A tab-separated table with a header; only the empty string is null, so NA stays a label."""
    reader = spark.read.option("sep", "\t").option("header", True).option("nullValue", "")
    return (reader.schema(schema) if schema else reader).csv(path)


def read_collection(spark: SparkSession, folder: str, pattern: str = "*.tsv", by_folder: bool = False) -> DataFrame:
    """One table from many files of one shape, with the file's stem, or its folder's name, as ``sample``."""
    df = read_tsv(spark, f"{folder}/{pattern}")
    name = r"([^/]+)/[^/]*$" if by_folder else r"([^/]+?)(\.[A-Za-z]+)*$"
    return df.withColumn("sample", F.regexp_extract(F.input_file_name(), name, 1))


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes one small file where Spark's readers find it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(content))
    out.close()


def require_one_each(df: DataFrame, key: str, wanted: Sequence) -> DataFrame:
    """Wanted keys that do not occur exactly once, with how often they do."""
    names = F.explode(F.array(*[F.lit(w) for w in wanted])).alias("wanted")
    w = df.sparkSession.range(1).select(names)
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return w.join(n, F.col("wanted") == F.col(key), "left").select("wanted", F.coalesce("n", F.lit(0)).alias("n")).filter("n <> 1")


def tar_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, sha256, content) of the files in tar or tar.gz archives, one archive a task at a time."""

    def untar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                    for member in archive:
                        if member.isfile():
                            yield pd.DataFrame({"archive": [name], "member": [member.name], "content": [archive.extractfile(member).read()]})

    df = spark.read.format("binaryFile").load(path).select("path", "content")
    return df.mapInPandas(untar, "archive string, member string, content binary").withColumn("sha256", F.sha2("content", 256))


def fasta(text: Column) -> Column:
    """Array of (contig, sequence) of a FASTA text; a contig is the header's first token, after a bar if there is one."""
    records = F.filter(F.split(F.concat(F.lit("\n"), text), "\n>"), lambda r: F.trim(r) != "")
    head = lambda r: F.get(F.split(F.get(F.split(r, "\n"), F.lit(0)), "\\s+"), F.lit(0))
    return F.transform(
        records,
        lambda r: F.struct(
            F.element_at(F.split(head(r), "\\|"), -1).alias("contig"), F.upper(F.regexp_replace(F.regexp_replace(r, "^[^\n]*", ""), "\\s", "")).alias("sequence")
        ),
    )


def fastq(text: Column) -> Column:
    """The sequences of a FASTQ text: every second line of four, upper-cased."""
    lines = F.split(text, "\n")
    return F.transform(F.filter(lines, lambda x, i: i % 4 == 1), lambda x: F.upper(x))


def canonical(col: Column, kind: str) -> Column:
    """Text of a value: null empty, booleans lower case, floats with ten significant digits and non-finite ones empty."""
    if kind == "boolean":
        text = F.when(col, "true").otherwise("false")
    elif kind in ("double", "float"):
        finite = ~F.isnan(col) & (F.abs(col) != float("inf"))
        text = F.when(finite, F.regexp_replace(F.format_string("%.10g", col), "(\\.[0-9]*?)0+(?=e|$)", "$1"))
        text = F.regexp_replace(text, "\\.(?=e|$)", "")
    else:
        text = col.cast("string")
    return F.coalesce(F.when(col.isNotNull(), text), F.lit(""))


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated files of canonical text with a header."""
    df.select(*[canonical(F.col(c), kind).alias(c) for c, kind in df.dtypes]).write.option("sep", "\t").option("header", True).option("emptyValue", "").mode("errorifexists").csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return df.select("path", "length", F.sha2("content", 256).alias("sha256"))


def empty_files(spark: SparkSession, path: str) -> DataFrame:
    """(path) of files without content under a folder, which Spark's readers pass over."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    found = []
    while files.hasNext():
        status = files.next()
        if status.getLen() == 0:
            found.append((status.getPath().toString(),))
    return spark.createDataFrame(found, "path string")


def unpinned(files: DataFrame, lock: DataFrame, empty: DataFrame | None = None) -> DataFrame:
    """Locked files that are missing or of another hash, and those that are ``empty`` if these are given (Spark's readers skip them); ``lock`` has (path, sha256)."""
    have = files.select(F.col("path").alias("__p"), "length", F.col("sha256").alias("__h"))
    if empty is not None:
        none = F.lit(0).cast("long").alias("length"), F.lit(None).cast("string").alias("__h")
        have = have.filter("length > 0").unionByName(empty.select(F.col("path").alias("__p"), *none))
    df = lock.join(have, F.col("path") == F.col("__p"), "left")
    why = F.when(F.col("__p").isNull(), "missing").when(F.col("length") == 0, "empty").when(F.col("__h") != F.col("sha256"), "changed")
    return df.select("path", why.alias("violation")).filter("violation is not null")
