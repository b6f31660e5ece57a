"""Rows of small domain files: workbooks, sparse matrices, trees and place marks.

Each file is one task of ``binaryFile`` + ``mapInPandas``; only the standard
library and numpy are needed.  HDF5 and GeoTIFF need libraries that are not
assumed here.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from itertools import combinations
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _each_file(spark: SparkSession, path: str, schema: str, rows: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """``rows(content)`` of every file, with its path in the first column ``file``."""
    names = ["file", *[c.split()[0] for c in schema.split(", ")]]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                found = [(name, *r) for r in rows(bytes(content))]
                if found:
                    yield pd.DataFrame(found, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, f"file string, {schema}")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def workbook_cells(content: bytes) -> Iterator[tuple]:
    """(sheet, row, column, value) of the filled cells of an xlsx workbook, values as text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter() if _local(t.tag) == "t"))
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            sheet = int(re.search(r"(\d+)\.xml$", name)[1])
            for cell in ElementTree.fromstring(z.read(name)).iter():
                if _local(cell.tag) != "c":
                    continue
                text = "".join(v.text or "" for v in cell.iter() if _local(v.tag) in ("v", "t"))
                if text:
                    letters, row = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
                    column = 0
                    for ch in letters:
                        column = 26 * column + ord(ch) - 64
                    yield sheet, int(row), column, shared[int(text)] if cell.get("t") == "s" else text


def sparse_triples(content: bytes) -> Iterator[tuple]:
    """(row, column, value) of a compressed sparse row matrix saved as npz."""
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        indptr, indices, data = z["indptr"], z["indices"], z["data"]
    rows = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    yield from zip(rows.tolist(), indices.tolist(), data.astype(float).tolist())


def tip_distances(content: bytes) -> Iterator[tuple]:
    """(tip_i, tip_j, distance) of all tips of a Newick tree, i < j in name order."""
    # one stack entry for each open node: the tips below it with their distance to it
    stack: list[list] = [[]]
    out: dict[tuple[str, str], float] = {}
    pending: list | None = None
    for token in re.findall(r"\(|\)|,|;|[^(),;]+", content.decode()):
        token = token.strip()
        if token == "(":
            stack.append([])
        elif token in (",", ")", ";", ""):
            if pending is not None:
                stack[-1].append(pending)
                pending = None
            if token == ")":
                children = stack.pop()
                for a, b in combinations(children, 2):
                    for (x, dx), (y, dy) in ((p, q) for p in a for q in b):
                        out[min(x, y), max(x, y)] = dx + dy
                pending = [t for c in children for t in c]
        else:
            name, _, length = token.partition(":")
            step = float(length or 0)
            pending = [(t, d + step) for t, d in pending] if pending is not None else [(name.strip("' "), step)]
    yield from ((i, j, d) for (i, j), d in sorted(out.items()))


def placemarks(content: bytes) -> Iterator[tuple]:
    """(name, longitude, latitude) of the points of a KML document."""
    for mark in ElementTree.fromstring(content).iter():
        if _local(mark.tag) != "Placemark":
            continue
        name = next((e.text for e in mark.iter() if _local(e.tag) == "name"), None)
        for e in mark.iter():
            if _local(e.tag) == "coordinates":
                for point in (e.text or "").split():
                    lon, lat = point.split(",")[:2]
                    yield name, float(lon), float(lat)


def ontology_terms(content: bytes) -> Iterator[tuple]:
    """(term, label, parent) of the classes of an ontology in RDF or OWL XML: one row for each named parent, or one without."""
    root = ElementTree.fromstring(content)
    rdf = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
    labels, parents = {}, {}
    for e in root.iter():
        kind = _local(e.tag)
        if kind == "Class" and e.get(f"{rdf}about"):
            term = e.get(f"{rdf}about")
            parents.setdefault(term, [])
            for child in e:
                if _local(child.tag) == "label" and term not in labels:
                    labels[term] = child.text
                elif _local(child.tag) == "subClassOf" and child.get(f"{rdf}resource"):
                    parents[term].append(child.get(f"{rdf}resource"))
        elif kind == "Declaration":
            for child in e:
                if _local(child.tag) == "Class" and child.get("IRI"):
                    parents.setdefault(child.get("IRI"), [])
        elif kind == "SubClassOf" and [_local(c.tag) for c in e] == ["Class", "Class"]:
            term, parent = (c.get("IRI") for c in e)
            parents.setdefault(term, []).append(parent)
        elif kind == "AnnotationAssertion":
            found = {_local(c.tag): c for c in e}
            named = found.get("AnnotationProperty")
            if named is not None and "rdfs:label" in (named.get("abbreviatedIRI"), named.get("IRI")) and "IRI" in found and "Literal" in found:
                labels.setdefault(found["IRI"].text, found["Literal"].text)
    for term, above in parents.items():
        for parent in above or [None]:
            yield term, labels.get(term), parent


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    return _each_file(spark, path, "term string, label string, parent string", ontology_terms)


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    return _each_file(spark, path, "sheet int, row int, column int, value string", workbook_cells)


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    return _each_file(spark, path, "row long, column long, value double", sparse_triples)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return _each_file(spark, path, "tip_i string, tip_j string, distance double", tip_distances)


def read_placemarks(spark: SparkSession, path: str) -> DataFrame:
    return _each_file(spark, path, "name string, longitude double, latitude double", placemarks)
