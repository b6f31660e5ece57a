"""Small domain files."""

import zipfile

import numpy as np
import pytest

from varve.sources import formats


def test_domain_files(spark, tmp_path):
    (tmp_path / "t.nwk").write_text("((a:1,b:2)x:0.5,'c':3,d:1);")
    tree = {(r.tip_i, r.tip_j): r.distance for r in formats.read_tree(spark, f"{tmp_path}/t.nwk").collect()}
    assert tree == {("a", "b"): 3.0, ("a", "c"): 4.5, ("a", "d"): 2.5, ("b", "c"): 5.5, ("b", "d"): 3.5, ("c", "d"): 4.0}
    (tmp_path / "one.nwk").write_text("a;")
    assert formats.read_tree(spark, f"{tmp_path}/one.nwk").count() == 0
    dense = np.array([[0, 2, 0], [0, 0, 0], [1.5, 0, 3]])
    rows, cols = np.nonzero(dense)
    np.savez(tmp_path / "m.npz", data=dense[rows, cols], indices=cols, indptr=np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=3))]), shape=dense.shape)
    got = formats.read_sparse(spark, f"{tmp_path}/m.npz").collect()
    assert {(r.row, r.column): r.value for r in got} == {(0, 1): 2.0, (2, 0): 1.5, (2, 2): 3.0}
    (tmp_path / "p.kml").write_text('<kml xmlns="http://www.opengis.net/kml/2.2"><Placemark><name>s1</name><Point><coordinates>45.5,18.25,0</coordinates></Point></Placemark></kml>')
    assert [tuple(r)[1:] for r in formats.read_placemarks(spark, f"{tmp_path}/p.kml").collect()] == [("s1", 45.5, 18.25)]
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>site</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>19.5</v></c><c r="B2"/></row></sheetData></worksheet>')
    cells = {(r.sheet, r.row, r.column): r.value for r in formats.read_workbook(spark, f"{tmp_path}/w.xlsx").collect()}
    assert cells == {(1, 1, 1): "site", (1, 1, 28): "ab", (1, 2, 1): "19.5"}


@pytest.mark.parametrize("text, n", [("(a,b);", 1), ("a;", 0), ("(a:1,(b:1,(c:1,d:1):1):1);", 6)])
def test_tree_shapes(text, n):
    assert len(list(formats.tip_distances(text.encode()))) == n


RDF = b"""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#">
<owl:Class rdf:about="x:root"><rdfs:label>root</rdfs:label></owl:Class>
<owl:Class rdf:about="x:leaf"><rdfs:label>leaf</rdfs:label><rdfs:subClassOf rdf:resource="x:root"/><rdfs:subClassOf rdf:resource="x:other"/><rdfs:subClassOf><owl:Restriction/></rdfs:subClassOf></owl:Class>
</rdf:RDF>"""
OWL = b"""<Ontology xmlns="http://www.w3.org/2002/07/owl#"><Declaration><Class IRI="#a"/></Declaration><Declaration><Class IRI="#b"/></Declaration>
<SubClassOf><Class IRI="#a"/><Class IRI="#b"/></SubClassOf><SubClassOf><Class IRI="#a"/><ObjectSomeValuesFrom/></SubClassOf>
<AnnotationAssertion><AnnotationProperty abbreviatedIRI="rdfs:label"/><IRI>#a</IRI><Literal>the a</Literal></AnnotationAssertion></Ontology>"""


def test_ontologies_in_either_form(spark, tmp_path):
    from varve.sources import formats

    for name, content in (("one.owl", RDF), ("two.owl", OWL)):
        (tmp_path / name).write_bytes(content)
    got = {(r.term, r.label, r.parent) for r in formats.read_ontology(spark, f"{tmp_path}/*.owl").collect()}
    assert got == {("x:root", "root", None), ("x:leaf", "leaf", "x:root"), ("x:leaf", "leaf", "x:other"), ("#a", "the a", "#b"), ("#b", None, None)}
