import gzip
import json
import zipfile

import pytest

from pathweave.sinks import flat
from pathweave.sources import biopax, flatfiles

UNIPROT = """-----------
ID   CALR_HUMAN              Reviewed;         417 AA.
AC   P27797; Q6IAT4;
AC   Q9UDG2;
DE   RecName: Full=Calreticulin {ECO:1};
DE   AltName: Full=CRP55;
GN   Name=CALR {ECO:2}; Synonyms=CRTC, HACBP;
OS   Homo sapiens (Human).
OX   NCBI_TaxID=9606;
DR   EMBL; M32294; AAA36582.1; -; mRNA.
DR   RefSeq; NP_004334.1; NM_004343.3.
DR   HGNC; HGNC:1455; CALR.
DR   PDB; 2CLR; X-ray.
DR   GO; GO:1; C:x.
//
ID   X_Y   z.
AC   P1;
//
"""
OBO = """format-version: 1.2

[Term]
id: CHEBI:422
name: (S)-lactaldehyde
def: "An aldehyde." [x]
alt_id: CHEBI:18
synonym: "(2S)-2-hydroxypropanal" EXACT IUPAC_NAME [I]
synonym: "L-lactaldehyde" EXACT []
property_value: http://purl.obolibrary.org/obo/chebi/formula "C3H6O2" xsd:string
property_value: http://purl.obolibrary.org/obo/chebi/mass "74.07850" xsd:string
property_value: http://purl.obolibrary.org/obo/chebi/inchikey "BSABBBMNWQWLLU-VKHMYHEASA-N" xsd:string
xref: KEGG:C00424 {source="KEGG"}
xref: Foo:1
is_a: CHEBI:18041 ! lactaldehyde
relationship: is_enantiomer_of CHEBI:167 ! x

[Typedef]
id: has_part
"""
OWL = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:bp="http://www.biopax.org/release/biopax-level3.owl#" xml:base="http://x.y#">
<bp:Protein rdf:ID="p1"><bp:displayName rdf:datatype = "xsd:string">  P
 one </bp:displayName><bp:entityReference rdf:resource="#er1"/></bp:Protein>
<bp:ProteinReference rdf:about="http://x.y#er1"><bp:xref><bp:UnificationXref rdf:about="uniprot:P1"><bp:id>P1</bp:id></bp:UnificationXref></bp:xref></bp:ProteinReference>
<bp:Protein rdf:ID="p1"><bp:displayName>P one</bp:displayName></bp:Protein></rdf:RDF>"""


def test_uniprot(spark, tmp_path):
    (tmp_path / "u.dat.gz").write_bytes(gzip.compress(UNIPROT.encode()))
    e = flatfiles.read_uniprot(spark, str(tmp_path / "u.dat.gz")).cache()
    assert [r.ac for r in flatfiles.uniprot_accessions(e).filter("entry_name = 'CALR_HUMAN'").orderBy("place").collect()] == ["P27797", "Q6IAT4", "Q9UDG2"]
    assert {(r.name, r.is_standard) for r in flatfiles.uniprot_names(e).collect()} == {("Calreticulin", True), ("CRP55", False)}
    assert {(r.symbol, r.is_synonym) for r in flatfiles.uniprot_genes(e).collect()} == {("CALR", False), ("CRTC", True), ("HACBP", True)}
    assert {(r.db, r.id) for r in flatfiles.uniprot_xrefs(e).collect()} == {("Nucleotide Sequence Database", "M32294"), ("Nucleotide Sequence Database", "AAA36582.1"), ("refseq", "NP_004334"), ("refseq", "NM_004343"), ("HGNC", "HGNC:1455"), ("hgnc.symbol", "CALR"), ("PDB", "2CLR")}


def test_obo(spark, tmp_path):
    (tmp_path / "c.obo").write_text(OBO)
    c = flatfiles.chemicals(flatfiles.read_obo(spark, str(tmp_path / "c.obo"))).collect()
    assert len(c) == 1
    c = c[0]
    assert (c.id, c.standard_name, c.formula, c.inchikey, c.alt_ids, c.parents) == ("CHEBI:422", "(2S)-2-hydroxypropanal", "C3H6O2", "BSABBBMNWQWLLU-VKHMYHEASA-N", ["CHEBI:18"], ["CHEBI:18041"])
    assert c.names == ["L-lactaldehyde", "C3H6O2"] and abs(c.mass - 74.0785) < 1e-4 and [tuple(x) for x in c.xrefs] == [("KEGG Compound", "C00424")] and c.relationships[0].type == "is_enantiomer_of"


def test_biopax_round_trip(spark, tmp_path):
    (tmp_path / "a.owl").write_text(OWL)
    m = biopax.read_biopax(spark, str(tmp_path / "a.owl"), "test")
    assert {(r.uri, r.type) for r in m.elements.collect()} == {("http://x.y#p1", "Protein"), ("http://x.y#er1", "ProteinReference"), ("uniprot:P1", "UnificationXref")}
    assert {tuple(r) for r in m.edges.collect()} == {("http://x.y#p1", "entityReference", "http://x.y#er1"), ("http://x.y#er1", "xref", "uniprot:P1")}
    assert {tuple(r) for r in m.literals.collect()} == {("http://x.y#p1", "displayName", "P one"), ("uniprot:P1", "id", "P1")}
    text = flat.owl_header("http://x.y#") + "\n".join(r.value for r in flat.owl_lines(m).collect()) + "</rdf:RDF>"
    (tmp_path / "b.owl").write_text(text)
    again = biopax.read_biopax(spark, str(tmp_path / "b.owl"), "test")
    for a, b in ((m.elements, again.elements), (m.edges, again.edges), (m.literals, again.literals)):
        assert sorted(a.collect()) == sorted(b.collect())
    assert all(json.loads(r.value)["@id"] for r in flat.jsonld_lines(m).collect())
    flat.write_model(m, str(tmp_path / "m"))
    assert flat.read_model(spark, str(tmp_path / "m")).elements.count() == 3 and not flat.is_empty(m)


def test_tables(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("HGNC\tUniProt\n5\tP1\nx\tP2\n6\t\n5\tP1\n")
    got = flatfiles.read_simple_mapping(spark, str(tmp_path / "m.tsv"), {"hgnc": "[0-9]+"}).collect()
    assert [tuple(r) for r in got] == [("HGNC", "5", "UNIPROT", "P1")]
    (tmp_path / "md.json").write_text(json.dumps({"datasources": [{"identifier": "a", "name": ["A", "B"], "type": "BIOPAX"}, {"identifier": "b"}]}))
    assert [r.identifier for r in flatfiles.read_metadata(spark, str(tmp_path / "md.json")).collect()] == ["a", "b"]
    (tmp_path / "t.txt").write_text("#h\nuniprotkb:P1\tuniprotkb:P2\t-\t-\t-\t-\tpsi-mi:x\t-\tpubmed:1|pubmed:2\ttaxid:9606(human)\ttaxid:-1\t-\t-\tid:1\t-\n")
    r = flatfiles.read_mitab(spark, str(tmp_path / "t.txt")).first()
    assert (r.a_ids, r.publications, r.taxon_a, r.taxon_b) == (["uniprotkb:P1"], ["pubmed:1", "pubmed:2"], 9606, -1)
    with pytest.warns(UserWarning):
        assert flatfiles.read_blacklist(spark, str(tmp_path / "none.txt")) is None
    (tmp_path / "empty.txt").write_text("")
    with pytest.raises(ValueError):
        flatfiles.read_blacklist(spark, str(tmp_path / "empty.txt"))


def test_archive(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for n in ("d/", "d/a b.owl", "__MACOSX/x", "d/.hidden"):
            z.writestr(n, "data")
    files = biopax.expand_archive(str(tmp_path / "a.zip"), str(tmp_path / "out"))
    assert [f.rsplit("/", 1)[1] for f in files] == ["d_a_b.owl.orig.gz"] and gzip.open(files[0]).read() == b"data"


def test_psimi(spark, tmp_path):
    p = '<participant id="{0}"><interactor><names><shortLabel>{1}</shortLabel></names><xref><primaryRef db="uniprotkb" id="{1}"/></xref></interactor></participant>'
    (tmp_path / "x.xml").write_text('<entrySet><interaction id="1"><participantList>' + p.format(1, "P1") + p.format(2, "P2") + "</participantList></interaction></entrySet>")
    assert [tuple(r) for r in biopax.read_psimi(spark, str(tmp_path / "x.xml")).collect()] == [("1", "P1", "uniprotkb", "P1"), ("1", "P2", "uniprotkb", "P2")]
    assert biopax.read_psimi(spark, str(tmp_path / "x.xml"), complexes=True).first().members == ["uniprotkb:P1", "uniprotkb:P2"]
