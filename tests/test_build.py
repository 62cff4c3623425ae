"""Flat sources as models, and the build's stages on a small model."""

import pytest
from pyspark.sql import functions as F

from pathweave import build
from pathweave.model import Model
from pathweave.service import ANALYSES, analysis
from pathweave.sinks import flat
from pathweave.sources import flatfiles as R
from pathweave.sources import models as M

ENTRY = "ID   MADE_UP   Reviewed;\nAC   Q90001; Q90002;\nDE   RecName: Full=Made up kinase {ECO:1};\nGN   Name=MADU1; Synonyms=MDU;\nOS   Homo sapiens (Human).\nOX   NCBI_TaxID=9606;\nDR   RefSeq; NP_900001.2; -.\n"
TERM = '[Term]\nid: CHEBI:90001\nname: made up acid\nsynonym: "C2H4" RELATED FORMULA [x]\nxref: CAS:1-2-3\nis_a: CHEBI:90000 ! parent\n'


def links(m, prop):
    return {(r.src, r.dst) for r in m.edges.filter(F.col("prop") == prop).collect()}


def test_uniprot_and_chemicals(spark):
    u = M.uniprot_model(R.uniprot_records(spark.createDataFrame([(ENTRY,)], "value string")))
    uri = M.REGISTRY + "uniprot:Q90001"
    assert links(u, "organism") == {(uri, M.REGISTRY + "ncbitaxon:9606")} and {r.uri for r in u.of_type("ProteinReference").collect()} == {uri}
    ids = {(r.type, r.value) for r in u.elements.join(u.literals.filter("prop = 'id'"), "uri").collect()}
    assert ids == {("UnificationXref", "Q90001"), ("RelationshipXref", "Q90002"), ("RelationshipXref", "NP_900001"), ("RelationshipXref", "MADU1")}
    assert {r.value for r in u.literals.filter(F.col("uri") == uri).collect()} >= {"MADE_UP", "Made up kinase", "MADU1", "MDU"}
    c = M.chemical_model(R.obo_terms(spark.createDataFrame([(TERM,)], "value string")))
    assert links(c, "memberEntityReference") == {(M.REGISTRY + "chebi:90000", M.REGISTRY + "chebi:90001")}
    assert {r.value for r in c.literals.filter("prop in ('displayName', 'chemicalFormula')").collect()} == {"made up acid", "C2H4"}


@pytest.mark.parametrize("complexes", [False, True])
def test_interactions(spark, complexes):
    rows = spark.createDataFrame([("k", ["uniprotkb:Q90001"], ["chebi:CHEBI:1"])], "line_key string, a_ids array<string>, b_ids array<string>")
    m = M.mitab_model(rows, complexes)
    assert len(links(m, "component" if complexes else "participant")) == 2 and {r.value for r in m.literals.filter("prop = 'id'").collect()} == {"Q90001", "CHEBI:1"}
    p = M.psimi_model(spark.createDataFrame([("1", "A", "uniprotkb", "Q90001"), ("1", "B", None, None)], "interaction string, participant string, db string, id string"), complexes)
    assert p.of_type("Protein").count() == 1 and set(M.CONVERTERS) == {"uniprot", "chebi", "mitab", "psimi"}


def test_build(spark, tmp_path):
    u = M.uniprot_model(R.uniprot_records(spark.createDataFrame([(ENTRY,)], "value string")))
    flat.write_model(u, f"{tmp_path}/stock")
    stock = flat.read_model(spark, f"{tmp_path}/stock")
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    provider = Model(
        make([("pw", "Pathway", "kegg"), ("p", "Protein", "kegg"), ("er", "ProteinReference", "kegg"), ("x", "UnificationXref", "kegg")], "uri string, type string, datasource string"),
        make([("pw", "pathwayComponent", "p"), ("p", "entityReference", "er"), ("er", "xref", "x")], "src string, prop string, dst string"),
        make([("x", "db", "refseq"), ("x", "id", "NP_900001"), ("p", "displayName", "made")], "uri string, prop string, value string"),
    )
    mapping = make([("NP_900001", "Q90001")], "src_id string, dst_id string")
    merged = build.merge(stock, mapping, [provider])
    assert links(merged, "entityReference") == {("p", M.REGISTRY + "uniprot:Q90001")} and "er" not in {r.uri for r in merged.elements.collect()}
    out = str(tmp_path)
    flat.write_model(merged, f"{out}/model")
    flat.write_model(merged, f"{out}/kept")
    docs = build.index(spark, out).documents
    assert {r.uri for r in docs.collect()} == {"pw", "p", M.REGISTRY + "uniprot:Q90001"}
    merged = flat.read_model(spark, f"{out}/kept")
    build.export(merged, docs, make([("p", "MADU1", False)], "uri string, ref string, molecule boolean"), f"{out}/export")
    assert [r.value for r in spark.read.text(f"{out}/export/sets.gmt").collect()] == ["pw\tname: pw; datasource: kegg; organism: Homo sapiens; idtype: hgnc.symbol\tMADU1"]
    analysis("drop_kegg")(lambda m: build.reset(m, "kegg"))
    after = build.modify(spark, out, "drop_kegg")
    assert "p" not in {r.uri for r in after.documents.collect()} and flat.read_model(spark, f"{out}/model").elements.filter("datasource = 'kegg'").count() == 0
    with pytest.raises(TypeError):
        build.modify(spark, out, "counts_by_class")
    del ANALYSES["drop_kegg"]
    more = build.attach_xrefs(provider, make([("p", "CHEBI:9"), ("x", "CHEBI:9")], "uri string, id string"), "CHEBI")
    assert len(links(more, "xref")) == 2 and {r.uri for r in build.select(provider, ["Process"], ["KEGG"]).collect()} == {"pw"}
