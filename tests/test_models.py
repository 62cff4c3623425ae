"""Cleaners, quality rules, the service, plug-ins and streaming upserts on a small model."""

import json
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from pathweave import quality
from pathweave.clean import providers as C
from pathweave.model import PARENTS, Model
from pathweave.operators import entities as E
from pathweave.operators import interactions as I
from pathweave.operators import search as S
from pathweave.operators.search import search_documents
from pathweave.service import BadRequest, Service, analyze, catalogue
from pathweave.sinks import flat
from pathweave.streaming.upserts import upsert_stream


def make(spark, elements, edges=(), literals=()):
    return Model(
        spark.createDataFrame([(u, t, "ds") for u, t in elements], "uri string, type string, datasource string"),
        spark.createDataFrame(list(edges), "src string, prop string, dst string"), spark.createDataFrame(list(literals), "uri string, prop string, value string"),
    )


def types(m):
    return {r.uri: r.type for r in m.elements.collect()}


def values(m, prop):
    return {(r.uri, r.value) for r in m.literals.filter(f"prop = '{prop}'").collect()}


def links(m, prop):
    return {(r.src, r.dst) for r in m.edges.filter(f"prop = '{prop}'").collect()}


def test_reactome(spark):
    m = make(spark, [("a", "Pathway"), ("b", "Pathway"), ("c", "Conversion"), ("x", "UnificationXref"), ("o", "RelationshipXref")], [("a", "xref", "x"), ("b", "xref", "x"), ("a", "xref", "o")], [("x", "db", "Reactome"), ("x", "id", "REACTOME:R-1"), ("o", "db", "Reactome Database ID"), ("o", "id", "5")])
    out = C.reactome(m)
    t = types(out)
    assert t["http://bioregistry.io/reactome:R-1"] == "Pathway" and "a" not in t and "o" not in t and values(out, "conversionDirection") == {("c", "LEFT_TO_RIGHT")}
    assert {t[d] for s, d in links(out, "xref") if s == "b"} == {"RelationshipXref"}


def test_humancyc_and_names(spark):
    m = make(spark, [("p", "Protein"), ("x", "UnificationXref"), ("er", "ProteinReference"), ("u1", "UnificationXref"), ("u2", "UnificationXref"), ("pw", "Pathway")], [("p", "xref", "x"), ("er", "xref", "u1"), ("er", "xref", "u2")], [("p", "displayName", "<i>&beta;</i>-P"), ("x", "db", "entrez"), ("x", "id", "1"), ("u1", "db", "UniProt"), ("u1", "id", "Q2"), ("u2", "db", "UniProt"), ("u2", "id", " Q1")])
    out = C.humancyc(m)
    assert links(out, "xref") == {("er", "u2")} and values(out, "displayName") == {("p", "beta-P")} and ("x", "NCBI Gene") in values(out, "db") and len(links(out, "organism")) == 1


def test_pathbank(spark):
    m = make(
        spark, [("http://identifiers.org/smpdb/S1", "Pathway"), ("sub", "Pathway"), ("st", "PathwayStep"), ("r", "BiochemicalReaction"), ("i", "Interaction"), ("b/Taxonomy_9606", "BioSource")],
        [("http://identifiers.org/smpdb/S1", "pathwayOrder", "st"), ("st", "stepProcess", "r"), ("http://identifiers.org/smpdb/S1", "pathwayComponent", "sub"), ("r", "organism", "b/Taxonomy_9606")], [("sub", "name", "SubPathway"), ("r", "name", "subpathway 1")],
    )
    out = C.pathbank(m)
    assert set(types(out)) == {"http://bioregistry.io/pathbank:S1", "r", "b/Taxonomy_9606"} and links(out, "pathwayComponent") == {("http://bioregistry.io/pathbank:S1", "r")} and not values(out, "name")
    assert C.pathbank(make(spark, [("b/Taxonomy_1", "BioSource")])).elements.count() == 0


def test_panther_inoh_kegg_netpath_others(spark):
    m = make(
        spark, [("pw", "Pathway"), ("r", "BiochemicalReaction"), ("k", "Catalysis"), ("g", "ProteinReference"), ("one", "ProteinReference"), ("p", "Protein"), ("x", "RelationshipXref"), ("mouse", "BioSource"), ("far", "ProteinReference")],
        [("pw", "pathwayComponent", "r"), ("k", "controlled", "r"), ("g", "memberEntityReference", "one"), ("p", "entityReference", "g"), ("p", "xref", "x"), ("far", "organism", "mouse")], [("x", "db", "PANTHER Pathway"), ("x", "id", "1")],
    )
    out = C.panther(m)
    assert ("pw", "k") in links(out, "pathwayComponent") and ("p", "one") in links(out, "entityReference") and not {"x", "mouse", "far"} & set(types(out))
    out = C.inoh(make(spark, [("p", "Protein"), ("er", "ProteinReference"), ("x", "PublicationXref"), ("t", "TemplateReaction")], [("p", "entityReference", "er"), ("p", "xref", "x")], [("x", "db", "UniProt"), ("x", "id", "P1")]))
    assert types(out) == {"p": "Protein", "er": "ProteinReference", "x": "RelationshipXref"} and links(out, "xref") == {("er", "x")}
    out = C.kegg(make(spark, [("p", "Protein"), ("er", "ProteinReference"), ("x", "UnificationXref")], [("p", "entityReference", "er"), ("p", "xref", "x"), ("er", "xref", "x")], [("p", "displayName", "ABC..."), ("p", "name", "ABC DEF"), ("p", "name", "ABD DEF")]))
    assert links(out, "xref") == {("er", "x")} and values(out, "displayName") == {("p", "ABC DEF")}
    out = C.netpath(make(spark, [("v", "CellVocabulary"), ("x", "RelationshipXref")], [("v", "xref", "x")], [("v", "term", "phospho-serine")]))
    assert values(out, "term") == set() or values(out, "term") == {("v", "phospho-L-serine")}
    assert values(C.drugbank(make(spark, [("x", "UnificationXref")], [], [("x", "db", "GenBank Protein Database")])), "db") == {("x", "genbank")}
    lines = spark.createDataFrame([('<secondaryRef db="uniprot" dbAc="a" id="b"/>',), ('x "07467 "',)], "value string")
    assert [r.value for r in C.hprd_lines(lines).collect()] == ['<secondaryRef db="uniprot" dbAc="a" id="b" refType="identity"/>', 'x "074670"']
    assert set(types(C.repair_uris(make(spark, [("a/intact_complex:1", "Complex"), ("z", "Evidence")])))) == {"a/intact.complex:1"}


def test_quality(spark):
    m = make(spark, [("c", "Control"), ("n", "Nothing")], [("c", "controlled", "gone")], [("c", "controlType", "WRONG"), ("c", "name", " ")])
    v = quality.check(quality.model_rules(m))
    assert {(r.rule, r.uri) for r in v.collect()} == {("unknown.class", "n"), ("range.violated", "c"), ("dangling.reference", "c"), ("blank.value", "c")} and quality.unfixed_errors(v).first().n == 2
    stamped = quality.stamp_source(make(spark, [("p", "Protein"), ("old", "Provenance")], [("p", "dataSource", "old")]), "new", ["N"])
    assert links(stamped, "dataSource") == {("p", "new")} and "old" not in types(stamped)
    named = quality.name_organisms(make(spark, [("b", "BioSource"), ("x", "UnificationXref")], [("b", "xref", "x")], [("x", "id", "9606"), ("b", "displayName", "h")]), {"9606": "Homo sapiens"})
    assert values(named, "displayName") == {("b", "Homo sapiens")}


@pytest.fixture(scope="module")
def service(spark):
    m = make(
        spark, [("pw", "Pathway"), ("r", "BiochemicalReaction"), ("k", "Catalysis"), ("e", "Protein"), ("a", "SmallMolecule"), ("b", "SmallMolecule"), ("x", "UnificationXref")],
        [("pw", "pathwayComponent", "r"), ("r", "left", "a"), ("r", "right", "b"), ("k", "controlled", "r"), ("k", "controller", "e"), ("e", "xref", "x")], [("e", "displayName", "Enzyme"), ("x", "id", "P12345"), ("a", "name", "ATP")],
    )
    mapping = spark.createDataFrame([("HGNC", "5", "UNIPROT", "P12345")], "src_db string, src_id string, dst_db string, dst_id string")
    return Service(m, search_documents(m).cache(), mapping)


def test_service(spark, service):
    found = service.search("atp").collect()
    assert "a" in [r.uri for r in found] and [(-r.score, r.uri) for r in found] == sorted((-r.score, r.uri) for r in found)
    assert [r.name for r in service.search("xrefid:P12345", type_="Protein").collect()] == ["Enzyme"]
    assert set(types(service.fetch("k"))) == {"k", "r", "e", "x", "a", "b"}
    assert [tuple(r) for r in service.traverse("Protein/displayName", "P12345").collect()] == [("e", "Enzyme")]
    assert service.map_ids("UNIPROT", "5,6").first().mapped == ["P12345"]
    assert {r.uri for r in service.query_graph("neighborhood", ["P12345"]).collect()} == {"e", "k", "x"}
    assert {r.uri for r in service.query_graph("PATHSFROMTO", ["k"], ["b"], 3).collect()} == {"k", "r", "b"}
    refs = spark.createDataFrame([("e", "ENZ", False), ("a", "CHEBI:1", True), ("b", "CHEBI:2", True)], "uri string, ref string, molecule boolean")
    assert {r.value for r in service.convert(service.model, "binary_sif", refs).collect()} == {"CHEBI:1\tconsumption-controlled-by\tENZ", "ENZ\tcontrols-production-of\tCHEBI:2", "CHEBI:1\tused-to-produce\tCHEBI:2"}
    assert all(json.loads(r.value) for r in service.convert(service.model, "JSONLD").collect()) and service.convert(service.model, "sbgn", refs).count() > 3
    member = spark.createDataFrame([("e", "ENZ", False), ("r", "RX", False)], "uri string, ref string, molecule boolean")
    assert [r.value for r in service.convert(service.model, "GSEA", member).collect()] == ["pw\tname: pw; datasource: ds; organism: ; idtype: hgnc.symbol\tRX"]
    txt = [r.value for r in service.convert(service.model, "TXT", refs).orderBy("part", "value").collect()]
    assert txt[0].startswith("PARTICIPANT_A\t") and any(v.startswith("ENZ\tProteinReference\tEnzyme\tP12345") for v in txt) and "" in txt
    assert {r.uri for r in service.query_graph("neighborhood", ["P12345"], limit=3, datasources=["nowhere"]).collect()} == {"e"}
    assert {r.uri for r in service.query_graph("neighborhood", ["P12345"], datasources=["ds"]).collect()} == {"e", "k", "x"}
    for call in (lambda: service.search(" "), lambda: service.query_graph("x", ["a"]), lambda: service.convert(service.model, "x"), lambda: service.traverse("x", "a"), lambda: service.query_graph("commonstream", ["a"], direction="undirected"), lambda: service.resolve("")):
        with pytest.raises(BadRequest):
            call()
    assert ("formats", "BIOPAX") in catalogue(service.model) and {r.type for r in analyze("counts_by_class", service.model).collect()} >= {"Protein"}


def test_interactions_blacklist(spark):
    roles = spark.createDataFrame([(1, "complex", "component", r, False, "", "", "") for r in "abc"], "reaction int, kind string, role string, ref string, molecule boolean, state string, location string, phospho string")
    assert {(r.a, r.b) for r in I.infer(roles, ("in-complex-with",), spark.createDataFrame([("b",)], "ref string")).collect()} == {("a", "c")}
    with pytest.raises(ValueError):
        I.infer(roles, ())


def test_entities(spark):
    x = spark.createDataFrame([("u", "UnificationXref", " ", "1"), ("v", "PublicationXref", None, "1"), ("w", "RelationshipXref", "CHEBI", "1")], "uri string, type string, db string, id string")
    assert {(r.uri, r.db) for r in E.clean_xrefs(x).collect()} == {("v", None), ("w", "chebi")}
    a = spark.createDataFrame([("1", "ATP"), ("2", "x"), ("3", None)], "uri string, name string")
    b = spark.createDataFrame([("m", "atp"), ("n", "X"), ("o", "x")], "uri string, name string")
    assert [tuple(r) for r in E.by_name(a, b).collect()] == [("1", "m")]


def test_stream(spark, tmp_path):
    schema = "src_db string, src_id string, dst_db string, dst_id string"
    rows = [("uniprot", "P1-2", "chebi", "5"), ("uniprot", "P1", "CHEBI", "CHEBI:5"), ("a", None, "b", "c")]
    for i in range(2):
        spark.createDataFrame(rows[: 2 + i], schema).write.mode("append").parquet(str(tmp_path / "in"))
        upsert_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [(r.src_id, r.dst_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("P1", "CHEBI:5")]


def test_stored_index(spark, service, tmp_path):
    index = service.index.write(str(tmp_path / "index"))
    again = S.open_index(spark, str(tmp_path / "index"))
    assert {r.uri for r in S.ranked(again, "enzyme OR atp").collect()} == {r.uri for r in S.ranked(service.index, "enzyme OR atp").collect()}
    stored = Service(service.model, again, service.mapping, page_size=1)
    first, second = stored.search("enzyme OR atp").collect(), stored.search("enzyme OR atp", 1).collect()
    assert len(first) == len(second) == 1 and first[0].score >= second[0].score and first[0].uri != second[0].uri
    new = index.documents.filter("uri = 'e'").withColumn("keywords", F.array(F.lit("changed")))
    updated = index.with_documents(new)
    assert [r.uri for r in S.ranked(updated, "changed").collect()] == ["e"] and updated.documents.count() == index.documents.count()


def test_top_pathways_by_child(spark):
    docs = spark.createDataFrame([("big", "Pathway", ["up"], 3), ("up", "Pathway", [], 1), ("own", "Pathway", [], 3), ("small", "Pathway", [], 2)], "uri string, type string, pathway_uris array<string>, num_processes int")
    edges = spark.createDataFrame([("up", "pathwayComponent", "big")], "src string, prop string, dst string")
    assert {r.uri for r in S.top_pathways(docs, PARENTS, edges).collect()} == {"up", "own"}


def test_documents(spark, tmp_path):
    pairs = spark.createDataFrame([("A", "used-to-produce", "B")], "a string, relation string, b string")
    flat.write_document(flat.sbgn_lines(pairs), str(tmp_path / "sbgn"), flat.SBGN_HEADER, flat.SBGN_FOOTER)
    text = "\n".join(r.value for k in range(3) for r in spark.read.text(f"{tmp_path}/sbgn/{k}").collect())
    assert ElementTree.fromstring(text.split("?>", 1)[1]).find(".//{*}arc").get("class") == "production"
