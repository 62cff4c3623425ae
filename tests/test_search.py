import pytest

from pathweave.functions.text import name_variants, tokens
from pathweave.model import Model
from pathweave.operators import search as S
from pathweave.plans.querylang import parse, scored_terms
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("1", "SmallMolecule", "ATP binds beta-d-fructose-6-phosphate", "beta-D-fructose 6-phosphate", ["CHEBI:20", "chebi:20"], "glycolysis", "Escherichia coli", "kegg"), ("2", "Protein", "the kinase of fructose", "P16104", ["P16104"], "Pathway50", "Homo sapiens", "other")]
    df = spark.createDataFrame(rows, "uri string, type string, text string, n string, xref_ids array<string>, p string, o string, d string")
    return df.select("uri", "type", tokens("text").alias("keywords"), name_variants("n").alias("names"), "xref_ids", F.array("p").alias("pathways"), tokens("o").alias("organisms"), F.array("d").alias("datasources"), F.array("uri").alias("uris"))


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("ATP", "1"), ("atp OR kinase", "12"), ("fructose AND NOT kinase", "1"), ("+fructose -atp", "2"), ("beta-d-fructose", "12"), ('"beta-d-fructose"', "1"), ("pathway:glycolysis", "1"), ("pathway:GlycoLysis", ""),
        ("xrefid:P16104", "2"), ("xrefid:p16104", ""), (r"xrefid:CHEBI\:20", "1"), ('xrefid:"chebi:20"', "1"), ("name:b?ta?D*6?p*", "1"), ("name:*fructose*", "1"), ("name:fructose", ""), ("*", "12"), ("(atp OR kinase) AND fructose", "12"), ("kin*", "2"), ("the", ""),
    ],
)
def test_queries(docs, query, expected):
    assert "".join(sorted(r.uri for r in S.search(docs, query).select("uri").collect())) == expected


def test_facets_and_errors(docs):
    assert [r.uri for r in S.search(docs, "*", organisms=["Escherichia coli"]).collect()] == ["1"]
    assert [r.uri for r in S.search(docs, "*", datasources=["KEGG"]).collect()] == ["1"]
    for bad in ("", "(a", "nofield:x", "-a", "a)"):
        with pytest.raises(ValueError):
            parse(bad)
    assert scored_terms(parse("a1 AND NOT b1")) == ["a1"]


def test_bm25_and_pages(spark):
    df = spark.createDataFrame([(1, "cat dog"), (2, "cat cat"), (3, "dog"), (4, None), (5, "")], "id int, t string")
    p = S.postings(df, "id", "t")
    stats = spark.createDataFrame([(3, 5 / 3)], "n bigint, avg_len double")
    got = S.page_of(S.bm25(p, stats, ["cat"]), 0, 10).collect()
    assert [r.uri for r in got] == ["2", "1"] and S.page_of(S.bm25(p, stats, ["cat"]), 1, 1).first().uri == "1"


def test_documents_of_a_model(spark):
    m = Model(
        spark.createDataFrame([("pw", "Pathway", "kegg"), ("p", "Protein", "kegg"), ("x", "UnificationXref", None)], "uri string, type string, datasource string"),
        spark.createDataFrame([("pw", "pathwayComponent", "p"), ("p", "xref", "x")], "src string, prop string, dst string"),
        spark.createDataFrame([("pw", "name", "Glycolysis"), ("x", "id", "CHEBI:20"), ("p", "comment", "REPLACED x")], "uri string, prop string, value string"),
    )
    d = {r.uri: r for r in S.search_documents(m).collect()}
    assert set(d) == {"pw", "p"} and d["p"].xref_ids == ["CHEBI:20", "chebi:20"] and d["p"].pathways == ["glycolysis", "pw"] and d["pw"].num_participants == 1 and "replaced" not in d["p"].keywords
