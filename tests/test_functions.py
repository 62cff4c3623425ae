import pytest
from pyspark.sql import functions as F

from pathweave.functions import ids, text

URIS = [
    ("bioregistry.io/chebi:1", "CHEBI:1"), ("http://bioregistry.io/uniprot:A", "A"), ("http://identifiers.org/chebi/CHEBI:1", "CHEBI:1"),
    ("identifiers.org/uniprot/A", "A"), ("identifiers.org/pubchem:1", "CID:1"), ("bioregistry.io/pubchem.substance:1", "SID:1"), ("a.foo/bar", None), (None, None),
]
REBASE = [
    ("bioregistry.io/chebi:1", None, None, "bioregistry.io/chebi:1"), ("uniprot:1", "foo", "bar:", "uniprot:1"), ("uniprot:1", None, "bar:", "uniprot:1"), ("a.foo/bar", None, None, "bar"),
    ("https://a.foo/bar1", "https://a.foo/", "xyz:", "xyz:bar1"), ("http://a.foo#bar1", "http://a.foo#", "xyz:", "xyz:bar1"), ("ftp://a.foo#bar1", None, "xyz:", "xyz:bar1"),
    ("foo#123", "whatever/", "bar:", "foo#123"), ("http://smpdb.ca/pathways/#a1", None, "foo:", "foo:a1"), ("foo:123", "foo:", "bar:", "bar:123"), ("foo:123", None, "bar:", "foo:123"), ("plain", None, "x:", "x:plain"),
]
FIX = [
    ("uniprot", "Q8TD86-1", "Q8TD86"), ("uniprot isoform", "Q8TD86-1", "Q8TD86"), ("refseq", "NP_619650.1", "NP_619650"), ("ChEBI", "28", "CHEBI:28"), ("chEbi", "chebi:28", "CHEBI:28"),
    ("PubChem-substance", "14438", "SID:14438"), ("pubchem.compound", "cid:5", "CID:5"), ("KEGG genes", "hsa:123", "123"), ("other", "X-1", "X-1"), ("uniprot", None, None),
]


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


@pytest.mark.parametrize(("uri", "expected"), URIS)
def test_id_from_uri(spark, uri, expected):
    assert one(spark, ids.id_from_uri("u"), u=uri) == expected


@pytest.mark.parametrize(("uri", "old", "new", "expected"), REBASE)
def test_rebase(spark, uri, old, new, expected):
    assert one(spark, ids.rebase_uri("u", new, old), u=uri) == expected


@pytest.mark.parametrize(("db", "i", "expected"), FIX)
def test_fix(spark, db, i, expected):
    assert one(spark, ids.fix_id_for_mapping("d", "i"), d=db, i=i) == expected


def test_stored_form_keeps_kegg(spark):
    assert one(spark, ids.fix_id_for_mapping("d", "i", kegg_suffix=False), d="KEGG", i="hsa:123") == "hsa:123"


def test_names(spark):
    assert one(spark, text.strip_name_markup("n"), n="<i>&beta;-Protein</i>") == "beta-Protein"
    assert one(spark, text.strip_name_markup("n"), n="Protein A &amp;beta;-chain") == "Protein A beta-chain"
    assert one(spark, F.concat_ws("|", text.tokens("n")), n="The β-catenin of Wnt/1") == "β|catenin|wnt|1"


def test_plain_python():
    assert text.stage_file("/foo/bar.some.gz", "normalized") == "/foo/bar.normalized.gz"
    assert text.sanitized_file("d", "a b/c.owl") == "d/a_b_c.owl.orig.gz"
    assert text.taxonomy_names(["Homo sapiens (9606)"]) == {"9606": "Homo sapiens"}
    with pytest.raises(ValueError):
        text.taxonomy_names(["Homo sapiens"])
    assert text.parse_enum(text.Format, "extended-binary_sif") is text.Format.EXTENDED_BINARY_SIF and text.parse_enum(text.Format, "x") is None
    assert text.split_arguments("a,b", "b", " c ") == ["a", "b", "c"]
    assert text.valid_source_id("a_b") and not text.valid_source_id("a b") and not text.valid_source_id("a-b")
