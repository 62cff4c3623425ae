"""Flat sources as models: UniProt and OBO as warehouse references, PSI-MITAB and PSI-MI as molecular interactions (SRC6-SRC11)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.model import Model
from pathweave.sources import flatfiles as R

REGISTRY = "http://bioregistry.io/"


def _elements(rows: DataFrame, uri: Column, kind: str, datasource: str) -> DataFrame:
    return rows.select(uri.alias("uri"), F.lit(kind).alias("type"), F.lit(datasource).alias("datasource"))


def _edges(rows: DataFrame, src: Column, prop: str, dst: Column) -> DataFrame:
    return rows.select(src.alias("src"), F.lit(prop).alias("prop"), dst.alias("dst"))


def _literals(rows: DataFrame, uri: Column, prop: str, value: Column) -> DataFrame:
    return rows.select(uri.alias("uri"), F.lit(prop).alias("prop"), value.cast("string").alias("value")).filter(F.col("value").isNotNull() & (F.col("value") != ""))


def _model(elements: list[DataFrame], edges: list[DataFrame], literals: list[DataFrame]) -> Model:
    union = lambda parts: reduce(DataFrame.unionByName, parts).distinct()
    return Model(union(elements), union(edges), union(literals))


def _xrefs(rows: DataFrame, owner: Column, kind: str, datasource: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Elements, edges and literals of references (db, id) of owners; equal ones meet under one uri."""
    uri = F.concat(F.lit(f"{kind}_"), F.md5(F.concat_ws("|", F.lower("db"), "id")))
    return _elements(rows, uri, kind, datasource), _edges(rows, owner, "xref", uri), [_literals(rows, uri, "db", F.lower("db")), _literals(rows, uri, "id", F.col("id"))]


def uniprot_model(entries: DataFrame, datasource: str = "uniprot") -> Model:
    """SRC6, SCA21-SCA25: protein references of parsed entries: names, genes, accessions (the first gives the uri), references, organism."""
    acs = R.uniprot_accessions(entries)
    first = acs.filter("place = 0").select("entry_name", F.concat(F.lit(f"{REGISTRY}uniprot:"), "ac").alias("uri"))
    with_uri = lambda rows: rows.join(first, "entry_name")
    uri = F.col("uri")
    names, genes = with_uri(R.uniprot_names(entries)), with_uri(R.uniprot_genes(entries))
    primary = with_uri(acs.filter("place = 0").select("entry_name", F.lit("uniprot").alias("db"), F.col("ac").alias("id")))
    second = with_uri(acs.filter("place > 0").select("entry_name", F.lit("uniprot").alias("db"), F.col("ac").alias("id")))
    symbols = genes.filter("not is_synonym").select("entry_name", "uri", F.lit("hgnc.symbol").alias("db"), F.col("symbol").alias("id"))
    parts = [_xrefs(primary, uri, "UnificationXref", datasource), *(_xrefs(x, uri, "RelationshipXref", datasource) for x in (second, symbols, with_uri(R.uniprot_xrefs(entries))))]
    taxa = with_uri(entries.select("entry_name", F.regexp_extract("ox", r"NCBI_TaxID=([0-9]+)", 1).alias("taxon"), F.trim(F.regexp_extract("os", r"^([^(.]*)", 1)).alias("species"))).filter("taxon <> ''")
    source = F.concat(F.lit(f"{REGISTRY}ncbitaxon:"), "taxon")
    return _model(
        [_elements(first, uri, "ProteinReference", datasource), _elements(taxa, source, "BioSource", datasource), *(p[0] for p in parts)],
        [_edges(taxa, uri, "organism", source), *(p[1] for p in parts)],
        [
            _literals(first, uri, "displayName", F.col("entry_name")), _literals(names.filter("is_standard"), uri, "standardName", F.col("name")), _literals(names, uri, "name", F.col("name")),
            _literals(genes, uri, "name", F.col("symbol")), _literals(taxa, source, "displayName", F.col("species")), *(x for p in parts for x in p[2]),
        ],
    )


def chemical_model(terms: DataFrame, datasource: str = "chebi") -> Model:
    """SRC7, SRC8, SCA28, SCA29: small molecule references of parsed terms; a parent has its children as members, other relationships
    are relationship references."""
    c = R.chemicals(terms)
    of = lambda id_: F.concat(F.lit(REGISTRY), F.lower(F.regexp_replace(id_, "^([^:]*):.*$", "$1")), F.lit(":"), F.regexp_replace(id_, "^[^:]*:", ""))
    uri = of(F.col("id"))
    rows = c.withColumn("uri", uri)
    u = F.col("uri")
    own = rows.select("uri", F.lit("chebi").alias("db"), "id")
    alt = rows.select("uri", F.lit("chebi").alias("db"), F.explode("alt_ids").alias("id"))
    other = rows.select("uri", F.inline("xrefs"))
    related = rows.select("uri", F.lit("chebi").alias("db"), F.explode(F.transform("relationships", lambda r: r["id"])).alias("id"))
    parts = [_xrefs(own, u, "UnificationXref", datasource), *(_xrefs(x, u, "RelationshipXref", datasource) for x in (alt, other, related))]
    above = rows.select("uri", F.explode("parents").alias("parent"))
    structure = F.concat(u, F.lit("_structure"))
    with_inchi = rows.filter("inchi is not null and inchi <> ''")
    return _model(
        [_elements(rows, u, "SmallMoleculeReference", datasource), _elements(with_inchi, structure, "ChemicalStructure", datasource), *(p[0] for p in parts)],
        [_edges(above, of(F.col("parent")), "memberEntityReference", u), _edges(with_inchi, u, "structure", structure), *(p[1] for p in parts)],
        [
            _literals(rows, u, "displayName", F.col("name")), _literals(rows, u, "standardName", F.col("standard_name")), _literals(rows.select("uri", F.explode("names").alias("n")), u, "name", F.col("n")),
            _literals(rows, u, "chemicalFormula", F.col("formula")), _literals(rows, u, "molecularWeight", F.col("mass")), _literals(with_inchi, structure, "structureData", F.col("inchi")), *(x for p in parts for x in p[2]),
        ],
    )


def _interactions(rows: DataFrame, complexes: bool, datasource: str) -> Model:
    """Molecular interactions, or complexes, of participants (interaction, participant, db, id)."""
    top = F.concat(F.lit("Complex_" if complexes else "MolecularInteraction_"), F.md5("interaction"))
    part = F.concat(F.lit("Protein_"), F.md5(F.concat_ws("|", F.lower("db"), "id")))
    x, links, ids = _xrefs(rows, part, "RelationshipXref", datasource)
    return _model(
        [_elements(rows, top, "Complex" if complexes else "MolecularInteraction", datasource), _elements(rows, part, "Protein", datasource), x],
        [_edges(rows, top, "component" if complexes else "participant", part), links],
        [_literals(rows, part, "displayName", F.coalesce("participant", "id")), *ids],
    )


def mitab_model(rows: DataFrame, complexes: bool = False, datasource: str = "mitab") -> Model:
    """SRC10, SRC11: the model of read_mitab's rows; a participant is its first id."""
    side = lambda c: rows.select(F.col("line_key").alias("interaction"), F.lit(None).cast("string").alias("participant"), F.get(c, F.lit(0)).alias("x"))
    both = side("a_ids").unionByName(side("b_ids")).filter("x is not null")
    return _interactions(both.select("interaction", "participant", F.substring_index("x", ":", 1).alias("db"), F.regexp_replace("x", "^[^:]*:", "").alias("id")), complexes, datasource)


def psimi_model(rows: DataFrame, complexes: bool = False, datasource: str = "psimi") -> Model:
    """SRC9, SRC11: the model of read_psimi's rows (interaction, participant, db, id)."""
    return _interactions(rows.filter("id is not null"), complexes, datasource)


#: UDF3: converters by name: what a source's rows become.
CONVERTERS = {"uniprot": uniprot_model, "chebi": chemical_model, "mitab": mitab_model, "psimi": psimi_model}
