"""Line-oriented sources: UniProt flat files, OBO stanzas, PSI-MITAB, two-column id mappings, metadata JSON, blacklists (SRC6-SRC14)."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathweave.functions.ids import valid_id
from pathweave.runtime import filled


def read_uniprot(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: (record, lines) of a flat file (gzipped or not): records end with ``//``, so each is one row wherever the file is cut."""
    return uniprot_records(spark.read.option("lineSep", "//\n").text(path))


def uniprot_records(texts: DataFrame, column: str = "value") -> DataFrame:
    """(entry_name, ac, de, gn, os, ox, dr, cc, ft) of record texts: the data (from column 6 on) of each line code in order, joined.

    Lines of DR keep their ends, others are joined by a blank. Lines without a two-character code and three blanks are banner lines.
    """
    lines = F.filter(F.split(F.col(column), r"\r?\n"), lambda x: x.rlike("^[A-Z]{2}   "))
    rows = texts.select(lines.alias("lines")).filter(F.exists("lines", lambda x: x.startswith("AC")))

    def data(code: str, sep: str = " ") -> Column:
        own = F.filter("lines", lambda x: x.startswith(code))
        joined = F.array_join(F.transform(own, lambda x: F.trim(F.substring(x, 6, 1 << 20))), sep)
        return F.when(F.size(own) > 0, joined)

    return rows.select(F.split(data("ID"), r"\s+")[0].alias("entry_name"), *(data(c).alias(c.lower()) for c in ("AC", "DE", "GN", "OS", "OX")), data("DR", "\n").alias("dr"), data("CC").alias("cc"), data("FT").alias("ft"))


def uniprot_accessions(entries: DataFrame) -> DataFrame:
    """SCA21: (entry_name, ac, place): accessions in order, the primary one at 0."""
    return entries.select("entry_name", F.posexplode(F.filter(F.transform(F.split("ac", ";"), lambda v: F.trim(v)), lambda x: x != "")).alias("place", "ac"))


def uniprot_names(entries: DataFrame) -> DataFrame:
    """SCA22: (entry_name, name, is_standard): names of the DE lines without evidence; the recommended one is the standard name."""
    parts = entries.select("entry_name", F.explode(F.split("de", ";")).alias("p")).filter(F.col("p").contains("="))
    name = F.trim(F.regexp_replace(F.regexp_replace("p", r"\{[^}]*\}", ""), r"^[^=]*=", ""))
    return parts.select("entry_name", name.alias("name"), F.col("p").contains("RecName: Full").alias("is_standard"))


# The databases of DR lines that ids are kept of, with the names they are stored under.
DR_DATABASES = {"GENEID": "NCBI Gene", "REFSEQ": "refseq", "ENSEMBL": "ENSEMBL", "HGNC": "HGNC", "PDB": "PDB", "IPI": "IPI", "EMBL": "Nucleotide Sequence Database", "PIR": "PIR", "PHARMGKB": "PHARMGKB", "DIP": "DIP"}
# What an id of these databases must look like; the first that doesn't ends its line.
DR_PATTERNS = {"PDB": "^[0-9][A-Za-z0-9]{3}$", "ENSEMBL": "^ENS", "PHARMGKB": "^PA", "DIP": "^DIP-", "EMBL": r"^(\w+\d+(\.\d+)?|NP_\d+)$"}


def uniprot_xrefs(entries: DataFrame) -> DataFrame:
    """SCA24: (entry_name, db, id) of the DR lines of kept databases, up to the first ``-`` or id that isn't one."""
    lines = entries.select("entry_name", F.explode(F.split("dr", "\n")).alias("l")).filter(F.trim("l") != "")
    cut = F.transform(F.split(F.regexp_replace("l", r"\.[^.]*$", ""), ";"), lambda v: F.trim(v))
    x = lines.select("entry_name", F.upper(cut[0]).alias("db"), F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0))).alias("ids")).filter(F.col("db").isin(*DR_DATABASES))
    ok: Column = F.lit(".*")
    for db, p in DR_PATTERNS.items():
        ok = F.when(F.col("db") == db, F.lit(p)).otherwise(ok)
    x = x.withColumn("ok", ok)
    good = F.transform("ids", lambda i: (i != "-") & (i != "") & F.rlike(i, F.col("ok")))
    first_bad = F.array_position(good, False)
    kept = F.when(first_bad > 0, F.slice("ids", F.lit(1), (first_bad - 1).cast("int"))).otherwise(F.col("ids"))
    each = x.select("entry_name", "db", F.explode(kept).alias("id"))
    name: Column = F.col("db")
    for db, n in DR_DATABASES.items():
        name = F.when(F.col("db") == db, F.lit(n)).otherwise(name)
    name = F.when((F.col("db") == "HGNC") & ~F.col("id").startswith("HGNC:"), "hgnc.symbol").otherwise(name)
    return each.select("entry_name", name.alias("db"), F.when(F.col("db") == "REFSEQ", F.regexp_replace("id", r"\.\d+", "")).otherwise(F.col("id")).alias("id")).distinct()


def uniprot_genes(entries: DataFrame) -> DataFrame:
    """SCA25: (entry_name, symbol, is_synonym) of GN lines."""
    gn = F.regexp_replace("gn", r"\{[^}]*\}", "")
    one = lambda label: F.flatten(F.transform(F.regexp_extract_all(gn, F.lit(rf"{label}=([^;]+)"), F.lit(1)), lambda v: F.split(v, ",")))
    row = lambda label, syn: entries.select("entry_name", F.explode(F.transform(one(label), lambda v: F.trim(v))).alias("symbol"), F.lit(syn).alias("is_synonym")).filter("symbol <> ''")
    return row("Name", False).unionByName(row("Synonyms", True))


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: (id, name, def, alt_ids, synonyms, properties, xrefs, parents, relationships) of the terms of an OBO file."""
    return obo_terms(spark.read.option("lineSep", "\n\n").text(path))


def obo_terms(texts: DataFrame, column: str = "value") -> DataFrame:
    """SRC7, SRC8, SCA29: terms of stanza texts. A stanza must have exactly one id; others, and other kinds of stanza, are left out."""
    stanza = texts.select(F.transform(F.split(F.col(column), r"\r?\n"), lambda v: F.trim(v)).alias("l")).filter(F.array_contains("l", "[Term]"))

    def values(tag: str) -> Column:
        own = F.filter("l", lambda x: x.startswith(f"{tag}: "))
        return F.transform(own, lambda x: F.trim(F.substring(x, len(tag) + 2, 1 << 20)))

    t = stanza.select(*(values(k).alias(k) for k in ("id", "name", "def", "alt_id", "synonym", "property_value", "xref", "is_a", "relationship"))).filter(F.size("id") == 1)
    bare = lambda c: F.transform(c, lambda x: F.regexp_extract(x, r"^(\S+)", 1))
    link = lambda c: F.transform(c, lambda x: F.struct(F.regexp_extract(x, r"^(\S+)\s+(\S+)", 1).alias("type"), F.regexp_extract(x, r"^(\S+)\s+(\S+)", 2).alias("id")))
    quoted = F.regexp_extract(F.get("def", F.lit(0)), r'"((?:[^"\\]|\\.)*)"', 1)
    return t.select(
        F.col("id")[0].alias("id"), F.get("name", F.lit(0)).alias("name"), quoted.alias("definition"), F.col("alt_id").alias("alt_ids"), F.col("synonym").alias("synonyms"),
        F.col("property_value").alias("properties"), F.col("xref").alias("xrefs"), bare("is_a").alias("parents"), link("relationship").alias("relationships"),
    )


# The databases whose references of chemical terms are kept.
CHEMICAL_DATABASES = ("CAS", "DRUGBANK", "HMDB", "KEGG")


def chemicals(terms: DataFrame) -> DataFrame:
    """SCA28: (id, name, standard_name, names, formula, mass, inchi, inchikey, xrefs) of chemical terms.

    Facts may be given as synonyms or as properties. KEGG ids starting with C or D are compounds or drugs.
    """
    facts = F.concat("synonyms", "properties")
    text = lambda x: F.regexp_extract(x, r'"((?:[^"\\]|\\.)*)"', 1)
    pick = lambda *keys: F.filter(facts, lambda x: _any_in(x, keys))
    plain = F.filter("synonyms", lambda x: ~_any_in(x, ("IUPAC_NAME", "InChIKey", "InChI=", "FORMULA", "MASS")))
    names = F.array_distinct(F.transform(F.concat(plain, pick("FORMULA", "chebi/formula"), pick("chebi/smiles")), text))
    xr = F.filter(F.transform("xrefs", lambda x: F.regexp_extract_all(x, F.lit(r"^([^:\s]+):(\S+)"), F.lit(0))[0]), lambda x: x.isNotNull())
    kept = F.filter(xr, lambda x: F.upper(F.substring_index(x, ":", 1)).isin(*CHEMICAL_DATABASES))
    db = lambda x: F.when((F.upper(F.substring_index(x, ":", 1)) == "KEGG") & F.substring_index(x, ":", -1).startswith("C"), "KEGG Compound").when((F.upper(F.substring_index(x, ":", 1)) == "KEGG") & F.substring_index(x, ":", -1).startswith("D"), "KEGG Drug").otherwise(F.substring_index(x, ":", 1))
    first = lambda a: F.get(F.transform(a, text), F.lit(0))
    return terms.select(
        "id", "name", first(pick("IUPAC_NAME")).alias("standard_name"), names.alias("names"), first(pick("FORMULA", "chebi/formula")).alias("formula"),
        F.try_to_number(first(pick("MASS", "chebi/mass")), F.lit("999999999.999999999")).cast("float").alias("mass"), first(pick("InChI=")).alias("inchi"),
        F.regexp_replace(first(pick("InChIKey", "chebi/inchikey")), "^InChIKey=", "").alias("inchikey"), F.transform(kept, lambda x: F.struct(db(x).alias("db"), F.regexp_replace(x, "^[^:]*:", "").alias("id"))).alias("xrefs"), "alt_ids", "parents", "relationships",
    )


def _any_in(x: Column, keys: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | x.contains(k)
    return out


def read_mitab(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: (line_key, a_ids, b_ids, methods, publications, taxon_a, taxon_b, types, sources, ids, scores): PSI-MITAB's first 15 columns."""
    names = ("a", "b", "alt_a", "alt_b", "alias_a", "alias_b", "method", "author", "pub", "tax_a", "tax_b", "type", "source", "id", "score")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    t = spark.read.schema(schema).option("sep", "\t").option("quote", "").option("comment", "#").csv(path)
    many = lambda c: F.filter(F.split(F.col(c), r"\|"), lambda x: (x != "-") & (x != ""))
    taxon = lambda c: F.regexp_extract(F.col(c), r"taxid:(-?\d+)", 1).cast("int")
    return t.select(F.md5(F.concat_ws("\t", *names)).alias("line_key"), many("a").alias("a_ids"), many("b").alias("b_ids"), many("method").alias("methods"), many("pub").alias("publications"), taxon("tax_a").alias("taxon_a"), taxon("tax_b").alias("taxon_b"), many("type").alias("types"), many("source").alias("sources"), many("id").alias("ids"), many("score").alias("scores"))


def read_simple_mapping(spark: SparkSession, path: str, patterns: dict[str, str], swap: bool = False) -> DataFrame:
    """SRC12, SRC17: mapping rows of a two-column TSV whose header names the id types; invalid ids are dropped; swap exchanges columns.

    patterns: the registry's id pattern by database, in lower case; databases without one take any filled id.
    """
    t = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    src, dst = t.columns[:2][:: -1 if swap else 1]
    rows = t.select(filled(F.col(f"`{src}`")).alias("src_id"), filled(F.col(f"`{dst}`")).alias("dst_id")).dropna()
    for c, db in (("src_id", src), ("dst_id", dst)):
        if p := patterns.get(db.strip().lower()):
            rows = rows.filter(valid_id(c, F.lit(p)))
    return rows.select(F.lit(src.strip().upper()).alias("src_db"), "src_id", F.lit(dst.strip().upper()).alias("dst_db"), "dst_id").distinct()


METADATA = "description string, version string, datasources array<struct<identifier:string,name:array<string>,description:string,dataUrl:string,homepageUrl:string,iconUrl:string,type:string,cleanerClass:string,converterClass:string,pubmedId:string,availability:string,numPathways:int,numInteractions:int,numPhysicalEntities:int>>"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """SRC13: one row a source of a metadata file, declared types, nothing inferred."""
    return spark.read.schema(METADATA).option("multiLine", True).json(path).select(F.inline("datasources"))


def read_blacklist(spark: SparkSession, path: str) -> DataFrame | None:
    """SRC14: (uri, degree); None with a warning where there is no file, ValueError where it is empty."""
    try:
        b = spark.read.schema("uri string, degree int").option("sep", "\t").csv(path)
        empty = b.isEmpty()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        warnings.warn(f"no blacklist at {path}", stacklevel=2)
        return None
    if empty:
        raise ValueError(f"the blacklist at {path} is empty")
    return b
