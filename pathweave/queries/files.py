"""Queries of sources, sinks and plug-ins: tables written in a source's format and read by its parser, flat outputs as lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathweave import binding as B
from pathweave.operators import entities as E
from pathweave.runtime import strip, table
from pathweave.service import analyze
from pathweave.sinks import flat
from pathweave.sources import flatfiles as R

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("select entry_name, regexp_extract(ox, 'NCBI_TaxID=([0-9]+)', 1) as taxon, trim(de) as de from uniprot_entries where ac is not null and trim(ac) <> '' and ox is not null and de is not null")
def parse_uniprot(s, d):
    """SRC6: entries written as flat-file records and parsed back."""
    u = table(s, d, "uniprot_entries").filter("trim(ac) <> '' and ox is not null and de is not null")
    text = F.concat(F.lit("ID   "), "entry_name", F.lit("   Reviewed;\nAC   "), F.regexp_replace(F.trim("ac"), r"\s*\n\s*", "\nAC   "), F.lit("\nDE   "), "de", F.lit("\nOX   "), "ox", F.lit("\n----\n"))
    p = R.uniprot_records(u.select(text.alias("value")))
    return p.select("entry_name", F.regexp_extract("ox", "NCBI_TaxID=([0-9]+)", 1).alias("taxon"), "de")


@query("select doc_no as id, display_name as name, trim(pathway, E' \\n\\t\\r') as parent from (select doc_no, display_name, pathway from pathway_index where display_name is not null and trim(pathway, E' \\n\\t\\r') <> '')")
def parse_obo(s, d):
    """SRC7, SRC8: records written as stanzas and parsed back with their parents."""
    p = table(s, d, "pathway_index").filter("display_name is not null").select("doc_no", "display_name", strip("pathway").alias("parent")).filter("parent <> ''")
    text = F.concat(F.lit("[Term]\nid: "), F.col("doc_no").cast("string"), F.lit("\nname: "), "display_name", F.lit("\nis_a: "), "parent", F.lit(" ! up\n"))
    t = R.obo_terms(p.select(text.alias("value")))
    return t.select(F.col("id").cast("bigint").alias("id"), F.col("name"), F.col("parents")[0].alias("parent"))


@query("select submission_id, substr(coalesce(src_db, ''), 1, 128) as query from mapping_submissions")
def audit_lines(s, d):
    """SNK18, SCA30: audit lines as JSON, read back."""
    m = table(s, d, "mapping_submissions")
    none = F.lit(None).cast("string")
    lines = flat.audit_lines(m.select(F.col("submission_id").cast("string").alias("command"), F.coalesce("src_db", F.lit("")).alias("query"), none.alias("providers"), none.alias("error")))
    return lines.select(F.get_json_object("value", "$.command").cast("bigint").alias("submission_id"), F.get_json_object("value", "$.query").alias("query"))


@query("select identifier || chr(9) || coalesce(description, '') || chr(9) || source_kind || chr(9) || array_to_string(display_names, ';') || chr(9) || coalesce(num_pathways, 0) || chr(9) || coalesce(num_interactions, 0) as value from datasources")
def datasources_txt(s, d):
    """SNK10."""
    t = table(s, d, "datasources").select("identifier", "description", F.col("source_kind").alias("kind"), F.col("display_names").alias("names"), "num_pathways", "num_interactions")
    return flat.datasource_lines(t)


@query("select distinct trim(dst_id) as value from mappings where upper(trim(dst_db)) = 'HGNC' and trim(dst_id) <> '' and trim(src_id) <> '' and trim(src_db) <> ''")
def accession_list(s, d):
    """SNK11: distinct primary ids."""
    m = E.normalized_mapping(table(s, d, "mappings")).filter("dst_db = 'HGNC'").withColumn("dst_db", F.lit("UNIPROT"))
    return flat.accession_list(m)


@query("with x as (select distinct 'order:' || l_orderkey as uri, n_name as organism, p_name as symbol from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join part on p_partkey = l_partkey where n_name in ('NATION_1', 'NATION_7')) select uri || chr(9) || 'name: ' || uri || '; datasource: orders; organism: ' || organism || '; idtype: name' || chr(9) || string_agg(symbol, chr(9) order by symbol) as value from x group by uri, organism")
def gmt(s, d):
    """SNK5, FIL18: gene-set lines, members and pathway of one species."""
    li = table(s, d, "lineitem").join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(table(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    u = B.uri("order", "l_orderkey")
    m = li.select(u.alias("uri"), u.alias("name"), F.lit("orders").alias("datasource"), F.col("n_name").alias("organism"), F.col("n_name").alias("member_organism"), F.lit("name").alias("id_type"), F.col("p_name").alias("symbol"))
    return flat.gmt_lines(m, ["NATION_1", "NATION_7"])


@query(f"with {B.GRAPH_SQL} select e.uri, 'bp:' || e.type as type, (select string_agg(distinct value, ';' order by value) from literal l where l.uri = e.uri and prop = 'name') as name from element e where e.type in ('Nation', 'Region', 'Supplier')")
def jsonld(s, d):
    """SNK7: elements as JSON objects, read back."""
    m = B.model(s, d)
    keep = m.elements.filter("type in ('Nation', 'Region', 'Supplier')")
    sub = type(m)(keep, m.edges, m.literals, m.parents)
    v = flat.jsonld_lines(sub)
    return v.select(F.get_json_object("value", "$['@id']").alias("uri"), F.get_json_object("value", "$['@type']").alias("type"), F.get_json_object("value", "$.name[0]").alias("name"))


@query(f"with {B.ELEMENT_SQL} select type, count(*) as n from element group by type")
def plugin_apply(s, d):
    """UDF1-UDF3: a registered analysis run by name."""
    return analyze("counts_by_class", B.model(s, d))


@query(f"with {B.ELEMENT_SQL} select md5(uri) as key, uri from element where type in ('Part', 'Customer')")
def index_upsert(s, d):
    """SNK15: two versions of each document, of which the later stays."""
    e = B.elements(s, d).filter("type in ('Part', 'Customer')")
    rows = e.select(F.md5("uri").alias("key"), F.lit("old").alias("uri"), F.lit(1).alias("version")).unionByName(e.select(F.md5("uri").alias("key"), "uri", F.lit(2).alias("version")))
    return E.latest(rows, "key", "version").select("key", "uri")
