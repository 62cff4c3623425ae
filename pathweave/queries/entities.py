"""Queries of the filters, joins, aggregations, set operations and scalar functions, on the star-schema and problem tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathweave import binding as B
from pathweave.functions import ids, text
from pathweave.model import subtypes
from pathweave.operators import entities as E
from pathweave.operators import search as S
from pathweave.runtime import Scratch, filled, strip, table
from pathweave.sources import flatfiles as R

QUERIES, SQL = {}, {}
T = table


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"with {B.ELEMENT_SQL}, {B.CLOSURE_SQL} select e.type, count(*) as n from element e join type_closure c on c.sub = e.type where c.super = 'Entity' group by e.type")
def type_scan_subtypes(s, d):
    """FIL1, FIL3: elements per class under Entity."""
    return B.elements(s, d).filter(F.col("type").isin(subtypes("Entity", B.PARENTS))).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {B.ELEMENT_SQL} select uri, type from element where uri in ('part:1','part:2','part:3','customer:5','supplier:7','nation:3','region:1','order:1','order:2','nowhere:1')")
def uri_lookup_semi(s, d):
    """FIL2: point lookups, unknown uris dropped."""
    keys = [f"part:{k}" for k in (1, 2, 3)] + ["customer:5", "supplier:7", "nation:3", "region:1", "order:1", "order:2", "nowhere:1"]
    return E.lookup_uris(B.elements(s, d), s.createDataFrame([(k,) for k in keys], "uri string")).select("uri", "type")


@query("select uri, biopax_type, coalesce(nullif(trim(display_name, ' '), ''), uri) as name from (select trim(uri, E' \\n\\t\\r') as uri, biopax_type, display_name, doc_no from pathway_index) where uri <> ''")
def coalesce_name(s, d):
    """FIL23: a hit's name, or else its uri."""
    p = T(s, d, "pathway_index").select(strip("uri").alias("uri"), "biopax_type", F.trim("display_name").alias("n")).filter("uri <> ''")
    return p.select("uri", "biopax_type", F.coalesce(F.when(F.col("n") != "", F.col("n")), "uri").alias("name"))


@query(f"with {B.LITERAL_SQL} select prop, count(*) as n, count(distinct value) as n_values from literal where prop in ('author','chemicalFormula','comment','controlType','eCNumber','id','name','term','title') and not starts_with(value, 'REPLACED') and not contains(value, 'ADDED') group by prop")
def keyword_allowlist(s, d):
    """FIL10, FIL11: keyword literals by property."""
    return E.keyword_literals(B.literals(s, d)).groupBy("prop").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))


@query("select row_id, lower(trim(src_db)) as db, trim(src_id) as id from mappings where trim(src_db) <> '' and trim(src_id) <> ''")
def blank_ref_cleanup(s, d):
    """FIL12: references with a blank database or id dropped, the database lower-cased."""
    x = T(s, d, "mappings").select("row_id", F.lit("UnificationXref").alias("type"), F.trim("src_db").alias("db"), F.trim("src_id").alias("id"))
    return E.clean_xrefs(x).select("row_id", "db", "id")


@query("select 'order:' || l_orderkey || '/' || l_linenumber as interaction from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey where n_name in ('NATION_1','NATION_7','NATION_12') group by 1")
def species_interaction_filter(s, d):
    """FIL13: interactions with a participant of a supported nation; parts abstain like small molecules."""
    li, su, na = T(s, d, "lineitem"), T(s, d, "supplier"), T(s, d, "nation")
    key = F.concat(F.lit("order:"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("interaction")
    agents = li.join(su, F.col("l_suppkey") == F.col("s_suppkey")).join(na, F.col("s_nationkey") == F.col("n_nationkey")).select(key, F.lit("Protein").alias("kind"), F.col("n_name").alias("organism"))
    parts = li.select(key, F.lit("SmallMolecule").alias("kind"), F.lit(None).cast("string").alias("organism"))
    return E.supported_interactions(agents.unionByName(parts), ["NATION_1", "NATION_7", "NATION_12"])


@query("select 'customer:' || c_custkey as uri from customer join nation on n_nationkey = c_nationkey where n_name not in ('NATION_1','NATION_7') and not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def unsupported_dangling(s, d):
    """FIL14: customers that no urgent order refers to, those of supported nations apart."""
    c = T(s, d, "customer").join(T(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    e = c.select(B.uri("customer", "c_custkey").alias("uri"), F.lit("Customer").alias("type"), "n_name")
    refs = T(s, d, "orders").filter("o_orderpriority = '1-URGENT'").select(B.uri("customer", "o_custkey").alias("dst"))
    return E.unreferenced(e, refs, ["Customer"], F.col("n_name").isin("NATION_1", "NATION_7"))


@query("select 'order:' || o_orderkey as uri from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def dangling_anti(s, d):
    """JOI15: orders without line items."""
    return T(s, d, "orders").select("o_orderkey").join(T(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select(B.uri("order", "o_orderkey").alias("uri"))


@query("select 'order:' || l_orderkey as uri, count(*) as processes from lineitem group by l_orderkey having count(*) > 2")
def top_containers(s, d):
    """FIL16, GRA12: containers without a parent that have more than two processes."""
    e = B.edges(s, d)
    orders = B.elements(s, d).filter("type = 'Pathway'").select("uri")
    inner = e.filter("prop = 'component'")
    top = orders.join(inner.select(F.col("dst").alias("uri")), "uri", "left_anti")
    n = inner.groupBy(F.col("src").alias("uri")).agg(F.count(F.lit(1)).alias("processes"))
    return top.join(n, "uri").filter("processes > 2")


@query("select src_db as db, count(*) as n from mapping_lines l where exists (select 1 from db_registry r where r.db_name = l.src_db and r.db_id in (1, 2, 6, 7, 8)) group by 1")
def source_type_allowlist(s, d):
    """FIL26, FIL28: rows of databases on an allow-list, names compared as registered."""
    allowed = T(s, d, "db_registry").filter(F.col("db_id").isin(1, 2, 6, 7, 8)).select(F.col("db_name").alias("src_db"))
    return T(s, d, "mapping_lines").join(F.broadcast(allowed), "src_db", "left_semi").groupBy(F.col("src_db").alias("db")).agg(F.count(F.lit(1)).alias("n"))


@query("select identifier, (source_kind in ('WAREHOUSE','MAPPING')) as not_pathway_data from datasources")
def datasource_split(s, d):
    """FIL21: pathway data or not."""
    return T(s, d, "datasources").select("identifier", F.col("source_kind").isin("WAREHOUSE", "MAPPING").alias("not_pathway_data"))


@query("select submission_id, (lower(coalesce(src_db, '')) like 'panther%' or lower(coalesce(src_db, '')) like 'uni%') as hit from mapping_submissions")
def db_prefix_predicate(s, d):
    """FIL27, SCA13."""
    return T(s, d, "mapping_submissions").select("submission_id", ids.starts_with_any("src_db", "PANTHER", "Uni").alias("hit"))


FIX_SQL = """case when db like 'UNIPROT%' then regexp_replace(id, '-[0-9]+$', '')
 when db = 'CHEBI' then case when upper(id) like 'CHEBI:%' then upper(id) else 'CHEBI:' || upper(id) end
 when db = 'REFSEQ' then regexp_replace(id, '\\.[0-9]+$', '')
 when db like 'KEGG%' and regexp_matches(id, ':[0-9]+$') then regexp_extract(id, '[^:]*$')
 when db like '%PUBCHEM%' and (db like '%SUBSTANCE%' or db like '%SID%') then case when regexp_matches(id, '^[0-9]+$') then 'SID:' || id else upper(id) end
 when db like '%PUBCHEM%' and (db like '%COMPOUND%' or db like '%CID%') then case when regexp_matches(id, '^[0-9]+$') then 'CID:' || id else upper(id) end
 else id end"""
MAPPING_SQL = f"""raw as (select upper(trim(src_db)) as sdb, trim(src_id) as sid, upper(trim(dst_db)) as ddb, trim(dst_id) as did from mappings
 where trim(src_db) <> '' and trim(src_id) <> '' and trim(dst_db) <> '' and trim(dst_id) <> ''),
mapping as (select distinct sdb as src_db, {FIX_SQL.replace("db", "sdb").replace("id", "sid").replace("ssid", "sid").replace("ssdb", "sdb")} as src_id,
 ddb as dst_db, {FIX_SQL.replace("db", "ddb").replace("id", "did").replace("ddid", "did").replace("dddb", "ddb")} as dst_id from raw)"""


@query(f"with {MAPPING_SQL} select src_db, src_id, dst_db, dst_id, md5(src_db || '|' || src_id || '|' || dst_db || '|' || dst_id) as doc_id from mapping")
def mapping_table(s, d):
    """DM7, AGG14, JOI23: mapping rows as stored, one a key."""
    return E.normalized_mapping(T(s, d, "mappings")).select("src_db", "src_id", "dst_db", "dst_id", "doc_id")


@query(f"with {MAPPING_SQL} select src_id as id, string_agg(distinct dst_id, ';' order by dst_id) as mapped from mapping where dst_db = 'UNIPROT' and src_db in ('HGNC', 'REFSEQ') group by src_id")
def map_forward(s, d):
    """JOI8, JOI9: ids mapped to UniProt, distinct and sorted."""
    m = E.normalized_mapping(T(s, d, "mappings"))
    asked = m.filter(F.col("src_db").isin("HGNC", "REFSEQ")).select(F.col("src_id").alias("id"))
    known = m.filter(F.col("src_db").isin("HGNC", "REFSEQ"))
    return E.map_ids(asked, known, "UNIPROT").select("id", F.concat_ws(";", "mapped").alias("mapped"))


@query(f"with {MAPPING_SQL} select dst_db, dst_id, count(*) as n, string_agg(distinct src_db, ';' order by src_db) as src_dbs from mapping where dst_db = 'CHEBI' group by dst_db, dst_id")
def map_reverse(s, d):
    """JOI7, JOI13: what maps to each id of a database."""
    return E.mapped_from(E.normalized_mapping(T(s, d, "mappings")), "ChEBI")


@query(f"with {MAPPING_SQL}, t as (select src_db, src_id, list_sort(list(distinct dst_id)) as l from mapping where dst_db = 'UNIPROT' group by 1, 2) select src_db, src_id, len(l) as n_found, array_to_string(l[1:5], ';') as first_five, case when len(l) <= 5 then array_to_string(l, ';') else '' end as all_or_nothing from t")
def capped_symbols(s, d):
    """JOI11, AGG13: at most five ids, the first or none."""
    m = E.normalized_mapping(T(s, d, "mappings")).filter("dst_db = 'UNIPROT'")
    t = m.groupBy("src_db", "src_id").agg(F.collect_set("dst_id").alias("l"))
    return t.select("src_db", "src_id", F.size("l").cast("bigint").alias("n_found"), F.concat_ws(";", E.capped(F.col("l"), False)).alias("first_five"), F.concat_ws(";", E.capped(F.col("l"), True)).alias("all_or_nothing"))


@query("select distinct 'part:' || l_partkey as uri, p_name as \"primary\", 'uri' as how from lineitem join part on p_partkey = l_partkey")
def canonical_by_uri(s, d):
    """JOI1: references found in the warehouse under their own uri."""
    refs = T(s, d, "lineitem").select(B.uri("part", "l_partkey").alias("uri")).distinct()
    wh = T(s, d, "part").select(B.uri("part", "p_partkey").alias("uri"), F.col("p_name").alias("primary"))
    none = s.createDataFrame([], "src_id string, dst_id string"), s.createDataFrame([], "uri string, type string, id string")
    return E.canonical(refs, wh, *none)


@query(f"""with {MAPPING_SQL}, refs as (select distinct 'http://bioregistry.io/uniprot:' || src_id as uri, regexp_replace(regexp_extract(src_id, '[^/]*$'), '^[^:]*:', '') as id from mapping where src_db in ('HGNC', 'REFSEQ')),
wh as (select distinct dst_id as prim from mapping where dst_db = 'UNIPROT'), ways as (select distinct src_id, dst_id from mapping where dst_db = 'UNIPROT' union select prim, prim from wh)
select uri, min(dst_id) as "primary", 'id' as how from refs join ways on ways.src_id = refs.id group by uri having count(distinct dst_id) = 1""")
def canonical_by_id(s, d):
    """JOI2, JOI10: references without usable references of their own, by the id in their uri."""
    m, _ = Scratch(s, "mapping").write(E.normalized_mapping(T(s, d, "mappings")))
    to = m.filter("dst_db = 'UNIPROT'")
    refs = m.filter("src_db in ('HGNC', 'REFSEQ')").select(F.concat(F.lit("http://bioregistry.io/uniprot:"), "src_id").alias("uri")).distinct()
    wh = to.select(F.concat(F.lit("warehouse:"), F.col("dst_id")).alias("uri"), F.col("dst_id").alias("primary")).distinct()
    return E.canonical(refs, wh, to, s.createDataFrame([], "uri string, type string, id string"))


@query("with n as (select lower(c_name) as n, min('customer:' || c_custkey) as t, count(*) as k from customer group by 1) select 'item:' || c_custkey as uri, t as target from customer join n on n.n = lower(c_name) where k = 1")
def by_exact_name(s, d):
    """JOI6: elements by exact name in any case."""
    c = T(s, d, "customer")
    left = c.select(F.concat(F.lit("item:"), F.col("c_custkey").cast("string")).alias("uri"), F.upper("c_name").alias("name"))
    return E.by_name(left, c.select(B.uri("customer", "c_custkey").alias("uri"), F.col("c_name").alias("name")))


@query(f"""with {MAPPING_SQL} select src_db, src_id, dst_db, dst_id, md5(src_db || '|' || src_id || '|' || dst_db || '|' || dst_id) as doc_id from mapping""")
def mapping_from_warehouse(s, d):
    """JOI23: mapping rows from warehouse references; relationship references count where they are an identity."""
    m = T(s, d, "mappings")
    first = F.coalesce(F.col("src_db"), F.lit("")) < "M"
    x = m.select(F.col("dst_db").alias("primary_db"), F.col("dst_id").alias("primary"), F.when(first, "UnificationXref").otherwise("RelationshipXref").alias("type"), F.when(first, None).otherwise("identity").alias("relation"), F.col("src_db").alias("db"), F.col("src_id").alias("id"))
    other = x.withColumn("type", F.lit("RelationshipXref")).withColumn("relation", F.lit("see-also")).withColumn("id", F.concat("id", F.lit("x")))
    return E.mapping_from_warehouse(x.unionByName(other)).select("src_db", "src_id", "dst_db", "dst_id", "doc_id")


@query(f"""with {MAPPING_SQL}, refs as (select distinct src_db || ':' || src_id as uri, src_id, src_db from mapping),
wh as (select distinct dst_id as prim from mapping where dst_db = 'UNIPROT'),
ways as (select distinct src_id, dst_id from mapping where dst_db = 'UNIPROT' union select prim, prim from wh),
hit as (select r.uri, w.dst_id as prim, case when r.src_db in ('HGNC','REFSEQ','UNIPROT') then 2 else 3 end as rk from refs r join ways w on w.src_id = r.src_id),
best as (select uri, min(rk) as rk from hit group by uri)
select h.uri, min(prim) as "primary", case when min(h.rk) = 2 then 'unification' else 'relationship' end as how from hit h join best b on b.uri = h.uri and b.rk = h.rk group by h.uri having count(distinct prim) = 1""")
def canonical_by_mapping(s, d):
    """JOI2-JOI5, JOI10, JOI24: the one warehouse id by unification references, else by relationship references."""
    m, _ = Scratch(s, "mapping").write(E.normalized_mapping(T(s, d, "mappings")))
    refs = m.select(F.concat_ws(":", "src_db", "src_id").alias("uri"), F.col("src_id").alias("id"), "src_db").distinct()
    to = m.filter("dst_db = 'UNIPROT'")
    wh = to.select(F.concat(F.lit("warehouse:"), F.col("dst_id")).alias("uri"), F.col("dst_id").alias("primary")).distinct()
    kind = F.when(F.col("src_db").isin("HGNC", "REFSEQ", "UNIPROT"), "UnificationXref").otherwise("RelationshipXref")
    return E.canonical(refs.select("uri").distinct(), wh, to, refs.select("uri", kind.alias("type"), "id"))


@query("with c as (select lower(display_name) as n, min(uri) as uri, count(distinct uri) as k from (select trim(uri, E' \\n\\t\\r') as uri, display_name from pathway_index) where uri <> '' and display_name is not null group by 1) select n as name, uri from c where k = 1")
def ambiguity_reject(s, d):
    """JOI5, JOI6: names that stand for one element only."""
    p = T(s, d, "pathway_index").select(strip("uri").alias("uri"), F.lower("display_name").alias("name")).filter("uri <> '' and name is not null")
    return E.unambiguous(p, "name", "uri")


@query(f"with {MAPPING_SQL}, e as (select src_db || ':' || src_id as uri, src_id, bool_or(dst_db = 'UNIPROT') as has from mapping where src_db = 'ENSEMBL' group by 1, 2), f as (select e.uri, list_sort(list(distinct m.dst_id)) as l from e join mapping m on m.src_id = e.src_id and m.dst_db = 'REFSEQ' group by e.uri) select uri, unnest(l[1:5]) as id from f")
def enrich_xrefs(s, d):
    """JOI12, HLP1: ids of a database added to entities that have none of it."""
    m = E.normalized_mapping(T(s, d, "mappings"))
    e = m.filter("src_db = 'ENSEMBL'").groupBy(F.concat_ws(":", "src_db", "src_id").alias("uri"), "src_id").agg(F.first(F.array(F.lit("ensembl"))).alias("dbs"))
    return E.enriched(e.select("uri", "dbs", F.array("src_id").alias("ids")), m, "REFSEQ")


@query("select 'part:' || p_partkey as uri, min('part:' || p_partkey) over (partition by p_type, p_size) as survivor from part")
def feature_equivalence(s, d):
    """JOI14, AGG12: features of equal type and size stand for the least uri."""
    return E.equivalents(T(s, d, "part").select(B.uri("part", "p_partkey").alias("uri"), "p_type", "p_size"), ["p_type", "p_size"])


@query("select p_brand, p_size, min('part:' || p_partkey) as survivor, count(*) as merged from part group by 1, 2")
def equiv_merge(s, d):
    """AGG12: one survivor for each equivalence key."""
    return T(s, d, "part").groupBy("p_brand", "p_size").agg(F.min(B.uri("part", "p_partkey")).alias("survivor"), F.count(F.lit(1)).alias("merged"))


@query("select cast(c_custkey as varchar) as uri, 'Customer' as type_a, 'Supplier' as type_b from customer join supplier on c_custkey = s_suppkey")
def type_conflicts(s, d):
    """JOI16: the same id under different classes."""
    a = T(s, d, "customer").select(F.col("c_custkey").cast("string").alias("uri"), F.lit("Customer").alias("type"))
    b = T(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("uri"), F.lit("Supplier").alias("type"))
    return E.type_conflicts(a, b)


@query("select 'customer:' || c_custkey as src, 'location' as prop, 'nation:' || min(n2.n_nationkey) as dst from customer join nation n on n.n_nationkey = c_nationkey join nation n2 on n2.n_regionkey = n.n_regionkey group by c_custkey")
def replace_refs(s, d):
    """JOI17: references to nations replaced by the first nation of their region."""
    n = T(s, d, "nation")
    first = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("k"))
    swap = n.join(first, "n_regionkey").select(B.uri("nation", "n_nationkey").alias("old"), B.uri("nation", "k").alias("new"))
    e = T(s, d, "customer").select(B.uri("customer", "c_custkey").alias("src"), F.lit("location").alias("prop"), B.uri("nation", "c_nationkey").alias("dst"))
    return E.replaced(e, swap)


@query(f"with {MAPPING_SQL} select md5(dst_id) as group_id, dst_id, string_agg(distinct src_db || ':' || src_id, ';' order by src_db || ':' || src_id) as uris from mapping where dst_db = 'HGNC' group by dst_id")
def seed_groups(s, d):
    """JOI18: each id asked for, with the elements it resolves to, one group an id."""
    m = E.normalized_mapping(T(s, d, "mappings")).filter("dst_db = 'HGNC'")
    g = m.groupBy("dst_id").agg(E.sorted_join(F.concat_ws(":", "src_db", "src_id")).alias("uris"))
    return g.select(F.md5("dst_id").alias("group_id"), "dst_id", "uris")


@query("select 'order:' || l_orderkey as src, min('part:' || l_partkey) as dst from lineitem group by l_orderkey having count(distinct l_partkey) = 1")
def single_member_collapse(s, d):
    """JOI21: containers of exactly one member."""
    e = T(s, d, "lineitem").select(B.uri("order", "l_orderkey").alias("src"), F.lit("member").alias("prop"), B.uri("part", "l_partkey").alias("dst"))
    return E.single_members(e, "member")


@query("select distinct 'order:' || l_orderkey as src, 'pathwayComponent' as prop, 'supplier:' || l_suppkey as dst from lineitem")
def control_to_container(s, d):
    """JOI22: controls belong to the containers of what they control."""
    li = T(s, d, "lineitem")
    c = li.select(B.uri("order", "l_orderkey").alias("src"), F.lit("pathwayComponent").alias("prop"), B.item_uri().alias("dst"))
    k = li.select(B.uri("supplier", "l_suppkey").alias("src"), F.lit("controlled").alias("prop"), B.item_uri().alias("dst"))
    return E.controls_to_containers(c.unionByName(k))


@query("select identifier, display_name from datasources, unnest(display_names) as t(display_name) where lower(identifier) in ('reactory', 'kinome')")
def datasource_lookup(s, d):
    """JOI20, JOI25: sources by identifier in any case, with their names."""
    return E.datasources_named(T(s, d, "datasources"), "REACTORY", "Kinome")


ITEMS_SQL = "count(distinct l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d'))::int"


@query(f"select 'order:' || l_orderkey as uri, count(distinct l_partkey)::int as num_participants, {ITEMS_SQL} as num_processes from lineitem group by 1 union all select distinct {B.ITEM_SQL}, 1, 0 from lineitem")
def process_counts(s, d):
    """AGG2: processes and participants of each pathway and interaction, over its child closure."""
    m = B.model(s, d)
    return S.member_counts(type(m)(m.elements, m.edges.filter("prop in ('component', 'participant')"), m.literals, (*m.parents, ("Complex", "PhysicalEntity"))))


@query("select datasource, count(*) filter (where biopax_type = 'Pathway') as pathways, count(*) filter (where biopax_type <> 'Pathway') as interactions, count(distinct organism) as organisms from (select distinct trim(uri, E' \\n\\t\\r') as uri, biopax_type, datasource, organism from pathway_index) where uri <> '' group by datasource")
def datasource_counts(s, d):
    """AGG3: elements by class and source."""
    p = T(s, d, "pathway_index").select(strip("uri").alias("uri"), "biopax_type", "datasource", "organism").filter("uri <> ''").distinct()
    return p.groupBy("datasource").agg(F.count_if(F.col("biopax_type") == "Pathway").alias("pathways"), F.count_if(F.col("biopax_type") != "Pathway").alias("interactions"), F.countDistinct("organism").alias("organisms"))


@query("select datasource, coalesce(string_agg(distinct organism, ';' order by organism), '') as organisms, coalesce(string_agg(distinct biopax_type, ';' order by biopax_type), '') as types from pathway_index group by datasource")
def facet_sets(s, d):
    """AGG4, AGG5: sorted sets of facets."""
    return T(s, d, "pathway_index").groupBy("datasource").agg(E.sorted_join("organism").alias("organisms"), E.sorted_join("biopax_type").alias("types"))


@query(f"with {B.EDGE_SQL}, deg as (select dst as uri, count(*) as degree from edge group by dst), big as (select avg(degree) * 3 as t from deg) select uri, degree from deg where degree >= 40")
def ubiquitous_hubs(s, d):
    """AGG9: nodes that 40 edges or more point to."""
    return E.ubiquitous(B.edges(s, d), 40)


@query("select n_name as term, count(*) as n_genes, string_agg(distinct p_name, ';' order by p_name) as genes from (select distinct n_name, p_partkey, p_name from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join part on p_partkey = l_partkey) group by n_name")
def gene_sets(s, d):
    """AGG10, SNK5: the set of each group, sorted."""
    li = T(s, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    su = T(s, d, "supplier").join(F.broadcast(T(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    j = li.join(su, F.col("l_suppkey") == F.col("s_suppkey")).select("n_name", "l_partkey").distinct()
    j = j.join(T(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("n_name").alias("term")).agg(F.count(F.lit(1)).alias("n_genes"), E.sorted_join("p_name").alias("genes"))


@query("select p_brand, arg_min(p_name, lpad(length(p_name)::varchar, 6, '0') || p_name) as name from part group by p_brand")
def shortest_name(s, d):
    """SRT5: the shortest name of each group, the first of equally long ones."""
    return T(s, d, "part").groupBy("p_brand").agg(E.shortest_name(F.col("p_name")).alias("name"))


@query("select identifier, source_kind, row_number() over (order by (source_kind in ('WAREHOUSE','MAPPING')), identifier) as place from datasources")
def datasource_order(s, d):
    """SRT7: pathway sources first, then the others."""
    from pyspark.sql import Window

    w = Window.orderBy(F.col("source_kind").isin("WAREHOUSE", "MAPPING"), "identifier")  # a fixed list of some dozen sources
    return T(s, d, "datasources").select("identifier", "source_kind", F.row_number().over(w).cast("bigint").alias("place"))


@query(f"with {B.ELEMENT_SQL} select uri, min(type) as type from (select uri, type from element where type in ('Part', 'Customer') union all select uri, type from element where type in ('Customer', 'Supplier')) group by uri")
def model_union(s, d):
    """SET1-SET3: two overlapping sources as one, elements of equal uri merged."""
    m = B.model(s, d)
    one = type(m)(m.elements.filter("type in ('Part', 'Customer')"), m.edges.filter("prop = 'location'"), m.literals, m.parents)
    two = type(m)(m.elements.filter("type in ('Customer', 'Supplier')"), m.edges.filter("prop = 'location'"), m.literals, m.parents)
    return one.union(two).elements.select("uri", "type")


@query("with prim as (select distinct regexp_extract(ac, '[A-Z][0-9][A-Z0-9]{3}[0-9]') as ac from uniprot_entries where ac is not null), known as (select distinct trim(src_id) as ac from mappings where upper(trim(src_db)) = 'UNIPROT') select ac from prim where ac <> '' and ac not in (select ac from known where ac is not null)")
def new_minus_existing(s, d):
    """SET5, AGG8: primary accessions that the mapping doesn't have."""
    prim = T(s, d, "uniprot_entries").select(F.regexp_extract("ac", "[A-Z][0-9][A-Z0-9]{3}[0-9]", 0).alias("ac")).filter("ac <> ''")
    known = T(s, d, "mappings").filter(F.upper(F.trim("src_db")) == "UNIPROT").select(F.trim("src_id").alias("ac"))
    return E.minus(prim, known, "ac")


@query("select uri, array_to_string(list_sort(list_filter(list_distinct([a, b]), lambda x: x <> uri)), ';') as others from (select trim(uri, E' \\n\\t\\r') as uri, coalesce(trim(pathway, E' \\n\\t\\r'), '') as a, coalesce(datasource, '') as b, doc_no from pathway_index where uri is not null) where uri <> ''")
def self_exclusion(s, d):
    """SET6: an element's sets without itself."""
    p = T(s, d, "pathway_index").select(strip("uri").alias("uri"), F.coalesce(strip("pathway"), F.lit("")).alias("a"), F.coalesce("datasource", F.lit("")).alias("b")).filter("uri <> ''")
    return p.select("uri", F.concat_ws(";", E.others("uri", "a", "b")).alias("others"))


@query(f"select row_id, {FIX_SQL} as fixed from (select row_id, upper(trim(src_db)) as db, trim(src_id) as id from mappings where trim(src_db) <> '' and trim(src_id) <> '')")
def fix_ids(s, d):
    """SCA1."""
    m = T(s, d, "mappings").select("row_id", F.upper(F.trim("src_db")).alias("db"), F.trim("src_id").alias("id")).filter("db <> '' and id <> ''")
    return m.select("row_id", ids.fix_id_for_mapping("db", "id").alias("fixed"))


@query("""select row_id, case when contains(lower(u), 'bioregistry.io/') then
 (case when contains(lower(u), 'substance') then 'SID:' when contains(lower(u), 'compound') or contains(lower(u), 'pubchem') then 'CID:' when contains(lower(u), 'chebi') then 'CHEBI:' else '' end) || regexp_replace(regexp_extract(u, '[^/]*$'), '^[^:]*:', '') end as id
 from (select row_id, case when row_id % 5 = 0 then 'a.foo/' || trim(src_id) else 'http://bioregistry.io/' || lower(trim(src_db)) || ':' || trim(src_id) end as u from mappings where trim(src_db) <> '' and trim(src_id) <> '')""")
def ids_from_uris(s, d):
    """SCA2."""
    m = T(s, d, "mappings").filter("trim(src_db) <> '' and trim(src_id) <> ''")
    u = F.when(F.col("row_id") % 5 == 0, F.concat(F.lit("a.foo/"), F.trim("src_id"))).otherwise(F.concat(F.lit("http://bioregistry.io/"), F.lower(F.trim("src_db")), F.lit(":"), F.trim("src_id")))
    return m.select("row_id", ids.id_from_uri(u).alias("id"))


@query("""select uri, case when not regexp_matches(u, '[:/#]') then 'pw:' || u when contains(u, '#') then 'pw:' || regexp_extract(u, '[^#]*$') when contains(u, '/') then 'pw:' || regexp_extract(u, '[^/]*$') else u end as rebased,
 regexp_replace(regexp_replace(u, '/$', ''), '^.*[/#:]', '') as local from (select trim(uri, E' \\n\\t\\r') as uri, replace(trim(uri, E' \\n\\t\\r'), ':', '/') as u from pathway_index) where uri <> ''""")
def rebase_uris(s, d):
    """SCA3-SCA6: URIs under another base, and their local parts."""
    p = T(s, d, "pathway_index").select(strip("uri").alias("uri")).filter("uri <> ''")
    u = F.replace("uri", F.lit(":"), F.lit("/"))
    return p.select("uri", ids.rebase_uri(u, "pw:").alias("rebased"), ids.local_part(u, colons=True).alias("local"))


@query("select row_id, case when contains(id, ':') then lower(split_part(id, ':', 1)) || substr(id, strpos(id, ':')) else id end as lowered, case when starts_with(id, 'CHEBI:') then id else 'CHEBI:' || id end as prefixed, regexp_replace(id, '[^-a-zA-Z0-9_]', '_', 'g') as encoded from (select row_id, trim(dst_id) as id from mappings where trim(dst_id) <> '')")
def id_forms(s, d):
    """SCA7, SCA8, SCA12."""
    m = T(s, d, "mappings").select("row_id", F.trim("dst_id").alias("id")).filter("id <> ''")
    return m.select("row_id", ids.lower_prefix("id").alias("lowered"), ids.with_prefix("id").alias("prefixed"), ids.encode_id("id").alias("encoded"))


@query("select l.line_id, regexp_full_match(split_part(l.raw_line, E'\\t', 1), r.id_pattern) as valid from mapping_lines l join db_registry r on r.db_name = l.src_db where l.raw_line is not null")
def id_validation(s, d):
    """SCA10, SRC12: ids against their registry pattern."""
    r = F.broadcast(T(s, d, "db_registry").select(F.col("db_name").alias("src_db"), "id_pattern"))
    x = T(s, d, "mapping_lines").filter("raw_line is not null").join(r, "src_db")
    return x.select("line_id", ids.valid_id(F.split("raw_line", "\t")[0], "id_pattern").alias("valid"))


@query("select doc_id, regexp_replace(regexp_replace('<i>' || coalesce(source, '') || '</i> &amp;beta;-x &alpha;', '</?(i|sub|sup)>', '', 'gi'), '&(amp;)?(alpha|beta|gamma|delta|epsilon);', '\\2', 'gi') as name from documents")
def strip_name_markup(s, d):
    """SCA11."""
    name = F.concat(F.lit("<i>"), F.coalesce("source", F.lit("")), F.lit("</i> &amp;beta;-x &alpha;"))
    return T(s, d, "documents").select("doc_id", text.strip_name_markup(name).alias("name"))


@query("select identifier, upper(substr(n, 1, 1)) || substr(n, 2) as standard_name from (select identifier, case when len(display_names) > 1 then display_names[2] else display_names[1] end as n from datasources)")
def standard_names(s, d):
    """SCA18."""
    return T(s, d, "datasources").select("identifier", text.capitalized("display_names").alias("standard_name"))


@query("select entry_key, regexp_extract(os, '^([^(.]*)', 1) as organism, cast(regexp_extract(ox, 'NCBI_TaxID=([0-9]+)', 1) as integer) as taxon from uniprot_entries where ox is not null")
def organism_fields(s, d):
    """SCA23, SCA34: an entry's organism and taxon."""
    u = T(s, d, "uniprot_entries").filter("ox is not null")
    return u.select("entry_key", F.regexp_extract("os", "^([^(.]*)", 1).alias("organism"), F.regexp_extract("ox", "NCBI_TaxID=([0-9]+)", 1).cast("int").alias("taxon"))


@query("select entry_key::varchar as entry_name, trim(regexp_replace(regexp_extract(de, 'RecName: Full=([^;]*)', 1), '\\{[^}]*\\}', '', 'g')) as name from uniprot_entries where contains(de, 'RecName: Full=')")
def protein_names(s, d):
    """SCA22: the recommended name without evidence, by the flat-file parser."""
    u = T(s, d, "uniprot_entries").select(F.col("entry_key").cast("string").alias("entry_name"), "de")
    return R.uniprot_names(u).filter("is_standard").select("entry_name", "name")


@query("select rule, count(*) as n, 0 as fixed from (select 'range.violated' as rule from lineitem where l_returnflag not in ('A', 'N') union all select 'blank.name' from pathway_index where display_name is null or trim(display_name) = '' union all select 'dangling' from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)) group by rule")
def rule_violations(s, d):
    """VAL1, VAL2, AGG7: violations by rule."""
    from pathweave.quality import Rule, check

    rules = [
        Rule("range.violated", T(s, d, "lineitem").select(B.item_uri().alias("uri"), "l_returnflag"), ~F.col("l_returnflag").isin("A", "N")),
        Rule("blank.name", T(s, d, "pathway_index").select(F.col("doc_no").cast("string").alias("uri"), "display_name"), filled("display_name").isNull()),
        Rule("dangling", T(s, d, "orders").select("o_orderkey").join(T(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select(B.uri("order", "o_orderkey").alias("uri")), F.lit(True)),
    ]
    return check(rules).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_if("fixed").cast("int").alias("fixed"))


@query("select count(*) as n from lineitem where l_returnflag not in ('A', 'N')")
def unfixed_errors(s, d):
    """AGG7: errors that no fix removed; warnings and fixed ones don't count."""
    from pathweave.quality import WARNING, Rule, check, unfixed_errors

    rules = [
        Rule("range.violated", T(s, d, "lineitem").select(B.item_uri().alias("uri"), "l_returnflag"), ~F.col("l_returnflag").isin("A", "N")),
        Rule("blank.name", T(s, d, "pathway_index").select(F.col("doc_no").cast("string").alias("uri"), "display_name"), filled("display_name").isNull(), WARNING),
        Rule("padded.uri", T(s, d, "pathway_index").select("uri"), F.col("uri") != strip("uri"), fixable=True),
    ]
    return unfixed_errors(check(rules))


@query("""with g as (select 'generic:' || p_brand as src, 'memberPhysicalEntity' as prop, 'part:' || p_partkey as dst from part union all select 'part:' || p_partkey, 'entityReference', 'ref:' || p_type from part),
n as (select distinct m.src as generic, 'EntityReference_' || md5(m.src) as new, r.dst as er from g m join g r on r.src = m.dst and r.prop = 'entityReference' where m.prop = 'memberPhysicalEntity')
select src, prop, dst from g union all select distinct generic, 'entityReference', new from n union all select new, 'memberEntityReference', er from n""")
def normalize_generics(s, d):
    """GRA11: generics, here brands of parts, get an entity reference with their members' as members."""
    p = T(s, d, "part")
    m = p.select(F.concat(F.lit("generic:"), "p_brand").alias("src"), F.lit("memberPhysicalEntity").alias("prop"), B.uri("part", "p_partkey").alias("dst"))
    r = p.select(B.uri("part", "p_partkey").alias("src"), F.lit("entityReference").alias("prop"), F.concat(F.lit("ref:"), "p_type").alias("dst"))
    return E.normalize_generics(m.unionByName(r))


@query(f"with {B.ELEMENT_SQL} select datasource, count(*) filter (where type = 'Pathway') as num_pathways, count(*) filter (where type = 'Interaction') as num_interactions, count(*) filter (where type in ('PhysicalEntity', 'Part')) as num_physical_entities from element group by datasource")
def source_summary(s, d):
    """AGG3: counts by class of each source."""
    return E.source_summary(B.elements(s, d), B.PARENTS)


@query("select 'nation:' || n_nationkey as uri, case when n_nationkey % 2 = 0 then 'taxonomy:' || n_nationkey else n_name end as label from nation")
def organism_labels(s, d):
    """HLP3: references first, else names."""
    n = T(s, d, "nation").withColumn("uri", B.uri("nation", "n_nationkey"))
    x = n.filter(F.col("n_nationkey") % 2 == 0).select("uri", F.lit("taxonomy").alias("db"), F.col("n_nationkey").cast("string").alias("id"))
    return E.organism_labels(n, x, n.select("uri", F.col("n_name").alias("name")))
