"""Queries of full-text search: boolean queries, facets, ranking and pages, on documents and the pathway index."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathweave import binding as B
from pathweave.functions.text import STOP_WORDS, name_variants, tokens
from pathweave.operators import entities as E
from pathweave.operators import search as S
from pathweave.runtime import table

QUERIES, SQL = {}, {}
STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
TOKENS_SQL = f"docs as (select doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: w not in ({STOP})) as ts, lang, source from documents where text is not null)"


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(s, d):
    none = F.array().cast("array<string>")
    t = table(s, d, "documents").filter("text is not null")
    return t.select("doc_id", F.lit("Document").alias("type"), tokens("text").alias("keywords"), none.alias("names"), none.alias("xref_ids"), F.array(F.lower(F.coalesce("source", F.lit("")))).alias("datasources"), F.array(F.lower(F.coalesce("lang", F.lit("")))).alias("organisms"))


def _terms(s, d):
    """Pathway index records with exact names and analysed type and source."""
    none = F.array().cast("array<string>")
    p = table(s, d, "pathway_index").filter("display_name is not null")
    return p.select("doc_no", "uri", F.col("biopax_type").alias("type"), none.alias("keywords"), name_variants("display_name").alias("names"), none.alias("xref_ids"), F.array(F.lower(F.coalesce("datasource", F.lit("")))).alias("datasources"), tokens(F.coalesce("organism", F.lit(""))).alias("organisms"))


@query(f"with {TOKENS_SQL} select doc_id from docs where list_contains(ts, 'lysosome')")
def search_term(s, d):
    """FIL8, FIL9."""
    return S.search(_docs(s, d), "keyword:lysosome").select("doc_id")


@query(f"with {TOKENS_SQL} select doc_id from docs where list_contains(ts, 'isoforms') and list_contains(ts, 'differ') and not list_contains(ts, 'receptor')")
def search_boolean(s, d):
    """FIL8: AND and NOT."""
    return S.search(_docs(s, d), "isoforms AND differ AND NOT receptor").select("doc_id")


@query(f"with {TOKENS_SQL} select doc_id from docs where contains(' ' || array_to_string(ts, ' ') || ' ', ' half life ')")
def search_phrase(s, d):
    """FIL8: tokens side by side."""
    return S.search(_docs(s, d), '"half-life of"').select("doc_id")


@query(f"with {TOKENS_SQL} select doc_id from docs where len(list_filter(ts, lambda t: t = 'half' or t = 'life')) > 0")
def search_word_of_tokens(s, d):
    """FIL8: a word of several tokens matches any of them."""
    return S.search(_docs(s, d), "half-life").select("doc_id")


@query("select doc_no from pathway_index where display_name like '%or_ne%' or lower(display_name) like '%or_ne%'")
def search_wildcard(s, d):
    """FIL8: wildcards on exact names, leading ones too."""
    return S.search(_terms(s, d), "name:*or?ne*").select("doc_no")


@query("select doc_no from pathway_index where display_name = 'Regulation of zanrhool' or display_name = 'regulation of zanrhool' or lower(display_name) = 'regulation of zanrhool'")
def search_field_exact(s, d):
    """FIL9, SCA35: exact names, or their lower-case copies."""
    return S.search(_terms(s, d), 'name:"Regulation of zanrhool" OR name:"regulation of zanrhool"').select("doc_no")


@query("select biopax_type as type, count(*) as n from pathway_index where display_name is not null and biopax_type in ('Interaction', 'MolecularInteraction', 'Conversion', 'BiochemicalReaction', 'ComplexAssembly', 'Degradation', 'Transport', 'TransportWithBiochemicalReaction', 'Control', 'Catalysis', 'Modulation', 'TemplateReactionRegulation', 'GeneticInteraction', 'TemplateReaction') and lower(datasource) = 'reactory' group by 1")
def search_all_type(s, d):
    """FIL7: everything of a class and a source."""
    from pathweave.model import PARENTS

    return S.search(_terms(s, d), "*", "Interaction", ["Reactory"], classes=PARENTS).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id from documents where text is not null and lower(lang) in ('en', 'fr') and lower(source) in ('reactory', 'kinome')")
def facet_or(s, d):
    """FIL4-FIL6: values of a facet OR-ed, facets AND-ed."""
    return S.search(_docs(s, d), "*", None, ["reactory", "Kinome"], ["en", "fr"]).select("doc_id")


@query("select doc_no from pathway_index where display_name is not null and (organism = 'Homo sapiens' or regexp_matches(lower(organism), '\\brattus\\b'))")
def facet_and_tokens(s, d):
    """FIL6: a value of several words needs all of them."""
    return S.search(_terms(s, d), "*", None, None, ["Homo sapiens", "Rattus"]).select("doc_no")


@query(f"""with {TOKENS_SQL}, n as (select count(*) as n, avg(len(ts)) as avg_len from docs),
p as (select doc_id, len(ts) as dl, t.term, len(list_filter(ts, lambda x: x = t.term)) as tf from docs, (values ('membrane'), ('receptor'), ('mitochondrial')) t(term) where list_contains(ts, t.term)),
df as (select term, count(*) as df from p group by term),
sc as (select doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_len))) as score from p join df using (term), n group by doc_id),
r as (select row_number() over (order by round(score, 6) desc, doc_id::varchar) as place, doc_id::varchar as uri, round(score, 4) as score from sc)
select place, uri, score from r where place > 10 and place <= 20""")
def search_ranked_page(s, d):
    """SRT1, SRT2: the second page of ten by BM25, ties by uri."""
    docs = table(s, d, "documents").filter("text is not null")
    index = S.postings(docs, "doc_id", "text")
    stats = docs.select(F.size(tokens("text")).alias("l")).agg(F.count(F.lit(1)).alias("n"), F.avg("l").alias("avg_len"))
    return S.page_of(S.bm25(index, stats, ["membrane", "receptor", "mitochondrial"]), 1, 10)


@query(f"with {TOKENS_SQL}, h as (select count(*) as hits from docs where list_contains(ts, 'membrane')) select hits, (case when hits > 0 then (hits - 1) // 100 + 1 else 0 end)::bigint as pages from h")
def search_num_hits(s, d):
    """AGG1, AGG6: all hits and pages."""
    n = S.search(_docs(s, d), "membrane").agg(F.count(F.lit(1)).alias("hits"))
    return n.select("hits", E.pages(F.col("hits"), F.lit(100)).alias("pages"))


@query(f"with {TOKENS_SQL} select term, count(*) as df, sum(tf)::bigint as cf from (select doc_id, term, count(*) as tf from (select doc_id, unnest(ts) as term from docs) group by 1, 2) group by term")
def posting_statistics(s, d):
    """DM9, FIL9: document and collection frequencies of the inverted index."""
    p = S.postings(table(s, d, "documents").filter("text is not null"), "doc_id", "text")
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("select doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?i)([^\\n]{0,40}\\bmembrane\\b[^\\n]{0,40})', 1)[1:7], lambda p: regexp_replace(p, '(?i)\\b(membrane)\\b', '<span class=\"hitHL\">\\1</span>', 'g')), ' ... ') as fragments from documents where regexp_matches(text, '(?i)\\bmembrane\\b')")
def search_highlight(s, d):
    """SRT6: fragments around the hits."""
    t = table(s, d, "documents").filter(F.col("text").rlike(r"(?i)\bmembrane\b"))
    return t.select("doc_id", F.concat_ws(" ... ", S.highlight("text", ["membrane"])).alias("fragments"))


def search_top_pathways(s, d):
    """FIL16, AGG2, AGG4, IDX1-IDX5: top pathways of the search documents of a graph."""
    m = B.model(s, d)
    small = type(m)(m.elements, m.edges.filter("prop in ('component', 'participant')"), m.literals, m.parents)
    counts = S.member_counts(type(m)(small.elements, small.edges, small.literals, (*m.parents, ("Complex", "PhysicalEntity"))))
    return counts.filter("num_processes > 2")


QUERIES["search_top_pathways"] = search_top_pathways
SQL["search_top_pathways"] = "select 'order:' || l_orderkey as uri, count(distinct l_partkey)::int as num_participants, count(distinct l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d'))::int as num_processes from lineitem group by l_orderkey having count(distinct l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d')) > 2"
