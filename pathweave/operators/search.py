"""Full-text search: documents and postings (DM9, IDX*), facets, boolean queries, BM25 ranking, pages, highlights (FIL3-FIL9, SRT*)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathweave.functions.ids import local_part, lower_prefix
from pathweave.functions.text import tokens
from pathweave.model import Model, subtypes
from pathweave.operators.graph import containers, fetch_closure
from pathweave.operators.entities import keyword_literals
from pathweave.plans.querylang import analyse, condition, parse, scored_terms

PAGE = 100
#: BM25's usual parameters.
K1, B = 1.2, 0.75


def search_documents(m: Model) -> DataFrame:
    """IDX1-IDX5, FIL20, AGG2: one document for each Entity, EntityReference and Provenance.

    keywords are tokens of the element's and its children's (two levels) keyword texts; names and ids are exact values with lower-case
    copies; pathways are the containers' local parts and names; counts are of the child closure.
    """
    scope = m.of_type("Entity").unionByName(m.of_type("EntityReference")).unionByName(m.of_type("Provenance")).distinct()
    empty = F.array().cast("array<string>")
    sets = lambda df, name: df.groupBy("uri").agg(F.sort_array(F.collect_set("value")).alias(name))
    near = _descend(m.edges, scope, 2)
    words = near.join(keyword_literals(m.literals).withColumnRenamed("uri", "child"), "child").select("uri", F.explode(tokens("value")).alias("value"))
    names = m.literals.filter(F.col("prop").isin("name", "displayName", "standardName"))
    names = names.select("uri", "value").unionByName(names.select("uri", F.lower("value").alias("value")))
    xids = near.join(_xref_ids(m, "UnificationXref", "RelationshipXref").withColumnRenamed("owner", "child"), "child").select("uri", "value")
    xids = xids.unionByName(xids.select("uri", lower_prefix("value").alias("value")))
    up = containers(m.edges, scope, m.of_type("Pathway")).filter("uri <> container")
    up_names = up.join(m.literals.filter(F.col("prop").isin("name", "displayName")).select(F.col("uri").alias("container"), "value"), "container").select("uri", F.lower("value").alias("value"))
    up_ids = up.join(_xref_ids(m, "UnificationXref").select(F.col("owner").alias("container"), "value"), "container").select("uri", "value")
    up_names = up_names.unionByName(up.select("uri", local_part("container", colons=True).alias("value"))).unionByName(up_ids)
    org = near.join(m.edges.filter("prop = 'organism'").select(F.col("src").alias("child"), F.col("dst").alias("value")), "child").select("uri", "value")
    org_names = org.join(m.literals.filter(F.col("prop").isin("name", "displayName", "standardName")).select(F.col("uri").alias("value"), F.col("value").alias("n")), "value").select("uri", F.explode(tokens("n")).alias("value"))
    # an organism is also found by its taxon id, and by the tissue and cell type it is of
    kinds = org.select("uri", F.col("value").alias("o")).join(m.edges.filter("prop in ('tissue', 'cellType')").select(F.col("src").alias("o"), F.col("dst").alias("cv")), "o")
    terms = kinds.join(m.literals.filter("prop = 'term'").select(F.col("uri").alias("cv"), F.col("value").alias("n")), "cv").select("uri", F.explode(tokens("n")).alias("value"))
    taxa = org.select("uri", F.col("value").alias("owner")).join(_xref_ids(m, "UnificationXref", "RelationshipXref"), "owner").select("uri", "value")
    org_names = org_names.unionByName(terms).unionByName(taxa)
    src = scope.select("uri", F.col("datasource").alias("value")).filter("value is not null")
    src_names = src.join(m.literals.filter(F.col("prop").isin("name", "displayName", "standardName")).select(F.col("uri").alias("value"), F.lower("value").alias("n")), "value").select("uri", F.col("n").alias("value"))
    docs = scope.select("uri", "type")
    for df, name in (
        (words, "keywords"), (names, "names"), (xids, "xref_ids"), (up_names, "pathways"), (up.select("uri", F.col("container").alias("value")), "pathway_uris"),
        (org_names, "organisms"), (org, "organism_uris"), (src.select("uri", F.lower("value").alias("value")).unionByName(src_names), "datasources"), (src, "datasource_uris"),
    ):
        docs = docs.join(sets(df, name), "uri", "left").withColumn(name, F.coalesce(name, empty))
    counts = member_counts(m)
    return docs.join(counts, "uri", "left").withColumn("uris", F.array("uri")).withColumn("types", F.array(F.lower("type")))


def _xref_ids(m: Model, *kinds: str) -> DataFrame:
    """SCA33: (owner, value): the ids of elements' references of these classes, so not of publications."""
    x = m.elements.filter(F.col("type").isin(*kinds)).select(F.col("uri").alias("x"))
    owned = m.edges.filter("prop = 'xref'").select(F.col("src").alias("owner"), F.col("dst").alias("x")).join(x, "x", "left_semi")
    return owned.join(m.literals.filter("prop = 'id'").select(F.col("uri").alias("x"), "value"), "x").select("owner", "value")


def xref_ids(m: Model) -> DataFrame:
    """(uri, unification, relationship): the ids of elements' own and their entity references' references, one a row."""
    own = m.elements.select("uri", F.col("uri").alias("owner"))
    via = m.edges.filter("prop = 'entityReference'").select(F.col("src").alias("uri"), F.col("dst").alias("owner"))
    none = F.lit(None).cast("string")
    of = lambda kind: own.unionByName(via).join(_xref_ids(m, kind), "owner")
    return of("UnificationXref").select("uri", F.col("value").alias("unification"), none.alias("relationship")).unionByName(of("RelationshipXref").select("uri", none.alias("unification"), F.col("value").alias("relationship")))


def _descend(edges: DataFrame, scope: DataFrame, depth: int) -> DataFrame:
    """(uri, child): the elements of scope with themselves and what is below them to a depth."""
    e = edges.filter("prop <> 'nextStep'").select(F.col("src").alias("child"), F.col("dst").alias("next"))
    level = scope.select("uri", F.col("uri").alias("child"))
    out = level
    for _ in range(depth):
        level = level.join(e, "child").select("uri", F.col("next").alias("child"))
        out = out.unionByName(level)
    return out.distinct()


def member_counts(m: Model) -> DataFrame:
    """AGG2: (uri, num_participants, num_processes) of pathways, interactions and complexes over their child closure, which stops at
    sub-pathways; complexes have participants only."""
    from pathweave.operators.graph import distances
    from pathweave.runtime import Scratch

    owners = m.of_type("Process").unionByName(m.of_type("Complex")).select("uri", "type").distinct()
    sub = m.of_type("Pathway").select(F.col("uri").alias("src"))
    direct = m.edges.filter("prop <> 'nextStep'").select("src", "dst")
    inner = direct.join(sub, "src", "left_anti").select("src", "dst")
    scratch = Scratch(m.elements.sparkSession, "members")
    first = owners.join(direct, owners["uri"] == direct["src"]).select(F.col("uri").alias("owner"), F.col("dst").alias("uri")).distinct()
    below = distances(inner, first, None, scratch, "owner").join(m.elements.select("uri", F.col("type").alias("kind")), "uri")
    physical, process = subtypes("PhysicalEntity", m.classes) + (["Gene"] if "Gene" in m.classes else []), subtypes("Process", m.classes)
    n = below.groupBy(F.col("owner").alias("uri")).agg(F.count_if(F.col("kind").isin(physical)).cast("int").alias("num_participants"), F.count_if(F.col("kind").isin(process)).cast("int").alias("num_processes"))
    joined = n.join(owners, "uri")
    return joined.select("uri", "num_participants", F.when(F.col("type") != "Complex", F.col("num_processes")).alias("num_processes"))


def postings(docs: DataFrame, uri: str, text: str, field: str = "keyword") -> DataFrame:
    """DM9: (field, term, uri, tf, pos, doc_len): the inverted index of a text column, one row a term and document."""
    t = docs.select(F.col(uri).cast("string").alias("uri"), tokens(text).alias("ts"))
    each = t.select("uri", F.size("ts").alias("doc_len"), F.posexplode("ts").alias("p", "term"))
    g = each.groupBy("term", "uri", "doc_len").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.sort_array(F.collect_list("p")).alias("pos"))
    return g.select(F.lit(field).alias("field"), "term", "uri", "tf", "pos", "doc_len")


@dataclass(frozen=True)
class Index:
    """IDX6, IDX7: search documents with their inverted index and its statistics (one row: n documents, mean length avg_len)."""

    documents: DataFrame
    postings: DataFrame
    stats: DataFrame

    @staticmethod
    def of(docs: DataFrame) -> Index:
        """The index of documents' keywords."""
        each = docs.select("uri", F.size("keywords").alias("doc_len"), F.explode("keywords").alias("term"))
        p = each.groupBy("term", "uri", "doc_len").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        return Index(docs, p, docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("keywords")).alias("avg_len")))

    def write(self, path: str) -> Index:
        """SNK15: store the index, terms sorted within files so that a search reads few of them; what was there is replaced."""
        self.documents.write.mode("overwrite").parquet(f"{path}/search_doc")
        docs = self.documents.sparkSession.read.parquet(f"{path}/search_doc")
        new = Index.of(docs)
        new.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/posting")
        new.stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        return open_index(docs.sparkSession, path)

    def with_documents(self, docs: DataFrame) -> Index:
        """SNK15: documents added; those of the same uri are replaced."""
        kept = self.documents.join(docs.select("uri"), "uri", "left_anti").select(*self.documents.columns)
        return Index.of(kept.unionByName(docs))


def open_index(spark: SparkSession, path: str) -> Index:
    """SRC15: a stored index, to read."""
    return Index(*(spark.read.parquet(f"{path}/{n}") for n in ("search_doc", "posting", "stats")))


def ranked(index: Index, query: str, type_: str | None = None, datasources: list[str] | None = None, organisms: list[str] | None = None, classes: dict[str, str] | None = None) -> DataFrame:
    """SRT1, SRT6: the documents that a query matches, with their BM25 score over the query's keyword terms: 0 where only exact values match."""
    hits = search(index.documents, query, type_, datasources, organisms, classes)
    terms = scored_terms(parse(query))
    if not terms:
        return hits.withColumn("score", F.lit(0.0))
    return hits.join(bm25(index.postings, index.stats, terms), "uri", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def facet(values: list[str], column: Column) -> Column:
    """FIL6, SET4: values are OR-ed; one with white space is analysed and its tokens AND-ed, a single word is a lower-case token."""
    out = F.lit(False)
    for v in values:
        words = analyse(v) if re.search(r"\s", v) else [v.lower()]
        part = F.lit(bool(words))
        for w in words:
            part = part & F.array_contains(column, w)
        out = out | part
    return out


def type_filter(name: str, classes: dict[str, str]) -> Column:
    """FIL3: the class or any of its subclasses."""
    return F.col("type").isin(subtypes(name, classes))


def search(docs: DataFrame, query: str, type_: str | None = None, datasources: list[str] | None = None, organisms: list[str] | None = None, classes: dict[str, str] | None = None) -> DataFrame:
    """FIL7, FIL8: the documents that a query matches, filtered by class and facets."""
    hits = docs.filter(condition(parse(query)))
    if type_:
        hits = hits.filter(type_filter(type_, classes or {}))
    if datasources:
        hits = hits.filter(facet(datasources, F.col("datasources")))
    if organisms:
        hits = hits.filter(facet(organisms, F.col("organisms")))
    return hits


def bm25(index: DataFrame, stats: DataFrame, terms: list[str]) -> DataFrame:
    """(uri, score) of the documents with any of the terms. stats has one row: n documents and their mean length avg_len.

    Only the terms' postings are read; document frequencies come from them.
    """
    p = index.filter(F.col("term").isin(terms))
    df = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    x = p.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    return x.groupBy("uri").agg(F.sum(part).alias("score"))


def page_of(scored: DataFrame, page: int, size: int = PAGE) -> DataFrame:
    """SRT1, SRT2: (place, uri, score) of one page, from 0, by score and then uri; places count over all hits from 1."""
    top = scored.orderBy(F.desc(F.round("score", 6)), "uri").limit((page + 1) * size)
    w = Window.orderBy(F.desc(F.round("score", 6)), "uri")  # over the top rows only
    return top.withColumn("place", F.row_number().over(w)).filter(F.col("place") > page * size).select(F.col("place").cast("bigint").alias("place"), "uri", F.round("score", 4).alias("score"))


def highlight(text: Column | str, terms: list[str], fragments: int = 7, width: int = 80) -> Column:
    """SRT6: up to so many fragments of a text around its hits, each hit in a span."""
    t = F.col(text) if isinstance(text, str) else text
    alt = "|".join(map(re.escape, terms))
    pieces = F.regexp_extract_all(t, F.lit(rf"(?i)([^\n]{{0,{width // 2}}}\b(?:{alt})\b[^\n]{{0,{width // 2}}})"), F.lit(1))
    return F.transform(F.slice(pieces, 1, fragments), lambda p: F.regexp_replace(p, rf"(?i)\b({alt})\b", '<span class="hitHL">$1</span>'))


def hits_of(docs: DataFrame, elements: DataFrame, names: DataFrame) -> DataFrame:
    """FIL23, FIL24: hits as the service gives them; documents whose element is no longer in the model are left out."""
    n = names.groupBy("uri").agg(F.min(F.when(F.col("prop") == "standardName", F.col("value"))).alias("std"), F.min(F.when(F.col("prop") == "displayName", F.col("value"))).alias("disp"))
    return docs.join(elements.select("uri"), "uri", "left_semi").join(n, "uri", "left").select(
        "uri", F.col("type").alias("biopax_class"), F.coalesce("std", "disp").alias("name"), F.col("organism_uris").alias("organism"),
        F.col("datasource_uris").alias("datasource"), F.array_remove("pathway_uris", F.col("uri")).alias("pathway"), F.col("num_participants").alias("size"), "num_processes", *(["score"] if "score" in docs.columns else []),
    )


def top_pathways(docs: DataFrame, classes: dict[str, str], edges: DataFrame) -> DataFrame:
    """FIL16, GRA12: pathways in no other pathway that have more than two processes, or a child pathway that has."""
    pathways = docs.filter(type_filter("Pathway", classes))
    large = pathways.filter("num_processes > 2").select("uri")
    over = edges.filter("prop = 'pathwayComponent'").join(large.withColumnRenamed("uri", "dst"), "dst", "left_semi").select(F.col("src").alias("uri"))
    top = pathways.filter(F.size(F.array_remove("pathway_uris", F.col("uri"))) == 0)
    return top.join(large.unionByName(over).distinct(), "uri", "left_semi").select(*docs.columns)


def drop_documents(index: DataFrame) -> DataFrame:
    """SNK16, IDX6: an index without its model's documents; mapping rows (no field) stay."""
    return index.filter(F.col("field").isNull())


__all__ = ["Index", "open_index", "ranked", "bm25", "drop_documents", "facet", "fetch_closure", "highlight", "hits_of", "member_counts", "page_of", "postings", "search", "search_documents", "top_pathways", "type_filter"]
