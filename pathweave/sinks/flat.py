"""Flat outputs as DataFrames of lines or rows, and their writers (SNK1-SNK20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.functions.text import truncate_query
from pathweave.model import Model
from pathweave.operators.entities import sorted_join


def sif_lines(pairs: DataFrame) -> DataFrame:
    """SNK3: (value): ``a<TAB>relation<TAB>b``, distinct."""
    return pairs.select(F.concat_ws("\t", "a", "relation", "b").alias("value")).distinct()


def txt_sections(pairs: DataFrame, nodes: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK4: the edge and the node section of extended SIF. sources (a, relation, b, datasource, publication, pathway); nodes (ref, kind,
    name, unification, relationship), one row a value. Lists are sorted and joined by ``;``."""
    e = pairs.join(sources, ["a", "relation", "b"], "left").groupBy("a", "relation", "b").agg(sorted_join("datasource").alias("interaction_data_source"), sorted_join("publication").alias("interaction_pubmed_id"), sorted_join("pathway").alias("pathway_names"))
    n = nodes.groupBy(F.col("ref").alias("participant")).agg(F.min("kind").alias("participant_type"), sorted_join("name").alias("participant_name"), sorted_join("unification").alias("unification_xref"), sorted_join("relationship").alias("relationship_xref"))
    return e.withColumnsRenamed({"a": "participant_a", "relation": "interaction_type", "b": "participant_b"}), n


def txt_lines(pairs: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """SNK4: (part, value): extended SIF: part 0 the edges' header, 1 the edges, 2 an empty line, 3 the nodes' header, 4 the nodes."""
    e, n = txt_sections(pairs, nodes, sources)
    spark = pairs.sparkSession
    heads = spark.createDataFrame([(0, "\t".join(c.upper() for c in e.columns)), (2, ""), (3, "\t".join(c.upper() for c in n.columns))], "part int, value string")
    lines = lambda df, k: df.select(F.lit(k).alias("part"), F.concat_ws("\t", *(F.coalesce(F.col(c), F.lit("")) for c in df.columns)).alias("value"))
    return heads.unionByName(lines(e, 1)).unionByName(lines(n, 4))


def gmt_members(m: Model, refs: DataFrame, id_type: str) -> DataFrame:
    """AGG10: the rows of gmt_lines: for each pathway the identifiers (refs: uri, ref) of the entities below it that aren't molecules."""
    from pathweave.operators.graph import containers

    name = m.literals.filter(F.col("prop").isin("displayName", "standardName", "name")).groupBy("uri").agg(F.min_by("value", F.when(F.col("prop") == "displayName", 0).otherwise(1)).alias("label"))
    organism = m.edges.filter("prop = 'organism'").select(F.col("src").alias("o"), F.col("dst").alias("b")).join(name.withColumnRenamed("uri", "b"), "b", "left").groupBy("o").agg(F.min(F.coalesce("label", "b")).alias("species"))
    via = m.edges.filter("prop = 'entityReference'").select(F.col("src").alias("uri"), F.col("dst").alias("o"))
    species = via.unionByName(refs.select("uri", F.col("uri").alias("o"))).join(organism, "o").groupBy("uri").agg(F.min("species").alias("member_organism"))
    up = containers(m.edges, refs.filter("not molecule").select("uri"), m.of_type("Pathway"))
    rows = up.join(refs.filter("not molecule").select("uri", F.col("ref").alias("symbol")), "uri").join(species, "uri", "left").drop("uri").withColumnRenamed("container", "uri")
    rows = rows.join(m.elements.select("uri", "datasource"), "uri").join(name, "uri", "left").join(organism.withColumnRenamed("o", "uri"), "uri", "left")
    none = F.lit("")
    return rows.select("uri", F.coalesce("label", "uri").alias("name"), F.coalesce("datasource", none).alias("datasource"), F.coalesce("species", "member_organism", none).alias("organism"), F.coalesce("member_organism", "species", none).alias("member_organism"), F.lit(id_type).alias("id_type"), "symbol")


def gmt_lines(members: DataFrame, organisms: list[str] | None = None) -> DataFrame:
    """SNK5, FIL18: gene sets ``uri<TAB>name; datasource; organism; id type<TAB>symbols...`` of members (uri, name, datasource, organism,
    member_organism, id_type, symbol): members of another species than their pathway, and pathways of species not asked for, are left out."""
    m = members.filter((F.col("organism") == F.col("member_organism")) & F.col("symbol").isNotNull())
    if organisms:
        m = m.filter(F.col("organism").isin(organisms))
    title = F.concat(F.lit("name: "), F.col("name"), F.lit("; datasource: "), F.col("datasource"), F.lit("; organism: "), F.col("organism"), F.lit("; idtype: "), F.col("id_type"))
    g = m.groupBy("uri", title.alias("title")).agg(F.sort_array(F.collect_set("symbol")).alias("symbols"))
    return g.select(F.concat_ws("\t", "uri", "title", F.array_join("symbols", "\t")).alias("value"))


def jsonld_lines(m: Model) -> DataFrame:
    """SNK7: (value): one JSON object an element: its id, type and properties, references as ``{"@id": ...}``."""
    own = m.elements.select("uri")
    refs = m.edges.select(F.col("src").alias("uri"), "prop", F.to_json(F.struct(F.col("dst").alias("@id"))).alias("v")).join(own, "uri", "left_semi")
    data = m.literals.join(own, "uri", "left_semi").select("uri", "prop", F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace("value", r"([\\\"])", r"\\$1"), r"[\x00-\x1f]", " "), F.lit('"')).alias("v"))
    props = refs.unionByName(data).groupBy("uri", "prop").agg(F.sort_array(F.collect_set("v")).alias("vs"))
    text = props.groupBy("uri").agg(F.sort_array(F.collect_list(F.concat(F.lit('"'), F.col("prop"), F.lit('":['), F.array_join("vs", ","), F.lit("]")))).alias("ps"))
    j = m.elements.join(text, "uri", "left")
    body = F.when(F.size(F.coalesce("ps", F.array())) > 0, F.concat(F.lit(","), F.array_join("ps", ","))).otherwise("")
    return j.select(F.concat(F.lit('{"@id":"'), F.col("uri"), F.lit('","@type":"bp:'), F.col("type"), F.lit('"'), body, F.lit("}")).alias("value"))


def _escaped(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    for ch, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(ch), F.lit(ref))
    return c


def owl_lines(m: Model, base: str = "") -> DataFrame:
    """SNK1: (uri, value): each element as RDF/XML with absolute URIs; put between ``owl_header`` and ``</rdf:RDF>``."""
    refs = m.edges.select(F.col("src").alias("uri"), F.concat(F.lit("<bp:"), F.col("prop"), F.lit(' rdf:resource="'), _escaped("dst"), F.lit('"/>')).alias("v"))
    data = m.literals.select("uri", F.concat(F.lit("<bp:"), F.col("prop"), F.lit(' rdf:datatype="http://www.w3.org/2001/XMLSchema#string">'), _escaped("value"), F.lit("</bp:"), F.col("prop"), F.lit(">")).alias("v"))
    body = refs.unionByName(data).groupBy("uri").agg(F.array_join(F.sort_array(F.collect_set("v")), "\n ").alias("body"))
    j = m.elements.join(body, "uri", "left")
    return j.select("uri", F.concat(F.lit("<bp:"), F.col("type"), F.lit(' rdf:about="'), _escaped("uri"), F.lit('">\n '), F.coalesce("body", F.lit("")), F.lit("\n</bp:"), F.col("type"), F.lit(">")).alias("value"))


def owl_header(base: str) -> str:
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:bp="http://www.biopax.org/release/biopax-level3.owl#" xml:base="{base}">\n<owl:Ontology rdf:about=""><owl:imports rdf:resource="http://www.biopax.org/release/biopax-level3.owl#"/></owl:Ontology>'


# The arc classes of SBGN process diagrams that relations stand for; others are an unknown influence.
ARCS = {"consumption-controlled-by": "consumption", "used-to-produce": "production", "controls-production-of": "production", "catalysis-precedes": "catalysis", "controls-expression-of": "stimulation", "controls-state-change-of": "stimulation", "controls-phosphorylation-of": "stimulation", "controls-transport-of": "stimulation", "controls-transport-of-chemical": "stimulation"}
SBGN_HEADER = '<?xml version="1.0" encoding="UTF-8"?>\n<sbgn xmlns="http://sbgn.org/libsbgn/0.2"><map language="process description">'
SBGN_FOOTER, OWL_FOOTER = "</map></sbgn>", "</rdf:RDF>"


def sbgn_lines(pairs: DataFrame) -> DataFrame:
    """SNK6: (value): glyphs and arcs of SBGN-ML for (a, relation, b), to stand between SBGN_HEADER and SBGN_FOOTER; no layout."""
    glyph = lambda c: pairs.select(F.concat(F.lit('<glyph class="macromolecule" id="'), _escaped(c), F.lit('"><label text="'), _escaped(c), F.lit('"/></glyph>')).alias("value"))
    kind = F.lit("unknown influence")
    for relation, arc in ARCS.items():
        kind = F.when(F.col("relation") == relation, arc).otherwise(kind)
    arcs = pairs.select(F.concat(F.lit('<arc class="'), kind, F.lit('" source="'), _escaped("a"), F.lit('" target="'), _escaped("b"), F.lit('"/>')).alias("value"))
    return glyph("a").unionByName(glyph("b")).unionByName(arcs).distinct()


def write_document(lines: DataFrame, path: str, header: str, footer: str) -> None:
    """SNK1, SNK6: a document in a folder of gzip parts that make one file when joined in order: the header, the lines, the footer."""
    spark = lines.sparkSession
    end = lambda text: spark.createDataFrame([(text,)], "value string").coalesce(1)
    for k, df in enumerate((end(header), lines.select("value"), end(footer))):
        df.write.mode("overwrite").option("compression", "gzip").text(f"{path}/{k}")


def datasource_lines(sources: DataFrame) -> DataFrame:
    """SNK10: the TSV summary of sources (identifier, names, description, kind, num_pathways, num_interactions)."""
    n = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    return sources.select(F.concat_ws("\t", "identifier", F.coalesce("description", F.lit("")), "kind", F.array_join("names", ";"), n("num_pathways"), n("num_interactions")).alias("value"))


def accession_list(mapping: DataFrame) -> DataFrame:
    """SNK11: distinct primary accessions, sorted by the writer."""
    return mapping.filter(F.upper("dst_db") == "UNIPROT").select(F.col("dst_id").alias("value")).distinct()


def audit_lines(requests: DataFrame) -> DataFrame:
    """SNK18, SCA30: one JSON line a request: its query cut to 128 characters, providers, error."""
    return requests.select(F.to_json(F.struct("command", truncate_query("query").alias("query"), "providers", "error")).alias("value"))


def response_lines(hits: DataFrame) -> DataFrame:
    """SNK17: one JSON object a hit; nulls left out."""
    return hits.select(F.to_json(F.struct("*")).alias("value"))


def write_lines(lines: DataFrame, path: str, order: str | None = "value", codec: str = "gzip") -> None:
    """Lines as text files; with an order the files are sorted one after the other."""
    out = lines.orderBy(order) if order else lines
    out.select("value").write.mode("overwrite").option("compression", codec).text(path)


def write_model(m: Model, path: str) -> None:
    """SNK1, IDX7: a model as three Parquet tables."""
    for name, df in (("element", m.elements), ("edge", m.edges), ("literal", m.literals)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_model(spark, path: str) -> Model:
    """SRC5: a model written by write_model."""
    return Model(*(spark.read.parquet(f"{path}/{n}") for n in ("element", "edge", "literal")))


def is_empty(m: Model) -> bool:
    """SNK8: whether there is nothing to give: callers then answer with an empty result."""
    return m.elements.isEmpty()


def blacklist_lines(hubs: DataFrame) -> DataFrame:
    """SNK12: ``uri<TAB>degree`` of ubiquitous elements."""
    return hubs.select(F.concat_ws("\t", "uri", F.col("degree").cast("string")).alias("value"))


def metadata_lines(sources: DataFrame) -> DataFrame:
    """SNK13: one JSON object a source, local prefixes of its data's location left out."""
    local = F.regexp_replace("dataUrl", "^(classpath:|file:)", "")
    return sources.withColumn("dataUrl", local).select(F.to_json(F.struct(*sources.columns)).alias("value"))


def report_lines(violations: DataFrame) -> DataFrame:
    """SNK14: a validation report as one JSON line a rule: its violations in order."""
    g = violations.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_if("fixed").alias("n_fixed"))
    return g.select(F.to_json(F.struct("rule", "severity", "n", "n_fixed")).alias("value"))


def provider_names(elements: DataFrame) -> DataFrame:
    """SNK9, AGG5: the distinct providers of a result."""
    return elements.select("datasource").dropna().distinct()
