"""The service's operations on one loaded model and index: fetch, search, traverse, the graph queries, id mapping, conversion, the
catalogue, plug-ins (UDF1-UDF3) and request checks (VAL5). Nothing is computed before a result's rows are asked for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.functions.text import Direction, Format, Graph, parse_enum, parse_format, split_arguments
from pathweave.model import INVERSES, Model, closure, subtypes
from pathweave.operators import entities, graph, interactions, search
from pathweave.plans.paths import traverse
from pathweave.sinks import flat

#: What graph queries start from when they are given reference ids.
SEEDS = ("PhysicalEntity", "Gene")
ANALYSES: dict[str, Callable[..., object]] = {}


def analysis(name: str) -> Callable:
    """Register a callable under a name; it gets a model (or tables) and returns a DataFrame, or a model that replaces it."""

    def add(f: Callable) -> Callable:
        ANALYSES[name] = f
        return f

    return add


def analyze(name: str, *arguments: object) -> object:
    """UDF1: run a registered analysis; KeyError if there is none."""
    return ANALYSES[name](*arguments)


@analysis("counts_by_class")
def counts_by_class(m: Model) -> DataFrame:
    return m.elements.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@analysis("features_summary")
def features_summary(m: Model, providers: list[str] | None = None) -> DataFrame:
    """AGG11, FIL25, JOI19: each feature's entities, providers and experimental forms."""
    f = m.edges.filter(F.col("prop").isin("feature", "notFeature")).select(F.col("dst").alias("feature"), F.col("src").alias("uri"))
    own = f.join(m.elements.select("uri", "datasource"), "uri")
    forms = m.edges.filter("prop = 'experimentalFeature'").select(F.col("dst").alias("feature"), F.col("src").alias("form")).groupBy("feature").agg(F.sort_array(F.collect_set("form")).alias("forms"))
    g = own.groupBy("feature").agg(F.sort_array(F.collect_set("uri")).alias("entities"), F.sort_array(F.collect_set("datasource")).alias("providers"))
    out = g.join(forms, "feature", "left")
    return out.filter(F.arrays_overlap("providers", F.array(*map(F.lit, providers))) | (F.size("providers") == 0)) if providers else out


class BadRequest(ValueError):
    """Status 400."""


@dataclass
class Service:
    """HLP6: a model with its index (or its documents, which are then indexed), mapping and blacklist (uri)."""

    model: Model
    index: search.Index | DataFrame
    mapping: DataFrame
    blacklist: DataFrame | None = None
    page_size: int = search.PAGE

    def __post_init__(self) -> None:
        if isinstance(self.index, DataFrame):
            self.index = search.Index.of(self.index)

    @property
    def documents(self) -> DataFrame:
        return self.index.documents

    def resolve(self, *ids: str, kinds: tuple[str, ...] = ()) -> DataFrame:
        """JOI18: (group_id, uri): each id's elements, itself where it is a uri, else those with it as a reference id, of these classes."""
        wanted = split_arguments(*ids)
        if not wanted:
            raise BadRequest("no id")
        spark = self.model.elements.sparkSession
        asked = spark.createDataFrame([(i, v) for i, v in enumerate(wanted)], "group_id int, id string")
        known = asked.join(self.model.elements.select(F.col("uri").alias("id")), "id", "left_semi").select("group_id", F.col("id").alias("uri"))
        docs = self.documents
        if kinds:
            docs = docs.filter(F.col("type").isin([t for k in kinds if k in self.model.classes for t in subtypes(k, self.model.classes)]))
        x = docs.select("uri", F.explode("xref_ids").alias("id"))
        by_id = asked.join(known.select("group_id"), "group_id", "left_anti").join(x, "id").select("group_id", "uri")
        return known.unionByName(by_id).distinct()

    def search(self, query: str, page: int = 0, type_: str | None = None, datasources: list[str] | None = None, organisms: list[str] | None = None) -> DataFrame:
        """SRT1-SRT3: one page of hits, the best first, ties by uri; a page past the last is empty."""
        if not query.strip() or page < 0:
            raise BadRequest("a query and a page from 0 are needed")
        found = search.ranked(self.index, query, type_, datasources, organisms, self.model.classes)
        places = search.page_of(found.select("uri", "score"), page, self.page_size).select("uri", "place")
        best = search.hits_of(found.join(places.select("uri"), "uri", "left_semi"), self.model.elements, self.model.literals)
        return best.join(places, "uri").orderBy("place").drop("place")

    def top_pathways(self) -> DataFrame:
        return search.hits_of(search.top_pathways(self.documents, self.model.classes, self.model.edges), self.model.elements, self.model.literals)

    def fetch(self, *ids: str, sub_pathways: bool = False) -> Model:
        """GRA7."""
        return graph.complete(self.model, self.resolve(*ids).select("uri").distinct(), sub_pathways)

    def traverse(self, path: str, *ids: str) -> DataFrame:
        try:
            return traverse(self.model, path, self.resolve(*ids).select("uri").distinct())
        except ValueError as e:
            raise BadRequest(str(e)) from e

    def map_ids(self, to_db: str, *ids: str) -> DataFrame:
        spark = self.model.elements.sparkSession
        return entities.map_ids(spark.createDataFrame([(i,) for i in split_arguments(*ids)], "id string"), self.mapping, to_db)

    def _allowed(self, organisms: list[str] | None, datasources: list[str] | None) -> DataFrame | None:
        """FIL15: the elements of these organisms and data sources; what has neither, like xrefs, is in no document and allowed."""
        if not organisms and not datasources:
            return None
        ok = F.lit(True)
        if organisms:
            ok = ok & ((F.size("organisms") == 0) | search.facet(organisms, F.col("organisms")))
        if datasources:
            ok = ok & ((F.size("datasources") == 0) | search.facet(datasources, F.col("datasources")))
        return self.model.elements.select("uri").join(self.documents.filter(~ok).select("uri"), "uri", "left_anti")

    def query_graph(self, kind: str, source: list[str], target: list[str] | None = None, limit: int = 1, direction: str | None = None, shortest_plus: int | None = None, organisms: list[str] | None = None, datasources: list[str] | None = None) -> DataFrame:
        """GRA1-GRA4 by name, within organisms and data sources where they are given. Without targets, paths from-to are paths between."""
        k = parse_enum(Graph, kind)
        way = parse_enum(Direction, direction) if direction else None
        if k is None or limit < 1 or not source or (direction and way is None):
            raise BadRequest("kind, source, limit or direction is wrong")
        seeds, e, only = self.resolve(*source, kinds=SEEDS), self.model.edges, self._allowed(organisms, datasources)
        if k is Graph.NEIGHBORHOOD:
            return graph.neighborhood(e, seeds, limit, way or Direction.UNDIRECTED, self.blacklist, only)
        if k is Graph.COMMONSTREAM:
            if way in (Direction.BOTHSTREAM, Direction.UNDIRECTED):
                raise BadRequest("a common stream goes one way")
            return graph.common_stream(e, seeds, limit, way or Direction.DOWNSTREAM, self.blacklist, only)
        if k is Graph.PATHSBETWEEN or not target:
            return graph.paths_between(e, seeds, limit, self.blacklist, only)
        return graph.paths_from_to(e, seeds, self.resolve(*target, kinds=SEEDS), limit, shortest_plus, self.blacklist, only)

    def convert(self, m: Model, format_: str, refs: DataFrame | None = None, id_type: str = "hgnc.symbol", organisms: list[str] | None = None) -> DataFrame:
        """SNK2-SNK9, FIL18, FIL19: lines of a sub-model in a format. refs (uri, ref, molecule) gives entities' identifiers.

        Pathways are left out of the formats of pairs. Extended SIF has its sections in order of part, gene sets are of the organisms asked for.
        """
        f = parse_format(format_)
        if f is None:
            raise BadRequest(f"no format {format_}")
        if f is Format.BIOPAX:
            return flat.owl_lines(m).select("value")
        if f is Format.JSONLD:
            return flat.jsonld_lines(m)
        if refs is None:
            raise BadRequest("identifiers of entities are needed")
        if f is Format.GSEA:
            return flat.gmt_lines(flat.gmt_members(m, refs, id_type), organisms)
        blacklist = None if self.blacklist is None else refs.join(self.blacklist.select("uri"), "uri", "left_semi").select("ref").distinct()
        pairs = interactions.infer(interactions.roles_of(m, refs), blacklist=blacklist)
        if f is Format.SBGN:
            return flat.sbgn_lines(pairs)
        if f is Format.BINARY_SIF:
            return flat.sif_lines(pairs)
        names = m.literals.filter(F.col("prop").isin("displayName", "standardName", "name")).select("uri", F.col("value").alias("name"))
        ids = search.xref_ids(m)
        kind = F.when(F.col("molecule"), "SmallMoleculeReference").otherwise("ProteinReference").alias("kind")
        nodes = refs.join(names, "uri", "left").join(ids, "uri", "left").select("ref", kind, "name", "unification", "relationship")
        used = pairs.select(F.col("a").alias("ref")).unionByName(pairs.select(F.col("b").alias("ref"))).distinct()
        none = m.elements.sparkSession.createDataFrame([], "a string, relation string, b string, datasource string, publication string, pathway string")
        return flat.txt_lines(pairs, nodes.join(used, "ref", "left_semi"), none)


def catalogue(m: Model) -> list[tuple[str, str]]:
    """The help catalogue: (topic, member)."""
    rows = [("formats", f.name) for f in Format] + [("kinds", g.name) for g in Graph] + [("directions", d.name) for d in Direction]
    rows += [("types", t) for t in closure(m.classes)] + [("properties", p) for p in INVERSES] + [("inverse_properties", p) for p in INVERSES.values()] + [("limits", "NORMAL"), ("limits", "SHORTEST_PLUS_K")]
    return rows
