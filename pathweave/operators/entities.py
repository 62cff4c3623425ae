"""Filters, joins, aggregations and set operations on elements, references and mappings (FIL*, JOI*, AGG*, SET*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.functions.ids import fix_id_for_mapping, guess_id, id_from_uri, mapping_key, starts_with_any
from pathweave.model import Model
from pathweave.runtime import filled

#: More mapped ids than this are no identification (AGG13).
MOST_IDS = 5


def lookup_uris(elements: DataFrame, uris: DataFrame) -> DataFrame:
    """FIL2: the elements of these uris (uri); unknown ones are dropped."""
    return elements.join(uris.select("uri").distinct(), "uri", "left_semi")


def keyword_literals(literals: DataFrame, props: tuple[str, ...] = ("author", "chemicalFormula", "comment", "controlType", "eCNumber", "id", "name", "term", "title")) -> DataFrame:
    """FIL10, FIL11: the literals searched as keywords: of these properties, without texts that the merge generated."""
    return literals.filter(F.col("prop").isin(*props) & ~F.col("value").startswith("REPLACED") & ~F.col("value").contains("ADDED"))


def clean_xrefs(xrefs: DataFrame) -> DataFrame:
    """FIL12: references (uri, type, db, id) without those, publications apart, whose db or id is blank; db in lower case."""
    publication = F.col("type") == "PublicationXref"
    ok = publication | (filled("db").isNotNull() & filled("id").isNotNull())
    return xrefs.filter(ok).withColumn("db", F.when(publication, F.col("db")).otherwise(F.lower("db")))


def supported_interactions(participants: DataFrame, supported: list[str]) -> DataFrame:
    """FIL13: (interaction) that stay, of participants (interaction, kind, organism): one participant is a complex or process, has no
    known organism, or a supported one. Small molecules don't count; an interaction of small molecules only goes."""
    keeps = F.col("kind").isin("Complex", "Process") | ((F.col("kind") != "SmallMolecule") & (F.col("organism").isNull() | F.col("organism").isin(supported)))
    return participants.groupBy("interaction").agg(F.bool_or(keeps).alias("keep")).filter("keep").select("interaction")


def unreferenced(elements: DataFrame, edges: DataFrame, kinds: list[str], spared: Column | None = None) -> DataFrame:
    """FIL14, JOI15: (uri) of the elements of these classes that no edge points to, those that the condition spares apart."""
    e = elements.filter(F.col("type").isin(kinds))
    if spared is not None:
        e = e.filter(~F.coalesce(spared, F.lit(False)))
    return e.select("uri").join(edges.select(F.col("dst").alias("uri")), "uri", "left_anti")


def remove_dangling(model: Model, kinds: list[str]) -> Model:
    """JOI15: the model without elements of these classes that nothing points to, again and again until none is left."""
    from pathweave.runtime import Scratch

    scratch = Scratch(model.elements.sparkSession, "dangling")
    elements, edges = model.elements, model.edges
    while True:
        gone, _ = scratch.write(unreferenced(elements, edges, kinds))
        if gone.isEmpty():
            break
        elements, _ = scratch.write(elements.join(gone, "uri", "left_anti"))
        edges, _ = scratch.write(edges.join(gone.withColumnRenamed("uri", "src"), "src", "left_anti").select("src", "prop", "dst"))
    return Model(elements, edges, model.literals.join(elements.select("uri"), "uri", "left_semi").select("uri", "prop", "value"), model.parents)


def map_ids(ids: DataFrame, mapping: DataFrame, to_db: str) -> DataFrame:
    """JOI7-JOI9: (id, mapped): sorted distinct ids of to_db (CHEBI or UNIPROT) that ids (id) map to; ids without any are left out."""
    source = ids.select("id", guess_id("id", to_db).alias("src_id")).distinct()
    hits = source.join(mapping.filter(F.upper("dst_db") == to_db.upper()), "src_id")
    return hits.groupBy("id").agg(F.sort_array(F.collect_set("dst_id")).alias("mapped"))


def normalized_mapping(mapping: DataFrame) -> DataFrame:
    """DM7: mapping rows as stored: databases upper-cased, ids in the mapping form, one row for each key."""
    rows = mapping.select(F.upper(filled("src_db")).alias("src_db"), filled("src_id").alias("s"), F.upper(filled("dst_db")).alias("dst_db"), filled("dst_id").alias("d")).dropna()
    fixed = rows.select("src_db", fix_id_for_mapping("src_db", "s").alias("src_id"), "dst_db", fix_id_for_mapping("dst_db", "d").alias("dst_id"))
    return fixed.distinct().withColumn("doc_id", mapping_key("src_db", "src_id", "dst_db", "dst_id"))


def unambiguous(pairs: DataFrame, key: str, target: str) -> DataFrame:
    """JOI5: (key, target) of the keys with exactly one distinct target."""
    return pairs.groupBy(key).agg(F.min(target).alias(target), F.max(target).alias("most")).filter(F.col(target) == F.col("most")).select(key, target)


def canonical(references: DataFrame, warehouse: DataFrame, mapping: DataFrame, xrefs: DataFrame) -> DataFrame:
    """JOI1-JOI5, JOI10: (uri, primary, how): the warehouse id a reference stands for, by the first way that finds any.

    references (uri), warehouse (uri, primary), mapping (src_id, dst_id), xrefs (uri, type, id). Ways: the same uri; the uri's id,
    only without usable references; unification references; relationship references. More than one target of a way means none.
    """
    usable = xrefs.filter(F.col("type").isin("UnificationXref", "RelationshipXref"))
    known = warehouse.select(F.col("primary").alias("dst_id")).distinct()
    ways = mapping.select("src_id", "dst_id").unionByName(known.select(F.col("dst_id").alias("src_id"), "dst_id")).distinct().join(known, "dst_id", "left_semi")
    same = references.join(warehouse, "uri").select("uri", "primary", F.lit(0).alias("rank"), F.lit("uri").alias("how"))
    bare = references.join(usable.select("uri"), "uri", "left_anti").select("uri", id_from_uri("uri").alias("src_id"))
    by_id = bare.join(ways, "src_id").select("uri", F.col("dst_id").alias("primary"), F.lit(1).alias("rank"), F.lit("id").alias("how"))
    linked = usable.join(references.select("uri"), "uri", "left_semi").join(ways, usable["id"] == ways["src_id"])
    unification = F.col("type") == "UnificationXref"
    by_xref = linked.select("uri", F.col("dst_id").alias("primary"), F.when(unification, 2).otherwise(3).alias("rank"), F.when(unification, "unification").otherwise("relationship").alias("how"))
    found = same.unionByName(by_id).unionByName(by_xref)
    ways = found.groupBy("uri", "rank", "how").agg(F.min("primary").alias("primary"), F.max("primary").alias("most"))
    best = ways.groupBy("uri").agg(F.min_by(F.struct("primary", "most", "how"), "rank").alias("b")).select("uri", "b.*")
    # a warehouse has one entry for a uri; what else is ambiguous is none
    return best.filter((F.col("primary") == F.col("most")) | (F.col("how") == "uri")).select("uri", "primary", "how")


def datasources_named(sources: DataFrame, *identifiers: str) -> DataFrame:
    """JOI20, JOI25: (identifier, display_name): the names of the sources (identifier, display_names) with these identifiers, in any case."""
    found = sources.filter(F.lower("identifier").isin([i.lower() for i in identifiers]))
    return found.select("identifier", F.explode("display_names").alias("display_name"))


def mapped_from(mapping: DataFrame, db: str) -> DataFrame:
    """JOI7, JOI13: (dst_db, dst_id, n, src_dbs): how many ids map to each id of a database, and of which databases, sorted and joined."""
    return mapping.filter(F.upper("dst_db") == db.upper()).groupBy("dst_db", "dst_id").agg(F.count(F.lit(1)).alias("n"), sorted_join("src_db").alias("src_dbs"))


def minus(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """SET5: distinct keys of new that known doesn't have; nulls are neither."""
    return new.select(key).dropna().distinct().join(known.select(key), key, "left_anti")


def others(own: Column | str, *values: Column | str) -> Column:
    """SET6: the distinct values besides an element's own, sorted; nulls left out."""
    a = F.array_compact(F.array(*values))
    return F.sort_array(F.array_remove(F.array_distinct(a), F.col(own) if isinstance(own, str) else own))


def by_name(left: DataFrame, right: DataFrame) -> DataFrame:
    """JOI6: (uri, target) by exact name in any case (uri, name on both sides), ambiguous names left out."""
    r = right.select(F.lower("name").alias("n"), F.col("uri").alias("target"))
    return unambiguous(left.select("uri", F.lower("name").alias("n")).join(r, "n"), "uri", "target")


def capped(ids: Column, all_or_nothing: bool, most: int = MOST_IDS) -> Column:
    """AGG13: at most so many ids: more are none of them, or else the first in order."""
    s = F.sort_array(ids)
    return F.when(F.size(s) <= most, s).otherwise(F.array().cast("array<string>") if all_or_nothing else F.slice(s, 1, most))


def enriched(entities: DataFrame, mapping: DataFrame, db: str) -> DataFrame:
    """JOI12, HLP1, HLP2: (uri, id): ids of db that entities (uri, dbs, ids) map to, for those with no reference to db yet."""
    lacking = entities.filter(~F.exists("dbs", lambda x: starts_with_any(x, db))).select("uri", F.explode("ids").alias("src_id"))
    hits = lacking.join(mapping.filter(F.upper("dst_db") == db.upper()), "src_id").groupBy("uri").agg(F.collect_set("dst_id").alias("found"))
    return hits.select("uri", F.explode(capped(F.col("found"), db.upper() == "CHEBI")).alias("id"))


def equivalents(items: DataFrame, keys: list[str], uri: str = "uri") -> DataFrame:
    """JOI14, AGG12: (uri, survivor): items with equal keys stand for the least uri among them."""
    return items.join(items.groupBy(*keys).agg(F.min(uri).alias("survivor")), keys).select(uri, "survivor")


def type_conflicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """JOI16: (uri, type_a, type_b) of elements of both sides with different classes."""
    return a.select("uri", F.col("type").alias("type_a")).join(b.select("uri", F.col("type").alias("type_b")), "uri").filter("type_a <> type_b")


def replacement_uri(base: str, kind: Column | str, uri: Column | str) -> Column:
    """A stable URI for an element whose own is taken by another class: of base, class and the md5 of both."""
    k, u = (F.col(x) if isinstance(x, str) else x for x in (kind, uri))
    return F.concat(F.lit(base), k, F.lit("_"), F.md5(F.concat_ws("|", k, u)))


def replaced(edges: DataFrame, replacements: DataFrame) -> DataFrame:
    """JOI17: edges with both ends replaced by replacements (old, new)."""
    s = replacements.select(F.col("old").alias("src"), F.col("new").alias("new_src"))
    d = replacements.select(F.col("old").alias("dst"), F.col("new").alias("new_dst"))
    return edges.join(s, "src", "left").join(d, "dst", "left").select(F.coalesce("new_src", "src").alias("src"), "prop", F.coalesce("new_dst", "dst").alias("dst")).distinct()


def single_members(edges: DataFrame, prop: str) -> DataFrame:
    """JOI21: (src, dst) of the sources with exactly one target by prop."""
    return unambiguous(edges.filter(F.col("prop") == prop).select("src", "dst"), "src", "dst")


def controls_to_containers(edges: DataFrame) -> DataFrame:
    """JOI22: edges (container, component, control): a control belongs where the process it controls does."""
    contained = edges.filter(F.col("prop") == "pathwayComponent").select(F.col("src").alias("container"), F.col("dst").alias("process"))
    controls = edges.filter(F.col("prop") == "controlled").select(F.col("src").alias("control"), F.col("dst").alias("process"))
    return contained.join(controls, "process").select(F.col("container").alias("src"), F.lit("pathwayComponent").alias("prop"), F.col("control").alias("dst")).distinct()


def mapping_from_warehouse(xrefs: DataFrame) -> DataFrame:
    """JOI23: mapping rows of warehouse references (primary_db, primary, type, relation, db, id): all unification references, and
    relationship references that are an identity or secondary accession."""
    ok = (F.col("type") == "UnificationXref") | ((F.col("type") == "RelationshipXref") & F.col("relation").isin("identity", "secondary-ac"))
    return normalized_mapping(xrefs.filter(ok).select(F.col("db").alias("src_db"), F.col("id").alias("src_id"), F.col("primary_db").alias("dst_db"), F.col("primary").alias("dst_id")))


def ubiquitous(edges: DataFrame, least: int) -> DataFrame:
    """AGG9: (uri, degree) of the nodes that at least so many edges point to: the blacklist of graph queries."""
    return edges.groupBy(F.col("dst").alias("uri")).agg(F.count(F.lit(1)).alias("degree")).filter(F.col("degree") >= least)


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """SNK15: an upsert's outcome: of each key the row of the highest version."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def pages(hits: Column, size: Column) -> Column:
    """AGG6: the number of pages."""
    return F.when(hits > 0, F.floor((hits - 1) / size) + 1).otherwise(0).cast("bigint")


def sorted_join(c: Column | str, sep: str = ";") -> Column:
    """AGG4, SRT4: distinct values of a group, sorted, joined."""
    return F.concat_ws(sep, F.sort_array(F.collect_set(c)))


def shortest_name(name: Column) -> Column:
    """SRT5: of a group's names the shortest, the first of equally long ones; truncated names ("...") only if there are no others."""
    cut = name.rlike(r"\.\.\.$")
    return F.min_by(name, F.struct(cut.cast("int"), F.length(name), name))


def normalize_generics(edges: DataFrame) -> DataFrame:
    """GRA11: edges with an entity reference for every generic (an entity with memberPhysicalEntity) that lacks one: it has its members'
    references as members and is named by the generic's md5."""
    members = edges.filter("prop = 'memberPhysicalEntity'").select(F.col("src").alias("generic"), F.col("dst").alias("pe"))
    refs = edges.filter("prop = 'entityReference'").select(F.col("src").alias("pe"), F.col("dst").alias("er"))
    bare = members.join(refs.select(F.col("pe").alias("generic")), "generic", "left_anti")
    found = bare.join(refs, "pe").select("generic", F.concat(F.lit("EntityReference_"), F.md5("generic")).alias("new"), "er").distinct()
    own = found.select(F.col("generic").alias("src"), F.lit("entityReference").alias("prop"), F.col("new").alias("dst")).distinct()
    below = found.select(F.col("new").alias("src"), F.lit("memberEntityReference").alias("prop"), F.col("er").alias("dst"))
    return edges.select("src", "prop", "dst").unionByName(own).unionByName(below)


def organism_labels(elements: DataFrame, xrefs: DataFrame, names: DataFrame) -> DataFrame:
    """HLP3: (uri, label): an organism's references (uri, db, id), else its names (uri, name), sorted and joined; null without either."""
    x = xrefs.groupBy("uri").agg(sorted_join(F.concat_ws(":", "db", "id")).alias("x"))
    n = names.groupBy("uri").agg(sorted_join("name").alias("n"))
    return elements.select("uri").join(x, "uri", "left").join(n, "uri", "left").select("uri", F.coalesce("x", "n").alias("label"))


def source_summary(elements: DataFrame, classes: dict[str, str]) -> DataFrame:
    """AGG3: (datasource, num_pathways, num_interactions, num_physical_entities)."""
    from pathweave.model import subtypes

    kinds = {"num_pathways": subtypes("Pathway", classes), "num_interactions": subtypes("Interaction", classes), "num_physical_entities": subtypes("PhysicalEntity", classes) + (["Gene"] if "Gene" in classes else [])}
    return elements.groupBy("datasource").agg(*(F.count_if(F.col("type").isin(v)).alias(k) for k, v in kinds.items()))
