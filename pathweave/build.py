"""The build in stages, each on stored tables: merge providers with the warehouse, index, export, modify; and a command for each.

    python -m pathweave.build merge OUT WAREHOUSE PROVIDER[:CLEANER]...     index OUT     export OUT FOLDER     analyze OUT NAME     modify OUT NAME
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.clean.providers import CLEANERS
from pathweave.model import Model, subtypes
from pathweave.operators import entities as E
from pathweave.operators import interactions, search
from pathweave.runtime import Scratch
from pathweave.service import ANALYSES
from pathweave.sinks import flat


def _ids(m: Model, kinds: tuple[str, ...]) -> DataFrame:
    """(uri, type, id) of entity references' own references of these classes."""
    x = m.elements.filter(F.col("type").isin(*kinds)).select(F.col("uri").alias("x"), F.col("type"))
    owned = m.edges.filter("prop = 'xref'").select("src", F.col("dst").alias("x")).join(x, "x")
    refs = m.of_type("EntityReference").select(F.col("uri").alias("src"))
    return owned.join(refs, "src", "left_semi").join(m.literals.filter("prop = 'id'").select(F.col("uri").alias("x"), F.col("value").alias("id")), "x").select(F.col("src").alias("uri"), "type", "id")


def stored(m: Model, scratch: Scratch) -> Model:
    """The model written and read back: what follows reads tables, not the whole plan again."""
    return Model(*(scratch.write(df)[0] for df in (m.elements, m.edges, m.literals)), m.parents)


def reset(m: Model, datasource: str) -> Model:
    """HLP4: the model without a provider's elements and what they own, before it is read again."""
    gone = m.elements.filter(F.col("datasource") == datasource).select("uri")
    without = lambda df, c: df.join(gone.withColumnRenamed("uri", c), c, "left_anti").select(*df.columns)
    return Model(without(m.elements, "uri"), without(m.edges, "src"), without(m.literals, "uri"), m.parents)


def attach_xrefs(m: Model, found: DataFrame, db: str) -> Model:
    """HLP2: found (uri, id) attached as relationship references to genes, physical entities and entity references; other classes are left."""
    ok = m.elements.filter(F.col("type").isin([t for k in ("Gene", "PhysicalEntity", "EntityReference") for t in subtypes(k, m.classes)])).select("uri")
    rows = found.join(ok, "uri", "left_semi").select("uri", "id", F.concat(F.lit("RelationshipXref_"), F.md5(F.concat_ws("|", F.lit(db.lower()), "id"))).alias("x"))
    elements = rows.select(F.col("x").alias("uri"), F.lit("RelationshipXref").alias("type"), F.lit(None).cast("string").alias("datasource")).distinct()
    literals = rows.select(F.col("x").alias("uri"), F.lit("db").alias("prop"), F.lit(db.lower()).alias("value")).unionByName(rows.select(F.col("x").alias("uri"), F.lit("id").alias("prop"), F.col("id").alias("value")))
    edges = rows.select(F.col("uri").alias("src"), F.lit("xref").alias("prop"), F.col("x").alias("dst"))
    return m.union(Model(elements, edges, literals.distinct(), m.parents))


def merge(warehouse: Model, mapping: DataFrame, providers: list[Model]) -> Model:
    """SET1-SET3, JOI1-JOI5, JOI17: providers united with the warehouse references they stand for; their own references of these go.

    Warehouse references that nothing refers to are left out, with what only they own.
    """
    main = providers[0]
    for p in providers[1:]:
        main = main.union(p)
    scratch = Scratch(main.elements.sparkSession, "merge")
    main, warehouse = stored(main, scratch), stored(warehouse, scratch)
    kinds = ("UnificationXref", "RelationshipXref")
    refs = main.of_type("EntityReference").select("uri")
    stock, _ = scratch.write(warehouse.of_type("EntityReference").select("uri").join(_ids(warehouse, ("UnificationXref",)), "uri").groupBy("uri").agg(F.min("id").alias("primary")))
    known = E.canonical(refs, stock, mapping, _ids(main, kinds))
    swap, _ = scratch.write(known.join(stock.withColumnRenamed("uri", "new"), "primary").select(F.col("uri").alias("old"), "new").filter("old <> new"))
    gone = swap.select(F.col("old").alias("uri"))
    without = lambda df, c: df.join(gone.withColumnRenamed("uri", c), c, "left_anti").select(*df.columns)
    edges = E.replaced(without(main.edges, "src"), swap)
    merged = stored(Model(without(main.elements, "uri"), edges, without(main.literals, "uri"), main.parents).union(warehouse), scratch)
    return E.remove_dangling(merged, [*subtypes("EntityReference"), *subtypes("Xref"), "BioSource", "ChemicalStructure"])


def export(m: Model, docs: DataFrame, refs: DataFrame, folder: str) -> None:
    """SNK2, SNK10-SNK13, SNK19, SNK20: the standard files of a model: each source's sub-model, pairs, gene sets, hubs, accessions."""
    flat.write_document(flat.owl_lines(m), f"{folder}/all.owl", flat.owl_header(""), flat.OWL_FOOTER)
    flat.write_lines(flat.sif_lines(interactions.infer(interactions.roles_of(m, refs))), f"{folder}/pairs.sif")
    flat.write_lines(flat.gmt_lines(flat.gmt_members(m, refs, "hgnc.symbol")), f"{folder}/sets.gmt")
    flat.write_lines(flat.blacklist_lines(E.ubiquitous(m.edges, 100)), f"{folder}/blacklist.txt")
    flat.write_lines(flat.response_lines(search.hits_of(search.top_pathways(docs, m.classes, m.edges), m.elements, m.literals)), f"{folder}/top_pathways.json")


def select(m: Model, types: list[str] | None = None, datasources: list[str] | None = None) -> DataFrame:
    """SNK2: (uri) of the elements of any of the classes and any of the sources; all where a list is empty."""
    e = m.elements
    if types:
        e = e.filter(F.col("type").isin([t for k in types for t in subtypes(k, m.classes)]))
    if datasources:
        e = e.filter(F.lower("datasource").isin([d.lower() for d in datasources]))
    return e.select("uri")


def index(spark: SparkSession, folder: str) -> search.Index:
    """IDX6: the stored model's documents indexed anew."""
    return search.Index.of(search.search_documents(flat.read_model(spark, f"{folder}/model"))).write(f"{folder}/index")


def modify(spark: SparkSession, folder: str, name: str, *arguments: object) -> search.Index:
    """UDF2: a registered analysis gives a model that replaces the stored one, which is then indexed anew."""
    new = ANALYSES[name](flat.read_model(spark, f"{folder}/model"), *arguments)
    if not isinstance(new, Model):
        raise TypeError(f"{name} gives no model")
    flat.write_model(new, f"{folder}/model.new")
    flat.write_model(flat.read_model(spark, f"{folder}/model.new"), f"{folder}/model")
    return index(spark, folder)


def cleaned(m: Model, name: str | None) -> Model:
    """UDF3: a model after the cleaner of this name; as it is without one. KeyError if there is no such cleaner."""
    return CLEANERS[name](m) if name else m


def main(argv: list[str]) -> None:
    spark = SparkSession.builder.appName("pathweave").getOrCreate()
    command, folder, *rest = argv

    def _merge() -> None:
        stock = flat.read_model(spark, rest[0])
        mapping = spark.read.parquet(f"{rest[0]}/mapping")
        providers = [cleaned(flat.read_model(spark, p), c or None) for p, _, c in (r.partition(":") for r in rest[1:])]
        flat.write_model(merge(stock, mapping, providers), f"{folder}/model")

    def _export() -> None:
        m = flat.read_model(spark, f"{folder}/model")
        export(m, search.open_index(spark, f"{folder}/index").documents, spark.read.parquet(f"{folder}/refs"), rest[0])

    commands: dict[str, Callable[[], object]] = {
        "merge": _merge, "index": lambda: index(spark, folder), "export": _export, "modify": lambda: modify(spark, folder, *rest),
        "analyze": lambda: ANALYSES[rest[0]](flat.read_model(spark, f"{folder}/model"), *rest[1:]).show(truncate=False),
    }
    commands[command]()


if __name__ == "__main__":
    main(sys.argv[1:])
