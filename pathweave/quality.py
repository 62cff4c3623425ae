"""Validation (VAL1-VAL6): rules are filters, violations a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.model import Model
from pathweave.runtime import filled

ERROR, WARNING, IGNORE = "error", "warning", "ignore"


@dataclass(frozen=True)
class Rule:
    """A rule's name, the rows it looks at (uri and what the condition needs), when a row breaks it, and whether a fix is at hand."""

    name: str
    rows: DataFrame
    broken: Column
    severity: str = ERROR
    fixable: bool = False


def check(rules: list[Rule]) -> DataFrame:
    """VAL1: (rule, uri, severity, fixed) of every violation; rules that are ignored report none."""
    out = None
    for r in rules:
        if r.severity == IGNORE:
            continue
        v = r.rows.filter(F.coalesce(r.broken, F.lit(False))).select(F.lit(r.name).alias("rule"), "uri", F.lit(r.severity).alias("severity"), F.lit(r.fixable).alias("fixed"))
        out = v if out is None else out.unionByName(v)
    if out is None:
        raise ValueError("no rule")
    return out


def unfixed_errors(violations: DataFrame) -> DataFrame:
    """AGG7: (n) errors that no fix removed."""
    return violations.agg(F.count_if((F.col("severity") == ERROR) & ~F.col("fixed")).alias("n"))


def model_rules(m: Model) -> list[Rule]:
    """The rules every model is held to: known classes, allowed values, references that lead somewhere, filled ids."""
    known = list(m.classes)
    lit = m.literals
    return [
        Rule("unknown.class", m.elements, ~F.col("type").isin(known)),
        Rule("range.violated", lit.filter("prop = 'controlType'"), ~F.col("value").isin("ACTIVATION", "INHIBITION", "INHIBITION-ALLOSTERIC", "INHIBITION-COMPETITIVE", "INHIBITION-IRREVERSIBLE", "INHIBITION-NONCOMPETITIVE", "INHIBITION-OTHER", "INHIBITION-UNCOMPETITIVE", "INHIBITION-UNKMECH", "ACTIVATION-ALLOSTERIC", "ACTIVATION-NONALLOSTERIC", "ACTIVATION-UNKMECH")),
        Rule("dangling.reference", m.edges.join(m.elements.select(F.col("uri").alias("dst")), "dst", "left_anti").select(F.col("src").alias("uri")), F.lit(True), WARNING),
        Rule("blank.value", lit, filled("value").isNull(), WARNING, True),
    ]


def normalize_databases(literals: DataFrame, synonyms: DataFrame) -> DataFrame:
    """VAL3: literals with db names brought to the registry's prefix; synonyms (name: lower case, prefix) is a fixed list."""
    db = F.col("prop") == "db"
    j = literals.join(F.broadcast(synonyms.select(F.col("name").alias("__n"), "prefix")), db & (F.lower(F.trim("value")) == F.col("__n")), "left")
    return j.select("uri", "prop", F.coalesce("prefix", "value").alias("value"))


def stamp_source(m: Model, uri: str, names: list[str]) -> Model:
    """VAL4: every element's dataSource replaced by one Provenance with these names; older Provenance goes."""
    spark = m.elements.sparkSession
    entities = m.of_type("Entity").select("uri")
    old = m.of_type("Provenance").select("uri")
    elements = m.elements.join(old, "uri", "left_anti").select("uri", "type", "datasource").unionByName(spark.createDataFrame([(uri, "Provenance", uri)], "uri string, type string, datasource string"))
    edges = m.edges.filter("prop <> 'dataSource'").unionByName(entities.select(F.col("uri").alias("src"), F.lit("dataSource").alias("prop"), F.lit(uri).alias("dst")))
    literals = m.literals.join(old, "uri", "left_anti").select("uri", "prop", "value").unionByName(spark.createDataFrame([(uri, "name", n) for n in names], "uri string, prop string, value string"))
    return Model(elements, edges, literals, m.parents)


def name_organisms(m: Model, names: dict[str, str]) -> Model:
    """VAL6: BioSources of these taxa get the configured name."""
    spark = m.elements.sparkSession
    taxa = spark.createDataFrame(list(names.items()), "taxon string, name string")
    sources = m.of_type("BioSource").select("uri")
    ids = m.edges.filter("prop = 'xref'").join(sources.withColumnRenamed("uri", "src"), "src", "left_semi").select("src", "dst").join(m.literals.filter("prop = 'id'").select(F.col("uri").alias("dst"), F.col("value").alias("taxon")), "dst")
    added = ids.join(F.broadcast(taxa), "taxon").select(F.col("src").alias("uri"), F.lit("displayName").alias("prop"), F.col("name").alias("value"))
    kept = m.literals.join(added.select("uri", "prop"), ["uri", "prop"], "left_anti").select("uri", "prop", "value")
    return Model(m.elements, m.edges, kept.unionByName(added.distinct()), m.parents)
