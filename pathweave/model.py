"""The typed graph: three tables (elements, edges, literals), the class hierarchy and the properties' inverses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, STRINGS = T.StringType(), T.ArrayType(T.StringType())

ELEMENT = _schema(uri=S, type=S, datasource=S)
EDGE = _schema(src=S, prop=S, dst=S)
LITERAL = _schema(uri=S, prop=S, value=S)
MAPPING = _schema(doc_id=S, src_db=S, src_id=S, dst_db=S, dst_id=S)
SEARCH_DOC = _schema(
    uri=S, type=S, names=STRINGS, xref_ids=STRINGS, keywords=STRINGS, pathways=STRINGS, pathway_uris=STRINGS, organisms=STRINGS,
    organism_uris=STRINGS, datasources=STRINGS, datasource_uris=STRINGS, num_participants=T.IntegerType(), num_processes=T.IntegerType(),
)
POSTING = _schema(field=S, term=S, uri=S, tf=T.IntegerType(), pos=T.ArrayType(T.IntegerType()), doc_len=T.IntegerType())
HIT = _schema(uri=S, biopax_class=S, name=S, organism=STRINGS, datasource=STRINGS, pathway=STRINGS, size=T.IntegerType(), num_processes=T.IntegerType(), score=T.DoubleType())
VIOLATION = _schema(rule=S, uri=S, severity=S, fixed=T.BooleanType())

# The classes of the BioPAX Level 3 standard, each with the class it specialises.
PARENTS = {
    "Entity": "", "UtilityClass": "",
    "Gene": "Entity", "Pathway": "Process", "Process": "Entity", "Interaction": "Process", "PhysicalEntity": "Entity",
    "Control": "Interaction", "Catalysis": "Control", "Modulation": "Control", "TemplateReactionRegulation": "Control",
    "Conversion": "Interaction", "BiochemicalReaction": "Conversion", "ComplexAssembly": "Conversion", "Degradation": "Conversion",
    "Transport": "Conversion", "TransportWithBiochemicalReaction": "Transport", "GeneticInteraction": "Interaction",
    "MolecularInteraction": "Interaction", "TemplateReaction": "Interaction",
    "SimplePhysicalEntity": "PhysicalEntity", "Complex": "PhysicalEntity", "Dna": "SimplePhysicalEntity", "DnaRegion": "SimplePhysicalEntity",
    "Rna": "SimplePhysicalEntity", "RnaRegion": "SimplePhysicalEntity", "Protein": "SimplePhysicalEntity", "SmallMolecule": "SimplePhysicalEntity",
    "EntityReference": "UtilityClass", "SequenceEntityReference": "EntityReference", "ProteinReference": "SequenceEntityReference",
    "DnaReference": "SequenceEntityReference", "DnaRegionReference": "SequenceEntityReference", "RnaReference": "SequenceEntityReference",
    "RnaRegionReference": "SequenceEntityReference", "SmallMoleculeReference": "EntityReference",
    "Xref": "UtilityClass", "UnificationXref": "Xref", "RelationshipXref": "Xref", "PublicationXref": "Xref",
    "ControlledVocabulary": "UtilityClass", "BioSource": "UtilityClass", "Provenance": "UtilityClass", "Evidence": "UtilityClass",
    "EntityFeature": "UtilityClass", "ModificationFeature": "EntityFeature", "BindingFeature": "EntityFeature", "FragmentFeature": "EntityFeature",
    "CovalentBindingFeature": "BindingFeature", "PathwayStep": "UtilityClass", "BiochemicalPathwayStep": "PathwayStep",
    "Stoichiometry": "UtilityClass", "ChemicalStructure": "UtilityClass", "SequenceLocation": "UtilityClass", "SequenceSite": "SequenceLocation",
    "SequenceInterval": "SequenceLocation", "Score": "UtilityClass", "ExperimentalForm": "UtilityClass", "DeltaG": "UtilityClass", "KPrime": "UtilityClass",
    "CellularLocationVocabulary": "ControlledVocabulary", "CellVocabulary": "ControlledVocabulary", "EntityReferenceTypeVocabulary": "ControlledVocabulary",
    "EvidenceCodeVocabulary": "ControlledVocabulary", "ExperimentalFormVocabulary": "ControlledVocabulary", "InteractionVocabulary": "ControlledVocabulary",
    "PhenotypeVocabulary": "ControlledVocabulary", "RelationshipTypeVocabulary": "ControlledVocabulary", "SequenceModificationVocabulary": "ControlledVocabulary",
    "SequenceRegionVocabulary": "ControlledVocabulary", "TissueVocabulary": "ControlledVocabulary",
}
# Object properties of the standard and the names of their inverses.
INVERSES = {
    "xref": "xrefOf", "entityReference": "entityReferenceOf", "memberEntityReference": "memberEntityReferenceOf",
    "memberPhysicalEntity": "memberPhysicalEntityOf", "pathwayComponent": "pathwayComponentOf", "controlled": "controlledOf",
    "controller": "controllerOf", "stepProcess": "stepProcessOf", "pathwayOrder": "pathwayOrderOf", "feature": "featureOf",
    "notFeature": "notFeatureOf", "entityFeature": "entityFeatureOf", "component": "componentOf", "participant": "participantOf",
    "nextStep": "nextStepOf", "member": "memberOf", "bindsTo": "bindsToOf",
}
#: Sub-properties that a reader of the super-property also sees.
SPECIAL = {"participant": ("left", "right", "controller", "controlled", "template", "product", "cofactor")}


def closure(parents: dict[str, str] = PARENTS) -> dict[str, list[str]]:
    """Each class with itself and all its subclasses, sorted."""
    out: dict[str, set[str]] = {c: {c} for c in parents}
    for c in parents:
        up = parents[c]
        while up:
            out.setdefault(up, {up}).add(c)
            up = parents.get(up, "")
    return {k: sorted(v) for k, v in out.items()}


def type_closure(spark: SparkSession, parents: dict[str, str] = PARENTS) -> DataFrame:
    """(super, sub), reflexive: some hundred rows, fixed by the standard."""
    return spark.createDataFrame([(k, s) for k, v in closure(parents).items() for s in v], "super string, sub string")


def subtypes(name: str, parents: dict[str, str] = PARENTS) -> list[str]:
    """The class and its subclasses; the name in any case. ValueError if there is no such class."""
    known = {c.lower(): c for c in parents}
    if name.lower() not in known:
        raise ValueError(f"no class {name}")
    return closure(parents)[known[name.lower()]]


@dataclass(frozen=True)
class Model:
    """Elements, edges and literals of one source or of the union, with its classes."""

    elements: DataFrame
    edges: DataFrame
    literals: DataFrame
    parents: tuple[tuple[str, str], ...] = tuple(PARENTS.items())

    @property
    def classes(self) -> dict[str, str]:
        return dict(self.parents)

    def of_type(self, name: str) -> DataFrame:
        """FIL1: elements of a class or its subclasses."""
        return self.elements.filter(F.col("type").isin(subtypes(name, self.classes)))

    def union(self, other: Model) -> Model:
        """SET1: the union by uri. Of an uri's several types or sources the least is kept; properties are united as sets."""
        elements = self.elements.unionByName(other.elements).groupBy("uri").agg(F.min("type").alias("type"), F.min("datasource").alias("datasource"))
        return Model(elements, self.edges.unionByName(other.edges).distinct(), self.literals.unionByName(other.literals).distinct(), self.parents)

    def deduplicated(self) -> Model:
        """SRC2: objects of equal uri within one file merged."""
        empty = Model(self.elements.limit(0), self.edges.limit(0), self.literals.limit(0), self.parents)
        return self.union(empty)
