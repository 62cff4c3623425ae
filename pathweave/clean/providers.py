"""Cleaners (CLN1-CLN11): one function from model to model for each provider, as joins and column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.functions.ids import rebase_uri, relationship_xref_uri
from pathweave.functions.text import strip_name_markup
from pathweave.model import Model, subtypes
from pathweave.operators.entities import controls_to_containers, remove_dangling, replaced, shortest_name, single_members

# Database names as providers write them and as they are registered.
DRUGBANK_NAMES = {"genbank gene database": "genbank", "genbank protein database": "genbank", "therapeutic targets database": "ttd.drug", "hugo gene nomenclature committee (hgnc)": "hgnc", "drugs product database (dpd)": "cdpd"}
HUMANCYC_NAMES = {"entrez": "NCBI Gene", "entrez-gene": "NCBI Gene", "ecocyc": "BioCyc", "humancyc": "BioCyc", "cas-number": "CAS"}


def _set(m: Model, **parts: DataFrame) -> Model:
    return Model(parts.get("elements", m.elements), parts.get("edges", m.edges), parts.get("literals", m.literals), m.parents)


def _values(m: Model, prop: str, new: Callable[[Column], Column], uris: DataFrame | None = None) -> Model:
    """The model with the values of a literal property changed, those of some elements only where uris is given."""
    lit = m.literals
    mine = F.col("prop") == prop
    if uris is not None:
        lit = lit.join(uris.select("uri", F.lit(True).alias("__in")).distinct(), "uri", "left")
        mine = mine & F.coalesce("__in", F.lit(False))
    return _set(m, literals=lit.select("uri", "prop", F.when(mine, new(F.col("value"))).otherwise(F.col("value")).alias("value")))


def _without(m: Model, uris: DataFrame) -> Model:
    """The model without these elements (uri) and all that refers to them."""
    gone = uris.select("uri").distinct()
    edges = m.edges.join(gone.withColumnRenamed("uri", "src"), "src", "left_anti").join(gone.withColumnRenamed("uri", "dst"), "dst", "left_anti").select("src", "prop", "dst")
    return _set(m, elements=m.elements.join(gone, "uri", "left_anti"), edges=edges, literals=m.literals.join(gone, "uri", "left_anti").select("uri", "prop", "value"))


def _renamed(m: Model, old_new: DataFrame) -> Model:
    """The model with elements' uris (old) replaced (new)."""
    r = old_new.select(F.col("old").alias("uri"), "new")
    name = lambda df, cols: df.join(r, "uri", "left").select(F.coalesce("new", "uri").alias("uri"), *cols)
    return _set(m, elements=name(m.elements, ["type", "datasource"]), edges=replaced(m.edges, old_new), literals=name(m.literals, ["prop", "value"]))


def rename_databases(m: Model, names: dict[str, str]) -> Model:
    """References' databases under their registered names."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return _values(m, "db", lambda v: F.coalesce(F.try_element_at(table, F.lower(v)), v))


def _xrefs(m: Model, kind: str = "Xref") -> DataFrame:
    """(owner, xref, db, id) of references of a class."""
    x = m.of_type(kind).select(F.col("uri").alias("xref"))
    value = lambda p: m.literals.filter(F.col("prop") == p).groupBy(F.col("uri").alias("xref")).agg(F.min("value").alias(p))
    own = m.edges.filter("prop = 'xref'").select(F.col("src").alias("owner"), F.col("dst").alias("xref"))
    return own.join(x, "xref").join(value("db"), "xref", "left").join(value("id"), "xref", "left").select("owner", "xref", "db", "id")


def to_relationship(m: Model, links: DataFrame) -> Model:
    """CLN10: these links (owner, xref, db, id) go to a relationship reference of the same database and id, made once."""
    rx = links.select("owner", "xref", "db", "id", relationship_xref_uri("db", "id").alias("rx"))
    new = rx.select("rx", "db", "id").distinct()
    elements = m.elements.unionByName(new.select(F.col("rx").alias("uri"), F.lit("RelationshipXref").alias("type"), F.lit(None).cast("string").alias("datasource")).join(m.elements.select("uri"), "uri", "left_anti"))
    old = rx.select(F.col("owner").alias("src"), F.lit("xref").alias("prop"), F.col("xref").alias("dst"))
    edges = m.edges.join(old, ["src", "prop", "dst"], "left_anti").unionByName(rx.select(F.col("owner").alias("src"), F.lit("xref").alias("prop"), F.col("rx").alias("dst")))
    values = new.select(F.col("rx").alias("uri"), F.inline(F.array(F.struct(F.lit("db").alias("prop"), F.col("db").alias("value")), F.struct(F.lit("id").alias("prop"), F.col("id").alias("value")))))
    return _set(m, elements=elements, edges=edges.select("src", "prop", "dst").distinct(), literals=m.literals.unionByName(values).distinct())


def shared_to_relationship(m: Model, links: DataFrame) -> Model:
    """Unification references of several owners become relationship references of all but the least owner."""
    first = links.groupBy("xref").agg(F.min("owner").alias("first"))
    return to_relationship(m, links.join(first, "xref").filter("owner <> first"))


def reactome(m: Model) -> Model:
    """CLN1: processes named by their stable id; shared references made relationships; conversions go left to right unless they say
    otherwise; unstable references go where a stable one is."""
    ux = _xrefs(m, "UnificationXref").filter(F.lower("db") == "reactome")
    proc = m.of_type("Process").select(F.col("uri").alias("owner")).filter(~F.col("owner").contains("bioregistry.io/reactome") & ~F.col("owner").contains("identifiers.org/reactome"))
    named = ux.join(proc, "owner").withColumn("new", F.concat(F.lit("http://bioregistry.io/reactome:"), F.regexp_replace("id", "^REACTOME:", "")))
    taken = m.elements.select(F.col("uri").alias("new"))
    chosen = named.join(taken, "new", "left_anti").groupBy("new").agg(F.min("owner").alias("old"))
    m = to_relationship(m, named.join(chosen.select(F.col("old").alias("owner")), "owner", "left_anti").select("owner", "xref", "db", "id"))
    m = _renamed(m, chosen.select("old", "new"))
    undirected = m.of_type("Conversion").select("uri").join(m.literals.filter("prop = 'conversionDirection'").select("uri"), "uri", "left_anti")
    m = _set(m, literals=m.literals.unionByName(undirected.select("uri", F.lit("conversionDirection").alias("prop"), F.lit("LEFT_TO_RIGHT").alias("value"))))
    x = _xrefs(m)
    stable = x.filter(F.lower("db") == "reactome").select("owner").distinct()
    unstable = x.filter(F.lower("db").startswith("reactome database")).join(stable, "owner", "left_semi")
    drop = unstable.select(F.col("owner").alias("src"), F.lit("xref").alias("prop"), F.col("xref").alias("dst"))
    m = _set(m, edges=m.edges.join(drop, ["src", "prop", "dst"], "left_anti").select("src", "prop", "dst"))
    return remove_dangling(m, subtypes("UtilityClass"))


def humancyc(m: Model) -> Model:
    """CLN2: no unification references of physical entities; ids trimmed and without a one-letter prefix, PDB ids upper-cased; databases
    renamed; markup out of names; of a reference's several UniProt accessions the first stays; pathways are human."""
    pe = m.of_type("PhysicalEntity").select(F.col("uri").alias("src"))
    ux = m.of_type("UnificationXref").select(F.col("uri").alias("dst"))
    drop = m.edges.filter("prop = 'xref'").join(pe, "src", "left_semi").join(ux, "dst", "left_semi")
    m = _set(m, edges=m.edges.join(drop, ["src", "prop", "dst"], "left_anti").select("src", "prop", "dst"))
    m = _values(m, "id", lambda v: F.regexp_replace(F.trim(v), r"^[A-Z]: ", ""))
    pdb = m.literals.filter((F.col("prop") == "db") & (F.lower("value") == "pdb")).select("uri")
    m = rename_databases(_values(m, "id", F.upper, pdb), HUMANCYC_NAMES)
    for p in ("name", "displayName", "standardName"):
        m = _values(m, p, strip_name_markup)
    er = m.of_type("ProteinReference").select(F.col("uri").alias("owner"))
    up = _xrefs(m, "UnificationXref").filter(F.lower("db").startswith("uniprot")).join(er, "owner", "left_semi")
    keep = up.groupBy("owner").agg(F.min("id").alias("kept"))
    extra = up.join(keep, "owner").filter("id <> kept").select(F.col("owner").alias("src"), F.lit("xref").alias("prop"), F.col("xref").alias("dst"))
    m = _set(m, edges=m.edges.join(extra, ["src", "prop", "dst"], "left_anti").select("src", "prop", "dst"))
    return human_pathways(m)


def human_pathways(m: Model, uri: str = "http://bioregistry.io/ncbitaxon:9606") -> Model:
    """Pathways without organism get the human one, which is made if it isn't there."""
    spark = m.elements.sparkSession
    p = m.of_type("Pathway").select(F.col("uri").alias("src")).join(m.edges.filter("prop = 'organism'").select("src"), "src", "left_anti")
    one = spark.createDataFrame([(uri, "BioSource", None)], "uri string, type string, datasource string")
    name = spark.createDataFrame([(uri, "name", "Homo sapiens")], "uri string, prop string, value string")
    return _set(m, elements=m.elements.unionByName(one.join(m.elements.select("uri"), "uri", "left_anti")), edges=m.edges.unionByName(p.select("src", F.lit("organism").alias("prop"), F.lit(uri).alias("dst"))), literals=m.literals.unionByName(name).distinct())


def kegg(m: Model) -> Model:
    """CLN3: pathways named by their registered id; of truncated names the shortest whole one is shown; references that an entity shares
    with its entity reference stay at the latter only."""
    ux = _xrefs(m, "UnificationXref").filter(F.lower("db").startswith("kegg")).join(m.of_type("Pathway").select(F.col("uri").alias("owner")), "owner", "left_semi")
    new = ux.select(F.col("owner").alias("old"), F.concat(F.lit("http://bioregistry.io/kegg.pathway:"), "id").alias("new")).groupBy("new").agg(F.min("old").alias("old")).select("old", "new")
    m = _renamed(m, new)
    whole = m.literals.filter(F.col("prop").isin("name", "displayName", "standardName")).groupBy("uri").agg(shortest_name(F.col("value")).alias("short"))
    cut = m.literals.filter((F.col("prop") == "displayName") & F.col("value").endswith("...")).select("uri")
    shown = whole.join(cut, "uri", "left_semi").select("uri", F.lit("displayName").alias("prop"), F.col("short").alias("value"))
    kept = m.literals.join(shown.select("uri", "prop"), ["uri", "prop"], "left_anti").select("uri", "prop", "value")
    m = _set(m, literals=kept.unionByName(shown))
    own = m.edges.filter("prop = 'xref'").select("src", "dst")
    er = m.edges.filter("prop = 'entityReference'").select("src", F.col("dst").alias("er"))
    shared = own.join(er, "src").join(own.select(F.col("src").alias("er"), "dst"), ["er", "dst"], "left_semi").select("src", F.lit("xref").alias("prop"), "dst")
    return _set(m, edges=m.edges.join(shared, ["src", "prop", "dst"], "left_anti").select("src", "prop", "dst"))


def netpath(m: Model) -> Model:
    """CLN4: ``phospho-`` terms say which form; vocabularies' relationship references become unifications, shared ones the reverse."""
    m = _values(m, "term", lambda v: F.regexp_replace(v, "^phospho-(?!L-)", "phospho-L-"))
    cv = m.of_type("ControlledVocabulary").select(F.col("uri").alias("owner"))
    rx = _xrefs(m, "RelationshipXref").join(cv, "owner", "left_semi").select(F.col("xref").alias("uri")).distinct().withColumn("u", F.lit(True))
    elements = m.elements.join(rx, "uri", "left").select("uri", F.when(F.col("u"), "UnificationXref").otherwise(F.col("type")).alias("type"), "datasource")
    m = _set(m, elements=elements)
    return remove_dangling(shared_to_relationship(m, _xrefs(m, "UnificationXref")), subtypes("UtilityClass"))


def panther(m: Model) -> Model:
    """CLN5: what is human only; no PANTHER references; generics of one member replaced by it; controls put in their pathways."""
    bio = m.of_type("BioSource").select("uri")
    human = m.edges.filter("prop = 'xref'").join(m.literals.filter("prop = 'id' and value = '9606'").select(F.col("uri").alias("dst")), "dst", "left_semi").select(F.col("src").alias("uri"))
    others = bio.join(human, "uri", "left_anti").filter(~F.col("uri").rlike("[:/]9606$"))
    foreign = m.edges.filter("prop = 'organism'").join(others.withColumnRenamed("uri", "dst"), "dst", "left_semi").select(F.col("src").alias("uri")).join(m.of_type("SequenceEntityReference").select("uri"), "uri", "left_semi")
    own = m.literals.filter((F.col("prop") == "db") & F.lower("value").startswith("panther pathway")).select("uri")
    m = human_pathways(_without(m, others.unionByName(foreign).unionByName(own)))
    single = single_members(m.edges, "memberEntityReference").select(F.col("src").alias("old"), F.col("dst").alias("new"))
    links = m.edges.filter("prop = 'entityReference'")
    m = _set(m, edges=m.edges.filter("prop <> 'entityReference'").unionByName(replaced(links, single)))
    m = _set(m, edges=m.edges.unionByName(controls_to_containers(m.edges)).distinct())
    return remove_dangling(m, subtypes("UtilityClass"))


def pathbank(m: Model) -> Model:
    """CLN6: other species' files are refused (an empty model); pathways under their registered uri; no sub-pathway stubs and bare
    interactions; steps without successor dissolved into components."""
    bio = m.of_type("BioSource")
    human = bio.filter(F.lower("uri").contains("taxonomy_9606"))
    if not bio.isEmpty() and human.isEmpty():
        return _set(m, elements=m.elements.limit(0), edges=m.edges.limit(0), literals=m.literals.limit(0))
    old_new = m.elements.select(F.col("uri").alias("old"), rebase_uri("uri", "http://bioregistry.io/pathbank:", "http://identifiers.org/smpdb/").alias("new")).filter("old <> new")
    m = _renamed(m, old_new)
    stubs = m.literals.filter((F.col("prop").isin("name", "displayName", "standardName")) & (F.col("value") == "SubPathway")).select("uri").join(m.of_type("Pathway").select("uri"), "uri", "left_semi")
    m = _without(m, stubs.unionByName(m.elements.filter("type = 'Interaction'").select("uri")))
    nxt = m.edges.filter("prop = 'nextStep'")
    linked = nxt.select(F.col("src").alias("uri")).unionByName(nxt.select(F.col("dst").alias("uri")))
    steps = m.of_type("PathwayStep").select("uri").join(linked, "uri", "left_anti")
    order = m.edges.filter("prop = 'pathwayOrder'").select(F.col("src").alias("pathway"), F.col("dst").alias("uri")).join(steps, "uri", "left_semi")
    inner = m.edges.filter(F.col("prop").isin("stepProcess", "stepConversion")).select(F.col("src").alias("uri"), F.col("dst").alias("process")).join(m.of_type("Interaction").select(F.col("uri").alias("process")), "process", "left_semi")
    added = order.join(inner, "uri").select(F.col("pathway").alias("src"), F.lit("pathwayComponent").alias("prop"), F.col("process").alias("dst"))
    m = _without(_set(m, edges=m.edges.unionByName(added).distinct()), steps)
    m = _set(m, literals=m.literals.filter(~(F.col("prop").isin("name", "displayName", "standardName") & F.lower("value").startswith("subpathway"))))
    return remove_dangling(m, subtypes("UtilityClass"))


def inoh(m: Model) -> Model:
    """CLN7: UniProt publication references are relationships; entities' references move to their entity reference; terms lose their id
    prefix; template reactions without template go."""
    pub = m.literals.filter((F.col("prop") == "db") & F.lower("value").startswith("uniprot")).select("uri").join(m.of_type("PublicationXref").select("uri"), "uri", "left_semi").withColumn("u", F.lit(True))
    m = _set(m, elements=m.elements.join(pub, "uri", "left").select("uri", F.when(F.col("u"), "RelationshipXref").otherwise(F.col("type")).alias("type"), "datasource"))
    er = m.edges.filter("prop = 'entityReference'").select("src", F.col("dst").alias("er"))
    up = m.literals.filter((F.col("prop") == "db") & F.lower("value").startswith("uniprot")).select(F.col("uri").alias("dst"))
    moved = m.edges.filter("prop = 'xref'").join(up, "dst", "left_semi").join(er, "src").select("src", "dst", "er")
    kept = m.edges.join(moved.select("src", F.lit("xref").alias("prop"), "dst"), ["src", "prop", "dst"], "left_anti").select("src", "prop", "dst")
    m = _set(m, edges=kept.unionByName(moved.select(F.col("er").alias("src"), F.lit("xref").alias("prop"), "dst")).distinct())
    m = _values(m, "term", lambda v: F.regexp_replace(v, r"^[A-Z]+:\S+\s+", ""))
    bare = m.of_type("TemplateReaction").select("uri").join(m.edges.filter("prop = 'template'").select(F.col("src").alias("uri")), "uri", "left_anti")
    return remove_dangling(_without(m, bare), subtypes("UtilityClass"))


def drugbank(m: Model) -> Model:
    """CLN8: databases renamed."""
    return rename_databases(m, DRUGBANK_NAMES)


def hprd_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """CLN9: PSI-MI lines of which secondary UniProt references are identities, and a known id with a trailing blank is mended."""
    line = F.regexp_replace(F.col(column), r'^(\s*)<secondaryRef db="uniprot" dbAc="([^"]*)" id="([^"]*)"\s*/>\s*$', r'$1<secondaryRef db="uniprot" dbAc="$2" id="$3" refType="identity"/>')
    return lines.withColumn(column, F.replace(line, F.lit('"07467 "'), F.lit('"074670"')))


def repair_uris(m: Model) -> Model:
    """CLN11: no dangling utility elements; a misspelt registry prefix and blanks in uris mended."""
    old_new = m.elements.select(F.col("uri").alias("old"), F.regexp_replace(F.replace("uri", F.lit("intact_complex"), F.lit("intact.complex")), r"\s+", "_").alias("new")).filter("old <> new")
    return remove_dangling(_renamed(m, old_new), subtypes("UtilityClass"))


CLEANERS: dict[str, Callable[[Model], Model]] = {"reactome": reactome, "humancyc": humancyc, "kegg": kegg, "netpath": netpath, "panther": panther, "pathbank": pathbank, "inoh": inoh, "drugbank": drugbank, "repair_uris": repair_uris}
