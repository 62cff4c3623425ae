"""Binary interactions inferred from typed roles (SIF1-SIF14), and their flat forms.

The input has one row for each role an element plays: roles (reaction, kind, role, ref, molecule, state, location, phospho). kind is
conversion, template, molecular or complex; role is left, right, controller, product, participant or component; ref is the identifier
that stands for the element; molecule tells chemicals from proteins. What a reaction changes shows in a ref on both of its sides.
Pairs are the result of these relations; ubiquitous refs are taken out before any join, so hubs don't multiply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.runtime import Scratch

#: Refs of a class that are paired with those of another at once.
BLOCK = 256


def _role(roles: DataFrame, role: str, molecule: bool | None, side: str) -> DataFrame:
    r = roles.filter(F.col("role") == role)
    if molecule is not None:
        r = r.filter(F.col("molecule") == molecule)
    return r.select("reaction", *(F.col(c).alias(f"{side}_{c}") for c in ("ref", "state", "location", "phospho"))).distinct()


def _pairs(df: DataFrame, a: str, relation: str, b: str, ordered: bool = False) -> DataFrame:
    apart = F.col(a) < F.col(b) if ordered else F.col(a) != F.col(b)
    return df.filter(apart).select(F.col(a).alias("a"), F.lit(relation).alias("relation"), F.col(b).alias("b")).distinct()


def _changed(roles: DataFrame, molecule: bool, what: str) -> DataFrame:
    """(reaction, b_ref): refs on both sides of a reaction that differ in what."""
    left, right = _role(roles, "left", molecule, "b"), _role(roles, "right", molecule, "r")
    j = left.join(right, (left["reaction"] == right["reaction"]) & (F.col("b_ref") == F.col("r_ref")) & (F.col(f"b_{what}") != F.col(f"r_{what}")))
    return j.select(left["reaction"], "b_ref").distinct()


def _same(roles: DataFrame, roles_in: tuple[str, ...], relation: str, molecule: bool | None) -> DataFrame:
    r = roles.filter(F.col("role").isin(*roles_in))
    if molecule is not None:
        r = r.filter(F.col("molecule") == molecule)
    r = r.select("reaction", "ref").distinct()
    x, y = r.select("reaction", F.col("ref").alias("x")), r.select("reaction", F.col("ref").alias("y"))
    return _pairs(x.join(y, "reaction").filter("x < y"), "x", relation, "y", ordered=True)


def controls_state_change_of(r: DataFrame) -> DataFrame:
    """SIF1."""
    return _pairs(_role(r, "controller", False, "a").join(_changed(r, False, "state"), "reaction"), "a_ref", "controls-state-change-of", "b_ref")


def controls_transport_of(r: DataFrame) -> DataFrame:
    """SIF2."""
    return _pairs(_role(r, "controller", False, "a").join(_changed(r, False, "location"), "reaction"), "a_ref", "controls-transport-of", "b_ref")


def controls_phosphorylation_of(r: DataFrame) -> DataFrame:
    """SIF3."""
    return _pairs(_role(r, "controller", False, "a").join(_changed(r, False, "phospho"), "reaction"), "a_ref", "controls-phosphorylation-of", "b_ref")


def controls_expression_of(r: DataFrame) -> DataFrame:
    """SIF4."""
    return _pairs(_role(r, "controller", False, "a").join(_role(r, "product", False, "b"), "reaction"), "a_ref", "controls-expression-of", "b_ref")


def _precedes(who: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of (ref, chemical, made, lo, hi), the first and last reaction in which ref makes or uses a chemical: the makers' classes (class, chemicals,
    members with not_b), the users' classes, which classes share a chemical, and the pairs (a, b) of theirs that one and the same reaction makes.

    Refs of equal chemicals are one class, so pairs are found once for two classes and not once for each chemical.
    """
    made, used = who.filter("made").drop("made"), who.filter("not made").drop("made")
    sets = lambda w, side: w.groupBy(F.col("ref").alias(side)).agg(F.sort_array(F.collect_set("chemical")).alias(f"{side}_chemicals"))
    makers, users = sets(made, "a"), sets(used, "b")
    # a reaction feeding itself counts only with another one: pairs for which all shared chemicals come from one that does
    sole = lambda w, side: w.filter("lo = hi").select(F.col("ref").alias(side), "chemical", "lo")
    fed = sole(made, "a").join(sole(used, "b"), ["chemical", "lo"]).filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    fed = fed.join(makers, "a").join(users, "b").filter(F.size(F.array_intersect("a_chemicals", "b_chemicals")) == F.col("n")).select("a", "b")
    makers = makers.join(fed.groupBy("a").agg(F.collect_list("b").alias("not_b")), "a", "left")
    a = makers.groupBy("a_chemicals").agg(F.min("a").alias("a_class"), F.collect_list(F.struct("a", "not_b")).alias("a_members"))
    b = users.groupBy("b_chemicals").agg(F.min("b").alias("b_class"), F.collect_list("b").alias("b_members"))
    by = lambda c, side: c.select(f"{side}_class", F.explode(f"{side}_chemicals").alias("chemical"))
    return a, b, by(a, "a").join(by(b, "b"), "chemical").select("a_class", "b_class").distinct(), fed


def _precedes_pairs(who: DataFrame) -> DataFrame:
    """Pairs of two classes block by block, the blocks dealt out evenly; each pair comes once."""
    a, b, links, _ = _precedes(who)
    blocks = lambda c, side: c.select(f"{side}_class", F.explode(F.expr(f"transform(sequence(0, (size({side}_members) - 1) div {BLOCK}), i -> slice({side}_members, int(i) * {BLOCK} + 1, {BLOCK}))")).alias(f"{side}_block"))
    conf = who.sparkSession.conf
    parts = max(int(conf.get("spark.sql.shuffle.partitions")), 3 * who.sparkSession.sparkContext.defaultParallelism)
    j = links.join(blocks(a, "a"), "a_class").join(blocks(b, "b"), "b_class").select("a_block", "b_block").repartition(parts)
    j = j.select(F.explode("a_block").alias("x"), "b_block").select("x.a", "x.not_b", F.explode("b_block").alias("b"))
    return j.filter("a <> b and (not_b is null or not array_contains(not_b, b))").select("a", F.lit("catalysis-precedes").alias("relation"), "b")


def catalysis_precedes(r: DataFrame) -> DataFrame:
    """SIF5: A controls a reaction that makes a chemical which another reaction, controlled by B, takes in."""
    controllers = r.filter("role = 'controller' and not molecule").select("reaction", "ref").distinct()
    chemicals = r.filter("role in ('left', 'right') and molecule").select("reaction", F.col("ref").alias("chemical"), (F.col("role") == "right").alias("made")).distinct()
    who = controllers.join(chemicals, "reaction").filter("ref is not null and chemical is not null").groupBy("ref", "chemical", "made").agg(F.min("reaction").alias("lo"), F.max("reaction").alias("hi"))
    return _precedes_pairs(Scratch(r.sparkSession, "precedes").write(who)[0])


def in_complex_with(r: DataFrame) -> DataFrame:
    """SIF6."""
    return _same(r, ("component",), "in-complex-with", False)


def interacts_with(r: DataFrame) -> DataFrame:
    """SIF7."""
    return _same(r, ("participant",), "interacts-with", False)


def neighbor_of(r: DataFrame) -> DataFrame:
    """SIF8: proteins with any role in the same interaction."""
    return _same(r, ("left", "right", "controller", "product", "participant"), "neighbor-of", False)


def consumption_controlled_by(r: DataFrame) -> DataFrame:
    """SIF9."""
    return _pairs(_role(r, "left", True, "a").join(_role(r, "controller", False, "b"), "reaction"), "a_ref", "consumption-controlled-by", "b_ref")


def controls_production_of(r: DataFrame) -> DataFrame:
    """SIF10."""
    return _pairs(_role(r, "controller", False, "a").join(_role(r, "right", True, "b"), "reaction"), "a_ref", "controls-production-of", "b_ref")


def controls_transport_of_chemical(r: DataFrame) -> DataFrame:
    """SIF11."""
    return _pairs(_role(r, "controller", False, "a").join(_changed(r, True, "location"), "reaction"), "a_ref", "controls-transport-of-chemical", "b_ref")


def chemical_affects(r: DataFrame) -> DataFrame:
    """SIF12: a chemical that controls or enters a reaction which changes a protein's state."""
    c = _role(r, "left", True, "a").unionByName(_role(r, "controller", True, "a")).select("reaction", "a_ref").distinct()
    return _pairs(c.join(_changed(r, False, "state"), "reaction"), "a_ref", "chemical-affects", "b_ref")


def reacts_with(r: DataFrame) -> DataFrame:
    """SIF13."""
    return _same(r, ("left",), "reacts-with", True)


def used_to_produce(r: DataFrame) -> DataFrame:
    """SIF14."""
    return _pairs(_role(r, "left", True, "a").join(_role(r, "right", True, "b"), "reaction"), "a_ref", "used-to-produce", "b_ref")


RELATIONS = {
    "controls-state-change-of": controls_state_change_of, "controls-transport-of": controls_transport_of, "controls-phosphorylation-of": controls_phosphorylation_of,
    "controls-expression-of": controls_expression_of, "catalysis-precedes": catalysis_precedes, "in-complex-with": in_complex_with, "interacts-with": interacts_with,
    "neighbor-of": neighbor_of, "consumption-controlled-by": consumption_controlled_by, "controls-production-of": controls_production_of,
    "controls-transport-of-chemical": controls_transport_of_chemical, "chemical-affects": chemical_affects, "reacts-with": reacts_with, "used-to-produce": used_to_produce,
}
#: FIL17: what is inferred unless asked otherwise.
DEFAULT = tuple(k for k in RELATIONS if k != "neighbor-of")


ROLES, CHANGES = ("left", "right", "controller", "product", "participant", "component"), ("state", "location", "phospho")


def _bits(molecule: bool, *what: str) -> int:
    """A bit for each role, and for each thing that a reaction changes, of proteins and of chemicals."""
    return sum(1 << (2 * (ROLES + CHANGES).index(w) + molecule) for w in what)


_CONTROL = _bits(False, "controller")
#: What a and b are in the same reaction, and whether a pair's order is free (then a is the smaller). Catalysis-precedes needs two of these.
ENDS = {
    "controls-state-change-of": (_CONTROL, _bits(False, "state"), False), "controls-transport-of": (_CONTROL, _bits(False, "location"), False),
    "controls-phosphorylation-of": (_CONTROL, _bits(False, "phospho"), False), "controls-expression-of": (_CONTROL, _bits(False, "product"), False),
    "in-complex-with": (_bits(False, "component"), _bits(False, "component"), True), "interacts-with": (_bits(False, "participant"), _bits(False, "participant"), True),
    "neighbor-of": (*[_bits(False, "left", "right", "controller", "product", "participant")] * 2, True), "consumption-controlled-by": (_bits(True, "left"), _CONTROL, False),
    "controls-production-of": (_CONTROL, _bits(True, "right"), False), "controls-transport-of-chemical": (_CONTROL, _bits(True, "location"), False),
    "chemical-affects": (_bits(True, "left", "controller"), _bits(False, "state"), False), "reacts-with": (_bits(True, "left"), _bits(True, "left"), True),
    "used-to-produce": (_bits(True, "left"), _bits(True, "right"), False),
}
#: Who makes a chemical, and a chemical with who uses it.
MAKES, USES = (_CONTROL, _bits(True, "right")), (_bits(True, "left"), _CONTROL)


def _ends(roles: DataFrame) -> DataFrame:
    """(reaction, ref, bits): all that a ref is in a reaction."""
    r = roles.filter(F.col("role").isin(*ROLES)).dropna(subset=["reaction", "ref", "molecule"])
    bit = F.coalesce(*(F.when((F.col("role") == x) & (F.col("molecule") == m), F.lit(_bits(m, x))) for x in ROLES for m in (False, True)))
    at = lambda f, side, what: f(F.when(F.col("role") == side, F.col(what))).alias(f"{f.__name__}_{side}_{what}")
    sides = r.filter("role in ('left', 'right')").groupBy("reaction", "ref", "molecule").agg(*(at(f, x, w) for w in CHANGES for x in ("left", "right") for f in (F.min, F.max)))
    # a value on the left and another one on the right: both sides have some, and not all are the same one
    differs = lambda w: f"min_left_{w} is not null and min_right_{w} is not null and not (min_left_{w} = max_left_{w} and min_right_{w} = max_right_{w} and min_left_{w} = min_right_{w})"
    changed = sum((F.when(F.expr(differs(w)), F.when(F.col("molecule"), _bits(True, w)).otherwise(_bits(False, w))).otherwise(0) for w in CHANGES), F.lit(0))
    both = r.select("reaction", "ref", bit.alias("bits")).unionByName(sides.select("reaction", "ref", changed.alias("bits")).filter("bits > 0"))
    return both.groupBy("reaction", "ref").agg(F.bit_or("bits").alias("bits"))


def _found(ends: DataFrame, relations: list[str], chemicals: bool) -> DataFrame:
    """(a, b, found, ...) from one join of the reactions' refs: a bit for each relation; with chemicals, also the first and last reaction in which a
    makes b, or a is used by b.

    Relations with the same end a are a slot, and refs meet in a slot only: all that meet are related (but for order and equal refs).
    """
    has = lambda bits, of: F.col(of).bitwiseAND(bits) != 0
    slots: dict[int, int] = {}
    for x, y in [ENDS[k][:2] for k in relations] + [MAKES, USES] * chemicals:
        slots[x] = slots.get(x, 0) | y
    number = {x: k for k, x in enumerate(slots)}
    side = lambda masks, *more: ends.select("reaction", *more, F.explode(F.array_compact(F.array(*(F.when(has(m, "bits"), k) for k, m in enumerate(masks))))).alias("slot"))
    j = side(slots, F.col("ref").alias("a")).join(side(slots.values(), F.col("ref").alias("b"), F.col("bits").alias("b_bits")), ["reaction", "slot"])
    meets = lambda x, y: (F.col("slot") == number[x]) & has(y, "b_bits")
    found = F.lit(0)
    for k, name in enumerate(relations):
        x, y, free = ENDS[name]
        found = found.bitwiseOR(F.when(meets(x, y) & (F.col("a") < F.col("b") if free else F.col("a") != F.col("b")), 1 << k).otherwise(0))
    ways = {"makes": meets(*MAKES), "uses": meets(*USES)} if chemicals else {}
    j = j.select("a", "b", "reaction", found.alias("found"), *(c.alias(w) for w, c in ways.items())).filter(" or ".join(["found > 0", *ways]))
    spans = [f(F.when(F.col(w), F.col("reaction"))).alias(f"{w}_{n}") for w in ways for n, f in (("lo", F.min), ("hi", F.max))]
    return j.groupBy("a", "b").agg(F.bit_or("found").alias("found"), *spans)


def _inferred(roles: DataFrame, relations: tuple[str, ...], blacklist: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, relation, b) without those of catalysis-precedes, and the rows that these follow from, if it is asked for."""
    if blacklist is not None:
        roles = roles.join(blacklist, "ref", "left_anti")
    if not relations:
        raise ValueError("no relation")
    direct, chemicals = [k for k in dict.fromkeys(relations) if k != "catalysis-precedes"], "catalysis-precedes" in relations
    # every relation reads the roles: they, what refs are in reactions, and what pairs are, are each made once
    scratch = Scratch(roles.sparkSession, "roles")
    kept, at = scratch.write(roles)
    ends, then = scratch.write(_ends(kept))
    scratch.drop(at)
    pairs, _ = scratch.write(_found(ends, direct, chemicals))
    scratch.drop(then)
    names = F.array_compact(F.array(*(F.when(F.col("found").bitwiseAND(1 << k) != 0, F.lit(name)) for k, name in enumerate(direct)))) if direct else F.array().cast("array<string>")
    out = pairs.filter("found > 0").select("a", F.explode(names).alias("relation"), "b")
    if not chemicals:
        return out, None
    who = [
        pairs.filter(f"{w}_lo is not null").select(F.col(ref).alias("ref"), F.col(chemical).alias("chemical"), F.lit(w == "makes").alias("made"), F.col(f"{w}_lo").alias("lo"), F.col(f"{w}_hi").alias("hi"))
        for w, ref, chemical in (("makes", "a", "b"), ("uses", "b", "a"))
    ]
    return out, who[0].unionByName(who[1])


def infer(roles: DataFrame, relations: tuple[str, ...] = DEFAULT, blacklist: DataFrame | None = None) -> DataFrame:
    """(a, relation, b), distinct, of these relations, without refs of the blacklist (ref)."""
    out, who = _inferred(roles, relations, blacklist)
    return out if who is None else out.unionByName(_precedes_pairs(who))


def counts(roles: DataFrame, relations: tuple[str, ...] = DEFAULT, blacklist: DataFrame | None = None) -> DataFrame:
    """(relation, n): how many pairs infer gives of each relation that has some. Those of catalysis-precedes are counted by classes."""
    out, who = _inferred(roles, relations, blacklist)
    n = out.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
    if who is None:
        return n
    a, b, links, fed = _precedes(who)
    size = lambda c, side: c.select(f"{side}_class", F.size(f"{side}_members").cast("bigint").alias(f"{side}_n"))
    own = who.filter("made").join(who.filter("not made").select("ref", "chemical"), ["ref", "chemical"]).select("ref").distinct()
    all_ = links.join(size(a, "a"), "a_class").join(size(b, "b"), "b_class").select(F.expr("a_n * b_n").alias("n"))
    # less each ref that follows itself, and what only a reaction's own chemicals link
    less = own.select(F.lit(-1).cast("bigint").alias("n")).unionByName(fed.select(F.lit(-1).cast("bigint").alias("n")))
    return n.unionByName(all_.unionByName(less).agg(F.sum("n").alias("n")).filter("n > 0").select(F.lit("catalysis-precedes").alias("relation"), "n"))


def roles_of(m, refs: DataFrame) -> DataFrame:
    """Roles of a BioPAX model; refs (uri, ref, molecule) gives each physical entity's identifier."""
    e = m.edges
    props = {"left": "left", "right": "right", "product": "product", "participant": "participant", "component": "component"}
    direct = e.filter(F.col("prop").isin(*props)).select(F.col("src").alias("reaction"), F.col("prop").alias("role"), F.col("dst").alias("uri"))
    controls = e.filter("prop = 'controller'").select(F.col("src").alias("control"), F.col("dst").alias("uri"))
    controlled = e.filter("prop = 'controlled'").select(F.col("src").alias("control"), F.col("dst").alias("reaction"))
    all_ = direct.unionByName(controls.join(controlled, "control").select("reaction", F.lit("controller").alias("role"), "uri"))
    pick = lambda prop, name: e.filter(F.col("prop") == prop).groupBy(F.col("src").alias("uri")).agg(F.concat_ws(";", F.sort_array(F.collect_set("dst"))).alias(name))
    kinds = m.elements.select(F.col("uri").alias("reaction"), F.col("type").alias("kind"))
    feats = e.filter("prop = 'feature'").select(F.col("src").alias("uri"), F.col("dst").alias("f"))
    terms = m.literals.filter("prop in ('term', 'name')").select(F.col("uri").alias("t"), F.lower("value").alias("term"))
    ph = feats.join(e.filter("prop = 'modificationType'").select(F.col("src").alias("f"), F.col("dst").alias("t")), "f").join(terms, "t").filter(F.col("term").contains("phospho")).groupBy("uri").agg(F.concat_ws(";", F.sort_array(F.collect_set("f"))).alias("phospho"))
    j = all_.join(refs, "uri").join(kinds, "reaction").join(pick("cellularLocation", "location"), "uri", "left").join(pick("feature", "state"), "uri", "left").join(ph, "uri", "left")
    blank: Column = F.lit("")
    return j.select("reaction", "kind", "role", "ref", "molecule", F.coalesce("state", blank).alias("state"), F.coalesce("location", blank).alias("location"), F.coalesce("phospho", blank).alias("phospho"))
