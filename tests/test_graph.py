import pytest

from pathweave.functions.text import Direction
from pathweave.model import Model, closure, subtypes
from pathweave.operators import graph as G
from pathweave.plans.paths import parse, traverse

E = "src string, prop string, dst string"


def edges(spark, *pairs, prop="p"):
    return spark.createDataFrame([(a, prop, b) for a, b in pairs], E)


def seeds(spark, *uris):
    return spark.createDataFrame([(u,) for u in uris], "uri string")


def dist(df):
    return {r[0]: r[1] for r in df.collect()}


def test_neighborhood(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("h", "b"), ("h", "z"), ("c", "a"))
    assert dist(G.neighborhood(e, seeds(spark, "a"), 1, Direction.DOWNSTREAM)) == {"a": 0, "b": 1}
    assert dist(G.neighborhood(e, seeds(spark, "a"), 2)) == {"a": 0, "b": 1, "c": 1, "h": 2, "d": 2}
    assert "h" not in dist(G.neighborhood(e, seeds(spark, "a"), 3, blacklist=seeds(spark, "h")))
    assert dist(G.neighborhood(e, seeds(spark), 2)) == {}


def test_paths(spark):
    e = edges(spark, ("a", "b"), ("b", "t"), ("a", "x"), ("x", "y"), ("y", "t"), ("t", "q"))
    assert dist(G.paths_from_to(e, seeds(spark, "a"), seeds(spark, "t"), 3)) == {"a": 2, "b": 2, "t": 2, "x": 3, "y": 3}
    assert set(dist(G.paths_from_to(e, seeds(spark, "a"), seeds(spark, "t"), 3, 0))) == {"a", "b", "t"}
    g = spark.createDataFrame([(1, "a"), (2, "t"), (3, "q")], "group_id int, uri string")
    assert dist(G.paths_between(e, g, 2)) == {"a": 2, "b": 2, "t": 1, "q": 1}


def test_common_stream(spark):
    e = edges(spark, ("a", "m"), ("b", "m"), ("m", "n"), ("a", "k"))
    g = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "group_id int, uri string")
    assert dist(G.common_stream(e, g, 2)) == {"m": 1, "n": 2}
    with pytest.raises(ValueError):
        G.common_stream(e, g, 1, Direction.UNDIRECTED)


def test_cycles(spark):
    e = edges(spark, ("A", "B"), ("B", "A"), ("B", "C"), ("C", "A"), ("C", "D"), prop="pathwayComponent")
    assert {(r.src, r.dst) for r in G.break_cycles(e).collect()} == {("A", "B"), ("B", "C"), ("C", "D")}


def model(spark):
    el = [("pw", "Pathway"), ("sub", "Pathway"), ("r", "BiochemicalReaction"), ("p", "Protein"), ("q", "Protein"), ("er", "ProteinReference"), ("s", "SmallMolecule")]
    ed = [("pw", "pathwayComponent", "r"), ("pw", "pathwayComponent", "sub"), ("sub", "pathwayComponent", "x"), ("r", "left", "p"), ("r", "right", "s"), ("p", "entityReference", "er"), ("q", "entityReference", "er"), ("pw", "nextStep", "q")]
    lit = [("p", "name", "P one"), ("er", "name", "E"), ("s", "name", "S")]
    return Model(spark.createDataFrame([(a, b, "ds") for a, b in el], "uri string, type string, datasource string"), spark.createDataFrame(ed, E), spark.createDataFrame(lit, "uri string, prop string, value string"))


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_traverse(spark):
    m = model(spark)
    assert pairs(traverse(m, "Pathway/pathwayComponent:Interaction/participant/name")) == {("pw", "P one"), ("pw", "S")}
    assert pairs(traverse(m, "ProteinReference/entityReferenceOf:Protein")) == {("er", "p"), ("er", "q")}
    assert pairs(traverse(m, "Pathway/pathwayComponent*:BiochemicalReaction")) == {("pw", "r")}
    assert pairs(traverse(m, "Protein/entityReference/name", seeds(spark, "p", "nothing"))) == {("p", "E")}
    for bad in ("name", "", "Nothing/name", "Protein/na me"):
        with pytest.raises(ValueError):
            traverse(m, bad)
    assert parse("A/b*:C")[1][0].transitive


def test_complete(spark):
    got = G.complete(model(spark), seeds(spark, "pw"))
    assert {r.uri for r in got.elements.collect()} == {"pw", "r", "sub", "p", "s", "er"}


def test_closure():
    assert "Protein" in closure()["Entity"] and subtypes("smallmolecule") == ["SmallMolecule"]
    with pytest.raises(ValueError):
        subtypes("Nothing")


def test_long_chains(spark):
    ring = [(f"r{i:02d}", "pathwayComponent", f"r{(i + 1) % 60:02d}") for i in range(60)]
    chain = [(f"c{i:02d}", "pathwayComponent", f"c{i + 1:02d}") for i in range(59)]
    e = spark.createDataFrame(ring + chain, "src string, prop string, dst string")
    assert {(r.src, r.dst) for r in e.exceptAll(G.break_cycles(e)).select("src", "dst").collect()} == {("r59", "r00")}
    c = e.filter("src like 'c%'")
    one = lambda u: spark.createDataFrame([(u,)], "uri string")
    assert [r.container for r in G.containers(c, one("c59"), one("c00")).collect()] == ["c00"]
