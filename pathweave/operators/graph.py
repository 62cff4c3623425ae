"""Graph queries over edges (src, dst): distances in hops, neighbourhood, paths, common stream, closure (GRA1-GRA7, GRA9, GRA10, GRA12).

One hop is one object-property edge of the projection given. Frontiers are tables of distinct nodes; each hop is one join of the edges
with the newest nodes, whose outcome alone is filtered, and an anti-join with those known, written to shared storage, so neither lineage
nor path counts grow. Edges are never written or shuffled as a whole where the frontier is small. Without a limit a search goes on
until nothing new is found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from pathweave.functions.text import Direction
from pathweave.model import Model
from pathweave.runtime import Scratch


def arcs(edges: DataFrame, direction: Direction = Direction.DOWNSTREAM) -> DataFrame:
    """(src, dst) of edges in a direction."""
    e = edges.select("src", "dst")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if direction is Direction.UPSTREAM:
        return back
    return e.unionByName(back) if direction in (Direction.BOTHSTREAM, Direction.UNDIRECTED) else e


def distances(edges: DataFrame, seeds: DataFrame, limit: int | None, scratch: Scratch, key: str | None = None, blacklist: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(uri, dist) of all nodes within limit hops of seeds (uri), seeds at 0; with key, of each group of seeds by itself.

    FIL15: no hop leaves or enters a node of the blacklist (uri), nor one outside allowed (uri) where that is given.
    """
    keys = [key] if key else []

    def open_(nodes: DataFrame) -> DataFrame:
        if blacklist is not None:
            nodes = nodes.join(blacklist.select("uri"), "uri", "left_anti")
        if allowed is not None:
            nodes = nodes.join(allowed.select("uri"), "uri", "left_semi")
        return nodes

    known, path = scratch.write(seeds.select(*keys, F.col("uri")).distinct().withColumn("dist", F.lit(0)))
    paths, new, hop = [path], open_(known), 0
    while limit is None or hop < limit:
        hop += 1
        step = new.join(edges, new["uri"] == edges["src"]).select(*keys, F.col("dst").alias("uri")).distinct()
        seen = Observation()
        fresh = open_(step.join(known, [*keys, "uri"], "left_anti")).withColumn("dist", F.lit(hop)).select(*keys, "uri", "dist")
        new, path = scratch.write(fresh.observe(seen, F.count(F.lit(1)).alias("n")))
        if not seen.get["n"]:
            break
        paths.append(path)
        known = edges.sparkSession.read.schema(known.schema).parquet(*paths)
    return known


def _fixed(nodes: DataFrame | None, scratch: Scratch) -> DataFrame | None:
    """A list of nodes that every hop reads, made once."""
    return None if nodes is None else scratch.write(nodes.select("uri"))[0]


def neighborhood(edges: DataFrame, seeds: DataFrame, limit: int = 1, direction: Direction = Direction.UNDIRECTED, blacklist: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """GRA1: (uri, dist) within limit hops of any seed. BOTHSTREAM is the union of upstream and downstream, each by itself."""
    scratch = Scratch(edges.sparkSession, "hood")
    blacklist, allowed = _fixed(blacklist, scratch), _fixed(allowed, scratch)
    if direction is Direction.BOTHSTREAM:
        both = [distances(arcs(edges, d), seeds, limit, scratch, None, blacklist, allowed) for d in (Direction.UPSTREAM, Direction.DOWNSTREAM)]
        return both[0].unionByName(both[1]).groupBy("uri").agg(F.min("dist").alias("dist"))
    return distances(arcs(edges, direction), seeds, limit, scratch, None, blacklist, allowed)


def paths_from_to(edges: DataFrame, sources: DataFrame, targets: DataFrame, limit: int, shortest_plus: int | None = None, blacklist: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """GRA3: (uri, through) of the nodes on directed walks from sources to targets (uri) of at most limit hops; through: the least such length.

    With shortest_plus k, only walks of the shortest length found plus k. No source gives no node; without targets use paths_between.
    """
    scratch = Scratch(edges.sparkSession, "paths")
    blacklist, allowed = _fixed(blacklist, scratch), _fixed(allowed, scratch)
    ahead = distances(arcs(edges), sources, limit, scratch, None, blacklist, allowed).select("uri", F.col("dist").alias("f"))
    behind = distances(arcs(edges, Direction.UPSTREAM), targets, limit, scratch, None, blacklist, allowed).select("uri", F.col("dist").alias("b"))
    on = ahead.join(behind, "uri").select("uri", (F.col("f") + F.col("b")).alias("through")).filter(F.col("through") <= limit)
    if shortest_plus is None:
        return on
    least = on.agg(F.min("through").alias("least"))  # one row
    return on.join(F.broadcast(least), F.col("through") <= F.col("least") + shortest_plus).select("uri", "through")


def paths_between(edges: DataFrame, seeds: DataFrame, limit: int, blacklist: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """GRA2: (uri, through) of the nodes on directed walks of at most limit hops from one group of seeds (group_id, uri) to another."""
    scratch = Scratch(edges.sparkSession, "between")
    blacklist, allowed = _fixed(blacklist, scratch), _fixed(allowed, scratch)
    ahead = distances(arcs(edges), seeds, limit, scratch, "group_id", blacklist, allowed).select(F.col("group_id").alias("g"), "uri", F.col("dist").alias("f"))
    behind = distances(arcs(edges, Direction.UPSTREAM), seeds, limit, scratch, "group_id", blacklist, allowed).select(F.col("group_id").alias("h"), "uri", F.col("dist").alias("b"))

    def nearest(df: DataFrame, g: str, d: str) -> DataFrame:
        """Of each side the two nearest groups suffice: the best pair of different groups is among them."""
        return df.withColumn("r", F.row_number().over(Window.partitionBy("uri").orderBy(d, g))).filter("r <= 2").drop("r")

    apart = nearest(ahead, "g", "f").join(nearest(behind, "h", "b"), "uri").filter("g <> h").select("uri", (F.col("f") + F.col("b")).alias("through"))
    return apart.groupBy("uri").agg(F.min("through").alias("through")).filter(F.col("through") <= limit)


def common_stream(edges: DataFrame, seeds: DataFrame, limit: int, direction: Direction = Direction.DOWNSTREAM, blacklist: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """GRA4: (uri, dist) of the nodes within limit hops up or down stream of every group of seeds (group_id, uri); dist: from the farthest.

    Groups with equal members count once. BOTHSTREAM and UNDIRECTED are refused.
    """
    if direction in (Direction.BOTHSTREAM, Direction.UNDIRECTED):
        raise ValueError("a common stream goes one way")
    scratch = Scratch(edges.sparkSession, "stream")
    blacklist, allowed = _fixed(blacklist, scratch), _fixed(allowed, scratch)
    distinct = seeds.groupBy("group_id").agg(F.sort_array(F.collect_set("uri")).alias("members")).groupBy("members").agg(F.min("group_id").alias("group_id"))
    groups, _ = scratch.write(distinct.select("group_id", F.explode("members").alias("uri")))
    n = groups.select("group_id").distinct().count()
    d = distances(arcs(edges, direction), groups, limit, scratch, "group_id", blacklist, allowed)
    return d.groupBy("uri").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("dist")).filter(F.col("n") == n).select("uri", "dist")


#: Properties that a closure doesn't follow: the next step of a pathway is another step, no part of this one.
NOT_FOLLOWED = ("nextStep",)


def fetch_closure(edges: DataFrame, seeds: DataFrame, depth: int | None = None, skip: tuple[str, ...] = NOT_FOLLOWED, into: DataFrame | None = None) -> DataFrame:
    """GRA5: (uri, dist) of seeds (uri) and all elements below them by properties other than skip; with into (uri), only to those nodes.

    Without depth until nothing new is found.
    """
    e = edges.filter(~F.col("prop").isin(list(skip))).select("src", "dst")
    if into is not None:
        e = e.join(into.select(F.col("uri").alias("dst")), "dst", "left_semi").select("src", "dst")
    return distances(e, seeds, depth, Scratch(edges.sparkSession, "closure"))


def complete(model: Model, seeds: DataFrame, sub_pathways: bool = False) -> Model:
    """GRA6: the self-contained sub-model of seeds (uri): their closure; other pathways' content only with sub_pathways."""
    edges = model.edges
    if not sub_pathways:
        pathways = model.of_type("Pathway").select(F.col("uri").alias("src"))
        inner = pathways.join(seeds.select(F.col("uri").alias("src")), "src", "left_anti")
        edges = edges.join(inner, "src", "left_anti").select("src", "prop", "dst")
    keep = fetch_closure(edges, seeds.join(model.elements.select("uri"), "uri", "left_semi")).select("uri")
    part = lambda df, c: df.join(keep.withColumnRenamed("uri", c), c, "left_semi")
    inner_edges = part(part(edges, "src"), "dst").select("src", "prop", "dst")
    return Model(part(model.elements, "uri").select("uri", "type", "datasource"), inner_edges, part(model.literals, "uri").select("uri", "prop", "value"), model.parents)


def cyclic_core(e: DataFrame, scratch: Scratch) -> DataFrame:
    """The arcs (src, dst) left when nodes that nothing points to, or that point to nothing, are taken off again and again."""
    core, path = scratch.write(e.select("src", "dst").distinct().withColumn("n", F.lit(0)))
    left = -1
    while True:
        starts, ends = core.select(F.col("src").alias("x")).distinct(), core.select(F.col("dst").alias("x")).distinct()
        seen, old = Observation(), path
        kept = core.join(starts, F.col("dst") == F.col("x"), "left_semi").join(ends, F.col("src") == F.col("x"), "left_semi")
        core, path = scratch.write(kept.observe(seen, F.count(F.lit(1)).alias("n")))
        scratch.drop(old)
        if seen.get["n"] in (0, left):
            return core.select("src", "dst")
        left = seen.get["n"]


def break_cycles(edges: DataFrame, prop: str = "pathwayComponent") -> DataFrame:
    """GRA9: edges of prop without those that close a cycle: of an edge between two nodes that reach each other, the one to the smaller
    uri goes, and a loop to itself too. The rest of the edges stays.

    What can't be on a cycle is peeled off first, however long its chains; reachability is kept for edges to smaller uris in the core
    only, and searched until nothing new is found.
    """
    scratch = Scratch(edges.sparkSession, "cycles")
    core = cyclic_core(edges.filter(F.col("prop") == prop), scratch)
    # an edge that goes to a smaller uri is the one to lose if its target reaches its source
    back = core.filter(F.col("dst") <= F.col("src"))
    reach = distances(core, back.select(F.col("dst").alias("g"), F.col("dst").alias("uri")), None, scratch, "g")
    bad = back.join(reach.select(F.col("g").alias("dst"), F.col("uri").alias("src")), ["dst", "src"], "left_semi").select("src", "dst").withColumn("prop", F.lit(prop))
    return edges.join(bad, ["src", "prop", "dst"], "left_anti").select("src", "prop", "dst")


def containers(edges: DataFrame, nodes: DataFrame, into: DataFrame, limit: int | None = None) -> DataFrame:
    """GRA10: (uri, container): for each node (uri) the elements of into (uri) that contain it, directly or through others, at any depth
    where there is no limit. Its state is one row for each node and element above it."""
    scratch = Scratch(edges.sparkSession, "containers")
    d = distances(arcs(edges, Direction.UPSTREAM), nodes.select(F.col("uri").alias("g"), "uri"), limit, scratch, "g").filter("dist > 0")
    return d.join(into.select("uri"), "uri", "left_semi").select(F.col("g").alias("uri"), F.col("uri").alias("container"))


def inferred(edges: DataFrame, elements: DataFrame, nodes: DataFrame, pathways: DataFrame) -> DataFrame:
    """GRA10: (uri, pathways, organisms, datasources) of nodes (uri), each sorted: the pathways (uri) above them, and the organisms and
    data sources of themselves or, where they have none, of these pathways."""
    up = containers(edges, nodes, pathways)
    organism = edges.filter("prop = 'organism'").select(F.col("src").alias("o"), F.col("dst").alias("organism")).distinct()
    source = elements.filter("datasource is not null").select(F.col("uri").alias("o"), "datasource")
    sets = lambda df, name: df.groupBy("uri").agg(F.sort_array(F.collect_set(name)).alias(name))
    out = nodes.select("uri").distinct().join(sets(up.withColumnRenamed("container", "pathway"), "pathway"), "uri", "left")
    for table, name in ((organism, "organism"), (source, "datasource")):
        own = sets(nodes.select("uri").distinct().join(table, F.col("uri") == F.col("o")).select("uri", name), name)
        above = sets(up.join(table, F.col("container") == F.col("o")).select("uri", name), name).withColumnRenamed(name, "above")
        out = out.join(own, "uri", "left").join(above, "uri", "left").withColumn(name, F.coalesce(name, "above")).drop("above")
    empty = F.array().cast("array<string>")
    return out.select("uri", *(F.coalesce(c, empty).alias(f"{c}s") for c in ("pathway", "organism", "datasource")))
