"""Problem 5: parent-child links to full hierarchies: path, depth, root and descendants of every node, with cycles told apart.

Method: bottom-up leaf peeling. Each round takes off the nodes without children left and adds their subtree sizes to their parents;
then, in reverse peel order, each layer gets its paths and depths from its parents, which went later. Peeling alone needs a round for
each level of the tallest tree, so every round also splices out nodes with a single child left, no two neighbours at once: the child
takes their place and carries their uris. About a third of each chain goes a round, so rounds grow with the logarithm of the number of
nodes, not with the depth. A cycle shrinks likewise, to one node that is its own parent: what can't be peeled away is cycles.

A round is one aggregation by parent, combined on the map side, so a parent with a third of all rows as children is one partial sum a
task. The nodes alive are fewer each round; the way back reads those only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pathweave.runtime import Scratch, filled, heavy_keys, identified, lookup

ALIVE, PEELED, SPLICED = 0, 1, 2
#: A node on the way up: its id, uri and parent's id; its children left (number, exclusive or of their ids) and the descendants already
#: counted; what was spliced out between it and its parent (uris, number, their counted descendants and themselves), and of the latter
#: the sum over its children left.
UP = ("v", "uri", "p", "kids", "kid_ids", "below", "between", "gap", "extra", "kids_extra")
DOWN = ("v", "uri", "root_uri", "depth_no", "uri_path", "below")


def parents_of(index: DataFrame) -> DataFrame:
    """(uri, parent), one row per distinct uri; the parent is null for a root: blank, or the uri of no row."""
    rows = index.select(filled("uri").alias("uri"), filled("pathway").alias("parent")).filter(F.col("uri").isNotNull())
    nodes = rows.groupBy("uri").agg(F.min("parent").alias("parent"))
    named = nodes.select("parent").filter(F.col("parent").isNotNull()).distinct()
    known = named.join(nodes.select(F.col("uri").alias("known")), F.col("parent") == F.col("known"), "left_semi").select("parent", F.lit(True).alias("there"))
    return lookup(nodes, "parent", known, "parent", heavy_keys(nodes, "parent"), "left").select("uri", F.when(F.col("there"), F.col("parent")).alias("parent"))


def _grown(nodes: DataFrame) -> DataFrame:
    """The nodes (v, uri, p) as they start: nothing counted, nothing spliced."""
    kids = nodes.filter(F.col("p").isNotNull()).groupBy(F.col("p").alias("k")).agg(F.count(F.lit(1)).alias("kids"), F.bit_xor("v").alias("kid_ids"))
    none = F.lit(0).cast("bigint")
    return nodes.join(kids, nodes["v"] == kids["k"], "left").select(
        "v", "uri", "p", F.coalesce("kids", none).alias("kids"), F.coalesce("kid_ids", none).alias("kid_ids"), none.alias("below"), F.lit("").alias("between"), none.alias("gap"), none.alias("extra"), none.alias("kids_extra")
    )


def _peeled(rest: DataFrame) -> DataFrame:
    """rest with the nodes without children told apart (state) and counted at their parents."""
    leaf, none = F.col("kids") == 0, F.lit(0).cast("bigint")
    sent = rest.filter(leaf & F.col("p").isNotNull()).groupBy(F.col("p").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("v").alias("ids"), F.sum(F.col("below") + F.col("extra") + 1).alias("more"), F.sum("extra").alias("less")
    )
    got = rest.filter(~leaf).join(sent, F.col("v") == F.col("k"), "left")
    alive = got.select(
        "v", "uri", "p", (F.col("kids") - F.coalesce("n", none)).alias("kids"), F.col("kid_ids").bitwiseXOR(F.coalesce("ids", none)).alias("kid_ids"),
        (F.col("below") + F.coalesce("more", none)).alias("below"), "between", "gap", "extra", (F.col("kids_extra") - F.coalesce("less", none)).alias("kids_extra"), F.lit(ALIVE).alias("state"),
    )
    return alive.unionByName(rest.filter(leaf).withColumn("state", F.lit(PEELED)))


def _spliced(rest: DataFrame, turn: int) -> DataFrame:
    """rest with the inner nodes of chains told apart that come before their parent and their one child by a hash of this turn."""
    place = lambda c: F.xxhash64(F.lit(turn), F.col(c))
    inner = F.coalesce((F.col("kids") == 1) & (F.col("p") != F.col("v")) & (place("v") > place("p")) & (place("v") > place("kid_ids")), F.lit(False))
    out, none = rest.filter(inner), F.lit(0).cast("bigint")
    more = F.col("below") + 1
    news = F.struct(F.col("p"), F.concat("between", "uri", F.lit(">")).alias("between"), (F.col("gap") + 1).alias("gap"), (F.col("extra") + more).alias("extra"))
    to = F.array(
        F.struct(F.col("kid_ids").alias("k"), news.alias("news"), none.alias("ids"), none.alias("more")),
        F.struct(F.col("p").alias("k"), F.when(F.lit(False), news).alias("news"), F.col("v").bitwiseXOR(F.col("kid_ids")).alias("ids"), (more + F.col("kids_extra")).alias("more")),
    )
    sent = out.select(F.inline(to)).groupBy("k").agg(F.max("news").alias("news"), F.bit_xor("ids").alias("ids"), F.sum("more").alias("more"))
    got = rest.filter(~inner).join(sent, F.col("v") == F.col("k"), "left")
    alive = got.select(
        "v", "uri", F.when(F.col("news").isNotNull(), F.col("news.p")).otherwise(F.col("p")).alias("p"), "kids", F.col("kid_ids").bitwiseXOR(F.coalesce("ids", none)).alias("kid_ids"), "below",
        F.concat(F.coalesce("news.between", F.lit("")), "between").alias("between"), (F.coalesce("news.gap", none) + F.col("gap")).alias("gap"),
        (F.coalesce("news.extra", none) + F.col("extra")).alias("extra"), (F.col("kids_extra") + F.coalesce("more", none)).alias("kids_extra"), F.lit(ALIVE).alias("state"),
    )
    return alive.unionByName(out.withColumn("state", F.lit(SPLICED)))


def _named(layer: DataFrame, above: DataFrame, heavy: list | None, below: Column) -> DataFrame:
    """A layer's nodes under their parents above, whose uris and paths are known; caught where the parent is."""
    table = above.select("v", F.col("root_uri").alias("p_root"), F.col("depth_no").alias("p_depth"), F.col("uri_path").alias("p_path"))
    rows = lookup(layer, "p", table, "v", heavy, "left")
    root, caught = F.col("p").isNull(), F.col("p_depth") < 0
    return rows.select(
        "v", "uri",
        F.when(root, F.col("uri")).otherwise(F.col("p_root")).alias("root_uri"),
        F.when(root, 0).when(caught, -1).otherwise(F.col("p_depth") + 1 + F.col("gap")).cast("int").alias("depth_no"),
        F.when(root, F.col("uri")).when(caught, "").otherwise(F.concat("p_path", F.lit(">"), "between", "uri")).alias("uri_path"),
        F.when(~root & caught, -1).otherwise(below).cast("bigint").alias("below"),
    )


def hierarchies(index: DataFrame) -> DataFrame:
    """p5: (uri, root_uri, depth_no, uri_path, n_desc), one row per distinct uri of index (uri, pathway = the parent's uri).

    White space around uris is ignored, rows without uri are left out, records repeated under one uri count once (of differing parents
    the least is taken). A blank parent or one that is no row's uri makes a root, of depth 0. ``uri_path`` goes from the root to the
    node, joined by ``>``; ``n_desc`` counts all nodes below. A node on a cycle or below one gets '', -1, '' and -1. An empty table
    gives no rows; columns besides the two are ignored.

    Nodes are 64-bit hashes on the way, told apart on all of them first.
    """
    spark = index.sparkSession
    scratch = Scratch(spark, "tree")
    links, links_path = scratch.write(parents_of(index))
    nodes, nodes_path, _ = identified(links, ["uri"], scratch, lambda key: [F.when(F.col("parent").isNotNull(), key("parent")).alias("p"), F.col("uri")])
    scratch.drop(links_path)
    heavy = heavy_keys(nodes, "p")
    rest, _ = scratch.write(_grown(nodes))
    scratch.drop(nodes_path)
    layers: list[tuple[int, DataFrame]] = []
    active, turn = 1, 0
    while active:
        for kind, step in ((PEELED, _peeled), (SPLICED, lambda r, t=turn: _spliced(r, t))):
            seen = Observation()
            # a node that is its own parent is what is left of a cycle
            left = F.count_if((F.col("state") == ALIVE) & F.coalesce(F.col("p") != F.col("v"), F.lit(True)))
            out, path = scratch.write(step(rest).observe(seen, left.alias("active"), F.count_if(F.col("state") == kind).alias("gone")), by="state")
            if seen.get["gone"]:
                layers.append((kind, out.filter(F.col("state") == kind).select(*UP)))
            rest, active = out.filter(F.col("state") == ALIVE).select(*UP), seen.get["active"]
            if turn or kind == SPLICED:
                scratch.drop(f"{before}/state={ALIVE}")
            before = path
        turn += 1
    cycles = rest.select("v", "uri", F.lit("").alias("root_uri"), F.lit(-1).alias("depth_no"), F.lit("").alias("uri_path"), F.lit(-1).cast("bigint").alias("below"))
    done, path = scratch.write(cycles)
    paths = [path]
    for kind, layer in reversed(layers):
        if kind == SPLICED:
            under = done.select(F.col("v").alias("c"), F.col("below").alias("c_below"))
            layer = layer.join(under, F.col("kid_ids") == F.col("c"))
            named = _named(layer, done, None, F.col("below") + F.col("kids_extra") + F.col("c_below") + 1)
        else:
            named = _named(layer, done, heavy, F.col("below"))
        paths.append(scratch.write(named)[1])
        done = spark.read.schema(cycles.schema).parquet(*paths)  # one scan, however many layers
    return done.select("uri", "root_uri", "depth_no", "uri_path", F.col("below").cast("int").alias("n_desc"))


def descendants(index: DataFrame) -> DataFrame:
    """(uri, desc_uri, steps): every node with each of its descendants, from the nodes' paths; nodes on or below a cycle have none."""
    paths = hierarchies(index).filter(F.col("depth_no") > 0).select(F.col("uri").alias("desc_uri"), F.col("depth_no"), F.split("uri_path", ">").alias("p"))
    rows = paths.select("desc_uri", "depth_no", F.posexplode(F.slice("p", F.lit(1), F.col("depth_no"))).alias("d", "uri"))
    return rows.select("uri", "desc_uri", (F.col("depth_no") - F.col("d")).alias("steps"))
