"""Problem 1: one group identifier for all records that pairwise matches link, directly or through others.

Method: low-diameter decomposition. At each level every vertex draws an exponential shift; a cluster starts to grow from a vertex the
earlier the larger its shift, one hop a round, and each vertex joins the cluster that reaches it first. Clusters are contracted to
super-vertices, the same is done with the edges left between clusters, and the assignments of all levels are composed.

At the first level, where every round would shuffle all edges, a vertex looks at its neighbours only: it stays a centre if it starts
before any of them reaches it, else it follows the neighbour that reaches it first, and that one its own, up to a centre. These
clusters are connected too, and need one pass over the edges. From the second level on, waves grow hop by hop, and only vertices
reached anew send on. Growth can go on until no vertex is reached sooner; by default it is cut after a few hops, as the data has chains of over
a hundred records, each hop of which would be a round, while contraction takes them at the next level. Whichever way a vertex takes, its
centre is in its component, so the result is exact for any cut.

All state is in tables of 64-bit ids: one row a vertex, one row an edge. No adjacency list is ever collected, the message to a vertex
is combined on the map side (a minimum), and the few vertices that hold more than 1/1000 of the edges are salted, so
a hub costs no more than its share of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pathweave.functions.ids import fix_id_for_mapping
from pathweave.runtime import HEAVY, Scratch, hashed, heavy_keys, identified, lookup, once, strip

#: Mean shift, in hops: large against the hops of a level, so that few waves meet and clusters are as large as the hops allow.
MEAN_SHIFT = 32.0
#: Hops that waves grow at each level after the first; None: until no vertex is reached sooner. Measured in the README.
HOPS = 3


def _shift(v: Column, level: int) -> Column:
    """Exponentially distributed, from the id alone: no state, the same on a retried task."""
    u = (F.abs(F.xxhash64(F.lit(level * 7919 + 1), v) % F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    return -F.log(u) * MEAN_SHIFT


def _both(edges: DataFrame) -> DataFrame:
    pair = F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))
    return edges.select(F.inline(pair))


def _heavy(labels: DataFrame, n_edges: int) -> list[int]:
    """Vertices with more than 1/HEAVY of the edges, at most 2 * HEAVY of them."""
    return [r.v for r in labels.filter(F.col("deg") > max(n_edges // HEAVY, 1000)).select("v").collect()]


def _counted(df: DataFrame, scratch: Scratch, **counts: Column) -> tuple[DataFrame, str, dict]:
    """df written, with counts taken on the way."""
    seen = Observation()
    out, path = scratch.write(df.observe(seen, *(c.alias(k) for k, c in counts.items())))
    return out, path, seen.get


def _first_arrivals(edges: DataFrame, level: int, scratch: Scratch) -> tuple[DataFrame, str]:
    """(v, c, key, deg): the vertex whose wave reaches v first within a hop, when, and v's degree; a neighbour's start follows from its id."""
    own = -_shift(F.col("v"), level)
    sent = _both(edges).select("v", F.col("w").alias("c"), (1 - _shift(F.col("w"), level)).alias("key"))
    first = sent.groupBy("v").agg(F.min_by("c", "key").alias("c"), F.min("key").alias("key"), F.count(F.lit(1)).alias("deg"))
    at_home = own <= F.col("key")
    return scratch.write(first.select("v", F.when(at_home, F.col("v")).otherwise(F.col("c")).alias("c"), F.when(at_home, own).otherwise(F.col("key")).alias("key"), "deg"))


def _followed(labels: DataFrame, path: str, heavy: list[int], scratch: Scratch) -> tuple[DataFrame, str]:
    """(v, c) with c a centre: each vertex's way followed to its end, which it has, as starts grow earlier along it.

    Only vertices that others follow and that follow on themselves are between; their ways are doubled, then all are led to the end.
    """
    led = labels.filter(F.col("v") != F.col("c")).select("v", "c")
    followed = led.select(F.col("c").alias("w")).distinct()
    between, b_path, seen = _counted(led.join(followed, F.col("v") == F.col("w"), "left_semi").select(F.col("v").alias("w"), F.col("c").alias("further"), F.lit(True).alias("moved")), scratch, moved=F.count_if("moved"))
    while seen["moved"]:
        nxt = between.select(F.col("w").alias("x"), F.col("further").alias("f"))
        old = b_path
        more = lookup(between.select("w", "further"), "further", nxt, "x", heavy, "left")
        between, b_path, seen = _counted(more.select("w", F.coalesce("f", "further").alias("further"), F.col("f").isNotNull().alias("moved")), scratch, moved=F.count_if("moved"))
        scratch.drop(old)
    ends = between.select("w", "further")
    out, o_path = scratch.write(lookup(labels.select("v", "c"), "c", ends, "w", heavy, "left", True).select("v", F.coalesce("further", "c").alias("c")))
    scratch.drop(path, b_path)
    return out, o_path


def _grown(edges: DataFrame, labels: DataFrame, path: str, heavy: list[int], hops: int | None, scratch: Scratch, large: bool = False) -> tuple[DataFrame, str]:
    """(v, c) after the waves have grown by so many hops, the first of which is made; without hops until no vertex is reached sooner."""
    labels = labels.select("v", "c", "key", F.lit(True).alias("new"))
    hop = 1
    while hops is None or hop < hops:
        senders = labels.filter("new").select("v", "c", "key")
        sent = lookup(_both(edges).select(F.col("w").alias("s"), F.col("v").alias("t")), "s", senders, "v", heavy, hashed_join=large)
        waves = sent.select(F.col("t").alias("v"), "c", (F.col("key") + 1).alias("key"), F.lit(None).cast("double").alias("was"))
        best = labels.select("v", "c", "key", F.col("key").alias("was")).unionByName(waves).groupBy("v").agg(F.min_by("c", "key").alias("c"), F.min("key").alias("key"), F.max("was").alias("was"))
        old = path
        labels, path, seen = _counted(best.select("v", "c", "key", (F.col("key") < F.col("was")).alias("new")), scratch, new=F.count_if("new"))
        scratch.drop(old)
        hop += 1
        if not seen["new"]:
            break
    return labels.select("v", "c"), path


def connected_components(edges: DataFrame, scratch: Scratch, hops: int | None = HOPS) -> DataFrame | None:
    """(v, comp) for every endpoint of edges (a, b: 64-bit ids, a < b, distinct); None where there are no edges.

    Two vertices get the same comp exactly if a path joins them. Isolated vertices aren't in edges and get no row. hops cuts the growth
    at the levels after the first; the result is the same.
    """
    levels: list[tuple[DataFrame, str]] = []
    e, e_path, seen = _counted(edges, scratch, n=F.count(F.lit(1)))
    n, level = seen["n"], 0
    while n:
        labels, path = _first_arrivals(e, level, scratch)
        heavy = _heavy(labels, n)
        labels, path = _grown(e, labels, path, heavy, hops, scratch, level < 2) if level else _followed(labels, path, heavy, scratch)
        names = labels.select("v", F.col("c").alias("cv"))
        # the first levels are large, and their labels two numbers a vertex; the others are small enough for Spark to choose
        one = lookup(e, "a", names.withColumnRenamed("cv", "ca"), "v", heavy, hashed_join=level < 2).select("ca", "b")
        between = lookup(one, "b", names.withColumnRenamed("cv", "cb"), "v", heavy, hashed_join=level < 2).filter("ca <> cb")
        left = between.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
        levels.append((labels, path))
        old = e_path
        e, e_path, seen = _counted(left, scratch, n=F.count(F.lit(1)))
        scratch.drop(old)
        n = seen["n"]
        level += 1
    scratch.drop(e_path)
    if not levels:
        return None
    comp, comp_path = levels[-1][0].withColumnRenamed("c", "comp"), levels[-1][1]
    for k, (labels, path) in reversed(list(enumerate(levels[:-1]))):
        up = comp.withColumnRenamed("v", "c")
        out, out_path = scratch.write(lookup(labels, "c", up, "c", heavy_keys(labels, "c"), "left", k == 0).select("v", F.coalesce("comp", "c").alias("comp")))
        scratch.drop(path, comp_path)
        comp, comp_path = out, out_path
    return comp


def records_of(mappings: DataFrame) -> DataFrame:
    """(d1, r1, d2, r2): the databases and ids of the rows' two records. Rows with a null or blank cell among the four are left out."""
    cells = once(mappings, *(strip(c).alias(c) for c in ("src_db", "src_id", "dst_db", "dst_id")))
    rows = cells.filter("src_db <> '' and src_id <> '' and dst_db <> '' and dst_id <> ''")
    upper = once(rows, F.upper("src_db").alias("d1"), F.col("src_id").alias("i1"), F.upper("dst_db").alias("d2"), F.col("dst_id").alias("i2"))
    return once(upper, F.col("d1"), fix_id_for_mapping("d1", "i1", kegg_suffix=False).alias("r1"), F.col("d2"), fix_id_for_mapping("d2", "i2", kegg_suffix=False).alias("r2"))


def group_records(mappings: DataFrame) -> DataFrame:
    """p1: (rec_db, rec_id, group_key), one row per distinct record of mappings (src_db, src_id, dst_db, dst_id; more columns are ignored).

    A record is the database, trimmed and upper-cased, with the id, trimmed and in the stored mapping form. Rows with a null or blank
    cell add no record. Repeated pairs, in either direction, count once; a record matched only with itself is a group of one.
    ``group_key`` is the least ``rec_db|rec_id`` of the group in byte order. An empty table gives an empty result.

    Records are 64-bit hashes on the way. Whether two records share a hash is tested on all of them first, and another seed is taken
    if so: the result is exact.
    """
    spark = mappings.sparkSession
    scratch = Scratch(spark, "groups")
    pairs = records_of(mappings)
    both = F.array(*(F.struct(F.col(d).alias("rec_db"), F.col(i).alias("rec_id")) for d, i in (("d1", "r1"), ("d2", "r2"))))
    vertices, _, seed = identified(pairs.select(F.inline(both)).distinct(), ["rec_db", "rec_id"], scratch)
    key = hashed(seed)
    ends = once(pairs, key("d1", "r1").alias("x"), key("d2", "r2").alias("y")).filter("x <> y")
    edges = ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    comp = connected_components(edges, scratch)
    if comp is None:
        return vertices.select("rec_db", "rec_id", F.concat_ws("|", "rec_db", "rec_id").alias("group_key"))
    named, _ = scratch.write(vertices.join(comp.hint("shuffle_hash"), "v", "left").select(F.coalesce("comp", "v").alias("comp"), "rec_db", "rec_id"))
    least = named.groupBy("comp").agg(F.min(F.concat_ws("|", "rec_db", "rec_id")).alias("group_key"))
    return lookup(named, "comp", least, "comp", heavy_keys(named, "comp")).select("rec_db", "rec_id", "group_key")
