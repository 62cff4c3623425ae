"""The star-schema tables as a typed graph, so the graph operators run on them.

Orders are pathways with line items as their interactions, parts are physical entities taking part, suppliers control, customers own;
nations and regions are places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.model import Model
from pathweave.runtime import table

PARENTS = {
    "Entity": "", "Utility": "", "Process": "Entity", "Pathway": "Process", "Interaction": "Process", "PhysicalEntity": "Entity",
    "Part": "PhysicalEntity", "Agent": "Entity", "Customer": "Agent", "Supplier": "Agent", "Place": "Utility", "Nation": "Place", "Region": "Place",
}


def uri(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def item_uri() -> Column:
    """Line items: order and line number repeat, so part, supplier and date belong to the key."""
    return F.concat(F.lit("lineitem:"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")))


def elements(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    none = F.lit(None).cast("string")
    parts = [
        t("orders").select(uri("order", "o_orderkey").alias("uri"), F.lit("Pathway").alias("type"), F.col("o_orderpriority").alias("datasource")),
        t("lineitem").select(item_uri().alias("uri"), F.lit("Interaction").alias("type"), F.col("l_returnflag").alias("datasource")),
        t("part").select(uri("part", "p_partkey").alias("uri"), F.lit("Part").alias("type"), F.col("p_brand").alias("datasource")),
        t("customer").select(uri("customer", "c_custkey").alias("uri"), F.lit("Customer").alias("type"), F.col("c_mktsegment").alias("datasource")),
        t("supplier").select(uri("supplier", "s_suppkey").alias("uri"), F.lit("Supplier").alias("type"), none.alias("datasource")),
        t("nation").select(uri("nation", "n_nationkey").alias("uri"), F.lit("Nation").alias("type"), none.alias("datasource")),
        t("region").select(uri("region", "r_regionkey").alias("uri"), F.lit("Region").alias("type"), none.alias("datasource")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    e = lambda df, s, p, o: df.select(s.alias("src"), F.lit(p).alias("prop"), o.alias("dst"))
    item = t("lineitem")
    ends = F.array(*(F.struct(s.alias("src"), F.lit(p).alias("prop"), o.alias("dst")) for s, p, o in (
        (uri("order", "l_orderkey"), "component", item_uri()), (item_uri(), "participant", uri("part", "l_partkey")), (item_uri(), "controller", uri("supplier", "l_suppkey")))))
    out = item.select(F.inline(ends))
    for p in (
        e(t("orders"), uri("order", "o_orderkey"), "placedBy", uri("customer", "o_custkey")),
        e(t("customer"), uri("customer", "c_custkey"), "location", uri("nation", "c_nationkey")),
        e(t("supplier"), uri("supplier", "s_suppkey"), "location", uri("nation", "s_nationkey")),
        e(t("nation"), uri("nation", "n_nationkey"), "partOf", uri("region", "n_regionkey")),
    ):
        out = out.unionByName(p)
    return out


def literals(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    v = lambda df, u, p, c: df.select(u.alias("uri"), F.lit(p).alias("prop"), F.col(c).cast("string").alias("value"))
    out = v(t("part"), uri("part", "p_partkey"), "name", "p_name")
    for p in (
        v(t("part"), uri("part", "p_partkey"), "brand", "p_brand"),
        v(t("part"), uri("part", "p_partkey"), "term", "p_type"),
        v(t("customer"), uri("customer", "c_custkey"), "name", "c_name"),
        v(t("supplier"), uri("supplier", "s_suppkey"), "name", "s_name"),
        v(t("nation"), uri("nation", "n_nationkey"), "name", "n_name"),
        v(t("region"), uri("region", "r_regionkey"), "name", "r_name"),
        v(t("orders"), uri("order", "o_orderkey"), "status", "o_orderstatus"),
        v(t("lineitem"), item_uri(), "controlType", "l_returnflag"),
    ):
        out = out.unionByName(p)
    return out


def model(spark: SparkSession, d: str) -> Model:
    return Model(elements(spark, d), edges(spark, d), literals(spark, d), tuple(PARENTS.items()))


ITEM_SQL = "'lineitem:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d')"
#: The same three tables as SQL.
ELEMENT_SQL = f"""element as (
  select 'order:' || o_orderkey as uri, 'Pathway' as type, o_orderpriority as datasource from orders
  union all select {ITEM_SQL}, 'Interaction', l_returnflag from lineitem
  union all select 'part:' || p_partkey, 'Part', p_brand from part
  union all select 'customer:' || c_custkey, 'Customer', c_mktsegment from customer
  union all select 'supplier:' || s_suppkey, 'Supplier', null from supplier
  union all select 'nation:' || n_nationkey, 'Nation', null from nation
  union all select 'region:' || r_regionkey, 'Region', null from region)"""
EDGE_SQL = f"""edge as (
  select 'order:' || l_orderkey as src, 'component' as prop, {ITEM_SQL} as dst from lineitem
  union all select {ITEM_SQL}, 'participant', 'part:' || l_partkey from lineitem
  union all select {ITEM_SQL}, 'controller', 'supplier:' || l_suppkey from lineitem
  union all select 'order:' || o_orderkey, 'placedBy', 'customer:' || o_custkey from orders
  union all select 'customer:' || c_custkey, 'location', 'nation:' || c_nationkey from customer
  union all select 'supplier:' || s_suppkey, 'location', 'nation:' || s_nationkey from supplier
  union all select 'nation:' || n_nationkey, 'partOf', 'region:' || n_regionkey from nation)"""
LITERAL_SQL = f"""literal as (
  select 'part:' || p_partkey as uri, 'name' as prop, p_name as value from part
  union all select 'part:' || p_partkey, 'brand', p_brand from part
  union all select 'part:' || p_partkey, 'term', p_type from part
  union all select 'customer:' || c_custkey, 'name', c_name from customer
  union all select 'supplier:' || s_suppkey, 'name', s_name from supplier
  union all select 'nation:' || n_nationkey, 'name', n_name from nation
  union all select 'region:' || r_regionkey, 'name', r_name from region
  union all select 'order:' || o_orderkey, 'status', o_orderstatus from orders
  union all select {ITEM_SQL}, 'controlType', l_returnflag from lineitem)"""
GRAPH_SQL = f"{ELEMENT_SQL}, {EDGE_SQL}, {LITERAL_SQL}"
CLOSURE_SQL = "type_closure(super, sub) as (values ('Entity','Process'),('Entity','Pathway'),('Entity','Interaction'),('Entity','PhysicalEntity'),('Entity','Part'),('Entity','Agent'),('Entity','Customer'),('Entity','Supplier'),('Process','Pathway'),('Process','Interaction'),('PhysicalEntity','Part'),('Agent','Customer'),('Agent','Supplier'),('Utility','Place'),('Utility','Nation'),('Utility','Region'),('Place','Nation'),('Place','Region'),('Pathway','Pathway'),('Interaction','Interaction'),('Part','Part'),('Customer','Customer'),('Supplier','Supplier'),('Nation','Nation'),('Region','Region'))"
