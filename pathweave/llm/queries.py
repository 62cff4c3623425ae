"""Queries of the problems tagged llm, over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm import canonical, grouping, mojibake, packing, tokenizer
from pathweave.runtime import Scratch, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.group_records(table(spark, sf_dir, "mappings"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.map_submissions(table(spark, sf_dir, "mapping_submissions"), table(spark, sf_dir, "db_registry"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The md5 of every text as its ids decode."""
    texts = tokenizer.decode_corpus(tokenizer.encode_corpus(table(spark, sf_dir, "documents")))
    return texts.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("md5"))


def p7_pack_2048(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tokenizer.count_tokens(table(spark, sf_dir, "documents")), 2048)


def p7_pack_8192(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tokenizer.count_tokens(table(spark, sf_dir, "documents")), 8192)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used and the share of their room that is filled, for both capacities; texts are tokenized once."""
    out = None
    sizes, _ = Scratch(spark, "sizes").write(tokenizer.count_tokens(table(spark, sf_dir, "documents")))
    for capacity in (2048, 8192):
        row = packing.pack(sizes, capacity).agg((F.max("container") + 1).alias("containers"), F.sum("n_tokens").alias("tokens")).select(F.lit(capacity).alias("capacity"), "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * capacity), 4).alias("filled"))
        out = row if out is None else out.unionByName(row)
    return out


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p4_found": p4_found,
    "p6_ids": p6_ids,
    "p6_decoded": p6_decoded,
    "p7_pack_2048": p7_pack_2048,
    "p7_pack_8192": p7_pack_8192,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
}

_FIX = """case when {db} like 'UNIPROT%' then regexp_replace({id}, '-[0-9]+$', '') when {db} = 'CHEBI' then case when upper({id}) like 'CHEBI:%' then upper({id}) else 'CHEBI:' || upper({id}) end
 when {db} = 'REFSEQ' then regexp_replace({id}, '\\.[0-9]+$', '') when {db} like 'KEGG%' and regexp_full_match({id}, ':[0-9]+') then substr({id}, 2)
 when {db} like '%PUBCHEM%' and ({db} like '%SUBSTANCE%' or {db} like '%SID%') then case when regexp_full_match({id}, '[0-9]+') then 'SID:' || {id} else upper({id}) end
 when {db} like '%PUBCHEM%' and ({db} like '%COMPOUND%' or {db} like '%CID%') then case when regexp_full_match({id}, '[0-9]+') then 'CID:' || {id} else upper({id}) end else {id} end"""
#: Ids are checked by what they decode to. Connected components by the spread of the least record; the other problems can't be said in SQL.
SQL: dict[str, str] = {
    "p6_decoded": "select doc_id, md5(coalesce(text, '')) as md5 from documents",
    "p1_found": f"""with recursive x as (select upper(trim(src_db)) as d1, trim(src_id) as i1, upper(trim(dst_db)) as d2, trim(dst_id) as i2 from mappings where trim(src_db) <> '' and trim(src_id) <> '' and trim(dst_db) <> '' and trim(dst_id) <> ''),
 p as (select d1, {_FIX.format(db="d1", id="i1")} as r1, d2, {_FIX.format(db="d2", id="i2")} as r2 from x),
 v as (select d1 as db, r1 as id from p union select d2, r2 from p), e as (select d1 || '|' || r1 as a, d2 || '|' || r2 as b from p union select d2 || '|' || r2, d1 || '|' || r1 from p),
 cc(rec, least) using key (rec) as (select distinct db || '|' || id, db || '|' || id from v
  union select e.b, min(cc.least) from cc join e on e.a = cc.rec join recurring.cc as u on u.rec = e.b where cc.least < u.least group by e.b)
 select v.db as rec_db, v.id as rec_id, cc.least as group_key from v join cc on cc.rec = v.db || '|' || v.id""",
}
