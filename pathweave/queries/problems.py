"""Queries of the general problems, over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathweave.operators import bad_rows, hierarchy, packed_fields
from pathweave.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_fields.split_fields(table(spark, sf_dir, "uniprot_entries"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bad_rows.failing_lines(table(spark, sf_dir, "mapping_lines"), table(spark, sf_dir, "db_registry"))


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = bad_rows.parse_lines(table(spark, sf_dir, "mapping_lines"), table(spark, sf_dir, "db_registry"))
    return lines.filter("reason is null").select("line_id", "src_db", "src_id", "dst_db", "dst_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchies(table(spark, sf_dir, "pathway_index"))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(table(spark, sf_dir, "pathway_index"))


QUERIES: dict[str, Query] = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_loaded": p3_loaded,
    "p5_found": p5_found,
    "p5_descendants": p5_descendants,
}
VALUE = r'(?:"(?:[^"]|"")*"[ \r]*|[^"\t]*)'
LINES_SQL = rf"""l as (select line_id, src_db, dst_db, raw_line, raw_line is null or regexp_full_match(raw_line, '(?s)[ \r]*{VALUE}(?:\t[ \r]*{VALUE})*') as readable,
 raw_line is not null and regexp_full_match(raw_line, '\s*') as blank, length(regexp_replace(raw_line, '"(?:[^"]|"")*"', '', 'g')) - length(replace(regexp_replace(raw_line, '"(?:[^"]|"")*"', '', 'g'), chr(9), '')) as tabs,
 regexp_extract(raw_line, '(?s)^[ \r]*({VALUE})\t[ \r]*({VALUE})$', 1) as v1, regexp_extract(raw_line, '(?s)^[ \r]*({VALUE})\t[ \r]*({VALUE})$', 2) as v2 from mapping_lines),
v as (select *, case when starts_with(v1, '"') then replace(regexp_replace(rtrim(v1, ' ' || chr(13)), '^"|"$', '', 'g'), '""', '"') else rtrim(v1, ' ' || chr(13)) end as a,
 case when starts_with(v2, '"') then replace(regexp_replace(rtrim(v2, ' ' || chr(13)), '^"|"$', '', 'g'), '""', '"') else rtrim(v2, ' ' || chr(13)) end as b from l),
w as (select v.line_id, v.src_db, v.dst_db, a, b, case when not readable then 'quoting' when raw_line is null or blank or tabs <> 1 then 'column_count'
 when not regexp_full_match(a, p.id_pattern) or not regexp_full_match(b, q.id_pattern) then 'invalid_value' end as reason
 from v left join db_registry p on p.db_name = v.src_db left join db_registry q on q.db_name = v.dst_db)"""
TREE_SQL = r"""x as (select trim(uri, E' \n\t\r') as uri, nullif(trim(pathway, E' \n\t\r'), '') as parent from pathway_index),
n as (select uri, min(parent) as parent from x where uri <> '' group by uri), m as (select n.uri, p.uri as parent from n left join n p on p.uri = n.parent),
r as (select uri, uri as root, 0 as depth, uri as path from m where parent is null union all select m.uri, r.root, r.depth + 1, r.path || '>' || m.uri from r join m on m.parent = r.uri)"""
#: SQL of what SQL can say; values packed with quotes (p2) are tested against a plain parser instead.
SQL: dict[str, str] = {
    "p3_found": f"with {LINES_SQL} select line_id, reason from w where reason is not null",
    "p3_loaded": f"with {LINES_SQL} select line_id, src_db, a as src_id, dst_db, b as dst_id from w where reason is null",
    "p5_found": f"with recursive {TREE_SQL}, d as (select anc, count(*) as k from (select unnest(string_split(path, '>')[1:depth]) as anc from r where depth > 0) group by anc) select m.uri, coalesce(root, '') as root_uri, coalesce(depth, -1)::int as depth_no, coalesce(path, '') as uri_path, (case when root is null then -1 else coalesce(k, 0) end)::int as n_desc from m left join r using (uri) left join d on d.anc = m.uri",
    "p5_descendants": f"with recursive {TREE_SQL} select p[i] as uri, uri as desc_uri, (depth + 1 - i)::int as steps from (select uri, depth, string_split(path, '>') as p, unnest(range(1, depth + 1)) as i from r)",
}
