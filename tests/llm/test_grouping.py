import random

import pytest

from pathweave.llm import grouping as G
from pathweave.runtime import Scratch

SCHEMA = "src_db string, src_id string, dst_db string, dst_id string, rec_db string, group_key string"


def groups(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return {f"{r.rec_db}|{r.rec_id}": r.group_key for r in G.group_records(df).collect()}


def test_cases(spark):
    got = groups(spark, [("uniprot", " P1-2 ", "CHEBI", "5"), ("UNIPROT", "P1", "refseq", "NP_1.3"), ("RefSeq", "NP_1", "UniProt", "P1"), ("A", "1", "A", "1"), ("A", "2", None, "3"), ("A", "2", "B", " "), ("B", "1", "A", "1")])
    assert got == {"UNIPROT|P1": "CHEBI|CHEBI:5", "CHEBI|CHEBI:5": "CHEBI|CHEBI:5", "REFSEQ|NP_1": "CHEBI|CHEBI:5", "A|1": "A|1", "B|1": "A|1"}


def test_only_loops_and_empty(spark):
    assert groups(spark, [("A", "1", "A", "1")]) == {"A|1": "A|1"}
    assert G.group_records(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("hops", [1, 3, None])
def test_against_union_find(spark, hops):
    random.seed(5)
    pairs = {(i, i + 1) for i in range(1, 60)} | {(1000, 2000 + i) for i in range(300)} | {tuple(sorted(random.sample(range(5000, 5400), 2))) for _ in range(250)}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    comp = G.connected_components(spark.createDataFrame(sorted(pairs), "a bigint, b bigint"), Scratch(spark, "t"), hops)
    got = {}
    for r in comp.collect():
        got.setdefault(r.comp, set()).add(r.v)
    want = {}
    for v in root:
        want.setdefault(find(v), set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_heavy_vertices_agree(spark, monkeypatch):
    monkeypatch.setattr(G, "HEAVY", 10)
    import pathweave.runtime as R

    rows = [("A", "hub", "B", str(i)) for i in range(1500)] + [("B", "7", "C", "1")]
    got = groups(spark, rows)
    assert set(got.values()) == {"A|hub"} and len(got) == 1502 and R.HEAVY == 1000
