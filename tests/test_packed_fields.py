import pytest

from pathweave.operators import packed_fields as P

CASES = [
    ("AC", "Q1; Q2", ["Q1", "Q2"]), ("AC", ' W1 | D4\tX9;P0 L5, |T3 E0; ;', ["W1", "D4", "X9", "P0", "L5", "T3", "E0"]), ("AC", '"K5", S2 "N0";', ["K5", "S2", "N0"]),
    ("AC", "Q1; Q1", ["Q1", "Q1"]), ("AC", "", []), ("AC", None, []), ("AC", " ; ,", []),
    ("DR", "PDB:5EPH.\nGO:GO:1 word word.", ["PDB:5EPH", "GO:GO:1 word word"]), ("DR", '"RefSeq:NP_1.1, subunit x".', ["RefSeq:NP_1.1, subunit x"]),
    ("DR", '"PIR:E1 ""ith""; variant";RefSeq:NP_3.4', ['PIR:E1 "ith"; variant', "RefSeq:NP_3.4"]), ("DR", "'DIP:D-1; nor';\nPIR:U4 5'-MGC2/YR / A:1", ["DIP:D-1; nor", "PIR:U4 5'-MGC2/YR", "A:1"]),
    ("GN", 'Name="HY" {ECO:1|X:2} | Synonyms=A,B alpha; and Name=C/5;', ["HY", "A", "B alpha", "C/5"]), ("GN", "5'-TSBB;\nQIP3/5,RIA", ["5'-TSBB", "QIP3/5", "RIA"]), ("GN", "name = X;\nORFNames = 'V | and k'", ["X", "V | and k"]),
    ("GN", 'A "B', ['A "B']), ("GN", "Name=A {ECO:1, ECO:2|X:3}; {ECO:4}; B", ["A", "B"]), ("DR", "A:1. ;\r\nB:2.; .", ["A:1", "B:2."]), ("AC", "Q1;'';Q2/\"\"/Q3", ["Q1", "Q2", "Q3"]),
]


@pytest.mark.parametrize(("field", "packed", "expected"), CASES)
def test_split(spark, field, packed, expected):
    df = spark.createDataFrame([(1, *(packed if f == field else None for f in ("AC", "DR", "GN")))], "entry_key bigint, ac string, dr string, gn string")
    rows = P.split_fields(df).orderBy("pos").collect()
    assert [r.val for r in rows] == expected and [r.pos for r in rows] == list(range(1, len(expected) + 1))


def test_shuffled_rules_agree(spark, data, monkeypatch):
    u = spark.read.parquet(f"{data}/uniprot_entries.parquet")
    a = P.split_fields(u).collect()
    monkeypatch.setattr(P, "BROADCAST_RULES", 0)
    assert sorted(a) == sorted(P.split_fields(u).collect())


def test_edges(spark):
    schema = "entry_key bigint, ac string, dr string, gn string, field string, val string, pos int"
    assert P.split_fields(spark.createDataFrame([], schema)).count() == 0
    long = "; ".join(f"Q{i}" for i in range(20000))
    df = spark.createDataFrame([(1, long, None, "", "x", "y", 1), (2, "Q1", None, None, None, None, None), (3, "Q1", None, None, None, None, None)], schema)
    out = P.split_fields(df)
    assert out.columns == ["entry_key", "field", "pos", "val"] and out.count() == 20002


def test_stretches_and_rules(spark, data):
    from pyspark.sql import functions as F

    u = spark.read.parquet(f"{data}/uniprot_entries.parquet")
    for f in P.FIELDS:
        c = F.col(f.lower())
        assert u.filter(F.array_join(P.tokens_of(c, f), "") != c).count() == 0
    cut = P.stretches_of(u, "entry_key", P.FIELDS).persist()
    assert cut.filter(F.length("skeleton") > F.size("tokens")).count() == 0
    rules = cut.select("field", "skeleton").distinct().collect()
    assert len(rules) < 0.2 * cut.count() and all(P.resolve(r.field, r.skeleton)[1] > 0 for r in rules)
    cut.unpersist()
