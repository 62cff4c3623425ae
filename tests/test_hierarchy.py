import random

import pytest

from pathweave.operators.hierarchy import descendants, hierarchies

SCHEMA = "uri string, pathway string, depth_no int"


def brute(rows):
    parent = {}
    for u, p, *_ in rows:
        u, p = (u or "").strip(), (p or "").strip() or None
        if u:
            parent[u] = min((x for x in (parent.get(u), p) if x), default=None)
    out = {}
    for u in parent:
        path, x = [u], parent[u]
        while x in parent and x not in path:
            path.append(x)
            x = parent[x]
        out[u] = ("", -1, "") if x in path else (path[-1], len(path) - 1, ">".join(reversed(path)))
    n = dict.fromkeys(out, 0)
    for u, (_, d, p) in out.items():
        for a in p.split(">")[:-1] if d > 0 else []:
            n[a] += 1
    return {u: (*v, n[u] if v[1] >= 0 else -1) for u, v in out.items()}


@pytest.mark.parametrize("seed", [7])
def test_against_brute_force(spark, seed):
    random.seed(seed)
    rows = [(f"u{i}", f" u{random.randrange(max(1, i))}\n" if i % 9 else None, 1) for i in range(120)]
    rows += [("c1", "c2", 1), ("c2", "c1", 1), ("below", "c1", 1), ("self", "self", 1), ("lost", "nowhere", 1), (None, "u1", 1), (" ", "u1", 1), (" u5 ", rows[5][1], 1), ("hub", None, 1)]
    rows += [(f"h{i}", "hub", 1) for i in range(60)]
    got = {r.uri: tuple(r)[1:] for r in hierarchies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_empty_and_descendants(spark):
    assert hierarchies(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("a", None, 0), ("b", "a", 0), ("c", "b", 0), ("x", "x", 0)]
    assert {tuple(r) for r in descendants(spark.createDataFrame(rows, SCHEMA)).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


@pytest.mark.parametrize("n", [1200])
def test_chains_and_rings(spark, n):
    rows = [(f"k{i:04d}", f"k{i - 1:04d}" if i else None, 0) for i in range(n)]
    rows += [(f"r{i}", f"r{(i + 1) % 60}", 0) for i in range(60)] + [("hangs", "r5", 0), ("deeper", "hangs", 0)]
    got = {r.uri: tuple(r)[1:] for r in hierarchies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
