import random
import time

import pytest
from pyspark.sql import functions as F

from pathweave.operators import interactions as I

S = "reaction string, kind string, role string, ref string, molecule boolean, state string, location string, phospho string"


def roles(spark, rows):
    return spark.createDataFrame([(r, "k", role, ref, mol, *(more or ("", "", ""))) for r, role, ref, mol, *more in rows], S)


def following(rows):
    """catalysis-precedes pair by pair."""
    of = lambda role, mol: {(r, ref) for r, k, ref, m in rows if k == role and m is mol and r and ref}
    made, used = ({(a, m, r) for r, a in of("controller", False) for q, m in of(side, True) if q == r} for side in ("right", "left"))
    return sorted({(a, "catalysis-precedes", b) for a, m, r in made for b, n, q in used if m == n and r != q and a != b})


@pytest.mark.parametrize("seed", range(4))
def test_catalysis_precedes(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, *(f"r{i}" for i in range(8))]), rnd.choice(["left", "right", "controller"]), rnd.choice([None, *"abcdefghij"]), rnd.choice([True, False, True, False, None])) for _ in range((40, 80, 120, 160)[seed])]
    assert sorted(map(tuple, I.catalysis_precedes(roles(spark, rows)).collect())) == following(rows)


def test_catalysis_precedes_of_one_reaction(spark):
    """A reaction that uses what it makes: its controllers don't follow each other unless another reaction is there for one chemical."""
    rows = [("r", "controller", x, False) for x in "abc"] + [("r", side, m, True) for side in ("left", "right") for m in "xy"]
    assert I.catalysis_precedes(roles(spark, rows)).count() == 0
    rows += [("q", "controller", "a", False), ("q", "right", "y", True)]
    assert sorted(map(tuple, I.catalysis_precedes(roles(spark, rows)).collect())) == following(rows) == [("a", "catalysis-precedes", "b"), ("a", "catalysis-precedes", "c")]


def test_catalysis_precedes_many_shared(spark):
    """1000 controllers that share 1000 chemicals: the 999,000 pairs are found once, not once for each chemical."""
    n = 1000
    rows = [(r, "controller", f"a{i:04d}", False) for r in ("r", "q") for i in range(n)] + [(r, side, f"m{i:04d}", True) for r, side in (("r", "right"), ("q", "left")) for i in range(n)]
    began = time.time()
    assert I.catalysis_precedes(roles(spark, rows)).distinct().count() == n * (n - 1)
    assert time.time() - began < 60


@pytest.mark.parametrize("seed", [1])
def test_infer(spark, seed):
    """All relations from one join are those found one by one, and are counted right."""
    rnd = random.Random(seed)
    some = lambda *x: rnd.choice([None, *x])
    rows = [(some(*(f"r{i}" for i in range(30))), some("left", "left", "right", "right", "controller", "controller", "product", "participant", "component", "other"), some(*"abcdefghijklmnop"), some(True, False, True, False), some("s", "t"), some("", "x"), some("", "y")) for _ in range(400)]
    r = roles(spark, rows).unionByName(roles(spark, rows[:50])).cache()
    one_by_one = sorted(tuple(x) for f in I.RELATIONS.values() for x in f(r).collect())
    assert sorted(map(tuple, I.infer(r, tuple(I.RELATIONS)).collect())) == one_by_one
    assert dict(map(tuple, I.counts(r, tuple(I.RELATIONS)).collect())) == {k: n for k in I.RELATIONS if (n := sum(x[1] == k for x in one_by_one))}


def test_counts_many(spark):
    """20,000 controllers that share a chemical: 399,980,000 pairs, counted without being made."""
    n = 20_000
    ids = spark.range(n).select(F.concat(F.lit("a"), F.col("id")).alias("ref"))
    blank = [F.lit("").alias(c) for c in ("state", "location", "phospho")]
    both = lambda x: ids.select(F.lit(x).alias("reaction"), F.lit("k").alias("kind"), F.lit("controller").alias("role"), "ref", F.lit(False).alias("molecule"), *blank)
    r = both("r").unionByName(both("q")).unionByName(roles(spark, [("r", "right", "m", True), ("q", "left", "m", True)]))
    began = time.time()
    assert dict(map(tuple, I.counts(r).collect())) == {"catalysis-precedes": n * (n - 1), "consumption-controlled-by": n, "controls-production-of": n}
    assert time.time() - began < 60
