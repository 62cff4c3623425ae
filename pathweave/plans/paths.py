"""GRA8: path expressions ``Type/prop[:Filter]/prop*[:Filter]`` compiled to chains of joins."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.model import INVERSES, SPECIAL, Model, subtypes
from pathweave.operators.graph import distances
from pathweave.runtime import Scratch

_STEP = re.compile(r"([A-Za-z]\w*)(\*)?(?::([A-Za-z]\w*))?")


@dataclass(frozen=True)
class Step:
    prop: str
    transitive: bool
    only: str | None


def parse(path: str) -> tuple[str, list[Step]]:
    """The class a path starts from and its steps; ValueError if it doesn't begin with a class and a step, or is malformed."""
    first, *rest = path.strip().split("/")
    if not first or not rest:
        raise ValueError(f"a path begins with a class: {path!r}")
    steps = []
    for part in rest:
        m = _STEP.fullmatch(part)
        if not m:
            raise ValueError(f"malformed step {part!r} in {path!r}")
        steps.append(Step(m[1], bool(m[2]), m[3]))
    return first, steps


def _edges(model: Model, prop: str) -> DataFrame:
    """The edges of a property, of its sub-properties, or, by an inverse's name, backwards."""
    forward = {v: k for k, v in INVERSES.items()}
    name = forward.get(prop, prop[:-2] if prop.endswith("Of") and prop != "Of" else prop)
    names = [name, *SPECIAL.get(name, ())]
    if prop in forward or (prop.endswith("Of") and prop not in ("partOf",)):
        return model.edges.filter(F.col("prop").isin(names)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return model.edges.filter(F.col("prop").isin([prop, *SPECIAL.get(prop, ())])).select("src", "dst")


def traverse(model: Model, path: str, starts: DataFrame | None = None) -> DataFrame:
    """(uri, value): the distinct values a path reaches from each start (uri) of the path's class; all elements of the class without starts.

    Object values are URIs, data values strings. Starts of another class, or from which nothing is reached, have no row.
    """
    first, steps = parse(path)
    scratch = Scratch(model.elements.sparkSession, "traverse")
    at = model.of_type(first).select("uri")
    if starts is not None:
        at = at.join(starts.select("uri").distinct(), "uri", "left_semi")
    at = at.select(F.col("uri").alias("start"), "uri")
    for k, s in enumerate(steps):
        if k == len(steps) - 1 and not s.transitive and not s.only:
            data = model.literals.filter(F.col("prop") == s.prop).select("uri", F.col("value").alias("next"))
            e = _edges(model, s.prop)
            reached = e.select(F.col("src").alias("uri"), F.col("dst").alias("next")).unionByName(data)
            return at.join(reached, "uri").select(F.col("start").alias("uri"), F.col("next").alias("value")).distinct()
        e = _edges(model, s.prop)
        if s.transitive:
            e, _ = scratch.write(e)
            step = distances(e, at.select(F.col("start"), "uri"), None, scratch, "start").filter("dist > 0").select("start", "uri")
        else:
            step = at.join(e, at["uri"] == e["src"]).select("start", F.col("dst").alias("uri")).distinct()
        if s.only:
            kinds = model.elements.filter(F.col("type").isin(subtypes(s.only, model.classes))).select("uri")
            step = step.join(kinds, "uri", "left_semi").select("start", "uri")
        at = step
    return at.select(F.col("start").alias("uri"), F.col("uri").alias("value")).distinct()
