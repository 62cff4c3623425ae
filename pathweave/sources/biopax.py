"""XML sources: BioPAX Level 3 RDF/XML as elements, edges and literals (SRC1, SRC2), PSI-MI XML (SRC9, SRC11), archives (SRC3, SRC4)."""

from __future__ import annotations

import gzip
import io
import os
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.functions.text import sanitized_file
from pathweave.model import Model
from pathweave.runtime import ship

RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
XML_BASE = "{http://www.w3.org/XML/1998/namespace}base"
BIOPAX = "{http://www.biopax.org/release/biopax-level3.owl#}"
TRIPLE = "kind string, uri string, name string, value string"


def triples(content: bytes) -> Iterator[tuple[str, str, str, str | None]]:
    """(element, uri, class, None), (edge, uri, property, target), (literal, uri, property, value) of one RDF/XML document.

    ``rdf:ID`` is relative to ``xml:base``, ``rdf:about`` is as it stands, a ``rdf:resource`` starting with ``#`` is a local one. White
    space in values is collapsed. Elements are read one by one; nested ones count as well.
    """
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    base = ""

    def uri_of(e: ElementTree.Element) -> str | None:
        if (i := e.get(f"{RDF}ID")) is not None:
            return f"{base}{'' if base.endswith(('#', '/', ':')) or not base else '#'}{i}"
        return e.get(f"{RDF}about")

    def target(ref: str) -> str:
        return f"{base}{'' if base.endswith(('#', '/', ':')) or not base else '#'}{ref[1:]}" if ref.startswith("#") else ref

    def read(e: ElementTree.Element) -> Iterator[tuple[str, str, str, str | None]]:
        uri = uri_of(e)
        if uri is None or not e.tag.startswith(BIOPAX):
            return
        yield "element", uri, e.tag[len(BIOPAX) :], None
        for p in e:
            if not p.tag.startswith(BIOPAX):
                continue
            name = p.tag[len(BIOPAX) :]
            if (ref := p.get(f"{RDF}resource")) is not None:
                yield "edge", uri, name, target(ref)
            elif len(p):
                for inner in p:
                    if (u := uri_of(inner)) is not None:
                        yield "edge", uri, name, u
                        yield from read(inner)
            elif (text := " ".join((p.text or "").split())) != "":
                yield "literal", uri, name, text

    depth = 0
    for event, e in ElementTree.iterparse(io.BytesIO(content), events=("start", "end")):
        if event == "start":
            depth += 1
            if depth == 1:
                base = e.get(XML_BASE, "")
        else:
            depth -= 1
            if depth == 1:
                yield from read(e)
                e.clear()


def _read_all(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for content in part["content"]:
            rows = []
            for row in triples(bytes(content)):
                rows.append(row)
                if len(rows) == 50_000:
                    yield pd.DataFrame(rows, columns=["kind", "uri", "name", "value"])
                    rows = []
            yield pd.DataFrame(rows, columns=["kind", "uri", "name", "value"])


def read_biopax(spark: SparkSession, path: str, datasource: str | None = None, merge_duplicates: bool = True) -> Model:
    """SRC1, SRC2: the model of BioPAX files (a file a task; gzipped or not), objects of equal uri merged."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    t = files.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInPandas(_read_all, TRIPLE)
    m = Model(
        t.filter("kind = 'element'").select("uri", F.col("name").alias("type"), F.lit(datasource).cast("string").alias("datasource")),
        t.filter("kind = 'edge'").select(F.col("uri").alias("src"), F.col("name").alias("prop"), F.col("value").alias("dst")),
        t.filter("kind = 'literal'").select("uri", F.col("name").alias("prop"), "value"),
    )
    return m.deduplicated() if merge_duplicates else m


def read_psimi(spark: SparkSession, path: str, complexes: bool = False) -> DataFrame:
    """SRC9, SRC11: (interaction, participant, db, id) of PSI-MI XML; complexes gives (complex, members) with the members in one set."""
    attr = "struct<_db:string,_id:string>"
    schema = f"_id string, participantList struct<participant:array<struct<_id:string,interactor:struct<names:struct<shortLabel:string>,xref:struct<primaryRef:{attr}>>>>>"
    rows = spark.read.format("xml").option("rowTag", "interaction").schema(schema).load(path)
    each = rows.select(F.col("_id").alias("interaction"), F.explode("participantList.participant").alias("p"))
    flat = each.select("interaction", F.col("p.interactor.names.shortLabel").alias("participant"), F.col("p.interactor.xref.primaryRef._db").alias("db"), F.col("p.interactor.xref.primaryRef._id").alias("id"))
    if not complexes:
        return flat
    return flat.groupBy(F.col("interaction").alias("complex")).agg(F.sort_array(F.collect_set(F.concat_ws(":", "db", "id"))).alias("members"))


def skipped_entry(name: str) -> bool:
    """FIL22: folders, system and hidden entries of an archive aren't data."""
    parts = name.split("/")
    return name.endswith("/") or "__MACOSX" in parts or parts[-1].startswith(".") or not parts[-1]


def expand_archive(path: str, folder: str) -> list[str]:
    """SRC3: each data entry of a zip archive as a gzip file in the folder; what is there already stays. Returns the files."""
    os.makedirs(folder, exist_ok=True)
    out = []
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            if skipped_entry(name):
                continue
            to = sanitized_file(folder, name)
            out.append(to)
            if not os.path.exists(to):
                with z.open(name) as source, gzip.open(to + ".part", "wb") as sink:
                    while chunk := source.read(1 << 20):
                        sink.write(chunk)
                os.rename(to + ".part", to)
    return out
