"""Text functions (SCA11, SCA14-SCA19, SCA30-SCA32, SCA35) and the analysis of search fields."""

from __future__ import annotations

import re
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markup and character references that names carry.
NAME_TAGS = ("i", "sub", "sup")
NAME_REFERENCES = ("alpha", "beta", "gamma", "delta", "epsilon")
# The usual English stop words of full-text search.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_name_markup(name: Column | str) -> Column:
    """SCA11: a name without i, sub and sup tags, Greek letters' references (escaped once more or not) as their names."""
    tags = F.regexp_replace(_c(name), f"(?i)</?(?:{'|'.join(NAME_TAGS)})>", "")
    for ref in NAME_REFERENCES:
        tags = F.regexp_replace(tags, f"(?i)&(?:amp;)?{ref};", ref)
    return tags


def strip_markup(html: Column | str) -> Column:
    """All tags removed and blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(html), r"<[^>]*>", " "), r"\s+", " "))


def unescape(text: Column | str) -> Column:
    """SCA31: the five predefined character references resolved; the ampersand last."""
    out = _c(text)
    for ref, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(ref), F.lit(ch))
    return out


def truncate_query(q: Column | str, length: int = 128) -> Column:
    """SCA30."""
    return F.substring(_c(q), 1, length)


def capitalized(names: Column | str) -> Column:
    """SCA18: a source's standard name, its second name if there is one, else the first, with a capital first letter."""
    n = _c(names)
    name = F.when(F.size(n) > 1, F.element_at(n, 2)).otherwise(F.element_at(n, 1))
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30))


def name_variants(*names: Column | str) -> Column:
    """SCA35: the distinct names with their lower-case copies, sorted; nulls left out."""
    a = F.filter(F.array(*map(_c, names)), lambda x: x.isNotNull())
    return F.sort_array(F.array_distinct(F.concat(a, F.transform(a, F.lower))))


def tokens(text: Column | str, stop_words: bool = True) -> Column:
    """FIL9: a text's tokens for search: lower case, cut at everything but letters and digits, stop words dropped."""
    words = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS)) if stop_words else words


def sanitized_file(folder: str, entry: str) -> str:
    """SCA14: where an archive's entry is expanded to."""
    return f"{folder}/{re.sub('[^a-zA-Z0-9.-]', '_', entry)}.orig.gz"


STAGES = ("cleaned", "converted", "normalized", "issues")


def stage_file(path: str, stage: str) -> str:
    """SCA14: the file of a later stage: the last suffix before .gz replaced."""
    if stage not in STAGES:
        raise ValueError(f"no stage {stage}")
    return re.sub(r"[^.]+\.gz$", f"{stage}.gz", path, count=1)


def taxonomy_names(organisms: list[str]) -> dict[str, str]:
    """SCA15: taxon id -> name of configured organisms like ``Homo sapiens (9606)``; ValueError where the id is missing."""
    out = {}
    for o in organisms:
        m = re.fullmatch(r"\s*([^()]*?)\s*\(\s*(\d+)\s*\)\s*", o)
        if not m:
            raise ValueError(f"no taxonomy id in {o!r}")
        out[m[2]] = m[1]
    return out


class Format(Enum):
    """Output formats; tags are read in any case, with ``-`` or ``_``."""

    BINARY_SIF = "sif"
    EXTENDED_BINARY_SIF = "txt"
    GSEA = "gmt"
    SBGN = "sbgn"
    JSONLD = "jsonld"
    BIOPAX = "owl"


class Graph(Enum):
    """Kinds of graph query."""

    NEIGHBORHOOD = 1
    PATHSBETWEEN = 2
    PATHSFROMTO = 3
    COMMONSTREAM = 4


class Direction(Enum):
    UPSTREAM = 1
    DOWNSTREAM = 2
    BOTHSTREAM = 3
    UNDIRECTED = 4


def parse_enum(kind: type[Enum], tag: str | None) -> Enum | None:
    """SCA16, HLP7: the member of this name; None if there is none."""
    return kind.__members__.get((tag or "").strip().upper().replace("-", "_"))


def parse_format(tag: str | None) -> Format | None:
    """SCA16: the format of this name, or of this file suffix (TXT and gmt as well as EXTENDED_BINARY_SIF and GSEA); None if there is none."""
    return parse_enum(Format, tag) or next((f for f in Format if f.value == (tag or "").strip().lower()), None)


def split_arguments(*values: str) -> list[str]:
    """SCA17: repeated and comma-separated arguments as one list, each once, in order."""
    parts = (p.strip() for v in values for p in v.split(","))
    return list(dict.fromkeys(p for p in parts if p))


def valid_source_id(identifier: str) -> bool:
    """SCA19: not blank, no white space or hyphen."""
    return bool(identifier) and not re.search(r"[\s-]", identifier)


def result_name(kind: str, parts: list[str]) -> str:
    """SCA32: a name for a result model, from the query's kind and arguments, the same for the same query."""
    import hashlib

    return f"graph_{kind}_{hashlib.md5('|'.join(sorted(parts)).encode()).hexdigest()[:12]}"
