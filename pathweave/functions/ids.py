"""Identifier functions (SCA1-SCA10, SCA12-SCA13) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fix_id_for_mapping(db: Column | str, id_: Column | str, kegg_suffix: bool = True) -> Column:
    """SCA1: the id in the form used for mapping, by its database.

    UniProt loses an isoform suffix ``-N``, RefSeq a version ``.N``; CHEBI is upper-cased and gets its prefix; a digits-only PubChem
    substance or compound gets ``SID:`` or ``CID:``. KEGG ``org:N`` becomes ``N`` where kegg_suffix is set; else only an id that is
    wholly ``:N`` does, as the stored mapping form has it. Null in, null out.
    """
    d, i = F.upper(_c(db)), _c(id_)
    up = F.upper(i)
    digits = i.rlike(r"^[0-9]+$")
    kegg = i.rlike(r":[0-9]+$") if kegg_suffix else i.rlike(r"^:[0-9]+$")
    pubchem = d.contains("PUBCHEM")
    substance = d.contains("SUBSTANCE") | d.contains("SID")
    compound = d.contains("COMPOUND") | d.contains("CID")
    return (
        F.when(d.startswith("UNIPROT"), F.when(i.contains("-"), F.regexp_replace(i, r"-[0-9]+$", "")).otherwise(i))
        .when(d == "CHEBI", F.when(up.startswith("CHEBI:"), up).otherwise(F.concat(F.lit("CHEBI:"), up)))
        .when(d == "REFSEQ", F.when(i.contains("."), F.regexp_replace(i, r"\.[0-9]+$", "")).otherwise(i))
        .when(d.startswith("KEGG") & kegg, F.substring_index(i, ":", -1))
        .when(pubchem & substance, F.when(digits, F.concat(F.lit("SID:"), up)).otherwise(up))
        .when(pubchem & compound, F.when(digits, F.concat(F.lit("CID:"), up)).otherwise(up))
        .otherwise(i)
    )


REGISTRIES = ("identifiers.org/", "bioregistry.io/")


def _normalized(u: Column) -> Column:
    low = F.lower(u)
    return low.contains(REGISTRIES[0]) | low.contains(REGISTRIES[1])


def id_from_uri(uri: Column | str) -> Column:
    """SCA2: the id in a registry URI: the last path part without its prefix, with CHEBI:, SID: or CID: put before such ids.

    Null for URIs of no registry.
    """
    u = _c(uri)
    last = F.substring_index(u, "/", -1)
    bare = F.when(last.contains(":"), F.regexp_replace(last, r"^[^:]*:", "")).otherwise(last)
    low = F.lower(u)
    prefixed = (
        F.when(low.contains("substance"), F.concat(F.lit("SID:"), bare))
        .when(low.contains("compound") | low.contains("pubchem"), F.concat(F.lit("CID:"), bare))
        .when(low.contains("chebi"), F.concat(F.lit("CHEBI:"), bare))
        .otherwise(bare)
    )
    return F.when(_normalized(u), prefixed)


def rebase_uri(uri: Column | str, to_base: str | None, from_base: str | None = None) -> Column:
    """SCA3: the URI under another base.

    With from_base, that prefix is replaced wherever the URI starts with it. Without, registry URIs and CURIEs stay; of others the part
    after the last ``#``, or else the last ``/``, is put under the new base, and a bare name gets it in front.
    """
    u, to = _c(uri), F.lit(to_base.strip() and to_base if to_base else "")
    if from_base and from_base.strip():
        return F.when(u.startswith(from_base), F.replace(u, F.lit(from_base), to)).otherwise(u)
    keep = u.contains(REGISTRIES[0]) | u.contains(REGISTRIES[1])
    return (
        F.when(keep, u)
        .when(~u.rlike("[:/#]"), F.concat(to, u))
        .when(u.contains("#"), F.concat(to, F.substring_index(u, "#", -1)))
        .when(u.contains("/"), F.concat(to, F.substring_index(u, "/", -1)))
        .otherwise(u)
    )


def rebase_unique(uri: Column | str, new: Column | str, taken: Column | str) -> Column:
    """SCA4: the rebased URI, with an underscore and the md5 of the old one behind it where another element has it already."""
    old, n = _c(uri), _c(new)
    return F.when((old != n) & _c(taken), F.concat(n, F.lit("_"), F.md5(old))).otherwise(n)


def local_part(uri: Column | str, colons: bool = False) -> Column:
    """SCA5, SCA6: what follows the last ``/`` or ``#`` (also ``:`` where colons is set), a trailing slash ignored."""
    u = F.regexp_replace(_c(uri), "/$", "")
    return F.regexp_replace(u, "^.*[/#:]" if colons else "^.*[/#]", "")


def lower_prefix(id_: Column | str) -> Column:
    """SCA7: ``CHEBI:1`` as ``chebi:1``; ids without a colon as they are."""
    i = _c(id_)
    return F.when(i.contains(":"), F.concat(F.lower(F.substring_index(i, ":", 1)), F.regexp_replace(i, "^[^:]*", ""))).otherwise(i)


def with_prefix(id_: Column | str, prefix: str = "CHEBI:") -> Column:
    """SCA8: the id with its prefix."""
    i = _c(id_)
    return F.when(i.startswith(prefix), i).otherwise(F.concat(F.lit(prefix), i))


# Patterns of UniProt isoform and RefSeq ids in queries.
ISOFORM = r"^([A-N,R-Z][0-9]([A-Z][A-Z, 0-9][A-Z, 0-9][0-9]){1,2}|[O,P,Q][0-9][A-Z, 0-9][A-Z, 0-9][A-Z, 0-9][0-9])-[0-9]+$"
REFSEQ = r"^(AC|AP|NC|NG|NM|NP|NR|NT|NW|XM|XP|XR|YP|ZP)_[0-9]+(\.[0-9]+)?$"


def guess_id(id_: Column | str, to_db: str) -> Column:
    """SCA9: a query id in the form that the mapping to to_db (CHEBI or UNIPROT) is stored under."""
    i = _c(id_)
    if to_db.upper() == "CHEBI":
        return F.when(i.rlike("^[0-9]+$"), F.concat(F.lit("CHEBI:"), i)).otherwise(i)
    if to_db.upper() != "UNIPROT":
        raise ValueError("ids are mapped to CHEBI or UNIPROT only")
    return F.when(i.rlike(ISOFORM), F.regexp_replace(i, "-[0-9]+$", "")).when(i.rlike(REFSEQ), F.regexp_replace(i, r"\.[0-9]+$", "")).otherwise(i)


def valid_id(id_: Column | str, pattern: Column | str) -> Column:
    """SCA10: whether the id matches its registry pattern as a whole."""
    p = _c(pattern)
    return F.rlike(_c(id_), F.concat(F.lit("^(?:"), p, F.lit(r")\z")))


def encode_id(id_: Column | str) -> Column:
    """SCA12: everything but letters, digits, ``_`` and ``-`` as ``_``."""
    return F.regexp_replace(_c(id_), r"[^-\w]", "_")


def starts_with_any(value: Column | str, *prefixes: str) -> Column:
    """SCA13: whether the value starts with any of the prefixes, in any case; false for null."""
    low = F.lower(_c(value))
    out = F.lit(False)
    for p in prefixes:
        out = out | low.startswith(p.lower())
    return F.coalesce(out, F.lit(False))


def relationship_xref_uri(db: Column | str, id_: Column | str, term: str = "") -> Column:
    """SCA20: one URI for each database, id and relationship type, so equal references meet."""
    return F.concat_ws("_", F.lit("RelationshipXref"), F.md5(F.concat_ws("|", F.lower(_c(db)), _c(id_), F.lit(term))))


def mapping_key(src_db: Column | str, src_id: Column | str, dst_db: Column | str, dst_id: Column | str) -> Column:
    """AGG14: the key of a mapping row, the md5 of its four fields."""
    return F.md5(F.concat_ws("|", _c(src_db), _c(src_id), _c(dst_db), _c(dst_id)))
