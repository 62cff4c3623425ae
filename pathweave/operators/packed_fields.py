"""Problem 2: several values packed in one field, one row per value with its place.

Method: a field is cut into stretches, each from one separator outside quotes to the next, by one regular expression. A stretch is cut
into tokens (labels, evidence, separators, quotes, blanks, runs of ordinary characters); its delimiter skeleton is one character a
token, ordinary runs masked and the separators at its end folded. Which tokens of a stretch are its value is decided once per distinct
skeleton, in a small parser; the rules are broadcast and applied by position. Fields have many forms, stretches few: the rules hardly
grow with the data. Cutting and applying are built-in expressions; Python sees distinct skeletons only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.runtime import BLANKS, Scratch, heavy_keys, lookup, once, ship

# The labels of gene name lines.
LABELS = ("Name", "Synonyms", "OrderedLocusNames", "ORFNames")

_LABEL = rf"(?<![^\s;,|/])(?i:{'|'.join(LABELS)})[ \t]*="
_EVIDENCE = r"\{[^{}]*\}"
_AND = r"(?i:and)(?=\s)"
#: A slash separates where nothing but blanks or separators stand beside it.
_SLASH = r"(?<![^\s;,|])/(?![^\s;,|])"
_QUOTED = r'"(?:[^"]|"")*+"'


def _stretch(field: str) -> str:
    """One stretch: what precedes a value, the value up to a separator outside quotes, the separators after it."""
    if field == "AC":
        sep, blank, before, inner = r"[\s;,|/]", r"\.", r"[\s;,|/]", ""
    else:
        sep, blank, before, inner = rf"(?:[;,|\t\n]|{_SLASH})", r"(?:[^\S\t\n]|\.)", rf"(?:[\s;,|]|{_SLASH})", ""
    if field == "GN":
        blank, before, inner = rf"(?:{blank}|{_EVIDENCE})", rf"(?:{before}|{_LABEL}|{_EVIDENCE}|{_AND})", rf"{_EVIDENCE}|(?!{_LABEL})"
    after = rf"(?={blank}*+(?:{sep}|\z))"
    value = rf"(?:{_QUOTED}|{inner}(?!{sep})[\s\S])"
    return rf"{before}*+(?:'[\s\S]*?'{after}{blank}*+|{value}++)(?:{sep}|[^\S\t\n])*+"


def _empty(field: str) -> str:
    """A stretch without a value: empty quotes, or a period alone."""
    dot = "" if field == "AC" else r"|\."
    before = rf"(?:[\s;,|/]{rf'|{_LABEL}|{_EVIDENCE}|{_AND}' if field == 'GN' else ''})"
    return rf"""^{before}*+(?:"\s*"|'\s*'{dot})?+(?:[\s;,|/.]{rf'|{_EVIDENCE}' if field == 'GN' else ''})*+\z"""


FIELDS = ("AC", "DR", "GN")
STRETCH = {f: _stretch(f) for f in FIELDS}
EMPTY = {f: _empty(f) for f in FIELDS}
#: Alternatives in order; the last takes any single character, so the tokens of a stretch joined together are the stretch.
_PLAIN_TOKENS = r"""\r?\n|\t|[^\S\t\n]+|[^\s"';,|/]+|[\s\S]"""
TOKENS = {
    "AC": _PLAIN_TOKENS,
    "DR": _PLAIN_TOKENS,
    "GN": rf"""{_LABEL}|{_EVIDENCE}|\r?\n|\t|[^\S\t\n]+|[^\s"';,|/{{}}=]+|[\s\S]""",
}
#: Rules up to this many and this wide are broadcast, some MB; were there ever more, they would be joined by a shuffle, hot skeletons apart.
BROADCAST_RULES, BROADCAST_CHARS = 50_000, 8_000_000

RULE = "field string, skeleton string, start int, length int, kind int"
PLAIN, QUOTED, APOSTROPHES, LAST_OF_LINE = 0, 1, 2, 4


def tokens_of(c: Column, field: str) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({TOKENS[field]})"), F.lit(1))


def skeleton_of(c: Column, gene_names: Column) -> Column:
    """One character a token: L label, e evidence, & and, a ordinary, n line end, t tab, _ blanks, q and p quotes, separators and a lone
    period as they are; the separators and blanks at the end as n if a line ends there, else as ;"""
    named = F.regexp_replace(F.regexp_replace(c, _LABEL, "\x01"), _EVIDENCE, "\x02")
    named = F.regexp_replace(named, r"""(?<![^\s"';,|/{}=\x01\x02])(?i:and)(?=[\s"';,|/{}=\x01\x02])""", "\x03")
    named = F.regexp_replace(F.regexp_replace(named, r"""[^\s"';,|/{}=.\x01\x02\x03][^\s"';,|/{}=\x01\x02\x03]*|\.[^\s"';,|/{}=\x01\x02\x03]+""", "a"), "[={}]", "a")
    plain = F.regexp_replace(c, r"""[^\s"';,|/.][^\s"';,|/]*|\.[^\s"';,|/]+""", "a")
    masked = F.regexp_replace(F.regexp_replace(F.when(gene_names, named).otherwise(plain), r"[^\S\t\n]+(?!\n)|[^\S\t\n\r]+(?=\r)", "_"), r"\r?\n", "n")
    masked = F.translate(masked, "\t\"'\x01\x02\x03", "tqpLe&")
    return F.regexp_replace(F.regexp_replace(masked, "[;,|/t_]*n[;,|/tn_]*$", "n"), "[;,|/t_]+$", ";")


def resolve(field: str, skeleton: str) -> tuple[int, int, int]:
    """Where the value of any stretch with this skeleton is: its first token, from 1, the number of its tokens, and its kind."""
    n = len(skeleton)

    def separates(i: int) -> bool:
        k = skeleton[i]
        if k in ";,|tn":
            return True
        if k == "_":
            return field == "AC"
        if k == "/":
            alone = (i == 0 or skeleton[i - 1] in "_tn;,|") and (i + 1 == n or skeleton[i + 1] in "_tn;,|")
            return field == "AC" or alone
        return False

    def after_quote(i: int) -> bool:
        """Whether a value may end before token i, where a quote was just closed."""
        while i < n and skeleton[i] in "_.e" and not separates(i):
            i += 1
        return i == n or separates(i)

    def closing(i: int, quote: str) -> int:
        """Where the quote opened at i closes, -1 if nowhere; a doubled quote is part of the value."""
        j = i + 1
        while j < n:
            if skeleton[j] == quote:
                if quote == "q" and skeleton[j + 1 : j + 2] == quote:
                    j += 2
                    continue
                if quote == "q" or after_quote(j + 1):
                    return j
            j += 1
        return -1

    i = 0
    while i < n and (separates(i) or skeleton[i] in "_Le" or (skeleton[i] == "&" and skeleton[i + 1 : i + 2] in ("_", "t", "n"))):
        i += 1
    start = i
    if i < n and skeleton[i] in "qp" and (end := closing(i, skeleton[i])) > 0 and after_quote(end + 1):
        return i + 2, end - i - 1, QUOTED if skeleton[i] == "q" else APOSTROPHES
    while i < n and not separates(i) and skeleton[i] not in "eL":
        if skeleton[i] == "q" and (end := closing(i, "q")) > 0:
            i = end
        i += 1
    end = i
    while end > start and skeleton[end - 1] == "_":
        end -= 1
    return start + 1, end - start, LAST_OF_LINE if "n" in skeleton[i:] else PLAIN


def _resolve_all(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        spans = [resolve(f, x) for f, x in zip(p["field"], p["skeleton"], strict=True)]
        yield p.assign(**{c: [s[k] for s in spans] for k, c in enumerate(("start", "length", "kind"))})


def stretches_of(entries: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, field, i, tokens, skeleton): every stretch of the fields that has a value, i from 0 within its field. One scan."""
    text = lambda f: F.concat(F.col(f.lower()), F.lit("\n"))  # noqa: E731  the end of a field ends its last line

    def filled_stretches(f: str) -> Column:
        return F.filter(F.regexp_extract_all(text(f), F.lit(f"({STRETCH[f]})"), F.lit(1)), lambda s: ~s.rlike(EMPTY[f]))

    cut = [F.struct(F.lit(f).alias("field"), filled_stretches(f).alias("s")) for f in fields]
    each = entries.select(key, F.inline(F.array(*cut))).select(key, "field", F.posexplode("s").alias("i", "s"))
    gene_names = F.col("field") == "GN"
    return once(each, F.col(key), F.col("field"), F.col("i"), F.when(gene_names, tokens_of(F.col("s"), "GN")).otherwise(tokens_of(F.col("s"), "AC")).alias("tokens"), skeleton_of(F.col("s"), gene_names).alias("skeleton"))


def split_fields(entries: DataFrame, key: str = "entry_key", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """p2: (key, field, pos, val), one row per value of the fields (columns of entries by their lower-case codes).

    ``pos`` counts from 1, repeated values included. Values are trimmed; enclosing quotes go and doubled ones inside become single;
    separators inside quotes don't separate, nor do those in evidence. AC splits at every separator and blank, DR and GN at ``;``, ``,``,
    ``|``, tab, line end and a slash with blanks around it. DR loses the period that closes a line or the field; GN its labels, the
    ``and`` between genes and evidence in braces. Null and empty fields have no values. A quote that is never closed is an ordinary
    character. Columns besides the key and the fields are ignored.
    """
    spark = entries.sparkSession
    ship(spark)
    scratch = Scratch(spark, "packed")
    cut, _ = scratch.write(stretches_of(entries, key, fields))
    rules, _ = scratch.write(cut.select("field", "skeleton").distinct().mapInPandas(_resolve_all, RULE))
    size = rules.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("skeleton")).alias("chars")).first()
    if size["n"] <= BROADCAST_RULES and (size["chars"] or 0) <= BROADCAST_CHARS:
        ruled = cut.join(F.broadcast(rules), ["field", "skeleton"])
    else:
        named = cut.withColumn("rule", F.concat_ws(":", "field", "skeleton")).drop("skeleton")
        table = rules.select(F.concat_ws(":", "field", "skeleton").alias("rule"), "start", "length", "kind")
        ruled = lookup(named, "rule", table, "rule", heavy_keys(named, "rule"))
    raw = ruled.select(key, "field", "i", "kind", F.array_join(F.slice("tokens", F.col("start"), F.col("length")), "").alias("raw"))
    trim = lambda c: F.btrim(c, F.lit(BLANKS))
    value = (
        F.when(F.col("kind") == QUOTED, trim(F.replace("raw", F.lit('""'), F.lit('"'))))
        .when(F.col("kind") == APOSTROPHES, trim(F.replace("raw", F.lit("''"), F.lit("'"))))
        .when((F.col("field") == "DR") & (F.col("kind") == LAST_OF_LINE), trim(F.regexp_replace(trim(F.col("raw")), r"\.$", "")))
        .otherwise(trim(F.col("raw")))
    )
    return raw.select(key, "field", (F.col("i") + 1).alias("pos"), value.alias("val")).filter("val <> ''")
