"""FIL7, FIL8: the search language read into a tree, and the tree into a condition on search documents.

    query  = clause { [AND | OR] clause }          words side by side are OR-ed
    clause = [+ | - | NOT] ( '(' query ')' | [field ':'] ( word | "phrase" | '(' query ')' ) )

Words may hold ``?`` and ``*`` (a leading one too) and escapes by a backslash. A field of exact values compares as typed, case and all;
an analysed field compares tokens, and a word of several tokens matches any of them, a phrase all side by side.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from dataclasses import field as of

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathweave.functions.text import STOP_WORDS

#: Search fields -> the document's column of values, and whether it holds exact values or tokens.
FIELDS = {
    "keyword": ("keywords", False), "name": ("names", True), "xrefid": ("xref_ids", True), "uri": ("uris", True), "pathway": ("pathways", True),
    "organism": ("organisms", False), "datasource": ("datasources", False), "type": ("types", False),
}
DEFAULT_FIELDS = ("keyword", "name", "xrefid")


@dataclass
class Node:
    """kind: word, phrase, all, and, or, not; text and field of a leaf, parts of the others."""

    kind: str
    text: str = ""
    field: str | None = None
    parts: list[Node] = of(default_factory=list)


_TOKEN = re.compile(r'\s+|(?P<op>\(|\)|&&|\|\||[+\-!](?=\S))|"(?P<phrase>(?:\\.|[^"\\])*)"|(?P<field>[A-Za-z_]\w*):(?=\S)|(?P<word>(?:\\.|[^\s()"\\:])+(?:(?::|\\.)(?:\\.|[^\s()"\\])*)?)')


class Parser:
    def __init__(self, query: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(query):
            m = _TOKEN.match(query, at)
            if not m:
                raise ValueError(f"can't read the query at {at}: {query!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def query(self, name: str | None = None) -> Node:
        """Clauses with their operators: AND binds its neighbours as required, NOT and - as excluded, others are optional."""
        must, may, never = [], [], []
        last: Node | None = None
        last_in = may
        while self.peek()[0] != "end" and self.peek() != ("op", ")"):
            kind, text = self.peek()
            joined = None
            if (kind, text) in (("word", "AND"), ("op", "&&")):
                joined = "and"
                self.take()
            elif (kind, text) in (("word", "OR"), ("op", "||")):
                joined = "or"
                self.take()
            sign = ""
            while self.peek() in (("op", "+"), ("op", "-"), ("op", "!"), ("word", "NOT")):
                sign = "+" if self.take()[1] == "+" else "-"
            node = self.clause(name)
            if joined == "and" and last is not None and last_in is may:
                may.remove(last)
                must.append(last)
            into = never if sign == "-" else must if sign == "+" or joined == "and" else may
            into.append(node)
            last, last_in = node, into
        if not (must or may or never):
            raise ValueError("an empty query")
        parts = [*must, *([Node("or", parts=may)] if may and not must else [])]
        parts += [Node("not", parts=[n]) for n in never]
        if not must and not may:
            raise ValueError("a query of excluded words only")
        return parts[0] if len(parts) == 1 else Node("and", parts=parts)

    def clause(self, name: str | None) -> Node:
        kind, text = self.take()
        if kind == "field":
            if text not in FIELDS:
                raise ValueError(f"no field {text}")
            return self.clause(text)
        if (kind, text) == ("op", "("):
            inner = self.query(name)
            if self.take() != ("op", ")"):
                raise ValueError("a bracket isn't closed")
            return inner
        if kind == "phrase":
            return Node("phrase", re.sub(r"\\(.)", r"\1", text), name)
        if kind == "word":
            return Node("all") if text == "*" and name is None else Node("word", text, name)
        raise ValueError(f"unexpected {text!r}")


def parse(query: str) -> Node:
    """The tree of a query; ValueError if it is malformed or empty."""
    p = Parser(query)
    tree = p.query()
    if p.peek()[0] != "end":
        raise ValueError("a bracket too many")
    return tree


def analyse(text: str) -> list[str]:
    return [w for w in re.findall(r"[^\W_]+", text.lower()) if w not in STOP_WORDS]


def _pattern(word: str) -> str | None:
    """A word with wildcards as a regular expression; None if it has none."""
    out, wild, i = "", False, 0
    while i < len(word):
        ch = word[i]
        if ch == "\\" and i + 1 < len(word):
            i += 1
            out += re.escape(word[i])
        elif ch in "*?":
            out += ".*" if ch == "*" else "."
            wild = True
        else:
            out += re.escape(ch)
        i += 1
    return f"^(?s:{out})$" if wild else None


def _leaf(node: Node, name: str) -> Column:
    column, exact = FIELDS[name]
    values = F.col(column)
    plain = re.sub(r"\\(.)", r"\1", node.text)
    if node.kind == "phrase":
        if exact:
            return F.array_contains(values, plain)
        words = analyse(plain)
        return F.contains(F.concat(F.lit(" "), F.concat_ws(" ", values), F.lit(" ")), F.lit(f" {' '.join(words)} ")) if words else F.lit(False)
    pattern = _pattern(node.text)
    if pattern is not None:
        pattern = pattern if exact else pattern.lower().replace("(?s:", "(?s:")
        return F.exists(values, lambda v: v.rlike(pattern))
    if exact:
        return F.array_contains(values, plain)
    words = analyse(plain)
    return F.arrays_overlap(values, F.array(*map(F.lit, words))) if words else F.lit(False)


def condition(node: Node, default: tuple[str, ...] = DEFAULT_FIELDS) -> Column:
    """The tree as a condition on search documents."""
    if node.kind == "all":
        return F.lit(True)
    if node.kind in ("word", "phrase"):
        out = F.lit(False)
        for name in [node.field] if node.field else default:
            out = out | _leaf(node, name)
        return out
    parts = [condition(n, default) for n in node.parts]
    if node.kind == "not":
        return ~parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if node.kind == "and" else out | p
    return out


def scored_terms(node: Node) -> list[str]:
    """The analysed words that count for the score: those of leaves not under NOT."""
    if node.kind in ("word", "phrase"):
        return analyse(re.sub(r"\\(.)", r"\1", node.text))
    if node.kind == "not":
        return []
    return list(dict.fromkeys(t for n in node.parts for t in scored_terms(n)))
