"""Problem 3: rows that fail to parse are set apart with the reason while the valid ones load.

Method: a recursive-descent grammar over the text of tab-separated records that recovers from errors::

    file    = record { LF record }
    record  = value { TAB value }
    value   = pad ( quoted | bare ) pad
    quoted  = '"' { any character but '"' | '""' } '"'
    bare    = { any character but '"', TAB, LF }
    pad     = { space | CR }

After a broken quote the parser doesn't look for the quote's end, which may be far off or nowhere: it resumes at the next anchor. Where
record starts are known (the lines of a table) that is the next start. Where they aren't (the text of a file) it is the next line
start, even one inside the broken value, from which a record can be read whose first value is valid. Every record comes out typed or
as a located error. Where each quote closes is found for a text once, from its end, so parsing is linear in the text, however many
quotes are left open.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.runtime import ship, spread

PAD = " \r"
#: The registry is a fixed list; a longer one than this is refused, as its patterns go to every task.
MOST_PATTERNS = 10_000
QUOTING, COLUMN_COUNT, INVALID_VALUE = "quoting", "column_count", "invalid_value"


@dataclass
class Record:
    """One record: its values, or the first reason why it is none, at which character of the text."""

    start: int
    values: list[str]
    reason: str | None = None
    error_at: int | None = None


class BrokenQuote(Exception):
    """A double quote where none may stand, or one that isn't closed; args: its place."""


class Grammar:
    """Reads one text. is_valid says whether a value may stand in a column, from 0; starts are the record starts, if known, ascending:
    a record then ends one character before the next one's start."""

    _BARE = re.compile(r'[^"\t\n]*')
    _PAD = re.compile(f"[{PAD}]*")

    def __init__(self, text: str, is_valid: Callable[[int, str], bool], columns: int = 2, starts: list[int] | None = None):
        self.text, self.is_valid, self.columns, self.starts = text, is_valid, columns, starts
        self.closes = self._closes(text)

    @staticmethod
    def _closes(text: str) -> dict[int, int]:
        """Each double quote's place -> where a value opened there closes; quotes that are never closed are left out."""
        places = [m.start() for m in re.finditer('"', text)]
        after: list[int | None] = [None] * (len(places) + 2)  # the first quote from the k-th on that isn't doubled
        for k in range(len(places) - 1, -1, -1):
            doubled = k + 1 < len(places) and places[k + 1] == places[k] + 1
            after[k] = after[k + 2] if doubled else places[k]
        return {at: after[k + 1] for k, at in enumerate(places) if after[k + 1] is not None}

    def file(self) -> Iterator[Record]:
        """Every record of the text."""
        if self.starts is not None:
            for at, end in zip(self.starts, [*(s - 1 for s in self.starts[1:]), len(self.text)], strict=True):
                yield self.recovered(at, end)[0]
            return
        at = 0
        while at <= len(self.text):
            record, at = self.recovered(at, len(self.text))
            yield record

    def recovered(self, at: int, limit: int) -> tuple[Record, int]:
        """The record at this place, which ends at limit at the latest, or its error, and where the next one starts."""
        try:
            values, places, end = self.record(at, limit)
        except BrokenQuote as e:
            return Record(at, [], QUOTING, e.args[0]), self.anchor(at) if self.starts is None else limit + 1
        if self.starts is not None and end < limit:
            return Record(at, values, COLUMN_COUNT, end), limit + 1
        return self.typed(at, values, places, end), end + 1

    def typed(self, at: int, values: list[str], places: list[int], end: int) -> Record:
        if len(values) != self.columns or not self.text[at:end].strip():
            return Record(at, values, COLUMN_COUNT, places[min(len(places) - 1, self.columns)])
        for k, v in enumerate(values):
            if not self.is_valid(k, v):
                return Record(at, values, INVALID_VALUE, places[k])
        return Record(at, values)

    def record(self, at: int, limit: int) -> tuple[list[str], list[int], int]:
        values, places = [], []
        while True:
            v, place, at = self.value(at, limit)
            values.append(v)
            places.append(place)
            if at == limit or self.text[at] == "\n":
                return values, places, at
            at += 1  # the tab

    def value(self, at: int, limit: int) -> tuple[str, int, int]:
        place = self.pad(at, limit)
        if place == limit or self.text[place] != '"':
            return self.bare(place, limit)
        end = self.closes.get(place, limit)
        if end >= limit:
            raise BrokenQuote(place)
        at = self.pad(end + 1, limit)
        if at < limit and self.text[at] not in "\t\n":
            raise BrokenQuote(at)
        return self.text[place + 1 : end].replace('""', '"'), place, at

    def pad(self, at: int, limit: int) -> int:
        return self._PAD.match(self.text, at, limit).end()

    def bare(self, at: int, limit: int) -> tuple[str, int, int]:
        end = self._BARE.match(self.text, at, limit).end()
        if end < limit and self.text[end] == '"':
            raise BrokenQuote(end)
        return self.text[at:end].rstrip(PAD), at, end

    def anchor(self, at: int) -> int:
        """The next line start from which a record with a valid first value can be read; past the text if there is none."""
        while (at := self.text.find("\n", at)) >= 0:
            at += 1
            try:
                values, _, _ = self.record(at, len(self.text))
            except BrokenQuote:
                continue
            if len(values) == self.columns and self.is_valid(0, values[0]):
                return at
        return len(self.text) + 1


PARSED = "line_id bigint, src_db string, src_id string, dst_db string, dst_id string, reason string, error_at int"


TEXT_RECORD = "text_id bigint, record_no int, start_at bigint, src_db string, src_id string, dst_db string, dst_id string, reason string, error_at bigint"


def _validity(patterns: dict[str, str]) -> Callable[[str | None, str | None], Callable[[int, str], bool]]:
    compiled = {k: re.compile(v) for k, v in patterns.items()}

    def of(src: str | None, dst: str | None) -> Callable[[int, str], bool]:
        pair = compiled.get(src), compiled.get(dst)
        return lambda k, v: pair[k] is not None and pair[k].fullmatch(v) is not None

    return of


def _parse_lines(patterns: dict[str, str]) -> Callable:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        validity = _validity(patterns)
        for part in parts:
            # the lines of a batch that are of the same two databases are one text; where each starts is known
            for _, lines in part.groupby(["src_db", "dst_db"], dropna=False, sort=False):
                src, dst = (None if pd.isna(x) else x for x in lines[["src_db", "dst_db"]].iloc[0])
                raw = [x if isinstance(x, str) else "" for x in lines["raw_line"]]
                starts = list(accumulate((len(x) + 1 for x in raw[:-1]), initial=0))
                records = list(Grammar("\n".join(raw), validity(src, dst), starts=starts).file())
                good = [r.values if r.reason is None else (None, None) for r in records]
                yield pd.DataFrame({
                    "line_id": lines["line_id"].to_numpy(), "src_db": src, "src_id": [v[0] for v in good], "dst_db": dst, "dst_id": [v[1] for v in good],
                    "reason": [r.reason for r in records], "error_at": pd.array([None if r.error_at is None else r.error_at - r.start for r in records], dtype="Int32"),
                })

    return run


def _parse_texts(patterns: dict[str, str]) -> Callable:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        validity = _validity(patterns)
        for part in parts:
            for text_id, src, dst, text in zip(part["text_id"], part["src_db"], part["dst_db"], part["text"], strict=True):
                if not isinstance(text, str) or not text:
                    continue
                rows = []
                for n, r in enumerate(Grammar(text.removesuffix("\n"), validity(src, dst)).file()):
                    a, b = r.values if r.reason is None else (None, None)
                    rows.append((text_id, n, r.start, src, a, dst, b, r.reason, r.error_at))
                yield pd.DataFrame(rows, columns=["text_id", "record_no", "start_at", "src_db", "src_id", "dst_db", "dst_id", "reason", "error_at"]).astype({"error_at": "Int64"})

    return run


def _patterns(registry: DataFrame) -> dict[str, str]:
    names = registry.select("db_name", "id_pattern").dropna().take(MOST_PATTERNS + 1)
    if len(names) > MOST_PATTERNS:
        raise ValueError(f"the registry has more than {MOST_PATTERNS} patterns")
    return {r["db_name"]: r["id_pattern"] for r in names}


def parse_lines(lines: DataFrame, registry: DataFrame) -> DataFrame:
    """p3: every line of lines (line_id, src_db, dst_db, raw_line) parsed: src_id and dst_id of a valid one, else reason and error_at.

    registry (db_name, id_pattern) is a fixed reference list; its patterns go to the tasks with the code. Reasons, the first that
    holds: ``quoting``, ``column_count`` (null and blank lines too), ``invalid_value`` (also where a database has no pattern).
    A row is one record: a line end inside it can only be part of a quoted value. Equal lines under other ids are parsed each; columns
    besides those named are ignored; an empty table gives no rows.
    """
    ship(lines.sparkSession)
    return spread(lines.select("line_id", "src_db", "dst_db", "raw_line")).mapInPandas(_parse_lines(_patterns(registry)), PARSED)


def parse_texts(texts: DataFrame, registry: DataFrame) -> DataFrame:
    """p3: every record of whole texts (text_id, src_db, dst_db, text): its number and place, its values, or reason and error_at.

    Values may hold line ends in quotes. After a broken quote, reading goes on at the next anchor, so what follows is kept; the lines up
    to there belong to the error. Null and empty texts have no records. A text is read in one task.
    """
    ship(texts.sparkSession)
    return spread(texts.select("text_id", "src_db", "dst_db", "text")).mapInPandas(_parse_texts(_patterns(registry)), TEXT_RECORD)


def failing_lines(lines: DataFrame, registry: DataFrame) -> DataFrame:
    """The lines that fail, with their reason."""
    return parse_lines(lines, registry).filter(F.col("reason").isNotNull()).select("line_id", "reason")
