"""Tables of a page by a stack parser (B1, B2 where patterns don't do).

The regular-expression form (``operators.pages.extract_rows``) cuts flat
markup inside the JVM.  Pages with nested tables, comments or scripts that hold
markup, or attributes that hold ``>`` go through the standard library's HTML
parser, batch by batch (``mapInPandas``); each page is parsed by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketflow.session import ship_package

OUT_ROWS = 10_000          # rows handed back at once
_BREAK = re.compile(r"[ \t]*[\r\n]+[ \t]*")
_FIELDS = (T.StructType().add("table_pos", T.IntegerType()).add("parent_pos", T.IntegerType()).add("row_pos", T.IntegerType())
           .add("name", T.StringType()).add("symbol", T.StringType()).add("cells", T.ArrayType(T.StringType())))


def displayed(parts: list[str]) -> str:
    """Text as displayed, like ``functions.text.strip_tags``."""
    return _BREAK.sub(" ", "".join(parts)).strip(" ")


class _Table:
    def __init__(self, pos: int, parent: int | None):
        self.pos, self.parent, self.n = pos, parent, 0
        self.row: dict | None = None
        self.cell: dict | None = None


class TableParser(HTMLParser):
    """Collects the rows of all tables of a page, in the order they end.

    A cell's text is its own: what a table inside it says belongs to that
    table.  Row and cell ends may be left out, as browsers have it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.open: list[_Table] = []
        self.found = 0
        self.quiet = 0                      # inside a script or style

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)  # "<![...": the parser's own form gives up on unknown ones

    def _end_cell(self, t: _Table) -> None:
        if t.cell is not None:
            if t.cell["kind"] == "td":
                t.row["cells"].append(displayed(t.cell["text"]))
            t.cell = None

    def _end_row(self, t: _Table) -> None:
        self._end_cell(t)
        if t.row is not None:
            marks = [None if x is None else displayed(x) for x in (t.row["a"], t.row["div"])]
            self.rows.append((t.pos, t.parent, t.n, *marks, t.row["cells"]))
            t.n, t.row = t.n + 1, None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.quiet += 1
        elif tag == "table":
            self.open.append(_Table(self.found, self.open[-1].pos if self.open else None))
            self.found += 1
        elif self.open:
            t = self.open[-1]
            if tag == "tr":
                self._end_row(t)
            if tag in ("tr", "td", "th") and t.row is None:
                t.row = {"cells": [], "a": None, "div": None}
            if tag in ("td", "th"):
                self._end_cell(t)
                t.cell = {"kind": tag, "text": [], "inside": None}
            elif tag in ("a", "div") and t.cell is not None and t.cell["kind"] == "th" and t.row[tag] is None:
                t.row[tag], t.cell["inside"] = [], tag

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.quiet = max(0, self.quiet - 1)
        elif self.open:
            t = self.open[-1]
            if tag == "table":
                self._end_row(self.open.pop())
            elif tag == "tr":
                self._end_row(t)
            elif tag in ("td", "th"):
                self._end_cell(t)
            elif t.cell is not None and t.cell["inside"] == tag:
                t.cell["inside"] = None

    def handle_data(self, data):
        if not self.quiet and self.open and self.open[-1].cell is not None:
            t = self.open[-1]
            t.cell["text"].append(data)
            if t.cell["inside"]:
                t.row[t.cell["inside"]].append(data)


def page_rows(html: str | None) -> list[tuple]:
    """(table_pos, parent_pos, row_pos, name, symbol, cells) of every table row of a page."""
    parser = TableParser()
    parser.feed(html or "")
    parser.close()
    while parser.open:                      # a page may end inside a table
        parser._end_row(parser.open.pop())
    return parser.rows


def table_rows(pages: DataFrame, html: str = "html", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """B1 and B2 by the parser: every row of every table, nested ones too.

    ``keep`` columns, ``table_pos`` (order of the tables' beginnings),
    ``parent_pos`` (the table around it, or NULL), ``row_pos``, ``name`` and
    ``symbol`` (first link and first div of a header cell, NULL without) and
    ``cells`` (texts of the data cells).  A NULL or empty page has no rows;
    anything that isn't markup is read as a browser would.
    """
    kept = pages.select(F.struct(*keep).alias("kept"), F.col(html).alias("html"))
    schema = T.StructType().add("kept", kept.schema["kept"].dataType)
    for f in _FIELDS.fields:
        schema = schema.add(f)

    def frame(own: list, rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=_FIELDS.names).astype({"parent_pos": "Int32"})
        out.insert(0, "kept", own)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, rows = [], []
            for k, text in zip(batch["kept"], batch["html"]):
                found = page_rows(text)
                own += [k] * len(found)
                rows += found
                if len(rows) >= OUT_ROWS:
                    yield frame(own, rows)
                    own, rows = [], []
            if rows:
                yield frame(own, rows)
    ship_package(pages.sparkSession)
    return kept.mapInPandas(run, schema).select("kept.*", *_FIELDS.names)
