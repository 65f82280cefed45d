"""Tables of HTML pages as rows: each cell at the places that it covers, with its text and its absolute links."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = "table_no int, row_no int, column_no int, header boolean, covered boolean, text string, links array<string>"
#: HTML's own bounds of spans.
MOST_ROWS, MOST_COLUMNS = 65534, 1000


class _Tables(HTMLParser):
    """Cells of a page's tables as lists [table, row, rowspan, colspan, header, texts, links]; a table inside a cell is one of its own."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.cells, self.rows, self.stack, self.tables, self.silent = base, [], [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag in ("script", "style"):
            self.silent += 1
        elif tag == "table":
            self.stack.append({"table": self.tables, "row": -1, "cell": None})
            self.tables += 1
        elif self.stack and tag == "tr":
            self.stack[-1]["row"] += 1
            self.stack[-1]["cell"] = None
        elif self.stack and tag in ("td", "th"):
            top = self.stack[-1]
            top["row"] = max(top["row"], 0)
            top["cell"] = [top["table"], top["row"], _span(found.get("rowspan"), MOST_ROWS), _span(found.get("colspan"), MOST_COLUMNS), tag == "th", [], []]
            self.cells.append(top["cell"])
        elif self.stack and self.stack[-1]["cell"] and tag == "a" and found.get("href") is not None:
            try:
                link = urljoin(self.base, found["href"].strip())
            except ValueError:
                return
            if link.startswith(("http://", "https://")):
                self.stack[-1]["cell"][6].append(link)
        elif self.stack and self.stack[-1]["cell"] and tag in ("br", "p", "div", "li"):
            self.stack[-1]["cell"][5].append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif self.stack and tag == "table":
            self.stack.pop()
        elif self.stack and tag in ("td", "th", "tr"):
            self.stack[-1]["cell"] = None

    def handle_data(self, data):
        if self.stack and self.stack[-1]["cell"] and not self.silent:
            self.stack[-1]["cell"][5].append(data)


def _span(value: str | None, most: int) -> int:
    digits = (value or "").strip()
    return min(max(int(digits), 1), most) if digits.isdecimal() else 1


def cells_of(html: str, base: str) -> Iterator[tuple]:
    """(table, row, column, header, covered, text, links): a cell takes the first free columns of its row; `covered` marks the places besides its first."""
    parser = _Tables(base)
    parser.feed(html)
    parser.close()
    taken: set[tuple[int, int, int]] = set()
    last = {}
    for table, row, *_ in parser.cells:
        last[table] = max(last.get(table, 0), row)
    for table, row, down, across, header, texts, links in parser.cells:
        column = 0
        while (table, row, column) in taken:
            column += 1
        text = " ".join("".join(texts).split())
        for r in range(row, min(row + down, last[table] + 1)):  # a span ends with its table
            for c in range(column, column + across):
                if (table, r, c) not in taken:
                    taken.add((table, r, c))
                    yield table, r, c, header, (r, c) != (row, column), text, links


def html_tables(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """A row (key, CELLS) for every place of every table of pages. Null or empty pages, and pages without a table, give none; links
    are http and https ones, absolute by the page's url; all character references are resolved. Work and memory are a page's."""
    rows = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.col(html).alias("html")).filter(F.col(html).rlike("(?i)<table"))
    kind = dict(rows.dtypes)["key"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.strip().split(" ")[0] for c in CELLS.split(",")]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.list_(pa.string())]
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(cells_of(batch.column("html")[i].as_py(), batch.column("url")[i].as_py()))
                if found:
                    keys = batch.column("key").take(pa.array([i] * len(found)))
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True))], ["key", *names])

    return rows.mapInArrow(parse, f"key {kind}, {CELLS}").withColumnRenamed("key", key)
