"""Reduction of web pages to what a reader needs, as a Spark job over pages(page_id, html)."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.functions.text import token_estimate

SKIPPED = {"script", "style", "noscript", "form", "button", "input", "img", "picture", "video", "audio", "svg", "iframe", "nav", "footer"}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {f"h{k}": "#" * k for k in range(1, 7)}


class Reader(HTMLParser):
    """Collects text lines (Markdown or plain), tables in their place, and table cells of a page."""

    def __init__(self, markdown: bool):
        super().__init__(convert_charrefs=True)
        self.markdown, self.skip, self.lines, self.line, self.links = markdown, 0, [], [], []
        self.skipped = ""  # the element that began what is skipped; skip: how many of its name are open
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self.open: list[int] = []
        self.outer: list[tuple] = []  # the cells that the open tables stand in
        self.cell: list[str] | None = None
        self.span = (1, 1)

    def flush(self) -> None:
        text = " ".join("".join(self.line).split())
        if text:
            self.lines.append(text)
        self.line = []

    def put(self, text: str) -> None:
        (self.line if self.cell is None else self.cell).append(text)

    def part(self) -> None:
        """A new line, or in a cell a blank."""
        if self.cell is None:
            self.flush()
        else:
            self.cell.append(" ")

    def end_cell(self) -> None:
        if self.open and self.cell is not None:
            self.tables[self.open[-1]][-1].append((" ".join("".join(self.cell).split()), *self.span))
        self.cell = None

    def end_table(self) -> None:
        self.end_cell()
        self.flush()
        number = self.open.pop()
        rows = grid(self.tables[number], False)
        self.lines.append(f"[table {number + 1}]")
        if self.markdown:
            rows = [[c.replace("|", "\\|") for c in row] for row in rows]
            rows[1:1] = [["---"] * len(rows[0])] if rows else []
        self.lines += ["| " + " | ".join(row) + " |" if self.markdown else "\t".join(row).strip() for row in rows]
        self.cell, self.span = self.outer.pop()

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if self.skip:
            self.skip += tag == self.skipped
        elif tag in SKIPPED:
            self.skip, self.skipped = int(tag not in EMPTY), tag
        elif tag == "table":
            if self.cell is None:
                self.flush()
            self.open.append(len(self.tables))
            self.outer.append((self.cell, self.span))
            self.tables.append([])
            self.cell = None
        elif tag == "tr" and self.open:
            self.end_cell()
            self.tables[self.open[-1]].append([])
        elif tag in ("td", "th") and self.open:
            self.end_cell()
            self.flush()
            if not self.tables[self.open[-1]]:
                self.tables[self.open[-1]].append([])
            span = lambda n: int(given.get(n) or 1) if (given.get(n) or "1").isdigit() and int(given.get(n) or 1) > 0 else 1
            self.cell, self.span = [], (span("rowspan"), span("colspan"))
        elif tag in HEADINGS:
            self.part()
            self.put(HEADINGS[tag] + " " if self.markdown and self.cell is None else "")
        elif tag == "a":
            self.links.append(given.get("href") or "")
            self.put("[" if self.markdown else "")
        elif tag in ("p", "div", "li", "br", "section", "article", "main"):
            self.part()
            self.put("- " if tag == "li" and self.markdown and self.cell is None else "")

    def handle_endtag(self, tag):
        if self.skip:
            self.skip -= tag == self.skipped
        elif tag in ("td", "th") and self.open:
            self.end_cell()
        elif tag == "table" and self.open:
            self.end_table()
        elif tag == "a" and self.links:
            href = self.links.pop()
            self.put(f"]({href})" if self.markdown else "")
        elif tag in HEADINGS or tag in ("p", "div", "li"):
            self.part()

    def handle_data(self, data):
        if not self.skip:
            self.put(data)


def read(html: str | None, markdown: bool = True) -> Reader:
    reader = Reader(markdown)
    reader.feed(html or "")
    reader.close()
    while reader.open:
        reader.end_table()
    reader.flush()
    return reader


def grid(rows: list[list[tuple[str, int, int]]], repeat: bool = True) -> list[list[str]]:
    """Cells with their spans filled in, with the text again or empty; rows without text go."""
    out: list[dict[int, str]] = [{} for _ in rows]
    for r, row in enumerate(rows):
        c = 0
        for text, down, across in row:
            while c in out[r]:
                c += 1
            for i in range(r, min(r + down, len(rows))):
                for j in range(c, c + min(across, 1000)):
                    out[i].setdefault(j, text if repeat or (i, j) == (r, c) else "")
    width = max((max(x, default=-1) + 1 for x in out), default=0)
    return [line for x in out if any((line := [x.get(c, "") for c in range(width)]))]


def reduced(pages: DataFrame, output: str = "markdown") -> DataFrame:
    """page_id, text, n_before, n_after (token estimates), ratio. output markdown or text; null pages count as empty."""

    def job(batches):
        for batch in batches:
            yield pd.DataFrame({"page_id": batch.page_id, "html": batch.html, "text": ["\n".join(read(h, output == "markdown").lines) for h in batch.html]})

    done = pages.select("page_id", "html").mapInPandas(job, "page_id long, html string, text string")
    before, after = token_estimate(F.coalesce("html", F.lit(""))), token_estimate(F.col("text"))
    return done.select("page_id", "text", before.alias("n_before"), after.alias("n_after"), F.round(F.try_divide(after, before), 4).alias("ratio"))


def tables(pages: DataFrame) -> DataFrame:
    """page_id, table_no, row, col, text of every table cell, spans filled in, bars escaped."""

    def job(batches):
        for batch in batches:
            found = [(p, t, r, c, text.replace("|", "\\|")) for p, h in zip(batch.page_id, batch.html) for t, rows in enumerate(read(h, False).tables, 1) for r, line in enumerate(grid(rows)) for c, text in enumerate(line)]
            yield pd.DataFrame(found, columns=["page_id", "table_no", "row", "col", "text"])

    return pages.select("page_id", "html").mapInPandas(job, "page_id long, table_no long, row long, col long, text string")
