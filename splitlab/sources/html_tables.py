"""Leaderboard tables out of stored web pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = "section INT, row_no INT, col_no INT, is_header BOOLEAN, cell STRING, header STRING"


class TableCells(HTMLParser):
    """Cells of the table with a given id, with end tags optional.

    Rows are numbered from 1 over the whole table, sections count its tbody
    elements, and a cell holds all text below it.
    """

    def __init__(self, table_id: str):
        super().__init__(convert_charrefs=True)
        self.table_id, self.depth = table_id, 0
        self.section = self.rows = 0
        self.open: list[list] = []  # rows being read: [depth, row_no, section, cells so far]
        self.cells: list[list] = []  # cells being read: [depth, row_no, col_no, section, th?, texts]
        self.found: list[tuple] = []

    def _end_cells(self, depth: int) -> None:
        while self.cells and self.cells[-1][0] >= depth:
            _, row, col, section, head, texts = self.cells.pop()
            self.found.append((section, row, col, head, "".join(texts).strip()))

    def _end_rows(self, depth: int) -> None:
        self._end_cells(depth)
        while self.open and self.open[-1][0] >= depth:
            self.open.pop()

    def handle_starttag(self, tag, attrs):
        if tag == "table" and (self.depth or dict(attrs).get("id") == self.table_id):
            self.depth += 1
        elif not self.depth:
            return
        elif tag == "tbody":
            self._end_rows(self.depth)
            self.section += 1
        elif tag == "tr":
            self._end_rows(self.depth)
            self.rows += 1
            self.open.append([self.depth, self.rows, self.section, 0])
        elif tag in ("td", "th") and self.open:
            self._end_cells(self.depth)
            row = self.open[-1]
            row[3] += 1
            self.cells.append([self.depth, row[1], row[3], row[2], tag == "th", []])

    def handle_endtag(self, tag):
        if not self.depth:
            return
        if tag in ("td", "th"):
            self._end_cells(self.depth)
        elif tag in ("tr", "tbody", "thead"):
            self._end_rows(self.depth)
        elif tag == "table":
            self._end_rows(self.depth)
            self.depth -= 1

    def handle_data(self, data):
        for cell in self.cells:
            cell[5].append(data)


def _read_page(html: str | None, table_id: str) -> list[tuple]:
    """Cells of one page with the text of the n-th th as header of column n."""
    if not html:
        return []
    parser = TableCells(table_id)
    parser.feed(html)
    parser.close()
    parser._end_rows(0)
    heads = {col: cell for _, _, col, head, cell in parser.found if head}
    return [(*found, heads.get(found[2])) for found in parser.found]


def table_cells(pages: DataFrame, table_id: str, rows_per_batch: int = 20000) -> DataFrame:
    """All cells of one table per page.

    Columns: page_id, section, row_no, col_no, is_header, cell, header. A page
    without the table gives no rows. Pages are read whole, each in the task
    that holds it; cells leave in batches of bounded size.
    """
    names = ["page_id", *[part.split()[0] for part in CELLS.split(", ")]]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in batches:
            for page, html in zip(batch["page_id"], batch["html"]):
                held += [(page, *cell) for cell in _read_page(html, table_id)]
                if len(held) >= rows_per_batch:
                    yield pd.DataFrame(held, columns=names)
                    held = []
        if held:
            yield pd.DataFrame(held, columns=names)

    key = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "html").mapInPandas(read, f"page_id {key}, {CELLS}")


HEADED = ("page_id", "row_no", "col_no", "header", "cell")


def leaderboard_cells(cells: DataFrame) -> DataFrame:
    """Body cells of the second tbody under their header."""
    return cells.filter((F.col("section") == 2) & ~F.col("is_header")).select(*HEADED)


def promote_header(cells: DataFrame, header_row: int = 2, dropped=(1, 3)) -> DataFrame:
    """A stored grid (page_id, row_no, col_no, cell) one of whose rows names the columns."""
    row = F.col("row_no")
    names = cells.filter(row == header_row).select(
        "page_id", "col_no", F.col("cell").alias("header")
    )
    body = cells.filter((row != header_row) & ~row.isin(*dropped)).drop("header")
    return body.join(names, ["page_id", "col_no"]).select(*HEADED)


def table_rows(headed: DataFrame, columns) -> DataFrame:
    """Headed cells as rows with the named columns; a short row gives NULLs."""
    wide = headed.groupBy("page_id", "row_no").pivot("header", list(columns))
    return wide.agg(F.first("cell"))
