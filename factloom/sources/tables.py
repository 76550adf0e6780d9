"""Tables and linked data of HTML pages, read with a stack of open tags (SRC-4)."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The largest span that HTML lets a cell have.
MOST = 1000


class _Table:
    """One open table: its number, the place of its next cell, the rows that columns are taken up to, and the open cell."""

    __slots__ = ("column", "columns", "head", "no", "row", "rows", "taken", "text")

    def __init__(self, no: int):
        self.no, self.row, self.column, self.taken, self.text = no, -1, 0, {}, None

    def start(self, tag: str, attrs: list) -> None:
        """A row, a cell, or an element that parts words."""
        if tag == "tr":
            self.row, self.column = self.row + 1, 0
        elif tag in ("td", "th"):
            self.row, self.head, self.text, self.rows, self.columns = max(self.row, 0), tag == "th", [], 1, 1
            if attrs:
                attrs = dict(attrs)
                span = lambda name: min(MOST, max(1, int(v))) if (v := (attrs.get(name) or "").strip()).isdecimal() else 1
                self.rows, self.columns = span("rowspan"), span("colspan")
        elif tag in ("br", "p", "div", "li") and self.text is not None:
            self.text.append(" ")

    def end(self, cells: list) -> None:
        """Close the open cell, if there is one."""
        if self.text is None:
            return
        text, self.text = " ".join("".join(self.text).split()), None
        column, row, taken = self.column, self.row, self.taken
        while taken.get(column, -1) >= row:  # columns that a cell above still spans
            column += 1
        if self.rows == self.columns == 1:
            cells.append((self.no, row, column, self.head, text))
            taken[column] = row
        else:
            for c in range(column, column + self.columns):
                for r in range(row, row + self.rows):
                    cells.append((self.no, r, c, self.head, text))
                taken[c] = row + self.rows - 1
        self.column = column + self.columns


class _Reader(HTMLParser):
    """Collects the cells of all tables, nested ones on their own, and the texts of ld+json scripts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells: list[tuple[int, int, int, bool, str]] = []
        self.linked: list[str] = []
        self.tables: list[_Table] = []  # open ones, the innermost last
        self.n_tables = 0
        self.script: list[str] | None = None
        self.skip = None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip = tag
            self.script = [] if tag == "script" and (dict(attrs).get("type") or "").strip().lower() == "application/ld+json" else None
        elif tag == "table":
            self.tables.append(_Table(self.n_tables))
            self.n_tables += 1
        elif self.tables:
            if tag in ("tr", "td", "th"):
                self.tables[-1].end(self.cells)
            self.tables[-1].start(tag, attrs)

    def handle_endtag(self, tag):
        if tag == self.skip:
            if self.script is not None:
                self.linked.append("".join(self.script))
            self.skip, self.script = None, None
        elif self.tables and tag in ("td", "th", "tr", "table"):
            self.tables[-1].end(self.cells)
            if tag == "table":
                self.tables.pop()

    def handle_data(self, data):
        if self.skip:
            if self.script is not None:
                self.script.append(data)
        elif self.tables and self.tables[-1].text is not None:
            self.tables[-1].text.append(data)

    def finish(self) -> None:
        self.close()
        while self.tables:  # tables that the page doesn't close
            self.tables.pop().end(self.cells)


def read_page(source: str) -> _Reader:
    """What a page holds; broken markup is read as far as it goes."""
    reader = _Reader()
    reader.feed(source)
    reader.finish()
    return reader


#: Comments and scripts whose ends leave no doubt; a tag without its brackets; its attributes.
_SKIPPED = re.compile(r"""<(?:!--(?![>-])[^-]*(?:-[^-]+)*-->|(script|style)(?: [a-z]+=(?:"[^"<>&]*"|'[^'<>&]*'))*>[^<]*(?:<(?![/!])[^<]*)*</\1>)""", re.IGNORECASE | re.ASCII)
_TAG = re.compile(r"""(/?)([a-z][a-z0-9]*)((?: [a-z]+=(?:"[^"<>&]*"|'[^'<>&]*'|[a-z0-9]+))*)""", re.IGNORECASE | re.ASCII)
_ATTRIBUTE = re.compile(r""" ([a-z]+)=(?:"([^"]*)"|'([^']*)'|([a-z0-9]+))""", re.IGNORECASE | re.ASCII)
#: Elements that tables are read by, and those whose text a parser may read in another way.
_READ = {"table", "tr", "td", "th", "br", "p", "div", "li"}
_HELD = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "plaintext", "xmp"}


@lru_cache(10_000)
def _plain_tag(tag: str) -> tuple[bool, str, list] | None:
    """Whether a tag without its brackets is an end, its name (empty if tables are not read by it) and attributes; None if it is not plain."""
    found = _TAG.fullmatch(tag)
    name = found and found[2].lower()
    if not found or name in _HELD or (found[1] and found[3]):
        return None
    return found[1] != "", name if name in _READ else "", [(k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTE.findall(found[3])]


def page_cells(source: str) -> list[tuple[int, int, int, bool, str]]:
    """The cells of a page, as read_page finds them: table_no, row_no, column_no, is_header, text.

    Plain markup is cut at its brackets, which takes a small part of the
    parser's time; at the first tag that is not plain the parser reads the page.
    """
    if "<!>" in source:
        return read_page(source).cells
    # The mark stays where something is skipped, as a reference does not go across it.
    pieces = iter(_SKIPPED.sub("<!>", source).split("<"))
    next(pieces)
    cells, tables, top, count = [], [], None, 0
    for piece in pieces:
        tag, closed, text = piece.partition(">")
        if tag != "!":
            plain = _plain_tag(tag) if closed else None
            if plain is None:
                return read_page(source).cells
            end, name, attrs = plain
            if not name:
                pass
            elif name == "table" and not end:
                tables.append(top)
                top, count = _Table(count), count + 1
            elif top:
                if name in ("td", "th", "tr", "table"):
                    top.end(cells)
                if not end:
                    top.start(name, attrs)
                elif name == "table":
                    top = tables.pop()
        if text and top and top.text is not None:
            top.text.append(unescape(text) if "&" in text else text)
    while top:
        top.end(cells)
        top = tables.pop()
    return cells


def _per_page(pages: DataFrame, html: str, read, columns: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """The page's other columns beside each of the tuples that read gives for its text."""
    others = [c for c in pages.columns if c != html]

    def run(batches):
        for batch in batches:
            at, found = [], []
            for n, source in enumerate(batch.column(html).to_pylist()):
                if source:
                    some = read(source)
                    at += [n] * len(some)
                    found += some
            parts = zip(*found, strict=True) if found else [[]] * len(columns)
            made = [pa.array(list(p), kind) for p, (_, kind) in zip(parts, columns.values(), strict=True)]
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in others], *made], names=[*others, *columns])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != html]
    return pages.mapInArrow(run, ", ".join([*kept, *[f"{c} {kind}" for c, (kind, _) in columns.items()]]))


_PLACE = {"table_no": ("int", pa.int32()), "row_no": ("int", pa.int32())}


def table_cells(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per cell of a page's tables: the page's other columns, table_no, row_no, column_no, is_header, text.

    A cell that spans rows or columns is there once for each place it covers.
    Tables in cells are tables of their own, and their text is not part of the
    outer cell. Rows that end before a span does keep the span's places, even
    below the last row. Pages without tables and null pages give no rows.
    """
    return _per_page(pages, html, page_cells, {**_PLACE, "column_no": ("int", pa.int32()), "is_header": ("boolean", pa.bool_()), "text": ("string", pa.string())})


def table_records(cells: DataFrame, page: str) -> DataFrame:
    """Cells below a header as fields: page, table_no, row_no, field (the header of the column), text.

    The header of a column is its last header cell above the first row that has
    a cell without one; header cells in later rows are fields as well. Columns
    without a header have none of their cells returned.
    """
    keys = [page, "table_no"]
    body = cells.where(~F.col("is_header")).groupBy(*keys).agg(F.min("row_no").alias("__first"))
    same = lambda a, b: F.col(f"{a}.{page}").eqNullSafe(F.col(f"{b}.{page}")) & (F.col(f"{a}.table_no") == F.col(f"{b}.table_no"))
    marked = cells.alias("c").join(body.alias("b"), same("c", "b")).select("c.*", "b.__first")
    head = marked.where(F.col("is_header") & (F.col("row_no") < F.col("__first"))).groupBy(*keys, "column_no").agg(F.max_by("text", "row_no").alias("field"))
    rows = marked.where(F.col("row_no") >= F.col("__first"))
    on = same("r", "h") & (F.col("r.column_no") == F.col("h.column_no"))
    return rows.alias("r").join(head.alias("h"), on).select(f"r.{page}", "r.table_no", "r.row_no", "h.field", "r.text")


def _fields(source: str) -> list[tuple[int, int, str, str]]:
    """table_no, row_no, field and text of what table_records returns of one page."""
    cells = page_cells(source)
    first: dict[int, int] = {}
    for t, r, _, is_header, _ in cells:
        if not is_header and r < first.get(t, r + 1):
            first[t] = r
    heads: dict[tuple[int, int], tuple[int, str]] = {}
    for t, r, c, is_header, text in cells:
        if is_header and t in first and r < first[t] and r >= heads.get((t, c), (-1,))[0]:
            heads[t, c] = r, text
    return [(t, r, heads[t, c][1], text) for t, r, c, _, text in cells if t in first and r >= first[t] and (t, c) in heads]


def page_records(pages: DataFrame, html: str = "html") -> DataFrame:
    """table_records of the tables of each page, read once and without a join: the page's other columns, table_no, row_no, field, text."""
    return _per_page(pages, html, _fields, {**_PLACE, "field": ("string", pa.string()), "text": ("string", pa.string())})


def linked_data(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per JSON-LD item of a page: the page's other columns, item_no, item_type, item (JSON text, null if it is none).

    A list or a @graph gives one item for each of its members.
    """
    others = [c for c in pages.columns if c != html]

    def run(batches):
        for batch in batches:
            rows, items = [], []
            for n, source in enumerate(batch.column(html).to_pylist()):
                found = []
                for text in read_page(source).linked if source else []:
                    try:
                        value = json.loads(text)
                    except (ValueError, RecursionError):
                        found.append((None, None))
                        continue
                    value = value.get("@graph", [value]) if isinstance(value, dict) else value
                    for x in value if isinstance(value, list) else [value]:
                        kind = x.get("@type") if isinstance(x, dict) else None
                        found.append((",".join(map(str, kind)) if isinstance(kind, list) else kind if kind is None else str(kind), json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))))
                rows += [n] * len(found)
                items += [(k, *x) for k, x in enumerate(found)]
            parts = list(zip(*items, strict=True)) if items else [[]] * 3
            kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in others]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(list(p), k) for p, k in zip(parts, [pa.int32(), pa.string(), pa.string()], strict=True)]], names=[*others, "item_no", "item_type", "item"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != html)
    return pages.mapInArrow(run, f"{head}, item_no int, item_type string, item string")
