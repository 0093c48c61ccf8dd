"""Pages that need a parser: Arrow batches in, rows out."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements without text, elements that never close, and those inside a line.
SILENT = {"script", "style", "noscript", "template", "svg", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "output", "q", "rp", "rt", "rtc", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}


def _hidden(attrs: dict) -> bool:
    style = (attrs.get("style") or "").replace(" ", "").lower()
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


class _Visible(HTMLParser):
    """Text outside silent and hidden elements. Elements that never close are void; a block element
    separates words, an inline one does not."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.open, self.muted = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.parts.append(" ")
        if tag in VOID:
            return
        mute = tag in SILENT or _hidden(dict(attrs))
        self.open.append((tag, mute))
        self.muted += mute

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.parts.append(" ")
        if any(t == tag for t, _ in self.open):
            while self.open:
                t, mute = self.open.pop()
                self.muted -= mute
                if t == tag:
                    break

    def handle_data(self, data):
        if not self.muted:
            self.parts.append(data)


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.now = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self._close()
            href = dict(attrs).get("href")
            self.now = [href, []] if href else None

    def handle_endtag(self, tag):
        if tag == "a":
            self._close()

    def handle_data(self, data):
        if self.now:
            self.now[1].append(data)

    def _close(self):
        if self.now:
            self.rows.append((self.now[0], " ".join("".join(self.now[1]).split())))
        self.now = None


class _Tables(HTMLParser):
    """Rows of all tables: (table, row, cells, hrefs); a nested table's rows are its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.stack, self.tables = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.stack.append({"table": self.tables, "n": 0, "row": None})
            self.tables += 1
        elif self.stack and tag == "tr":
            self._row()
            self.stack[-1]["row"] = []
        elif self.stack and tag in ("td", "th") and self.stack[-1]["row"] is not None:
            self.stack[-1]["row"].append([[], None])
        elif self.stack and tag == "a" and self.stack[-1]["row"]:
            cell = self.stack[-1]["row"][-1]
            cell[1] = cell[1] or dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag == "tr" and self.stack:
            self._row()
        elif tag == "table" and self.stack:
            self._row()
            self.stack.pop()

    def handle_data(self, data):
        if self.stack and self.stack[-1]["row"]:
            self.stack[-1]["row"][-1][0].append(data)

    def _row(self):
        top = self.stack[-1]
        if top["row"]:
            self.rows.append((top["table"], top["n"], [" ".join("".join(c).split()) for c, _ in top["row"]], [h for _, h in top["row"]]))
            top["n"] += 1
        top["row"] = None


class _Forms(HTMLParser):
    """Form fields: (kind, name, value, label). Options that only say 'choose' ("" and "0") are
    marked as placeholders."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.select, self.option = [], None, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "input":
            self.rows.append((a.get("type", "text").lower(), a.get("name"), a.get("value") or "", ""))
        elif tag == "select":
            self.select = a.get("name")
        elif tag == "option":
            self._close()
            self.option = [a.get("value") or "", []]

    def handle_endtag(self, tag):
        if tag in ("option", "select"):
            self._close()
        if tag == "select":
            self.select = None

    def handle_data(self, data):
        if self.option:
            self.option[1].append(data)

    def _close(self):
        if self.option and self.select is not None:
            value, label = self.option[0], " ".join("".join(self.option[1]).split())
            self.rows.append(("placeholder" if value in ("", "0") else "option", self.select, value, label))
        self.option = None


def _parsed(kind, html):
    p = kind()
    p.feed(html or "")
    p.close()
    return p


def _rows(pages: DataFrame, key: str, html: str, schema: str, make) -> DataFrame:
    """mapInArrow of a generator of tuples for each page; the key comes first."""
    out = pages.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            rows = [(k, *row) for k, h in zip(batch.column(key).to_pylist(), batch.column(html).to_pylist()) for row in make(h)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return pages.select(key, html).mapInArrow(run, out)


def _kind(pages: DataFrame, key: str) -> str:
    return pages.schema[key].dataType.simpleString()


def visible_text(pages: DataFrame, key: str, html: str) -> DataFrame:
    return _rows(pages, key, html, f"{key} {_kind(pages, key)}, text string", lambda h: [(" ".join("".join(_parsed(_Visible, h).parts).split()),)])


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    def make(h):
        p = _parsed(_Links, h)
        p._close()
        return [(i, href, label) for i, (href, label) in enumerate(p.rows)]

    return _rows(pages, key, html, f"{key} {_kind(pages, key)}, link_no int, href string, label string", make)


def tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    return _rows(pages, key, html, f"{key} {_kind(pages, key)}, table_no int, row_no int, cells array<string>, hrefs array<string>", lambda h: _parsed(_Tables, h).rows)


def form_fields(pages: DataFrame, key: str, html: str) -> DataFrame:
    return _rows(pages, key, html, f"{key} {_kind(pages, key)}, kind string, name string, value string, label string", lambda h: _parsed(_Forms, h).rows)
