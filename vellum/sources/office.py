"""Word and Excel files without other libraries: both are zipped XML.

docx() and xlsx() are readers for files.elements(); tables() gives the rows of every table of
scanned files as a DataFrame; sheet_chunks() cuts sheets into texts that repeat their header.
A file that can't be read gives one element of category Broken; other files go on. PDF needs a
reader from files.register().
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Words of letterheads and of framed titles of decisions, which are no data.
OFFICES, MOTTOES = ("bộ nông nghiệp", "bộ giáo dục", "trường đại học"), ("cộng hoà xã hội", "cộng hòa xã hội", "độc lập")
DECISION, ABOUT = "quyết định", ("ban hành", "về việc")


def _text(node: ElementTree.Element) -> str:
    """The text of a paragraph or cell; tabs and breaks as blanks."""
    return "".join(x.text or "" if x.tag == f"{_W}t" else " " if x.tag in (f"{_W}tab", f"{_W}br", f"{_W}cr") else "" for x in node.iter()).strip()


def _word_rows(table: ElementTree.Element) -> list[list[str]]:
    """Rows of a Word table; a cell that spans columns counts once, one that continues the cell above is empty."""
    rows = []
    for tr in table.iter(f"{_W}tr"):
        row = []
        for tc in tr.findall(f"{_W}tc"):
            merged = tc.find(f"{_W}tcPr/{_W}vMerge")
            row.append("" if merged is not None and merged.get(f"{_W}val") != "restart" else " ".join(filter(None, map(_text, tc.iter(f"{_W}p")))))
        if any(row):
            rows.append(row)
    return rows


def is_noise(rows: list[list[str]]) -> bool:
    """Whether a table holds no data: under two rows or columns, a letterhead, or a framed title."""
    if len(rows) < 2 or max(map(len, rows)) < 2:
        return True
    head = " ".join(" ".join(r) for r in rows[:3]).lower()
    has = lambda words: any(w in head for w in words)
    return has(OFFICES) and has(MOTTOES) or DECISION in head and has(ABOUT) and len(rows) <= 3


def markdown(rows: list[list[str]]) -> str | None:
    """Rows as a Markdown table, padded to the widest; None for noise."""
    rows = [[re.sub(r"\s+", " ", c.replace("|", "/")).strip() for c in r] for r in rows]
    rows = [r for r in rows if any(r)]
    if is_noise(rows):
        return None
    n = max(map(len, rows))
    head, *body = [[*r, *[""] * (n - len(r))] for r in rows]
    return "\n".join([f"| {' | '.join(head)} |", f"|{'|'.join(['---'] * n)}|", *(f"| {' | '.join(r)} |" for r in body)])


def docx(content: bytes) -> Iterator[tuple[str, str, int]]:
    """(text, category, page) of a Word file in order: headings as Title, tables as Markdown; pages by the breaks the file records."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    page = 1
    for node in body if body is not None else ():
        breaks = sum(x.tag == f"{_W}lastRenderedPageBreak" or x.tag == f"{_W}br" and x.get(f"{_W}type") == "page" for x in node.iter())
        if node.tag == f"{_W}tbl":
            shown = markdown(_word_rows(node))
            if shown:
                yield shown, "Table", page
        elif node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "").lower() if style is not None else ""
            said = _text(node)
            if said:
                yield said, "Title" if name.startswith(("heading", "title")) else "ListItem" if node.find(f"{_W}pPr/{_W}numPr") is not None else "Text", page
        page += breaks


def sheets(content: bytes) -> list[tuple[str, list[list[str]], list[tuple[int, int, int]]]]:
    """(name, rows, looks) of the sheets of a workbook; looks are the bold, text and number cells of each row. Rows and columns stand where the file has them."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        xml = lambda n: ElementTree.fromstring(z.read(n)) if n in names else None
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in (xml("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in names else ())]
        styles = xml("xl/styles.xml")
        fonts = [f.find(f"{_S}b") is not None for f in styles.iterfind(f"{_S}fonts/{_S}font")] if styles is not None else []
        bold = [bool(fonts[k]) if (k := int(x.get("fontId", 0))) < len(fonts) else False for x in styles.iterfind(f"{_S}cellXfs/{_S}xf")] if styles is not None else []
        target = {r.get("Id"): r.get("Target", "") for r in xml("xl/_rels/workbook.xml.rels")}
        for sheet in xml("xl/workbook.xml").iterfind(f"{_S}sheets/{_S}sheet"):
            path = target[sheet.get(f"{_R}id")]
            page = xml(path.lstrip("/") if path.startswith("/") else f"xl/{path}")
            rows, looks = [], []
            for r in page.iter(f"{_S}row") if page is not None else ():
                at = int(r.get("r") or len(rows) + 1)
                while len(rows) < at:
                    rows.append([])
                    looks.append((0, 0, 0))
                look = [0, 0, 0]
                for c in r.iterfind(f"{_S}c"):
                    value, kind = _cell(c, shared)
                    column = _column(c.get("r"), len(rows[at - 1]))
                    rows[at - 1] += [""] * (column + 1 - len(rows[at - 1]))
                    rows[at - 1][column] = value
                    look[0] += (k := int(c.get("s") or 0)) < len(bold) and bold[k]
                    look[1] += kind == "text"
                    look[2] += kind == "number"
                looks[at - 1] = tuple(look)
            out.append((sheet.get("name") or "", rows, looks))
    return out


def _column(place: str | None, after: int) -> int:
    """The index of a cell's column from its place, such as AB12."""
    letters = re.match(r"[A-Z]+", place or "")
    if not letters:
        return after
    n = 0
    for c in letters[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _cell(c: ElementTree.Element, shared: list[str]) -> tuple[str, str]:
    kind, v = c.get("t"), c.findtext(f"{_S}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_S}t")), "text"
    if v is None:
        return "", "none"
    if kind == "s":
        return shared[int(v)], "text"
    if kind == "b":
        return ("TRUE" if v == "1" else "FALSE"), "number"
    return (v, "text") if kind in ("str", "e") else (v.removesuffix(".0"), "number")


def xlsx(content: bytes) -> Iterator[tuple[str, str, int]]:
    """(text, category, page): a table for each sheet with its name above it; a sheet without data is left out."""
    for page, (name, rows, _) in enumerate(sheets(content), 1):
        shown = markdown(rows)
        if shown:
            yield f"### {name}\n\n{shown}", "Table", page


def csv_files(content: bytes) -> list[tuple[str, bytes]]:
    """Each sheet of a workbook as a CSV file in UTF-8 with a mark at its start."""
    out = []
    for name, rows, _ in sheets(content):
        f = io.StringIO(newline="")
        csv.writer(f).writerows(rows)
        out.append((f"{name}.csv", f.getvalue().encode("utf-8-sig")))
    return out


def header_row(looks: list[tuple[int, int, int]], scan: int = 5) -> int:
    """Which of the first rows is the header: the one with most bold and text cells and fewest numbers; the first on a tie."""
    score = [3 * b + 2 * t - n for b, t, n in looks[:scan]]
    return score.index(max(score)) if score else 0


def pack_sheet(title: str, rows: list[list[str]], looks: list[tuple[int, int, int]], most: int = 600, cost=None) -> list[str]:
    """A sheet as texts of at most `most` tokens where a row allows it: the lines above the header, then groups of rows under the repeated header, with the number of rows of each group and in all. Rows are written as CSV."""
    cost = cost or (lambda t: max(1, int(len(t.split()) * 1.3)))
    kept = [(r, look) for r, look in zip(rows, looks, strict=True) if any(c != "" for c in r)]
    if not kept:
        return []
    width = max(k + 1 for r, _ in kept for k, c in enumerate(r) if c != "")
    lines = []
    for r, _ in kept:
        f = io.StringIO(newline="")
        csv.writer(f, lineterminator="").writerow([*r, *[""] * width][:width])
        lines.append(f.getvalue())
    at = header_row([look for _, look in kept])

    def groups(lines: list[str], start: str) -> Iterator[tuple[str, int]]:
        text, n = start, 0
        for x in lines:
            if n and cost(text) + cost(x) > most:
                yield text, n
                text, n = start, 0
            text, n = f"{text}\n{x}", n + 1
        yield text, n

    above = [t for t, _ in groups(lines[:at], f"{title}:")] if at else []
    body = lines[at + 1 :]
    return above + [f"({n} of {len(body)}) {t}" for t, n in groups(body, f"{title}:\n{lines[at]}")]


def sheet_chunks(files: DataFrame, most: int = 600) -> DataFrame:
    """(doc, chunk, content) of the workbooks among scanned files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for name, content in zip(f["name"], f["content"], strict=True):
                try:
                    texts = [t for sheet, rows, looks in sheets(bytes(content)) for t in pack_sheet(f"{name.rsplit('.', 1)[0]} - {sheet}", rows, looks, most)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError, TypeError):
                    texts = []
                out += [(name, i, t) for i, t in enumerate(texts)]
            yield pd.DataFrame(out, columns=["doc", "chunk", "content"])

    return files.where(T.file_ending(F.col("name")) == ".xlsx").select("name", "content").mapInPandas(run, "doc string, chunk int, content string")


def safe(reader):
    """A reader that gives one element of category Broken for a file it can't read."""

    def read(content: bytes) -> list[tuple[str, str, int]]:
        try:
            return list(reader(content))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError, TypeError) as e:
            return [(f"{type(e).__name__}", "Broken", 1)]

    return read
