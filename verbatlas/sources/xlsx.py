"""Workbooks: a small writer of Office Open XML that streams rows, and the reports made with it.

What a cell means (best group, ambiguous lemma) is decided by DataFrame columns; here it only gets a style.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable
from dataclasses import dataclass, field
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.functions.text import ROW_ORD, sheet_title
from verbatlas.operators.groups import best_groups, groups_ranked, members_of

#: Lemmas beyond which a report gets no cell styles.
STYLED_LEMMAS = 100_000
PLAIN, HEAD, BOLD, BLUE, PCT, PCT_BOLD, HEAD_WRAPPED, BLUE_BOLD = range(8)
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")
_FONTS = ["", "<b/>", '<color rgb="FF0000FF"/>', '<b/><color rgb="FF0070C0"/>']
_STYLES = [(0, 0, ""), (1, 0, ""), (1, 0, ""), (2, 0, ""), (0, 10, ""), (1, 10, ""), (1, 0, '<alignment horizontal="center" wrapText="1"/>'), (3, 0, "")]


@dataclass
class Sheet:
    """rows: an iterable of lists of cells; a cell is a value or (value, style)."""

    title: str
    rows: Iterable[list]
    freeze: str | None = None
    filter: bool = False
    widths: list[int] = field(default_factory=list)


def column_name(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(k: int, i: int, cell) -> str:
    value, style = cell if isinstance(cell, tuple) else (cell, PLAIN)
    if value is None or value == "":
        return ""
    at = f'r="{column_name(k)}{i}"' + (f' s="{style}"' if style else "")
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or value in (float("inf"), float("-inf")):
        return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub("", str(value)))}</t></is></c>'
    return f"<c {at}><v>{value!r}</v></c>"


def write_workbook(path: str, sheets: list[Sheet]) -> None:
    """Sheets are written one by one, a row at a time."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    titles: list[str] = []
    for s in sheets:
        base = sheet_title(s.title) or "Sheet"
        name, k = base, 1
        while name.lower() in [t.lower() for t in titles]:
            k += 1
            name = f"{base[:28]}_{k}"
        titles.append(name)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, t in enumerate(titles, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{pack}/relationships">{links}<Relationship Id="rId{len(sheets) + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        fonts = "".join(f'<font>{x}<sz val="11"/><name val="Calibri"/></font>' for x in _FONTS)
        xfs = "".join(f'<xf numFmtId="{n}" fontId="{f}" fillId="0" borderId="0" xfId="0" applyFont="1" applyNumberFormat="1"' + (f' applyAlignment="1">{a}</xf>' if a else "/>") for f, n, a in _STYLES)
        z.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{main}"><fonts count="{len(_FONTS)}">{fonts}</fonts><fills count="1"><fill><patternFill patternType="none"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(_STYLES)}">{xfs}</cellXfs></styleSheet>')
        for i, s in enumerate(sheets, 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                pane = ""
                if s.freeze:
                    row = int(re.sub(r"\D", "", s.freeze)) - 1
                    pane = f'<sheetViews><sheetView workbookViewId="0"><pane ySplit="{row}" topLeftCell="{s.freeze}" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
                f.write(f'{head}<worksheet xmlns="{main}">{pane}<sheetData>'.encode())
                r = wide = 0
                for r, cells in enumerate(s.rows, 1):
                    wide = max(wide, len(cells))
                    f.write(f'<row r="{r}">{"".join(_cell(k, r, c) for k, c in enumerate(cells))}</row>'.encode())
                area = f'<autoFilter ref="A1:{column_name(max(0, wide - 1))}{max(1, r)}"/>' if s.filter and r else ""
                f.write(f"</sheetData>{area}</worksheet>".encode())


def table_rows(df: DataFrame, order_col: str | None = None) -> Iterable[list]:
    out = (df.orderBy(order_col) if order_col else df).drop(ROW_ORD)
    yield [(c, HEAD) for c in out.columns]
    for row in out.toLocalIterator():
        yield list(row)


def write_table(df: DataFrame, path: str, title: str = "Aggregated", groups: DataFrame | None = None, order_col: str | None = None) -> None:
    """One sheet of the rows; with groups a second one, `Groups`, of sorted lemmas by column."""
    sheets = [Sheet(title, table_rows(df, order_col))]
    if groups is not None:
        lists = [(r.group, r.lemmas) for r in members_of(groups).orderBy("group_pos").collect()]
        deep = max([0, *(len(x) for _, x in lists)])
        body = [[x[i] if i < len(x) else None for _, x in lists] for i in range(deep)]
        sheets.append(Sheet("Groups", [[(g, HEAD) for g, _ in lists], *body]))
    write_workbook(path, sheets)


def write_report(means: DataFrame, path: str, threshold: float = 0.5, profile: str = "standard", lemma_col: str = "lemma") -> None:
    """Sheets lemma_to_groups (means as shares of 100, best one bold, ambiguous lemmas blue) and groups_ranked.

    means: as lemma_means gives them. The fused profile has no count column, centred headers, and shows
    ambiguity on the first sheet only.
    """
    labels = [r.group for r in means.groupBy("group").agg(F.min("group_pos").alias("p")).orderBy("p").collect()]
    wide = means.groupBy("lemma").pivot("group", labels).agg(F.first("mean"))
    first = best_groups(means, threshold).select("lemma", "best", "is_ambiguous", "n").join(wide, "lemma").orderBy("lemma")
    styled = first.count() <= STYLED_LEMMAS
    fused = profile == "fused"
    head = HEAD_WRAPPED if fused else HEAD
    blue = BLUE_BOLD if fused else BLUE

    def lemma_rows() -> Iterable[list]:
        yield [(c, head) for c in [lemma_col, *labels, *([] if fused else ["count"])]]
        for r in first.toLocalIterator():
            cells = [(r.lemma, blue if styled and r.is_ambiguous else PLAIN)]
            cells += [(r[g], (PCT_BOLD if g == r.best and r[g] > 0 else PCT) if styled else PLAIN) for g in labels]
            yield cells + ([] if fused else [r.n])

    lists: dict[str, list] = {g: [] for g in labels}
    for r in groups_ranked(means, threshold).orderBy("group_pos", "rank").toLocalIterator():
        mark = blue if styled and r.is_ambiguous and not fused else PLAIN
        lists[r.group].append(((r.lemma, mark), (r["mean"], PCT if styled else PLAIN)))

    def ranked_rows() -> Iterable[list]:
        yield [(f"{g}_{x}", head) for g in labels for x in ("lemma", "pct")]
        for i in range(max([0, *map(len, lists.values())])):
            yield [c for g in labels for c in (lists[g][i] if i < len(lists[g]) else (None, None))]

    write_workbook(path, [Sheet("lemma_to_groups", lemma_rows(), "A2", True), Sheet("groups_ranked", ranked_rows(), "A2", True)])


def read_sheet(path: str, title: str) -> list[list]:
    """The cells of a sheet that write_workbook wrote, row by row: text, numbers, and None for cells left out."""
    import xml.etree.ElementTree as tree

    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as z:
        titles = [s.attrib["name"] for s in tree.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet")]
        if title not in titles:
            raise ValueError(f"no sheet {title!r}")
        out = []
        with z.open(f"xl/worksheets/sheet{titles.index(title) + 1}.xml") as f:
            for _, row in tree.iterparse(f):
                if row.tag != f"{main}row":
                    continue
                cells: list = []
                for c in row:
                    k = 0
                    for ch in re.sub(r"\d", "", c.attrib["r"]):
                        k = 26 * k + ord(ch) - 64
                    text = "".join(t.text or "" for t in c.iter(f"{main}t")) if c.attrib.get("t") == "inlineStr" else float(c.find(f"{main}v").text)
                    cells += [None] * (k - 1 - len(cells)) + [text]
                out.append(cells)
                row.clear()
    return out
