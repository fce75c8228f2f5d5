"""Excel workbooks (.xlsx) without an Excel library.

A workbook is a zip archive of XML. Spark reads the archives from wherever they are (``binaryFile``); one pass takes out of
each the packed XML of every wanted sheet, with the strings and styles that it refers to, and these parts are dealt to
tasks, so that the sheets of one workbook are read side by side. In a task the XML is streamed, row by row.

Cells come as text: numbers in their shortest form, dates as ``yyyy-MM-dd HH:mm:ss``, errors and missing cells blank.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 1_048_576
# Fixed values of the file format: its namespaces, and the built-in number formats that show a date or time.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
PARTS = "path string, sheet string, place int, epoch1904 boolean, xml binary, strings binary, styles binary"


def _packed(archive: zipfile.ZipFile, name: str) -> bytes:
    """The XML of a member, packed anew, so that what is dealt to tasks stays small; nothing if there is no such member."""
    if name not in archive.namelist():
        return b""
    packer, out = zlib.compressobj(1), []
    with archive.open(name) as f:
        while chunk := f.read(1 << 20):
            out.append(packer.compress(chunk))
    return b"".join([*out, packer.flush()])


class _Unpacked(io.RawIOBase):
    """Packed XML as a stream."""

    def __init__(self, packed: bytes):
        self.tool, self.rest = zlib.decompressobj(), packed

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        data = self.tool.decompress(self.rest, len(out))
        self.rest = self.tool.unconsumed_tail
        out[: len(data)] = data
        return len(data)


def _elements(packed: bytes, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a kind, one after another; each is forgotten when the next is asked for."""
    if not packed:
        return
    root = None
    for event, element in ElementTree.iterparse(io.BufferedReader(_Unpacked(packed)), events=("start", "end")):
        if event == "start":
            root = element if root is None else root
        elif element.tag == MAIN + tag:
            yield element
            element.clear()
            if tag == "row":
                root.clear()


def _sheets(content: bytes) -> Iterator[tuple[str, int, bool, bytes, bytes, bytes]]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        properties = book.find(MAIN + "workbookPr")
        epoch = properties is not None and properties.get("date1904") in ("1", "true")
        strings, styles = _packed(archive, "xl/sharedStrings.xml"), _packed(archive, "xl/styles.xml")
        for place, sheet in enumerate(book.iter(MAIN + "sheet")):
            target = links.get(sheet.get(LINK), "")
            yield sheet.get("name", ""), place, epoch, _packed(archive, target.lstrip("/") if target.startswith("/") else f"xl/{target}"), strings, styles


def sheet_parts(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, place, …): a row for every sheet of the workbooks at ``path``, with what it takes to read it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in _sheets(content.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (at, *row)], names=["path", "sheet", "place", "epoch1904", "xml", "strings", "styles"]).cast(pa.schema([("path", pa.string()), ("sheet", pa.string()), ("place", pa.int32()), ("epoch1904", pa.bool_()), ("xml", pa.binary()), ("strings", pa.binary()), ("styles", pa.binary())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, PARTS)


def column_number(reference: str) -> int:
    """The place, from 0 on, of a cell such as ``BC12``."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _shows_date(code: str) -> bool:
    plain = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code)
    return bool(re.search(r"[dmyhs]", plain, re.IGNORECASE)) and "general" not in plain.lower()


def _date_styles(packed: bytes) -> set[int]:
    """The cell styles that show their number as a date."""
    if not packed:
        return set()
    root = ElementTree.fromstring(zlib.decompress(packed))
    own = {int(e.get("numFmtId")) for e in root.iter(MAIN + "numFmt") if _shows_date(e.get("formatCode", ""))}
    cells = root.find(MAIN + "cellXfs")
    return {i for i, e in enumerate(cells if cells is not None else ()) if int(e.get("numFmtId", 0)) in DATE_FORMATS | own}


def _shown_number(text: str, date: bool, epoch1904: bool) -> str:
    value = float(text)
    if date:
        start = dt.datetime(1904, 1, 1) if epoch1904 else dt.datetime(1899, 12, 30)
        return str((start + dt.timedelta(seconds=round(value * 86_400))).replace(microsecond=0))
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def _text(element: ElementTree.Element) -> str:
    """The text of a string item, without the reading aids of phonetic runs."""
    return "".join(t.text or "" for run in element if run.tag != MAIN + "rPh" for t in ([run] if run.tag == MAIN + "t" else run.iter(MAIN + "t")))


def sheet_rows(xml: bytes, strings: bytes, styles: bytes, epoch1904: bool) -> Iterator[tuple[int, dict[int, str]]]:
    """(row number from 1 on, {place: text}) of the rows that hold something."""
    shared = [_text(e) for e in _elements(strings, "si")]
    dates = _date_styles(styles)
    number = 0
    for row in _elements(xml, "row"):
        number = int(row.get("r") or number + 1)
        cells, place = {}, -1
        for cell in row.iter(MAIN + "c"):
            place = column_number(cell.get("r")) if cell.get("r") else place + 1
            kind, value = cell.get("t", "n"), cell.findtext(MAIN + "v")
            if kind == "inlineStr":
                inline = cell.find(MAIN + "is")
                text = _text(inline) if inline is not None else ""
            elif value is None or kind == "e":
                text = ""
            elif kind == "s":
                text = shared[int(value)]
            elif kind == "b":
                text = "True" if value == "1" else "False"
            elif kind in ("str", "d"):
                text = value
            else:
                text = _shown_number(value, int(cell.get("s", 0)) in dates, epoch1904)
            if text:
                cells[place] = text
        if cells:
            yield number, cells


def _wanted(parts: DataFrame, sheet: str | int | None) -> DataFrame:
    return parts if sheet is None else parts.where(F.col("place") == sheet if isinstance(sheet, int) else F.col("sheet") == sheet)


def cells(spark: SparkSession, path: str, sheet: str | int | None = None, from_row: int = 1, to_row: int = ROWS) -> DataFrame:
    """(path, sheet, place, row, cells): the rows that hold something; ``place`` is that of the sheet in its workbook, from 0 on,
    and ``cells`` a map from the column's place to text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.int32(), pa.string())

        def packed(found: list) -> pa.RecordBatch:
            columns = list(zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array([list(c.items()) for c in columns[4]], kind)], names=["path", "sheet", "place", "row", "cells"])

        for batch in batches:
            for at in range(batch.num_rows):
                where, name, place, epoch, xml, strings, styles = (batch.column(i)[at].as_py() for i in range(7))
                found = []
                for number, row in sheet_rows(xml, strings, styles, epoch):
                    if number > to_row:
                        break
                    if number >= from_row:
                        found.append((where, name, place, number, row))
                    if len(found) == 2_000:
                        yield packed(found)
                        found = []
                if found:
                    yield packed(found)

    parts = _wanted(sheet_parts(spark, path), sheet)
    spread = parts.repartition(spark.sparkContext.defaultParallelism, "path", "sheet")
    return spread.mapInArrow(run, "path string, sheet string, place int, row int, cells map<int,string>")


def excel(spark: SparkSession, path: str, sheet: str | int | None = 0, header: int = 0) -> DataFrame:
    """The rows below row ``header`` (from 0 on) of a sheet, by name or place, or of all sheets (``sheet=None``) with a column
    ``sheet``, as text columns named by that row.

    Names are trimmed; a repeated name gets ``.1``, ``.2`` and so on, a blank one is ``Unnamed: <place>``. With several sheets or workbooks columns
    are matched by name, and are null where a sheet has none of the name; blank cells are blank. A name that only blank
    cells stand below is kept.
    """
    tops = cells(spark, path, sheet, header + 1, header + 1)
    # One row a sheet, as wide as its header.
    widths = cells(spark, path, sheet, header + 1).groupBy("path", "place", "sheet").agg(F.max(F.array_max(F.map_keys("cells"))).alias("last"))
    heads = widths.join(tops.select("path", "sheet", "cells"), ["path", "sheet"], "left").orderBy("path", "place").collect()
    names: dict[str, None] = {}
    lines = []
    for head in heads:
        found = _names(head["cells"] or {}, head["last"])
        names |= dict.fromkeys(found)
        lines.append((head["path"], head["sheet"], found))
    extra = [] if sheet is not None else [F.col("sheet")]
    if not lines:
        return cells(spark, path, sheet).select(*extra).where(F.lit(False))
    listed = spark.createDataFrame(lines, "path string, sheet string, names array<string>")
    rows = cells(spark, path, sheet, header + 2).join(F.broadcast(listed), ["path", "sheet"])  # one row a sheet
    place = lambda n: F.array_position("names", n) - 1
    value = lambda n: F.when(F.array_contains("names", n), F.coalesce(F.try_element_at("cells", place(n).cast("int")), F.lit("")))
    return rows.select(*extra, *[value(n).alias(n) for n in names])


def _names(cells: dict[int, str], last: int) -> list[str]:
    out: list[str] = []
    seen: dict[str, int] = {}
    for i in range(last + 1):
        name = cells.get(i, "").strip() or f"Unnamed: {i}"
        again = seen.get(name, 0)
        seen[name] = again + 1
        out.append(f"{name}.{again}" if again else name)
    return out


def top_rows(spark: SparkSession, path: str, sheet: str | int = 0, rows: int = 30) -> list[list[str | None]]:
    """The first rows of a sheet as lists, for header discovery; blank rows are empty lists."""
    found = {r["row"]: r["cells"] for r in cells(spark, path, sheet, 1, rows).collect()}
    return [[found[n].get(i) for i in range(max(found[n]) + 1)] if n in found else [] for n in range(1, max(found, default=0) + 1)]


# --- writing ----------------------------------------------------------------------------------------------------------


def column_name(place: int) -> str:
    out = ""
    place += 1
    while place:
        place, left = divmod(place - 1, 26)
        out = chr(65 + left) + out
    return out


def _cell(reference: str, value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{reference}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and value not in (float("inf"), float("-inf")):
        return f'<c r="{reference}"><v>{value!r}</v></c>'
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
    return f'<c r="{reference}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_workbook(path: str, sheets: Sequence[tuple[str, Sequence[str], Iterator[Sequence]]]) -> None:
    """A workbook on a local disk from (sheet name, column names, rows), row by row: no sheet has to fit memory."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main, link = MAIN[1:-1], LINK[1 : LINK.index("}")]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        each = range(1, len(sheets) + 1)
        archive.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in each) + "</Types>")
        relation = "http://schemas.openxmlformats.org/package/2006/relationships"
        archive.writestr("_rels/.rels", f'{head}<Relationships xmlns="{relation}"><Relationship Id="rId1" Type="{link}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        archive.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{link}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _, _) in zip(each, sheets)) + "</sheets></workbook>")
        archive.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{relation}">' + "".join(f'<Relationship Id="rId{i}" Type="{link}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in each) + "</Relationships>")
        for i, (_, names, rows) in zip(each, sheets):
            columns = [column_name(j) for j in range(len(names))]
            with archive.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as f:
                f.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
                for number, row in enumerate(chain([names], rows), 1):
                    if number > ROWS:
                        raise ValueError("more rows than a sheet holds; write parquet or csv")
                    f.write(f'<row r="{number}">{"".join(_cell(f"{c}{number}", v) for c, v in zip(columns, row))}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
