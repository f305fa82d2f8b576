"""Workbooks and word-processor documents by the standard library: both are zip archives of XML.

Cells of a workbook are rows of a DataFrame, so that texts, tables and hints are plans over them. A workbook is
written from rows that are streamed to the driver; what a sheet cannot hold goes on in further sheets.
"""

from __future__ import annotations

import datetime
import io
import re
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Rows of a sheet at most, as the format has it.
MOST_ROWS = 1 << 20
#: Built-in number formats that are dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
#: Cells that are held at once, and bytes of a workbook's cells that wait in memory at most.
CELLS_AT_ONCE, MOST_HELD = 20_000, 1 << 24
CELLS = "file_id string, sheet string, sheet_ord int, r int, c int, value string"
_UNPRINTABLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]").sub


def _column(reference: str) -> int:
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = 26 * n + ord(ch.upper()) - 64
    return n - 1


def _dated(number: float, from_1904: bool) -> str:
    """A serial day as a date and time, as text; a time alone below one."""
    day = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 30)
    at = day + datetime.timedelta(seconds=round(number * 86400))
    return str(at.time()) if 0 <= number < 1 and not from_1904 else str(at)


def workbook_cells(raw: bytes) -> Iterator[tuple[str, int, int, int, str]]:
    """``sheet, sheet_ord, r, c, value`` of each cell with a value, rows and columns from 0; formulas give their stored value."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        names = set(book.namelist())

        def tree(name: str) -> ElementTree.Element | None:
            return ElementTree.fromstring(book.read(name)) if name in names else None

        def text(of: ElementTree.Element) -> str:
            phonetic = {id(t) for p in of.iter(f"{MAIN}rPh") for t in p.iter(f"{MAIN}t")}
            return "".join(t.text or "" for t in of.iter(f"{MAIN}t") if id(t) not in phonetic)

        head = tree("xl/workbook.xml")
        links = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        shared = [text(s) for s in strings] if (strings := tree("xl/sharedStrings.xml")) is not None else []
        dates = set()
        if (styles := tree("xl/styles.xml")) is not None:
            own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode") or "") for f in styles.iter(f"{MAIN}numFmt")}
            kinds = [int(x.get("numFmtId") or 0) for xs in styles.iter(f"{MAIN}cellXfs") for x in xs]
            dates = {str(i) for i, k in enumerate(kinds) if k in DATE_FORMATS or re.search("[ymdhs]", own.get(k, ""), re.IGNORECASE)}
        from_1904 = any(p.get("date1904") in ("1", "true") for p in head.iter(f"{MAIN}workbookPr"))
        for ordinal, sheet in enumerate(head.iter(f"{MAIN}sheet")):
            target = links[sheet.get(RELATION)]
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            r, rows = -1, None
            with book.open(part) as stream:
                for event, row in ElementTree.iterparse(stream, ("start", "end")):
                    if event == "start" and row.tag == f"{MAIN}sheetData":
                        rows = row
                    if event == "start" or row.tag != f"{MAIN}row":
                        continue
                    r, c = int(row.get("r") or r + 2) - 1, -1
                    for cell in row:
                        c = _column(cell.get("r")) if cell.get("r") else c + 1
                        kind, stored = cell.get("t") or "n", cell.find(f"{MAIN}v")
                        value = text(cell) if kind == "inlineStr" else stored.text if stored is not None else None
                        if value is None:
                            continue
                        if kind == "s":
                            value = shared[int(value)]
                        elif kind == "b":
                            value = "True" if value == "1" else "False"
                        elif kind == "n":
                            number = float(value)
                            if cell.get("s") in dates:
                                value = _dated(number, from_1904)
                            elif number.is_integer() and abs(number) < 1e15:
                                value = str(int(number))
                            else:
                                value = repr(number)
                        yield sheet.get("name"), ordinal, r, c, value
                    row.clear()
                    if rows is not None:  # else the sheet would keep every row, though empty
                        rows.clear()


def document_lines(raw: bytes) -> list[str]:
    """Lines of a word-processor document: paragraphs outside tables, table rows, then headers and footers."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:

        def words(of: ElementTree.Element) -> str:
            shown = {"t": lambda x: x.text or "", "tab": lambda x: "\t", "br": lambda x: "\n", "cr": lambda x: "\n"}
            return "".join(shown[k](x) for run in of.iter(f"{WORD}r") for x in run if (k := x.tag.removeprefix(WORD)) in shown)

        def cell_text(cell: ElementTree.Element) -> str:
            return " ".join(x for p in cell.iter(f"{WORD}p") if (x := " ".join(words(p).split())))

        body = ElementTree.fromstring(book.read("word/document.xml")).find(f"{WORD}body")
        lines = [words(p) for p in body.findall(f"{WORD}p")]
        for table in body.findall(f"{WORD}tbl"):
            lines += [" | ".join(x for cell in row.findall(f"{WORD}tc") if (x := cell_text(cell))) for row in table.findall(f"{WORD}tr")]
        for kind in ("header", "footer"):
            for name in sorted(n for n in book.namelist() if re.fullmatch(rf"word/{kind}\d*\.xml", n)):
                lines += [words(p) for p in ElementTree.fromstring(book.read(name)).findall(f"{WORD}p")]
    return [x for line in lines if (x := " ".join(line.replace("\x00", " ").split()))]


def cell_batches(path: str, raw: bytes) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`cells` of one workbook, some at a time; they wait in a file until all are read, as a workbook may break at its end."""
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    schema = pa.schema(list(zip(["file_id", "sheet", "sheet_ord", "r", "c", "value"], kinds)))
    with tempfile.SpooledTemporaryFile(MOST_HELD) as spool:
        try:
            found = workbook_cells(raw)
            with pa.ipc.new_stream(spool, schema) as held:
                while rows := list(islice(found, CELLS_AT_ONCE)):
                    columns = ([path] * len(rows), *zip(*rows))
                    held.write_batch(pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema=schema))
        except Exception:  # a broken file is told of where texts are asked for
            return
        spool.seek(0)
        yield from pa.ipc.open_stream(spool)


def cells(files: DataFrame) -> DataFrame:
    """``file_id, sheet, sheet_ord, r, c, value`` of workbooks ``files (path, content)``; a broken workbook has no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                yield from cell_batches(path.as_py(), content.as_py())

    return files.select("path", "content").mapInArrow(run, CELLS)


def binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_workbook(spark: SparkSession, path: str, sheet: int | None = 0, ordinal: str = "ordinal") -> DataFrame:
    """A sheet as a table of strings: headers from its first row, ``ordinal`` counts the others from 0; empty rows are left out.

    No ``sheet`` means all, each of which goes on where the one before is full. The headers, no more than a sheet has columns, come to the driver.
    """
    book = cells(binary(spark, path))
    own = book if sheet is None else book.where(F.col("sheet_ord") == sheet)
    heads = {r.c: r.value.strip() for r in own.where("r = 0" if sheet is not None else "r = 0 AND sheet_ord = 0").select("c", "value").collect()}
    if not heads:
        raise ValueError(f"sheet {sheet or 0} of {path} has no headers")
    before = F.lit(0) if sheet is not None else F.col("sheet_ord").cast("long") * (MOST_ROWS - 1)
    rows = own.where("r > 0").groupBy((before + F.col("r") - 1).cast("long").alias(ordinal))
    return rows.agg(*(F.max(F.when(F.col("c") == c, F.col("value"))).alias(h) for c, h in sorted(heads.items())))


# writing

_TYPES = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>%s</Types>"""
_SHEET_TYPE = '<Override PartName="/xl/worksheets/sheet%d.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
_LINKS = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">%s</Relationships>"""
_LINK = '<Relationship Id="rId%d" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/%s" Target="%s"/>'


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_UNPRINTABLE("", str(value)))}</t></is></c>'


def write_book(sheets: dict[str, tuple[list[str], Iterable[tuple]]], out: BinaryIO) -> None:
    """A workbook of sheets, each its headers and an iterable of rows; those beyond a sheet's limit go on in sheets ``name (2)`` and so on."""
    names = []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, (headers, rows) in sheets.items():
            rows, part = iter(rows), 1
            following = next(rows, None)
            while part == 1 or following is not None:
                names.append(name if part == 1 else f"{name} ({part})")
                with book.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as sheet:
                    sheet.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
                    count, row = 0, tuple(headers)
                    while row is not None:
                        sheet.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
                        count += 1
                        if count == MOST_ROWS:
                            break
                        row, following = following, next(rows, None) if following is not None else None
                    sheet.write(b"</sheetData></worksheet>")
                part += 1
        numbers = range(1, len(names) + 1)
        book.writestr("[Content_Types].xml", _TYPES % "".join(_SHEET_TYPE % n for n in numbers))
        book.writestr("_rels/.rels", _LINKS % (_LINK % (1, "officeDocument", "xl/workbook.xml")))
        book.writestr("xl/_rels/workbook.xml.rels", _LINKS % "".join(_LINK % (n, "worksheet", f"worksheets/sheet{n}.xml") for n in numbers))
        named = "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{n}" r:id="rId{n}"/>' for n, name in zip(numbers, names))
        book.writestr(
            "xl/workbook.xml",
            f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{RELATION[1:].partition("}")[0]}"><sheets>{named}</sheets></workbook>',
        )


def workbook_bytes(sheets: dict[str, tuple[list[str], Iterable[tuple]]]) -> bytes:
    out = io.BytesIO()
    write_book(sheets, out)
    return out.getvalue()


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """DataFrames to the sheets of one workbook, written through the session's file systems in pieces."""
    spark = next(iter(sheets.values())).sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    with tempfile.TemporaryFile() as body:
        write_book({name: (df.columns, (tuple(r) for r in df.toLocalIterator())) for name, df in sheets.items()}, body)
        body.seek(0)
        out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
        try:
            while piece := body.read(1 << 20):
                out.write(bytearray(piece))
        finally:
            out.close()
