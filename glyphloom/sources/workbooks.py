"""The format `workbook`: coloured spreadsheets, written by tasks and read back.

Each task writes its rows as a fragment of the sheet beside the workbook; the commit puts the fragments behind each other into the file, a block of
bytes at a time, and a write that is broken off leaves none. Rows are in the order of their partitions, and go on in a further worksheet where one is
full. Paths may be of any store that pyarrow knows.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# Font colours of a report, and how many rows a worksheet can have.
COLOURS = {"RED": "FFFF0000", "BLACK": "FF000000", "GREEN": "FF009900", "BLUE": "FF0000FF", "PURPLE": "FFBB00BB"}
MOST_ROWS = 1_048_576
# Names of the file format.
_MAIN, _REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_KIND, _PACKAGE = "application/vnd.openxmlformats-officedocument.spreadsheetml", "http://schemas.openxmlformats.org/package/2006"
_HEAD, _SHEET = '<?xml version="1.0" encoding="UTF-8"?>', "xl/worksheets/sheet{}.xml"
_BLOCK, _END = 1 << 20, b"</row>"
# A part of the file of more bytes than that is written as ZIP64, which it needs from 2 GiB on.
_LONG = 1 << 30


def _parts(size: int, starts: list[int]) -> dict[str, str]:
    """All of a workbook but its sheets, which begin with the lines `starts`; the names of further ones say so."""
    numbers = range(1, len(starts) + 1)
    fonts = f'<font><sz val="{size}"/></font>' + "".join(f'<font><sz val="{size}"/><color rgb="{c}"/></font>' for c in COLOURS.values())
    styles = "".join(f'<xf fontId="{i}" applyFont="1"/>' for i in range(len(COLOURS) + 1))
    override = lambda name, kind: f'<Override PartName="/xl/{name}.xml" ContentType="{_KIND}.{kind}+xml"/>'
    related = lambda n, kind, target: f'<Relationship Id="rId{n}" Type="{_REL}/{kind}" Target="{target}"/>'
    types = override("workbook", "sheet.main") + "".join(override(f"worksheets/sheet{i}", "worksheet") for i in numbers) + override("styles", "styles")
    sheets = "".join(f'<sheet name="report{f" from {start}" if start else ""}" sheetId="{i}" r:id="rId{i}"/>' for i, start in zip(numbers, starts))
    return {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{types}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">{related(1, "officeDocument", "xl/workbook.xml")}</Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{sheets}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">{"".join(related(i, "worksheet", f"worksheets/sheet{i}.xml") for i in numbers)}{related(len(starts) + 1, "styles", "styles.xml")}</Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><fonts count="{len(COLOURS) + 1}">{fonts}</fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(COLOURS) + 1}">{styles}</cellXfs></styleSheet>',
    }


def row_xml(cells: list[str | None], colours: list[str | None]) -> str:
    """A row of the sheet: cells as text, each in its colour. Characters that XML can't hold become U+FFFD."""
    styles = list(COLOURS)
    made = []
    for cell, colour in zip(cells, colours, strict=True):
        text = "".join(c if c in "\t\n\r" or 0x20 <= ord(c) <= 0xD7FF or 0xE000 <= ord(c) <= 0xFFFD or ord(c) > 0xFFFF else "�" for c in cell or "")
        style = styles.index(colour) + 1 if colour in COLOURS else 0
        made.append(f'<c t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(text, {chr(13): "&#13;"})}</t></is></c>')
    return f"<row>{''.join(made)}</row>"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Fragment(WriterCommitMessage):
    part: int
    path: str
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.names = options["path"], schema.names
        self.most = int(options["most"]) if "most" in options else None
        self.sheet, self.size = int(options.get("sheet", MOST_ROWS)), int(options.get("size", 11))
        self.drop = {x for x in options.get("drop", "").split(",") if x}
        self.folder = f"{self.path}.{uuid.uuid4().hex}"

    def write(self, iterator) -> Fragment:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, folder = _store(self.folder)
        store.create_dir(folder)
        path, rows = f"{folder}/{task.partitionId()}-{task.taskAttemptId()}.xml", 0
        plain = [n for n in self.names if n not in ("colour", "colours")]
        with store.open_output_stream(path) as out:
            for row in iterator:
                if "colour" in self.names and row["colour"] in self.drop:
                    continue
                cells = [v for n in plain for v in (row[n] if isinstance(row[n], list) else [row[n]])]
                cells = [None if v is None else str(v) for v in cells]
                colours = list(row["colours"]) if "colours" in self.names else [row["colour"] if "colour" in self.names else None] * len(cells)
                colours += [None] * (len(cells) - len(colours))
                out.write(row_xml(cells, colours[: len(cells)]).encode())
                rows += 1
                if self.most is not None and rows > self.most:
                    raise ValueError(f"more than {self.most} rows: CSV is for these")
        return Fragment(task.partitionId(), path, rows)

    def commit(self, messages: list[Fragment | None]) -> None:
        store, folder = _store(self.folder)
        try:
            found = sorted((m for m in messages if m), key=lambda m: m.part)
            rows = sum(m.rows for m in found)
            if self.most is not None and rows > self.most:
                raise ValueError(f"more than {self.most} rows: CSV is for these")
            _, target = _store(self.path)
            whole = f"{folder}/whole"
            store.create_dir(folder)
            with store.open_output_stream(whole) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as book:
                for name, text in _parts(self.size, list(range(0, max(rows, 1), self.sheet))).items():
                    book.writestr(name, _HEAD + text)
                self._fill(book, store, found, rows)
            store.move(whole, target)
        finally:
            store.delete_dir(folder)

    def _fill(self, book: zipfile.ZipFile, store: fs.FileSystem, found: list[Fragment], rows: int) -> None:
        """The fragments behind each other as worksheets, of which all but the last have self.sheet rows."""
        long = sum(store.get_file_info(m.path).size for m in found) > _LONG
        sheets = -(-rows // self.sheet) or 1

        def begun(i: int):
            sheet = book.open(_SHEET.format(i), "w", force_zip64=long)
            sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
            return sheet

        def ended(sheet) -> None:
            sheet.write(b"</sheetData></worksheet>")
            sheet.close()

        at, left, sheet = 1, self.sheet, begun(1)
        for m in found:
            rest = b""
            with store.open_input_stream(m.path) as part:
                while block := part.read(_BLOCK):
                    rest += block
                    # A cell's own `<` is escaped, so each of these ends a row.
                    while (ends := rest.count(_END)) >= left and at < sheets:
                        behind = rest.split(_END, left)[left]
                        sheet.write(rest[: len(rest) - len(behind)])
                        ended(sheet)
                        at, left, rest = at + 1, self.sheet, behind
                        sheet = begun(at)
                    left -= ends
                    # What may be the beginning of an end waits for the next block.
                    kept = min(len(rest), len(_END) - 1)
                    sheet.write(rest[: len(rest) - kept])
                    rest = rest[len(rest) - kept :]
            sheet.write(rest)
        ended(sheet)

    def abort(self, messages: list[Fragment | None]) -> None:
        store, folder = _store(self.folder)
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


class _Reader(DataSourceReader):
    """line, cells, colours of a workbook's sheets; a sheet is one part, as its rows are bounded by its format."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        store, path = _store(self.path)
        with store.open_input_file(path) as raw, zipfile.ZipFile(raw) as book:
            names = [e.get("name") for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet")]
        return [InputPartition((i, int(name.partition(" from ")[2] or 0))) for i, name in enumerate(names, 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, list[str], list[str | None]]]:
        store, path = _store(self.path)
        number, line = partition.value
        styles = [None, *COLOURS]
        with store.open_input_file(path) as raw, zipfile.ZipFile(raw) as book, book.open(_SHEET.format(number)) as sheet:
            data = None
            for event, e in ElementTree.iterparse(sheet, ("start", "end")):
                if event == "start":
                    data = e if e.tag == f"{{{_MAIN}}}sheetData" else data
                elif e.tag == f"{{{_MAIN}}}row":
                    cells = list(e.iter(f"{{{_MAIN}}}c"))
                    yield line, ["".join(t.text or "" for t in c.iter(f"{{{_MAIN}}}t")) for c in cells], [styles[int(c.get("s", "0"))] for c in cells]
                    line += 1
                    data.clear()


class WorkbookSource(DataSource):
    """Options: path, `drop` (colours whose rows are left out, by commas), `size` of the letters, `most` rows (else as many as there are), rows of a `sheet`."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "line int, cells array<string>, colours array<string>"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), schema)


def write(rows: DataFrame, path: str, **options: object) -> None:
    """A workbook of rows: a column `colour` names the font of a row, one `colours` that of each of its cells; a list fills as many cells as it has values. What is at the path is replaced."""
    rows.sparkSession.dataSource.register(WorkbookSource)
    rows.write.format("workbook").options(**options).mode("overwrite").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """line, cells, colours of a workbook that write() wrote."""
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").load(path)
