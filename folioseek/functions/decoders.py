"""File bytes to text, for use inside Spark tasks.

Each decoder takes the bytes of one file and returns (text, metadata). Formats
the standard library and pandas cannot read are decoded only if a reader for
them is installed; otherwise, or to override, pass a decoder of your own.
"""

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from importlib import import_module
from xml.etree import ElementTree

Decoded = tuple[str, dict[str, str]]
Decoder = Callable[[bytes], Decoded]

# XML names of the two Office formats.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CORE_TITLE = "{http://purl.org/dc/elements/1.1/}title"
CORE_AUTHOR = "{http://purl.org/dc/elements/1.1/}creator"

# Text of the characters a Word run may hold as elements.
WORD_MARKS = {"tab": "\t", "ptab": "\t", "cr": "\n", "noBreakHyphen": "-"}

# Built-in spreadsheet number formats that show a date or time.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}

# A cell reference in a formula; text and sheet names in quotes are passed over.
CELL_REFERENCE = re.compile(
    r"""(?:"[^"]*"|'[^']*')|(?<![A-Za-z0-9_.$])(\$?)([A-Z]{1,3})(\$?)([0-9]+)(?![A-Za-z0-9_(.])"""
)


def decode_csv(data: bytes) -> Decoded:
    import pandas as pd

    return pd.read_csv(io.BytesIO(data)).to_string(index=False), {}


def _core_properties(archive: zipfile.ZipFile) -> dict[str, str]:
    if "docProps/core.xml" not in archive.namelist():
        return {}
    root = ElementTree.fromstring(archive.read("docProps/core.xml"))
    found = {"title": root.findtext(CORE_TITLE), "author": root.findtext(CORE_AUTHOR)}
    return {key: value for key, value in found.items() if value}


def decode_docx(data: bytes) -> Decoded:
    """Text of the body's own paragraphs, one line each."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
        metadata = _core_properties(archive)
    lines = []
    for paragraph in root.findall(f"{WORD}body/{WORD}p"):
        line = []
        for child in paragraph:
            if child.tag == f"{WORD}r":
                line.append(_run_text(child))
            elif child.tag == f"{WORD}hyperlink":
                line.extend(_run_text(run) for run in child.findall(f"{WORD}r"))
        lines.append("".join(line))
    return "\n".join(lines), metadata


def _run_text(run: ElementTree.Element) -> str:
    out = []
    for item in run:
        name = item.tag.removeprefix(WORD)
        if name == "t":
            out.append(item.text or "")
        elif name == "br" and item.get(f"{WORD}type", "textWrapping") == "textWrapping":
            out.append("\n")
        else:
            out.append(WORD_MARKS.get(name, ""))
    return "".join(out)


def decode_xlsx(data: bytes) -> Decoded:
    """Filled cells of all sheets, a line per row; formulas as written."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = set(archive.namelist())
        book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        links = ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
        targets = {link.get("Id"): link.get("Target", "") for link in links}
        shared = []
        if "xl/sharedStrings.xml" in names:
            table = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
            shared = [_rich_text(item) for item in table.findall(f"{SHEET}si")]
        dates = _date_styles(archive) if "xl/styles.xml" in names else set()
        setup = book.find(f"{SHEET}workbookPr")
        late = setup is not None and setup.get("date1904") in ("1", "true")
        epoch = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)
        sheets = book.findall(f"{SHEET}sheets/{SHEET}sheet")
        lines = []
        for sheet in sheets:
            target = targets[sheet.get(REL_ID)]
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            root = ElementTree.fromstring(archive.read(part))
            lines.extend(_sheet_lines(root, shared, dates, epoch))
        metadata = _core_properties(archive)
    return "\n".join(lines), {**metadata, "sheets": str(len(sheets))}


def _rich_text(item: ElementTree.Element) -> str:
    plain = item.findall(f"{SHEET}t") + item.findall(f"{SHEET}r/{SHEET}t")
    return "".join(part.text or "" for part in plain)


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    dated = set(DATE_FORMATS)
    for item in root.findall(f"{SHEET}numFmts/{SHEET}numFmt"):
        bare = re.sub(r'"[^"]*"|\\.|\[(?![hms]+\])[^\]]*\]', "", item.get("formatCode", ""))
        if re.search(r"[dmhys]", bare.lower()):
            dated.add(int(item.get("numFmtId")))
    styles = root.findall(f"{SHEET}cellXfs/{SHEET}xf")
    return {n for n, style in enumerate(styles) if int(style.get("numFmtId", 0)) in dated}


def _sheet_lines(root, shared: list[str], dates: set[int], epoch: datetime) -> Iterator[str]:
    origins: dict[str, tuple[str, str]] = {}
    for row in root.findall(f"{SHEET}sheetData/{SHEET}row"):
        values = [
            _formula(cell, origins) or _cell_value(cell, shared, dates, epoch)
            for cell in row.findall(f"{SHEET}c")
        ]
        shown = [str(value) for value in values if value]
        if shown:
            yield " ".join(shown)


def _formula(cell, origins: dict[str, tuple[str, str]]) -> str | None:
    """Formula of a cell as written; a shared one is moved to where it is used."""
    formula = cell.find(f"{SHEET}f")
    if formula is None:
        return None
    group, text, place = formula.get("si"), formula.text or "", cell.get("r", "A1")
    if formula.get("t") == "shared" and not text and group in origins:
        text = _moved(*origins[group], place)
    elif formula.get("t") == "shared":
        origins[group] = text, place
    return f"={text}"


def _moved(text: str, origin: str, place: str) -> str:
    (column, row), (to_column, to_row) = _coordinates(origin), _coordinates(place)

    def move(found: re.Match) -> str:
        fixed_column, letters, fixed_row, digits = found.groups()
        if letters is None:
            return found.group()
        at_column, at_row = _coordinates(letters + digits)
        at_column += 0 if fixed_column else to_column - column
        at_row += 0 if fixed_row else to_row - row
        return f"{fixed_column}{_letters(at_column)}{fixed_row}{at_row}"

    return CELL_REFERENCE.sub(move, text)


def _coordinates(reference: str) -> tuple[int, int]:
    letters = reference.rstrip("0123456789")
    column = 0
    for letter in letters:
        column = column * 26 + ord(letter) - ord("A") + 1
    return column, int(reference[len(letters) :])


def _letters(column: int) -> str:
    out = ""
    while column > 0:
        column, rest = divmod(column - 1, 26)
        out = chr(ord("A") + rest) + out
    return out


def _cell_value(cell, shared: list[str], dates: set[int], epoch: datetime):
    kind, raw = cell.get("t", "n"), cell.findtext(f"{SHEET}v")
    if kind == "inlineStr":
        inner = cell.find(f"{SHEET}is")
        return _rich_text(inner) if inner is not None else None
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return raw == "1"
    if kind != "n":
        return raw
    number = float(raw) if re.search(r"[.eE]", raw) else int(raw)
    if int(cell.get("s", 0)) in dates:
        moment = epoch + timedelta(days=number)
        moment = (moment + timedelta(microseconds=500)).replace(microsecond=0)
        return moment.time() if 0 <= number < 1 else moment
    return number


def _decode_pdf(data: bytes, library: str) -> Decoded:
    reader = import_module(library).PdfReader(io.BytesIO(data))
    pages = [page.extract_text() for page in reader.pages]
    return "\n".join(text for text in pages if text), {"pages": str(len(pages))}


def _decode_xls(data: bytes) -> Decoded:
    book = import_module("xlrd").open_workbook(file_contents=data)
    lines = []
    for sheet in book.sheets():
        for row in range(sheet.nrows):
            shown = [str(value) for value in sheet.row_values(row) if value]
            if shown:
                lines.append(" ".join(shown))
    return "\n".join(lines), {"sheets": str(book.nsheets)}


def standard_decoders() -> dict[str, Decoder]:
    """Decoders usable here, by file type. Old Word files have none."""
    found: dict[str, Decoder] = {
        "csv": decode_csv,
        "docx": decode_docx,
        "xlsx": decode_xlsx,
    }
    for library in ("pypdf", "PyPDF2"):
        try:
            import_module(library)
        except ImportError:
            continue
        found.setdefault("pdf", lambda data, name=library: _decode_pdf(data, name))
    try:
        import_module("xlrd")
        found["xls"] = _decode_xls
    except ImportError:
        pass
    return found
