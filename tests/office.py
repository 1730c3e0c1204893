"""Small Office files, written with the standard library."""

import io
import zipfile

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
CORE = (
    '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/'
    'core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/">'
    "<dc:title>Plan</dc:title><dc:creator>Ana</dc:creator></cp:coreProperties>"
)


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return out.getvalue()


def docx(*body):
    """Paragraphs from strings; other items are raw XML."""
    parts = [
        item if item.startswith("<") else f"<w:p><w:r><w:t>{item}</w:t></w:r></w:p>"
        for item in body
    ]
    document = f'<w:document xmlns:w="{W}"><w:body>{"".join(parts)}</w:body></w:document>'
    return _zip({"word/document.xml": document, "docProps/core.xml": CORE})


def xlsx(*sheets, shared=()):
    """Sheets from raw row XML."""
    names = "".join(
        f'<sheet name="s{n}" sheetId="{n}" r:id="rId{n}"/>' for n in range(1, len(sheets) + 1)
    )
    links = "".join(
        f'<Relationship Id="rId{n}" Target="worksheets/sheet{n}.xml"/>'
        for n in range(1, len(sheets) + 1)
    )
    strings = "".join(f"<si><t>{text}</t></si>" for text in shared)
    styles = (
        '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/>'
        '<numFmt numFmtId="165" formatCode="0.00 &quot;days&quot;"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'
    )
    parts = {
        "xl/workbook.xml": (
            f'<workbook xmlns="{S}" xmlns:r="{R}"><sheets>{names}</sheets></workbook>'
        ),
        "xl/_rels/workbook.xml.rels": f"<Relationships>{links}</Relationships>",
        "xl/sharedStrings.xml": f'<sst xmlns="{S}">{strings}</sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{S}">{styles}</styleSheet>',
    }
    for n, rows in enumerate(sheets, 1):
        parts[f"xl/worksheets/sheet{n}.xml"] = (
            f'<worksheet xmlns="{S}"><sheetData>{rows}</sheetData></worksheet>'
        )
    return _zip(parts)
