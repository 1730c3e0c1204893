"""Folder scans and text extraction."""

import os

import pytest

from folioseek import (
    DocumentIndex,
    count_files,
    index_folder,
    process_folder,
    search_documents,
)
from folioseek.functions.decoders import decode_docx, decode_xlsx
from folioseek.sources.extraction import extract_documents
from folioseek.sources.files import scan_folder
from office import docx, xlsx

SAMPLE = b"id,name,age\n1,John Doe,30\n2,Jane Smith,25\n3,Bob Johnson,40"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "sub" / "deep").mkdir(parents=True)
    files = {
        "a.docx": docx("Relatório anual", "<w:p/>", "<w:tbl><w:tr/></w:tbl>", "Fim"),
        "b.xlsx": xlsx('<row><c t="inlineStr"><is><t>soma</t></is></c><c><v>0</v></c></row>'),
        "c.csv": SAMPLE,
        "sub/D.CSV": b"id,name\n1,\n2,Zoe\n",
        "hdr.csv": b"id,name\n",
        "ragged.csv": b'a,b\n1,2,3\n"open',
        "broken.docx": b"not a zip",
        "e.pdf": b"%PDF",
        "f.xls": b"?",
        "g.doc": b"old",
        "h.txt": b"ignored",
        "empty.csv": b"",
        "sub/_budget.csv": SAMPLE,
        "sub/.notes.CSV": SAMPLE,
        "_skip.txt": b"ignored",
        "sub/deep/a b é.csv": SAMPLE,
        "p%20q.csv": SAMPLE,
    }
    for name, data in files.items():
        (root / name).write_bytes(data)
    return root


@pytest.fixture(scope="module")
def extracted(spark, folder):
    rows = process_folder(spark, str(folder)).collect()
    return {row["file_name"]: row for row in rows}


def test_scan_finds_supported_files_below_the_folder(spark, folder):
    rows = scan_folder(spark, folder).select("path").collect()
    found = {row["path"].rsplit("/", 1)[-1] for row in rows}
    assert found == {
        "a.docx", "b.xlsx", "c.csv", "D.CSV", "hdr.csv", "ragged.csv", "broken.docx",
        "e.pdf", "f.xls", "g.doc", "a b é.csv", "p%20q.csv", "_budget.csv", ".notes.CSV",
        "empty.csv",
    }


def test_missing_folder_is_empty(spark, tmp_path):
    assert process_folder(spark, str(tmp_path / "none")).collect() == []


def test_record_fields(extracted, folder):
    row = extracted["D.CSV"]
    assert row["file_path"].endswith(f"{folder}/sub/D.CSV")
    assert row["file_type"] == "csv"
    assert row["file_size"] == os.path.getsize(folder / "sub/D.CSV")
    assert row["modified_at"] is not None
    assert extracted["p%20q.csv"]["file_path"].endswith("/p%20q.csv")


def test_csv_text(extracted):
    assert extracted["c.csv"]["content"] == (
        " id        name  age\n  1    John Doe   30\n  2  Jane Smith   25\n  3 Bob Johnson   40"
    )
    assert "NaN" in extracted["D.CSV"]["content"]
    assert extracted["hdr.csv"]["content"].startswith("Empty DataFrame")


def test_docx_text_keeps_empty_paragraphs_and_skips_tables(extracted):
    assert extracted["a.docx"]["content"] == "Relatório anual\n\nFim"
    assert extracted["a.docx"]["metadata"] == {"title": "Plan", "author": "Ana"}


def test_docx_marks():
    runs = (
        "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t>"
        '<w:br w:type="page"/></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>'
    )
    assert decode_docx(docx(runs))[0] == "a\tb\nclink"


def test_xlsx_values():
    first = (
        '<row><c t="s"><v>0</v></c><c><v>0</v></c><c t="b"><v>0</v></c><c><v>2.5</v></c>'
        '<c><v>7</v></c><c t="b"><v>1</v></c></row><row><c t="s"><v>1</v></c></row>'
        '<row><c s="1"><v>45292</v></c><c s="2"><v>3</v></c><c><f>A1+B1</f><v>9</v></c></row>'
    )
    second = '<row><c t="inlineStr"><is><r><t>rich</t></r><r><t> text</t></r></is></c></row>'
    text, metadata = decode_xlsx(xlsx(first, second, shared=("name", "")))
    assert text == "name 2.5 7 True\n2024-01-01 00:00:00 3 =A1+B1\nrich text"
    assert metadata["sheets"] == "2"


def test_shared_formula_is_moved():
    rows = (
        '<row><c r="A1"><f t="shared" si="0" ref="A1:B2">SUM(C1:$D$4)&amp;"A1"</f></c>'
        '<c r="B1"><f t="shared" si="0"/></c></row>'
        '<row><c r="Z2"><f t="shared" si="0"/></c></row>'
    )
    assert decode_xlsx(xlsx(rows))[0] == (
        '=SUM(C1:$D$4)&"A1" =SUM(D1:$D$4)&"A1"\n=SUM(AB2:$D$4)&"A1"'
    )


def test_normalized_folder(spark, folder):
    rows = process_folder(spark, str(folder), normalize=True).filter("file_name = 'c.csv'")
    assert rows.first()["content"].startswith("id name age\n1 John Doe 30")


def test_one_bad_file_does_not_stop_the_rest(extracted):
    assert extracted["broken.docx"]["reason"].startswith("failed: BadZipFile")
    assert extracted["ragged.csv"]["reason"].startswith("failed: ParserError")
    assert extracted["g.doc"]["reason"] == "no_extractor"
    assert extracted["b.xlsx"]["content"] == "soma"


def test_own_decoder(spark, folder):
    rows = process_folder(spark, str(folder), {"doc": lambda data: (data.decode(), {})})
    assert rows.filter("file_type = 'doc'").first()["content"] == "old"


def test_large_files_are_listed_not_opened(spark, folder):
    rows = extract_documents(scan_folder(spark, str(folder)), max_bytes=20).collect()
    large = {row["file_name"]: row["reason"] for row in rows if row["file_size"] > 20}
    assert set(large.values()) == {"too_large"} and "c.csv" in large


def test_counters_are_those_of_a_walk(spark, folder):
    rows = count_files(spark, str(folder)).collect()
    counted = {row["file_type"]: (row["files_seen"], row["files_processed"]) for row in rows}
    assert counted["csv"] == (9, 7) and counted["docx"] == (2, 1) and counted["doc"] == (1, 0)
    assert counted["txt"] == (2, 0)
    walked = sum(len(names) for _, _, names in os.walk(folder))
    assert sum(seen for seen, _ in counted.values()) == walked


def test_hidden_and_empty_files(extracted, folder):
    row = extracted["_budget.csv"]
    assert row["file_path"] == f"file:{folder}/sub/_budget.csv"
    assert row["content"] == extracted["c.csv"]["content"]
    assert extracted[".notes.CSV"]["file_type"] == "csv"
    assert extracted["empty.csv"]["content"] is None and extracted["empty.csv"]["reason"]


def test_index_a_folder(spark, folder, tmp_path):
    index = DocumentIndex.create(spark, str(tmp_path / "index"))
    batch = index_folder(index, str(folder))
    assert batch.indexed == 9
    failed = {row["file_path"].rsplit("/", 1)[-1] for row in batch.failed.collect()}
    assert failed >= {"broken.docx", "ragged.csv", "g.doc"}
    opened = DocumentIndex(spark, str(tmp_path / "index"))
    hits = search_documents(opened, "Jane").collect()
    assert {row["file_name"] for row in hits} == {
        "c.csv", "a b é.csv", "p%20q.csv", "_budget.csv", ".notes.CSV",
    }


def test_empty_folder_writes_nothing(spark, tmp_path):
    (tmp_path / "files").mkdir()
    index = DocumentIndex.create(spark, str(tmp_path / "index"))
    batch = index_folder(index, str(tmp_path / "files"))
    assert batch.batch_id is None and batch.failed.collect() == []
    assert DocumentIndex(spark, str(tmp_path / "index")).batches == []
