"""Every file comes from one of the two sources, once."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioseek.sources import omitted
from folioseek import DocumentIndex, count_files, index_folder, index_new_files, process_folder
from folioseek.sources.extraction import extract_documents
from folioseek.sources.files import file_records, scan_folder
from folioseek.sources.folders import ArrowFolder, arrow_folder, storage_settings

NAMES = [
    "plain.csv",
    "empty.csv",
    "_hidden.csv",
    ".hidden.csv",
    "_a=b.csv",
    "_metadata.csv",
    "moving.csv._COPYING_",
    "sub/plain.csv",
    "sub/_archive/report.csv",
    "sub/_archive/deep/er/report.csv",
    "sub/_archive/_x=1/report.csv",
    ".git/report.csv",
    ".git/empty.csv",
    "_x=1/report.csv",
    "_x=1/_hidden.csv",
    "_metadata_of/report.csv",
    "under._COPYING_/report.csv",
]


def write(root):
    for name in NAMES:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"" if "empty" in name else f"text\n{name}\n".encode())


@pytest.fixture(params=["file", "viewfs"])
def address(request, spark, tmp_path):
    """A folder of NAMES, plainly and by a scheme that only Hadoop knows."""
    root = tmp_path / "_root"
    write(root)
    if request.param == "file":
        return str(root), root
    table = f"t{abs(hash(str(tmp_path)))}"
    conf = spark._jsc.hadoopConfiguration()
    conf.set(f"fs.viewfs.mounttable.{table}.link./in", f"file://{tmp_path}")
    return f"viewfs://{table}/in/_root", root


def relative(path, root):
    return path.split(f"/{root.name}/", 1)[1]


@pytest.mark.parametrize("folders", [1, 3, 1000])
def test_each_file_once(spark, address, monkeypatch, folders):
    monkeypatch.setattr(omitted, "FOLDERS", folders)
    folder, root = address
    for types in ((), ("csv",)):
        rows = scan_folder(spark, folder, types).collect()
        got = Counter(relative(r.path, root) for r in rows)
        assert got == Counter(n for n in NAMES if not types or n.endswith(".csv"))
        for r in rows:
            assert r.length == (root / relative(r.path, root)).stat().st_size
            assert (r.content is None) == r.omitted


def test_contents_of_omitted_files(spark, address):
    folder, root = address
    rows = process_folder(spark, folder).collect()
    assert {relative(r.file_path, root) for r in rows} == {n for n in NAMES if n.endswith(".csv")}
    for r in rows:
        name = relative(r.file_path, root)
        if "empty" in name:
            assert r.content is None and r.reason
        else:
            assert name in r.content and r.reason is None


def test_index_and_count(spark, address, tmp_path):
    folder, root = address
    index = DocumentIndex.create(spark, str(tmp_path / "index"))
    csv = [n for n in NAMES if n.endswith(".csv")]
    batch = index_folder(index, folder)
    assert batch.indexed == sum("empty" not in n for n in csv) and batch.quarantined == sum("empty" in n for n in csv)
    again = index_new_files(DocumentIndex(spark, index.path), folder)
    assert again.batch_id is None
    (root / "sub/_archive/report.csv").write_text("text\nlonger than before\n")
    assert index_new_files(DocumentIndex(spark, index.path), folder).indexed == 1
    seen = {r.file_type: r.files_seen for r in count_files(spark, folder).collect()}
    assert seen["csv"] == len(csv) and sum(seen.values()) == len(NAMES)


def test_listing_reads_no_contents(spark, address):
    folder, _ = address
    text = file_records(scan_folder(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in text and "content#" not in text and "content:" not in text


def test_large_hidden_files_stay_closed(spark, tmp_path):
    """The bound on the length stands below the step that opens files."""
    (tmp_path / "_large.csv").write_bytes(b"x" * 5000)
    (tmp_path / "_small.csv").write_bytes(b"a\n1\n")
    found = extract_documents(scan_folder(spark, str(tmp_path)), max_bytes=1000)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "(length#" in text[text.index("MapInArrow") :] and "<= 1000" in text[text.index("MapInArrow") :]
    rows = {r.file_name: r.reason for r in found.collect()}
    assert rows == {"_large.csv": "too_large", "_small.csv": None}


def test_one_unreadable_file_stops_no_other(spark, tmp_path):
    for name in ("_a.csv", "_gone.csv", "_z.csv"):
        (tmp_path / name).write_bytes(b"a\n1\n")
    files = scan_folder(spark, str(tmp_path)).filter("omitted")
    lost = files.withColumn("stored_at", F.regexp_replace("stored_at", "_gone", "_never"))
    rows = {r.file_name: r.reason for r in extract_documents(lost).collect()}
    assert rows == {"_a.csv": None, "_gone.csv": "unreadable", "_z.csv": None}


def test_storage_of_buckets(spark):
    conf = spark._jsc.hadoopConfiguration()
    pairs = {
        "fs.s3a.access.key": "general",
        "fs.s3a.secret.key": "s",
        "fs.s3a.endpoint": "http://127.0.0.1:9",
        "fs.s3a.bucket.mine.access.key": "own",
    }
    for key, value in pairs.items():
        conf.set(key, value)
    try:
        settings = storage_settings(spark)
        assert pairs.items() <= settings.items()
        folder = arrow_folder(spark, "s3a://mine/files")
        system, path = folder._open("s3a://mine/files/a.csv")
        assert type(system).__name__ == "S3FileSystem" and path == "mine/files/a.csv"
        assert arrow_folder(spark, "unheardof://x/y") is None
    finally:
        for key in pairs:
            conf.unset(key)


def test_paths_are_spelt_as_given(tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "c%20é.csv").write_text("x")
    folder = ArrowFolder(f"file:{tmp_path}", {})
    (below,) = folder.listed(folder.address)
    assert below.path == f"file:{tmp_path}/a b" and below.is_folder
    (found,) = folder.listed(below.path)
    assert found.name == "c%20é.csv" and folder.read(found.path) == b"x"
