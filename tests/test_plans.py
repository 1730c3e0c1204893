"""What the physical plans must look like to hold at scale."""

import re

import pytest
from pyspark.sql import Row, functions as F

from conftest import as_documents
from folioseek import DocumentIndex, advanced_search, index_documents, search_documents, search_many
from folioseek.operators import postings
from folioseek.operators.changes import latest_versions, one_per_path
from folioseek.operators.filters import Filters, after_hit, ordering, top
from folioseek.operators.matching import near_literals
from folioseek.operators.postings import build_postings, clustered as cluster_postings, describe_files, range_borders
from folioseek.operators.ranks import with_places
from folioseek.plans import search, store
from folioseek.sources.files import file_records, scan_folder
from folioseek.sources.records import stored_rows

ROWS = [(f"/t/{n}.csv", "csv" if n % 2 else "pdf", f"common word{n}") for n in range(40)]


def plan(rows):
    return rows._jdf.queryExecution().explainString(
        rows.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture(scope="module")
def index(make_index):
    return make_index(ROWS)


def scored(index, text, fuzziness="AUTO", filters=Filters()):
    terms = search.query_terms(index, text, fuzziness)
    return search._scored(index, terms, filters)


def test_building_postings_does_not_shuffle(spark):
    rows = stored_rows(as_documents(spark, ROWS))
    assert "Exchange" not in plan(build_postings(rows))


def test_one_term_search_does_not_shuffle(index):
    text = plan(scored(index, "common", 0))
    assert "Exchange hash" not in text and "BroadcastExchange" in text


def test_search_shuffles_once_and_pushes_terms_and_filters(index):
    text = plan(scored(index, "common word3", filters=Filters(file_type="csv", min_size=1)))
    assert text.count("hashpartitioning") == 1
    assert "SortMergeJoin" not in text and "Python" not in text
    pushed = next(line for line in text.splitlines() if line.startswith("PushedFilters"))
    assert "In(term" in pushed and "EqualTo(file_type,csv)" in pushed
    assert "GreaterThanOrEqual(file_size,1)" in pushed
    assert "positions" not in next(x for x in text.splitlines() if x.startswith("ReadSchema"))


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """A larger index: a frequent word, with all weights, and many rare ones."""
    folder = str(tmp_path_factory.mktemp("clustered"))
    rows = [
        (f"/c/{n}.csv", "csv", " ".join(["the"] * (n % 23 + 1) + [f"rare{n}"] + ["filler"] * (n * 7 % 61)))
        for n in range(600)
    ]
    DocumentIndex.create(spark, folder, term_buckets=4)
    least = store.POSTINGS_BYTES
    store.POSTINGS_BYTES = 1000
    index_documents(DocumentIndex(spark, folder), as_documents(spark, rows), unique_paths=True)
    index_documents(DocumentIndex(spark, folder), as_documents(spark, rows[:40]), unique_paths=True)
    store.POSTINGS_BYTES = least
    return DocumentIndex(spark, folder)


def opened(rows):
    return {f for f in rows.inputFiles() if "/postings/" in f}


def test_rare_term_opens_one_file_and_a_frequent_one_spreads(clustered):
    everything = opened(clustered.posting_versions())
    rare = opened(scored(clustered, "rare17", 0))
    frequent = opened(scored(clustered, "the", 0))
    # One for each batch; a border between files may fall on the term.
    assert 1 <= len(rare) <= 3 and len(everything) > 20
    assert len(frequent) >= 6
    spans = clustered.posting_places({"the": clustered.spark.sql("SELECT xxhash64('the')").first()[0]})
    assert {r["file"] for r in spans} == {f.rsplit("/", 1)[1] for f in frequent}


@pytest.mark.parametrize("text", ["the", "the rare17", "the filler", "the nothing"])
@pytest.mark.parametrize("size", [1, 10, 130, 900])
def test_top_opens_no_file_that_cannot_hold_a_hit(clustered, text, size):
    every = search_documents(clustered, text, None, fuzziness=0).select("file_path", "score").collect()
    hits = search_documents(clustered, text, size, fuzziness=0).select("file_path", "score").collect()
    assert hits == every[:size]
    terms = search.query_terms(clustered, text, 0)
    files = opened(search._scored(clustered, terms, Filters(), size))
    whole = opened(search._scored(clustered, terms, Filters()))
    assert files <= whole
    if text == "the" and size <= 10:
        assert 2 * len(files) < len(whole)


@pytest.mark.parametrize("sort", [{}, {"sort_by": "file_size", "sort_order": "asc"}])
def test_many_hits_are_joined_and_not_collected(clustered, monkeypatch, sort):
    few = advanced_search(clustered, "the filler", fuzziness=0, size=30, **sort).select("file_path", "score").collect()
    monkeypatch.setattr(search, "COLLECTED_HITS", 10)
    many = advanced_search(clustered, "the filler", fuzziness=0, size=30, **sort)
    assert many.select("file_path", "score").collect() == few and len(few) == 30
    assert "LocalTableScan" not in plan(many).split("TakeOrderedAndProject")[0]


def test_batches_with_other_numbers_of_buckets(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    DocumentIndex.create(spark, folder)
    for n, most in enumerate((10**9, 10)):
        monkeypatch.setattr(store, "BUCKET_BYTES", most)
        index_documents(DocumentIndex(spark, folder), as_documents(spark, ROWS[20 * n : 20 * n + 20]))
    index = DocumentIndex(spark, folder)
    assert len(set(index.buckets_of.values())) == 2
    assert search_documents(index, "common", None, fuzziness=0).count() == 40
    queries = spark.createDataFrame([(1, "common"), (2, "word3 word33")], "query_id int, query_text string")
    found = search_many(index, queries, None, fuzziness=0).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in found} == {1: 40, 2: 2}


def test_hits_are_fetched_by_pushed_paths(index):
    text = plan(search_documents(index, "word3", 1, fuzziness=0))
    assert "file_path,/t/3.csv" in text or "file_path, [/t/3.csv" in text
    assert "hashpartitioning" not in text


def test_near_terms_are_sought_in_folders_of_their_lengths(index):
    near = near_literals(index.term_changes(), ["common"])
    filters = next(x for x in plan(near).splitlines() if x.startswith("PartitionFilters"))
    assert "term_len" in filters


def test_lookup_opens_only_the_files_of_its_hits(spark, tmp_path):
    DocumentIndex.create(spark, str(tmp_path))
    spread = as_documents(spark, ROWS).repartition(40, "file_path")
    index_documents(DocumentIndex(spark, str(tmp_path)), spread, unique_paths=True)
    index = DocumentIndex(spark, str(tmp_path))
    files = {f for f in index.document_versions().inputFiles()}
    assert len(files) > 15
    hits = search_documents(index, "word3", 1, fuzziness=0)
    assert [row["file_path"] for row in hits.collect()] == ["/t/3.csv"]
    opened = [f for f in hits.inputFiles() if "/documents/" in f]
    assert len(opened) == 1
    by_name = advanced_search(index, "common", sort_by="file_name", size=1)
    assert len([f for f in by_name.inputFiles() if "/documents/" in f]) == 1
    assert "SortMergeJoin" not in plan(by_name)


def test_filter_search_reads_no_text(index):
    found = advanced_search(index, file_type="pdf", size=None).select("file_path", "score")
    reads = [line for line in plan(found).splitlines() if line.startswith("ReadSchema")]
    assert reads and not any("content" in line for line in reads)


def test_listing_files_reads_no_bytes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    text = plan(file_records(scan_folder(spark, str(tmp_path))))
    assert "content" not in next(x for x in text.splitlines() if x.startswith("ReadSchema"))


@pytest.mark.parametrize("choose", [one_per_path, latest_versions])
def test_repeated_paths_are_cut_before_the_shuffle(spark, choose):
    rows = stored_rows(as_documents(spark, ROWS)).withColumn("batch_id", F.lit(1))
    text = plan(choose(rows))
    assert text.count("WindowGroupLimit") >= 2


def test_append_lists_only_the_path_buckets_of_its_paths(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    monkeypatch.setattr(store, "BUCKET_PATHS", 5)
    DocumentIndex.create(spark, folder)
    index_documents(DocumentIndex(spark, folder), as_documents(spark, ROWS), unique_paths=True)
    index = DocumentIndex(spark, folder)
    new = as_documents(spark, [(*ROWS[7][:2], "changed"), ("/t/new.csv", "csv", "more")])
    listed = {f for f in index._replaced_by(new).inputFiles() if "/paths/" in f}
    everything = {f for f in index._read("paths", store.PATHS_SCHEMA).inputFiles()}
    assert len(everything) == 8 and 1 <= len(listed) <= 2
    assert index_documents(index, new).indexed == 2
    assert DocumentIndex(spark, folder).count_documents() == len(ROWS) + 1
    # Once more, when the path has a replaced version.
    again = as_documents(spark, [(*ROWS[7][:2], "again"), (*ROWS[9][:2], "again")])
    index_documents(DocumentIndex(spark, folder), again)
    after = DocumentIndex(spark, folder)
    assert after.count_documents() == after.documents().count() == len(ROWS) + 1
    assert search_documents(after, "again", None, fuzziness=0).count() == 2
    assert search_documents(after, "changed", None, fuzziness=0).count() == 0


def test_pages_after_a_hit_skip_nothing(clustered):
    every = search_documents(clustered, "the filler", None, fuzziness=0).select("score", "file_path").collect()
    last = every[399]
    page = search_documents(clustered, "the filler", 10, fuzziness=0, after=tuple(last))
    assert page.select("score", "file_path").collect() == every[400:410]
    found = search._scored(clustered, search.query_terms(clustered, "the filler", 0), Filters())
    cut = top(found.filter(after_hit("score", "desc", tuple(last))), ordering("score", "desc"), 0, 10)
    assert "Offset" not in plan(cut) and "TakeOrderedAndProject" in plan(cut)


@pytest.mark.parametrize("sort_by", ["file_size", "file_type", "modified_at", "file_name"])
@pytest.mark.parametrize("sort_order", ["asc", "desc"])
def test_pages_after_a_hit_in_any_order(clustered, sort_by, sort_order):
    """Also where the sort value is missing, as all times here are."""
    sort = {"sort_by": sort_by, "sort_order": sort_order}
    every = advanced_search(clustered, None, "csv", size=None, **sort).select(sort_by, "file_path").collect()
    after = advanced_search(clustered, None, "csv", size=5, after=tuple(every[99]), **sort)
    assert after.select(sort_by, "file_path").collect() == every[100:105]


def test_places_without_one_task_for_a_query(spark, tmp_path):
    rows = [(q, n * 37 % 11 / 4, f"/p{n}") for q in (1, 2) for n in range(3000 if q == 1 else 5)]
    table = spark.createDataFrame(rows, "query_id int, score double, file_path string").repartition(5)
    saves = []

    def save(found):
        saves.append(plan(found))
        folder = str(tmp_path / str(len(saves)))
        found.write.parquet(folder)
        return spark.read.parquet(folder)

    placed = with_places(table, ["query_id"], ordering("score", "desc"), save)
    wanted = {}
    for q, score, path in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        wanted[q, path] = sum(q == other for other, _ in wanted) + 1
    assert {(r.query_id, r.file_path): r.place for r in placed.collect()} == wanted
    assert "rangepartitioning(query_id" in saves[0] and "Window" not in saves[0]


def test_ranges_are_found_without_cutting_all_texts_twice(spark):
    """Postings come out in ranges of bucket, term and weight, with no range sampled by Spark."""
    rows = as_documents(spark, [(f"/r/{n}.csv", "csv", f"the the rare{n} " + "x " * (n % 7)) for n in range(90)])
    built = build_postings(rows, keep=("file_path",))
    borders = range_borders(built, 4, 9, 1.0)
    dealt = cluster_postings(built, 4, borders)
    assert "rangepartitioning" not in plan(dealt).lower()
    parts = dealt.withColumn("part", F.spark_partition_id()).collect()
    assert sorted(r["term"] for r in parts) == sorted(r["term"] for r in built.collect())
    spans = {}
    for row in parts:
        spans.setdefault(row["part"], []).append((row["term_bucket"], row["term"].encode()))
    assert len(spans) == 9 and max(map(len, spans.values())) <= 3 * len(parts) / 9
    ends = [(min(keys), max(keys)) for _, keys in sorted(spans.items())]
    assert all(left[1] <= right[0] for left, right in zip(ends, ends[1:]))


@pytest.mark.parametrize("buckets, files", [(1, 1), (1, 7), (4, 9), (64, 5)])
def test_ranges_are_the_borders_not_above_a_posting(spark, buckets, files):
    texts = [(f"/p{n}.csv", "csv", "the the filler " + f"word{n % 7} " * (n % 5)) for n in range(80)]
    built = build_postings(as_documents(spark, texts), keep=("file_path",))
    borders = range_borders(built, buckets, files, 1.0)
    rows = postings._in_range(postings._in_order(built, buckets), buckets, borders).collect()
    keys = [postings._as_bytes(tuple(row[name] for name in postings._RANGE_KEYS)) for row in rows]
    expected = [sum(postings._as_bytes(border) <= key for border in borders) for key in keys]
    assert [row["_range"] for row in rows] == expected
    assert len(set(expected)) == files


def test_steps_to_a_range_grow_with_the_borders_of_a_bucket(spark):
    """Ten borders in each bucket take as many comparisons, however many buckets there are."""
    steps = []
    built = build_postings(as_documents(spark, [("/a.csv", "csv", "the filler")]), keep=("file_path",))
    for buckets in (1, 16):
        borders = [(b, f"w{n}", "content", 0, 0) for b in range(buckets) for n in range(10)]
        rows = postings._in_range(postings._in_order(built, buckets), buckets, borders)
        steps.append(rows._jdf.queryExecution().optimizedPlan().toString().count("Project ["))
    assert steps[0] == steps[1] > 0


def test_shuffled_postings_hold_what_cannot_be_computed(spark):
    built = build_postings(as_documents(spark, [("/a.csv", "csv", "the filler")]), keep=("file_path",))
    dealt = cluster_postings(built, 4, range_borders(built, 4, 2, 1.0))
    assert dealt.columns == [*built.columns, "term_bucket"]
    sent = re.search(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", plan(dealt)).group(1)
    assert {name.split("#")[0].strip() for name in sent.split(",")} == {
        "field", "term", "dl", "positions", "is_lead", "file_path", "_range"
    }


def test_highlights_look_terms_up_by_hash(index):
    """Not word by word along the list of all near terms."""
    terms = [Row(field="content", term=f"t{n}", boost=1.0) for n in range(50)]
    documents = index.documents().select(search._marked(index, terms, 5).alias("marked"))
    assert "INSET" in plan(documents) and "array_contains" not in plan(documents)


def test_a_few_queries_leave_the_postings_where_they_are(spark, index, monkeypatch):
    """Terms near a few words are sent to the postings, whatever Catalyst makes of their size."""
    queries = spark.createDataFrame([(1, "common"), (2, "word7")], "query_id int, query_text string")
    with_limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = plan(search_many(index, queries, 5))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_limit)
    assert "BroadcastHashJoin" in found


def test_counts_by_period_and_term_are_dealt_out_by_term_once(index):
    dealt = plan(search.term_changes_over_time(index))
    assert "Union" not in dealt
    assert not re.search(r"hashpartitioning\(turn#\d+L?, term#\d+", dealt)


def test_files_are_described_without_sorting_their_postings(clustered):
    described = plan(describe_files(clustered.posting_versions()))
    assert re.search(r"\) HashAggregate", described)
    rows = describe_files(clustered.posting_versions()).collect()
    saved = [row for found in clustered._places_in({(4, n) for n in range(4)}).values() for row in found]
    key = lambda r: (r["file"], r["field"], r["first_term"], r["last_term"], r["rows"], r["most_tf"], r["least_ratio"])
    assert sorted(map(key, rows)) == sorted(map(key, saved))
