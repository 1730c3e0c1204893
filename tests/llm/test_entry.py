"""The registered queries and the pipeline's stages."""

from pathlib import Path

import pytest
from helpers import documents, prose

import __spark_entry__ as contract
import corpus_pipeline
from folioseek.llm import queries

DATA = Path("/root/testdata/sf0.001")


def test_names():
    found = contract.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(found)
    assert set(contract.oracle_sql()) <= set(found)


def test_pipeline_stages(spark, tmp_path):
    passage = prose("bench", 30)
    rows = [(i, prose(i, 100)) for i in range(20)]
    rows += [(30, prose(0, 100)), (31, "junk " * 60), (32, None), (33, f"{passage} {prose(33, 40)}")]
    rows += [(34, f"{prose(34, 60)} password=abcdefghijklmnop {prose(35, 60)}")]
    docs = documents(spark, rows)
    bench = spark.createDataFrame([(0, passage)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    clean = set(range(20)) | {34}
    assert kept[0] == clean | {30, 33} and kept[1] == clean | {33}
    assert kept[2] == kept[3] == kept[4] == clean


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_run(spark):
    found = corpus_pipeline.run(spark, str(DATA))
    assert found.count() > 0 and "sequence_id" in found.columns
