"""The registered queries on the smallest tables, against SQL where there is some."""
import os
import zlib

import pytest

from vidimus.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    from compare import check, connect

    ok, message = check(spark, connect(SF), name, QUERIES[name], SQL[name], SF)
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_one_row_a_document_at_least(spark, name):
    docs = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    got = [r["doc_id"] for r in QUERIES[name](spark, SF).collect()]
    assert set(got) == docs
    assert name == "op10_best_fit" or len(got) == len(docs)


def test_held_out_accuracy_of_the_classifier(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet").collect()}
    rows = QUERIES["op2_quality_pu"](spark, SF.replace("0.001", "0.01")).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) > 0.95


def test_pipeline_stages_filter_and_pack(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, seen, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-test-{name}"
        out.write.mode("overwrite").parquet(path)
        kept = spark.read.parquet(path)
        assert {r["doc_id"] for r in kept.collect()} <= {r["doc_id"] for r in seen.collect()}
        seen = kept
    packed = p.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in seen.collect()}
