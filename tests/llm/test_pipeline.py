"""The pipeline's stages on the driver's small tables with messy rows, and on nothing."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomscan.llm import queries

from .helpers import CLASHES, MESSY
from .test_texts import components, hits

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def _docs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(None if i is None else i + 10**6, t, "en", "src1", len(t or "")) for i, t in MESSY], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.unionByName(more).withColumns({c: F.lit("x") for c in CLASHES})


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    docs = _docs(spark)
    docs.write.parquet(str(tmp_path / "0"))
    docs = spark.read.parquet(str(tmp_path / "0"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k == len(corpus_pipeline.STAGES) - 1:
            assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
            break
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(str(tmp_path / str(k + 1)))
        after = spark.read.parquet(str(tmp_path / str(k + 1)))
        before, now = {(r.doc_id, r.text) for r in docs.collect()}, {(r.doc_id, r.text) for r in after.collect()}
        if name == "near_copies":
            groups = components([(i, t) for i, t in before if i is not None])
            assert now == {(i, t) for i, t in before if i is None or groups[i][1] == i}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            judged = {(i, t): hits(t, items) for i, t in before}
            assert now == {k for k, (n, h, _) in judged.items() if not (h > 0 and 20 * h >= n)}
        elif name == "secrets":
            assert after.count() == docs.count() and len(before - now) < 0.1 * len(before)
            assert after.where("n_chars <> length(text)").count() == 0
        else:
            assert now <= before and {i for i, _ in now} > {10**6 + i for i, _ in MESSY if i is not None} - {10**6 + 7}
        docs = after


def test_stages_on_nothing(spark, tmp_path):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_run_and_queries_return_a_row_for_each_document(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_stupid_backoff", "op2_secret_scan", "op3_jaccard_join", "op4_license_scan", "op7_toxicity", "op8_kd_sharding", "op10_decontamination"):
        assert queries.QUERIES[name](spark, SF).count() == n
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_trigram_scores_are_those_of_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = {r[0]: r[1:4] for r in con.execute(queries.ORACLE_SQL["op1_stupid_backoff_trigrams"]).fetchall()}
    got = {r.doc_id: (r.n_words, r.n_backoff, r.micro) for r in queries.QUERIES["op1_stupid_backoff_trigrams"](spark, SF).collect()}
    assert got == expected and any(b for _, b, _ in got.values())
