import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from quillmill.llm import licenses
from quillmill.llm.common import documents
from quillmill.llm.queries import ORACLES, QUERIES


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("kept", F.col("n_chars")).withColumn("row_id", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count() < 200


def test_stages_on_odd_rows(spark, make, sf_dir):
    docs = make([(1, None), (2, ""), (None, "und so weiter"), (3, "plain words of a text"), (3, "plain words of a text"), (4, "123")])
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).count()
        assert stage(spark, docs.where("false"), sf_dir).count() == 0, name


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = con.sql(ORACLES[name]).df()[list(got.columns)]
    key = {"op11_spelling": "word", "op13_centroids": "vec_id"}.get(name, "doc_id")
    told = lambda df: [tuple(str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in df.astype(object).where(df.notna(), None).sort_values(key).itertuples(index=False)]
    assert told(got) == told(want)


def test_known_licences(spark):
    mit = licenses.TEXTS[0][1]
    rows = [(1, mit.replace("sublicense", "sub-licence").upper() + "\nCopyright (c) 2020 X Y\n"), (2, None), (3, "..."), (4, "Copyright 2019 A.\nAll rights reserved.\n" + licenses.TEXTS[5][1]), (5, mit + " and more"), (6, "words\nreleased under the MIT Licence\nmore"), (7, "")]
    got = {r.doc_id: (r.license_id, r.notice_ids) for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", ""), 2: (None, ""), 3: (None, ""), 4: ("BSD-2-Clause", ""), 5: (None, ""), 6: (None, "MIT"), 7: (None, "")}


def test_licence_scan_is_linear_and_takes_tables(spark, make, tmp_path):
    import time

    (tmp_path / "Own-1.0.txt").write_text("Do what you like.\n\nCopyright (c) 1999 Me")
    more = licenses.text_files(spark, str(tmp_path))
    docs = make(["\n" * 1_000_000, "DO what you -- like", " \t" * 500_000, "\n *" * 300_000]).withColumn("text_digest", F.lit(1))
    start = time.time()
    got = {r.doc_id: r.license_id for r in licenses.licenses(docs, more=more).collect()}
    assert got == {0: None, 1: "Own-1.0", 2: None, 3: None} and time.time() - start < 60
    assert licenses.licenses(docs.where("false")).count() == 0


def test_pipeline_leaves_no_tables_behind(spark, sf_dir, tmp_path):
    import os

    from quillmill.llm import common

    before = common._own_scratch
    common._own_scratch = str(tmp_path)
    try:
        rows = corpus_pipeline.run(spark, sf_dir)
        assert rows.count() > 0
        size = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path) for f in fs)
        assert size < 2 * os.path.getsize(f"{sf_dir}/documents.parquet")
    finally:
        common._own_scratch = before
