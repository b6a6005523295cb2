from quillmill.plans import queries_checks
from quillmill.sources import pages


def test_layouts_are_worked_out_once_a_page(spark, sf_dir):
    plan = queries_checks.QUERIES["page_layouts"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # One for headings, titles and labels each, two for cells.
    assert plan.count("regexp_extract_all") == 5


def test_keys_of_one_row_group_are_dealt_out(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(queries_checks, "KEYS_A_TASK", 200, raising=False)
    assert spark.read.parquet(f"{sf_dir}/orders.parquet").count() == 1500
    assert queries_checks.QUERIES["page_layouts"](spark, sf_dir).rdd.getNumPartitions() == 8


def test_sections_fall_through_the_layouts(spark):
    texts = [
        None, "", "<p>研究方向</p>", "<h2></h2><p>研究方向：图论与网络</p>", '<td>职称</td><td>教授与导师</td><b class="title">AB</b>short',
        '<b class="title">AB</b>long enough<h2>One</h2>two',
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")
    got = [(r.page_id, r.seq, r.layout, r.heading, r.content) for r in pages.sections(rows).orderBy("page_id", "seq").collect()]
    assert got == [(3, 0, "label", "研究方向", "图论与网络"), (4, 0, "cell", "职称", "教授与导师"), (5, 0, "heading", "One", "two")]
    found = {r.page_id: r.found for r in pages.with_sections(rows).collect()}
    assert found[0] is None and found[1] == [] and found[2] == []
