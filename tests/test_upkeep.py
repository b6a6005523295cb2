import datetime

from pyspark.sql import functions as F

from quillmill.functions import names, publications
from quillmill.operators import fields, matching, upkeep
from quillmill.sources import pages


def test_reference_authors(spark):
    # The names end as soon as at most two words stand before a journal, a parenthesis or a year.
    rows = ["Ann Lee, Bob Ray, Cy Dow, Journal of Tests (2001)", "Smith & Jones IEEE Trans. 2001", "On graphs without end", None, "", "Deep Learning For Vision " * 200 + ": x"]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(publications.reference(F.col("t")).alias("r")).collect()
    assert (got[0].r.authors, got[0].r.title, got[0].r.year) == (["Ann Lee", "Bob Ray", "Cy Dow"], "Journal of Tests (2001)", 2001)
    assert got[1].r.authors == ["Smith"] and got[2].r.authors == [] and got[3].r is None and got[4].r.title == "" and got[5].r.authors == []


def test_nationality_of_nothing(spark):
    got = spark.createDataFrame([(None,) * 6], "a string, b string, c string, d string, e string, f string").select(names.nationality(*[F.col(c) for c in "abcdef"]).alias("n")).first().n
    assert tuple(got) == ("foreign", "无中文标识, 机构: (无)")


def test_scholar_pages(spark):
    html = (
        '<div id="gsc_prf_in">Ann Lee</div><div id="gsc_prf_inw">Professor at Test University, Dept</div><div id="gsc_prf_int"><a href="x">Graphs</a> <a>Maps &amp; trees</a></div>'
        '<table id="gsc_rsb_st"><td class="gsc_rsb_std">1,234</td><td class="gsc_rsb_std">12</td><td class="gsc_rsb_std">0</td></table><table><tbody id="gsc_a_b">'
        '<tr class="gsc_a_tr"><td class="gsc_a_t"><a href="/c1">On graphs</a><div class="gs_gray">A Lee</div><div class="gs_gray">J. Tests, 2001</div></td><td class="gsc_a_c"><a>7*</a></td></tr>'
        '<tr class="gsc_a_tr"><td class="gsc_a_t"><a></a></td></tr></tbody></table>'
    )
    rows = spark.createDataFrame([(1, "https://s.example/c?user=abc&hl=en", html), (2, "https://s.example", ""), (3, None, None)], "page_id int, url string, html string")
    one, two, _ = sorted(pages.scholar_profiles(rows).collect(), key=lambda r: r.page_id)
    assert (one.scholar_id, one.name_en, one.institution, one.citation_count, one.h_index, one.i10_index, one.interests) == ("abc", "Ann Lee", "Test University", 1234, 12, None, ["Graphs", "Maps & trees"])
    assert [tuple(p) for p in one.publications] == [("On graphs", "A Lee", "J. Tests", 2001, 7, "/c1")]
    assert (two.name_en, two.citation_count, two.publications) == (None, None, [])


def test_sections_and_departments(spark):
    rows = spark.createDataFrame([(1, 0, "Intro", "long enough: 研究所 graphs and maps"), (1, 1, "研究所", "abcd"), (2, 0, "x", "研究所：graphs and maps 论文 none"), (3, 0, "x", None)], "page_id int, seq int, heading string, content string")
    assert {r.page_id: r.content for r in pages.section(rows, "研究所").collect()} == {1: "abcd", 2: "graphs and maps "}
    none = spark.createDataFrame([(None, None)], "h string, u string").select(pages.department(F.col("h"), F.col("u"), F.lit(None).cast("string")).alias("d")).first().d
    assert none is None


def test_slugs(spark):
    got = spark.createDataFrame([(["机器人学", None, "Deep  Learning", "deep-learning", "??", "New Field"],), (None,)], "n array<string>").select(fields.slugs(F.col("n")).alias("s")).collect()
    assert got[0].s == ["robotics", "ai-machine-learning", "new_field"] and got[1].s is None


def test_repairs_of_empty_tables(spark):
    links = spark.createDataFrame([], "person_id int, field string")
    inferred = spark.createDataFrame([(1, ["b", "a", "b"])], "person_id int, fields array<string>")
    row = fields.repaired(links, inferred).first()
    assert (row.status, row.added, row.fields) == ("changed", ["a", "b"], ["b", "a"])
    assert fields.repaired(links, inferred.limit(0)).count() == 0
    assert matching.united(spark.createDataFrame([(1, None), (1, ["x", None, "x"])], "id int, a array<string>"), "id", "a").collect() == [(1, ["x"])]


def test_maintenance_cleans_only_what_mends_itself(spark):
    issue = "type string, severity string, entity_id string, detail string, action string"
    persons = spark.createDataFrame([(1, "首页", None, None, None, None, None, True, '{"source": "crawl"}', datetime.datetime(2020, 1, 1))], "id int, name_zh string, name_en string, department string, email string, bio_zh string, h_index int, is_active boolean, metadata string, last_scraped_at timestamp")
    frames = {"person": persons, "publication": spark.createDataFrame([], "person_id int")}
    now = F.lit(datetime.datetime(2021, 1, 1))
    _, same, actions = upkeep.maintenance(frames, [spark.createDataFrame([("A", "low", "1", "", "REVIEW")], issue)], now)
    assert same is frames and actions is None
    _, cleaned, actions = upkeep.maintenance(frames, [spark.createDataFrame([("A", "low", "1", "", "AUTO_FIX")], issue)], now)
    assert cleaned is not frames and actions.count() >= 1


def test_bare_persons_limit_comes_first(spark):
    old, new = datetime.datetime(2020, 1, 1), datetime.datetime(2021, 1, 1)
    rows = spark.createDataFrame([(1, "A", "t", "d", "e", "b", None, old), (2, "A", None, None, None, None, '{"sourceUrl": "u"}', new)], "id int, institution string, title string, department string, email string, bio_zh string, metadata string, last_scraped_at timestamp").withColumn("is_active", F.lit(True))
    assert upkeep.bare_persons(rows, most=1).count() == 0
    assert [tuple(r) for r in upkeep.bare_persons(rows, "A").collect()] == [(2, "A", None, "u", ["title", "department", "email", "bio"])]
    assert tuple(rows.select(upkeep.progress(F.lit(10), F.lit(130), F.lit(20.0)).alias("p")).first().p) == (0.5, 4.0)
