import pytest
from pyspark.sql import functions as F

from quillmill.operators import keyword_rules
from quillmill.sources import pages, profiles

FULL = """<html><head><title>王小明 - 计算机学院 - 某大学</title><meta name="description" content="Home of Xiaoming Wang"></head><body>
<p>姓名：副主任王小明</p><p>英文名：Deep Learning</p><p>职称：教授</p><p>邮箱：wang.xiaoming [at] uni.edu [dot] cn</p>
<p>个人简介：王小明长期从事自然语言处理与机器翻译的研究工作，曾获多项奖励与荣誉。研究方向：自然语言处理、图像识别,数据库，AI 教育背景</p>
<p>发表论文：[1] Wang X, Li Y. Deep parsing of text. Journal of Tests, 2019. doi:10.1234/abc.5; [2] 短 ; 3. Li Y. Graph methods for parsing, IEEE Transactions on Tests, 2020 科研项目</p>
<p>竞赛获奖：1. 指导学生获全国大学生数学建模竞赛一等奖；2. 省级程序设计大赛二等奖；短 评比</p><p>荣誉称号：入选长江学者奖励计划特聘教授；优秀教师一等奖 联系方式</p></body></html>"""
LD = """<title>李四 教授</title><p>姓名：李四</p><script type="application/ld+json">{"@type": "ScholarlyArticle", "name": "A study of things", "author": [{"name": "Li Si"}], "datePublished": "2021-02-03"}</script>
<h2>研究方向</h2><p>量子计算、拓扑绝缘体</p><h2>论文</h2><p>[1] Li S. Some other paper, Journal of Physics, 2020</p><img src="x" alt="Si Li"><p>联系：li#phys.edu.cn</p>"""


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [
        (1, "http://cs.uni.edu.cn/teacher/wang.html", FULL), (2, "http://x.uni.edu.cn/physics/people/7.htm", LD), (3, "u", "<title>首页</title>"), (4, "u", None), (5, "u", ""),
        (6, "u", "<p>姓名：王五</p>" + '<a href="x">y</a>' * 501), (7, "u", "<p>姓名：王</p>"), (8, None, "<p>姓名：张三丰教授 " + "他在山中研究太极与内功多年，著述甚多。" * 6 + "</p>"), (8, None, "<p>姓名：张三丰</p>"),
    ]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("plain", F.lit(1)).withColumn("found", F.lit(2))
    return {(r.page_id, r.bio is None): r for r in profiles.profiles(table, university=F.lit("某大学")).collect()}


def test_labels_come_first(parsed):
    r = parsed[1, False]
    assert (r.name_zh, r.title, r.institution, r.email) == ("王小明", "教授", "某大学", "wang.xiaoming@uni.edu.cn")
    assert r.name_en == "Wang Xiaoming"  # the label is a subject, the address tells
    assert r.bio.startswith("王小明长期从事") and r.department is not None
    assert list(r.research_updates) == ["自然语言处理", "图像识别", "数据库"]
    assert [(p.year, p.doi) for p in r.publications] == [(2019, "10.1234/abc.5"), (2020, None)] and r.publication_count == 2
    assert [(c.level is not None, c.award) for c in r.competition_updates] == [(True, "一等奖/金奖"), (True, "二等奖/银奖")]
    assert len(r.evaluation_updates) == 2
    assert r.fields[0] in ("natural-language-processing", "computer-vision") and len(r.fields) <= 5


def test_chains_go_on_to_sections_images_and_json(parsed):
    r = parsed[2, True]
    assert (r.name_zh, r.email, r.name_en) == ("李四", "li@phys.edu.cn", "Si Li")
    assert [p.title for p in r.publications] == ["A study of things"] and r.publications[0].authors == ["Li Si"]
    assert list(r.research_updates) == ["量子计算", "拓扑绝缘体"]
    assert r.fields[:2] == ["quantum-computing", "condensed-matter"]


def test_pages_that_are_no_profile_have_no_row(parsed):
    assert sorted(k[0] for k in parsed) == [1, 2, 8, 8]
    free, bare = parsed[8, False], parsed[8, True]
    assert free.name_zh == "张三丰" and "他在山中" in free.bio and bare.publications == [] and bare.publication_count is None


def test_patterns_can_be_overridden(spark):
    table = spark.createDataFrame([(1, "u", "<p>Who: Ann</p>")], "page_id long, url string, html string")
    got = profiles.profiles(table, {"name_zh": (r"Who: (\w+)",)}, not_name=lambda c: F.lit(False)).collect()
    assert [(r.name_zh, r.fields) for r in got] == [("Ann", [])]
    assert profiles.profiles(table.where("false")).count() == 0


def test_research_rules(spark):
    rules = keyword_rules.research_rules()
    assert len(rules) == 157
    rows = [(1, "自然语言处理与NLP"), (2, "nlp of the Art and law"), (3, None), (4, "AI"), (5, "car-t cells and CAR\nT; P=NP"), (6, "lawful artless"), (7, "统计 " * 40_000 + "密码学")]
    table = spark.createDataFrame(rows, "id long, t string").withColumn("h", keyword_rules.rule_hits(F.col("t")))
    got = {r.id: list(r.f) for r in table.select("id", keyword_rules.best_fields(F.col("h")).alias("f")).collect()}
    # P=NP: the automaton knows the single wild card; a field counts by its best rule, equal ones by their first.
    assert got == {1: ["natural-language-processing"], 2: ["natural-language-processing", "law", "arts"], 3: [], 4: [], 5: ["computational-complexity", "immunotherapy", "algorithms"], 6: [], 7: ["cryptography"]}


def test_rules_equal_regular_expressions():
    import random
    import re

    rules, rng = keyword_rules.research_rules(), random.Random(1)
    words = ["".join(c or "-" for c in s) for r in rules for s in keyword_rules.written_out(r.pattern)[0]]
    texts = ["".join(rng.choice([w, w.upper(), w[:-1], " ", w + "s", "，", "\n"]) for w in rng.sample(words, 6)) for _ in range(600)]
    matcher, compiled = keyword_rules.Matcher(rules), [re.compile(r.pattern, re.A | (re.I if r.ignore_case else 0)) for r in rules]
    for t in texts:
        assert matcher.hits(t) == [i for i, p in enumerate(compiled) if len(t) >= 3 and p.search(t)]
    with pytest.raises(ValueError):
        keyword_rules.written_out("a+b")


def test_json_ld_of_pages_and_rows_agree(spark):
    table = spark.createDataFrame([(2, "u", LD), (3, "u", None), (4, "u", '<script type="application/ld+json">no json</script>')], "page_id long, url string, html string")
    assert [(r.page_id, r.title, r.year) for r in pages.json_ld_publications(table).collect()] == [(2, "A study of things", 2021)]


def test_fields_of_addresses(spark):
    urls = [("http://cs.uni.edu.cn/x",), ("https://www.uni.edu.cn/math/physics/bio",), ("http://u.cn/cscw/chemx",), (None,), ("",), ("http://SOFT.u.cn/ai",), ("http://信息.u.cn",), ("http://信息安全.u.cn",)]
    got = [list(r[0]) for r in spark.createDataFrame(urls, "u string").coalesce(1).select(keyword_rules.from_url(F.col("u"))).collect()]
    assert got == [["computer-science"], ["mathematics", "physics"], [], [], [], ["artificial-intelligence", "computer-science"], ["computer-science"], ["cybersecurity"]]
