import threading

import pytest
from pyspark.sql import functions as F

from quillmill.operators.matching import upsert
from quillmill.operators.snapshot import Conflict, Store
from quillmill.sources import pages


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_readers_see_all_tables_of_a_commit_or_none(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.versions() == [] and store.manifest() == {}
    one = store.commit({"reports": spark.createDataFrame([(1, "PENDING")], "id int, status string"), "persons": spark.createDataFrame([(7, 50.0)], "id int, score double")})
    before = store.read("persons")

    approved = store.read("reports").withColumn("status", F.lit("APPROVED"))
    fails = store.read("persons").withColumn("score", F.expr("raise_error('lost')").cast("double"))
    with pytest.raises(Exception, match="lost"):  # the job dies between its tables
        store.commit({"reports": approved, "persons": fails})
    assert store.versions() == [one] and rows(store.read("reports")) == [(1, "PENDING")] and rows(store.read("persons")) == [(7, 50.0)]

    two = store.commit({"reports": approved, "persons": store.read("persons").withColumn("score", F.col("score") + 2)})
    assert (one, two) == (1, 2) and rows(store.read("reports")) == [(1, "APPROVED")] and rows(store.read("persons")) == [(7, 52.0)]
    assert rows(before) == [(7, 50.0)] and rows(store.read("persons", one)) == [(7, 50.0)]
    three = store.commit({"reports": upsert(store.read("reports"), spark.createDataFrame([(1, None), (2, "NEW")], "id int, status string"), ["id"])})
    assert rows(store.read("reports", three)) == [(1, "APPROVED"), (2, "NEW")] and rows(store.read("persons", three)) == [(7, 52.0)]
    assert store.vacuum(keep=1) == 5 and store.versions() == [three]  # three superseded tables and two of the lost job
    assert rows(store.read("reports")) == [(1, "APPROVED"), (2, "NEW")]


def test_a_commit_on_an_old_version_is_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    base = store.commit({"t": spark.range(1)})
    store.commit({"t": spark.range(2)}, base=base)
    with pytest.raises(Conflict):
        store.commit({"t": spark.range(9)}, base=base)
    assert store.read("t").count() == 2


def test_of_writers_at_once_one_wins(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    base, told = store.commit({"t": spark.range(0)}), []

    def write(n):
        try:
            told.append(store.commit({"t": spark.range(n)}, base=base))
        except Conflict:
            told.append(None)

    writers = [threading.Thread(target=write, args=(n,)) for n in (1, 2, 3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(t is None for t in told) == [False, True, True] and store.read("t").count() in (1, 2, 3)


BASE = "http://a.edu.cn/b/c/d.htm?q=1#f"


@pytest.mark.parametrize(
    "base, href, want",
    [
        (BASE, "g", "http://a.edu.cn/b/c/g"), (BASE, "./g", "http://a.edu.cn/b/c/g"), (BASE, "g/", "http://a.edu.cn/b/c/g/"), (BASE, "/g", "http://a.edu.cn/g"), (BASE, "//g.cn/x", "http://g.cn/x"),
        (BASE, "?y", "http://a.edu.cn/b/c/d.htm?y"), (BASE, "g?y/./x", "http://a.edu.cn/b/c/g?y/./x"), (BASE, "#s", "http://a.edu.cn/b/c/d.htm?q=1#s"), (BASE, "", "http://a.edu.cn/b/c/d.htm?q=1"),
        (BASE, ".", "http://a.edu.cn/b/c/"), (BASE, "..", "http://a.edu.cn/b/"), (BASE, "../g", "http://a.edu.cn/b/g"), (BASE, "../../../../g", "http://a.edu.cn/g"), (BASE, "/./g/../h", "http://a.edu.cn/h"),
        (BASE, "https://x.cn/../y", "https://x.cn/../y"), (BASE, "mailto:a@b.cn", "mailto:a@b.cn"), (BASE, " g ", "http://a.edu.cn/b/c/g"), ("http://a.cn", "g", "http://a.cn/g"), (BASE, None, None), (None, "g", None),
    ],
)
def test_addresses_are_made_whole(spark, base, href, want):
    table = spark.createDataFrame([(base, href)], "b string, h string")
    assert table.select(pages.resolved(F.col("b"), F.col("h"))).first()[0] == want


def test_links_to_persons(spark):
    html = """<base href="/szdw/"><a class=x href="teacher/1.htm">王小明</a> <a href="../teacher/1.htm">王小明</a><a href="//b.edu.cn/info/1/2.htm"><b>李四</b></a>
<a href="/teacher/list.htm">张三</a><a href="/teacher/2.htm">教师招聘</a><a href="/teacher/3.htm">首页</a><a href="http://evil.com/teacher/4.htm">赵六</a><a href="http://notedu.cn/teacher/4.htm">赵六</a>
<a href="/x/detail/5">查看详情</a><a href="/x/detail/6">more on</a><a href="javascript:void(0)">王五</a><a href="#a">王五</a><a href="/plain">王五</a><a href="/zj/js/7.php"> 钱七 </a>"""
    table = spark.createDataFrame([(1, "http://cs.a.edu.cn/index.htm", html), (2, "http://cs.a.edu.cn", None), (3, None, '<a href="/teacher/9">王五</a>')], "page_id long, url string, html string")
    assert rows(pages.discovered(table)) == sorted((1, x) for x in ("http://cs.a.edu.cn/szdw/teacher/1.htm", "http://cs.a.edu.cn/teacher/1.htm", "http://b.edu.cn/info/1/2.htm", "http://cs.a.edu.cn/x/detail/6", "http://cs.a.edu.cn/zj/js/7.php"))
    only = spark.createDataFrame([("B.edu.cn",)], "domain string")
    assert rows(pages.discovered(table, only)) == [(1, "http://b.edu.cn/info/1/2.htm")]


PAGE = "<html><head>{}</head><body>" + "清华大学计算机科学与技术系，教授，研究方向：自然语言处理。" * 6 + "</body></html>"


def test_bytes_of_many_charsets(spark, tmp_path):
    meta = '<meta charset="{}">'
    files = {
        "gbk": (PAGE.format(meta.format("gb2312")).encode("gbk"), None), "utf8": (PAGE.format("").encode(), None), "big5": ("<p>臺灣大學資訊工程學系</p>".encode("big5"), "Big5"), "gb18030": ("\U00020000".encode("gb18030") + b"x", "gb18030"),
        "wrong": (PAGE.format("").encode("gbk"), "utf-8"), "lying": (PAGE.format(meta.format("iso-8859-1")).encode("gbk"), None), "latin": ("déjà".encode("latin-1"), "ISO-8859-1"), "odd": ("清".encode("gbk"), "no-such"),
    }
    for name, (content, _) in files.items():
        (tmp_path / name).write_bytes(content)
    read = spark.read.format("binaryFile").load(str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("key"), "content")
    told = spark.createDataFrame([(n, c) for n, (_, c) in files.items()] + [("none", None)], "key string, charset string")
    rows = pages.decoded(told.join(read, "key", "left"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString() and "InPandas" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {r.key: r.text for r in rows.collect()}
    assert got == {
        "gbk": PAGE.format(meta.format("gb2312")), "utf8": PAGE.format(""), "big5": "<p>臺灣大學資訊工程學系</p>", "gb18030": "\U00020000x", "wrong": PAGE.format(""), "lying": PAGE.format(meta.format("iso-8859-1")),
        "latin": "déjà", "odd": "清", "none": None,
    }
    empty = spark.createDataFrame([(1, bytearray(b""), None), (2, bytearray(b""), "gbk")], "key int, content binary, charset string")
    assert [r.text for r in pages.decoded(empty).collect()] == ["", ""] and pages.decoded(empty.where("false")).count() == 0
