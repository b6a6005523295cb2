from pyspark.sql import functions as F

from quillmill.functions import names, text


def one(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.v for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_names_from_addresses(spark):
    emails = ["wang.xiaoming@x.edu.cn", "xiaoming_wang-li@x", "info.wang@x", "a.wang@x", "li@x", "wang.2020@x", None]
    assert one(spark, emails, names.name_from_email) == ["Wang Xiaoming", "Xiaoming Wang Li", None, None, None, None, None]
    urls = ["https://x.cn/teacher/wang-xiaoming", "https://x.cn/en/faculty/Zhang.San/index.htm", "https://x.cn/teacher/wang", "https://x.cn/news/a-b", None]
    assert one(spark, urls, names.name_from_url) == ["Wang Xiaoming", "Zhang San", None, None, None]


def test_pinyin_given_first(spark):
    table = {"王": "wang", "小": "xiao", "明": "ming", "欧": "ou", "阳": "yang"}
    got = one(spark, ["王小明", "欧阳小明（教授）", "王", "欧阳", "Ann Lee", "", None], lambda c: names.pinyin_given_first(c, table))
    assert got == ["Xiaoming Wang", "Xiaoming Ouyang", None, None, None, None, None]


def test_junk_english_names(spark):
    rows = [("science", None, None), ("J. Physics", None, None), ("Journal of Tests", None, "0000-1"), ("", "IJCSMA", ""), ("Ann Lee", None, None), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, e string, z string, o string")
    got = df.orderBy("i").select(names.junk_english_name(F.col("e"), F.col("z"), F.col("o")).alias("j")).collect()
    assert [r.j for r in got] == [True, True, False, True, False, False]


def test_menus_keys_topics_titles(spark):
    assert one(spark, ["学院概况 学院简介 更多", "他研究数学", None], text.bio_or_null) == [None, "他研究数学", None]
    assert one(spark, ["武汉大学", "x", None], text.university_key) == ["whu", None, None]
    assert one(spark, ["图像识别， a；machine learning\n" + "、".join(f"topic{i}" for i in range(20)), "", None], text.topics) == [["图像识别", "machine learning"] + [f"topic{i}" for i in range(13)], [], None]
    assert one(spark, ["发表论文", "已发表学术30篇", "在国际会议发表", "共12篇", "图像识别方法", None], text.suspicious_title) == [True, True, True, True, False, False]
