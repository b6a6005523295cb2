"""Rules of requests, records of two services, and lists walked in order."""

import datetime
import json

from pyspark.sql import functions as F

from quillmill.functions import text
from quillmill.operators import metrics, requests
from quillmill.sources import records


def one(spark, kind, **given):
    return spark.range(1).select(requests.problems(kind, {k: F.expr(v) for k, v in given.items()}).alias("p")).first().p


def test_requests(spark):
    assert one(spark, "register", name="'Ann'", email="'ann@uni.edu'", password="'abcdefg1'") == []
    assert one(spark, "register", name="''", email="'ann'", password="'abcdefgh'") == ["name", "email", "password"]
    assert one(spark, "register", name="'Ann'") == ["email", "password"]
    assert one(spark, "edu_email", edu_email="'a@uni.edu.cn'") == [] and one(spark, "edu_email", edu_email="'a@uni.org'") == ["edu_email"]
    assert one(spark, "update_person", email="cast(null as string)") == [] and one(spark, "create_person", name_zh="'x'", field_ids="array()") == ["field_ids"]
    assert one(spark, "person_query", page="'2'", limit="'101'", sort="'by_me'", min_score="'x'") == ["min_score", "sort", "limit"]
    assert one(spark, "search", q="'a'", page="1.5") == ["page"] and one(spark, "search", q="'a'", page="''") == ["page"]
    assert one(spark, "review_report", action="'MAYBE'", score_delta="map('a', 51.0)") == ["action", "score_delta"]
    assert one(spark, "review_report", action="'APPROVE'", score_delta="map('a', -50.0)") == []
    assert one(spark, "create_field", slug="'No'", name_zh="'x'", name_en="'x'") == ["slug"]
    assert one(spark, "update_user") == [] and one(spark, "update_user", role="'KING'") == ["role"]


def test_authors_works(spark):
    rows = [("w1", 3, ["a", "b"]), ("w2", 5, ["a", "a"]), ("w3", None, ["a"]), ("w4", 3, ["a"]), ("w5", 1, [None]), ("w6", 1, None)]
    works = spark.createDataFrame(rows, "id string, citation_count int, author_ids array<string>")
    listed = lambda page: {(r.author_id, r.place): r.id for r in records.author_works(works, page, 3).collect()}
    assert listed(1) == {("a", 1): "w2", ("a", 2): "w1", ("a", 3): "w4", ("b", 1): "w1"}
    assert listed(2) == {("a", 4): "w3"}


def test_papers_of_authors(spark, tmp_path):
    papers = [{"paperId": "p", "title": "T", "year": 2020, "venue": "", "citationCount": 2, "externalIds": {"DOI": "10.1/X"}}, {"paperId": "q", "extra": 1}]
    (tmp_path / "a.json").write_text(json.dumps({"authorId": "7", "papers": papers}))
    got = records.semantic_scholar_papers(spark, str(tmp_path)).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("7", "p", "T", 2020, None, 2, "10.1/x"), ("7", "q", None, None, None, None, None)]


def test_rate_limit_across_batches(spark):
    """A long key spans batches; a null key is a key; no request, no row."""
    start = datetime.datetime(2024, 1, 1)
    rows = [("k", start + datetime.timedelta(seconds=i), i) for i in range(500)] + [(None, start, 1000), (None, start, 1001)]
    requests_ = spark.createDataFrame(rows, "key string, at timestamp_ntz, id long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.id: (r.allowed, r.remaining) for r in metrics.rate_limited(requests_, 3, 10).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {**{i: (i % 10 < 3, max(0, 2 - i % 10)) for i in range(500)}, 1000: (True, 2), 1001: (True, 1)}
    assert metrics.rate_limited(requests_.limit(0), 3, 10).collect() == []


def test_first_capture(spark):
    rows = spark.createDataFrame([("Tel: 12 ",), ("Phone: 7",), ("Tel:  ; Phone: 8",), ("",), (None,)], "t string")
    got = [r.c for r in rows.select(text.first_capture(F.col("t"), (r"Tel:([^;]*)", r"Phone:(.*)")).alias("c")).collect()]
    assert got == ["12", "7", "8", None, None]
