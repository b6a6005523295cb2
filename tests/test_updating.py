import datetime as dt
import json

from pyspark.sql import functions as F

from quillmill.operators import updating
from quillmill.operators.snapshot import Store

AT = dt.datetime(2024, 5, 1, 12)
CHILD = "id long, person_id long, title string, url string"
PROFILE = (
    "person_id long, place int, institution string, email string, department string, website string, bio_zh string, slugs array<string>, "
    "publications array<struct<title string, doi string, citation_count int, abstract string>>, "
    + ", ".join(f"{t} array<struct<title string, url string>>" for t in updating.CHILDREN)
)


def test_a_batch_is_one_commit(spark, tmp_path):
    make = spark.createDataFrame
    store = Store(spark, str(tmp_path))
    children = {t: make([(1, 1, "Known TITLE", "u")], CHILD) for t in updating.CHILDREN}
    store.commit({
        "persons": make([(1, "甲", "a@x", None, None, None, None, '{"source": "crawl", "n": {"m": 1}}'), (2, "乙", None, None, None, None, None, "no json"), (3, "丙", None, None, None, None, None, None)], "id long, institution string, email string, department string, website string, bio_zh string, last_scraped_at timestamp_ntz, metadata string"),
        "publications": make([("p1", 9, "old", "10/a", 1, "kept", "SEED"), ("p2", 9, "none", None, 5, None, "SEED")], "id string, person_id long, title string, doi string, citation_count int, abstract string, source string"),
        **children, "links": make([(1, 10, True)], "person_id long, field_id int, is_primary boolean"), "fields": make([(10, "ai"), (11, "math"), (12, "bio")], "id int, slug string"),
    })
    profiles = make([
        (1, 0, "新甲", "", "系", None, None, ["math", "ai", "nowhere"], [("t", "10/a", 7, None), ("t2", "10/b", 2, "first"), ("t3", None, 1, None), None], [("known title", "x"), ("New", "y")], None, []),
        (1, 1, None, "later@x", None, None, None, ["math"], [("t2 again", "10/b", 9, "same person"), ("t4", "10/c", None, None)], None, None, None),
        (2, 0, None, None, None, None, None, ["bio", "ai"], [("t5", "10/b", 3, None), ("t6", "10/a", None, "not told: no count")], [(None, "z")], [("Gold", "w")], None),
        (99, 0, "不在", None, None, None, None, ["ai"], [("t7", "10/z", 1, None)], [("X", "x")], None, None),
        (None, 0, "不在", None, None, None, None, ["ai"], None, None, None, None),
    ], PROFILE)
    assert updating.update_known(store, profiles, F.col("slugs"), F.lit(AT)) == 2

    persons = {r["id"]: r for r in store.read("persons").collect()}
    assert (persons[1]["institution"], persons[1]["email"], persons[1]["department"], persons[1]["last_scraped_at"]) == ("新甲", "later@x", "系", AT)
    assert json.loads(persons[1]["metadata"]) == {"source": "crawl", "n": {"m": 1}, "lastUpdated": "2024-05-01T12:00:00Z"}
    assert json.loads(persons[2]["metadata"]) == {"lastUpdated": "2024-05-01T12:00:00Z"}
    assert persons[3]["last_scraped_at"] is None and persons[3]["metadata"] is None
    found = {(r["doi"], r["person_id"], r["title"], r["citation_count"], r["abstract"], r["source"]) for r in store.read("publications").collect()}
    assert found == {("10/a", 9, "old", 7, "kept", "SEED"), (None, 9, "none", 5, None, "SEED"), ("10/b", 1, "t2", 3, "first", "SCRAPER"), ("10/c", 1, "t4", None, None, "SCRAPER")}
    titles = lambda t: {(r["person_id"], r["title"]) for r in store.read(t).collect()}
    assert titles("research_updates") == {(1, "Known TITLE"), (1, "New"), (2, None)}
    assert titles("competition_updates") == {(1, "Known TITLE"), (2, "Gold")} and titles("evaluation_updates") == {(1, "Known TITLE")}
    # Person 1 brought eight records, so the lacking field is added; person 2 had no field, so the first one is primary.
    assert {tuple(r) for r in store.read("links").collect()} == {(1, 10, True), (1, 11, False), (2, 12, True), (2, 10, False)}
    assert store.read("persons", 1).where("id = 1").first()["institution"] == "甲"


def test_limits_ties_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, i, f"t{i}") for i in range(30)] + [(2, 0, "x" * 60 + "a")], "person_id long, place int, title string")
    stored = spark.createDataFrame([(2, "X" * 60 + "b")], "person_id long, title string")
    got = updating.new_titled(stored, rows)
    assert got.columns == rows.columns and sorted((r["person_id"], r["place"]) for r in got.collect()) == [(1, i) for i in range(20)]
    many = spark.createDataFrame([(1, i, f"10/{i}", 1, None) for i in range(60)], "person_id long, place int, doi string, citation_count int, abstract string")
    none = spark.createDataFrame([], "id long, person_id long, doi string, citation_count int, abstract string, source string")
    assert updating.publications_after(none, many).count() == 50
    assert updating.publications_after(none, many.limit(0)).count() == 0
    links, fields = spark.createDataFrame([(1, 10)], "person_id long, field_id int"), spark.createDataFrame([(10, "a"), (11, "b")], "id int, slug string")
    inferred = spark.createDataFrame([(1, 0, "b")], "person_id long, place int, slug string")
    few = spark.createDataFrame([(1, 4)], "person_id long, n int")
    assert updating.new_links(links, fields, inferred, few).count() == 0
    assert [tuple(r) for r in updating.new_links(links, fields, inferred, few.withColumn("n", F.lit(5))).collect()] == [(1, 11, False)]


def test_rows_of_one_place_are_ordered_by_doi(spark):
    stored = spark.createDataFrame([], "id string, person_id long, title string, doi string, citation_count int, abstract string, source string")
    rows = [(1, 7, "t", "10/b", 2, None), (1, 7, "t", "10/a", 1, None), (1, 7, "t", None, 3, None)]
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        incoming = spark.createDataFrame(order, "person_id long, place long, title string, doi string, citation_count int, abstract string").coalesce(1)
        assert [(r["doi"], r["citation_count"]) for r in updating.publications_after(stored, incoming, 1).collect()] == [("10/a", 1)]
