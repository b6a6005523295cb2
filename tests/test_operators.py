import datetime as dt

from pyspark.sql import functions as F

from quillmill.operators import cleanup, graph, ingest, matching, metrics, quality, search
from quillmill.sources import pages, records

PERSON = "id long, name_zh string, name_en string, title string, institution string, department string, email string, bio_zh string, h_index int, citation_count int, orcid_id string, scholar_id string, score double, is_active boolean, last_scraped_at timestamp_ntz, metadata string"


def person(id, **kv):
    base = dict(id=id, name_zh="王伟", name_en=None, title=None, institution=None, department=None, email=None, bio_zh=None, h_index=None, citation_count=None, orcid_id=None, scholar_id=None, score=100.0, is_active=True, last_scraped_at=None, metadata='{"source": "crawl"}')
    return {**base, **kv}


def persons(spark, *rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], PERSON)


def test_search_is_literal_and_caseless(spark):
    df = spark.createDataFrame([(1, "a_b"), (2, "axb"), (3, None)], "id int, name string")
    assert [r.id for r in df.where(search.contains_any("A_B", "name")).collect()] == [1]


def test_descending_nulls_come_first(spark):
    df = persons(spark, person(1, h_index=3), person(2), person(3, h_index=9))
    assert [r.id for r in search.ordered(df, "h_index_desc").collect()] == [2, 3, 1]


def test_pages_are_bounded(spark):
    df = spark.range(250).orderBy("id")
    assert search.page(df, 1, 1000).count() == 100 and [r.id for r in search.page(df, 3, 2).collect()] == [4, 5]


def test_metadata_without_source_is_skipped(spark):
    df = persons(spark, person(1), person(2, metadata=None), person(3, metadata='{"k": 1}'), person(4, metadata='{"source": "seed"}'), person(5, metadata="broken"))
    assert [r.entity_id for r in quality.incomplete_profiles(df).collect()] == ["1"]


def test_zero_h_index_is_not_missing(spark):
    row = persons(spark, person(1, h_index=0, name_en="", title="T")).select(quality.missing_fields().alias("m")).first()
    assert row.m == ["name_en", "department", "email", "bio_zh"]


def test_stale_boundaries(spark):
    now = dt.datetime(2024, 6, 1)
    df = persons(spark, *[person(i, last_scraped_at=now - dt.timedelta(days=d)) for i, d in ((1, 90), (2, 91), (3, 181))], person(4))
    got = {r.entity_id: (r.severity, r.detail) for r in quality.stale_profiles(df, F.lit(now).cast("timestamp_ntz")).collect()}
    assert got == {"2": ("medium", "91"), "3": ("high", "181"), "4": ("high", "never")}


def test_cleanup_order_and_dry_run(spark):
    df = persons(spark, person(1, name_zh="首页"), person(2, name_zh="x"), person(3, bio_zh="<div>nothing here</div>"), person(4, is_active=False))
    pubs = spark.createDataFrame([(4, "p")], "person_id long, title string")
    frames = {"person": df, "publication": pubs}
    now = F.lit(dt.datetime(2024, 6, 1)).cast("timestamp_ntz")
    same, actions = cleanup.run_cleanup(frames, now)
    assert same["person"] is df and actions.count() == 4
    new, _ = cleanup.run_cleanup(frames, now, dry_run=False)
    active = {r.id: (r.is_active, r.bio_zh) for r in new["person"].collect()}
    assert active == {1: (False, None), 2: (False, None), 3: (True, None), 4: (False, None)}
    assert new["publication"].count() == 0
    assert '"source":"crawl"' in new["person"].where("id = 1").first().metadata


def test_publications_first_wins(spark):
    rows = [(1, 1, "10.1/A", "Deep  Nets!", 2020, "J"), (1, 2, "10.1/a", "Other", 2020, "J"), (1, 3, None, "deep nets", 2021, "J"), (1, 4, None, "???", 2020, "J"), (1, 5, None, "!!!", 2020, "j "), (2, 1, "10.1/A", "Deep Nets", 2020, "J")]
    got = matching.distinct_publications(spark.createDataFrame(rows, "person_id int, seq int, doi string, title string, year int, journal string"))
    assert sorted((r.person_id, r.seq) for r in got.collect()) == [(1, 1), (1, 4), (2, 1)]


def test_source_precedence_skips_zero_and_empty(spark):
    rows = [(1, "ORCID", "o", "", None, 0), (1, "CN_UNIVERSITY", "c", "王", "MIT", 7), (1, "GOOGLE_SCHOLAR", "g", "Wang", None, 5), (2, "ORCID", "o2", "Li", "x, China", None)]
    df = spark.createDataFrame(rows, "person_id int, source string, source_id string, name_zh string, institution string, h_index int")
    got = {r.person_id: r for r in matching.merge_sources(df).collect()}
    assert (got[1].name_zh, got[1].institution, got[1].h_index, got[1].n_sources) == ("王", "Massachusetts Institute of Technology", 5, 3)
    assert got[2].institution == "x, China" and got[2].confidence == 1.0


def test_token_matches_equal_brute_force(spark):
    names = ["wei zhang", "zhang wei", "john a smith", "john smith", "smith", "a b c d", "a b c e", "", "li li wei"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = {(r.left_id, r.right_id) for r in matching.token_matches(df, df, 0.5).collect()}
    words = [set(n.split()) for n in names]
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if a and b and len(a & b) / len(a | b) >= 0.5}
    assert got == want


def test_decisions(spark):
    stored = persons(spark, person(1, name_en="John Smith", institution="MIT", orcid_id="o1"), person(2, name_en="Wei Zhang"), person(3, name_en="Ann Lee", is_active=False))
    new = persons(spark, person(10, name_en="Somebody Else", orcid_id="o1"), person(11, name_en="Zhang Wei"), person(12, name_en="Nobody Known"), person(13, name_en="Ann Lee"))
    got = {r.in_id: (r.id, r.decision) for r in matching.decisions(new, stored).collect()}
    assert got[11] == (2, "review") or got[11] == (2, "match")
    assert got[12] == (None, "new") and got[13] == (None, "new") and got[10][1] in ("new", "review")


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, n string, m string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", None), (3, "c", None)], "id int, n string, m string")
    assert {tuple(r) for r in matching.upsert(old, new, ["id"]).collect()} == {(1, "a", "x"), (2, "b", "y"), (3, "c", None)}
    assert {tuple(r) for r in matching.insert_missing(old, new, ["id"]).collect()} == {(1, "a", "x"), (2, "b", None), (3, "c", None)}


def test_merge_persons(spark):
    df = persons(spark, person(1, email=None), person(2, email="e", h_index=4))
    merges = spark.createDataFrame([(2, 1)], "source_id long, target_id long")
    got = {r.id: r for r in matching.merge_persons(df, merges).collect()}
    assert got[1].email == "e" and got[1].is_active and not got[2].is_active
    pubs = spark.createDataFrame([(2, "t")], "person_id long, title string")
    assert matching.reassign(pubs, merges).first().person_id == 1


def test_pagerank_matches_plain_loop(spark):
    edges = [(1, 2, 1.0), (2, 1, 1.0), (1, 3, 0.5), (3, 1, 0.5)]
    got = dict(graph.pagerank(spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long"), spark.createDataFrame(edges, "from_id long, to_id long, weight double")).collect())
    rank = dict.fromkeys((1, 2, 3, 4), 0.25)
    for _ in range(100):
        new = {n: 0.15 / 4 + 0.85 * sum(rank[a] / sum(e[0] == a for e in edges) * w for a, b, w in edges if b == n) for n in rank}
        done = max(abs(new[n] - rank[n]) for n in rank) < 1e-6
        rank = new
        if done:
            break
    assert all(abs(got[n] - rank[n]) < 1e-9 for n in rank)


def test_communities(spark):
    two = [(a, b, 1.0) for g in ((1, 2, 3), (7, 8, 9)) for a in g for b in g if a != b]
    got = dict(graph.communities(spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8, 9, 20)], "id long"), spark.createDataFrame(two, "from_id long, to_id long, weight double")).collect())
    assert got[1] == got[2] == got[3] != got[7] == got[8] == got[9] and got[20] == 20


def test_author_lookup(spark):
    people = persons(spark, person(1, name_zh="王伟", name_en="Wei Wang"), person(2, name_zh="李娜"))
    pubs = spark.createDataFrame([(5, " WEI WANG; 李娜 ;x"), (6, None)], "id int, authors string")
    assert {tuple(r) for r in graph.name_lookup_edges(pubs, people).collect()} == {(5, 1), (5, 2)}


def test_rate_limit_restarts_with_first_request(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t + dt.timedelta(seconds=s), i) for i, s in enumerate((0, 1, 2, 59, 60, 61))]
    got = {r.id: (r.allowed, r.remaining) for r in metrics.rate_limited(spark.createDataFrame(rows, "key string, at timestamp_ntz, id long"), 2, 60).collect()}
    assert got == {0: (True, 1), 1: (True, 0), 2: (False, 0), 3: (False, 0), 4: (True, 1), 5: (True, 0)}


def test_ingest_routes(spark):
    stored = persons(spark, person(1, name_zh="王伟", institution="MIT", email=None))
    scraped = persons(spark, person(0, name_zh="王伟", institution="mit", email="w@mit.edu"), person(0, name_zh="首页"), person(0, name_zh="李娜", institution="X"))
    after, audit = ingest.run(scraped, stored)
    assert {(r.action, r.name_zh) for r in audit.collect()} == {("INSERT", "李娜"), ("UPDATE", "王伟")}
    assert after.count() == 2


def test_backoff(spark):
    df = persons(spark, person(1), person(2)).withColumn("failures", F.lit(3))
    got = {r.id: (r.failures, r.wait_days, r.is_active) for r in ingest.refresh_failures(df, df.where("id = 1")).collect()}
    assert got == {1: (4, 112.0, False), 2: (3, None, True)}


def test_empty_tables(spark):
    none = persons(spark, person(1)).where("id < 0")
    assert quality.incomplete_profiles(none).count() == 0
    assert matching.decisions(none, none).count() == 0
    assert graph.pagerank(none.select("id"), spark.createDataFrame([], "from_id long, to_id long, weight double")).count() == 0


def test_sources(spark, tmp_path):
    xml = """<feed><entry><id>http://arxiv.org/abs/2401.00001v2</id><title>A
 B</title><summary>S</summary><published>2024-01-02T03:04:05Z</published><author><name>Ann Lee</name></author><author><name>Bo</name></author><category term="cs.AI"/><arxiv:doi>10.1/x</arxiv:doi></entry></feed>"""
    row = records.arxiv_papers(spark.createDataFrame([(xml,)], "xml string")).first()
    assert (row.id, row.title, row.authors, row.categories, row.doi) == ("2401.00001", "A B", ["Ann Lee", "Bo"], ["cs.AI"], "10.1/x")
    works = tmp_path / "w.json"
    works.write_text('{"results": [{"id": "W1", "doi": "https://doi.org/10.1/X", "title": "T", "publication_year": 2020, "cited_by_count": 3, "primary_location": {"source": {"display_name": "J"}}, "authorships": [{"author": {"id": "A", "display_name": "Ann"}}]}]}')
    row = records.openalex_works(spark, str(works)).first()
    assert (row.doi, row.journal, row.authors) == ("10.1/x", "J", "Ann")
    orcid = '{"orcid-identifier": {"path": "0000"}, "person": {"name": {"given-names": {"value": "Ann"}, "family-name": {"value": "Lee"}}}, "activities-summary": {"works": {"group": [{"work-summary": [{"title": {"title": {"value": "T"}}, "publication-date": {"year": {"value": "2020"}}}]}]}}}'
    row = records.orcid_records(spark.createDataFrame([(orcid,)], "json string")).first()
    assert (row.orcid_id, row.name, row.titles, row.years) == ("0000", "Ann Lee", ["T"], [2020])


def test_pages(spark):
    html = '<title>T</title><h2>Research</h2><p>Deep</p><h3>Awards</h3>None<script type="application/ld+json">[{"@type": "ScholarlyArticle", "headline": "H", "author": [{"name": "Ann"}]}]</script><a href="/p/1">王伟</a>'
    df = spark.createDataFrame([(1, "http://a.edu/x/y.html", html)], "page_id long, url string, html string")
    assert [(r.heading, r.content.split(" ")[0]) for r in pages.sections(df).orderBy("seq").collect()] == [("Research", "Deep"), ("Awards", "None")]
    row = pages.json_ld(df).first()
    assert (row.kind, row.title, row.authors) == ("ScholarlyArticle", "H", ["Ann"])
    raw = spark.createDataFrame([(1, bytearray("清华".encode("gbk")), None), (2, bytearray("清华".encode()), None), (3, None, None), (4, bytearray(b'<meta charset="gb2312">' + "清".encode("gbk")), None)], "key long, content binary, charset string")
    assert {r.key: r.text for r in pages.decoded(raw).collect()} == {1: "清华", 2: "清华", 3: None, 4: '<meta charset="gb2312">清'}
