from pyspark.sql import functions as F

from quillmill.functions import names, numbers, scores, text
from quillmill.operators import fields, rating


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_weighted_scores(spark):
    six = list(scores.CATEGORY_WEIGHTS)

    def rows(person, points):
        return [(person, c, float(v)) for c, v in zip(six, points)]

    data = rows(1, [100] * 6) + rows(2, [80, 90, 100, 100, 100, 100]) + rows(3, [85, 100, 100, 100, 100, 100]) + rows(4, [90, 120, 70, 100, 100, 100]) + [(5, "UNKNOWN", 3.0)]
    found = dict(rating.aggregate_scores(spark.createDataFrame(data, "person_id int, category string, value double")).collect())
    assert found == {1: 100.0, 2: 91.5, 3: 95.5, 4: 97.5, 5: 100.0}


def test_clamp_and_decay(spark):
    assert [r[0] for r in values(spark, [(-100.0,), (-51.0,), (-50.0,), (0.0,), (50.0,), (51.0,)], "d double", scores.clamp_delta(F.col("d")))] == [-50, -50, -50, 0, 50, 50]
    months = [(m,) for m in (0, 6, 7, 12, 13, 24, 25, 36, 37)]
    assert [r[0] for r in values(spark, months, "m int", scores.time_decay(F.col("m")))] == [1, 1, 0.85, 0.85, 0.7, 0.7, 0.5, 0.5, 0.3]


def test_half_up(spark):
    assert [r[0] for r in values(spark, [(1.005,), (-0.125,), (2.5,)], "x double", numbers.half_up(F.col("x"), 2))] == [1.0, -0.12, 2.5]


def test_levels_and_streaks(spark):
    exp = [(0,), (99,), (100,), (250,), (300,), (999,), (1000,), (5000,)]
    got = values(spark, exp, "e int", scores.level_of(F.col("e")), scores.level_progress(F.col("e")), scores.exp_to_next(scores.level_of(F.col("e")), F.col("e")))
    assert got == [(1, 0, 100), (1, 99, 1), (2, 0, 200), (2, 75, 50), (3, 0, 300), (4, 100, 1), (5, 100, 0), (5, 100, 0)]
    assert [r[0] for r in values(spark, [(2,), (3,), (7,), (29,), (30,)], "d int", scores.streak_bonus(F.col("d")))] == [0, 20, 50, 50, 200]
    assert [r[0] for r in values(spark, [(0, 0), (3, 1), (1, 2)], "a int, r int", scores.accuracy(F.col("a"), F.col("r")))] == [0.0, 0.75, 0.33]


def test_running_log_goes_below_zero(spark):
    changes = spark.createDataFrame([(1, "RESEARCH_QUALITY", i, -80.0) for i in range(10)] + [(1, "OTHER", 99, 0.0)], "person_id int, category string, seq int, delta double")
    log = rating.rating_log(changes).orderBy("seq").collect()
    assert len(log) == 10 and log[0]["old_value"] == 100 and log[-1]["new_value"] == -400


def test_apply_changes_keeps_input(spark):
    old = spark.createDataFrame([(1, "RESEARCH_QUALITY", 90.0)], "person_id int, category string, value double")
    change = spark.createDataFrame([(1, "RESEARCH_QUALITY", -10.0), (1, "PEER_RECOGNITION", 60.0), (2, "PEER_RECOGNITION", 0.0)], "person_id int, category string, delta double")
    new, log = rating.apply_changes(old, change)
    assert {tuple(r) for r in new.collect()} == {(1, "RESEARCH_QUALITY", 80.0), (1, "PEER_RECOGNITION", 150.0)}
    assert {tuple(r) for r in log.collect()} == {(1, "RESEARCH_QUALITY", 90.0, 80.0, -10.0), (1, "PEER_RECOGNITION", 100.0, 150.0, 50.0)}
    assert old.count() == 1


def test_garbage_names(spark):
    got = values(spark, [("首页",), ("登录",), ("李",), ("王伟",), ("12345",), ("ab " * 30 + "c",), (None,), ("Home",), ("<b>x</b>",), ("null",), ("Ann Lee",)], "n string", text.garbage_name(F.col("n")))
    kinds = [r[0] and r[0].split()[0] for r in got]
    assert kinds == ["pattern", "pattern", "short", None, "pattern", "long", "short", "pattern", "pattern", "pattern", None]


def test_junk_bios(spark):
    rows = [("<div>hello there</div>",), ("Plain words about research",), ("short",), ("one\n\ntwo lines here",), ("a &amp; b and more",), ("function (x) { }",), ("y" * 1000,)]
    assert [r[0] for r in values(spark, rows, "b string", text.junk_bio(F.col("b")))] == [0, None, None, 5, 2, 9, 6]


def test_name_rules(spark):
    rows = [("Vincent Chen",), ("Department of X",), ("José Silva",), ("A. B.",), ("B. Biology",), ("人工 智能",), ("清华大学",), ("google",), ("Prof Smith",), ("Jane Doe PhD",), ("何",), ("SPRINGERS",), ("Ann Lee",)]
    got = [r[0] for r in values(spark, rows, "n string", names.name_problem(F.col("n")))]
    assert got == ["organisation", "organisation", None, "initials only", "field with a letter", "Chinese field", "Chinese organisation", "known entity", "title", "degree", None, "all capitals", None]


def test_name_functions(spark):
    assert values(spark, [("Prof. John  Smith (MIT)",)], "n string", text.canonical_name(F.col("n"))) == [("John Smith",)]
    assert values(spark, [("John Smith",)], "n string", text.name_variants(F.col("n")))[0][0] == ["John Smith", "Smith, John", "J. Smith", "Smith J.", "Smith John"]
    same = values(spark, [("Wei Zhang", "wei zhang"), ("Wei Zhang", "Zhang Wei"), ("Wei", "Wei Zhang"), ("abc", "xyz")], "a string, b string", text.name_similarity(F.col("a"), F.col("b")))
    assert [r[0] for r in same] == [1.0, 0.85, 0.9, 0.0]
    assert values(spark, [("王伟",), ("欧",)], "n string", names.pinyin(F.col("n"), {"王": "Wang", "伟": "Wei"})) == [("Wang Wei",), (None,)]


def test_institutions(spark):
    rows = [("MIT",), ("GenusBio",), ("Some College, USA",), (None,), ("the nus lab",)]
    assert [r[0] for r in values(spark, rows, "i string", text.normal_institution(F.col("i")))] == ["Massachusetts Institute of Technology", "GenusBio", "Some College", None, "National University of Singapore"]


def test_emails_and_html(spark):
    assert values(spark, [("write to Me [at] uni.edu now",), ("none",)], "t string", text.email(F.col("t"))) == [("me@uni.edu",), (None,)]
    assert values(spark, [("<p>a&nbsp;b</p><script>x()</script> c",)], "h string", text.strip_html(F.col("h"))) == [("a b c",)]


def test_department_fields(spark):
    rows = [("计算机学院",), ("2013~今,教授",), ("数学与物理学院",), (None,)]
    assert [r[0] for r in values(spark, rows, "d string", fields.from_department(F.col("d")))] == [["computer-science"], [], ["mathematics", "physics"], []]


def test_relevance_is_capped(spark):
    rows = [("d", "j", 12, True, 3, "Accepted")]
    now = F.expr("TIMESTAMP_NTZ '2024-01-02 00:00:00'")
    got = values(spark, rows, "d string, j string, n int, l boolean, c int, m string", scores.relevance(F.col("d"), F.col("j"), F.col("n"), F.col("l"), now, now, F.col("c"), F.col("m")))
    assert got == [(100,)]
