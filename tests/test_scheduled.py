import datetime as dt

import pytest

from quillmill.operators import scheduled
from quillmill.operators.snapshot import Store

AT = dt.datetime(2024, 5, 1)
PERSON = "id long, name_zh string, name_en string, institution string, department string, email string, h_index int, last_scraped_at timestamp_ntz, is_active boolean, metadata string, failures int, authority double"


def tables(spark):
    make = spark.createDataFrame
    old = dt.datetime(2023, 1, 1)
    return {
        "persons": make([(1, "王小明", None, "甲大学", None, None, None, AT, True, None, 0, None), (2, "李四", "Si Li", "乙大学", None, None, 9, old, True, None, 0, None), (3, "赵六", None, "丙大学", None, None, 4, old, True, None, 3, None)], PERSON),
        "universities": make([(0, "a", "甲大学", 0, None), (1, "b", "乙大学", 2, None), (2, "c", "丙大学", 3, dt.datetime(2024, 5, 2))], "idx int, key string, name_zh string, failures int, tripped_until timestamp_ntz"),
        "profiles": make([("a", "王小明", "Xiaoming Wang", "甲大学", "物理系", "w@a.cn"), ("a", "张三丰", None, "甲大学", "武术系", None), ("a", "张三丰", None, "甲大学", "武术系", None), ("a", "首页", None, "甲大学", None, None), ("c", "钱七", None, "丙大学", None, None)], "university string, name_zh string, name_en string, institution string, department string, email string"),
        "refreshed": make([("李四", "乙大学", "化学系", "li@b.cn")], "name_zh string, institution string, department string, email string"),
        "works": make([(1, 12, None, None), (3, 99, None, "z@c.cn")], "id long, h_index int, name_en string, email string"), "scholar": make([(1, 50, None, "late@a.cn")], "id long, h_index int, name_en string, email string"),
        "papers": make([], "id long, h_index int, name_en string, email string"),
        "arxiv": make([(1, "Paper A", AT), (1, "Paper A", AT), (2, "Known", AT)], "person_id long, title string, published_at timestamp_ntz"), "updates": make([(2, "Known", old)], "person_id long, title string, published_at timestamp_ntz"),
        "authorships": make([(1, 1), (1, 2), (2, 2), (2, 3)], "paper_id long, person_id long"), "links": make([(1, 5), (2, 5), (3, 6)], "person_id long, field_id int"),
        "audit": make([], "run_id string, action string, n long, at timestamp_ntz"),
    }


def state(store):
    return {t: sorted((tuple(r) for r in store.read(t).collect()), key=repr) for t in ("persons", "universities", "updates", "audit")}


LETTERS = {"张": "zhang", "三": "san", "丰": "feng", "赵": "zhao", "六": "liu"}


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("whole")))
    store.commit(tables(spark))
    assert len(scheduled.run(store, "r1", scheduled.phases("r1", AT, letters=LETTERS))) == 9
    return store


def test_a_run_does_its_phases(whole):
    persons = {r.name_zh: r for r in whole.read("persons").collect()}
    assert set(persons) == {"王小明", "李四", "赵六", "张三丰"}
    w, li, z = persons["王小明"], persons["李四"], persons["赵六"]
    assert (w.name_en, w.department, w.email, w.h_index) == ("Xiaoming Wang", "物理系", "w@a.cn", 12)
    assert (li.department, li.email, li.last_scraped_at, li.failures) == ("化学系", "li@b.cn", AT, 0)
    assert (z.is_active, z.failures) == (False, 4)  # the fourth failure switches off
    assert persons["张三丰"].is_active and persons["张三丰"].name_en == "Sanfeng Zhang"
    assert w.authority > 0 and persons["张三丰"].authority is None
    assert {r.key: (r.failures, r.tripped_until) for r in whole.read("universities").collect()} == {"a": (0, None), "b": (3, dt.datetime(2024, 5, 2)), "c": (3, dt.datetime(2024, 5, 2))}
    assert sorted((r.person_id, r.title) for r in whole.read("updates").collect()) == [(1, "Paper A"), (2, "Known")]
    assert sorted((r.action, r.n) for r in whole.read("audit").collect()) == [("CITATION_ANALYSIS", 3), ("INSERT", 1), ("SCHEDULED_SCRAPE", 4), ("UPDATE", 1)]


@pytest.mark.parametrize("at", [0, 3, 7])
def test_a_killed_run_ends_alike(spark, tmp_path, whole, at):
    store = Store(spark, str(tmp_path / "store"))
    store.commit(tables(spark))
    phases = scheduled.phases("r1", AT, letters=LETTERS)

    def dies(read):
        phases[at].work(read)
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError, match="killed"):
        scheduled.run(store, "r1", [*phases[:at], phases[at]._replace(work=dies), *phases[at + 1 :]])
    assert scheduled.progress(store, "r1") == [p.name for p in phases[:at]]
    assert scheduled.run(store, "r1", phases) == [p.name for p in phases[at:]]
    assert scheduled.run(store, "r1", phases) == [] and state(store) == state(whole)
