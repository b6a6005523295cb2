import json

from quillmill.sources import field_trees

TREE = [
    {"slug": "science", "nameZh": "理学", "level": 0, "sortOrder": 1, "children": [
        {"slug": "physics", "nameEn": "Physics", "children": [{"slug": "optics", "children": [{"slug": "lasers", "level": 9}]}]}, {"nameEn": "no slug", "children": [{"slug": "loose"}]}]},
    {"slug": "known", "nameEn": "New name", "children": []}, {"slug": "physics", "nameEn": "Physics again"},
]


def trees(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "tree_id int, tree string")


def test_any_depth(spark):
    rows = field_trees.field_nodes(trees(spark, json.dumps(TREE), '{"slug": "single"}', None, "broken [", "[]", "3")).orderBy("path").collect()
    assert [(r["slug"], r["parent_slug"], r["depth"], r["level"]) for r in rows] == [
        ("science", None, 0, 0), ("physics", "science", 1, 1), ("optics", "physics", 2, 2), ("lasers", "optics", 3, 9), ("loose", None, 2, 2), ("known", None, 0, 0), ("physics", None, 0, 0), ("single", None, 0, 0)]


def test_put_in_by_slug(spark):
    fields = spark.createDataFrame([("k", "known", "x", "知", "Old name", 4, 7), ("x", "other", None, None, None, 0, 1)], "id string, slug string, parent_id string, name_zh string, name_en string, level int, sort_order int")
    after = field_trees.loaded(fields, field_trees.field_nodes(trees(spark, json.dumps(TREE))))
    assert after.columns == fields.columns
    by = {r["slug"]: r for r in after.collect()}
    assert tuple(by["known"]) == ("k", "known", "x", "知", "New name", 0, 7) and by["other"]["id"] == "x"
    assert by["physics"]["name_en"] == "Physics again" and by["physics"]["parent_id"] == by["science"]["id"]
    assert by["lasers"]["parent_id"] == by["optics"]["id"] and by["loose"]["parent_id"] is None and len(by) == 7
    assert field_trees.loaded(fields, field_trees.field_nodes(trees(spark))).count() == 2
