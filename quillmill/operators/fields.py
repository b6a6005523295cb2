"""Research fields inferred from text, departments and URLs by rule tables.

A rule is (pattern, field, confidence). Rule tables are parameters: research rules are the caller's, the department
rules below are the default. Each rule is one column of the projection, so the text is read once and nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

Rules = list[tuple[str, str, float]]

# What department names say of the field.
DEPARTMENTS: Rules = [
    ("计算机|计[算科]学|信息[^管经]", "computer-science", 0.7), ("人工智能|智能科学|智能技术", "artificial-intelligence", 0.85),
    ("电子[工程信]|电信|微电子", "electronic-engineering", 0.8), ("数学|数理|应用数学", "mathematics", 0.8), ("物理|应用物理|工程物理", "physics", 0.8),
    ("化学|化工|应用化学", "chemistry", 0.8), ("生物[学命医]|生命科学", "biology", 0.75), ("医学|临床|基础医学|药学|中医药", "medicine", 0.75),
    ("安全|密码|网安", "cybersecurity", 0.85), ("软件|软件工程", "computer-science", 0.7), ("经济|金融|经管|管理[^科学]", "economics", 0.7),
    ("自动化|控制", "computer-science", 0.6), ("通信|信息与通信", "electronic-engineering", 0.7), ("网络[工程]*?$", "network-engineering", 0.8),
    ("分布式|并行计算|并行与分布", "distributed-systems", 0.85), ("数据[科学库]|大数据", "computer-science", 0.7), ("材料|纳米", "materials-science", 0.8),
    ("环境|生态", "chemistry", 0.6), ("能源|动力|热[能工]", "mechanical-engineering", 0.6), ("机械|制造|机电", "mechanical-engineering", 0.75), ("土木|建筑|结构|交通|道路|桥梁", "civil-engineering", 0.75),
    ("航空航天|飞行器|航天|航空", "aerospace-engineering", 0.8), ("法学|法律|法[学政]", "law", 0.8), ("管理[^科学]", "management", 0.7), ("哲学|伦理", "philosophy", 0.85),
    ("历史|考古|文物", "history", 0.8), ("文学|语言|外语|翻译", "linguistics", 0.75), ("艺术|美术|音乐|设计|影视", "arts", 0.8), ("教育|师范", "education", 0.75),
    ("光学|光[电纤]|激光|光子", "quantum-optics", 0.7), ("机器人|无人[机驾驶]", "artificial-intelligence", 0.7), ("电气|电[力网]|能源互联网", "electronic-engineering", 0.6), ("系统安全", "cybersecurity", 0.8),
]
# Field slugs by their English and Chinese names, the Chinese ones in the order in which they are looked for in a text.
SLUGS_EN = {
    "artificial_intelligence": "ai-machine-learning", "machine_learning": "ai-machine-learning", "deep_learning": "ai-machine-learning",
    "neural_network": "ai-machine-learning", "computer_vision": "computer-vision", "natural_language_processing": "nlp", "nlp": "nlp",
    "robotics": "robotics", "data_mining": "data-science", "data_science": "data-science", "cybersecurity": "cybersecurity",
    "software_engineering": "software-engineering", "distributed_systems": "distributed-systems", "computer_networks": "computer-networks",
    "human_computer_interaction": "hci", "hci": "hci", "theoretical_computer_science": "theory", "algorithms": "algorithms",
    "molecular_biology": "molecular-biology", "genetics": "genetics", "genomics": "genomics", "bioinformatics": "bioinformatics",
    "cell_biology": "cell-biology", "neuroscience": "neuroscience", "immunology": "immunology", "microbiology": "microbiology",
    "ecology": "ecology", "evolutionary_biology": "evolutionary-biology", "quantum_mechanics": "quantum-physics",
    "quantum_physics": "quantum-physics", "particle_physics": "particle-physics", "astrophysics": "astrophysics",
    "condensed_matter": "condensed-matter", "optics": "optics-photonics", "photonics": "optics-photonics", "nuclear_physics": "nuclear-physics",
    "cardiology": "cardiology", "oncology": "oncology", "neurology": "neurology", "immunology_medical": "immunology",
    "epidemiology": "epidemiology", "public_health": "public-health", "surgery": "surgery", "pediatrics": "pediatrics", "psychiatry": "psychiatry",
}
SLUGS_ZH = {
    "人工智能": "ai-machine-learning", "机器学习": "ai-machine-learning", "深度学习": "ai-machine-learning", "神经网络": "ai-machine-learning",
    "计算机视觉": "computer-vision", "自然语言处理": "nlp", "机器人": "robotics", "机器人学": "robotics", "数据挖掘": "data-science",
    "数据科学": "data-science", "大数据": "data-science", "网络安全": "cybersecurity", "信息安全": "cybersecurity", "网络空间安全": "cybersecurity",
    "软件工程": "software-engineering", "分布式系统": "distributed-systems", "计算机网络": "computer-networks", "人机交互": "hci",
    "算法": "algorithms", "计算理论": "theory", "计算机理论": "theory", "物联网": "distributed-systems", "云计算": "distributed-systems",
    "分子生物学": "molecular-biology", "遗传学": "genetics", "基因组学": "genomics", "生物信息学": "bioinformatics", "细胞生物学": "cell-biology",
    "神经科学": "neuroscience", "免疫学": "immunology", "微生物学": "microbiology", "生态学": "ecology", "进化生物学": "evolutionary-biology",
    "量子力学": "quantum-physics", "量子物理": "quantum-physics", "粒子物理": "particle-physics", "天体物理": "astrophysics",
    "凝聚态物理": "condensed-matter", "光学": "optics-photonics", "光子学": "optics-photonics", "核物理": "nuclear-physics",
    "心脏病学": "cardiology", "肿瘤学": "oncology", "神经病学": "neurology", "流行病学": "epidemiology", "公共卫生": "public-health",
    "外科学": "surgery", "儿科学": "pediatrics", "精神病学": "psychiatry", "免疫医学": "immunology", "材料科学": "materials-science",
    "纳米材料": "materials-science", "材料科学与工程": "materials-science", "有机化学": "organic-chemistry", "无机化学": "inorganic-chemistry",
    "物理化学": "physical-chemistry", "高分子化学": "organic-chemistry", "经济学": "economics", "金融学": "finance", "管理学": "management",
    "电气工程": "electrical-engineering", "机械工程": "mechanical-engineering", "土木工程": "civil-engineering", "化学工程": "chemical-engineering",
    "环境工程": "environmental-engineering", "环境科学": "environmental-science", "电子工程": "electrical-engineering", "控制科学": "robotics",
    "控制科学与工程": "robotics", "自动化": "robotics", "通信工程": "computer-networks", "信息与通信工程": "computer-networks",
}
NO_DEPARTMENT = r"^\d{4}.*今|^\d{4}[-~年]|获奖|发明奖|专利奖|科技进步奖"
#: What each source of a combined inference counts.
SOURCES = {"research": 0.85, "publications": 0.75, "department": 0.65, "url": 0.55, "bio": 0.5}


def _hits(subject: Column, rules: Rules, least: int) -> Column:
    """Fields whose rule is found, in rule order, with confidence and place; nulls taken out."""
    found = [F.when(F.regexp_like(subject, F.lit(f"(?i){p}")), F.struct((-F.lit(c)).alias("less"), F.lit(i).alias("rule"), F.lit(f).alias("field"))) for i, (p, f, c) in enumerate(rules)]
    return F.when(F.length(subject) >= least, F.array_compact(F.array(*found))).otherwise(F.array().cast("array<struct<less:double,rule:int,field:string>>"))


def from_text(subject: Column, rules: Rules, most: int = 3) -> Column:
    """The `most` best fields: highest confidence first, then rule order; a field counts by its best rule."""
    ordered = F.transform(F.array_sort(_hits(subject, rules, 3)), lambda h: h["field"])
    return F.slice(F.array_distinct(ordered), 1, most)


def from_department(subject: Column, rules: Rules = DEPARTMENTS, most: int = 2) -> Column:
    """Fields of a department in rule order; texts that are careers or awards have none."""
    fields = F.array_distinct(F.transform(_hits(subject, rules, 2), lambda h: h["field"]))
    return F.when(F.regexp_like(F.coalesce(subject, F.lit("")), F.lit(NO_DEPARTMENT)), F.array().cast("array<string>")).otherwise(F.slice(fields, 1, most))


def combined(parts: dict[str, Column], most: int = 5) -> Column:
    """Fields of several sources (names of SOURCES, arrays of fields): highest weight first, then source and place."""
    def weighted(source: str, fields: Column) -> Column:
        less = -F.lit(SOURCES[source])
        return F.transform(F.coalesce(fields, F.array().cast("array<string>")), lambda f, i: F.struct(less.alias("less"), i.alias("place"), f.alias("field")))

    ordered = F.transform(F.array_sort(F.concat(*[weighted(k, c) for k, c in parts.items()])), lambda h: h["field"])
    return F.slice(F.array_distinct(ordered), 1, most)


def slugs(names: Column, zh: dict[str, str] = SLUGS_ZH, en: dict[str, str] = SLUGS_EN) -> Column:
    """Distinct slugs of an array of field names, in order: by a whole Chinese name, by the first Chinese name in it, by an English name.

    A name that no table has becomes its own slug (lower case, letters, digits and underscores); one that leaves nothing, and null, has none.
    """
    table = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    chinese, english, parts = table(zh), table(en), F.array(*[F.lit(k) for k in zh])

    def slug(name: Column) -> Column:
        key = F.regexp_replace(F.regexp_replace(F.lower(name), r"[\s-]+", "_"), "[^a-z0-9_]", "")
        held = F.get(F.filter(parts, lambda k: F.contains(name, k)), F.lit(0))
        return F.coalesce(F.try_element_at(chinese, name), F.try_element_at(chinese, held), F.try_element_at(english, key), F.nullif(key, F.lit("")))

    return F.array_distinct(F.array_compact(F.transform(names, slug)))


def all_fields(subject: Column, rules: Rules) -> Column:
    """Every field that a rule finds, distinct, in rule order; none for null."""
    found = [F.when(F.regexp_like(subject, F.lit(f"(?i){p}")), F.lit(f)) for p, f, *_ in rules]
    return F.array_distinct(F.array_compact(F.array(*found)))


def addition(persons: DataFrame, links: DataFrame, rules: Rules) -> DataFrame:
    """person_id, field: fields found in `text` of active persons (id, is_active, text) that links (person_id, field) lacks."""
    found = persons.where("is_active").select(F.col("id").alias("person_id"), F.explode(all_fields(F.col("text"), rules)).alias("field"))
    return found.join(links.select("person_id", "field"), ["person_id", "field"], "left_anti")


def repaired(existing: DataFrame, inferred: DataFrame) -> DataFrame:
    """person_id, status, added, removed, unchanged, fields of existing links (person_id, field) and inferred ones (person_id, fields array).

    Status `changed`: the inferred fields take the old ones' place; `unchanged`: they are the same; `no_fields_inferred`:
    the old ones stay, though removed names them. Every person of either side has a row; arrays but fields are sorted.
    """
    old = existing.groupBy("person_id").agg(F.collect_set("field").alias("old"))
    none = F.array().cast("array<string>")
    both = old.join(inferred.select("person_id", F.array_distinct("fields").alias("new")), "person_id", "full_outer").select("person_id", F.coalesce("old", none).alias("old"), F.coalesce("new", none).alias("new"))
    added, removed = F.array_sort(F.array_except("new", "old")), F.array_sort(F.array_except("old", "new"))
    status = F.when(F.size("new") == 0, "no_fields_inferred").when((F.size(added) == 0) & (F.size(removed) == 0), "unchanged").otherwise("changed")
    kept = F.when(F.size("new") == 0, F.array_sort("old")).otherwise(F.col("new"))
    return both.select("person_id", status.alias("status"), added.alias("added"), removed.alias("removed"), F.array_sort(F.array_intersect("old", "new")).alias("unchanged"), kept.alias("fields"))


def in_phases(persons: DataFrame, links: DataFrame, phases: list[tuple[Column, Column]]) -> DataFrame:
    """person_id, phase, field, is_primary of active persons without links: the first phase whose condition holds decides, even if it finds nothing.

    A phase is (condition, array of fields); the first field is the primary one. One pass over the persons: a phase
    leaves out the ids of the earlier ones because only the first condition counts.
    """
    bare = persons.where("is_active").join(links.select(F.col("person_id").alias("id")), "id", "left_anti")
    phase, found = F, F
    for i, (holds, fields) in enumerate(phases):
        holds = F.coalesce(holds, F.lit(False))
        phase, found = phase.when(holds, i + 1), found.when(holds, fields)
    rows = bare.select(F.col("id").alias("person_id"), phase.alias("phase"), found.alias("found")).where("phase is not null")
    return rows.select("person_id", "phase", F.posexplode("found").alias("place", "field")).select("person_id", "phase", "field", (F.col("place") == 0).alias("is_primary"))


def collapsed(slugs: Column, groups: dict[str, list[str]]) -> Column:
    """Slugs with the members of a group replaced by its parent; order kept, repeats dropped."""
    parent = {member: name for name, members in groups.items() for member in members}
    table = F.create_map(*[F.lit(x) for pair in parent.items() for x in pair])
    return F.array_distinct(F.transform(slugs, lambda s: F.coalesce(F.try_element_at(table, s), s)))


def missing_links(persons: DataFrame, links: DataFrame, rules: Rules = DEPARTMENTS) -> DataFrame:
    """person_id, field: what the department says of active persons that have no field yet."""
    bare = persons.where("is_active").join(links.select(F.col("person_id").alias("id")), "id", "left_anti")
    return bare.select(F.col("id").alias("person_id"), F.explode(from_department(F.col("department"), rules)).alias("field"))


def research_text(updates: DataFrame) -> DataFrame:
    """person_id, text: titles and descriptions of a person's updates, joined in order of id."""
    each = F.concat_ws(" ", "title", F.coalesce("description", F.lit("")))
    return updates.groupBy("person_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", each.alias("t")))), lambda r: r["t"]), "; ").alias("text"))


def filled_department(c: Column) -> Column:
    return text.filled(c) & ~F.regexp_like(c, F.lit(NO_DEPARTMENT))
