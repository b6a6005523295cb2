"""Finding and merging records of the same person or publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..functions.numbers import half_up


def tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(name)), r"\s+"), lambda t: t != ""))


def token_matches(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """left_id, right_id, similarity: pairs whose names' word sets have a Jaccard similarity of `least` or more.

    Names meet over their rarest words only: a pair at the threshold shares one of the first n - ceil(least * n) + 1
    words of either name in order of frequency (prefix filter). So a word that a third of all names have makes no
    bucket, and no pair is lost.
    """
    a = left.select(F.col("id").alias("left_id"), tokens(F.col("name")).alias("a"))
    b = right.select(F.col("id").alias("right_id"), tokens(F.col("name")).alias("b"))
    counts = a.select(F.explode("a").alias("word")).unionByName(b.select(F.explode("b").alias("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))

    def prefix(df: DataFrame, key: str, words: str) -> DataFrame:
        each = df.select(key, F.explode(words).alias("word"), F.size(words).alias("size")).join(counts, "word")
        rank = F.row_number().over(Window.partitionBy(key).orderBy("n", "word"))
        return each.withColumn("rank", rank).where(F.col("rank") <= F.col("size") - F.ceil(F.lit(least) * F.col("size")) + 1).select(key, "word")

    pairs = prefix(a, "left_id", "a").join(prefix(b, "right_id", "b"), "word").select("left_id", "right_id").distinct()
    scored = pairs.join(a, "left_id").join(b, "right_id").withColumn("similarity", text.jaccard(F.col("a"), F.col("b")))
    return scored.where(F.col("similarity") >= least).select("left_id", "right_id", "similarity")


def best_token_matches(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """The best right_id of each left_id among token_matches; ties go to the smallest id.

    Names of the same words are matched once, whoever has them: of equal right names only the smallest id can be the best.
    So copies of a name make no pairs, on either side.
    """
    keyed = lambda df: df.select("id", F.array_join(F.array_sort(tokens(F.col("name"))), " ").alias("name")).where("id is not null and name <> ''")
    a, firsts = keyed(left), keyed(right).groupBy("name").agg(F.min("id").alias("right_id"))
    alike = token_matches(a.select(F.col("name").alias("id"), "name").distinct(), firsts.select(F.col("name").alias("id"), "name"), least)
    best = best_matches(alike.withColumnRenamed("right_id", "name").join(firsts, "name").select("left_id", "right_id", "similarity"))
    return best_matches(a.select(F.col("id").alias("left_id"), "name").join(best.withColumnRenamed("left_id", "name"), "name").select("left_id", "right_id", "similarity"))


def best_matches(matches: DataFrame) -> DataFrame:
    """The best right_id of each left_id; ties go to the smallest id."""
    best = Window.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id")
    return matches.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def containing(inner: DataFrame, outer: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """in_id, id: rows of outer (id, scope, name) whose name holds the name of a row of inner (in_id, scope, name), scope being equal.

    A name meets the others over its rarest inner trigram, one of under three letters over itself.
    """

    def pieces(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length("name") - (n - 1)), lambda i: F.substring(F.col("name"), i, F.lit(n)))
        return F.when(F.length("name") >= n, each).otherwise(F.array().cast("array<string>"))

    every = F.array_distinct(F.concat(F.array(F.lit("")), pieces(1), pieces(2), pieces(3)))
    whole = outer.where("name is not null").select("id", *scope, F.col("name").alias("outer"), F.explode(every).alias("key"))
    counts = whole.groupBy(*scope, "key").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.length("name") >= 3, F.array_distinct(pieces(3))).otherwise(F.array("name"))
    each = inner.where("name is not null").select("in_id", *scope, F.col("name").alias("inner"), F.explode(own).alias("key")).join(counts, [*scope, "key"])
    rarest = F.row_number().over(Window.partitionBy("in_id", *scope, "inner").orderBy("n", "key"))
    chosen = each.withColumn("place", rarest).where("place = 1").select("in_id", *scope, "inner", "key")
    return chosen.join(whole, [*scope, "key"]).where(F.contains("outer", "inner")).select("in_id", "id").distinct()


def similar_names(names: DataFrame, least: float = 0.7) -> DataFrame:
    """a_id, b_id, similarity for pairs of equal institution whose names are alike; blocks are (institution, shared trigram prefix).

    Two names with a trigram similarity of `least` or more share one of the rarest trigrams of either (prefix filter).
    Names of which one holds the other meet by containing(), names of two swapped parts by the sorted parts.
    """
    rows = names.select("id", "institution", F.lower("name").alias("name"))
    grams = rows.select("id", "institution", "name", F.array_distinct(text.trigrams(F.col("name"))).alias("g"))
    counts = grams.select("institution", F.explode("g").alias("gram")).groupBy("institution", "gram").agg(F.count(F.lit(1)).alias("n"))
    each = grams.select("id", "institution", F.explode("g").alias("gram"), F.size("g").alias("size")).join(counts, ["institution", "gram"])
    rank = F.row_number().over(Window.partitionBy("id").orderBy("n", "gram"))
    # The similarity counts repeated trigrams of the first name, hence one more than the set bound.
    keys = each.withColumn("rank", rank).where(F.col("rank") <= F.col("size") - F.ceil(F.lit(least) * F.col("size")) + 2).select("id", "institution", "gram")
    other = keys.select(F.col("id").alias("b_id"), "institution", "gram")
    pairs = keys.join(other, ["institution", "gram"]).where("id < b_id").select(F.col("id").alias("a_id"), "b_id")
    held = containing(rows.withColumnRenamed("id", "in_id"), rows, ("institution",)).where("in_id <> id").select(F.least("in_id", "id").alias("a_id"), F.greatest("in_id", "id").alias("b_id"))
    two = rows.select("id", "institution", F.array_sort(F.split("name", r"\s+")).alias("parts")).where(F.size("parts") == 2)
    swapped = two.join(two.withColumnRenamed("id", "b_id"), ["institution", "parts"]).where("id < b_id").select(F.col("id").alias("a_id"), "b_id")
    pairs = pairs.unionByName(held).unionByName(swapped).distinct()
    named = pairs.join(rows.select(F.col("id").alias("a_id"), F.col("name").alias("a")), "a_id").join(rows.select(F.col("id").alias("b_id"), F.col("name").alias("b")), "b_id")
    return named.withColumn("similarity", half_up(text.name_similarity(F.col("a"), F.col("b")), 4)).where(F.col("similarity") >= least).select("a_id", "b_id", "similarity")


def distinct_publications(pubs: DataFrame) -> DataFrame:
    """Of each person's publications (person_id, seq, doi, title, year, journal): the first of every DOI and of every title.

    Titles without a letter or digit count by year and journal. A row goes if an earlier row of the person has its DOI
    or its title key, whether that row stays or not.
    """
    key = text.title_key(F.col("title"))
    fallback = F.concat_ws("|", F.coalesce(F.col("year").cast("string"), F.lit("unknown")), F.trim(F.lower(F.coalesce("journal", F.lit("")))))
    keyed = pubs.withColumn("doi_key", F.nullif(F.trim(F.lower("doi")), F.lit(""))).withColumn("text_key", F.when(F.coalesce(key, F.lit("")) != "", F.concat(F.lit("t:"), key)).otherwise(F.concat(F.lit("f:"), fallback)))
    by_doi = Window.partitionBy("person_id", "doi_key").orderBy("seq")
    by_text = Window.partitionBy("person_id", "text_key").orderBy("seq")
    first = (F.col("doi_key").isNull() | (F.row_number().over(by_doi) == 1)) & (F.row_number().over(by_text) == 1)
    return keyed.withColumn("first", first).where("first").drop("first", "doi_key", "text_key")


#: Which source is believed first, by attribute.
PRECEDENCE = {
    "name_zh": ("ORCID", "CN_UNIVERSITY", "GOOGLE_SCHOLAR", "SEMANTIC_SCHOLAR", "RESEARCHGATE"),
    "name_en": ("ORCID", "CN_UNIVERSITY", "GOOGLE_SCHOLAR", "SEMANTIC_SCHOLAR", "RESEARCHGATE"),
    "title": ("CN_UNIVERSITY", "ORCID", "GOOGLE_SCHOLAR"),
    "institution": ("CN_UNIVERSITY", "ORCID", "SEMANTIC_SCHOLAR", "RESEARCHGATE", "GOOGLE_SCHOLAR"),
    "department": ("CN_UNIVERSITY", "ORCID", "RESEARCHGATE"),
    "email": ("CN_UNIVERSITY", "ORCID", "GOOGLE_SCHOLAR", "RESEARCHGATE"),
    "bio": ("ORCID", "CN_UNIVERSITY", "RESEARCHGATE"),
    "h_index": ("SEMANTIC_SCHOLAR", "GOOGLE_SCHOLAR", "RESEARCHGATE"),
    "citation_count": ("SEMANTIC_SCHOLAR", "GOOGLE_SCHOLAR", "RESEARCHGATE"),
}


def merge_sources(rows: DataFrame) -> DataFrame:
    """One record per person_id from rows of several sources (source, source_id and the attributes of PRECEDENCE).

    An attribute is the first by its precedence that is neither null, empty nor 0. One group-by: each attribute is the
    minimum of (rank of the source, value), so nothing is pivoted or collected. A person with one source keeps its row.
    """

    def first_of(column: str, order: tuple[str, ...]) -> Column:
        value = F.col(column)
        told = value.isNotNull() & (value.cast("string") != "") & (value.cast("string") != "0")
        rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
        return F.min(F.when(told & (rank > 0), F.struct(rank.alias("rank"), value.alias("value"))))["value"]

    known = [c for c in PRECEDENCE if c in rows.columns]
    grouped = rows.groupBy("person_id").agg(
        F.count_distinct("source").alias("n_sources"), F.array_sort(F.collect_set("source")).alias("sources"),
        *[first_of(c, PRECEDENCE[c]).alias(c) for c in known],
        *[F.max(F.when(F.col("source") == s, F.col("source_id"))).alias(c) for s, c in (("ORCID", "orcid_id"), ("GOOGLE_SCHOLAR", "scholar_id"))],
    )
    if "institution" in known:
        grouped = grouped.withColumn("institution", F.when(F.col("n_sources") > 1, text.normal_institution(F.col("institution"))).otherwise(F.col("institution")))
    told = {c: F.col(c).isNotNull() for c in (*known, "orcid_id")}
    return grouped.withColumn("confidence", scores.confidence(F.col("n_sources"), told))


def person_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Similarity of two records: name 0.4, institution 0.25 (0.15 if one name holds the other), fields 0.15, e-mail 0.1, department 0.1."""
    ia, ib = F.lower(text.normal_institution(a["institution"])), F.lower(text.normal_institution(b["institution"]))
    same = lambda c: F.coalesce(F.lower(a[c]) == F.lower(b[c]), F.lit(False)) & text.filled(a[c])
    total = text.name_similarity(a["name"], b["name"]) * 0.4
    total += F.when(ia == ib, 0.25).when(F.contains(ia, ib) | F.contains(ib, ia), 0.15).otherwise(0.0)
    total += text.jaccard(a["fields"], b["fields"]) * 0.15
    return total + F.when(same("email"), 0.1).otherwise(0.0) + F.when(same("department"), 0.1).otherwise(0.0)


def new_and_known(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """incoming rows whose keys exist not yet, and those whose keys exist. Rows with a null key count as new."""
    have = existing.select(*keys).distinct()
    return incoming.join(have, keys, "left_anti"), incoming.join(have, keys, "left_semi")


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """existing with the incoming rows whose keys it lacks, one row per key."""
    new, _ = new_and_known(incoming.dropDuplicates(keys), existing, keys)
    return existing.unionByName(new, allowMissingColumns=True)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """existing with values of incoming where keys meet (nulls don't overwrite), and incoming's other rows added."""
    fresh = incoming.dropDuplicates(keys)
    values = [c for c in existing.columns if c not in keys and c in fresh.columns]
    renamed = fresh.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values])
    joined = existing.join(renamed, keys, "full_outer")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in values else F.col(c) for c in existing.columns])


def merge_persons(persons: DataFrame, merges: DataFrame) -> DataFrame:
    """persons after merging source_id into target_id: the target's nulls are filled from the source, the source is switched off."""
    columns = [c for c in persons.columns if c not in ("id", "is_active")]
    source = persons.select(F.col("id").alias("source_id"), *[F.col(c).alias(f"_from_{c}") for c in columns])
    given = merges.join(source, "source_id").withColumnRenamed("target_id", "id")
    filled = persons.join(given.drop("source_id"), "id", "left").select("id", "is_active", *[F.coalesce(c, f"_from_{c}").alias(c) for c in columns])
    gone = merges.select(F.col("source_id").alias("id"), F.lit(True).alias("_gone"))
    return filled.join(gone, "id", "left").withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).drop("_gone").select(persons.columns)


def reassign(children: DataFrame, merges: DataFrame) -> DataFrame:
    """children with person_id moved from source_id to target_id."""
    moves = merges.select(F.col("source_id").alias("person_id"), "target_id")
    return children.join(moves, "person_id", "left").withColumn("person_id", F.coalesce("target_id", "person_id")).drop("target_id").select(children.columns)


def candidates(incoming: DataFrame, existing: DataFrame, ids: tuple[str, ...] = ("orcid_id", "scholar_id")) -> DataFrame:
    """in_id, id: existing rows that an incoming row may be, as a union of equi-joins.

    By each external id; and, for rows without such a hit, active rows whose name is or holds a written variant of the
    name (case ignored) and, where the name met anything, those whose institution holds the row's. Distinct.
    """
    by_id = [incoming.select(F.col("id").alias("in_id"), c).where(F.col(c).isNotNull()).join(existing.select("id", c), c).select("in_id", "id") for c in ids if c in incoming.columns and c in existing.columns]
    exact = by_id[0] if by_id else incoming.select(F.col("id").alias("in_id"), "id").where(F.lit(False))
    for more in by_id[1:]:
        exact = exact.unionByName(more)
    rest = incoming.join(exact.select(F.col("in_id").alias("id")), "id", "left_anti")
    name = F.coalesce(F.nullif(F.col("name_en"), F.lit("")), F.col("name_zh"))
    variants = F.slice(text.name_variants(text.canonical_name(name)), 1, 5)
    told = rest.select(F.col("id").alias("in_id"), F.explode(F.transform(variants, lambda v: F.lower(v))).alias("key"))
    known = existing.where("is_active").select("id", F.explode(F.array_distinct(F.array_compact(F.array(F.lower(text.canonical_name(F.col("name_zh"))), F.lower(text.canonical_name(F.col("name_en"))))))).alias("key"))
    active = existing.where("is_active")
    stored = active.select("id", F.explode(F.array_compact(F.array(F.lower("name_zh"), F.lower("name_en")))).alias("name"))
    named = told.join(known, "key").select("in_id", "id").unionByName(containing(told.where("key <> ''").withColumnRenamed("key", "name"), stored)).distinct()
    places = active.select(F.lower("institution").alias("name")).distinct().select(F.col("name").alias("id"), "name")
    met = rest.join(named.select(F.col("in_id").alias("id")).distinct(), "id", "left_semi").where(text.filled(F.col("institution"))).select(F.col("id").alias("in_id"), F.lower("institution").alias("name"))
    located = containing(met, places).withColumnRenamed("id", "place").join(active.select("id", F.lower("institution").alias("place")), "place").select("in_id", "id")
    return exact.unionByName(named).unionByName(located).distinct()


def record_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Similarity of an incoming and a stored record: external ids up to 0.5 where there are any, name 0.4, institution 0.1, over their sum, at most 1."""
    same = lambda c: F.coalesce(a[c] == b[c], F.lit(False))
    any_id = a["orcid_id"].isNotNull() | a["scholar_id"].isNotNull()
    score = F.when(same("orcid_id"), 0.5).otherwise(0.0) + F.when(same("scholar_id"), 0.4).otherwise(0.0)
    score = score + F.coalesce(text.name_similarity(a["name"], b["name"]), F.lit(0.0)) * 0.4
    score = score + F.when(F.coalesce(F.lower(a["institution"]) == F.lower(b["institution"]), F.lit(False)), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), score / F.when(any_id, 1.0).otherwise(0.5))


def decisions(incoming: DataFrame, existing: DataFrame, high: float = 0.85, medium: float = 0.65) -> DataFrame:
    """in_id, id, similarity, decision (match, review, new): the best candidate of every incoming row; ties go to the smallest id."""
    name = lambda p: F.coalesce(F.nullif(F.col(f"{p}_name_en"), F.lit("")), F.col(f"{p}_name_zh"))
    columns = ("name_zh", "name_en", "institution", "orcid_id", "scholar_id")
    tell = lambda df, p, key: df.select(F.col("id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    pairs = candidates(incoming, existing).join(tell(incoming, "a", "in_id"), "in_id").join(tell(existing, "b", "id"), "id")
    record = lambda p: {"name": name(p), **{c: F.col(f"{p}_{c}") for c in ("institution", "orcid_id", "scholar_id")}}
    scored = pairs.withColumn("similarity", record_similarity(record("a"), record("b")))
    best = scored.groupBy("in_id").agg(F.max(F.struct("similarity", (-F.col("id")).alias("least"))).alias("m"))
    joined = incoming.select(F.col("id").alias("in_id")).join(best, "in_id", "left")
    value = F.coalesce("m.similarity", F.lit(0.0))
    return joined.select("in_id", F.when(value >= medium, -F.col("m.least")).alias("id"), value.alias("similarity"), F.when(value >= high, "match").when(value >= medium, "review").otherwise("new").alias("decision"))


def directory_match(display: Column, works: Column, orcid: Column, institutions: Column, name_en: Column, name_zh: Column, institution: Column) -> Column:
    """Confidence that an entry of an author directory is our person: name 0.45, institution 0.30, plausible work count 0.15, an ORCID 0.10; accepted from 0.5."""
    d, en, zh, inst = F.lower(display), F.lower(name_en), F.lower(F.regexp_replace(name_zh, r"\s+", "")), F.lower(institution)
    tight = F.regexp_replace(d, r"\s+", "")
    parts = F.split(en, r"\s+")
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    english = F.when((tight == F.regexp_replace(en, r"\s+", "")) | F.contains(d, en) | F.contains(en, d), 0.25).when(F.contains(d, first) & F.contains(d, last), 0.20).when(F.contains(d, last), 0.12).otherwise(0.0)
    letters = F.split(zh, "")
    overlap = F.size(F.filter(letters, lambda c: F.contains(tight, c))) / F.greatest(F.size(letters), F.lit(1))
    chinese = F.when(F.contains(tight, zh) | F.contains(zh, tight), 0.20).otherwise(overlap * 0.20)
    names = F.transform(institutions, lambda n: F.lower(n))
    where = F.when(F.array_contains(names, inst), 0.30).when(F.exists(names, lambda n: F.contains(n, inst) | F.contains(inst, n)), 0.22).otherwise(0.0)
    amount = F.when(works.between(10, 500), 0.15).when(works.between(5, 800), 0.10).otherwise(0.0)
    zero = F.lit(0.0)
    return F.coalesce(english, zero) + F.coalesce(chinese, zero) + F.coalesce(where, zero) + amount + F.when(orcid.isNotNull(), 0.10).otherwise(0.0)


def graph_service_match(found: Column, aliases: Column, affiliations: Column, papers: Column, name: Column, institution: Column) -> Column:
    """Confidence of a citation-graph service's entry: equal name 0.5, one in the other 0.35, alias 0.25; affiliation 0.4; over 10 and over 50 papers 0.05 each; accepted from 0.4."""
    f, n, i = F.lower(found), F.lower(name), F.lower(institution)
    within = lambda a, b: F.contains(a, b) | F.contains(b, a)
    alias = F.coalesce(F.exists(aliases, lambda a: within(F.lower(a), n)), F.lit(False))
    named = F.when(f == n, 0.5).when(within(f, n), 0.35).when(alias, 0.25).otherwise(0.0)
    located = F.when(F.coalesce(F.exists(affiliations, lambda a: within(F.lower(a), i)), F.lit(False)), 0.4).otherwise(0.0)
    return named + located + F.when(papers > 10, 0.05).otherwise(0.0) + F.when(papers > 50, 0.05).otherwise(0.0)


def key_by_part(institution: Column, parts: list[tuple[str, str]]) -> Column:
    """Key of the first part, in the list's order, that the institution's name holds, case aside; null for none."""
    said, out = F.lower(institution), F
    for part, key in parts:
        out = out.when(F.contains(said, F.lit(part.lower())), key)
    return out.otherwise(F.lit(None).cast("string")) if parts else F.lit(None).cast("string")


def united(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per key with the distinct members, sorted, of each array column. Members are made distinct before they are gathered."""
    out = rows.select(key).distinct()
    for c in columns:
        members = rows.select(key, F.explode(c).alias("_member")).where("_member is not null").distinct()
        out = out.join(members.groupBy(key).agg(F.array_sort(F.collect_list("_member")).alias(c)), key, "left")
    return out.select(key, *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in columns])


def shown_name(record: dict[str, Column]) -> Column:
    """The name of a stored record (name_zh, name_en) that is compared: the English one if there is any, without titles."""
    return text.canonical_name(F.coalesce(F.nullif(record["name_en"], F.lit("")), record["name_zh"]))


def duplicate_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Similarity of two stored records (name by shown_name, institution): name 0.6, equal institution 0.4, one in the other 0.25.

    Names go without titles and keep their case where they are equal or one holds the other; shared trigrams count with
    repeats, over all distinct ones. A missing institution adds nothing.
    """
    na, nb = a["name"], b["name"]
    name = F.when(na == nb, 1.0).when(F.contains(na, nb) | F.contains(nb, na), 0.9).otherwise(text.shared_trigrams(F.lower(na), F.lower(nb)))
    ia, ib = (F.trim(F.lower(F.nullif(r["institution"], F.lit("")))) for r in (a, b))
    place = F.when(ia == ib, 0.4).when(F.contains(ia, ib) | F.contains(ib, ia), 0.25).otherwise(0.0)
    return F.coalesce(name, F.lit(0.0)) * 0.6 + place


def institutions_of_slugs(keys: DataFrame, persons: DataFrame) -> DataFrame:
    """key, institution of slugs (key): an active person's institution with that ASCII slug, else one equal to the decoded key; the smallest person's."""
    known = persons.where("is_active and institution is not null").groupBy("institution").agg(F.min("id").alias("id"))
    ascii = F.regexp_replace(F.regexp_replace(F.lower("institution"), r"\s+", "-"), "[^a-z0-9-]", "")
    by_slug = keys.select("key").distinct().join(known.select(ascii.alias("key"), F.lit(0).alias("tier"), "id", "institution"), "key")
    by_name = keys.select("key", F.try_url_decode("key").alias("institution")).distinct().join(known, "institution").select("key", F.lit(1).alias("tier"), "id", "institution")
    best = by_slug.unionByName(by_name).groupBy("key").agg(F.min(F.struct("tier", "id", "institution")).alias("b"))
    return keys.join(best, "key", "left").select("key", F.col("b.institution").alias("institution"))
