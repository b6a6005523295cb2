"""Co-author graph, PageRank, authority and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from .stored import Steps


#: Pairs of authors that a partition counts, and nodes (an id and a number or two each) that are broadcast at most.
PAIRS, MAX_BROADCAST = 2_000_000, 2_000_000


def _small(nodes: DataFrame, n: int) -> DataFrame:
    return F.broadcast(nodes) if n <= MAX_BROADCAST else nodes


def coauthor_edges(authorships: DataFrame, most_authors: int | None = None) -> DataFrame:
    """from_id, to_id, papers, weight (both directions) of (paper_id, person_id) rows; weight = min(1, ln(papers + 1) / ln 8).

    A paper has as many pairs as its authors allow, which is what the graph is; most_authors leaves out papers with more.
    Pairs are counted in one direction and turned round afterwards, in as many partitions as PAIRS asks for.
    """
    return _coauthor_edges(authorships, most_authors)[0]


def stored_coauthor_edges(authorships: DataFrame, steps: Steps, most_authors: int | None = None) -> DataFrame:
    """coauthor_edges as a table written once, a node's edges in one file: for those who read them several times."""
    edges, n = _coauthor_edges(authorships, most_authors)
    return steps.write(edges.repartition(n, "from_id"), "edges")


def _coauthor_edges(authorships: DataFrame, most_authors: int | None) -> tuple[DataFrame, int]:
    who = authorships.select("paper_id", "person_id").where("paper_id is not null and person_id is not null")
    sizes = (who.distinct() if most_authors else who).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    if most_authors:
        sizes = sizes.where(F.col("n") <= most_authors)
        who = who.join(sizes.select("paper_id"), "paper_id", "left_semi")
    n = max(1, -(-int(sizes.agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0] or 0) // PAIRS))
    dealt = who.repartition(n, "paper_id").distinct()
    pairs = dealt.withColumnRenamed("person_id", "a").join(dealt.withColumnRenamed("person_id", "b"), "paper_id").where("a < b")
    counted = pairs.select("a", "b").repartition(n, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("papers"))
    weighed = counted.withColumn("weight", half_up(F.least(F.lit(1.0), F.log(F.col("papers") + 1.0) / F.log(F.lit(8.0))), 6))
    ways = F.array(F.struct(F.col("a").alias("from_id"), F.col("b").alias("to_id")), F.struct(F.col("b").alias("from_id"), F.col("a").alias("to_id")))
    return weighed.select(F.inline(ways), "papers", "weight"), n


def name_lookup_edges(pubs: DataFrame, persons: DataFrame) -> DataFrame:
    """paper_id, person_id: authors of pubs (id, authors parted by ';') found among the persons' names, case and blanks ignored."""
    names = persons.select("id", F.explode(F.array_distinct(F.array_compact(F.array(F.trim(F.lower("name_zh")), F.trim(F.lower("name_en")))))).alias("name")).where("name <> ''")
    authors = pubs.select(F.col("id").alias("paper_id"), F.explode(F.split("authors", ";")).alias("author")).select("paper_id", F.trim(F.lower("author")).alias("name")).where(F.length("name") > 1)
    return authors.join(names, "name").select("paper_id", F.col("id").alias("person_id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("from_id").agg(F.count(F.lit(1)).alias("degree"))


def pagerank_step(ranks: DataFrame, edges: DataFrame, n: int, damping: float = 0.85, degree: DataFrame | None = None) -> DataFrame:
    """One iteration: contributions are rank / out-degree * weight; degrees ignore weights and nothing is given back for dangling nodes.

    Up to MAX_BROADCAST nodes go to the edges, which then are not shuffled. degree: degrees(edges), where it is known.
    """
    senders = (degrees(edges) if degree is None else degree).join(ranks.select(F.col("id").alias("from_id"), "rank"), "from_id")
    sent = edges.select("from_id", "to_id", "weight").join(_small(senders, n), "from_id")
    received = sent.groupBy(F.col("to_id").alias("id")).agg(F.sum(F.col("rank") / F.col("degree") * F.col("weight")).alias("in"))
    return ranks.select("id").join(received, "id", "left").select("id", ((1 - damping) / n + damping * F.coalesce("in", F.lit(0.0))).alias("rank"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, most: int = 100, tolerance: float = 1e-6, stored: bool = False) -> DataFrame:
    """id, rank after convergence. Only the largest change of an iteration reaches the driver. stored: edges are a written table."""
    nodes = nodes.select("id").distinct()
    n = nodes.count()
    steps = Steps(nodes.sparkSession)
    edges = edges if stored else steps.write(edges, "edges")
    degree = steps.write(degrees(edges), "degrees")
    ranks, last = steps.write(nodes.withColumn("rank", F.lit(1.0 / max(1, n))), "ranks0"), "ranks0"
    for i in range(1, most + 1 if n else 1):
        # The round before is still read for the change, so two names take turns.
        last = f"ranks{i % 2}"
        new = steps.write(pagerank_step(ranks, edges, n, damping, degree), last)
        change = new.join(ranks.withColumnRenamed("rank", "old"), "id").agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = new
        if change < tolerance:
            break
    steps.keep_only(last)
    return ranks


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that each id of the edges (a, b) reaches, by least labels with jumps to a label's own label."""
    steps = Steps(edges.sparkSession)
    both = steps.write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = steps.write(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("component")), "labels")
    while True:
        heard = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("near")), "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        jump = labels.join(labels.select(F.col("id").alias("component"), F.col("component").alias("jump")), "component").select("id", F.col("component").alias("was"), "jump")
        moved = steps.write(jump.join(heard, "id").select("id", "was", F.least("jump", "near").alias("component")), "labels")
        labels = moved.select("id", "component")
        if moved.where("component <> was").isEmpty():
            steps.keep_only("labels")
            return labels


def authority(nodes: DataFrame, edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """nodes (id, citations, h_index) with pagerank, coauthors and authority, each part over its largest value."""
    degree = edges.groupBy(F.col("from_id").alias("id")).agg(F.count(F.lit(1)).alias("coauthors"), F.avg("weight").alias("mean_weight"))
    joined = nodes.select("id", F.coalesce("citations", F.lit(0)).alias("citations"), F.coalesce("h_index", F.lit(0)).alias("h_index")).join(ranks, "id", "left").join(degree, "id", "left")
    joined = joined.select("id", "citations", "h_index", F.coalesce("rank", F.lit(0.0)).alias("rank"), F.coalesce("coauthors", F.lit(0)).alias("coauthors"), F.coalesce("mean_weight", F.lit(0.0)).alias("mean_weight"))
    top = joined.agg(F.greatest(F.lit(0.001), F.max("rank")).alias("r"), F.greatest(F.lit(1), F.max("coauthors")).alias("d"), F.greatest(F.lit(1), F.max("citations")).alias("c"), F.greatest(F.lit(1), F.max("h_index")).alias("h"))
    scored = joined.crossJoin(F.broadcast(top))  # one row
    total = 0.35 * F.col("rank") / F.col("r") + 0.20 * F.col("coauthors") / F.col("d") + 0.20 * F.col("citations") / F.col("c") + 0.15 * F.col("h_index") / F.col("h") + 0.10 * F.least(F.lit(1.0), F.col("mean_weight"))
    return scored.select("id", half_up(F.col("rank") / F.col("r"), 4).alias("pagerank"), half_up(total, 3).alias("authority"), "coauthors")


def communities(nodes: DataFrame, edges: DataFrame, most: int = 20, stored: bool = False) -> DataFrame:
    """id, community: label propagation, all nodes at once; the label with the most weight around wins, ties go to the smallest. stored: edges are a written table."""
    steps = Steps(nodes.sparkSession)
    labels = steps.write(nodes.select("id", F.col("id").alias("community")).distinct(), "labels")
    edges, n = edges if stored else steps.write(edges, "edges"), labels.count()
    for _ in range(most):
        heard = edges.join(_small(labels.withColumnRenamed("id", "to_id"), n), "to_id").groupBy(F.col("from_id").alias("id"), "community").agg(F.sum("weight").alias("w"))
        chosen = heard.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("less"), "community"))["community"].alias("new"))
        moved = steps.write(labels.join(chosen, "id", "left").select("id", F.col("community").alias("was"), F.coalesce("new", "community").alias("community")), "labels")
        labels = moved.select("id", "community")
        if moved.where("was <> community").isEmpty():
            break
    steps.keep_only("labels")
    return labels


def power_structure(authorities: DataFrame, labels: DataFrame, most: int = 50) -> DataFrame:
    """id, pagerank, authority, coauthors, community_id: the `most` highest authorities (ties: smallest id) with their community's number.

    Communities are numbered from 0 in order of their label, over all labels. Only the chosen rows' labels, at most
    `most`, are held against all labels, so no label list is sorted in one task.
    """
    top = authorities.orderBy(F.desc("authority"), "id").limit(most).join(labels, "id", "left")
    named = top.select("community").where("community is not null").distinct().select(F.col("community").alias("named"))
    every = labels.select(F.col("community").alias("label")).distinct()
    number = F.broadcast(named).join(every, F.col("label") <= F.col("named")).groupBy("named").agg((F.count(F.lit(1)) - 1).alias("community_id"))
    return top.join(number, F.col("community") == F.col("named"), "left").select("id", "pagerank", "authority", "coauthors", "community_id")
