"""Domain frames over the driver's tables.

The reputation domain has persons, reports, updates, publications and so on; the test tables have customers, orders,
events and line items. Each frame is a list of column expressions in the SQL that Spark and DuckDB share, so the same
text feeds the DataFrame here and the common table expression of the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PERSON = {
    "id": "c_custkey",
    "name_zh": "c_name",
    "name_en": "CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 9 = 1 THEN '' ELSE lower(c_name) END",
    "title": "CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Professor' ELSE 'Lecturer' END",
    "institution": "CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE n_name END",
    "region": "r_name",
    "department": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END",
    "email": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat(lower(c_mktsegment), '@', lower(n_name), '.edu') END",
    "bio_zh": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE concat(c_mktsegment, ' of ', n_name) END",
    "h_index": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 60 AS INTEGER) END",
    "citation_count": "CAST(c_custkey * 13 % 997 AS INTEGER)",
    "orcid_id": "CASE WHEN c_custkey % 11 = 0 THEN concat('0000-', CAST(c_custkey AS VARCHAR(20))) ELSE NULL END",
    "score": "(c_acctbal + 1000) / 55.0",
    "is_active": "c_custkey % 10 <> 0",
    "last_scraped_at": "last_order",
    "metadata": "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '{\"source\": \"seed\"}' WHEN 2 THEN '{\"k\": 1}' ELSE '{\"source\": \"crawl\"}' END",
}
REPORT = {
    "id": "o_orderkey",
    "person_id": "o_custkey",
    "reporter_id": "o_orderkey % 97",
    "category": "CASE o_orderkey % 5 WHEN 0 THEN 'ACADEMIC_MISCONDUCT' WHEN 1 THEN 'RIGOROUS_RESEARCH' WHEN 2 THEN 'CONFLICT_OF_INTEREST' WHEN 3 THEN 'CITATION_MANIPULATION' ELSE 'OTHER' END",
    "severity": "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(substring(o_orderpriority, 1, 1) AS INTEGER) END",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'P' THEN 'UNDER_REVIEW' ELSE CASE WHEN o_orderkey % 11 = 0 THEN 'REJECTED' ELSE 'PENDING' END END",
    "created_at": "o_orderdate",
}
UPDATE = {
    "id": "event_id",
    "person_id": "user_id",
    "kind": "CASE event_type WHEN 'purchase' THEN 'competition' WHEN 'signup' THEN 'evaluation' ELSE 'research' END",
    "title": "concat(event_type, ' ', CAST(event_id AS VARCHAR(20)))",
    "level": "CASE WHEN value > 100 THEN '国际级' WHEN value > 50 THEN '国家级' WHEN value > 20 THEN '省部级' ELSE NULL END",
    "published_at": "ts",
}
PUBLICATION = {
    "id": "l_orderkey * 10 + l_linenumber",
    "paper_id": "l_orderkey",
    "person_id": "l_suppkey",
    "citation_count": "CAST(l_quantity AS INTEGER)",
    "published_at": "l_shipdate",
}
FIELD_LINK = {"person_id": "c_custkey", "field_id": "c_nationkey + 100", "is_primary": "c_custkey % 2 = 0"}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{expression} AS {name}" for name, expression in columns.items())


# Common table expressions of the oracles.
CTE = {
    "person": f"person AS (SELECT {_select(PERSON)} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY 1) q ON o_custkey = c_custkey)",
    "report": f"report AS (SELECT {_select(REPORT)} FROM orders)",
    "update": f"updates AS (SELECT {_select(UPDATE)} FROM events)",
    "publication": f"publication AS (SELECT {_select(PUBLICATION)} FROM lineitem)",
    "field": "field AS (SELECT r_regionkey AS id, lower(r_name) AS slug, CAST(NULL AS INTEGER) AS parent_id, 0 AS level FROM region UNION ALL SELECT n_nationkey + 100, lower(n_name), n_regionkey, 1 FROM nation)",
    "link": f"link AS (SELECT {_select(FIELD_LINK)} FROM customer WHERE c_custkey % 13 <> 0)",
    "now": "now_at AS (SELECT max(o_orderdate) AS t FROM orders)",
    "event_now": "now_at AS (SELECT max(ts) AS t FROM events)",
}


def with_(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(CTE[n] for n in names) + "\n"


class Domain:
    """The frames of one folder of tables, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _frame(self, table: DataFrame, columns: dict[str, str]) -> DataFrame:
        return table.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])

    @property
    def persons(self) -> DataFrame:
        last = self.table("orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"))
        return self._frame(self._customers().join(last, F.col("o_custkey") == F.col("c_custkey"), "left"), PERSON)

    @property
    def people(self) -> DataFrame:
        """persons without last_scraped_at, for which the orders are read."""
        return self._frame(self._customers(), {n: e for n, e in PERSON.items() if n != "last_scraped_at"})

    def _customers(self) -> DataFrame:
        return self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))

    @property
    def reports(self) -> DataFrame:
        return self._frame(self.table("orders"), REPORT)

    @property
    def updates(self) -> DataFrame:
        return self._frame(self.table("events"), UPDATE)

    @property
    def publications(self) -> DataFrame:
        return self._frame(self.table("lineitem"), PUBLICATION)

    @property
    def fields(self) -> DataFrame:
        top = self.table("region").selectExpr("r_regionkey AS id", "lower(r_name) AS slug", "CAST(NULL AS INTEGER) AS parent_id", "0 AS level")
        return top.unionByName(self.table("nation").selectExpr("n_nationkey + 100 AS id", "lower(n_name) AS slug", "n_regionkey AS parent_id", "1 AS level"))

    @property
    def links(self) -> DataFrame:
        return self._frame(self.table("customer").where("c_custkey % 13 <> 0"), FIELD_LINK)

    def now(self):
        """The last order's date: the time that takes the clock's place."""
        return self.table("orders").agg(F.max("o_orderdate").alias("t")).scalar()

    def event_now(self):
        return self.table("events").agg(F.max("ts").alias("t")).scalar()
