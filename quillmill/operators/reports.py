"""Reports, reporters' figures, daily tasks and activity logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores

# Texts shown for codes.
CATEGORY_LABELS = {"ACADEMIC_MISCONDUCT": "学术不端", "RIGOROUS_RESEARCH": "严谨研究", "CONFLICT_OF_INTEREST": "利益冲突", "CITATION_MANIPULATION": "引用操纵", "OTHER": "其他"}
STATUS_LABELS = {"PENDING": "待审核", "UNDER_REVIEW": "审核中", "APPROVED": "已通过"}


def label(code: Column, labels: dict[str, str]) -> Column:
    """The text of a code; a code without one stands for itself."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), code)


def visible(reports: DataFrame, user: int | str | None, admin: bool = False, **wanted) -> DataFrame:
    """Reports that a user may see, which for all but administrators are their own, with the wanted column values (None: any)."""
    found = reports if admin else reports.where(F.col("reporter_id").eqNullSafe(F.lit(user)))
    for column, value in wanted.items():
        if value is not None:
            found = found.where(F.col(column) == value)
    return found


def report_page(reports: DataFrame, persons: DataFrame, page: int = 1, limit: int = 20) -> DataFrame:
    """A page of reports, newest first, with the person's name and the number of all."""
    total = reports.agg(F.count(F.lit(1)).alias("n")).scalar()
    chosen = reports.withColumn("total", total).orderBy(F.desc("created_at"), F.desc("id")).offset((page - 1) * limit).limit(limit)
    names = persons.select(F.col("id").alias("person_id"), F.col("name_zh").alias("person_name"))
    return chosen.join(names, "person_id", "left").select("id", "reporter_id", "person_id", "person_name", "category", "status", "severity", "created_at", "total")


def with_children(reports: DataFrame, children: DataFrame, name: str) -> DataFrame:
    """reports with an array of their children (report_id, id and more) in order of id; empty where there are none."""
    kept = [c for c in children.columns if c != "report_id"]
    found = children.groupBy(F.col("report_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in kept if c != "id"]))).alias(name))
    return reports.join(found, "id", "left").withColumn(name, F.coalesce(name, F.array()))


def user_stats(reports: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """reporter_id, total, approved, rejected, today, score_impact, accuracy of each reporter; changes: reporter_id, delta."""
    counted = reports.groupBy("reporter_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "APPROVED").alias("approved"), F.count_if(F.col("status") == "REJECTED").alias("rejected"),
        F.count_if(F.coalesce(F.col("created_at") >= F.date_trunc("day", as_of), F.lit(False))).alias("today"),
    )
    moved = changes.groupBy("reporter_id").agg(F.sum("delta").alias("moved"))
    return counted.join(moved, "reporter_id", "left").select("reporter_id", "total", "approved", "rejected", "today", F.abs(F.coalesce("moved", F.lit(0))).alias("score_impact"), scores.accuracy(F.col("approved"), F.col("rejected")).alias("accuracy"))


def completed_tasks(tasks: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """What a user has after a task: user_id, task_id, exp_gained, streak, longest_streak, level_exp, level.

    tasks: one each of user_id, with task_id, task_type, status; users: id, level_exp, current_streak, longest_streak,
    last_active. A task that isn't COMPLETED changes nothing. A streak's bonus is given on the days it grows; days after a
    break or without a past day count as the first.
    """
    days = F.date_diff(F.to_date(as_of), F.to_date("last_active"))
    done = F.col("status") == "COMPLETED"
    streak = F.when(~done | (days == 0), F.col("current_streak")).when(days == 1, F.col("current_streak") + 1).otherwise(1)
    longest = F.when(~done, F.col("longest_streak")).when(F.col("last_active").isNull(), 1).when(days == 1, F.greatest("longest_streak", "streak")).otherwise(F.col("longest_streak"))
    bonus = F.when(F.col("streak") > F.col("current_streak"), scores.streak_bonus(F.col("streak"))).otherwise(0)
    rows = tasks.join(users.withColumnRenamed("id", "user_id"), "user_id").withColumn("streak", streak).withColumn("longest_streak", longest)
    rows = rows.withColumn("exp_gained", F.when(done, scores.task_exp(F.col("task_type")) + bonus).otherwise(0)).withColumn("level_exp", F.col("level_exp") + F.col("exp_gained"))
    return rows.select("user_id", "task_id", "exp_gained", "streak", "longest_streak", "level_exp", scores.level_of(F.col("level_exp")).alias("level"))


def daily_tasks(users: DataFrame, fields: DataFrame, tasks: DataFrame, as_of: Column, each: int = 3) -> DataFrame:
    """user_id, field_id: `each` fields (least level, then id, level 1 or deeper) for every user without a task on the day. The fields are a bounded array."""
    chosen = fields.where("level >= 1").orderBy("level", "id").limit(each).agg(F.array_sort(F.collect_list("id")).alias("ids")).scalar()
    today = tasks.where(F.to_date("assigned_at") == F.to_date(as_of)).select("user_id")
    return users.select(F.col("id").alias("user_id")).join(today, "user_id", "left_anti").select("user_id", F.explode(chosen).alias("field_id"))


def placed_fields(new: DataFrame, fields: DataFrame) -> DataFrame:
    """New fields (slug, parent_id) with their level: one under the parent, 0 without one."""
    parents = fields.select(F.col("id").alias("parent_id"), (F.col("level") + 1).alias("level"))
    return new.join(parents, "parent_id", "left").withColumn("level", F.coalesce("level", F.lit(0)))


def activity(log: DataFrame, actions: list[str], limit: int = 50) -> DataFrame:
    """The latest rows of the log with one of the actions, and how many there are of each."""
    found = log.where(F.col("action").isin(actions))
    counts = found.groupBy("action").agg(F.count(F.lit(1)).alias("of_action"))
    return found.orderBy(F.desc("created_at"), F.desc("id")).limit(limit).join(counts, "action")


def sanitized_html(text: Column) -> Column:
    """Text in which no character opens a tag, an entity or an attribute."""
    for said, instead in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("/", "&#x2F;")):
        text = F.replace(text, F.lit(said), F.lit(instead))
    return text


def sanitized_url(url: Column) -> Column:
    """The URL if its scheme is http or https and it has a host; else null."""
    return F.when(F.regexp_like(url, F.lit(r"^(?i:https?)://[^\s/?#]+")), url)


def valid_email(email: Column) -> Column:
    return F.coalesce(F.regexp_like(email, F.lit(r"^[A-Za-z0-9_+-]+([.'][A-Za-z0-9_+-]+)*@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}\z")), F.lit(False))


def edu_domain(email: Column) -> Column:
    """Whether the address is of a .edu or .edu.cn domain."""
    return F.coalesce(F.regexp_like(F.lower(F.split_part(email, F.lit("@"), F.lit(2))), F.lit(r"\.edu(\.cn)?\z")), F.lit(False))


def highlight_score(score: Column, achievements: Column, votes: Column) -> Column:
    """Heat of a highlight in 0..1 of the score (70 to 130), recent achievements (to 5) and votes (to 10)."""
    share = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return scores.half_up(0.4 * share((score - 70) / 60.0) + 0.35 * F.least(F.lit(1.0), achievements / 5.0) + 0.25 * F.least(F.lit(1.0), votes / 10.0), 2)
